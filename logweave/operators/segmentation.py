"""Physical lines to logical events, and the checks of a header pattern.

Lines carry (file, line_no, line). Order inside a file is the line number; a file is one window partition. `bounded=True` deals a file into
stretches that begin at lines which surely open an event (a blank line before them or a header), so that one huge file is no single task: the event's number is then
the line number of its first line, which needs only the last boundary before each line, found by stretch.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import constants as C
from logweave.functions.parsing import any_of, strip
from logweave.session import Scratch

STRETCH = 100_000


def safety(pattern: str, longest: int = 1000, alternatives: int = 25) -> tuple[bool, str]:
    """Whether a header pattern may be used: anchored, short, no catch-all, few alternatives, and valid for Python and Java."""
    if not pattern:
        return False, "empty pattern"
    if not pattern.startswith("^"):
        return False, "pattern must start with ^"
    if len(pattern) > longest:
        return False, f"pattern too long: {len(pattern)} > {longest}"
    if pattern in C.CATCH_ALLS:
        return False, "catch-all pattern"
    if (n := top_level_alternatives(pattern)) > alternatives:
        return False, f"too many alternatives: {n} > {alternatives}"
    try:
        re.compile(pattern)
    except re.error as error:
        return False, f"pattern does not compile: {error}"
    return True, "ok"


def top_level_alternatives(pattern: str) -> int:
    bare = re.sub(r"\\.", "", pattern, flags=re.S)
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    while (less := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = less
    return 1 + bare.split("(")[0].count("|")


def flag_lines(lines: DataFrame, header: str = C.HEADER, scratch: Scratch | None = None) -> DataFrame:
    """lines with is_blank, is_header, prev_blank, starts (opens an event) and event_line, the number of the first line of its event. scratch: each line is matched once and what is known of it written, instead of anew for each part."""
    kept = scratch.keep if scratch else lambda rows, name: rows
    rows = lines.withColumns({"is_blank": strip(F.col("line")) == "", "is_header": F.col("line").rlike(header), "_stretch": F.floor(F.col("line_no") / STRETCH)})
    rows = kept(rows, "matched")
    inside = Window.partitionBy("file", "_stretch").orderBy("line_no")
    rows = rows.withColumn("_prev", F.lag("is_blank").over(inside))
    ends = rows.groupBy("file", "_stretch").agg(F.max_by("is_blank", "line_no").alias("_last"), F.max(F.when(~F.col("is_blank") & F.col("is_header"), F.col("line_no"))).alias("_h"), F.count(F.lit(1)).alias("_n"))
    # A row for each stretch of a file: carries whether the last line before a stretch was blank.
    before = ends.select("file", "_stretch", F.lag("_last").over(Window.partitionBy("file").orderBy("_stretch")).alias("_carry"))
    rows = rows.join(before, ["file", "_stretch"])
    rows = rows.withColumn("prev_blank", F.coalesce("_prev", "_carry", F.lit(True)))
    rows = rows.withColumn("starts", ~F.col("is_blank") & (F.col("is_header") | F.col("prev_blank")))
    opened = rows.withColumn("_open", F.last(F.when(F.col("starts"), F.col("line_no")), ignorenulls=True).over(inside))
    opened = kept(opened, "opened")
    last = (opened if scratch else rows).groupBy("file", "_stretch").agg(F.max(F.when(F.col("starts"), F.col("line_no"))).alias("_last_open"))
    carried = last.select("file", "_stretch", F.last("_last_open", ignorenulls=True).over(Window.partitionBy("file").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    return opened.join(carried, ["file", "_stretch"]).withColumn("event_line", F.coalesce("_open", "_from")).drop("_stretch", "_prev", "_carry", "_open", "_from")


def assemble(lines: DataFrame, header: str = C.HEADER, flagged: DataFrame | None = None) -> DataFrame:
    """(file, line_no, event, line_count, first_line_is_header, source): events with their lines trimmed and joined by " | "; blank lines only separate. flagged: `flag_lines` of them, if made before."""
    flagged = (flag_lines(lines, header) if flagged is None else flagged).where(~F.col("is_blank"))
    parts = F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("line")).alias("line"))))
    events = flagged.groupBy("file", F.col("event_line").alias("line_no")).agg(F.array_join(F.transform(parts, lambda p: p["line"]), " | ").alias("event"), F.count(F.lit(1)).alias("line_count"), F.min_by("is_header", "line_no").alias("first_line_is_header"))
    return events.withColumn("source", F.when(F.col("first_line_is_header"), "regex").otherwise("orphan"))


def strong_header(line):
    return (strip(line) != "") & any_of(strip(line), C.STRONG_HEADERS)


def validate(lines: DataFrame, header: str = C.HEADER, parser: Callable[[Column], Column] | None = None, flagged: DataFrame | None = None) -> DataFrame:
    """One row: the counters and rates of a header pattern over all lines, and whether it is accepted.

    parser: a column function from an event to its fields, null where it cannot read it; at least 95 % of the events must then be read. flagged: `flag_lines` of the lines, if made before."""
    flagged = flag_lines(lines, header) if flagged is None else flagged
    line = F.col("line")
    strong = strong_header(line) & ~F.col("is_header")
    flat = strong & ~line.rlike(r"^\s")
    internal = strong & ~F.col("starts")
    n = lambda condition: F.count_if(condition)
    counts = flagged.agg(
        F.count(F.lit(1)).alias("total_lines"), n(~F.col("is_blank")).alias("nonempty_lines"), n(F.col("is_blank")).alias("blank_lines"), n(~F.col("is_blank") & F.col("is_header")).alias("header_matches"),
        n(~F.col("is_blank") & flat).alias("unmatched_strong_headers"), n(~F.col("is_blank") & internal).alias("internal_header_candidates"), n(F.col("starts")).alias("total_events"), n(F.col("starts") & ~F.col("is_header")).alias("orphan_events"),
    )
    sizes = flagged.where(~F.col("is_blank")).groupBy("file", "event_line").agg(F.count(F.lit(1)).alias("size"))
    spread = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("event_lines"), F.max("size").alias("max_lines"), F.min("size").alias("min_lines"), F.count_if(F.col("size") > 1).alias("multi_line_events"), F.count_if(F.col("size") == 1).alias("single_line_events"))
    both = counts.crossJoin(spread)  # one row each
    part = lambda a, b: F.coalesce(F.col(a) * 100.0 / F.nullif(b, F.lit(0)), F.lit(0.0))
    both = both.withColumns(
        {
            "coverage": part("header_matches", F.col("header_matches") + F.col("internal_header_candidates")), "all_line_ratio": part("header_matches", F.col("nonempty_lines")),
            "under_segmentation_rate": part("internal_header_candidates", F.col("header_matches") + F.col("internal_header_candidates")), "zero_loss": F.col("event_lines") == F.col("nonempty_lines"),
        }
    )
    read = F.lit(0).cast("long") if parser is None else F.count_if(parser(F.col("event")).isNotNull())
    parsed = assemble(lines, header, flagged).agg(F.count(F.lit(1)).alias("parser_attempts"), read.alias("parser_success")) if parser else lines.sparkSession.range(1).select(F.lit(0).cast("long").alias("parser_attempts"), read.alias("parser_success"))
    both = both.crossJoin(parsed).withColumn("parser_ratio", F.coalesce(F.col("parser_success") * 100.0 / F.nullif("parser_attempts", F.lit(0)), F.lit(100.0)))  # one row
    return both.withColumn("accepted", (F.col("header_matches") > 0) & (F.col("coverage") >= 99) & (F.col("internal_header_candidates") == 0) & F.col("zero_loss") & (F.col("parser_ratio") >= 95))


def samples(lines: DataFrame, header: str = C.HEADER, failed: int = 30, positive: int = 12, internal: int = 30, chars: int = 700) -> DataFrame:
    """(kind, nth, file, line_no, line): first distinct unmatched strong headers, first matches, and first strong headers inside events."""
    flagged = flag_lines(lines, header).where(~F.col("is_blank"))
    text = F.substring("line", 1, chars)
    missed = flagged.where(strong_header(F.col("line")) & ~F.col("is_header")).groupBy(text.alias("line")).agg(F.min(F.struct("file", "line_no")).alias("at")).select(F.lit("failed").alias("kind"), "at.file", "at.line_no", "line").orderBy("file", "line_no").limit(failed)
    hit = flagged.where("is_header").select(F.lit("positive").alias("kind"), "file", "line_no", text.alias("line")).orderBy("file", "line_no").limit(positive)
    inner = flagged.where(strong_header(F.col("line")) & ~F.col("is_header") & ~F.col("starts")).select(F.lit("internal").alias("kind"), "file", "line_no", text.alias("line")).orderBy("file", "line_no").limit(internal)
    both = missed.unionByName(hit).unionByName(inner)
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("file", "line_no")))


DIGITS, LETTERS = "9", "A"  # in a shape: a run of digits, a run of letters


def shape(text: Column) -> Column:
    """A text with each run of digits as 9 and each run of letters as A."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}+", LETTERS), r"\d+", DIGITS)


def pattern_of(shapes: list[str]) -> str:
    """A header pattern that takes lines that begin with one of the shapes."""
    one = lambda s: "".join({DIGITS: r"\d+", LETTERS: r"[A-Za-z]+", " ": r"\s+"}.get(c) or re.escape(c) for c in s)
    return "^(?:" + "|".join(map(one, shapes)) + ")"


def induce(lines: DataFrame, words: int = 4, most: int = 6, share: float = 0.02, stands: float = 0.9) -> list[str]:
    """Header patterns from the shapes of lines, best first; for formats that the built-in one does not know and without a model.

    A line that begins without white space has a shape for each number of its first words, up to `words`. A shape may open an event if it holds a time: at least three runs of digits, or an epoch of ten digits or more. Of the
    shapes that begin alike, the longest counts that still holds `stands` of the lines of the shortest. The first candidate takes all shapes with a `share` of such lines (`most` at most), the second
    the most frequent one alone. Shapes are counted in partial sums; only those with a share come to the driver.
    """
    head = F.regexp_replace(F.substring("line", 1, 200), r"\s+", " ")
    flat = lines.where(~F.col("line").rlike(r"^\s") & (strip(F.col("line")) != "")).select(head.alias("h"), F.filter(F.split(head, " "), lambda w: w != "").alias("w"))
    starts = flat.select(F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(words), F.size("w"))), lambda n: F.struct(n.alias("n"), F.array_join(F.slice("w", 1, n), " ").alias("p")))).alias("s"))
    timed = F.col("s.p").rlike(r"(?:\d+\D+){2}\d+|\d{10}")
    counted = starts.where(timed).groupBy(F.col("s.n").alias("n"), shape(F.col("s.p")).alias("shape")).agg(F.count(F.lit(1)).alias("k"))
    total = starts.where(timed).agg(F.max("s.n")).first()[0]
    if total is None:
        return []
    all_timed = flat.where(F.array_join(F.slice("w", 1, words), " ").rlike(r"(?:\d+\D+){2}\d+|\d{10}")).count()
    frequent = sorted(((r["n"], r["shape"], r["k"]) for r in counted.where(F.col("k") >= share * all_timed).collect()), key=lambda r: (r[0], -r[2], r[1]))  # words / share at most
    best: dict[str, tuple[str, int, int]] = {}  # by the shortest shape: (longest that stands, its lines, lines of the shortest)
    for _, text, k in frequent:
        root = next((r for r in best if text.startswith(r)), None)
        if root is None:
            best[text] = (text, k, k)
        elif k >= stands * best[root][2]:
            best[root] = (text, k, best[root][2])
    chosen = [s for s, _, _ in sorted(best.values(), key=lambda v: (-v[1], v[0]))][:most]
    return list(dict.fromkeys([pattern_of(chosen), pattern_of(chosen[:1])])) if chosen else []


@dataclass
class Segmentation:
    """What the controller settled on."""

    header: str
    verified: bool
    origin: str
    attempts: list[dict] = field(default_factory=list)
    flagged: DataFrame | None = None  # the lines as flagged by this header, where they were written


def settle(
    lines: DataFrame, candidates: list[str] = (), strict: bool = True, rounds: int = 3, parser: Callable[[Column], Column] | None = None,
    refine: Callable[[dict, DataFrame], str | None] | None = None, critic: Callable[[list[dict]], str | None] | None = None, discover: bool = True, scratch: Scratch | None = None,
) -> Segmentation:
    """The header pattern that passes its checks: candidates in turn, then what `refine` makes of the report and samples of the last one, `rounds` patterns in all; then
    what `critic` makes of all attempts; then the built-in pattern. strict refuses one that fails its checks. discover: lines of which the built-in pattern takes none get
    the candidates of `induce`. scratch: flagged lines are written there once for each pattern, for its checks and for `assemble`."""
    tried: list[dict] = []
    flagged: dict[str, DataFrame] = {}

    def fits(origin: str, pattern: str) -> bool:
        safe, why = safety(pattern)
        if safe and scratch and pattern not in flagged:
            flagged[pattern] = flag_lines(lines, pattern, scratch)
        report = validate(lines, pattern, parser, flagged.get(pattern)).first().asDict() if safe else {"accepted": False}
        tried.append({"pattern": pattern, "origin": origin, "reason": why} | report)
        return report["accepted"]

    waiting = list(candidates)[:rounds]
    if discover and not waiting and not lines.where(F.col("line").rlike(C.HEADER)).limit(1).count():
        waiting = candidates = induce(lines)[:rounds]
    for _ in range(rounds):
        if not waiting and refine is not None and tried:
            made = refine(tried[-1], samples(lines, tried[-1]["pattern"] if tried[-1]["reason"] == "ok" else C.HEADER))
            waiting = [made] if made else []
        if not waiting:
            break
        if fits("candidate" if len(tried) < len(candidates) else "refined", waiting[0]):
            return Segmentation(waiting[0], True, tried[-1]["origin"], tried, flagged.get(waiting[0]))
        waiting.pop(0)
    reviewed = critic(tried) if critic is not None and tried else None
    for origin, pattern in [*([("critic", reviewed)] if reviewed else []), ("built-in", C.HEADER)]:
        if fits(origin, pattern):
            return Segmentation(pattern, True, origin, tried, flagged.get(pattern))
    if strict:
        raise RuntimeError("no header pattern passes its checks; strict=False takes the built-in one unverified")
    return Segmentation(C.HEADER, False, "built-in", tried, flagged.get(C.HEADER))
