"""Repair of the structure of conversations by a fold in SQL's higher-order functions.

Turns of a conversation are taken by turn (nulls first; ties by role, then text; equal rows are one row with a number). A turn's first fault counts: blank (no character
but white space), duplicate (role and text stand in an earlier turn), truncated (its last character that is no white space is none of .!?).

Edits: keep costs 0, give the role user or assistant 1, delete 2 (a must for blank and duplicate turns), insert an empty turn of user or assistant 5; a truncated turn that stays
costs 5 more. The cheapest edits are found whose result is nothing, or pairs of user and assistant after at most one system turn (by the roles' initials); of equally cheap ones those whose initials
K, R, D, I, in order, come first in ASCII.

Fold: what was last kept is one of four states (nothing, system, user, assistant), and the cheapest (cost, audit) that leads to each is carried through `aggregate`; `least` chooses. Audits
of equal cost and state never begin one another, so the least one stays the least whatever follows.

A conversation is cut into segments of SEGMENT rows, each folded from all four states it may begin in; the segments' tables are joined in the same way, FAN at a time, until
one is left, and the path is handed down again. So a conversation with a third of all rows is dealt over all tasks, by range partitioning; one of up to SEGMENT rows in one range is one segment, and nothing is joined. Duplicates
come from the least turn of each (conversation, role, text), which is summed before the shuffle; illegal neighbours and places from windows within a range. Only the digest of a repaired
conversation needs its whole text in one value.

Cases: null roles and texts count as one space. A null conv_id is a conversation of its own. Null turns come first and are no gap. Repeated rows are duplicates. A
conversation without rows has cost 0 and an empty audit. Very long conversations and texts are dealt as above. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import Scratch

SEGMENT, FAN = 256, 8  # FAN: bits
NEVER = 1 << 50
STATES = "tsua"  # nothing yet, system, user, assistant
REROLE, DELETE, INSERT, UNFINISHED = 1, 2, 5, 5
#: Fixed value: roles that may follow one another, by their initials.
LEGAL = ("su", "ua", "au")

WORD = r"[^\x20\x09-\x0D]"
BLANK = r"[\x20\x09-\x0D]"


def damage(turns: DataFrame) -> DataFrame:
    """The turns with faults put in by CRC-32 of `conv_id:turn`, modulo 20: 0 drops a row, 1 empties its text, 2 takes .!? out of it, 3 repeats it, 4 makes it the user's."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("_")).drop("_")


def key(conv_id: Column) -> Column:
    """A conversation's name without null."""
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def flagged(turns: DataFrame) -> DataFrame:
    """(c, turn, role, text, n, blank, duplicate, truncated): equal rows are one, n is their number; duplicate: the first of them already is one."""
    rows = turns.select(key(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")])
    rows = rows.groupBy("c", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.sha2("text", 256))
    order = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = rows.groupBy("c", "role", "h").agg(F.min(order).alias("first"))
    rows = rows.join(first, ["c", "role", "h"]).withColumn("blank", ~F.col("text").rlike(WORD))
    rows = rows.withColumn("duplicate", ~F.col("blank") & (order > F.col("first")))
    last = F.right(F.regexp_replace("text", f"{BLANK}+\\z", ""), F.lit(1))
    return rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~last.isin(".", "!", "?")).drop("h", "first")


def segments(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, o, turns, measures): the rows of a conversation in pieces of at most SEGMENT, which o orders."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    ranged = rows.repartitionByRange(parts, "c", F.col("turn").asc_nulls_first(), "role", F.left("text", F.lit(64)))  # a prefix orders as the whole text does
    ranged = scratch.keep(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("c", "part").orderBy(*order)
    initial = F.left("role", F.lit(1))
    wrong = lambda before: (~F.concat(before, F.col("initial")).isin(*LEGAL)).cast("long")
    placed = ranged.withColumn("initial", initial).withColumn("nth", F.row_number().over(here)).withColumn("before", F.lag("initial").over(here))
    placed = placed.withColumn("illegal", F.coalesce(wrong(F.col("before")), F.lit(0)) + F.col("n") - 1)
    must = F.col("blank") | F.col("duplicate")
    turn = F.struct("nth", "role", "text", "initial", must.alias("must"), "truncated", "n")
    count = lambda c: F.sum(c).cast("long")
    found = placed.groupBy("c", "part", F.floor((F.col("nth") - 1) / SEGMENT).alias("piece")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns"),
        count(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        count(F.when(F.col("blank"), 0).when(F.col("duplicate"), F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        count(F.col("truncated").cast("int")).alias("truncated"),
        count("illegal").alias("illegal"),
        F.min_by("initial", "nth").alias("head"), F.max_by("initial", "nth").alias("tail"),
    )
    return found.withColumn("o", F.shiftleft(F.col("part").cast("long"), 32) + F.col("piece"))


def then(x: Column, cost: Column | int, letter: Column | str) -> Column:
    """A cell after one more edit; a cost never goes beyond NEVER."""
    return F.struct(F.least(F.lit(NEVER), x["cost"] + cost).cast("long").alias("cost"), F.concat(x["audit"], F.lit(letter) if isinstance(letter, str) else letter).alias("audit"))


def bound(value: Column, body) -> Column:
    """body(value), with the value made once."""
    return F.transform(F.array(value), body)[0]


def start_at(state: int) -> Column:
    return F.struct(*[F.struct(F.lit(0 if k == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(s) for k, s in enumerate(STATES)])


def inserted(x: Column) -> Column:
    """The four cells after as many insertions as pay."""
    user = F.least(x["u"], *[then(x[s], INSERT, "I") for s in "tsa"])
    return bound(user, lambda u: F.struct(x["t"].alias("t"), x["s"].alias("s"), u.alias("u"), F.least(x["a"], then(u, INSERT, "I")).alias("a")))


def turned(x: Column, turn: Column) -> Column:
    """The four cells after a turn (with its copies, which all go)."""
    facts = F.struct(
        F.when(turn["must"], F.lit(NEVER)).otherwise(F.when(turn["truncated"], F.lit(UNFINISHED)).otherwise(F.lit(0))).cast("long").alias("stay"),
        (turn["initial"] == "s").alias("s"), (turn["initial"] == "u").alias("u"), (turn["initial"] == "a").alias("a"), (turn["n"] - 1).cast("int").alias("more"),
    )

    def step(y: Column, before: Column, f: Column) -> Column:
        may = lambda x, name: then(x, f["stay"] + F.when(f[name], F.lit(0)).otherwise(F.lit(REROLE)), F.when(f[name], F.lit("K")).otherwise(F.lit("R")))
        system = then(y["t"], f["stay"] + F.when(f["s"], F.lit(0)).otherwise(F.lit(NEVER)), "K")
        gone = lambda s: then(y[s], DELETE, "D")
        new = F.struct(gone("t").alias("t"), F.least(gone("s"), system).alias("s"), F.least(gone("u"), may(before, "u")).alias("u"), F.least(gone("a"), may(y["u"], "a")).alias("a"))
        return bound(new, lambda z: F.when(f["more"] == 0, z).otherwise(F.struct(*[then(z[s], DELETE * f["more"], F.repeat(F.lit("D"), f["more"])).alias(s) for s in STATES])))

    return bound(inserted(x), lambda y: bound(F.struct(y.alias("y"), F.least(y["t"], y["s"], y["a"]).alias("b"), facts.alias("f")), lambda w: step(w["y"], w["b"], w["f"])))


def table_of(turns: Column) -> Column:
    """For each state to begin in, the four cells to end in."""
    return F.array(*[F.aggregate(turns, start_at(k), turned) for k in range(len(STATES))])


def best(cells: Column) -> Column:
    """(cost, audit, end, tail): the cheapest accepted end of the whole; tail are insertions after the last turn."""
    ends = []
    for end, tail in ((0, ""), (3, ""), (2, "I"), (1, "II")):
        x = then(cells[STATES[end]], INSERT * len(tail), tail)
        ends.append(F.struct(x["cost"].alias("cost"), x["audit"].alias("audit"), F.lit(end).alias("end"), F.lit(tail).alias("tail")))
    return F.least(*ends)


def joined(tables: Column) -> Column:
    """The table of segments in a row; `path` has the state in which each of them ends."""
    empty = lambda k, j: F.struct(F.lit(0 if k == j else NEVER).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path"))

    def step(x: Column, m: Column) -> Column:
        def to(j: int) -> Column:
            ways = []
            for k, s in enumerate(STATES):
                y = m[k][STATES[j]]
                ways.append(F.struct(F.least(F.lit(NEVER), x[s]["cost"] + y["cost"]).cast("long").alias("cost"), F.concat(x[s]["audit"], y["audit"]).alias("audit"), F.concat(x[s]["path"], F.lit(str(j))).alias("path")))
            return F.least(*ways)

        return F.struct(*[to(j).alias(s) for j, s in enumerate(STATES)])

    return F.array(*[F.aggregate(tables, F.struct(*[empty(k, j).alias(s) for j, s in enumerate(STATES)]), step) for k in range(len(STATES))])


def chosen(leaves: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((c, cost, tail, end), (c, o, begin, end)): the result for each conversation, and each segment's first and last state."""
    leaves = leaves.select("c", "o", "m")
    number = leaves.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    lone = leaves.join(number.where("k = 1").select("c"), "c", "left_semi")
    wide = number.where("k > 1").select("c")
    most = lambda rows: rows.groupBy("c").agg(F.count(F.lit(1)).alias("k")).agg(F.max("k")).first()[0] or 0
    result = lambda rows, m: rows.select("c", "o", best(F.col(m)[0]).alias("b"))
    tops = [result(lone, "m").select("c", "o", "b")]
    ends = [tops[0].select("c", "o", F.lit(0).alias("begin"), F.col("b.end").alias("end"))]
    if most(wide):
        with_path = F.transform("m", lambda row: F.struct(*[F.struct(row[s]["cost"].alias("cost"), row[s]["audit"].alias("audit"), F.lit("").alias("path")).alias(s) for s in STATES]))
        far = leaves.join(wide, "c", "left_semi").select("c", "m", F.col("o").alias("leaf"), F.shiftright("o", 32).alias("part"), F.col("o").bitwiseAND(F.lit((1 << 32) - 1)).alias("piece"))
        # Numbered without gaps: at most a row for each range and conversation is counted up.
        before = F.coalesce(F.sum("k").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = far.groupBy("c", "part").agg(F.count(F.lit(1)).alias("k")).select("c", "part", before.alias("before"))
        levels = [scratch.keep(far.join(parts, ["c", "part"]).select("c", "leaf", (F.col("before") + F.col("piece")).alias("o"), with_path.alias("m")), "level")]
        while most(levels[-1]) > 1:
            grouped = levels[-1].groupBy("c", F.shiftright("o", FAN).alias("o")).agg(F.array_sort(F.collect_list(F.struct("o", "m"))).alias("each"))
            levels.append(scratch.keep(grouped.select("c", "o", joined(F.transform("each", lambda e: e["m"])).alias("m"), F.transform("each", lambda e: e["o"]).alias("kids")), "level"))
        top = scratch.keep(result(levels[-1], "m"), "top")
        tops.append(top)
        known = top.select("c", "o", F.lit(0).alias("begin"), F.col("b.end").alias("end"))
        for level in levels[:0:-1]:
            at = F.col("m")[F.col("begin")]
            path = F.when(F.col("end") == 0, at["t"]["path"]).when(F.col("end") == 1, at["s"]["path"]).when(F.col("end") == 2, at["u"]["path"]).otherwise(at["a"]["path"])
            each = level.join(known, ["c", "o"]).select("c", "begin", path.alias("path"), F.posexplode("kids").alias("i", "o"))
            digit = lambda i: F.substring("path", i, F.lit(1)).cast("int")
            known = scratch.keep(each.select("c", "o", F.when(F.col("i") == 0, F.col("begin")).otherwise(digit(F.col("i"))).alias("begin"), digit(F.col("i") + 1).alias("end")), "down")
        ends.append(known.join(levels[0].select("c", "o", "leaf"), ["c", "o"]).select("c", F.col("leaf").alias("o"), "begin", "end"))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return union(tops).select("c", "b.cost", "b.audit", "b.end", "b.tail"), union(ends)


def replayed(turns: Column, audit: Column, begin: Column) -> Column:
    """What a segment's edits leave: array of (edit, role, text)."""
    none = F.array().cast("array<struct<edit:string,role:string,text:string>>")
    one = lambda edit, role, text: F.struct(F.lit(edit).alias("edit"), role.alias("role"), text.alias("text"))
    after = lambda state: F.when(state == 2, F.lit(3)).otherwise(F.lit(2))
    role_of = lambda state: F.when(state == 2, F.lit("user")).otherwise(F.lit("assistant"))
    letter = lambda at: F.substring(audit, at, F.lit(1))

    def step(acc: Column, turn: Column) -> Column:
        put = F.when(letter(acc["at"]) != "I", 0).when(letter(acc["at"] + 1) != "I", 1).otherwise(2)
        return bound(F.struct(acc["at"].alias("at"), acc["state"].alias("state"), acc["out"].alias("out"), put.alias("put"), letter(acc["at"] + put).alias("edit")), lambda x: with_edit(x, turn))

    def with_edit(x: Column, turn: Column) -> Column:
        insert = lambda state: one("I", role_of(after(state)), F.lit(""))
        first = after(x["state"])
        extra = F.when(x["put"] == 0, none).when(x["put"] == 1, F.array(insert(x["state"]))).otherwise(F.array(insert(x["state"]), insert(first)))
        now = F.when(x["put"] == 0, x["state"]).when(x["put"] == 1, first).otherwise(after(first))
        kept = F.when(turn["initial"] == "s", 1).when(turn["initial"] == "u", 2).otherwise(3)
        own = F.when(x["edit"] == "K", F.array(one("K", turn["role"], turn["text"]))).when(x["edit"] == "R", F.array(one("R", role_of(after(now)), turn["text"]))).otherwise(none)
        state = F.when(x["edit"] == "K", kept).when(x["edit"] == "R", after(now)).otherwise(now)
        return F.struct((x["at"] + x["put"] + turn["n"].cast("int")).alias("at"), state.alias("state"), F.concat(x["out"], extra, own).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(1).alias("at"), begin.alias("state"), none.alias("out")), step, lambda acc: acc["out"])


def repair(turns: DataFrame, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """turns (conv_id, turn, role, text) -> (measures of each conversation by c, repaired segments by c and o).

    Measures: gaps, blank, duplicate, truncated, illegal, cost, audit, tail. Segments: out, an array of (edit, role, text); insertions after the last turn are in tail."""
    scratch = scratch or Scratch(turns.sparkSession, "conversations")
    rows = flagged(turns)
    cut = scratch.keep(segments(rows, scratch), "segments")
    leaves = scratch.keep(cut.select("c", "o", table_of(F.col("turns")).alias("m")), "tables")
    result, ends = chosen(leaves, scratch)
    at = F.col("m")[F.col("begin")]
    audit = F.when(F.col("end") == 0, at["t"]["audit"]).when(F.col("end") == 1, at["s"]["audit"]).when(F.col("end") == 2, at["u"]["audit"]).otherwise(at["a"]["audit"])
    mended = cut.select("c", "o", "turns").join(leaves, ["c", "o"]).join(ends, ["c", "o"]).select("c", "o", "turns", "begin", audit.alias("part")).select("c", "o", replayed(F.col("turns"), F.col("part"), F.col("begin")).alias("out"))
    sums = cut.groupBy("c").agg(*[F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal")])
    # Neighbours in different ranges: at most a row for each range and conversation.
    ranges = cut.groupBy("c", "part").agg(F.min_by("head", "piece").alias("head"), F.max_by("tail", "piece").alias("tail")).withColumn("before", F.lag("tail").over(Window.partitionBy("c").orderBy("part")))
    across = ranges.groupBy("c").agg(F.sum((~F.concat("before", "head").isin(*LEGAL)).cast("long")).alias("across"))
    span = turns.groupBy(key(F.col("conv_id")).alias("c")).agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps"))
    measures = sums.join(across, "c").join(span, "c").join(result, "c").withColumn("illegal", F.col("illegal") + F.coalesce("across", F.lit(0))).drop("across", "end")
    return measures.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))), mended


def digests(original: DataFrame, turns: DataFrame) -> DataFrame:
    """For every conv_id of `original`, the measures of its `turns` and the SHA-256 of the repaired `role:text`, newline-joined."""
    scratch = Scratch(original.sparkSession, "conversations")
    measures, mended = repair(turns, scratch)
    lines = F.array_join(F.transform("out", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = mended.where(F.size("out") > 0).select("c", "o", lines.alias("lines")).groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "lines"))), lambda x: x["lines"]), "\n").alias("whole"))
    ends = F.when(F.col("tail") == "I", F.lit("\nassistant:")).when(F.col("tail") == "II", F.lit("\nuser:\nassistant:")).otherwise(F.lit(""))
    found = measures.join(whole, "c", "left").withColumn("repaired_sha256", F.sha2(F.concat(F.coalesce("whole", F.lit("")), ends), 256))
    ids = original.groupBy(key(F.col("conv_id")).alias("c")).agg(F.first("conv_id").alias("conv_id"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out = ids.join(found, "c", "left").select("conv_id", *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return out
