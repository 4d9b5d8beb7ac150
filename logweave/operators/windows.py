"""Trailing counts, anchored windows, and keyed bounded state."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.session import Scratch


def trailing_count(rows: DataFrame, key: str = "template_id", ts: str = "event_ts", seconds: int = 60, order: str | None = None, out: str = "window_count_1m", bucket: int | None = None) -> DataFrame:
    """Rows of the same key in the `seconds` before each row and at its time, itself included.

    Rows are counted by key and time first; the counts, not the rows, are dealt by time as well, so a key with a third of all rows is spread over its buckets. What is `seconds` before
    a time is asked for among the times of its own bucket: a window's sum is the bucket's running sum up to its time, and what the bucket of the time that is asked for holds from there on.
    Running sums cost each time once, however many times a window holds. With `order`, rows of the same time that come later are not counted.
    """
    rows = rows.withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_key", F.struct(F.col(key).alias("k")))  # a struct is null for no key
    sums = trailing_sums(rows.groupBy("_key", "_at").agg(F.count(F.lit(1)).alias("_n")), seconds, bucket)
    joined = rows.join(sums, ["_key", "_at"])
    if order:
        nth = F.row_number().over(Window.partitionBy("_key", "_at").orderBy(order))
        joined = joined.withColumn("_sum", F.col("_sum") - F.col("_n") + nth)
    return joined.withColumn(out, F.col("_sum")).drop("_key", "_at", "_n", "_sum")


def trailing_sums(times: DataFrame, seconds: int, bucket: int | None = None) -> DataFrame:
    """times (_key, _at in microseconds, _n) with _sum: that of _n in the `seconds` before, at both ends included."""
    step = seconds * 1_000_000
    size = max(bucket or 0, seconds) * 1_000_000
    own = times.select("_key", "_at", F.col("_at").alias("_place"), "_n", F.lit(1).alias("_own"))
    asks = times.select("_key", "_at", (F.col("_at") - step).alias("_place"), F.lit(0).cast("long").alias("_n"), F.lit(0).alias("_own"))  # before the rows of that time, which count
    both = own.unionByName(asks).withColumn("_b", F.floor(F.col("_place") / size))
    dealt = Window.partitionBy("_key", "_b")
    running = F.sum("_n").over(dealt.orderBy("_place", "_own").rowsBetween(Window.unboundedPreceding, 0))
    rest = F.when(F.floor(F.col("_at") / size) == F.col("_b"), F.lit(0)).otherwise(F.sum("_n").over(dealt)) - running
    parts = both.withColumn("_part", F.when(F.col("_own") == 1, running).otherwise(rest))
    return parts.groupBy("_key", "_at").agg(F.sum("_n").alias("_n"), F.sum("_part").alias("_sum"))


def anchored_windows(rows: DataFrame, source: str = "source", ts: str = "event_ts", order: str = "event_id", seconds: int = 300, most: int = 20_000, scratch: Scratch | None = None) -> DataFrame:
    """rows with window_start: a window opens at the first row, takes rows up to `seconds` later (inclusive) and at most `most` of them, and the next one
    opens at the row after.

    A source's rows are numbered by time; the row that opens the window after one that opens at row r is the first one more than `seconds` later, or row r + most. Which rows open windows
    is found by chunks of rows and by doubling between them (`opened`), so no source is a group. Rows of one time are one entry: they are in at most two windows (the open one until it
    is full, then those that begin at this time), and the table of times goes back to the rows by their time.
    """
    scratch = scratch or Scratch(rows.sparkSession, "windows")
    base = rows.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))).withColumn("_at", F.unix_micros(F.col(ts).cast("timestamp")))
    folded = time_windows(base.groupBy("_s", "_at").agg(F.count(F.lit(1)).alias("_n")), seconds * 1_000_000, most, scratch)
    joined = base.join(folded, ["_s", "_at"])
    # Only where a window fills up within a time do its rows have to be ordered; all others are spread.
    joined = joined.withColumn("_salt", F.when(F.col("_first") == F.col("_n"), F.pmod(F.xxhash64(order), F.lit(256))).otherwise(F.lit(-1)))
    rank = F.row_number().over(Window.partitionBy("_s", "_at", "_salt").orderBy(order))
    start = F.when((F.col("_salt") == -1) & (rank > F.col("_first")), F.col("_at")).otherwise(F.col("_start"))
    return joined.withColumn("window_start", F.timestamp_micros(start)).select(*rows.columns, "window_start")


def time_windows(counts: DataFrame, step: int, most: int, scratch: Scratch, chunk: int = 1 << 16) -> DataFrame:
    """counts (_s, _at, _n) with _start, the time of the window that the first of the _n rows are in, and _first, how many they are; the others' windows begin at _at itself."""
    groups = scratch.keep(numbered(scratch.keep(counts, "times"), step), "numbered")
    starts = scratch.keep(opened(groups, most, scratch, chunk), "opened")
    marks = starts.join(groups.select("_s", "_at", F.col("_row").alias("_group")), ["_s", "_at"]).groupBy("_s", "_at").agg(F.max((F.col("_row") == F.col("_group")).cast("int")).alias("_begins"), F.min(F.when(F.col("_row") > F.col("_group"), F.col("_row") - F.col("_group"))).alias("_inner"))
    marked = scratch.keep(groups.select("_s", "_b", "_at", "_n").join(marks, ["_s", "_at"], "left"), "marked")
    opens = F.when(F.col("_begins").isNotNull(), F.col("_at"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    # A row for each span of time: the last window that begins in an earlier one.
    spans = marked.groupBy("_s", "_b").agg(F.max(opens).alias("_last")).select("_s", "_b", F.max("_last").over(earlier(Window.partitionBy("_s").orderBy("_b"))).alias("_carry"))
    here = F.max(opens).over(earlier(Window.partitionBy("_s", "_b").orderBy("_at")))
    found = marked.withColumn("_here", here).join(spans, ["_s", "_b"])
    return found.select("_s", "_at", "_n", F.when(F.col("_begins") == 1, F.col("_at")).otherwise(F.coalesce("_here", "_carry")).alias("_start"), F.coalesce("_inner", "_n").alias("_first"))


def numbered(counts: DataFrame, step: int) -> DataFrame:
    """counts (_s, _at, _n) with _b (span of time), _row (number of the first row, from 0), _reach (number of the first row more than `step` later) and _reset (whether the row before is that far
    away). Sums run inside spans of `step`, and over one row for each span."""
    rows = counts.withColumn("_b", F.floor(F.col("_at") / step))
    w = Window.partitionBy("_s").orderBy("_b")
    spans = rows.groupBy("_s", "_b").agg(F.sum("_n").alias("_all"), F.max("_at").alias("_high"))
    spans = spans.select("_s", "_b", (F.sum("_all").over(w) - F.col("_all")).alias("_before"), "_all", F.lag("_high").over(w).alias("_prior"))
    # Times a step on stand among the times of the next span, and count what is before them there.
    asks = rows.select("_s", (F.col("_b") + 1).alias("_b"), (F.col("_at") + step).alias("_at"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_ask"))
    both = rows.select("_s", "_b", "_at", "_n", F.lit(0).alias("_ask")).unionByName(asks)
    w = Window.partitionBy("_s", "_b").orderBy("_at", "_ask")
    both = both.withColumns({"_sum": F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_prev": F.max(F.when(F.col("_ask") == 0, F.col("_at"))).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    far = both.where("_ask = 1").select("_s", (F.col("_at") - step).alias("_at"), F.col("_sum").alias("_inside"))
    own = both.where("_ask = 0").join(spans, ["_s", "_b"]).join(far, ["_s", "_at"])
    before = F.coalesce("_prev", "_prior")
    return own.select("_s", "_b", "_at", "_n", (F.col("_before") + F.col("_sum") - F.col("_n")).alias("_row"), (F.col("_before") + F.col("_all") + F.col("_inside")).alias("_reach"), (before.isNull() | (F.col("_at") - before > step)).alias("_reset"))


def opened(groups: DataFrame, most: int, scratch: Scratch, chunk: int = 1 << 16) -> DataFrame:
    """(_s, _row, _at) of the rows that open windows.

    A row after a pause opens one whatever came before. A source's rows are cut by their numbers into chunks; each finds where a window's row leads out of it, whatever row it is entered
    by. Only rows that chunks lead to are then joined by jumps over 1, 2, 4, ... chunks; at last each chunk follows the rows that it is entered by. Rows move three times, however many windows they make.
    """
    number = f"_row div {chunk}"
    columns = ["_s", "_chunk", "_at", "_row", "_n", "_reach", "_reset"]
    pieces = scratch.keep(groups.withColumn("_chunk", F.explode(F.expr(f"sequence({number}, (_row + _n - 1) div {chunk})"))).select(columns), "pieces")

    def laid(pdf: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the chunk's first row; for each of its rows the row that opens the next window, and its time; rows after a pause, and rows it is entered by, counted from the first."""
        start = int(pdf["_chunk"].iloc[0]) * chunk
        own = pdf[pdf["_n"] > 0].sort_values("_row")
        first, counts = own["_row"].to_numpy(), own["_n"].to_numpy()
        held = np.minimum(first + counts, start + chunk) - np.maximum(first, start)
        rows = start + np.arange(held.sum())
        entries = pdf.loc[pdf["_n"] == 0, "_row"].to_numpy() - start
        after = first[own["_reset"].to_numpy(bool) & (first >= start)] - start
        return start, np.minimum(np.repeat(own["_reach"].to_numpy(), held), rows + most), np.repeat(own["_at"].to_numpy(), held), after, entries[entries < len(rows)]

    def outs(start: int, to: np.ndarray) -> np.ndarray:
        to, end = to.copy(), start + len(to)
        while (inside := to < end).any():
            to[inside] = to[to[inside] - start]
        return to

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        start, to, *_ = laid(pdf)
        return pd.DataFrame({"_s": pdf["_s"].iloc[0], "_row": np.unique(outs(start, to))})

    def leads(pdf: pd.DataFrame) -> pd.DataFrame:
        start, to, _, after, entries = laid(pdf)
        to = outs(start, to)
        out = np.unique(to[after])
        return pd.DataFrame({"_s": pdf["_s"].iloc[0], "_row": np.concatenate([np.full(len(out), -1), start + entries]), "_to": np.concatenate([out, to[entries]])})

    def followed(pdf: pd.DataFrame) -> pd.DataFrame:
        start, to, at, after, entries = laid(pdf)
        opens, local = np.zeros(len(to), bool), (to - start).tolist()
        for row in np.concatenate([after, entries]).tolist():
            while row < len(local) and not opens[row]:
                opens[row] = True
                row = local[row]
        found = np.flatnonzero(opens)
        return pd.DataFrame({"_s": pdf["_s"].iloc[0], "_row": start + found, "_at": at[found]})

    def entered(rows: DataFrame) -> DataFrame:
        zero = F.lit(0).cast("long")
        rows = rows.select("_s", F.expr(number).alias("_chunk"), zero.alias("_at"), "_row", zero.alias("_n"), zero.alias("_reach"), F.lit(False).alias("_reset"))
        return pieces.unionByName(rows.join(pieces.select("_s", "_chunk").distinct(), ["_s", "_chunk"], "left_semi").select(columns)).groupBy("_s", "_chunk")

    goals = scratch.keep(pieces.groupBy("_s", "_chunk").applyInPandas(targets, "_s string, _row long").distinct(), "targets")
    made = scratch.keep(entered(goals).applyInPandas(leads, "_s string, _row long, _to long"), "leads")
    found, jumps = made.where("_row < 0").select("_s", F.col("_to").alias("_row")).distinct(), made.where("_row >= 0")
    while True:  # what the jumps reach, and jumps twice as far, are one table
        after = jumps.select("_s", F.col("_row").alias("_to"), F.col("_to").alias("_next"))
        twice = jumps.join(after, ["_s", "_to"]).select("_s", "_row", F.col("_next").alias("_to"))
        reached = found.join(jumps, ["_s", "_row"]).select("_s", F.lit(-1).cast("long").alias("_row"), "_to")
        both = scratch.keep(twice.unionByName(reached.distinct()), "jumps")
        new, jumps = both.where("_row < 0").select("_s", F.col("_to").alias("_row")), both.where("_row >= 0")
        if new.isEmpty():
            return entered(found).applyInPandas(followed, "_s string, _row long, _at long")
        found = scratch.keep(found.unionByName(new).distinct(), "found")


def tumbling_windows(rows: DataFrame, ts: str = "event_ts", seconds: int = 300) -> DataFrame:
    """The scale mode: window_start by the clock, a narrow operation."""
    return rows.withColumn("window_start", F.timestamp_seconds(F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds) * seconds))


KEY = ("family", "component", "error_family", "exception_type", "template")


def state_keys(rows: DataFrame, chars: int = 140) -> DataFrame:
    """rows with the five lower-cased parts of the state's key."""
    effective = F.coalesce(F.nullif(F.nullif(F.lower("service_family"), F.lit("unknown")), F.lit("")), F.lower("inferred_service_family"), F.lit("unknown"))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    return rows.withColumns({"k_family": effective, "k_component": low("component"), "k_error_family": low("error_family"), "k_exception_type": low("exception_type"), "k_template": F.substring(low("template"), 1, chars)})


def overflow(rows: DataFrame, keys: list[str], window: str = "window_start", ts: str = "event_ts", order: str = "event_id", most: int = 2000) -> DataFrame:
    """rows with state_key: the first `most` - 1 different keys of a window keep theirs, all later ones share __overflow__.

    Keys are ranked by first arrival in a table of one row for each key and window, which the rows are then joined to.
    """
    first = rows.groupBy(window, *keys).agg(F.min(F.struct(ts, order)).alias("_first"))
    ranked = first.withColumn("_rank", F.row_number().over(Window.partitionBy(window).orderBy("_first", *keys))).drop("_first")
    joined = rows.join(ranked, [window, *keys])
    return joined.withColumn("state_key", F.when(F.col("_rank") < most, F.concat_ws("|", *keys)).otherwise("__overflow__")).drop("_rank")


def histogram(rows: DataFrame, by: list[str], column: str, out: str, weight: str | None = None) -> DataFrame:
    """by, and an array of (key, n) sorted by count descending, then key: counted by key first, so a group's array has a row for each key only."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = rows.groupBy(*by, F.coalesce(column, F.lit("unknown")).alias("key")).agg(n.alias("n"))
    return counted.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "key"))).alias("a")).select(*by, F.transform("a", lambda e: F.struct(e["key"].alias("key"), (-e["m"]).alias("n"))).alias(out))


def states(rows: DataFrame, by: list[str], ts: str = "event_ts") -> DataFrame:
    """First and last time, number and highest risk of each group, and its error family and severity histograms."""
    main = rows.groupBy(*by).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("event_count"), F.max("risk_score").alias("max_risk_score"))
    return main.join(histogram(rows, by, "error_family", "error_family_counts"), by).join(histogram(rows, by, "severity", "severity_counts"), by)


def representatives(rows: DataFrame, by: list[str], ts: str = "event_ts", order: str = "event_id", most: int = 3) -> DataFrame:
    """At most `most` rows of each group, highest risk first, then earliest; with rep, their rank. Groups are cut down in two steps, so
    a large group passes a task only in shares of it."""
    rank = [F.col("risk_score").desc(), F.col(ts), F.col(order)]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(32)))
    near = salted.withColumn("rep", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*rank))).where(F.col("rep") <= most)
    return near.withColumn("rep", F.row_number().over(Window.partitionBy(*by).orderBy(*rank))).where(F.col("rep") <= most).drop("_salt")


