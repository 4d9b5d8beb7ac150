"""The same stages on streams: file source, parsing, template mining, counts, windows and state, store sink.

Late rows: `late` is the watermark; rows later than that are dropped, as the batch stages have no such notion. Rows of one micro-batch are
taken in order of their time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logweave.functions import context, parsing, scoring, signal
from logweave.operators.templates import Miner
from logweave.sources.store import IncidentStore


def read_lines(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(file, line_no, event): every line is an event. line_no is the place of its split in the file plus its place in the split: it rises along the file, no two
    lines of a file share it, equal lines included, and a repeated batch gives it again."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("line_no"), F.col("value").alias("event"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0  # a split's lines come one after the other, in one task
        for batch in batches:
            numbers = []
            for here in zip(batch.column("file").to_pylist(), batch.column("line_no").to_pylist(), strict=True):
                at, n = here, n + 1 if here == at else 0
                numbers.append(here[1] + n)
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(numbers, pa.int64()), batch.column("event")], ["file", "line_no", "event"])

    return rows.mapInArrow(run, "file string, line_no long, event string")


def canonical(lines: DataFrame, late: str = "5 minutes", lenient: bool = False) -> DataFrame:
    """Enriched canonical events with a watermark."""
    return context.enrich(parsing.parse(lines, lenient=lenient)).withWatermark("event_ts", late)


def _stateful(rows: DataFrame, key: str, output: str, state: str, f, timeout=GroupStateTimeout.NoTimeout) -> DataFrame:
    return rows.groupBy(key).applyInPandasWithState(f, output, state, "append", timeout)


def mine(events: DataFrame, similarity: float = 0.5, depth: int = 4, most: int = 100_000) -> DataFrame:
    """(event_id, event_ts, severity, message, template, template_id, cluster_size, confidence): templates at arrival, one tree for each token count.

    A token count's state is its clusters, none of which is forgotten; once there are `most`, a message that is like none joins the nearest of its leaf.
    """
    rows = events.select("event_id", "event_ts", "severity", "message", signal.prepared(F.col("message"), F.col("attributes")).alias("text")).withColumn("n", F.size(F.filter(F.split("text", " "), lambda t: t != "")))

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        miner = Miner(similarity, depth, most=most)
        for tokens, size in json.loads(state.get[0]) if state.exists else []:
            miner.leaf(tokens).append([tokens, size])
            miner.size += 1
        clusters: list[list] = []
        for pdf in frames:
            pdf = pdf.sort_values(["event_ts", "event_id"])
            found = [miner.add([t for t in text.split(" ") if t]) for text in pdf["text"]]
            yield pdf[["event_id", "event_ts", "severity", "message"]].assign(template=[" ".join(c[0]) for c in found], cluster_size=[c[1] for c in found])
        stack = list(miner.root.values())
        while stack:
            node = stack.pop()
            clusters += node.get(None, [])
            stack += [v for k, v in node.items() if k is not None]
        state.update((json.dumps(clusters),))

    mined = _stateful(rows, "n", "event_id string, event_ts timestamp, severity string, message string, template string, cluster_size long", "clusters string", run)
    mined = mined.withColumn("template", signal.unprotect(F.col("template")))
    return mined.withColumns({"template_id": signal.template_id(F.col("template")), "confidence": F.round(signal.confidence(F.col("template"), F.col("cluster_size")), 2), "entropy": F.round(signal.entropy(F.col("message")), 2)})


def trailing_count(rows: DataFrame, key: str = "template_id", seconds: int = 60) -> DataFrame:
    """(key, event_id, event_ts, window_count_1m): rows of the key in the `seconds` before, of those that have arrived. State keeps the different times of that span with their
    numbers of rows, so at times of whole seconds at most `seconds` + 1 of them, however many rows a key has; a key without rows for `seconds` of event time after the watermark is dropped."""
    schema = f"{key} string, event_id string, event_ts timestamp, window_count_1m long"

    def run(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, counts = (np.array(x, np.int64) for x in (state.get if state.exists else ([], [])))  # times in order, and how many rows each has
        span = seconds * 1_000_000
        for pdf in frames:
            pdf = pdf.sort_values(["event_ts", "event_id"])
            new = (pdf["event_ts"].astype("int64") // (1000 if pdf["event_ts"].dtype == "datetime64[ns]" else 1)).to_numpy()
            sums = np.concatenate([[0], np.cumsum(counts)])
            before = sums[np.searchsorted(times, new, "right")] - sums[np.searchsorted(times, new - span, "left")]
            found = before + np.arange(1, len(new) + 1) - np.searchsorted(new, new - span, "left")
            merged, place = np.unique(np.concatenate([times, new]), return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, np.ones(len(new))]), minlength=len(merged)).astype(np.int64)
            keep = np.searchsorted(merged, merged[-1] - span, "left")
            times, counts = merged[keep:], counts[keep:]
            yield pd.DataFrame({key: name[0], "event_id": pdf["event_id"], "event_ts": pdf["event_ts"], "window_count_1m": found})
        state.update((times.tolist(), counts.tolist()))
        state.setTimeoutTimestamp(max((int(times[-1]) if len(times) else 0) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    return _stateful(rows.select(key, "event_id", "event_ts"), key, schema, "times array<long>, counts array<long>", run, GroupStateTimeout.EventTimeTimeout)


def anchored_windows(rows: DataFrame, key: str = "source", seconds: int = 300, most: int = 20_000) -> DataFrame:
    """(key, event_id, event_ts, window_start): a window opens at the first row and takes rows up to `seconds` later and at most `most`."""
    schema = f"{key} string, event_id string, event_ts timestamp, window_start timestamp"

    def run(name, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, held = (pd.Timestamp(state.get[0], unit="us"), state.get[1]) if state.exists else (None, 0)
        for pdf in frames:
            pdf = pdf.sort_values(["event_ts", "event_id"])
            starts = []
            for t in pdf["event_ts"]:
                if start is None or t > start + pd.Timedelta(seconds=seconds) or held >= most:
                    start, held = t, 0
                held += 1
                starts.append(start)
            yield pd.DataFrame({key: name[0], "event_id": pdf["event_id"], "event_ts": pdf["event_ts"], "window_start": starts})
        state.update((int(start.value // 1000), held))

    return _stateful(rows.select(key, "event_id", "event_ts"), key, schema, "start long, held long", run)


def scores(mined: DataFrame, seconds: int = 60, late: str = "5 minutes", threshold: int = scoring.THRESHOLD) -> DataFrame:
    """Actionable counts by template, severity and clock window: a stateful aggregation that the watermark closes."""
    counted = mined.withWatermark("event_ts", late).groupBy(F.window("event_ts", f"{seconds} seconds"), "template_id", "severity").agg(F.count(F.lit(1)).alias("window_count_1m"), F.max("entropy").alias("entropy"), F.min("confidence").alias("confidence"))
    return scoring.actionable(scoring.score(counted, threshold))


def states(events: DataFrame, seconds: int = 300) -> DataFrame:
    """Keyed state by clock window: (window, family, error_family, severity) with first, last and number."""
    family = F.when(F.col("service_family") != "unknown", F.col("service_family")).otherwise(F.coalesce("inferred_service_family", F.lit("unknown")))
    return events.groupBy(F.window("event_ts", f"{seconds} seconds"), family.alias("family"), "error_family", "severity").agg(F.min("event_ts").alias("start_ts"), F.max("event_ts").alias("last_seen"), F.count(F.lit(1)).alias("event_count"))


def to_store(rows: DataFrame, store: IncidentStore, checkpoint: str, id_of, **trigger):
    """Write a stream's rows to an incident store: each micro-batch is one upsert, numbered by the batch, so a repeated batch changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        store.upsert(batch.withColumn("incident_id", id_of), number)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
