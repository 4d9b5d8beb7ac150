import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from logweave.functions import context, parsing
from logweave.operators import segmentation, windows
from logweave.sources import logs, text
from logweave.sources.store import IncidentStore
from logweave.streaming import stateful, stream

T0 = dt.datetime(2026, 9, 16, 15, 0, 0)


def drain(df, where, name, trigger=None, mode="append"):
    """Run a stream to its present end; the rows it has given so far."""
    q = df.writeStream.format("parquet").option("path", f"{where}/{name}").option("checkpointLocation", f"{where}/{name}-at").outputMode(mode).trigger(**(trigger or {"availableNow": True})).start()
    q.awaitTermination()
    return q


def some_log(rng, n):
    rows = []
    for k in range(n):
        rows.append(rng.choice([f"2026-09-16 15:{k % 60:02d}:03 [ERROR] x {k}", "  at a.b(c)", "caused by: y", "", "   ", "Traceback (most recent call last):", "INFO: ready"]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_streamed_events_equal_those_of_the_batch(spark, tmp_path, seed):
    """However a log is cut into files and micro-batches; started anew for each part."""
    rng = random.Random(seed)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = some_log(rng, 60) + [""]
    cuts = sorted(rng.sample(range(len(rows)), 4))
    (tmp_path / "in").mkdir()
    got = []
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True), 1):
        (tmp_path / "in" / f"app.log.{k}").write_text("".join(r + "\n" for r in rows[a:b]))
        if k % 2 == 0 or b == len(rows):
            lines = stream.read_lines(spark, str(tmp_path / "in"))
            drain(stateful.assemble(lines, idle=None), tmp_path, "events")
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "events")).select("line_no", "event", "line_count", "first_line_is_header", "source").collect()]
    frame = spark.createDataFrame([("f", k, r) for k, r in enumerate(rows)], "file string, line_no long, line string")
    want = [tuple(r) for r in segmentation.assemble(frame).select("line_no", "event", "line_count", "first_line_is_header", "source").collect()]
    assert sorted(got) == sorted(want)


def test_open_event_is_given_out_after_a_while(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2026-09-16 15:00:03 [ERROR] x\n  at a.b\n")
    q = stateful.assemble(stream.read_lines(spark, str(tmp_path / "in")), idle=1).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(processingTime="500 milliseconds").start()
    for _ in range(60):
        if spark.table("flushed").count():
            break
        q.awaitTermination(1)
    q.stop()
    assert [(r["event"], r["line_count"]) for r in spark.table("flushed").collect()] == [("2026-09-16 15:00:03 [ERROR] x | at a.b", 2)]


def scored_rows(rng, n):
    rows = []
    for k in range(n):
        family, error = rng.choice(["payment", "order", "database"]), rng.choice(["timeout", "retry", "connection"])
        at = T0 + dt.timedelta(seconds=rng.randrange(3000) if k else 0)
        attributes = {"trace_id": f"t{rng.randrange(6)}"} if rng.random() < 0.3 else {}
        rows.append((f"e{k:04d}", at, rng.choice(["ERROR", "CRITICAL"]), f"{family} {error} {rng.randrange(4)}", f"{family}-api", family, None, None, None, None, error, family, rng.choice(["svc", None]), None, f"{family} {error} <NUM>", attributes, [family, error], rng.randrange(50, 90), "json", None, None, None, 3))
    return rows


SCORED = (
    "event_id string, event_ts timestamp, severity string, message string, service string, service_family string, inferred_service string, inferred_service_family string, host string, raw string, error_family string, domain string, "
    "component string, exception_type string, template string, attributes map<string,string>, correlation_tokens array<string>, risk_score int, source string, framework string, runtime string, library string, window_count_1m long"
)


@pytest.mark.parametrize(("events", "states"), [(20_000, 2000), (25, 6)])
def test_streamed_incidents_equal_those_of_the_batch(spark, tmp_path, events, states):
    """Rows come out of order and in several runs of the query, each started from the checkpoint of the one before."""
    rng = random.Random(events)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rows = scored_rows(rng, 150)
    frame = spark.createDataFrame(rows, SCORED)
    made = windows.state_keys(windows.anchored_windows(frame.withColumn("stream", F.lit("all")), "stream", most=events).drop("stream"))
    keyed = windows.overflow(made, [f"k_{k}" for k in windows.KEY], most=states)
    by = ["window_start", "state_key"]
    reps = windows.representatives(keyed, by).join(windows.states(keyed, by).select(*by, "event_count"), by)
    reps = reps.withColumn("weight", F.when(F.col("rep") == 1, F.col("event_count") - (F.least(F.col("event_count"), F.lit(3)) - 1)).otherwise(F.lit(1)))
    columns = ["incident_id", "start_ts", "end_ts", "services", "event_count", "evidence_ids", "max_risk_score", "error_family_counts", "severity_counts", "pairwise_max"]
    want = sorted(map(str, stateful.incidents_of(reps.drop("event_count"), 300).select(columns).collect()))

    order = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(60)))  # within the watermark
    last = ("z", T0 + dt.timedelta(days=1), "ERROR", *order[-1][3:])
    store, source = IncidentStore(spark, str(tmp_path / "store")), tmp_path / "in"
    for k, part in enumerate([order[:40], order[40:90], order[90:], [last]]):
        spark.createDataFrame(part, SCORED).coalesce(1).write.mode("append").parquet(str(source))
        scored = spark.readStream.schema(SCORED).parquet(str(source)).withWatermark("event_ts", "2 minutes")
        stateful.to_incidents(scored, store, str(tmp_path / "at"), events=events, states=states).awaitTermination()
    got = store.load_all()
    assert sorted(map(str, got.select(columns).collect())) == want
    assert len(want) > 5


def test_counters_of_closed_windows(spark):
    rows = [("all", 0, "a", 1, 5, 7, 9, 2, 0, "{}"), ("all", 0, "a", 2, 1, 7, 9, 2, 0, "{}"), ("all", 0, "__overflow__", 1, 2, 2, 9, 2, 2, "{}")]
    got = spark.createDataFrame(rows, stateful.REPRESENTATIVE).agg(*stateful.window_counters()).first().asDict()
    assert got == {"stream_aggregated_events": 9, "stream_represented_events": 3, "max_active_window_events": 9, "max_active_incident_states": 2, "stream_coarsened_events": 2}


# ------------------------------------------------------------------ log files by positions


@pytest.mark.parametrize("step", [1, 7, 64, 1 << 20])
def test_ranges_hold_every_line_once(spark, tmp_path, step):
    rng = random.Random(step)
    for name, end in (("a.log", ""), ("b.log", "\n"), ("empty.log", None), ("_marker", "x")):
        lines = ["é" * rng.randrange(4) + "x" * rng.randrange(9) for _ in range(40)]
        (tmp_path / name).write_bytes(b"" if end is None else "\n".join(lines).encode() + b"\xff\r" + end.encode())
    got = {}
    for r in sorted(logs.read_ranges(spark, str(tmp_path), step).collect(), key=lambda r: (r["file"], r["line_no"])):
        got.setdefault(os.path.basename(r["file"]), []).append(r["line"])
    want = {n: [x.decode("utf-8", "ignore").removesuffix("\r") for x in (tmp_path / n).read_bytes().removesuffix(b"\n").split(b"\n")] for n in ("a.log", "b.log")}
    assert got == want


def test_sample_reads_only_its_stretches(tmp_path):
    class Counted:
        def __init__(self, f):
            self.f, self.bytes = f, 0

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            data = self.f.read(n)
            self.bytes += len(data)
            return data

    took = []
    for size in (2000, 200_000):
        path = tmp_path / f"{size}.log"
        path.write_text("".join(f"line {k} of the log\n" for k in range(size)))
        n = path.stat().st_size
        with open(path, "rb") as f:
            counted, found, plain = Counted(f), [], []
            for k in range(10):
                found += [x for _, x in logs.stretch(counted, n, 10, k, 15)]
            for k in range(10):  # as it is stated
                f.seek(k * (n // 10))
                if k:
                    f.readline()
                plain += [f.readline().decode().rstrip("\n") for _ in range(15)]
        assert found == plain and len(found) == 150
        took.append(counted.bytes)
    assert max(took) <= 10 * logs.FIRST


def test_sampled_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" for k in range(5000)))
    rows = logs.sample(spark, str(tmp_path), 10, 15).collect()
    assert len(rows) == 150 and {r["line"] for r in rows} >= {f"line {k}" for k in range(15)}


def test_lines_in_many_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {k}\n" for k in range(2000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        rows = text.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5 or rows.count() == 2000
        assert sorted((r["line_no"], r["line"]) for r in rows.collect()) == [(k, f"line {k}") for k in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_growing_files_become_events(spark, tmp_path):
    """A file is written to between runs, in the middle of a line: whole lines are taken, once."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "app.log"
    whole = "2026-09-16 15:00:03 [ERROR] one\n  at a.b\n2026-09-16 15:00:04 [ERROR] two\n\n"
    for cut in (10, 37, 50, len(whole)):
        path.write_text(whole[:cut])
        drain(stateful.assemble(logs.read_growing(spark, str(tmp_path / "in"), 16), F.col("file"), idle=None), tmp_path, "out")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["event"] for r in got.collect()) == ["2026-09-16 15:00:03 [ERROR] one | at a.b", "2026-09-16 15:00:04 [ERROR] two"]
    enriched = context.enrich(parsing.parse(got.select("file", "line_no", "event")))
    assert enriched.where("severity = 'ERROR'").count() == 2
