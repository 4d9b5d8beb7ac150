from pyspark.sql import functions as F

from logweave.operators import windows
from logweave.streaming import stream


def test_streams_equal_batches(spark, tmp_path):
    rows = [f"2026-09-16 15:{m:02d}:{s:02d} [ERROR] payment-api: timeout {m}" for m in range(0, 20, 2) for s in (0, 20, 40)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(rows))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    events = stream.canonical(stream.read_lines(spark, str(tmp_path / "in")))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    mined = run(stream.mine(events), "mined")
    assert mined.count() == len(rows) and mined.select("template").distinct().count() == 1
    base = mined.select("event_id", "event_ts", "template_id").withColumn("source", F.lit("s"))
    want = {r["event_id"]: r["window_start"] for r in windows.anchored_windows(base).collect()}
    got = run(stream.anchored_windows(events.withColumn("source", F.lit("s"))), "anchored")
    assert {r["event_id"]: r["window_start"] for r in got.collect()} == want
    counts = run(stream.trailing_count(events.withColumn("template_id", F.lit("t"))), "counts")
    expected = {r["event_id"]: r["window_count_1m"] for r in windows.trailing_count(base.withColumn("template_id", F.lit("t"))).collect()}
    assert {r["event_id"]: r["window_count_1m"] for r in counts.collect()} == expected
