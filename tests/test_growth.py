"""Steps whose work must grow no faster than their rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import correlate, segmentation, windows
from logweave.plans import catalogue
from logweave.plans.engine import Engine, Settings
from logweave.session import Scratch

START = dt.datetime(2024, 1, 1)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bucket", [None, 61, 200])
def test_trailing_count_reads_a_window_once(spark, bucket):
    """A sliding range frame is summed anew for each row: a window of n rows costs n times n."""
    random.seed(7)
    rows = [(k, random.choice("ab"), START + dt.timedelta(seconds=random.randrange(400))) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, template_id string, event_ts timestamp")
    made = windows.trailing_count(df, bucket=bucket)
    assert "RangeFrame" not in plan(made)
    assert {r["event_id"]: r["window_count_1m"] for r in made.collect()} == {i: sum(t == u and 0 <= (s - x).total_seconds() <= 60 for _, u, x in rows) for i, t, s in rows}


def near_events(spark, count: int = 120):
    random.seed(11)
    pick = lambda *values: random.choice(values)
    rows = [
        (k % 117, START + dt.timedelta(seconds=random.randrange(1500)), pick("w", "v"), pick(None, "", "t1", "t2", "t3", "t4"), pick(None, None, "r1"), pick("database", "redis", None), pick(None, "Pool"), pick("timeout", "retry"), pick([], ["a", "b"], [f"x{k}", "a"], [f"y{k}"]))
        for k in range(count)
    ]
    names = "event_id long, event_ts timestamp, window_start string, trace_id string, request_id string, service_family string, component string, error_family string, correlation_tokens array<string>"
    return spark.createDataFrame(rows, names)


def test_pairs_that_can_score_and_the_others_are_all_pairs(spark):
    rows = correlate.prepare(near_events(spark))
    every = correlate.pair_scores(correlate.band_pairs(rows)).select("l_event_id", "r_event_id", "score", "reasons").collect()
    near = correlate.pair_scores(correlate.reach_pairs(rows)).select("l_event_id", "r_event_id", "score", "reasons").collect()
    far = [(*r, 0.0, []) for r in correlate.far_pairs(rows).collect()]
    assert sorted(map(tuple, near + far)) == sorted(map(tuple, every)) and any(r["score"] > 0 and "shared_trace_id" in r["reasons"] for r in near)
    assert far and len(near) < len(every)
    assert correlate.count_pairs(rows).first()["n"] == len(every)


def test_incidents_keep_their_highest_overlap_without_all_pairs(spark):
    rows = near_events(spark, 117)
    found, scored = correlate.incident_members(rows)
    incident = {r["event_id"]: r["incident"] for r in found.collect()}
    best = lambda pairs: {i: max(o for l, r, o in pairs if incident[l] == incident[r] == i) for i in {incident[l] for l, r, _ in pairs if incident[l] == incident[r]}}  # noqa: E731, E741
    every = correlate.pair_scores(correlate.band_pairs(correlate.prepare(rows))).select("l_event_id", "r_event_id", "overlap").collect()
    got, want = best(list(scored.select("l_event_id", "r_event_id", "overlap").collect())), best(list(every))
    assert {i: o for i, o in got.items() if o} == {i: o for i, o in want.items() if o} and any(want.values())
    assert scored.count() < len(every)


def test_bursts_of_alike_events_are_scored_once(spark):
    """40 alike events of one time are one point: as pairs they are 780, and 1600 with those of another time."""
    pick = [("database", "timeout", ["a"]), ("database", "timeout", ["a"]), ("redis", "timeout", ["a"]), (None, "retry", [])]
    rows = [(f"e{t}-{c}-{k}", START + dt.timedelta(seconds=40 * t), "w", *pick[(t + c) % 4]) for t in range(4) for c in range(2) for k in range(20)]
    rows += [("twice", START, "w", "search", "timeout", ["a"]), ("twice", START, "w", "search", "timeout", ["a"]), (None, START, "w", "search", "timeout", ["a"])]
    names = "event_id string, event_ts timestamp, window_start string, service_family string, error_family string, correlation_tokens array<string>"
    events = spark.createDataFrame(rows, names)
    found, scored = correlate.incident_members(events, seconds=7200)
    assert scored.count() < 60
    incident = {r["event_id"]: r["incident"] for r in found.collect()}
    every = correlate.verdicts(correlate.pair_scores(correlate.band_pairs(correlate.prepare(events), 7200), 7200)).collect()
    root = {e: e for e in incident}
    for _ in root:
        for r in every:
            if r["verdict"] == "merge":
                root[r["l_event_id"]] = root[r["r_event_id"]] = min(root[r["l_event_id"]], root[r["r_event_id"]])
        if all(root[r["l_event_id"]] == root[r["r_event_id"]] for r in every if r["verdict"] == "merge"):
            break
    groups = lambda of: {frozenset(e for e in of if of[e] == i) for i in set(of.values())}
    assert groups(incident) == groups(root) and 1 < len(groups(root)) < len(root)
    for i in set(incident.values()):
        got = [(r["score"], r["times"]) for r in scored.collect() if r["score"] > 0 and incident[r["l_event_id"]] == incident[r["r_event_id"]] == i]
        want = [(r["score"], 1) for r in every if r["score"] > 0 and incident[r["l_event_id"]] == incident[r["r_event_id"]] == i]
        assert (sum(n for _, n in got), round(sum(s * n for s, n in got), 6)) == (sum(n for _, n in want), round(sum(s * n for s, n in want), 6))


def odd_events(spark, count: int = 400):
    """Many events of few times and kinds, with null and repeated ids, null times and windows, and ids that some share."""
    random.seed(5)
    pick = lambda *values: random.choice(values)
    rows = [
        (pick(None, f"e{k % 180}", f"e{k}", f"e{k}", f"e{k}"), pick(None, *[START + dt.timedelta(seconds=37 * random.randrange(40)) for _ in range(9)]), pick("w", "w", "v", None), pick(None, None, "", "t1", "t2"), pick(None, None, "r1", ""), pick("database", "redis"), pick(None, "Pool"), pick("timeout", "retry"), pick([], ["a", "b"]))
        for k in range(count)
    ]
    names = "event_id string, event_ts timestamp, window_start string, trace_id string, request_id string, service_family string, component string, error_family string, correlation_tokens array<string>"
    return correlate.prepare(spark.createDataFrame(rows, names))


@pytest.mark.parametrize("block", [4096, 16])
def test_blocks_make_every_pair_once(spark, monkeypatch, block):
    monkeypatch.setattr(correlate, "BLOCK", block)
    monkeypatch.setattr(correlate, "PART", block)
    monkeypatch.setattr(correlate, "MET", 4 * block)
    rows = odd_events(spark)
    got = correlate.every_pair(rows, 300).collect()
    want = correlate.band_pairs(rows, 300).selectExpr("l_event_id", "r_event_id", "r_us - l_us").collect()
    order = lambda found: sorted(map(str, map(tuple, found)))
    assert order(got) == order(want) and len(got) > 1000
    far = correlate.far_pairs(rows, 300).collect()
    met = correlate.pair_scores(correlate.band_pairs(rows, 300), 300).where("r_us - l_us > 120000000 and score = 0").select("l_event_id", "r_event_id").collect()
    assert order(far) == order(met) and len(far) > 100


def test_pairs_of_a_hot_bucket_are_many_tasks(spark, monkeypatch):
    """All 300 events are of one bucket: as its pairs, they were one task's."""
    monkeypatch.setattr(correlate, "BLOCK", 16)
    monkeypatch.setattr(correlate, "PART", 16)
    rows = spark.range(300).selectExpr("id AS event_id", "id * 1000000 AS us", "0 AS win")
    made = correlate.every_pair(rows, 7200).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in made) == 300 * 299 / 2 and max(r["count"] for r in made) < 300 * 299 / 4


@pytest.mark.parametrize("members", [128, 2])
def test_alike_events_are_scored_once_and_make_every_pair(spark, monkeypatch, members):
    monkeypatch.setattr(correlate, "MEMBERS", members)
    rows = odd_events(spark)
    got = correlate.scored_pairs(rows, Scratch(spark, "test"), 300).collect()
    want = correlate.verdicts(correlate.pair_scores(correlate.reach_pairs(rows, 300), 300)).select("l_event_id", "r_event_id", "score", F.array_join("reasons", ","), "verdict").collect()
    order = lambda found: sorted(map(str, map(tuple, found)))
    assert order(got) == order(want) and len(got) > 500


def test_pair_scores_scores_kinds_not_pairs(spark, tmp_path, monkeypatch):
    """30 copies of 40 times are one kind: 30 times 30 pairs score alike."""
    events = spark.range(1200).select((F.col("id") * 77 + 1).alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") % 40 * 17).cast("timestamp_ntz").alias("ts"), F.lit(3).cast("long").alias("user_id"), F.lit("error").alias("event_type"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    scored, score = [], correlate.pair_scores
    monkeypatch.setattr(correlate, "pair_scores", lambda pairs, *a: scored.append(pairs.count()) or score(pairs, *a))
    assert catalogue.pair_scores(spark, str(tmp_path)).count() == 1200 * 1199 // 2
    assert 0 < sum(scored) < 40 * 40


def test_pair_stats_are_folded_where_pairs_are_made(spark, monkeypatch):
    """No pair is written but those that link; the figures are those of all pairs inside an incident."""
    events = near_events(spark)
    events = events.unionByName(events.withColumn("event_id", F.col("event_id") + 1000)).unionByName(events.where("event_id < 60").withColumn("event_id", F.col("event_id") + 2000))
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name="t": kept.extend(df.columns) or keep(self, df, name))
    found, stats = correlate.incident_stats(events)
    got = {r["incident"]: (round(r["pairwise_max"], 6), round(r["pairwise_mean"], 6)) for r in stats.collect()}
    assert kept and "score" not in kept and "reasons" not in kept
    incident = {r["event_id"]: r["incident"] for r in found.collect()}
    want = {}
    for r in correlate.pair_scores(correlate.band_pairs(correlate.prepare(events))).where("score > 0").collect():
        if incident[r["l_event_id"]] == incident[r["r_event_id"]]:
            want.setdefault(incident[r["l_event_id"]], []).append(r["score"])
    assert got == {i: (round(max(of), 6), round(sum(of) / len(of), 6)) for i, of in want.items()} and len(got) > 1
    members = correlate.incident_members(events)[0]
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, members.collect()))


def test_files_of_every_pair_are_small(spark, tmp_path):
    """30 copies of 200 times make 17 991 000 pairs: in order of blocks they take less than half a byte each."""
    events = spark.range(6000).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") % 200 * 17 + F.col("id") % 200 % 7).cast("timestamp_ntz").alias("ts"), F.lit(3).cast("long").alias("user_id"), F.lit("error").alias("event_type"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    catalogue.band_join_pairs(spark, str(tmp_path)).write.parquet(str(tmp_path / "pairs"))
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 6000 * 5999 // 2 and size < 17_991_000 / 2


class Kept:
    """A state of a processor, without a store."""

    def __init__(self):
        self.of = {}
        self.exists = self.of.__len__
        self.containsKey, self.getValue, self.updateValue, self.removeKey = self.of.__contains__, self.of.get, self.of.__setitem__, self.of.pop
        self.keys, self.iterator, self.clear = lambda: list(self.of), lambda: list(self.of.items()), self.of.clear
        self.get, self.update = lambda: self.of[0], lambda value: self.of.__setitem__(0, value)


class Handle:
    def __init__(self):
        self.states, self.timers = {}, []
        self.registerTimer = self.timers.append

    def getMapState(self, name, *schema):
        return self.states.setdefault(name, Kept())

    getValueState = getMapState


class Watermark:
    def __init__(self, us):
        self.getCurrentWatermarkInMs = lambda: us // 1000


def test_waiting_rows_are_no_single_value_of_the_store():
    """A list is one value, which the store reads again with each row that is added."""
    import pandas as pd

    from logweave.streaming import stateful

    random.seed(3)
    step, rows = 60_000_000, [(random.randrange(100) * 7_000_000 + 1, f"e{k}", k % 5, f"s{k % 3}", "p") for k in range(9000)]
    handle, made = Handle(), stateful.Windows(60, 1 << 40, 100, 3)
    made.init(handle)
    frame = lambda part: pd.DataFrame(part, columns=["us", "event_id", "risk_score", "state_key", "payload"])
    list(made.handleInputRows(("a",), iter([frame(rows[:4000]), frame(rows[4000:])]), None))
    sizes = [len(value[0]) for value in handle.states["packs"].of.values()]
    assert len(sizes) > 5 and max(sizes) < 40 * stateful.PACK
    parts = [list(made.handleExpiredTimer(("a",), Watermark(at), None)) for at in (200_000_000, 10**12)]
    got = pd.concat([f for part in parts for f in part])
    want, start = {}, None
    for us, *_ in sorted(rows):
        if start is None or us > start + step:
            start = us
        want[start] = want.get(start, 0) + 1
    first = got[got["rep"] == 1]
    assert first.groupby("window_start")["event_count"].sum().to_dict() == want and not handle.states["packs"].of


@pytest.mark.parametrize("chunk", [3, 16, 1 << 16])
def test_windows_are_followed_by_chunks_of_rows(spark, tmp_path, chunk, monkeypatch):
    """Rounds go with the number of chunks, not of windows."""
    from logweave.session import Scratch

    random.seed(5)
    counts = [(s, t, random.randint(1, 9)) for s in "ab" for t in sorted(random.sample(range(0, 600), 60))]
    scratch, kept = Scratch(spark, "chunks"), []
    keep = scratch.keep
    monkeypatch.setattr(scratch, "keep", lambda df, name="t": kept.append(name) or keep(df, name))
    made = {(r["_s"], r["_at"]): (r["_start"], r["_first"]) for r in windows.time_windows(spark.createDataFrame(counts, "_s string, _at long, _n long"), 30, 7, scratch, chunk).collect()}
    start = held = source = None
    for s, at, n in sorted(counts):
        if s != source:
            source, start = s, None
        own, first = (None, 0), None
        for k in range(n):
            if start is None or at > start + 30 or held >= 7:
                if k and first is None:
                    first = k
                start, held = at, 0
            held += 1
            if not k:
                own = start
        assert made[s, at] == (own, first or n)
    assert chunk < 1 << 16 or kept.count("jumps") == 1


def test_the_engine_matches_each_line_once(spark):
    """Checks of the header and events come from lines that were matched and written once."""
    rows = [("a", k, line) for k, line in enumerate(["2026-09-16 15:00:00 [ERROR] pay: one", "  at two", "", "three", "2026-09-16 15:00:01 [INFO] pay: four"])]
    rows += [("b", 250_000, "late"), ("b", 99_999, "2026-09-16 15:00:02 [INFO] pay: five"), ("b", 100_000, "  six")]
    df = spark.createDataFrame(rows, "file string, line_no long, line string")
    made = Engine(spark, df, Settings(strict=False)).stage("events")
    assert "RLIKE" not in plan(made)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, segmentation.assemble(df).collect()))
