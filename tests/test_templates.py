import datetime as dt
import random

from pyspark.sql import functions as F

from logweave.functions import signal
from logweave.operators import templates

T0 = dt.datetime(2026, 9, 16, 15, 0, 0)
SCHEMA = "event_id string, event_ts timestamp, message string, attributes map<string,string>"
KINDS = ["disk {} of node {} is full now", "opened file {} in mode {} by worker", "cache {} missed key {} twice today", "queue {} holds {} jobs since noon"]


def messages(n, seed=1, kinds=KINDS):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfgh") for _ in range(5))
    return [(f"e{k:05d}", T0 + dt.timedelta(seconds=k), rng.choice(kinds).format(word(), word()), {}) for k in range(n)]


def mined(spark, rows, **options):
    got = templates.mine(spark.createDataFrame(rows, SCHEMA), **options)
    return {r["event_id"]: (r["template"], r["cluster_size"]) for r in got.collect()}


def one_tree(rows, similarity=0.5, depth=4):
    miner = templates.Miner(similarity, depth)
    found = {}
    for event_id, _, message, _ in rows:
        found[event_id] = miner.add(message.split())
    return {k: (" ".join(c[0]), c[1]) for k, c in found.items()}


def test_shards_of_a_hot_leaf_agree_with_one_tree(spark):
    """All messages have six tokens and, at depth 2, one leaf, which is mined in up to 20 shards."""
    rows = messages(600)
    want = one_tree(rows, depth=2)
    assert mined(spark, rows, depth=2) == want
    for split in (300, 30):
        assert mined(spark, rows, depth=2, split=split) == want


def test_plan_grows_with_the_depth_alone(spark):
    df = spark.createDataFrame(messages(50), SCHEMA)
    scans = [templates.mine(df, depth=d)._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") + templates.mine(df, depth=d)._jdf.queryExecution().optimizedPlan().toString().count("Relation [") for d in (4, 10)]
    assert scans[0] == scans[1] <= 8


def test_ids_stay(spark, tmp_path):
    store = templates.TemplateStore(spark, str(tmp_path / "templates"), levels=0)
    first = templates.mine(spark.createDataFrame([("a", T0, "disk one of node x is full", {}), ("b", T0, "user logged in from home", {})], SCHEMA), depth=2)
    ids = {r["event_id"]: r["stable_id"] for r in store.absorb(first).collect()}
    second = templates.mine(spark.createDataFrame([("c", T0, "disk two of node y is full", {}), ("d", T0, "something else is going on here", {})], SCHEMA), depth=2)
    later = {r["event_id"]: r["stable_id"] for r in store.absorb(second).collect()}
    assert later["c"] == ids["a"] and later["d"] not in ids.values() and store.version() == 2
    now = {r["stable_id"]: r["template"] for r in store.templates().collect()}
    assert now[ids["a"]] == "disk <*> of node <*> is full" and len(now) == 3
    assert {r["template"] for r in store.templates(1).collect()} == {r["template"] for r in first.collect()}
    third = {r["event_id"]: r["stable_id"] for r in store.absorb(first).collect()}
    assert third == ids


def test_guards_change_nothing(spark):
    """Texts that are not searched word by word are those in which nothing is found."""
    rows = ["a user Failed at 10.1.2.3", "login", "LOGIN x/y", "plain words only", "abcdefab-abcd-abcd-abcd-abcdefabcdef", "0xff and 12", "xuser userx", "", "deadbeef- x"]
    df = spark.createDataFrame([(r,) for r in rows], "message string")
    plain = signal.mask(signal.protect(signal.clean(F.col("message"))))
    assert all(a == b for a, b in df.select(signal.prepared(F.col("message")), plain).collect())


def test_search_beats_the_defaults(spark):
    rng = random.Random(9)
    kinds = ["alpha {} beta {} gamma {} delta", "alpha {} beta {} omega {} sigma", "job {} {} {} {} done"]
    rows = [(f"e{k:04d}", T0 + dt.timedelta(seconds=k), rng.choice(kinds).format(*["".join(rng.choice("bcdfgh") for _ in range(5)) for _ in range(4)]), {}) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    costs = {(r["similarity"], r["depth"]): r["cost"] for r in templates.grid(df).collect()}
    policy = templates.search(df)
    assert policy == templates.search(df.orderBy(F.rand(1))) == templates.tune(df, "search")
    assert costs[policy["similarity"], policy["depth"]] == min(costs.values()) < costs[0.5, 4]
    one = templates.Miner(0.5, 4)
    found = {id(c): c for c in (one.add(m.split()) for _, _, m, _ in rows)}.values()
    assert costs[0.5, 4] == sum(len(t) + n * t.count("<*>") for t, n in found)
    assert templates.search(df.limit(0)) == {"similarity": 0.5, "depth": 4}
