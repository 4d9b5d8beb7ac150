import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logweave.operators import causal, correlate, graph, segmentation, templates, triage, windows
from logweave.plans.engine import Engine, Settings
from logweave.session import Scratch
from logweave.sources import store, text

T0 = dt.datetime(2026, 9, 16, 15, 0, 0)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def lines(spark, rows, file="f"):
    return spark.createDataFrame([(file, k, r) for k, r in enumerate(rows)], "file string, line_no long, line string")


def test_segmentation_fixture(spark):
    df = lines(spark, ["  orphan start", "2026-09-16 15:03:00 [ERROR] x", "  at a.b", "", "tail"])
    events = [(r["event"], r["line_count"], r["first_line_is_header"], r["source"]) for r in segmentation.assemble(df).orderBy("line_no").collect()]
    assert events == [("orphan start", 1, False, "orphan"), ("2026-09-16 15:03:00 [ERROR] x | at a.b", 2, True, "regex"), ("tail", 1, False, "orphan")]
    report = segmentation.validate(df).first()
    assert (report["total_lines"], report["nonempty_lines"], report["blank_lines"], report["header_matches"], report["internal_header_candidates"], report["coverage"], report["zero_loss"], report["accepted"]) == (5, 4, 1, 1, 0, 100.0, True, True)


def test_indented_brace_refuses_the_file(spark):
    df = lines(spark, ["2026-09-16 15:03:00 x", "  {"])
    assert segmentation.validate(df).first()["internal_header_candidates"] == 1
    with pytest.raises(RuntimeError):
        segmentation.settle(df)
    assert not segmentation.settle(df, strict=False).verified


def test_stretches_change_nothing(spark, monkeypatch):
    random.seed(3)
    rows = [random.choice(["", "  cont", "2026-09-16 15:03:00 a", "{x", "plain"]) for _ in range(200)]
    whole = segmentation.assemble(lines(spark, rows)).orderBy("line_no").collect()
    monkeypatch.setattr(segmentation, "STRETCH", 7)
    assert segmentation.assemble(lines(spark, rows)).orderBy("line_no").collect() == whole


def test_safety():
    assert segmentation.safety(r"^\d+")[0]
    assert not any(segmentation.safety(p)[0] for p in ("", "x", "^.*", "^(", "^" + "a" * 1001, "^" + "|".join("abcdefghijklmnopqrstuvwxyzab")))


def test_components_against_union_find(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[find(a)] = find(b)
    got = {}
    for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long"), Scratch(spark)).collect():
        got.setdefault(r["root"], set()).add(r["node"])
    want = {}
    for n in list(parent):
        want.setdefault(find(n), set()).add(n)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, (v for v in want.values() if len(v) > 1)))
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark)).count() == 0


def test_trailing_count_against_brute_force(spark):
    random.seed(2)
    rows = [(k, random.choice("ab"), at(random.randrange(400))) for k in range(300)]
    df = spark.createDataFrame(rows, "event_id long, template_id string, event_ts timestamp")
    got = {r["event_id"]: r["window_count_1m"] for r in windows.trailing_count(df).collect()}
    assert got == {i: sum(t == u and 0 <= (s - x).total_seconds() <= 60 for _, u, x in rows) for i, t, s in rows}


def folded(rows, most, seconds=300):
    """(id, source, time) -> window starts, by a fold over the rows of each source."""
    out, state = {}, {}
    for i, s, t in sorted(rows, key=lambda r: (r[2], r[0])):
        start, held = state.get(s, (None, 0))
        if start is None or t > start + dt.timedelta(seconds=seconds) or held >= most:
            start, held = t, 0
        state[s] = start, held + 1
        out[i] = start
    return out


ROWS = "event_id long, source string, event_ts timestamp"


@pytest.mark.parametrize("span", [40, 5000, 90_000])
def test_anchored_windows_against_fold(spark, span):
    random.seed(4)
    rows = [(k, random.choice(["s", "s", "t", None]), at(random.randrange(span))) for k in range(200)]
    for most in (1, 5, 1000):
        got = {r["event_id"]: r["window_start"] for r in windows.anchored_windows(spark.createDataFrame(rows, ROWS), most=most).collect()}
        assert got == folded(rows, most)


def test_anchored_windows_at_size(spark):
    """A source that never pauses, with bursts: no group of it is folded, and no plan holds Python."""
    random.seed(8)
    times = [random.choice([random.randrange(400_000), 5000 + random.randrange(40), 77]) for _ in range(100_000)]
    rows = [(k, "s", at(t)) for k, t in enumerate(times)]
    df = spark.createDataFrame(rows, ROWS)
    for most in (1, 5, 20_000):
        made = windows.anchored_windows(df, most=most)
        assert "Python" not in made._jdf.queryExecution().toString() and "Pandas" not in made._jdf.queryExecution().toString()
        want = folded(rows, most)
        assert all(want[r["event_id"]] == r["window_start"] for r in made.collect())
    assert windows.anchored_windows(df.limit(0)).count() == 0


def test_trailing_count_in_order_and_without_key(spark):
    random.seed(5)
    rows = [(k, random.choice(["a", None]), at(random.randrange(90))) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, template_id string, event_ts timestamp")
    got = {r["event_id"]: r["window_count_1m"] for r in windows.trailing_count(df, order="event_id").collect()}
    assert got == {i: sum(t == u and 0 <= (s - x).total_seconds() <= 60 and (x < s or j <= i) for j, u, x in rows) for i, t, s in rows}


def test_overflow_cap(spark):
    df = spark.createDataFrame([(k, at(k), f"k{k}", "w") for k in range(30)], "event_id long, event_ts timestamp, k string, window_start string")
    found = windows.overflow(df, ["k"], most=10).groupBy("state_key").count().collect()
    assert len(found) == 10 and {r["state_key"]: r["count"] for r in found}["__overflow__"] == 21


@pytest.mark.parametrize("children", [2, 100])
def test_drain_against_single_tree(spark, children):
    random.seed(5)
    texts = [f"{random.choice(['open', 'close', 'read'])} file {random.choice(['a', 'b', 'x1'])} by {random.choice(['ann', 'bob', 'cyd'])}" + " now" * random.randrange(2) for _ in range(200)]
    df = spark.createDataFrame([(k, at(k), t) for k, t in enumerate(texts)], "event_id long, event_ts timestamp, message string")
    got = {r["event_id"]: (r["template"], r["cluster_size"]) for r in templates.mine(df, attributes=None, children=children).collect()}
    miner, first, clusters = templates.Miner(children=children), {}, {}
    for t in texts:
        first.setdefault(t, len(first))
    for t in first:
        clusters[t] = miner.add(t.split(" "), texts.count(t))
    assert got == {k: (" ".join(clusters[t][0]), clusters[t][1]) for k, t in enumerate(texts)}


def test_pair_score_fixture(spark):
    df = spark.createDataFrame([("a", at(0), "payment", "timeout", "payment", ["x"]), ("b", at(10), "payment", "retry", "payment", ["y"])], "event_id string, event_ts timestamp, service_family string, error_family string, domain string, correlation_tokens array<string>")
    row = correlate.verdicts(correlate.pair_scores(correlate.band_pairs(correlate.prepare(df, None)))).first()
    assert round(row["score"], 5) == 0.99333 and row["verdict"] == "merge"


def incident(i, family, error, risk, start, end):
    return (i, at(start), at(end), [family], [family], [error], risk)


SCHEMA = "incident_id string, start_ts timestamp, end_ts timestamp, service_families array<string>, domains array<string>, error_families array<string>, max_risk_score int"


def test_causal_fixture(spark):
    nodes = causal.nodes(spark.createDataFrame([incident("L", "database", "connection", 80, 0, 60), incident("R", "payment", "timeout", 50, 20, 40)], SCHEMA))
    edges = causal.edges(causal.judged_edges(causal.edge_scores(causal.ordered_pairs(nodes))))
    edge = edges.first()
    assert (edge["source"], edge["target"], edge["score"], edge["independent_evidence_count"], edge["evidence_diversity_score"]) == ("L", "R", 1.0, 3, 1.0)
    roles = {r["incident_id"]: (r["graph_role"], round(r["root_cause_score"], 6)) for r in causal.roles(nodes, edges).collect()}
    assert roles == {"L": ("upstream_root_candidate", 0.98), "R": ("downstream_symptom", 0.05)}
    assert causal.summary(nodes, edges).first()["root_cause_status"] == "confirmed_by_graph"


def test_weak_pair_gives_no_root(spark):
    nodes = causal.nodes(spark.createDataFrame([incident("L", "search", "other", 10, 0, 1), incident("R", "user", "other", 10, 100, 101)], SCHEMA))
    judged = causal.judged_edges(causal.edge_scores(causal.ordered_pairs(nodes)))
    row = judged.first()
    assert round(row["score"], 5) == 0.13333 and row["verdict"] == "rejected"
    edges = causal.edges(judged)
    assert causal.summary(nodes, edges).first()["root_cause_status"] == "unconfirmed"
    assert causal.root_candidates(causal.roles(nodes, edges)).count() == 0


def test_edge_id(spark):
    assert spark.range(1).select(causal.edge_id(F.lit("a"), F.lit("b"))).first()[0] == "EDGE-3d53ebc757"


def test_greedy_budget():
    pool = [{"incident_id": f"i{k}", "risk": k, "events": k, "services": ["s"], "errors": ["e"], "domain": "d", "bucket": str(k), "payload": "x" * 100} for k in range(50)]
    assert len(triage.greedy(pool)) == 18
    assert len(triage.greedy(pool, max_tokens=60)) == 2


def test_store(spark, tmp_path):
    held = store.IncidentStore(spark, str(tmp_path / "store"))
    one = spark.createDataFrame([("a", at(0), 1), ("b", at(1), 1)], "incident_id string, start_ts timestamp, n int")
    held.upsert(one, 1)
    held.upsert(one.where("incident_id = 'a'").withColumn("n", F.lit(2)), 2)
    assert [(r["incident_id"], r["n"]) for r in held.load_all().collect()] == [("a", 2), ("b", 1)]
    held.compact()
    assert held.count() == 2 and [r["incident_id"] for r in held.load_recent(1).collect()] == ["b"]


def test_text_source(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n\nthr\xffee\n")
    got = [(r["line_no"], r["line"]) for r in text.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [(0, "one"), (1, "two"), (2, ""), (3, "three")]
    assert text.file_fingerprint(spark, str(tmp_path)) == text.file_fingerprint(spark, str(tmp_path))


def test_smoke_story(spark):
    story = [
        '{"level":50,"msg":"db connection refused","service":"database","time":"2026-09-16T15:02:30"}', "2026-09-16 15:03:00 [ERROR] payment-api: primary DB timeout", "2026-09-16 15:03:05 [ERROR] payment-api: retry attempt 1",
        "2026-09-16 15:03:20 [ERROR] order-service: dependency failure calling payment HTTP 500", "2026-09-16 15:03:21 [INFO] inventory-api: health check 200",
    ]
    engine = Engine(spark, lines(spark, story), Settings(strict=False), ingest=F.lit("2026-09-16 15:03:10").cast("timestamp"))
    roles = {tuple(r["service_families"]): r["graph_role"] for r in engine.stage("incidents").join(engine.stage("roles"), "incident_id").collect()}
    assert roles == {("database",): "upstream_root_candidate", ("payment",): "downstream_symptom"}
    assert engine.stage("rca").count() == 1


def test_judges_reach_incidents_and_edges(spark, tmp_path):
    from logweave.plans.judge import FunctionJudge, cached

    answers = []

    def ask(rows):
        answers.append([r["pair_id"] for r in rows])
        return '```json\n{"decisions": [' + ", ".join(f'{{"pair_id": "{r["pair_id"]}", "decision": "merge", "confidence": 0.9}}' for r in rows if r["l_event_id"] == "a") + "]}\n```"

    df = spark.createDataFrame([("a", at(0), "payment", "other", "payment"), ("b", at(10), "payment", "retry", "x"), ("c", at(20), "payment", "timeout2", "y")], "event_id string, event_ts timestamp, service_family string, error_family string, domain string").withColumn("window_start", F.lit(0))
    alone = {r["event_id"]: r["incident"] for r in correlate.incident_members(df)[0].collect()}
    assert len(set(alone.values())) == 3
    expert = lambda rows: "[" + ", ".join(f'{{"pair_id": "{r["pair_id"]}", "decision": "separate"}}' for r in rows) + "]"
    judge = FunctionJudge(cached(ask, store.ValueCache(spark, str(tmp_path / "answers")), "test"), size=2, expert=expert, escalate=0.3)
    joined = {r["event_id"]: r["incident"] for r in correlate.incident_members(df, judge=judge)[0].collect()}
    assert len(set(joined.values())) == 1 and judge.stats == {"calls": 2, "pairs": 3, "unreadable": 0, "expert_calls": 1, "expert_decisions": 1}
    correlate.incident_members(df, judge=judge)[0].count()
    assert len(answers) == 2  # the second time the answers are known

    nodes = causal.nodes(spark.createDataFrame([incident("L", "search", "connection", 80, 0, 60), incident("R", "user", "retry", 50, 20, 40)], SCHEMA))
    judged = causal.judged_edges(causal.edge_scores(causal.ordered_pairs(nodes)))
    assert causal.edges(judged).count() == 0
    agree = FunctionJudge(lambda rows: "[" + ", ".join(f'{{"pair_id": "{r["pair_id"]}", "decision": "edge", "confidence": 0.95}}' for r in rows) + "]")
    edge = causal.edges(judged, causal.asked(judged, agree)).collect()
    assert [(e["source"], e["target"], e["validation_source"]) for e in edge] == [("L", "R", "judge")]


def test_representatives_of_an_incident(spark):
    random.seed(9)
    rows = [(f"e{k:02d}", at(random.randrange(300)), random.randrange(100), random.choice(["timeout", "retry", "other"]), k % 2) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id string, event_ts timestamp, risk_score int, error_family string, incident int")
    got = {}
    for r in correlate.select_representatives(df).orderBy("rep").collect():
        got.setdefault(r["incident"], []).append(r["event_id"])
    for which in (0, 1):
        own = sorted((t, e, s, f) for e, t, s, f, i in rows if i == which)
        want = [own[0][1], own[-1][1], min(own, key=lambda r: (-r[2], r[0], r[1]))[1]]
        want += [next(r[1] for r in own if r[3] == f) for f in sorted({r[3] for r in own}, key=lambda f: next(r[:2] for r in own if r[3] == f))]
        want += [r[1] for r in sorted(own, key=lambda r: (-r[2], r[1]))]
        assert got[which] == list(dict.fromkeys(want))[:6]


def test_store_survives_a_broken_compaction(spark, tmp_path):
    held = store.IncidentStore(spark, str(tmp_path / "s"))
    make = lambda v: spark.createDataFrame([("i", v, at(0)), ("j", v, at(1))], "incident_id string, v int, start_ts timestamp")
    held.upsert(make(1), 1)
    held.upsert(make(2), 2)
    (tmp_path / "s" / "v=1").mkdir()  # a compaction that broke off: no success marker
    assert held.versions() == [0] and [r["v"] for r in held.load_all().collect()] == [2, 2]
    held.compact()
    assert held.versions() == [1] and held.count() == 2 and held._rows().count() == 2
    held.upsert(make(3), 3)
    assert [r["v"] for r in held.load_recent(1).collect()] == [3]
    held.clear()
    assert held.versions() == []


def test_header_checks_by_a_parser_and_rounds(spark):
    df = lines(spark, [f"2026-09-16 15:03:{k:02d} [ERROR] x" for k in range(20)])
    reads = lambda event: F.when(event.contains("ERROR"), event)
    report = segmentation.validate(df, parser=reads).first()
    assert (report["parser_attempts"], report["parser_success"], report["accepted"]) == (20, 20, True)
    assert not segmentation.validate(df, parser=lambda event: F.when(event.contains("FATAL"), event)).first()["accepted"]
    asked = []

    def refine(report, found):
        asked.append({r["kind"] for r in found.collect()})
        return r"^\d{4}-\d{2}-\d{2} "

    settled = segmentation.settle(df, [r"^nothing"], refine=refine)
    assert (settled.origin, settled.verified, len(settled.attempts)) == ("refined", True, 2) and asked == [{"failed", "internal"}]
    assert segmentation.settle(df, [r"^nothing"], rounds=1, critic=lambda tried: r"^2026").origin == "critic"


def test_streamed_lines_that_are_equal(spark, tmp_path):
    from logweave.streaming import stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("same\nsame\n\nsame\n")
    query = stream.read_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("equal_lines").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table("equal_lines").orderBy("line_no").collect()
    assert [(r["event"], r["line_no"]) for r in rows] == [("same", 0), ("same", 1), ("", 2), ("same", 3)]


def test_a_full_miner_forgets_nothing():
    miner = templates.Miner(similarity=0.9, most=2)
    found = [miner.add(t.split()) for t in ("a b c d", "a b x y", "a b p q", "a b c d", "z b c d")]
    assert miner.size == 3 and found[0] is found[3] and [c[1] for c in miner.leaf(["a", "b", "c", "d"])] == [3, 1]


def test_engine_replays_counts_and_keeps_its_header(spark, tmp_path):
    rows = [f"2026-09-16 15:00:{k:02d} [ERROR] payment-api: timeout {k}" for k in range(6)] + ["2026-09-16 15:00:30 [INFO] inventory-api: health check 200"]
    cache, results = store.ValueCache(spark, str(tmp_path / "values")), store.ResultCache(spark, str(tmp_path / "results"))
    engine = Engine(spark, lines(spark, rows), Settings(), cache=cache)
    counted = engine.counters().first()
    assert (counted["raw_blocks"], counted["parsed"], counted["signaled"], counted["actionable"], counted["filtered_out"], counted["windows_finalized"], counted["stream_aggregated_events"]) == (7, 7, 7, 6, 1, 1, 6)
    assert engine.summary().first()["incident_candidates"] == counted["persisted_incidents"] >= 1
    held = engine.stage("incidents").first()
    assert 1 <= len(held["events"]) <= 6 and held["events"][0]["severity"] == "ERROR" and held["explicit_trace"] == 0.0 and 0 <= held["semantic_score"] <= 1
    first = engine.replayed("incidents", results, "f" * 64)
    again = Engine(spark, lines(spark, ["nothing like it"]), Settings(), cache=cache).replayed("incidents", results, "f" * 64)
    assert [r["incident_id"] for r in again.collect()] == [r["incident_id"] for r in first.collect()]
    assert Engine(spark, lines(spark, rows), Settings(), cache=cache)._settled() == engine._settled()
