import json

from pyspark.sql import functions as F

from logweave.operators import triage

INCIDENT = (
    "incident_id string, incident string, start_ts timestamp, end_ts timestamp, services array<string>, inferred_services array<string>, service_families array<string>, event_count long, max_risk_score int, error_family_counts array<struct<key:string,n:long>>, "
    "severity_counts array<struct<key:string,n:long>>, topology_dependencies array<string>, topology_upstreams array<string>, topology_downstreams array<string>, evidence_ids array<string>, evidence_count long, evidence array<string>, pairwise_max double"
)


def test_document(spark):
    many = [f"s{k}" for k in range(9)]
    rows = [(f"I{k}", f"i{k}", None, None, many, [], many, 3 + k, 40 + k, [("timeout", 2), ("retry", 1)], [("ERROR", 3)], [], many, [], many, 9, [], 0.9) for k in range(4)]
    incidents = spark.createDataFrame(rows, INCIDENT)
    events = spark.createDataFrame([("i0", "e1", "ERROR", 50, "first\nline " + "x" * 300), ("i0", "e0", "ERROR", 50, "second"), ("i1", "e2", "ERROR", 9, "third")], "incident string, event_id string, severity string, risk_score int, message string")
    edges = spark.createDataFrame([("E1", "I0", "I1", 0.9, ["temporal_precedence", "timeout_to_retry"], "judge", 0.8), ("E2", "I2", "I1", 0.95, ["known_dependency_direction"], "deterministic", None)], "edge_id string, source string, target string, score double, evidence array<string>, validation_source string, judge_confidence double")
    roots = spark.createDataFrame([("I2", 0.9), ("I0", 0.8)], "incident_id string, root_cause_score double")
    scores = spark.createDataFrame([("I2", 0.9), ("I0", 0.8004), ("I1", 0.05), ("I3", 0.0)], "incident_id string, root_cause_score double")
    summary = spark.createDataFrame([(4, 2, 0.912, "confirmed_by_graph")], "node_count long, edge_count long, graph_confidence double, root_cause_status string")
    compacted = triage.compact_incidents(incidents, events)
    anchors = triage.anchors(incidents, roots, edges)
    answer = spark.createDataFrame([("I0", 40, "first of all", "high"), ("I9", 1, "not there", "high")], "incident_id string, risk_score int, reason string, overall_priority string")
    row = triage.rca_payload(anchors, compacted, edges, roots, summary, scores, answer).first()
    said = json.loads(row["payload"])
    assert row["estimated_tokens"] == (len(row["payload"]) + 3) // 4
    assert said["triage"] == {"selected_incidents": [{"incident_id": "I0", "risk_score": 40, "reason": "first of all"}], "overall_priority": "high"}
    assert said["instructions"]["numeric_confidence_source"] == "causal_graph.authoritative_confidence" and len(said["instructions"]) == 9
    graph = said["causal_graph"]
    assert graph["root_cause_candidates"] == ["I0", "I2"] and graph["root_cause_scores"] == {"I0": 0.8, "I1": 0.05, "I2": 0.9}
    assert [(e["source"], e["judge_confidence"], e["evidence_dimensions"], e["independent_evidence_count"]) for e in graph["edges"]] == [("I2", None, ["dependency"], 1), ("I0", 0.8, ["propagation", "temporal"], 2)]
    first = said["incident_candidates"][0]
    assert [i["incident_id"] for i in said["incident_candidates"]] == said["context_selection"]["anchor_incidents"] == ["I0", "I2", "I1"]
    assert first["error_family_counts"] == {"timeout": 2, "retry": 1} and len(first["services"]) == 4 and len(first["evidence_ids"]) == 3
    assert [e["event_id"] for e in first["events"]] == ["e0"] and [e["event_id"] for e in said["incident_candidates"][2]["events"]] == ["e2"] and said["incident_candidates"][1]["events"] == []
    assert said["context_budget"]["max_incidents"] == 3 and said["context_budget"]["raw_log_blocks_included"] is False
    plain = json.loads(triage.rca_payload(anchors, triage.compact_incidents(incidents), edges.drop("judge_confidence"), roots, summary).select(F.col("payload")).first()[0])
    assert plain["triage"] is None and plain["causal_graph"]["root_cause_scores"] == {"I0": 0.8, "I2": 0.9}
