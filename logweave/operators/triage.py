"""Choice of incidents for triage and root-cause contexts, within a token budget."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.causal import dimensions

TOP_K, MAX_TOKENS = 18, 12_000


def tokens_of(text: Column) -> Column:
    """Estimated tokens of a JSON text: a quarter of its characters, at least 1."""
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def json_tokens(value: Column) -> Column:
    return tokens_of(F.to_json(value))


def top_event(events: DataFrame, by: list[str]) -> DataFrame:
    """The riskiest event of each group, the least id first among equals."""
    columns = [c for c in events.columns if c not in by]
    best = events.groupBy(*by).agg(F.min_by(F.struct(*columns), F.struct((-F.col("risk_score")).alias("r"), F.col("event_id").cast("string").alias("e"))).alias("_e"))
    return best.select(*by, "_e.*")


def compact_incidents(incidents: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Incidents cut down to what triage needs. events: (incident, event_id, event_time, severity, ..., risk_score), for the representative event."""
    head = lambda c, n: F.slice(F.col(c), 1, n).alias(c)
    rows = incidents
    fields = ["event_id", "event_ts", "severity", "service", "inferred_service", "service_family", "error_family", "domain", "exception_type", "risk_score", "message"]
    if events is not None:
        top = top_event(events.select("incident", *[c for c in fields if c in events.columns]), ["incident"])
        cells = [F.substring(F.regexp_replace(F.trim(c), "\n", " | "), 1, 220).alias(c) if c == "message" else F.col(c) for c in top.columns if c != "incident"]
        rows = rows.join(top.select("incident", F.struct(*cells).alias("representative_event")), "incident", "left")
    else:
        rows = rows.withColumn("representative_event", F.lit(None).cast("struct<event_id:string,domain:string>"))
    return rows.select(
        "incident_id", F.struct("start_ts", "end_ts").alias("time_range"), head("services", 6), head("inferred_services", 6), head("service_families", 6), "event_count", "max_risk_score", head("error_family_counts", 6), head("severity_counts", 6),
        head("topology_dependencies", 6), head("topology_upstreams", 6), head("topology_downstreams", 6), head("evidence_ids", 5), "evidence_count", head("evidence", 6), "pairwise_max", "representative_event",
    )


def ranked(incidents: DataFrame, k: int = TOP_K) -> DataFrame:
    """Risk first: the k incidents with the highest risk, then most events, then most evidence."""
    return incidents.orderBy(F.col("max_risk_score").desc(), F.col("event_count").desc(), F.col("evidence_count").desc(), "start_ts", "incident_id").limit(k)


def greedy(pool: list[dict], k: int = TOP_K, max_tokens: int = MAX_TOKENS) -> list[str]:
    """Ids in order of choice. Each dict: incident_id, risk, events, services, errors, domain, bucket, payload (JSON text).

    The next choice has the highest risk, novelty and size together; the choice ends at k, or before the budget is exceeded.
    """
    left, chosen, size = list(pool), [], 2
    seen: dict[str, set] = {"services": set(), "errors": set(), "domain": set(), "bucket": set()}
    while left and len(chosen) < k:

        def worth(i: dict) -> tuple:
            novelty = 2.2 * len(set(i["services"]) - seen["services"]) + 1.8 * len(set(i["errors"]) - seen["errors"]) + 1.2 * bool(i["domain"] and i["domain"] not in seen["domain"]) + 0.8 * bool(i["bucket"] and i["bucket"] not in seen["bucket"])
            return i["risk"] / 20.0 + novelty + min(2.0, i["events"] / 100.0), i["risk"], i["events"], i["incident_id"]

        best = max(left, key=worth)
        grown = size + len(best["payload"]) + bool(chosen)
        if max(1, (grown + 3) // 4) > max_tokens:
            break
        chosen.append(best["incident_id"])
        size = grown
        seen["services"] |= set(best["services"])
        seen["errors"] |= set(best["errors"])
        seen["domain"].add(best["domain"])
        seen["bucket"].add(best["bucket"])
        left = [i for i in left if i["incident_id"] != best["incident_id"]]
    return chosen


def triage(compacted: DataFrame, k: int = TOP_K, max_tokens: int = MAX_TOKENS, most: int = 5000) -> DataFrame:
    """The greedy diverse choice among the `most` riskiest incidents (the graph's own limit), in order of start, with nth (order of choice)."""
    low = lambda a: F.transform(a, F.lower)
    payload = F.to_json(F.struct(*compacted.columns))
    rows = compacted.select(
        F.lit(0).alias("one"), "incident_id", F.col("max_risk_score").alias("risk"), F.col("event_count").alias("events"), low(F.when(F.size("service_families") > 0, F.col("service_families")).otherwise(F.col("services"))).alias("services"),
        low(F.transform("error_family_counts", lambda e: e["key"])).alias("errors"), F.lower(F.coalesce("representative_event.domain", F.lit(""))).alias("domain"), F.coalesce(F.unix_millis(F.col("time_range.start_ts").cast("timestamp")).cast("string"), F.lit("")).alias("bucket"), payload.alias("payload"),
    ).orderBy(F.col("risk").desc(), F.col("events").desc(), "incident_id").limit(most)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = greedy(pdf.to_dict("records"), k, max_tokens)
        return pd.DataFrame({"incident_id": ids, "nth": range(1, len(ids) + 1)})

    chosen = rows.groupBy("one").applyInPandas(run, "incident_id string, nth int")
    return compacted.join(F.broadcast(chosen), "incident_id").orderBy("time_range.start_ts", "incident_id")  # at most k rows


def anchors(incidents: DataFrame, roots: DataFrame, graph_edges: DataFrame, selected: DataFrame | None = None, most: int = 8) -> DataFrame:
    """(incident_id, priority): roots, then both ends of the five best edges, then triage's choice; without any, the three riskiest. At most `most`."""
    top = graph_edges.orderBy(F.col("score").desc(), "source", "target").limit(5).withColumn("_n", F.row_number().over(Window.orderBy(F.col("score").desc(), "source", "target")))  # five rows
    parts = roots.select("incident_id", F.struct(F.lit(0).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("side")).alias("p"))
    for side, end in enumerate(("source", "target")):
        parts = parts.unionByName(top.select(F.col(end).alias("incident_id"), F.struct(F.lit(1).alias("kind"), F.col("_n").alias("n"), F.lit(side).alias("side")).alias("p")))
    if selected is not None:
        parts = parts.unionByName(selected.select("incident_id", F.struct(F.lit(2).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("side")).alias("p")))
    fallback = incidents.orderBy(F.col("max_risk_score").desc(), "incident_id").limit(3).select("incident_id", F.struct(F.lit(3).alias("kind"), F.lit(0).alias("n"), F.lit(0).alias("side")).alias("p"))
    every = parts.unionByName(fallback).join(incidents.select("incident_id"), "incident_id", "left_semi")
    best = every.groupBy("incident_id").agg(F.min("p").alias("p"))
    first = best.agg(F.min("p.kind").alias("_k"))  # one row
    kept = best.crossJoin(F.broadcast(first)).where((F.col("p.kind") < 3) | (F.col("_k") == 3))
    return kept.orderBy("p", "incident_id").limit(most).select("incident_id", F.col("p").alias("priority"))


INSTRUCTIONS = (
    "distinguish_root_cause_from_symptoms", "use_event_ids_as_evidence", "do_not_treat_risk_as_ground_truth", "do_not_claim_causality_without_temporal_and_dependency_evidence", "no_edges_means_no_confirmed_root_cause",
    "prefer_upstream_nodes_with_downstream_effects", "do_not_override_numeric_graph_confidence", "report_evidence_diversity",
)
# Names in the document.
CONFIDENCE_SOURCE, POLICY = "causal_graph.authoritative_confidence", "root_first_plus_top_causal_edges_then_triage_support"
EVENT_FIELDS = ("event_id", "event_time", "event_ts", "severity", "service", "service_family", "component", "exception_type", "error_family", "message", "risk_score", "occurrences_1m")


def rca_incident(compacted: DataFrame) -> Column:
    """A compacted incident as the document has it: counts as an object, at most four names of a kind, three ids, and its riskiest event."""
    counts = lambda c: F.map_from_entries(F.transform(c, lambda e: F.struct(e["key"], e["n"]))).alias(c)
    head = lambda c, n: F.slice(c, 1, n).alias(c)
    event = F.col("representative_event")
    have = [f.name for f in compacted.schema["representative_event"].dataType.fields if f.name in EVENT_FIELDS]
    events = F.when(event.isNull(), F.array()).otherwise(F.array(F.struct(*[event[f].alias("event_time" if f == "event_ts" else f) for f in have])))
    return F.struct(
        "incident_id", "time_range", head("services", 4), head("service_families", 4), "event_count", "max_risk_score", counts("error_family_counts"), counts("severity_counts"),
        head("topology_dependencies", 4), head("topology_upstreams", 4), head("topology_downstreams", 4), head("evidence_ids", 3), "evidence_count", events.alias("events"),
    )


def rca_payload(anchor_rows: DataFrame, compacted: DataFrame, graph_edges: DataFrame, roots: DataFrame, graph_summary: DataFrame, scores: DataFrame | None = None, answer: DataFrame | None = None) -> DataFrame:
    """One row with one JSON document: instructions, triage, the graph with the best edges at the anchors, and the anchors' incidents in the anchors' order.

    scores: (incident_id, root_cause_score) of all nodes; the five best stand for the graph, the anchors among them are given. answer: (incident_id, risk_score, reason, overall_priority) of a triage judge; without it the document's triage is null."""
    top = graph_edges.orderBy(F.col("score").desc(), "source", "target").limit(5)
    ids = anchor_rows.select("incident_id")
    near = top.join(ids.withColumnRenamed("incident_id", "source"), "source", "left_semi").unionByName(top.join(ids.withColumnRenamed("incident_id", "target"), "target", "left_semi")).dropDuplicates(["edge_id"])
    reasons = F.slice("evidence", 1, 6)
    d = dimensions(reasons, rca=True)
    said = F.col("judge_confidence") if "judge_confidence" in graph_edges.columns else F.lit(None).cast("double")
    edge = F.struct("source", "target", F.round("score", 3).alias("score"), "validation_source", said.alias("judge_confidence"), reasons.alias("evidence"), d.alias("evidence_dimensions"), F.size(d).alias("independent_evidence_count"))
    ordered = lambda entries: F.transform(F.array_sort(F.collect_list(entries)), lambda e: e["v"])
    gathered = near.agg(ordered(F.struct((-F.col("score")).alias("s"), "source", "target", edge.alias("v"))).alias("edges"))
    incidents = compacted.join(anchor_rows, "incident_id").agg(ordered(F.struct("priority", "incident_id", F.to_json(rca_incident(compacted)).alias("v"))).alias("incidents"))  # at most 8
    root_ids = roots.agg(F.sort_array(F.collect_list("incident_id")).alias("roots"))  # at most 3
    anchor_ids = anchor_rows.agg(ordered(F.struct("priority", F.col("incident_id").alias("v"))).alias("anchors"))
    best = roots if scores is None else scores.orderBy(F.col("root_cause_score").desc(), "incident_id").limit(5)
    view = best.join(ids, "incident_id", "left_semi").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("incident_id", F.round("root_cause_score", 3).alias("s"))))).alias("scores"))
    one = graph_summary.crossJoin(gathered).crossJoin(incidents).crossJoin(root_ids).crossJoin(anchor_ids).crossJoin(view)  # a row each
    said = F.lit(None).cast("variant")
    if answer is not None:
        items = answer.join(ids, "incident_id", "left_semi").orderBy("incident_id").limit(4)
        chosen = items.agg(F.array_sort(F.collect_list(F.struct("incident_id", "risk_score", F.substring(F.coalesce("reason", F.lit("")), 1, 180).alias("reason")))).alias("picked"), F.substring(F.coalesce(F.max("overall_priority"), F.lit("")), 1, 220).alias("priority"))
        one, said = one.crossJoin(chosen), F.parse_json(F.to_json(F.struct(F.col("picked").alias("selected_incidents"), F.col("priority").alias("overall_priority"))))  # a row
    document = F.struct(
        F.lit("root_cause_analysis").alias("task"), F.struct(*[F.lit(True).alias(k) for k in INSTRUCTIONS], F.lit(CONFIDENCE_SOURCE).alias("numeric_confidence_source")).alias("instructions"), said.alias("triage"),
        F.struct(F.slice("roots", 1, 3).alias("root_cause_candidates"), F.col("scores").alias("root_cause_scores"), "graph_confidence", F.col("graph_confidence").alias("authoritative_confidence"), "edge_count", "root_cause_status", "edges").alias("causal_graph"),
        F.transform("incidents", F.parse_json).alias("incident_candidates"), F.struct(F.col("anchors").alias("anchor_incidents"), F.slice("roots", 1, 3).alias("root_candidates"), F.lit(POLICY).alias("selection_policy")).alias("context_selection"),
        F.struct(
            F.size("incidents").alias("max_incidents"), F.size("edges").alias("max_graph_edges"), F.lit(4).alias("max_triage_items"), F.lit(5000).alias("target_estimated_input_tokens"), F.lit(1).alias("max_events_per_incident"),
            F.lit(220).alias("message_max_chars"), F.lit(False).alias("raw_log_blocks_included"), F.lit(False).alias("duplicate_graph_node_payload"),
        ).alias("context_budget"),
    )
    return one.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("payload")).withColumn("estimated_tokens", tokens_of(F.col("payload")))


def sections(report: str) -> list[tuple[str, str]]:
    """(title, body) of the numbered sections of a Markdown report."""
    import re

    heads = list(re.finditer(r"^###\s*\d+\.\s*(.+)$", report, re.M))
    return [(h[1].strip(), report[h.end() : n.start() if n else len(report)].strip()) for h, n in zip(heads, [*heads[1:], None], strict=True)]


def result_json(selected: DataFrame) -> str:
    """The chosen incidents (at most TOP_K) as one indented JSON text."""
    return json.dumps([json.loads(r["j"]) for r in selected.select(F.to_json(F.struct(*selected.columns)).alias("j")).collect()], indent=2, ensure_ascii=False)
