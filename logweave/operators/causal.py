"""Causal graph between incidents: scored edges, acceptance, roles and root scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave import constants as C
from logweave.functions.context import graph_family

EDGE_S, LEAST = 300, 0.35

# Names of reasons by what they are evidence of.
CANDIDATE = ("explicit_dependency_direction", "known_dependency_direction", "strong_error_propagation", "temporal_precedence", "tight_temporal_precedence", "timeout_to_retry", "http_failure_to_retry", "cross_domain_dependency", "inferred_topology")
DEPENDENCY = ("explicit_dependency_direction", "known_dependency_direction", "inferred_dependency_direction", "cross_domain_dependency", "inferred_topology")
PROPAGATION = ("strong_error_propagation", "timeout_to_retry", "http_failure_to_retry", "application_error_to_retry")
STRONG = ("explicit_dependency_direction", "known_dependency_direction", "strong_error_propagation", "tight_temporal_precedence", "cross_domain_dependency", "overlapping_incident_windows")


def words(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def known(array: Column) -> Column:
    return F.array_remove(array, "unknown")


def nodes(incidents: DataFrame) -> DataFrame:
    """The columns that edges need, with families normalised and "unknown" taken out of all sets."""
    have = set(incidents.columns)
    get = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>")
    normal = lambda c: F.array_distinct(F.transform(get(c), graph_family))
    millis = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    return incidents.select(
        "incident_id", millis("start_ts").alias("start_ms"), millis("end_ts").alias("end_ms"), known(normal("service_families")).alias("families"), known(get("domains")).alias("domains"), known(get("error_families")).alias("errors"), F.col("max_risk_score").alias("risk"),
        normal("topology_dependencies").alias("needs"), normal("topology_upstreams").alias("ups"), normal("topology_downstreams").alias("downs"),
    )


def ordered_pairs(graph_nodes: DataFrame, seconds: int = EDGE_S) -> DataFrame:
    """Pairs where the right incident starts after the left and at most `seconds` later, as an equal join on buckets of that size."""
    size = seconds * 1000
    left = graph_nodes.select(*[F.col(c).alias(f"l_{c}") for c in graph_nodes.columns], F.floor(F.col("start_ms") / size).alias("lb"))
    right = graph_nodes.select(*[F.col(c).alias(f"r_{c}") for c in graph_nodes.columns], F.explode(F.array(F.floor(F.col("start_ms") / size), F.floor(F.col("start_ms") / size) - 1)).alias("rb"))
    return left.join(right, (F.col("lb") == F.col("rb")) & (F.col("l_start_ms") < F.col("r_start_ms")) & (F.col("r_start_ms") - F.col("l_start_ms") <= size)).drop("lb", "rb")


def edge_scores(pairs: DataFrame, seconds: int = EDGE_S) -> DataFrame:
    """pairs as source, target, score, reasons (sorted)."""
    delta = F.col("r_start_ms") - F.col("l_start_ms")
    lf, rf, ld, rd, le, re = (F.col(c) for c in ("l_families", "r_families", "l_domains", "r_domains", "l_errors", "r_errors"))
    meet = F.arrays_overlap
    explicit = meet(F.col("l_downs"), rf) | meet(F.col("r_ups"), lf) | meet(F.col("l_needs"), rf)
    pairs_known = F.array(*[F.lit(f"{a}>{b}") for a, b in C.DEPENDENCIES])
    listed = meet(F.flatten(F.transform(lf, lambda a: F.transform(rf, lambda b: F.concat(a, F.lit(">"), b)))), pairs_known)
    layered = meet(lf, words(*C.INFRASTRUCTURE)) & meet(rf, words(*C.APPLICATIONS))
    fans_out = meet(le, words("connection", "timeout", "http_5xx", "application_error")) & meet(re, words("timeout", "http_5xx", "application_error", "retry")) & (F.size(lf) > 0) & (F.size(rf) > 0) & ~meet(lf, rf)
    kind = F.when(explicit, "explicit").when(listed, "known").when(layered | fans_out, "inferred").otherwise("none")
    base = pairs.withColumns({"_delta": delta, "_kind": kind})
    kind, delta, apart = F.col("_kind"), F.col("_delta"), ~meet(ld, rd)
    parts = [
        ("tight_temporal_precedence", 0.10, delta <= 30_000),
        ("temporal_precedence", 0.0, (delta > 30_000) & (delta <= 120_000)),
        ("overlapping_incident_windows", 0.0, F.col("l_end_ms") > F.col("r_start_ms")),
        ("explicit_dependency_direction", 0.55, kind == "explicit"),
        ("known_dependency_direction", 0.45, kind == "known"),
        ("cross_domain_dependency", 0.10, (kind == "known") & apart),
        ("inferred_topology", 0.0, (kind == "known") & ~apart),
        ("inferred_dependency_direction", 0.32, kind == "inferred"),
        ("cross_domain_dependency", 0.08, (kind == "inferred") & apart),
        ("strong_error_propagation", 0.25, F.array_contains(le, "connection") & meet(re, words("http_5xx", "timeout", "application_error", "other"))),
        ("timeout_to_retry", 0.18, F.array_contains(le, "timeout") & F.array_contains(re, "retry")),
        ("http_failure_to_retry", 0.18, F.array_contains(le, "http_5xx") & F.array_contains(re, "retry")),
        ("application_error_to_retry", 0.15, F.array_contains(le, "application_error") & F.array_contains(re, "retry")),
        ("same_domain", 0.10, meet(ld, rd)),
        ("same_service_family", 0.08, meet(lf, rf)),
        ("high_severity_upstream", 0.03, F.col("l_risk") >= 65),
    ]
    total = 0.20 * F.greatest(F.lit(0.0), 1.0 - delta / (seconds * 1000.0))
    for _, weight, condition in parts:
        if weight:
            total = total + F.when(condition, weight).otherwise(0.0)
    reasons = F.sort_array(F.array_distinct(F.array_compact(F.array(*[F.when(c, name) for name, _, c in parts]))))
    return base.select(F.col("l_incident_id").alias("source"), F.col("r_incident_id").alias("target"), F.least(F.lit(1.0), total).alias("score"), reasons.alias("reasons"))


def has(column: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(column, words(*names))


def dimensions(reasons: Column, rca: bool = False) -> Column:
    """Kinds of evidence. For RCA contexts overlapping windows count as temporal, and structure is left out."""
    temporal = ("tight_temporal_precedence", "temporal_precedence", *(("overlapping_incident_windows",) if rca else ()))
    structure = F.lit(None).cast("string") if rca else F.when(has(reasons, ("same_domain", "same_service_family")), "structure")
    return F.sort_array(F.array_compact(F.array(F.when(has(reasons, temporal), "temporal"), F.when(has(reasons, DEPENDENCY), "dependency"), F.when(has(reasons, PROPAGATION), "propagation"), structure)))


def independent(reasons: Column) -> Column:
    return F.size(F.array_remove(dimensions(reasons), "structure"))


def judged_edges(scored: DataFrame, high: float = 0.80, low: float = 0.40, least: float = LEAST) -> DataFrame:
    """scored with is_candidate and verdict: accepted, ambiguous or rejected."""
    r, s = F.col("reasons"), F.col("score")
    candidate = ((F.size(r) > 0) | (s > 0)) & (has(r, CANDIDATE) | (s >= least))
    certain = has(r, ("explicit_dependency_direction", "known_dependency_direction")) & F.array_contains(r, "temporal_precedence") & (s >= least)
    return scored.withColumns({"is_candidate": candidate, "verdict": F.when(candidate & ((s >= high) | certain), "accepted").when(candidate & (s >= low), "ambiguous").otherwise("rejected")})


def for_judge(judged: DataFrame, most: int = 20) -> DataFrame:
    """Ambiguous candidates with two kinds of evidence, best first: what a judge gets to see."""
    n = independent(F.col("reasons"))
    return judged.where((F.col("verdict") == "ambiguous") & (n >= 2)).withColumn("kinds", n).orderBy(F.col("score").desc(), F.col("kinds").desc(), "source", "target").limit(most)


def asked(judged: DataFrame, judge, most: int = 20) -> DataFrame:
    """(source, target, confidence) of the pairs that a judge takes for edges: pairs are named "source::target"."""
    pairs = for_judge(judged, most).withColumn("pair_id", F.concat_ws("::", "source", "target"))
    said = judge.decide(pairs.select("pair_id", "score", "reasons", "source", "target", "kinds"))
    return pairs.select("pair_id", "source", "target").join(said.where(F.col("decision") == "edge"), "pair_id").select("source", "target", "confidence")


def fuse(score: Column, opinion: Column, reasons: Column) -> Column:
    """Deterministic score and a judge's confidence together: struct of accepted and confidence."""
    hits = F.size(F.array_intersect(reasons, words(*STRONG)))
    joint = F.least(F.lit(1.0), score * 0.55 + opinion * 0.35 + F.least(F.lit(0.10), hits * 0.02))
    corroborated = (score >= 0.50) & (opinion >= 0.60) & (independent(reasons) >= 2)
    strong = (score >= 0.72) & (opinion >= 0.55) & (hits >= 2)
    return F.struct(F.when(corroborated, joint >= 0.50).when(strong, joint >= 0.55).otherwise(False).alias("accepted"), joint.alias("confidence"))


def edge_id(source: Column, target: Column) -> Column:
    return F.concat(F.lit("EDGE-"), F.substring(F.sha1(F.concat(source, F.lit("->"), target).cast("binary")), 1, 10))


def edges(judged: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Accepted edges, the best for each pair of incidents, with evidence and diversity. decisions: (source, target, confidence) of a judge for ambiguous pairs."""
    taken = judged.where(F.col("verdict") == "accepted").withColumn("validation_source", F.lit("deterministic"))
    if decisions is not None:
        fused = judged.where(F.col("verdict") == "ambiguous").join(decisions.select("source", "target", F.col("confidence").alias("_c")), ["source", "target"]).withColumn("_f", fuse(F.col("score"), F.col("_c"), F.col("reasons"))).where("_f.accepted")
        taken = taken.unionByName(fused.drop("_c", "_f").withColumn("validation_source", F.lit("judge")))
    best = taken.withColumn("_n", F.row_number().over(Window.partitionBy("source", "target").orderBy(F.col("score").desc(), "validation_source"))).where("_n = 1")
    evidence = F.when(F.col("validation_source") == "deterministic", F.sort_array(F.array_append("reasons", "deterministic_evidence"))).otherwise(F.col("reasons"))
    n = independent(F.col("reasons"))
    factor = F.when(n <= 1, 0.875).otherwise(1.0)
    score = F.round("score", 3)
    return best.select(edge_id(F.col("source"), F.col("target")).alias("edge_id"), "source", "target", score.alias("score"), "reasons", evidence.alias("evidence"), "validation_source", dimensions(F.col("reasons")).alias("evidence_dimensions"), n.alias("independent_evidence_count"), F.round(F.least(F.lit(1.0), score * factor), 3).alias("evidence_diversity_score"))


def roles(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """(incident_id, risk, in_degree, out_degree, upstream_incidents, downstream_incidents, graph_role, root_cause_score)."""
    out = graph_edges.groupBy(F.col("source").alias("incident_id")).agg(F.count(F.lit(1)).alias("out_degree"), F.sort_array(F.collect_list("target")).alias("downstream_incidents"))
    into = graph_edges.groupBy(F.col("target").alias("incident_id")).agg(F.count(F.lit(1)).alias("in_degree"), F.sort_array(F.collect_list("source")).alias("upstream_incidents"))
    size = graph_nodes.agg(F.count(F.lit(1)).alias("_n")).crossJoin(graph_edges.agg(F.count(F.lit(1)).alias("_e")))  # one row
    rows = graph_nodes.select("incident_id", "risk").join(out, "incident_id", "left").join(into, "incident_id", "left").crossJoin(F.broadcast(size))
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"in_degree": F.coalesce("in_degree", F.lit(0)), "out_degree": F.coalesce("out_degree", F.lit(0)), "upstream_incidents": F.coalesce("upstream_incidents", none), "downstream_incidents": F.coalesce("downstream_incidents", none)})
    root, leads = F.col("in_degree") == 0, F.col("out_degree") > 0
    role = F.when(root & leads, "upstream_root_candidate").when(~root & leads, "intermediate").when(~root, "downstream_symptom").otherwise("isolated")
    score = F.when(root, 0.55).otherwise(0.0) + F.when(leads, 0.25).otherwise(0.0) + 0.10 * F.least(F.lit(1.0), F.col("out_degree") / F.greatest(F.lit(1), F.col("_n") - 1)) + 0.10 * F.least(F.lit(1.0), F.col("risk") / 100.0)
    return rows.withColumns({"graph_role": role, "root_cause_score": F.when(F.col("_e") > 0, F.least(F.lit(1.0), score)).otherwise(0.0)}).drop("_n", "_e")


def root_candidates(roled: DataFrame, most: int = 3) -> DataFrame:
    """Root candidates; in a graph with edges but without roots, those with the highest scores; none without edges."""
    ranked = roled.where((F.col("in_degree") > 0) | (F.col("out_degree") > 0))
    first = F.when(F.col("graph_role") == "upstream_root_candidate", 0).otherwise(1)
    top = ranked.withColumn("_f", first).orderBy("_f", F.col("root_cause_score").desc(), "incident_id").limit(most)
    return top.withColumn("_best", F.min("_f").over(Window.partitionBy(F.lit(1)))).where("_f = _best").drop("_f", "_best")


def summary(graph_nodes: DataFrame, graph_edges: DataFrame) -> DataFrame:
    """One row: counts, confidence and status."""
    e = graph_edges.agg(F.count(F.lit(1)).alias("edge_count"), F.round(F.coalesce(F.avg("evidence_diversity_score"), F.lit(0.0)), 3).alias("graph_confidence"))
    return graph_nodes.agg(F.count(F.lit(1)).alias("node_count")).crossJoin(e).withColumn("root_cause_status", F.when(F.col("edge_count") > 0, "confirmed_by_graph").when(F.col("node_count") > 0, "unconfirmed").otherwise("no_incidents"))
