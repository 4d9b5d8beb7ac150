"""The whole way from log lines to a root-cause context."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from logweave.functions import compact, context, parsing, scoring, signal
from logweave.operators import causal, correlate, segmentation, templates, triage, windows
from logweave.plans.judge import Judge
from logweave.session import Scratch
from logweave.sources import text
from logweave.sources.store import ResultCache, ValueCache


@dataclass
class Settings:
    threshold: int = 50
    count_seconds: int = 60
    window_seconds: int = 300
    window_events: int = 20_000
    states: int = 2000
    representatives: int = 3
    edge_seconds: int = 300
    graph_incidents: int = 5000
    triage_k: int = 18
    triage_tokens: int = 12_000
    similarity: float = 0.5
    depth: int = 4
    lenient_timestamps: bool = False
    tumbling: bool = False
    strict: bool = True
    incident_events: int = 6
    judged_pairs: int = 20


STAGES = ("lines", "events", "canonical", "enriched", "signal", "scored", "actionable", "windowed", "states", "members", "incidents", "edges", "roles", "triage", "rca")


class Engine:
    """Stages by name; each is a DataFrame that is built when asked for. What two stages share is written to the shared folder once.

    judge, edge_judge: decide ambiguous pairs of events and of incidents (`logweave.plans.judge`); without them the scores decide. cache: a `ValueCache` that keeps the
    header which a sample of lines settled on. tune: proposes a mining policy from a preview (see `templates.tune`).
    """

    def __init__(
        self, spark: SparkSession, lines: DataFrame, settings: Settings | None = None, ingest: Column | None = None, header: str | None = None,
        judge: Judge | None = None, edge_judge: Judge | None = None, cache: ValueCache | None = None, tune=None,
    ):
        self.spark, self.lines, self.settings, self.ingest, self.header = spark, lines, settings or Settings(), ingest, header
        self.judge, self.edge_judge, self.cache, self.tune = judge, edge_judge, cache, tune
        self.tuned = {"calls": 0, "cache_hit": False}
        self.scratch = Scratch(spark, "engine")
        self._made: dict[str, DataFrame] = {"lines": lines}
        self._seen: dict[str, Observation] = {}
        self.pairs: DataFrame | None = None

    @classmethod
    def of_path(cls, spark: SparkSession, path: str, settings: Settings | None = None, ingest: Column | None = None, **others) -> Engine:
        return cls(spark, text.read_lines(spark, path), settings, ingest, **others)

    def stage(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = getattr(self, f"_{name}")()
        return self._made[name]

    def debug(self, name: str, n: int = 20) -> DataFrame:
        """The first rows of a stage: in order of file and line, time and id, or id, as far as it has them."""
        rows = self.stage(name)
        order = [c for c in ("file", "line_no", "start_ts", "event_ts", "incident_id", "event_id", "source", "target") if c in rows.columns]
        return (rows.orderBy(*order) if order else rows).limit(n)

    def replayed(self, name: str, results: ResultCache, fingerprint: str) -> DataFrame:
        """A stage from the cache, if it was made before from the input of this fingerprint (`text.file_fingerprint`) and these settings; else made, and kept there."""
        key = asdict(self.settings) | {"stage": name, "header": self.header}
        found = results.get(fingerprint, key)
        return results.put(fingerprint, key, self.stage(name)) if found is None else found

    def _kept(self, rows: DataFrame, name: str, **counts: Column) -> DataFrame:
        """Write a stage; what is counted is observed in the pass that writes it."""
        self._seen[name] = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
        return self.scratch.keep(rows.observe(self._seen[name], *[c.alias(k) for k, c in counts.items()]), name)

    def counters(self) -> DataFrame:
        """One row: how many rows each stage passed on, the fullest window and its states, and what was coarsened or tuned.

        Rows are counted while the stages are written. Only what is counted by window takes a job of its own, over the table of states."""
        for name in ("canonical", "scored", "windowed", "states", "members", "incidents"):
            self.stage(name)
        seen = {k: v for observed in self._seen.values() for k, v in observed.get.items()}
        by_window = self.stage("states").groupBy("window_start").agg(F.sum("event_count").alias("n"), F.count(F.lit(1)).alias("k"))
        rest = by_window.agg(F.count(F.lit(1)).alias("windows_finalized"), F.coalesce(F.max("n"), F.lit(0)).alias("max_active_window_events"), F.coalesce(F.max("k"), F.lit(0)).alias("max_active_incident_states"), F.coalesce(F.sum("n"), F.lit(0)).alias("stream_aggregated_events"))
        return rest.withColumns({k: F.lit(v or 0).cast("long") for k, v in seen.items()}).withColumns({"drain_tuning_calls": F.lit(self.tuned["calls"]), "drain_tuning_cache_hit": F.lit(self.tuned["cache_hit"])})

    def summary(self) -> DataFrame:
        """One row: what the incidents stand for."""
        actionable = self.stage("actionable").agg(F.count(F.lit(1)).alias("actionable_events"))
        found = self.stage("incidents").agg(F.count(F.lit(1)).alias("incident_candidates"), F.count_if(F.col("event_count") > 1).alias("groups_with_multiple_events"), F.coalesce(F.max("event_count"), F.lit(0)).alias("max_incident_event_count"))
        return actionable.crossJoin(found).withColumn("events_collapsed_into_incidents", F.greatest(F.lit(0), F.col("actionable_events") - F.col("incident_candidates")))  # a row each

    def _events(self) -> DataFrame:
        if self.header or self.cache is not None:
            return segmentation.assemble(self.lines, self.header or self._settled())
        found = segmentation.settle(self.lines, strict=self.settings.strict, scratch=self.scratch)
        return segmentation.assemble(self.lines, found.header, found.flagged)

    def _settled(self) -> str:
        key = {"header of": text.content_fingerprint(text.prefix(self.lines), {"strict": self.settings.strict})}
        return self.cache.get(key) or self.cache.put(key, segmentation.settle(self.lines, strict=self.settings.strict).header)

    def _policy(self, events: DataFrame) -> dict:
        """Similarity and depth of mining: the settings', or what `tune` proposes; a tuned policy is kept in the cache."""
        if self.tune is None:
            return {"similarity": self.settings.similarity, "depth": self.settings.depth}
        key = {"policy of": text.content_fingerprint(text.prefix(self.lines), {})}
        known = self.cache.get(key) if self.cache else None
        self.tuned = {"calls": 0 if known else 1, "cache_hit": known is not None}
        if known:
            return json.loads(known)
        policy = templates.tune(events, self.tune)
        if self.cache:
            self.cache.put(key, json.dumps(policy))
        return policy

    def _canonical(self) -> DataFrame:
        self._seen["events"] = Observation(f"events-{uuid.uuid4().hex[:8]}")
        events = self.stage("events").observe(self._seen["events"], F.count(F.lit(1)).alias("raw_blocks"))
        return self._kept(parsing.parse(events, ingest=self.ingest, lenient=self.settings.lenient_timestamps), "canonical", parsed=F.count(F.lit(1)))

    def _enriched(self) -> DataFrame:
        return self.scratch.keep(context.enrich(self.stage("canonical")), "enriched")

    def _signal(self) -> DataFrame:
        events = self.stage("enriched")
        mined = self.scratch.keep(templates.mine(events, **self._policy(events), scratch=self.scratch), "mined")
        counted = windows.trailing_count(mined, "template_id", "event_ts", self.settings.count_seconds)
        return counted.withColumn("entropy", F.round(signal.entropy(F.col("message")), 2)).withColumn("confidence", F.round("confidence", 2))

    def _scored(self) -> DataFrame:
        rows = scoring.score(self.stage("signal"), self.settings.threshold)
        return self._kept(rows, "scored", signaled=F.count(F.lit(1)), filtered_out=F.count_if(~F.col("is_actionable")), actionable=F.count_if("is_actionable"))

    def _actionable(self) -> DataFrame:
        return scoring.actionable(self.stage("scored"))

    def _windowed(self) -> DataFrame:
        rows = self.stage("actionable").withColumn("stream", F.lit("all"))
        if self.settings.tumbling:
            made = windows.tumbling_windows(rows, "event_ts", self.settings.window_seconds)
        else:
            made = windows.anchored_windows(rows, "stream", "event_ts", "event_id", self.settings.window_seconds, self.settings.window_events, self.scratch)
        keyed = windows.state_keys(made.drop("stream"))
        keys = [f"k_{k}" for k in windows.KEY]
        return self._kept(windows.overflow(keyed, keys, most=self.settings.states), "windowed", stream_coarsened_events=F.count_if(F.col("state_key") == "__overflow__"))

    def _states(self) -> DataFrame:
        return self.scratch.keep(windows.states(self.stage("windowed"), ["window_start", "state_key"]), "states")

    def _members(self) -> DataFrame:
        """Representatives of all states with their incident; weight is the number of events that the row stands for."""
        by = ["window_start", "state_key"]
        reps = windows.representatives(self.stage("windowed"), by, most=self.settings.representatives)
        sized = reps.join(self.stage("states").select(*by, "event_count"), by)
        events = self.scratch.keep(sized.withColumn("weight", F.when(F.col("rep") == 1, F.col("event_count") - (F.least(F.col("event_count"), F.lit(self.settings.representatives)) - 1)).otherwise(F.lit(1))).drop("event_count"), "reps")
        found, self.pairs = correlate.incident_members(events, "window_start", self.settings.window_seconds, self.judge, self.scratch)
        return self._kept(correlate.attribute_services(events.join(found, "event_id")), "members", stream_represented_events=F.count(F.lit(1)))

    def _incidents(self) -> DataFrame:
        members = self.stage("members")
        rows = correlate.rollup(members, self.pairs, weight="weight").join(correlate.explicit_trace(members), "incident").join(correlate.representative_events(members, self.settings.incident_events), "incident", "left")
        return self._kept(rows, "incidents", persisted_incidents=F.count(F.lit(1)))

    def _recent(self) -> DataFrame:
        return self.stage("incidents").orderBy(F.col("start_ts").desc(), F.col("incident_id").desc()).limit(self.settings.graph_incidents)

    def _nodes(self) -> DataFrame:
        return self.scratch.keep(causal.nodes(self.stage("recent")), "nodes")

    def _edges(self) -> DataFrame:
        scored = causal.edge_scores(causal.ordered_pairs(self.stage("nodes"), self.settings.edge_seconds), self.settings.edge_seconds)
        judged = causal.judged_edges(scored)
        if self.edge_judge is None:
            return self.scratch.keep(causal.edges(judged), "edges")
        judged = self.scratch.keep(judged, "judged")
        return self.scratch.keep(causal.edges(judged, causal.asked(judged, self.edge_judge, self.settings.judged_pairs)), "edges")

    def _roles(self) -> DataFrame:
        return causal.roles(self.stage("nodes"), self.stage("edges"))

    def _compacted(self) -> DataFrame:
        return self.scratch.keep(triage.compact_incidents(self.stage("recent"), self.stage("members")), "compacted")

    def _triage(self) -> DataFrame:
        return triage.triage(self.stage("compacted"), self.settings.triage_k, self.settings.triage_tokens, self.settings.graph_incidents)

    def _rca(self) -> DataFrame:
        roots = causal.root_candidates(self.stage("roles"))
        anchors = triage.anchors(self.stage("recent"), roots, self.stage("edges"), self.stage("triage"))
        return triage.rca_payload(anchors, self.stage("compacted"), self.stage("edges"), roots, causal.summary(self.stage("nodes"), self.stage("edges")), self.stage("roles"))


def compact_events(engine: Engine) -> DataFrame:
    """The actionable events as incident stages carry them."""
    return compact.compact(engine.stage("actionable"))
