"""Online template mining (Drain, He et al. 2017), parallel by leaf of the tree.

The tree's first level is the number of tokens, the next ones are leading tokens; clusters never cross leaves. Which leaf a message goes to is found for all messages at once: a
node takes its first CHILDREN different keys in the order of their first arrival, all others share its wildcard. Equal prepared messages are counted before mining: a leaf's
size is the number of its different messages. The order of arrival inside a leaf decides; it is the first arrival of each message.

A leaf of more than SPLIT different messages is cut into shards by their hash. Each is mined on its own, and the shards' clusters, which carry all that mining knows, are merged FAN shards at a time. Such a leaf's templates can
differ from those of one tree where the order of arrival decided; shards agree with it where messages of a template are more alike than `similarity` and those of two templates less.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweave.functions.signal import confidence, prepared, template_id, unprotect
from logweave.session import Scratch
from logweave.sources.store import Files

WILD = "<*>"
CHILDREN = 100
SPLIT, FAN = 20_000, 8


class Miner:
    """One tree: depth levels in all, of which the first is the token count and depth - 2 are leading tokens. Once there are `most` clusters, a message opens none
    where its leaf has one."""

    def __init__(self, similarity: float = 0.5, depth: int = 4, children: int = CHILDREN, most: int | None = None):
        self.most, self.size = most, 0
        self.similarity, self.levels, self.children = min(0.95, max(0.10, similarity)), min(10, max(2, depth)) - 2, children
        self.root: dict = {}

    def leaf(self, tokens: list[str]) -> list[list]:
        node = self.root.setdefault(len(tokens), {})
        for token in tokens[: self.levels]:
            key = WILD if any(c.isdecimal() for c in token) else token
            if key not in node and len(node) >= self.children:
                key = WILD
            node = node.setdefault(key, {})
        return node.setdefault(None, [])

    def add(self, tokens: list[str], times: int = 1) -> list:
        """The cluster [template tokens, size] that the message joins or opens."""
        best, best_rank = None, (-1.0, -1)
        for cluster in (clusters := self.leaf(tokens)):
            same = sum(a == b and a != WILD for a, b in zip(cluster[0], tokens, strict=True))
            rank = (same / max(1, len(tokens)), sum(a == WILD for a in cluster[0]))
            if rank > best_rank:
                best, best_rank = cluster, rank
        if best is None or best_rank[0] < self.similarity and tokens and (self.most is None or self.size < self.most):
            best = [list(tokens), 0]
            clusters.append(best)
            self.size += 1
        best[0] = [a if a == b else WILD for a, b in zip(best[0], tokens, strict=True)]
        best[1] += times
        return best


def mine(events: DataFrame, message: str = "message", attributes: str | None = "attributes", order: tuple[str, ...] = ("event_ts", "event_id"), similarity: float = 0.5, depth: int = 4, children: int = CHILDREN, split: int = SPLIT, scratch: Scratch | None = None) -> DataFrame:
    """events with template, template_id, cluster_size and confidence. Every event gets its message's template after all messages of its kind have been
    seen, and the final size of the cluster. The table of different messages is written once for each level of the tree, so that the plan grows with the depth alone."""
    scratch = scratch or Scratch(events.sparkSession, "templates")
    rows = events.withColumn("_text", prepared(F.col(message), F.col(attributes) if attributes else None))
    distinct = rows.groupBy("_text").agg(F.min(F.struct(*order)).alias("_first"), F.count(F.lit(1)).alias("_times")).withColumn("_tokens", F.filter(F.split("_text", " "), lambda t: t != "")).withColumn("_n", F.size("_tokens"))
    distinct, path = scratch.keep(distinct, "messages"), ["_n"]
    for level in range(min(10, max(2, depth)) - 2):  # the leaf, one level after the other
        token = F.get("_tokens", F.lit(level))
        distinct = distinct.withColumn("_key", F.when(token.rlike(r"\p{Nd}"), WILD).otherwise(token))
        met = distinct.groupBy(*path, "_key").agg(F.min(F.struct("_first", "_text")).alias("_met"))
        late = met.withColumn("_nth", F.row_number().over(Window.partitionBy(*path).orderBy("_met"))).where(F.col("_nth") > children).select(*path, "_key", F.lit(True).alias("_late"))
        distinct = scratch.keep(distinct.join(late, [*path, "_key"], "left").withColumn(f"_key{level}", F.coalesce(F.when(F.col("_late"), WILD).otherwise(F.col("_key")), F.lit(""))).drop("_late", "_key"), "level")
        path.append(f"_key{level}")
    mined = _mined(distinct, path, similarity, split, scratch).withColumn("template", unprotect(F.col("template")))
    out = rows.join(mined, "_text").drop("_text")
    return out.withColumns({"template_id": template_id(F.col("template")), "confidence": confidence(F.col("template"), F.col("cluster_size"))})


def _mined(distinct: DataFrame, path: list[str], similarity: float, split: int, scratch: Scratch) -> DataFrame:
    """(_text, template, cluster_size) of messages (path, _text, _tokens, _times, _first). A leaf of more than `split` messages is mined in shards, whose clusters are merged."""
    shards = distinct.groupBy(*path).agg(F.ceil(F.count(F.lit(1)) / split).cast("int").alias("_shards"))
    most = shards.agg(F.max("_shards")).first()[0] or 1
    distinct = distinct.join(shards, path).withColumn("_shard", F.pmod(F.xxhash64("_text"), F.col("_shards")).cast("int"))
    distinct = distinct.withColumn("_rank", F.row_number().over(Window.partitionBy(*path, "_shard").orderBy("_first", "_text")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        miner = Miner(similarity, 2)  # all of one leaf
        pdf = pdf.sort_values("_rank")
        found = [miner.add(list(tokens), int(times)) for tokens, times in zip(pdf["_tokens"], pdf["_times"], strict=True)]
        number: dict[int, int] = {}
        numbers = [number.setdefault(id(c), len(number)) for c in found]
        return pdf[[*path, "_shard", "_text"]].assign(_no=numbers, template=[" ".join(c[0]) for c in found], cluster_size=[c[1] for c in found])

    kinds = {f.name: f.dataType.simpleString() for f in distinct.schema}
    named = ", ".join(f"`{c}` {kinds[c]}" for c in path)
    mined = distinct.groupBy(*path, "_shard").applyInPandas(run, f"{named}, _shard int, _text string, _no int, template string, cluster_size long")
    if most == 1:
        return mined.select("_text", "template", "cluster_size")
    mined = scratch.keep(mined.join(distinct.select("_text", "_first"), "_text"), "shards")
    at = [*path, "_shard", "_no"]
    clusters = mined.groupBy(*at).agg(F.first("template").alias("template"), F.first("cluster_size").alias("cluster_size"), F.min("_first").alias("_first"))
    names = mined.select("_text", *at)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = Merger(similarity)
        pdf = pdf.sort_values("_rank")
        found = [merged.add(template.split(" "), int(size)) for template, size in zip(pdf["template"], pdf["cluster_size"], strict=True)]
        return pdf[at].assign(_new=found, template=[" ".join(merged.clusters[k][0]) for k in found], cluster_size=[merged.clusters[k][1] for k in found])

    while most > 1:  # FAN shards of a leaf become one
        group = [*path, F.floor(F.col("_shard") / FAN).cast("int").alias("_up")]
        ranked = clusters.select(*clusters.columns, group[-1]).withColumn("_rank", F.row_number().over(Window.partitionBy(*path, "_up").orderBy("_first", "_shard", "_no")))
        ranked = scratch.keep(ranked, "clusters")
        made = ranked.groupBy(*path, "_up").applyInPandas(merge, f"{named}, _shard int, _no int, _new int, template string, cluster_size long")
        made = scratch.keep(made.join(ranked.select(*at, "_first", "_up"), at), "merged")
        names = names.join(made.select(*at, "_up", "_new"), at).select("_text", *path, F.col("_up").alias("_shard"), F.col("_new").alias("_no"))
        clusters = made.groupBy(*path, F.col("_up").alias("_shard"), F.col("_new").alias("_no")).agg(F.first("template").alias("template"), F.first("cluster_size").alias("cluster_size"), F.min("_first").alias("_first"))
        most = -(-most // FAN)
    return names.join(clusters, at).select("_text", "template", "cluster_size")


class Merger:
    """Clusters of one leaf out of clusters that were mined apart, in the order of their first messages. A cluster joins the first of those that agree with it in the most places, if they agree in
    a share of `similarity`; wildcards agree with wildcards. What is merged differs in all other places, which become wildcards."""

    def __init__(self, similarity: float):
        self.similarity, self.clusters = min(0.95, max(0.10, similarity)), []

    def add(self, tokens: list[str], size: int) -> int:
        best, most = None, -1
        for k, (other, _) in enumerate(self.clusters):
            same = sum(a == b for a, b in zip(other, tokens, strict=True))
            if same > most:
                best, most = k, same
        if best is None or most < self.similarity * len(tokens):
            self.clusters.append([list(tokens), size])
            return len(self.clusters) - 1
        cluster = self.clusters[best]
        cluster[0] = [a if a == b else WILD for a, b in zip(cluster[0], tokens, strict=True)]
        cluster[1] += size
        return best


class TemplateStore:
    """Templates with ids that stay, in a folder of versions. `absorb` merges the templates of a batch into those of the last version: a template that is like a known one
    makes that more general and takes its id, others get an id of their own."""

    def __init__(self, spark: SparkSession, path: str, similarity: float = 0.5, levels: int = 2):  # levels: leading tokens that choose the leaf, depth - 2
        self.spark, self.path, self.similarity, self.levels = spark, path.rstrip("/"), similarity, levels
        self._files = Files(spark, self.path)

    def version(self) -> int:
        """The newest complete version, 0 without any."""
        return max((int(n[2:]) for n in self._files.names() if n.startswith("v=") and self._files.exists(f"{n}/_SUCCESS")), default=0)

    def templates(self, version: int | None = None) -> DataFrame:
        """(stable_id, template, cluster_size) of a version."""
        at = self.version() if version is None else version
        if not at:
            return self.spark.createDataFrame([], "stable_id string, template string, cluster_size long")
        return self.spark.read.parquet(f"{self.path}/v={at}").where("is_current").select("stable_id", "template", "cluster_size")

    def names(self, version: int | None = None) -> DataFrame:
        """(template, stable_id) of the templates that a version's batch had."""
        return self.spark.read.parquet(f"{self.path}/v={self.version() if version is None else version}").where("not is_current").select("template", "stable_id")

    def absorb(self, mined: DataFrame) -> DataFrame:
        """mined (template, cluster_size, ...) with stable_id; writes the next version."""
        at, similarity = self.version(), self.similarity
        batch = mined.groupBy("template").agg(F.max("cluster_size").alias("cluster_size")).select(F.lit(None).cast("string").alias("stable_id"), "template", "cluster_size")
        tokens = F.split("template", " ")
        key = lambda t: F.when(t.rlike(r"\p{Nd}") | t.rlike("^<.*>$"), WILD).otherwise(t)
        both = self.templates(at).unionByName(batch).withColumn("leaf", F.concat_ws(" ", F.size(tokens).cast("string"), *[F.coalesce(key(F.get(tokens, F.lit(k))), F.lit("")) for k in range(self.levels)]))
        both = both.withColumn("id", F.coalesce("stable_id", template_id(F.col("template"))))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            known, new = pdf[pdf["stable_id"].notna()].sort_values("stable_id"), pdf[pdf["stable_id"].isna()].sort_values(["cluster_size", "template"], ascending=[False, True])
            merged, ids, out = Merger(similarity), [], []
            for template, size, name in zip(known["template"], known["cluster_size"], known["id"], strict=True):
                merged.clusters.append([template.split(" "), int(size)])
                ids.append(name)
            for template, size, name in zip(new["template"], new["cluster_size"], new["id"], strict=True):
                k = merged.add(template.split(" "), int(size))
                if k == len(ids):
                    ids.append(name)
                out.append((ids[k], template, int(size), False))
            out += [(i, " ".join(c[0]), c[1], True) for i, c in zip(ids, merged.clusters, strict=True)]
            return pd.DataFrame(out, columns=["stable_id", "template", "cluster_size", "is_current"])

        both.groupBy("leaf").applyInPandas(run, "stable_id string, template string, cluster_size long, is_current boolean").write.mode("overwrite").parquet(f"{self.path}/v={at + 1}")
        return mined.join(self.names(at + 1), "template")


def preview(events: DataFrame, most: int = 500, top: int = 12, **options) -> DataFrame:
    """(template, size, share, wildcard_ratio) of the largest templates of the first messages: what a policy is judged by."""
    first = events.orderBy("event_ts", "event_id").limit(most)
    sized = mine(first, **options).groupBy("template").agg(F.count(F.lit(1)).alias("size"))
    total = sized.agg(F.sum("size").alias("_all"))
    words = F.size(F.split("template", " "))
    wild = F.size(F.filter(F.split("template", " "), lambda w: w.rlike("^<.*>$")))
    return sized.crossJoin(total).select("template", "size", (F.col("size") / F.col("_all")).alias("share"), (wild / words).alias("wildcard_ratio")).orderBy(F.col("size").desc(), "template").limit(top)


def grid(events: DataFrame, most: int = 2000, similarities: tuple[float, ...] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8), depths: tuple[int, ...] = (2, 3, 4, 5, 6)) -> DataFrame:
    """(similarity, depth, templates, cost) for each setting, mined from the first `most` messages, all settings in one pass.

    cost: the words that templates and messages take when each template is written once and each message as its wildcards' values. Too coarse templates pay with values, too fine ones with templates."""
    first = events.orderBy("event_ts", "event_id").limit(most).select(prepared(F.col("message"), F.col("attributes") if "attributes" in events.columns else None).alias("text"), F.struct("event_ts", "event_id").alias("at"))
    ordered = first.withColumn("n", F.row_number().over(Window.orderBy("at"))).drop("at")  # `most` rows
    settings = F.array(*[F.struct(F.lit(s).alias("similarity"), F.lit(d).alias("depth")) for s in similarities for d in depths])
    each = ordered.select("text", "n", F.explode(settings).alias("s")).select("text", "n", "s.similarity", "s.depth")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        miner = Miner(float(pdf["similarity"].iloc[0]), int(pdf["depth"].iloc[0]))
        clusters = {id(c): c for c in (miner.add([t for t in text.split(" ") if t]) for text in pdf["text"])}.values()
        cost = sum(len(tokens) + size * sum(t == WILD for t in tokens) for tokens, size in clusters)
        return pdf[["similarity", "depth"]].head(1).assign(templates=len(clusters), cost=cost)

    return each.groupBy("similarity", "depth").applyInPandas(run, "similarity double, depth int, templates long, cost long")


def search(events: DataFrame, **options) -> dict:
    """The setting of the least cost in the grid; the default one among equals, then the smaller similarity and depth."""
    rows = grid(events, **options).collect()  # a row for each setting
    best = min(rows, key=lambda r: (r["cost"], (r["similarity"], r["depth"]) != (0.5, 4), r["similarity"], r["depth"]), default=None)
    return {"similarity": best["similarity"], "depth": best["depth"]} if best else {"similarity": 0.5, "depth": 4}


def tune(events: DataFrame, propose=None, rounds: int = 3, least: int = 50) -> dict:
    """Similarity and depth for these messages: defaults, unless there are `least` messages and a judge proposes others from the preview, or `propose` is "search"."""
    policy = {"similarity": 0.5, "depth": 4}
    if propose is None or events.limit(least).count() < least:
        return policy
    if propose == "search":
        return search(events)
    for _ in range(rounds):
        wanted = propose(policy, [r.asDict() for r in preview(events, **policy).collect()])
        if not wanted:
            break
        policy = {"similarity": min(0.95, max(0.10, float(wanted.get("similarity", policy["similarity"])))), "depth": min(10, max(2, int(wanted.get("depth", policy["depth"]))))}
    return policy
