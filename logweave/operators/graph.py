"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node that has an edge to another node; root is one fixed node of the component.

    Contraction: each node points at its least neighbour, pointers are doubled until they are stable, edges are
    rewritten to the roots and made distinct; this repeats until no edge is left. Every step is a partial
    aggregation or a join whose one side is unique on the key, so that a component with a third of all nodes is only
    a skewed join side, which adaptive execution splits. Nodes are compared in the order of their hash: this
    keeps pointer chains short on paths of ascending ids. Self loops and null ends are no edges.
    """
    a, b = F.col(src), F.col(dst)
    key = lambda c: F.struct(F.xxhash64(c).alias("h"), c.alias("v"))
    live = scratch.keep(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        up = scratch.keep(near.select(F.col("a").alias("node"), F.least(key(F.col("a")), F.col("m"))["v"].alias("up")), "up")
        while True:
            hop = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            jumped = scratch.keep(up.join(hop, "up", "left").select("node", F.coalesce("far", "up").alias("up"), (F.col("far") != F.col("up")).alias("moved")), "jump")
            up = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        ends = live.join(up.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
        live = scratch.keep(ends.where("ra != rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            labels = scratch.keep(labels.join(up.select(F.col("node").alias("root"), F.col("up").alias("above")), "root", "left").select("node", F.coalesce("above", "root").alias("root")), "labels")
    else:
        raise RuntimeError("components did not settle")
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
