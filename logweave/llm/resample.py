"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k (Xie et al. 2023).

Features of a text: its words and pairs of words (runs of letters, digits and apostrophes, or single other signs, lower-cased),
hashed into BUCKETS buckets. Target model: bucket frequencies over documents labelled good; raw model: over all documents.
A document's log weight is the sum over its features of the log ratio of the two models; `score` is its mean by
feature. Its key is the log weight plus Gumbel noise drawn from a hash of the id, the text and the seed, so every run and every retry draws the same; the k
largest keys are a sample without replacement in proportion to the weights, and are marked as selected.

k: as a number, or by default the number of documents times the share of good ones among the labels. The k-th largest key is found by counting keys in
ever finer ranges, each count a partial aggregation; ties at the k-th key are settled by the id, then by the text's hash.

Bounds: the target model is fitted on at most TARGET labelled documents (those with the least hash of their id), whole texts; the two
models have BUCKETS numbers each. Everything else covers all rows.

Cases: a null or empty text has no features: weight 0. Null ids and repeated rows take part; rows alike in id and text share a key, and of those at the
k-th key all or as many as fit by order are selected. Labels that are null are not used; without a good label both models
are the raw one and all weights are 0. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.llm.shared import Numbers, slices
from logweave.session import Scratch

BUCKETS = 10_000
TARGET = 50_000
KNOWN = 400_000
FEATURE = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]|_")


class Hashed:
    """Bucket numbers of the features of texts."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.forget()

    def forget(self) -> None:
        self.index, self.hashes = Numbers(), np.zeros(0, np.uint64)

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all features, text of each): words first, then pairs."""
        if len(self.index) > KNOWN:
            self.forget()
        docs = [FEATURE.findall(t.lower()) if t else [] for t in texts]
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        known = len(self.index)
        place = np.fromiter((k for d in docs for k in map(self.index.__getitem__, d)), np.int64, int(sizes.sum()))
        if len(self.index) > known:
            self.hashes = np.concatenate([self.hashes, np.fromiter((zlib.crc32(w.encode()) for w in list(self.index)[known:]), np.uint64)])
        one = self.hashes[place]
        owner = np.repeat(np.arange(len(docs)), sizes)
        same = owner[:-1] == owner[1:]
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[same] >> np.uint64(20)
        return np.concatenate([one % self.buckets, two % self.buckets]).astype(np.int64), np.concatenate([owner, owner[:-1][same]])


def totals(docs: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all texts (column text): `buckets` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, total = Hashed(buckets), np.zeros(buckets, np.int64)
        for batch in slices(batches, "text", 8 << 20, 4096):
            total += np.bincount(hashed.features(batch.column("text").to_pylist())[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def log_ratio(target: np.ndarray, raw: np.ndarray, add: float = 1.0) -> np.ndarray:
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + add) / (target + add).sum()) - np.log((raw + add) / (raw + add).sum())


def weigh(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7, buckets: int = BUCKETS, target: int = TARGET) -> DataFrame:
    """(doc_id, n_features, log_weight, score, key, tie) of each row."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    good = labels.where((F.col(label_col) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(target)
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratio(totals(rows.join(F.broadcast(good), "doc_id", "left_semi"), buckets), totals(rows, buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(buckets)
        for batch in slices(batches, "text", 8 << 20, 4096):
            found, owner = hashed.features(batch.column("text").to_pylist())
            n = np.bincount(owner, minlength=batch.num_rows)
            weight = np.bincount(owner, weights=ratio.value[found], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(n.astype(np.int64)), pa.array(weight)], ["doc_id", "tie", "n_features", "log_weight"])

    kind = dict(rows.dtypes)["doc_id"]
    weighed = rows.withColumn("tie", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))).mapInArrow(run, f"doc_id {kind}, tie long, n_features long, log_weight double")
    uniform = (F.shiftrightunsigned("tie", 11).cast("double") + 0.5) / float(1 << 53)
    return weighed.select("doc_id", "n_features", "log_weight", (F.col("log_weight") / F.greatest(F.lit(1), "n_features")).alias("score"), (F.col("log_weight") - F.log(-F.log(uniform))).alias("key"), "tie")


def kth_largest(rows: DataFrame, key: str, k: int, parts: int = 4096) -> float:
    """The k-th largest value of a double column without nulls or NaN, by counting in ever finer ranges of its ordered bits."""
    first = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    low, high = first["low"], first["high"]
    above = 0
    while True:
        inside = rows.where((F.col(key) >= F.lit(low)) & (F.col(key) <= F.lit(high)))
        width = (high - low) / parts
        if width <= 0 or low + width == low:
            ordered = [(r[key], r["n"]) for r in inside.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col(key).desc()).limit(parts).collect()]
            for value, n in ordered:
                above += n
                if above >= k:
                    return value
            return ordered[-1][0]
        part = F.least(F.lit(parts - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"))
        counted = inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.col("part").desc()).collect()  # at most `parts` rows
        for r in counted:
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["low"] == r["high"] or above + r["n"] == k:
            return r["low"]
        low, high = r["low"], r["high"]


def select(weighed: DataFrame, k: int) -> DataFrame:
    """weighed with `selected`: whether the key is among the k largest."""
    if k <= 0:
        return weighed.withColumn("selected", F.lit(False))
    edge = kth_largest(weighed, "key", k)
    sure = weighed.where(F.col("key") > edge).count()
    at = weighed.where(F.col("key") == edge).groupBy("doc_id", "tie").agg(F.count(F.lit(1)).alias("n"))  # what shares the k-th key; rows alike in id and text are one
    at = at.withColumn("nth", F.sum("n").over(Window.orderBy(F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(Window.unboundedPreceding, 0)))
    last = at.where(F.col("nth") >= k - sure).orderBy("nth").first()
    above = F.col("key") > edge
    if last is None:
        return weighed.withColumn("selected", F.col("key") >= edge)
    before = lambda c: F.coalesce(c, F.lit(False))
    if last["doc_id"] is None:
        within = F.col("doc_id").isNotNull() | (F.col("tie") <= last["tie"])
    else:
        within = before(F.col("doc_id") < last["doc_id"]) | before((F.col("doc_id") == last["doc_id"]) & (F.col("tie") <= last["tie"]))
    return weighed.withColumn("selected", above | ((F.col("key") == edge) & within))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 7) -> DataFrame:
    """(doc_id, n_features, log_weight, score, key, selected) of each row."""
    scratch = Scratch(docs.sparkSession, "resample")
    weighed = scratch.keep(weigh(docs, labels, id_col, text_col, label_col, seed), "weights")
    if k is None:
        share = labels.agg(F.avg((F.col(label_col) > 0).cast("double")).alias("s")).first()["s"]
        k = round(weighed.count() * (1.0 if share is None else share))
    return select(weighed, k).drop("tie")

