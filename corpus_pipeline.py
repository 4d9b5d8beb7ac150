"""The corpus pipeline: documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. Toxic documents go, of near
duplicates one stays, documents that hold benchmark passages go, secrets in texts are replaced by a mark, and what is left becomes token
ids that decode to the text again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import bpe, decontaminate, secrets, simhash, toxicity
from logweave.llm.queries import vocabulary
from logweave.llm.shared import table
from logweave.session import Scratch


def clean_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field scores under 1/2; it learns from the labelled documents that are not held out."""
    return toxicity.remove_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def clean_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose SimHashes differ in at most two bits, or whose sets of five-word shingles are alike by 0.8 or more (Jaccard), the document with the smallest id."""
    return simhash.drop_similar(docs, width=5, similarity=0.8, distance=2)


def clean_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def clean_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced, and n_chars follows."""
    return secrets.redact(docs, secrets.fit(secrets.labelled_findings(spark)), size_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens, ids, and whether the ids decode to the text."""
    coded = bpe.encode(docs, vocabulary("byte_bpe_50k.json"), ids_col="ids", same_col="decodes")
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decodes")


STAGES = [
    ("toxicity", clean_toxic),
    ("near_duplicates", clean_duplicates),
    ("decontamination", clean_benchmark),
    ("secrets", clean_secrets),
    ("bpe", encode),
]

#: SQL can express neither the trained models nor the vocabulary; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
