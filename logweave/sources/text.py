"""Log text as rows (file, line_no, line) with a total order, samples, and fingerprints."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files. line_no orders the lines of a file: it is the row index of a split plus the lines of the splits before it.

    Files are read as splittable text; bytes that are no UTF-8 become U+FFFD, which is dropped. The count of lines by split (one small row each)
    makes the offsets, so no file passes through one task.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value"), F.monotonically_increasing_id().alias("id"))
    counts = raw.groupBy("file", "at").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("file", "at", "first", "ahead")
    line = F.regexp_replace(F.translate("value", "�", ""), "\r$", "")
    return raw.join(offsets, ["file", "at"]).select("file", (F.col("id") - F.col("first") + F.col("ahead")).alias("line_no"), line.alias("line"))


def split_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(file, line_no, line) of texts in a column; the id names the file."""
    lines = docs.select(F.col(id_col).cast("string").alias("file"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("line_no", "line"))
    return lines.withColumns({"line_no": F.col("line_no").cast("long"), "line": F.regexp_replace("line", "\r$", "")})


def stratified(lines: DataFrame, strata: int = 10, each: int = 15) -> DataFrame:
    """The first `each` lines of each of `strata` equal stretches of every file; the first line of a later stretch, which may be partial, is left out."""
    ends = lines.groupBy("file").agg(F.max("line_no").alias("_last"))
    rows = lines.join(ends, "file").withColumn("_stretch", F.floor(F.col("line_no") * strata / (F.col("_last") + 1)).cast("int"))
    n = F.row_number().over(Window.partitionBy("file", "_stretch").orderBy("line_no"))
    skip = F.when(F.col("_stretch") > 0, 1).otherwise(0)
    return rows.withColumn("_n", n).where((F.col("_n") > skip) & (F.col("_n") <= skip + each)).select("file", F.col("_stretch").alias("stretch"), "line_no", "line")


def prefix(rows: DataFrame, n: int = 250, *order: str) -> DataFrame:
    """The first n rows in order."""
    return rows.orderBy(*(order or ("file", "line_no"))).limit(n)


def file_fingerprint(spark: SparkSession, path: str, ends: int = 1 << 20) -> str:
    """SHA-256 of names, sizes and contents' ends of the files under a path; moving a file or touching it changes nothing.

    Only `ends` bytes at the beginning and at the end of a file are read, at their places, whatever its size; they are hashed in the JVM.
    """
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, listed = [], system.listFiles(where, True)
    while listed.hasNext():
        status = listed.next()
        name, size = status.getPath().getName(), status.getLen()
        if name.startswith((".", "_")):
            continue
        stream, digests = system.open(status.getPath()), []
        for at in (0, max(0, size - ends)):
            stream.seek(at)
            digests.append(jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream.readNBytes(min(ends, size))))
        stream.close()
        found.append(hashlib.sha256(f"{name}|{size}|{'|'.join(digests)}".encode()).hexdigest())
    return hashlib.sha256("|".join(sorted(found)).encode()).hexdigest()


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def content_fingerprint(sample: DataFrame, policy: dict, version: str = "1", most: int = 500) -> str:
    """32 hex digits from a sample's lines (at most `most`), the policy and the version."""
    lines = [r["line"] for r in sample.orderBy("file", "line_no").limit(most).collect()]
    return hashlib.sha256("\n".join([version, config_key(policy), *lines]).encode()).hexdigest()[:32]
