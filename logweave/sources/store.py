"""Incident store and caches: plain Parquet in a folder that Spark reaches."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.sources.text import config_key


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row for each key: that of the latest version."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("_r"))
    return best.select("_r.*")


class IncidentStore:
    """Batches of incidents are appended as they come; readers see the latest row of each id. One writer at a time.

    The store is a folder of versions; the newest complete one counts. `compact` writes the latest rows as the next version, which counts from the moment its success
    marker is there, and only then drops the versions before it: whatever breaks off in between, one whole version is left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = Files(spark, self.path)

    def versions(self) -> list[int]:
        """Complete versions, in order."""
        return sorted(int(n[2:]) for n in self._fs.names() if n.startswith("v=") and self._fs.exists(f"{n}/_SUCCESS"))

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version}"

    def upsert(self, incidents: DataFrame, batch: int | None = None) -> None:
        number = time.time_ns() if batch is None else batch
        incidents.withColumn("batch", F.lit(number).cast("long")).write.mode("append").parquet(self._folder(max(self.versions(), default=0)))

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self._folder(max(self.versions(), default=0)))

    def load_all(self, limit: int | None = None) -> DataFrame:
        rows = latest(self._rows(), "incident_id", "batch").orderBy("start_ts", "incident_id")
        return rows.limit(limit) if limit else rows

    def load_recent(self, limit: int = 5000) -> DataFrame:
        newest = latest(self._rows(), "incident_id", "batch").orderBy(F.col("start_ts").desc(), F.col("incident_id").desc()).limit(limit)
        return newest.orderBy("start_ts", "incident_id")

    def count(self) -> int:
        return self._rows().select("incident_id").distinct().count()

    def clear(self) -> None:
        self._fs.delete("")

    def compact(self) -> None:
        old = self.versions()
        latest(self._rows(), "incident_id", "batch").write.mode("overwrite").parquet(self._folder(max(old) + 1))
        for version in old:
            self._fs.delete(f"v={version}")


class Files:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self._path, self._root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, folder
        self._system = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self._root}/{name}" if name else self._root)

    def exists(self, name: str) -> bool:
        return self._system.exists(self._at(name))

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self._system.listStatus(self._at(""))] if self.exists("") else []

    def delete(self, name: str) -> None:
        self._system.delete(self._at(name), True)


class ValueCache:
    """Small texts by a key that JSON can express (settled headers, mining policies, a judge's answers), each a file of one row; none older than `ttl` seconds counts."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = 7 * 86400):
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl

    def get(self, key: dict) -> str | None:
        name = config_key(key)
        if not Files(self.spark, self.folder).exists(f"{name}/_SUCCESS"):
            return None
        row = self.spark.read.schema("value string, at double").parquet(f"{self.folder}/{name}").first()
        return row["value"] if row and time.time() - row["at"] <= self.ttl else None

    def put(self, key: dict, value: str) -> str:
        self.spark.createDataFrame([(value, time.time())], "value string, at double").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{config_key(key)}")
        return value


class ResultCache:
    """Results by input fingerprint and configuration, for `ttl` seconds after they were last asked for; at most `most` entries, those that were not asked for the longest go."""

    def __init__(self, spark: SparkSession, folder: str, ttl: float = 7 * 86400, most: int = 128):
        self.spark, self.folder, self.ttl, self.most = spark, folder.rstrip("/"), ttl, most

    def path(self, fingerprint: str, config: dict) -> str:
        return f"{self.folder}/{fingerprint[:32]}-{config_key(config)[:32]}"

    def _entries(self) -> list[tuple[float, str]]:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted((f.getModificationTime() / 1000, f.getPath().toString()) for f in fs.listStatus(where)) if fs.exists(where) else []

    def get(self, fingerprint: str, config: dict) -> DataFrame | None:
        name = self.path(fingerprint, config).rsplit("/", 1)[1]
        fresh = [p for at, p in self._entries() if p.endswith(name) and time.time() - at <= self.ttl]
        if not fresh:
            return None
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(fresh[0])
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).setTimes(where, int(time.time() * 1000), -1)
        return self.spark.read.parquet(fresh[0])

    def put(self, fingerprint: str, config: dict, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(fingerprint, config))
        entries = self._entries()
        old = [p for at, p in entries if time.time() - at > self.ttl] + [p for _, p in entries[: max(0, len(entries) - self.most)]]
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for p in set(old):
            hadoop(p).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop(p), True)
        return self.spark.read.parquet(self.path(fingerprint, config))


