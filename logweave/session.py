"""Session builder and the durable scratch area that long plans cut their lineage with."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "logweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine's results rely on (UTC, last key wins in maps)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and everything runs on one machine (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="logweave-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Written tables in the shared folder.

    ``keep(df)`` writes a table and reads it back: the lineage is cut, lost executors cost nothing, and
    the optimizer gets real sizes. The tables go when the interpreter ends, or with ``drop``.
    """

    def __init__(self, spark: SparkSession, name: str = "work"):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/logweave-{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        atexit.register(self.drop)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path or self.root)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended already: the folder then goes with the cluster's own cleaning
            pass
