"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20  # largest side sent to every executor


def build_session(app: str = "faultline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs more than building a wide plan itself
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """All times are UTC; a shared checkpoint folder must be known."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="faultline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a table to the shared folder so lost executors cost one read."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def sized_side(df: DataFrame) -> DataFrame:
    """An aggregate about to be joined to a far larger table: counted first, broadcast only if small.

    It is written once, so the count is of the rows that are joined. A side
    beyond the bound stays a shuffled join, which adaptive execution splits
    where a key is hot. Meant for sides of numbers and short names.
    """
    table = cut_lineage(df)
    row_bytes = 64 * len(df.columns)
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class FileSystem:
    """The few questions about folders that a table's rows do not answer, for any store Spark can write to."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._files.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._files.listStatus(self._path(path))]

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def file_system(spark: SparkSession, path: str) -> FileSystem:
    return FileSystem(spark, path)
