"""The current rows of a stream's keys as a table of few files, however many batches have run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import file_system


class CurrentTable:
    """Newest row of every key: a base with all keys, and the changes of the batches since.

    `upsert` writes one batch's changes under the batch's number, so a repeated batch
    replaces itself; every `compact_every` batches they are folded into a new base. A
    folder counts once it is wholly written (its _SUCCESS file). Folders that the base
    before the newest has made needless are removed, so a reader that has just listed
    the table can still read it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], compact_every: int = 8):
        self.spark, self.path, self.keys, self.compact_every = spark, path.rstrip("/"), keys, compact_every

    def _written(self) -> tuple[list[int], list[int]]:
        """Numbers of the finished bases and of the finished changes, ascending."""
        files = file_system(self.spark, self.path)
        if not files.exists(self.path):
            return [], []
        done = [n for n in files.names(self.path) if files.exists(f"{self.path}/{n}/_SUCCESS")]
        return tuple(sorted(int(n.split("-")[1]) for n in done if n.startswith(kind)) for kind in ("base-", "change-"))

    def upsert(self, changes: DataFrame, epoch: int) -> None:
        """The batch's rows, one per key, replace older rows of their keys."""
        changes.write.mode("overwrite").parquet(f"{self.path}/change-{epoch}")
        bases, written = self._written()
        if len([n for n in written if not bases or n > bases[-1]]) >= self.compact_every:
            self.replace(self.read(), epoch)

    def replace(self, rows: DataFrame, epoch: int) -> None:
        """The table is `rows` from now on."""
        rows.write.mode("overwrite").parquet(f"{self.path}/base-{epoch}")
        bases, changes = self._written()
        if len(bases) > 1:
            before = bases[-2]
            files = file_system(self.spark, self.path)
            for name in [f"base-{n}" for n in bases if n < before] + [f"change-{n}" for n in changes if n <= before]:
                files.remove(f"{self.path}/{name}")

    def read(self) -> DataFrame | None:
        """The newest row of every key; None before the first batch."""
        bases, changes = self._written()
        base = bases[-1] if bases else -1
        parts = ([(base, f"base-{base}")] if bases else []) + [(n, f"change-{n}") for n in changes if n > base]
        if not parts:
            return None
        rows = None
        for n, name in parts:
            part = self.spark.read.parquet(f"{self.path}/{name}").withColumn("_n", F.lit(n))
            rows = part if rows is None else rows.unionByName(part)
        if len(parts) == 1:
            return rows.drop("_n")
        others = [c for c in rows.columns if c not in [*self.keys, "_n"]]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_n").alias("_row"))
        return newest.select(*self.keys, "_row.*")
