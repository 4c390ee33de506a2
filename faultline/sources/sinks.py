"""Writers. Each writes from the executors; documents are rows of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import file_system


def write_run_parquet(df: DataFrame, path: str) -> None:
    """One partition folder per run; only the runs in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def write_logs_jsonl(logs: DataFrame, path: str) -> None:
    """One object per event with its labels nested."""
    logs.select("run_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("ts"),
                "service", "level", "message", "line", "labels").write.mode("overwrite").json(path)


def rca_documents(ranked: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per incident with its candidates nested in rank order (at most top-k of them)."""
    fields = ["service", "score", "magnitude", "centrality", "earliness"]
    docs = ranked.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("_c"))
    docs = docs.withColumn("candidates", F.transform("_c", lambda c: F.struct(*[c[f].alias(f) for f in fields])))
    return summary.join(docs, "incident_id").select("incident_id", "run_id", "n_alerts", "candidates")


def write_rca_json(ranked: DataFrame, summary: DataFrame, path: str) -> None:
    docs = rca_documents(ranked, summary)
    docs.withColumn("incident", F.col("incident_id")).write.mode("overwrite").partitionBy("incident").json(path)


def graph_documents(edges: DataFrame, window_seconds: int, kind: str = "cooccurrence_baseline", edges_per_document: int = 100_000) -> DataFrame:
    """The service graph as documents of at most `edges_per_document` edges, by ranges of (src, dst)."""
    ranged = edges.select("src", "dst", "weight").repartitionByRange("src", "dst").sortWithinPartitions("src", "dst")
    # ids count from 0 in each partition, whose number is in the bits above
    numbered = ranged.withColumn("_id", F.monotonically_increasing_id())
    place = {"_part": F.shiftright("_id", 33), "_chunk": F.expr(f"(_id & {2**33 - 1}) div {edges_per_document}")}
    packed = numbered.withColumns(place).groupBy("_part", "_chunk").agg(F.array_sort(F.collect_list(F.struct("src", "dst", "weight"))).alias("edges"))
    return packed.select("edges", F.lit(kind).alias("type"), F.lit(window_seconds).cast("long").alias("window_seconds"))


GRAPH_MANIFEST = "_manifest"


def write_graph_json(edges: DataFrame, window_seconds: int, folder: str, suffix: str, edges_per_document: int = 100_000) -> str:
    """A folder of edge documents, one a line, and a manifest, written last, with their number and that of the edges.

    `suffix` is the run's id, or `multi` for several runs.
    """
    spark = edges.sparkSession
    path = f"{folder}/service_graph_{suffix}.json"
    graph_documents(edges, window_seconds, edges_per_document=edges_per_document).write.mode("overwrite").json(path)
    written = spark.read.schema("edges ARRAY<STRUCT<src: STRING>>").json(path)
    written.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.size("edges")), F.lit(0)).cast("long").alias("edges")).write.mode("overwrite").json(f"{path}/{GRAPH_MANIFEST}")
    return path


def append_labels(labels: DataFrame, path: str) -> int:
    """Appends a numbered batch of labels and returns its number; every file carries its header.

    The numbers, not the files' times, tell the order, so a copied folder reads as it was
    written. Of two appends at once, one fails and can be repeated.
    """
    files = file_system(labels.sparkSession, path)
    batch = 0
    if files.exists(path):
        batch = max([int(n.split("=")[1]) for n in files.names(path) if n.startswith("batch=")], default=-1) + 1
    out = labels.select("run_id", "service", "fault_type", *[
        F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias(c) for c in ("start_ts", "end_ts")])
    out.write.mode("errorifexists").option("header", True).csv(f"{path}/batch={batch}")
    return batch


def write_csv_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
