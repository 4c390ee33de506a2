"""TF-IDF over log text: whole texts, counted as tokens, never concatenated."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import from_micros, micros
from faultline.operators.intervals import MINUTE, RUN_SERVICE
from faultline.operators.ordering import positions
from faultline.session import cut_lineage, sized_side

# Fixed value: a token is two or more word characters of any script.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def vocabulary(docs: DataFrame, text: str = "text", size: int = 50) -> DataFrame:
    """The `size` most frequent terms (ties alphabetical), numbered alphabetically: at most `size` rows."""
    top = (docs.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term")
           .agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), "term").limit(size))
    packed = top.agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return packed.select(F.posexplode("terms").alias("idx", "term"))


CANDIDATES = 128  # terms counted exactly for each 50 of the vocabulary
TRACKED = 10_000  # terms a task's summary keeps


def heavy_terms(docs: DataFrame, text: str = "text", size: int = 50, tracked: int = TRACKED) -> tuple[list[str], float]:
    """Likely most frequent terms, and a count that no other term exceeds.

    Every task keeps a frequent-items summary of `tracked` terms and the summaries are
    merged, so what is exchanged does not grow with the distinct terms. A summary's
    estimate is never below the true count and at most 3.5 / slots of all tokens above it;
    terms it does not report count no more than twice that, or than the last reported one.
    """
    kept = max(size, size * CANDIDATES // 50)
    slots = 1 << ceil(log2(tracked / 0.75))
    n, items = docs.select(F.explode(tokens(F.col(text))).alias("term")).agg(F.count("*"), F.expr(f"approx_top_k(term, {kept}, {tracked})")).first()
    error = 3.5 * n / slots
    return [i["item"] for i in items or []], max(2 * error, items[-1]["count"] if items and len(items) == kept else 0)


def term_counts(docs: DataFrame, keys: list[str], terms: DataFrame, text: str) -> DataFrame:
    """tf of the given terms (broadcast) in each document, written once; other tokens are dropped before the shuffle."""
    found = docs.select(*keys, F.explode(tokens(F.col(text))).alias("term")).join(F.broadcast(terms), "term")
    return cut_lineage(found.groupBy(*keys, *terms.columns).agg(F.count(F.lit(1)).alias("tf")))


def vocabulary_counts(docs: DataFrame, keys: list[str], text: str = "text", size: int = 50, tracked: int = TRACKED) -> DataFrame:
    """(keys, idx, term, tf) for the `size` most frequent terms, ties alphabetical, numbered alphabetically.

    Candidates come from merged summaries and are counted exactly. If their `size`-th count
    is above what any other term can have, they are the vocabulary; if not (ties at the
    border, or nearly even frequencies), all terms are counted.
    """
    spark = docs.sparkSession
    names, others = heavy_terms(docs, text, size, tracked)
    counts = term_counts(docs, keys, spark.createDataFrame([(n,) for n in names], "term STRING"), text)
    totals = counts.groupBy("term").agg(F.sum("tf").alias("total")).collect()  # at most the candidates
    top = sorted(totals, key=lambda r: (-r["total"], r["term"]))[:size]
    if (top[-1]["total"] > others) if len(top) == size else others < 1:
        numbered = [(i, term) for i, term in enumerate(sorted(r["term"] for r in top))]
        return counts.join(F.broadcast(spark.createDataFrame(numbered, "idx INT, term STRING")), "term").select(*keys, "idx", "term", "tf")
    return term_counts(docs, keys, vocabulary(docs, text, size), text)


def tfidf(docs: DataFrame, keys: list[str], text: str = "text", size: int = 50) -> DataFrame:
    """Long form (keys, idx, term, weight): tf * (ln((1+N)/(1+df)) + 1), rows scaled to length 1.

    The texts are read twice: for the candidates of the vocabulary and for the counts.
    """
    counts = vocabulary_counts(docs, keys, text, size)
    spread = F.broadcast(counts.groupBy("idx").agg(F.count(F.lit(1)).alias("df")))  # at most `size` rows
    total = docs.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()
    raw = (counts.join(spread, "idx")
           .withColumn("raw", F.col("tf") * (F.log((1 + total) / (1 + F.col("df"))) + 1)))
    # at most `size` rows per document
    rows = raw.groupBy(*keys).agg(F.collect_list(F.struct("idx", "term", "raw")).alias("terms"),
                                  F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return (rows.select(*keys, "norm", F.inline("terms"))
            .select(*keys, "idx", "term", (F.col("raw") / F.col("norm")).alias("weight")))


def tfidf_wide(docs: DataFrame, keys: list[str], text: str = "text", size: int = 50) -> DataFrame:
    """One row per document with any known term, columns tfidf_0 .. tfidf_<size-1>."""
    long = tfidf(docs, keys, text, size)
    return long.groupBy(*keys).agg(*[
        F.expr(f"coalesce(sum(CASE WHEN idx = {i} THEN weight END), 0D) AS tfidf_{i}") for i in range(size)])


def log_documents(logs: DataFrame, bucket_us: int = MINUTE, label: str = "start") -> DataFrame:
    """Lines keyed by their document: run, service and time bucket.

    The bucket's start is used as window_end, so a row may hold text later than
    its time; `label="end"` names the bucket by its end instead.
    """
    start = micros("ts") - F.pmod(micros("ts"), F.lit(bucket_us))
    end = start if label == "start" else start + F.lit(bucket_us)
    return logs.select(*RUN_SERVICE, from_micros(end - F.lit(bucket_us)).alias("window_start"),
                       from_micros(end).alias("window_end"), "ts", "text")


def bucket_documents(logs: DataFrame, bucket_us: int = MINUTE, tie: str = "text", lines_per_part: int = 1_000) -> DataFrame:
    """Text of each bucket in time order, as numbered parts of `lines_per_part` lines joined by a space.

    A document has the same form at every size: part p holds its lines p * lines_per_part and
    following, so no task ever holds more than that many lines of one bucket.
    """
    start = from_micros(micros("ts") - F.pmod(micros("ts"), F.lit(bucket_us)))
    doc = [*RUN_SERVICE, "window_end"]
    placed = positions(logs.select(*RUN_SERVICE, start.alias("window_end"), "ts", tie, *(["text"] if tie != "text" else [])),
                       [*RUN_SERVICE, "ts", tie])
    first = sized_side(placed.groupBy(*doc).agg(F.min("pos").alias("_first")))
    parts = placed.join(first, doc).withColumn("part", F.expr(f"(pos - _first) div {lines_per_part}"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return parts.groupBy(*doc, "part").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))
