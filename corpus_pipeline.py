"""From raw documents to token ids: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result to
the shared folder as Parquet and reads it back as the next one's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import byte_pairs, decontamination, jaccard_join, language, substring_dedup
from faultline.llm.queries import CODE_DIGESTS, code_digests
from faultline.llm.words import stored
from faultline.session import prepare

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.3  # of a text's n-grams that its language must hold
BATCH_ROWS = 2_000  # documents in one Arrow batch
CODED_ROWS = 500  # the same where the pieces of a batch meet the merge table


def bounded(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """The stages follow each other on the same executors, so each moves its texts in smaller batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; a text without letters, a null one, or one whose n-grams its language mostly lacks goes."""
    bounded(spark)
    filters = language.learn_languages(docs)
    found = language.predict_language(docs, filters)
    return found.filter((F.col("language.lang") != "und") & (F.col("language.score") >= LEAST_SCORE)).select(COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (Jaccard 0.8 or more) the one with the smallest id stays.

    Of rows with equal ids one stays; rows with a null id cannot be named and stay.
    """
    bounded(spark)
    groups = jaccard_join.near_duplicates(docs)
    kept = groups.filter(F.col("id") == F.col("component")).select(F.col("id").alias("doc_id")).distinct()
    chosen = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull())).select(COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 50 words and more that start in an earlier document are cut out.

    A document that loses nothing keeps its text as it is; one that loses all goes.
    """
    bounded(spark)
    parsed = substring_dedup.deduplicate(docs)
    cut = F.col("parsed.n_removed") > 0
    kept = parsed.filter(~cut | (F.col("parsed.n_removed") < F.col("parsed.n_words")))
    text = F.when(cut, F.col("parsed.kept")).otherwise(F.col("text"))
    return kept.withColumn("text", text).withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go."""
    bounded(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.decontaminate(docs, benchmark)
    return found.filter(~decontamination.is_contaminated()).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids_sha256 and the decoded text's sha256 of every document."""
    bounded(spark, CODED_ROWS)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_pairs.encode_decode(docs.select("doc_id", "lang", "source", "text"), ranks, code_digests, CODE_DIGESTS, public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", "coded.*")


STAGES = [
    ("language_id", keep_languages),
    ("jaccard_join", keep_one_of_each_group),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("byte_pairs", tokenize),
]
ORACLE_SQL = None  # no stage but one can be put in SQL; tests/llm holds the run against a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
