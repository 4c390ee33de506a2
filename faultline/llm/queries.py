"""The registered queries of this subpackage: op1 to op13 over whole tables."""

from __future__ import annotations

import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import byte_pairs, decontamination, hard_negatives, html_pages, jaccard_join, language, licences, maxent_lm, oracles, prefix_trie, sharding, spot_signatures, substring_dedup, warc
from faultline.llm.words import crc_rest
from faultline.session import prepare, scratch_path

QUERIES: dict = {}
ORACLES: dict = {
    "op2_jaccard_join": oracles.JACCARD_JOIN,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op7_decontamination": oracles.DECONTAMINATION,
    "op11_hard_negatives": oracles.HARD_NEGATIVES,
    "op12_prefix_trie": oracles.PREFIX_TRIE,
    "op13_warc": oracles.WARC,
}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"),
                        decontamination.is_contaminated().alias("contaminated"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_rest("doc_id", 4) == 2
    filters = language.learn_languages(docs.filter(~held_out))
    return language.predict_language(docs.drop("lang"), filters).select(
        "doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "parsed.n_words", "parsed.n_removed", F.sha2("parsed.kept", 256).alias("kept_sha256"))


@query
def op3_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_pairs.encode_decode(docs, ranks, code_digests, CODE_DIGESTS, public_tokenizers.PATTERN)
    return found.select("doc_id", "coded.*")


CODE_DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                             T.StructField("decoded_sha256", T.StringType())])


def code_digests(ids: pa.Array, decoded: pa.Array) -> list[pa.Array]:
    """Number of ids, SHA-256 of the ids as little-endian unsigned 32-bit integers and of the decoded bytes."""
    ends, raw = ids.offsets.to_pylist(), ids.values.to_numpy().astype("<u4").tobytes()
    return [pa.array(np.diff(ends), pa.int64()), pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(ends, ends[1:])]),
            pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in decoded])]


@query
def op8_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spot_signatures.compare_edited(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                        spot_signatures.fingerprint(F.col("signatures")).alias("fingerprint"),
                        spot_signatures.fingerprint(F.col("edited_signatures")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_pages.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


@query
def op1_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_rest("doc_id", 7) == 2)
    found = maxent_lm.score_texts(docs, docs.filter(~F.col("held_out")))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), licences.all_templates(), inside=True)
    names = F.transform("licences.matches", lambda m: m["licence"])
    best = F.array_max(F.transform("licences.matches", lambda m: m["dice"]))
    return found.select("doc_id", F.array_join(names, ",").alias("licences"), F.coalesce(best, F.lit(0.0)).alias("best_dice"),
                        F.size("licences.matches").cast("long").alias("n_licences"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_negatives(rows.withColumn("label", turned), F.col("vec_id") % 100 == 0)


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5)


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archive = scratch_path(spark, "archive")
    warc.archive_rows(pages, archive)
    return warc.archived_rows(spark, archive)
