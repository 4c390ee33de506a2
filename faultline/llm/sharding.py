"""Jump consistent hashing: stable shards without a ring table. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.words import stored

# the published generator's constants
MULTIPLIER = "2862933555777941757"
WRAP = "18446744073709551616"


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of a long key (null counts as 0).

    Each step of the published loop draws from a 64-bit generator and jumps to the next
    shard count at which the key would move; the last one below `shards` is its shard. At
    most `shards` steps exist, so a fold over that many steps, idle once it has passed the
    end, gives the loop's result. Decimals hold the unsigned products.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    unsigned = F.when(whole < 0, whole + F.lit(WRAP).cast("decimal(20,0)")).otherwise(whole).cast("decimal(20,0)")

    def step(s: Column, _: Column) -> Column:
        drawn = ((s["k"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + 1) % F.lit(WRAP).cast("decimal(20,0)")).cast("decimal(20,0)")
        high = F.floor(drawn / F.lit("8589934592").cast("decimal(10,0)")).cast("long")
        after = F.floor((s["j"] + 1).cast("double") * (F.lit(2147483648.0) / (high + 1).cast("double"))).cast("long")
        moved = F.struct(drawn.alias("k"), s["j"].alias("b"), after.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    begin = F.struct(unsigned.alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, step, lambda s: s["b"].cast("int"))


def shard_rows(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text",
               rows_per_bucket: int = 20_000, least_buckets: int = 8) -> DataFrame:
    """Every row's shard and its place there: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text (null: 0) plus 8. The law is `key`: key and shard
    count alone decide, a null key counts as 0, and with one shard more (`grown_shard`)
    rows move only into that one. Slots count from 0 without gaps in each shard: a shard is cut
    into buckets of about `rows_per_bucket` rows by a hash of the row, buckets are
    counted, and a row's slot is its rank in the bucket plus the rows in earlier ones, so no
    task sorts a whole shard. Rows that are equal throughout share out their slots in any
    order. The texts are read once and never shuffled. Other columns are left out.
    """
    content = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias(key), (F.octet_length(content) + 8).cast("long").alias("size"),
                       F.crc32(content).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), jump_shard(F.col(key), shards).alias("shard"),
                       jump_shard(F.col(key), shards + 1).alias("grown_shard"))
    rows = stored(rows, "shards")
    buckets = max(least_buckets, -(-rows.count() // (shards * rows_per_bucket)))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(key, "size", "text_crc32"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select(
        F.col("shard").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    place = Window.partitionBy("shard", "_bucket").orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    ranked = rows.withColumn("_rank", F.row_number().over(place) - 1)
    joined = ranked.join(starts, (F.col("shard") == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.select(key, "size", "text_crc32", "law", "shard", (F.col("_from") + F.col("_rank")).cast("long").alias("slot"), "grown_shard")
