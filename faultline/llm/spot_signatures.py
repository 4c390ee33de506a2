"""SpotSigs document fingerprints. DataFrame functions only.

A signature is a common word (the anchor) with the chain of content words that follow it.
A document is the set of its signatures; sets are partitioned by their length and
compared by Jaccard only where length and shared rare signatures allow the likeness asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.words import stored

# fixed values: common words of English, French, German and Spanish, the anchors by default
ANCHORS = (
    "a an and are as at be by for from has have in is it of on or that the this to was were will with "
    "au aux avec ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas plus pour que qui se son sur un une "
    "als auch auf aus bei das dass dem den der die ein eine einem einen einer es für hat ich im ist mit nach nicht sich sie sind "
    "und von war werden wie wird zu zum zur "
    "al como con del el ella entre era esta este fue hay las lo los más muy no para pero por porque sin sobre su sus también una y ya"
).split()
CHAIN = 2  # content words behind an anchor


def spot_set(text: Column, anchors: tuple = ANCHORS, chain: int = CHAIN) -> Column:
    """Sorted distinct signatures of a text, as 32-bit numbers.

    Words are runs of letters and digits, lower-cased. The j-th anchor (from 0) at word p has p - j
    content words before it, so its chain is content words p - j to p - j + chain - 1; an anchor with
    fewer words behind it has the chain that is left. A text without anchors has the chains
    that start at each of its content words; without words the set is empty.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # one number a word; the last bit tells anchors
    coded = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(
        F.when(w.isin(*anchors), F.lit(1)).otherwise(F.lit(0)).cast("long")))

    def chains(w: Column) -> Column:
        content = F.filter(w, lambda x: x.bitwiseAND(1) == 0)
        spots = F.filter(F.transform(w, lambda x, i: F.when(x.bitwiseAND(1) == 1, F.struct(x.alias("h"), i.alias("k")))), lambda x: x.isNotNull())
        spots = F.transform(spots, lambda x, j: F.struct(x["h"].alias("h"), (x["k"] - j).alias("k")))
        plain = F.transform(content, lambda x, i: F.struct(F.lit(0).cast("long").alias("h"), i.alias("k")))
        return once(F.struct(content.alias("c"), spots.alias("s"), plain.alias("p")), lambda both: F.transform(
            F.when(F.size(both["s"]) > 0, both["s"]).otherwise(both["p"]),
            lambda x: F.hash(x["h"], *[F.coalesce(F.get(both["c"], x["k"] + n), F.lit(0).cast("long")) for n in range(chain)])))

    return F.sort_array(F.array_distinct(once(coded, chains)))


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fingerprint(signatures: Column) -> Column:
    """The sorted set as text, 8 hexadecimal digits a signature."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) > 0, both / (F.size(a) + F.size(b) - both)).otherwise(F.lit(1.0))


def neighbours(lengths: DataFrame, key: str) -> DataFrame:
    """id, _next, _before, _need: the ids in a ring by ascending order, and half the length of the one before.

    Ids are cut into ranges and followed within each; the ends of a range get their neighbours
    from a table with a row per range, so no task orders them all.
    """
    spark = lengths.sparkSession
    ids = lengths.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max("_half").alias("_half"))
    ranged = stored(ids.repartitionByRange("_id").withColumn("_part", F.spark_partition_id()), "id-ranges")
    ends = ranged.groupBy("_part").agg(F.min("_id").alias("first"), F.max("_id").alias("last"), F.max_by("_half", "_id").alias("half"))
    ends = [tuple(r) for r in ends.orderBy("_part").collect()]
    n = len(ends)
    ring = [(ends[i][0], ends[(i + 1) % n][1], ends[i - 1][2], ends[i - 1][3]) for i in range(n)]
    kind = dict(ids.dtypes)["_id"]
    table = spark.createDataFrame(ring, f"_part int, _after {kind}, _prior {kind}, _prior_half int")
    order = Window.partitionBy("_part").orderBy("_id")
    followed = ranged.select("*", F.lead("_id").over(order).alias("_n"), F.lag("_id").over(order).alias("_b"), F.lag("_half").over(order).alias("_h"))
    return followed.join(F.broadcast(table), "_part").select(
        "_id", F.coalesce("_n", "_after").alias("_next"), F.coalesce("_b", "_prior").alias("_before"), F.coalesce("_h", "_prior_half").alias("_need"))


def spot_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: tuple = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """key, n_chars, signatures, fingerprint of every row; a null text counts as empty. Repeated rows stay."""
    return docs.select(F.col(key).alias(key), F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"),
                       spot_set(F.col(text), tuple(anchors), chain).alias("signatures")).withColumn("fingerprint", fingerprint(F.col("signatures")))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", anchors: tuple = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """Every row with its edited text, both fingerprints, near_edited and near_next.

    The last floor(n / 2) code points give way to the first as many (or all) of the next document by
    ascending id; behind the last id comes the first. Of several rows with the next id the
    one whose needed beginning is least counts. A row with a null id has no next document: its
    replacement is empty and near_next null. Texts are shuffled once by id, and the
    beginnings once more to the documents before them.
    """
    base = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    lengths = stored(base.select(F.col("_key").alias("_k"), F.floor(F.char_length("_text") / 2).cast("int").alias("_half")), "lengths")
    ring = stored(neighbours(lengths, "_k"), "ring")
    rows = base.join(ring, F.col("_key") == F.col("_id"), "left")
    # no filter here: with the same left input both joins share one exchange of the texts
    heads = rows.groupBy(F.col("_before").alias("_to")).agg(
        F.min(F.struct(F.substring("_text", F.lit(1), F.col("_need")).alias("head"), spot_set(F.col("_text"), tuple(anchors), chain).alias("set"))).alias("_after"))
    joined = base.join(heads, F.col("_key") == F.col("_to"), "left")
    n = F.char_length("_text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("_text", F.lit(1), n - half), F.substring(F.coalesce("_after.head", F.lit("")), F.lit(1), half))
    made = joined.select("_key", n.cast("long").alias("n_chars"), edited.alias("edited"), F.col("_after.set").alias("_set"),
                         spot_set(F.col("_text"), tuple(anchors), chain).alias("signatures"))
    made = made.withColumn("edited_signatures", spot_set(F.col("edited"), tuple(anchors), chain))
    return made.select(F.col("_key").alias(key), "n_chars", "edited", "signatures", "edited_signatures",
                       likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
                       F.when(F.col("_set").isNotNull(), likeness(F.col("signatures"), F.col("_set"))).alias("near_next"))


def spot_pairs(docs: DataFrame, share: int = 80, key: str = "doc_id", text: str = "text", anchors: tuple = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """a, b, likeness: pairs of different fingerprints with 100 * intersection >= `share` * union, by their least ids.

    Equal fingerprints are one set, named by its least id (a set of rows without ids is left
    out; empty sets link with nothing). Sets are partitioned by length so that a pair lies in one
    partition or two neighbouring ones; within them sets meet on the rarest of their
    signatures, and length and position prune before the sets are compared, once per pair.
    """
    if not 0 < share < 100:
        raise ValueError("share is a percentage below 100")
    sets = stored(spot_fingerprints(docs, key, text, anchors, chain).groupBy("signatures").agg(F.min(key).alias("id")).filter(
        F.col("id").isNotNull() & (F.size("signatures") > 0)).withColumn("n", F.size("signatures")), "spot-sets")
    each = sets.select("id", "n", F.explode("signatures").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("df"))
    rank = Window.partitionBy("id").orderBy("df", "s")
    placed = each.join(common, "s").withColumn("at", F.row_number().over(rank) - 1)
    prefix = placed.filter((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * share / 100.0 - 1e-9)))
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / share)) + 1e-9)
    prefix = stored(prefix.select("id", "n", "s", "at", part.alias("part")), "spot-prefixes")
    wide = prefix.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    a, b = wide.alias("a"), prefix.alias("b")
    least = F.ceil(share * (F.col("a.n") + F.col("b.n")) / (100.0 + share) - 1e-9)
    fits = (100 * F.col("a.n") >= share * F.col("b.n")) & ((F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id"))))
    near = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at")) >= least
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.s") == F.col("b.s")) & fits & near).select(
        F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    left = sets.select(F.col("id").alias("a"), F.col("signatures").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("signatures").alias("y"))
    compared = pairs.join(left, "a").join(right, "b").withColumn("_both", F.size(F.array_intersect("x", "y")))
    either = F.size("x") + F.size("y") - F.col("_both")
    return compared.filter(100 * F.col("_both") >= share * either).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("_both") / either).alias("likeness"))
