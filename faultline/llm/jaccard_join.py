"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters, verified once per pair.

A set is known by a hash of its n-grams, so exact copies are one set from the first step
on. Links are found in two rounds, because near copies come in groups whose pairs nobody
needs: first every set meets the most central set of each prefix n-gram (a star, linear in
the group), then all candidate pairs whose sets are not connected yet are compared. Sets
that are connected already cannot change a component, so no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import bloom
from faultline.llm.components import connected
from faultline.llm.words import between_spaces, giving_back, mix, pieces, stored, windows, words_of

ORDER_BITS = 40  # n-grams are ordered and joined by this many bits of their hash; exact ones decide
CHUNK = 1 << 21  # n-grams counted together before a task passes them on
FREQUENT = 1 << 19  # entries of the table of frequent n-grams sent to the tasks
HOT = 4096  # an n-gram in that many documents is grouped by a shuffled join instead of a bucket
RANGES = 256  # ranges of hashes in which the suffix filter counts a set
GROUP = 512  # sets compared with one centre in one task
SEEN = 1 << 20


def shingle_sets(texts: pa.Array, table: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, none is empty."""
    words = words_of(texts, table, lower=True)
    grams = windows(words.hash, size)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= size:
            own = np.sort(grams[a:b - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(windows(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signature(grams: np.ndarray) -> int:
    """One number for a whole set; equal sets have the same."""
    both = np.array([len(grams), mix(grams).sum(dtype=np.uint64), mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64)
    return int(mix(mix(mix(both[:1]) + both[1:2]) + both[2:])[0].astype(np.int64))


def least_overlap(n: int, m: int, share: int) -> int:
    """Smallest intersection with 100 * both >= share * either."""
    return -(-share * (n + m) // (100 + share))


def arrow_map(df: DataFrame, schema: T.StructType, run) -> DataFrame:
    return df.mapInArrow(giving_back(run), schema)


def bits(df: DataFrame, text: str, per_bucket: int) -> int:
    """Bucket bits so that a bucket of n-gram counts has about `per_bucket` entries."""
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return int(np.clip(np.ceil(np.log2(max(1.0, size / 6 / per_bucket))), 8, 24))


def frequent_grams(docs: DataFrame, text: str, size: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` most frequent n-grams and their document counts, counted over all documents.

    Tasks count what they hold and pass on sorted arrays by hash bucket, so a frequent n-gram
    is one entry per task. All n-grams of the least count that no longer fits are left out.
    """
    bucket_bits = bits(docs, text, 1 << 17)
    low = np.uint64(ORDER_BITS - bucket_bits)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("once", T.BinaryType()),
                           T.StructField("often", T.BinaryType()), T.StructField("count", T.BinaryType())])

    def split(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        bucket, rest = (key >> low).astype(np.int64), (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.uint32)
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cuts[1:].tolist(), len(key)]
        once = [rest[a:b][n[a:b] == 1].tobytes() for a, b in zip(cuts.tolist(), ends)]
        often = [rest[a:b][n[a:b] > 1].tobytes() for a, b in zip(cuts.tolist(), ends)]
        count = [n[a:b][n[a:b] > 1].astype(np.uint32).tobytes() for a, b in zip(cuts.tolist(), ends)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(once, pa.binary()),
                                           pa.array(often, pa.binary()), pa.array(count, pa.binary())], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, n = between_spaces(), [], 0
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                sets = shingle_sets(batch.column(0).slice(a, b - a), table, size)
                held.append(np.concatenate(sets) >> np.uint64(64 - ORDER_BITS))
                n += len(held[-1])
                if n >= CHUNK:
                    yield split(held)
                    held, n = [], 0
        if n:
            yield split(held)

    result = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def add(key, group):
        def numbers(name):
            return [np.frombuffer(x.as_py(), np.uint32) for x in group.column(name)]

        once, often, count = numbers("once"), numbers("often"), numbers("count")
        rest, place = np.unique(np.concatenate([*once, *often]), return_inverse=True)
        total = np.bincount(place, np.concatenate([np.ones(sum(map(len, once))), *count])).astype(np.int64)
        kept = total >= 3
        gram = rest[kept].astype(np.int64) | (np.int64(key[0].as_py()) << np.int64(low))
        return pa.table({"gram": gram, "n": total[kept]}, schema=pa.schema([("gram", pa.int64()), ("n", pa.int64())]))

    counted = stored(arrow_map(docs.select(text), schema, run).groupBy("bucket").applyInArrow(add, result), "gram-counts")
    sizes = counted.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).toPandas()
    sizes["sum"] = sizes["count"].cumsum()
    fits = sizes[sizes["sum"] <= most]
    if not len(fits):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    kept = counted.filter(F.col("n") >= int(fits["n"].min())).toPandas().sort_values("gram")
    return kept["gram"].to_numpy().astype(np.uint64), kept["n"].to_numpy().astype(np.uint64)


SETS = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("words", T.LongType()),
                     T.StructField("ranges", T.BinaryType()), T.StructField("bucket", T.IntegerType()), T.StructField("gram", T.BinaryType()),
                     T.StructField("of", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("at", T.BinaryType())])
MEMBERS = T.StructType([T.StructField(x, T.LongType()) for x in ("gram", "sig", "n", "at")])


def range_counts(grams: np.ndarray) -> bytes:
    """How many n-grams lie in each range of hashes (255 at most), one byte each."""
    return np.minimum(np.bincount((grams >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64), minlength=RANGES), 255).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, key: str, text: str, size: int, share: int, frequent) -> DataFrame:
    """Rows of two kinds: one per document (id, n, sig), and packed prefix entries by bucket of n-gram.

    Sets are sorted rare first: by document count if the table of frequent n-grams has it,
    else by hash. Two linked sets share one of their first n - least + 1 entries.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    bucket_bits = bits(docs, text, 1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, (known, counts), seen = between_spaces(), sent.value, set()
        for batch in batches:
            texts = batch.column(1)
            for a, b in pieces(texts):
                sets = shingle_sets(texts.slice(a, b - a), table, size)
                sigs = [signature(s) for s in sets]
                none = pa.nulls(len(sets), pa.binary())
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.int64()), batch.column(2).slice(a, b - a),
                    pa.array([range_counts(s) for s in sets], pa.binary()), pa.nulls(len(sets), pa.int32()), none, none, none, none], SETS.names)
                if len(seen) > SEEN:
                    seen.clear()
                fresh = []
                for s, x in zip(sets, sigs):
                    if len(s) and x not in seen:
                        seen.add(x)
                        fresh.append((s, x))
                if not fresh:
                    continue
                order = np.concatenate([s for s, _ in fresh]) >> np.uint64(64 - ORDER_BITS)
                rank = order
                if len(known):
                    spot = np.minimum(np.searchsorted(known, order), len(known) - 1)
                    count = np.where(known[spot] == order, counts[spot], np.uint64(0))
                    rank = order | (np.minimum(count, np.uint64((1 << 24) - 1)) << np.uint64(ORDER_BITS))
                gram, length, start = [], [], 0
                for s, _ in fresh:
                    n = len(s)
                    p = n - (-(-share * n // 100)) + 1
                    gram.append(np.sort(rank[start:start + n])[:p])
                    length.append(p)
                    start += n
                gram, length = np.concatenate(gram), np.array(length)
                of = np.repeat(np.array([x for _, x in fresh], np.int64), length)
                sizes = np.repeat(np.array([len(s) for s, _ in fresh], np.uint32), length)
                at = (np.arange(len(gram)) - np.repeat(np.cumsum(length) - length, length)).astype(np.uint32)
                hot = (gram >> np.uint64(ORDER_BITS)) >= HOT
                gram = gram & np.uint64((1 << ORDER_BITS) - 1)
                bucket = np.where(hot, -1, (gram >> np.uint64(ORDER_BITS - bucket_bits)).astype(np.int64))
                by = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[by], prepend=-2))
                ends = [*cuts[1:].tolist(), len(by)]
                columns = [[v[by][i:j].tobytes() for i, j in zip(cuts.tolist(), ends)] for v in (gram, of, sizes, at)]
                m = len(cuts)
                yield pa.RecordBatch.from_arrays([
                    *[pa.nulls(m, pa.int64()) for _ in range(4)], pa.nulls(m, pa.binary()), pa.array(bucket[by][cuts], pa.int32()),
                    *[pa.array(c, pa.binary()) for c in columns]], SETS.names)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("words")).mapInArrow(giving_back(run), SETS)


def unpacked(group: pa.Table) -> dict[str, np.ndarray]:
    kinds = {"gram": np.uint64, "of": np.int64, "sizes": np.uint32, "at": np.uint32}
    return {k: np.concatenate([np.frombuffer(x.as_py(), d) for x in group.column(k)]).astype(np.int64) for k, d in kinds.items()}


def members(packed: DataFrame) -> DataFrame:
    """gram, sig, n, at of every prefix n-gram that two different sets have in their prefixes."""
    packed = packed.filter("bucket is not null").select("bucket", "gram", "of", "sizes", "at")

    def shared(group):
        x = unpacked(group)
        order = np.lexsort((x["of"], x["gram"]))
        gram, sig = x["gram"][order], x["of"][order]
        fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (sig[1:] != sig[:-1])])
        order = order[fresh]
        gram = gram[fresh]
        same = gram[1:] == gram[:-1]
        kept = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        return pa.table([x[k][kept] for k in ("gram", "of", "sizes", "at")], schema=pa.schema([(n, pa.int64()) for n in MEMBERS.names]))

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = unpacked(pa.Table.from_batches([batch]))
                yield pa.RecordBatch.from_arrays([pa.array(x[k]) for k in ("gram", "of", "sizes", "at")], MEMBERS.names)

    rare = packed.filter("bucket >= 0").groupBy("bucket").applyInArrow(shared, MEMBERS)
    hot = packed.filter("bucket < 0").mapInArrow(loose, MEMBERS).dropDuplicates(["gram", "sig"])
    return rare.unionByName(hot)


def can_link(share: int) -> Column:
    """Length and positional filters of a pair a, b that meets at a shared n-gram."""
    n, m = F.col("a.n"), F.col("b.n")
    least = F.ceil(share * (n + m) / F.lit(100.0 + share) - 1e-9)
    rest = F.least(n - F.col("a.at"), m - F.col("b.at"))
    return (100 * F.least(n, m) >= share * F.greatest(n, m)) & (rest >= least)


def suffix_filter(pairs: DataFrame, names: DataFrame, share: int) -> DataFrame:
    """Pairs whose sets can still share enough: the counts in each range of hashes bound how much differs."""
    a = names.select("sig", F.col("n").alias("_n"), F.col("ranges").alias("_a"))
    b = names.select(F.col("sig").alias("centre"), F.col("n").alias("_m"), F.col("ranges").alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, RANGES).astype(np.int32) for k in (2, 3))
                size = batch.column(4).to_numpy()
                kept = np.abs(x - y).sum(axis=1) <= size - 2 * -(-share * size // (100 + share))
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(kept)), batch.column(1).filter(pa.array(kept))], ["sig", "centre"])

    return pairs.join(a, "sig").join(b, "centre").select("sig", "centre", "_a", "_b", (F.col("_n") + F.col("_m")).alias("size")).mapInArrow(giving_back(run), "sig long, centre long")


def star_pairs(entries: DataFrame, share: int) -> DataFrame:
    """Every set with the most central set of each of its n-grams: the one that has fewest rarer n-grams."""
    centre = entries.groupBy("gram").agg(F.min(F.struct("at", "sig", "n")).alias("c")).select("gram", "c.sig", "c.n", "c.at")
    pairs = entries.alias("a").join(centre.alias("b"), F.col("a.gram") == F.col("b.gram")).filter(
        (F.col("a.sig") != F.col("b.sig")) & can_link(share))
    return pairs.select(F.col("a.sig").alias("sig"), F.col("b.sig").alias("centre")).distinct()


def open_pairs(entries: DataFrame, labels: DataFrame, share: int) -> DataFrame:
    """All candidate pairs of sets that are not connected yet."""
    labelled = entries.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("gram").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("gram")
    rows = labelled.join(mixed, "gram", "left_semi")
    pairs = rows.alias("a").join(rows.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.label") < F.col("b.label")) & can_link(share))
    return pairs.select(F.col("a.sig").alias("sig"), F.col("b.sig").alias("centre")).distinct()


def verified(docs: DataFrame, text: str, size: int, share: int, pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs (sig, centre) that link, each verified once on the whole n-gram sets.

    Sets are made again from the texts; `names` has a hash of one text of each set, and a
    Bloom filter of the wanted texts keeps the rest in the scan. Each set is sent once per centre it
    meets, in groups of `GROUP`, with a copy of the centre in each.
    """
    spark = docs.sparkSession
    wanted = stored(pairs, "pairs")
    sized = wanted.groupBy("centre").agg(F.count("*").alias("_m"))
    asks = wanted.join(sized, "centre").select("sig", "centre", F.pmod("sig", F.ceil(F.col("_m") / GROUP)).alias("salt"))
    salts = sized.select(F.col("centre").alias("sig"), "centre", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_m") / GROUP) - 1)).alias("salt"))
    asks = stored(asks.unionByName(salts), "asks")
    sent = spark.sparkContext.broadcast(bloom.fill(stored(asks.select("sig").distinct().join(names, "sig").select("words"), "wanted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, seen = between_spaces(), sent.value, set()
        for batch in batches:
            key = batch.column(1).to_numpy()
            fresh = []
            for i in np.flatnonzero(bloom.holds(key, held)).tolist():
                if int(key[i]) not in seen:
                    seen.add(int(key[i]))
                    fresh.append(i)
            if len(seen) > SEEN:
                seen.clear()
            texts = batch.column(0).take(pa.array(fresh, pa.int64()))
            for a, b in pieces(texts):
                sets = shingle_sets(texts.slice(a, b - a), table, size)
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["sig", "grams"])

    sets = docs.select(text, F.xxhash64(text).alias("words")).mapInArrow(giving_back(run), "sig long, grams binary").dropDuplicates(["sig"])
    groups = asks.join(sets, "sig").groupBy("centre", "salt")

    def compare(key, group):
        centre = key[0].as_py()
        sigs, grams = group.column("sig").to_pylist(), group.column("grams")
        middle = next((np.frombuffer(grams[i].as_py(), np.uint64) for i, s in enumerate(sigs) if s == centre), None)
        linked = set()
        for i, s in enumerate(sigs):
            if s != centre and s not in linked and middle is not None:
                own = np.frombuffer(grams[i].as_py(), np.uint64)
                both = len(np.intersect1d(own, middle, assume_unique=True))
                if 100 * both >= share * (len(own) + len(middle) - both):
                    linked.add(s)
        linked = sorted(linked)
        return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([centre] * len(linked), pa.int64())})

    return groups.applyInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, share: int = 80,
                    frequent: int = FREQUENT) -> DataFrame:
    """id, n (set size), sig (set), component (smallest id reachable by links) of every row of `docs`.

    Words are runs between white space, A-Z lower-cased; a set holds the distinct runs of `size`
    words, or the whole sequence if there are fewer. Rows link when their sets are
    equal or 100 * intersection >= `share` * union. A null, empty or blank text has an empty set
    and links with nothing. A row with a null id links like others but names no
    component (null if nobody in it has an id). Repeated rows stay; further columns are left out.
    `frequent` bounds the table of frequent n-grams that tasks hold; it changes only the
    order of n-grams, not the result.
    """
    table = frequent_grams(docs, text, size, frequent)
    made = stored(prefixes(docs, key, text, size, share, table), "prefixes")
    rows = made.filter("bucket is null").select("id", "n", "sig")
    names = stored(made.filter("n > 0").groupBy("sig").agg(*[F.min(c).alias(c) for c in ("words", "n", "ranges")]), "texts")
    entries = stored(members(made), "members")
    links = stored(verified(docs, text, size, share, suffix_filter(star_pairs(entries, share), names, share), names), "star-links")
    labels = connected(links)
    missing = stored(suffix_filter(open_pairs(entries, labels, share), names, share), "open-pairs")
    if not missing.isEmpty():
        more = verified(docs, text, size, share, missing, names)
        labels = connected(links.unionByName(more))
    named = rows.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
        "label", F.when(F.col("n") > 0, F.coalesce("label", "sig")))
    named = stored(named, "named")
    least = named.filter("n > 0").groupBy("label").agg(F.min("id").alias("component"))
    full = named.filter("n > 0").join(least, "label").select("id", "n", "sig", "component")
    return full.unionByName(named.filter("n = 0").select("id", "n", "sig", F.col("id").alias("component")))
