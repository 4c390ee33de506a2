"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is the corpus itself: its blocks are the stretches of documents that may
occur elsewhere, found through sampled anchors. The index holds every window of every
block with the first document it starts in. A document is factored greedily: from a word at
which a window of an earlier document starts, the factor runs on for as long as the next
window is indexed for an earlier document too, also where one block ends and another
goes on, because the windows across that boundary are looked up like all others. Words
outside factors are literals; factors are the duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import bloom
from faultline.llm.words import Words, between_spaces, giving_back, pieces, stored, windows, within, words_of

GRAM = 10  # words of an anchor
CHUNK = 1 << 18  # windows gathered before a task passes their first documents on
PER_BUCKET = 1 << 18
PARSED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                       T.StructField("kept", T.StringType()),
                       T.StructField("factors", T.ArrayType(T.StructType([T.StructField("from", T.IntegerType()),
                                                                          T.StructField("until", T.IntegerType())])))])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, in log steps."""
    out, done = values, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:len(out) - step], out[step:])
        done += step
    return out


def anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, and for each the number of its anchor in the list of anchor hashes.

    A window's anchor is its least gram, the last one if several are equal: it depends on the
    window's words alone, so equal windows have equal anchors, and neighbours mostly share one.
    """
    gram = min(GRAM, window)
    n = len(words.hash) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = windows(words.hash, gram)
    place_bits = np.uint64(max(1, int(len(grams)).bit_length()))
    behind = np.arange(len(grams), dtype=np.uint64)[::-1]
    least = least_of((grams >> place_bits << place_bits) | behind, window - gram + 1)
    start = np.flatnonzero(within(words.first, window, n))
    at = len(grams) - 1 - (least[start] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    fresh = np.diff(at, prepend=-1) != 0
    return start, np.cumsum(fresh) - 1, grams[at[fresh]]


def shared_anchors(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """anchor: the anchors that more than one row has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = between_spaces()
        for batch in batches:
            for a, b in pieces(batch.column(0)):
                words = words_of(batch.column(0).slice(a, b - a), table, lower=False)
                start, which, anchor = anchors(words, window)
                if len(start):
                    row = np.searchsorted(words.first, start, "right") - 1
                    fresh = np.diff(which, prepend=-1) != 0
                    pairs = np.unique(np.stack([row[fresh].astype(np.uint64), anchor]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], ["anchor"])

    found = docs.filter(F.col(key).isNotNull()).select(text).mapInArrow(giving_back(run), "anchor long")
    return found.groupBy("anchor").count().filter("count > 1").select("anchor")


def block_windows(words: Words, window: int, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of reference blocks: those whose anchor is shared."""
    start, which, anchor = anchors(words, window)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    start = start[bloom.holds(anchor.view(np.int64), filled)[which]]
    return start, windows(words.hash, window)[start]


def first_documents(docs: DataFrame, key: str, text: str, window: int, sent) -> DataFrame:
    """id, hashes: for every document, the block windows that start in no document with a smaller id."""
    size = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    bits = np.uint64(np.clip(np.ceil(np.log2(max(1.0, size / 6 / PER_BUCKET))), 6, 24))

    def packed(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, hashes))
        ids, hashes = ids[order], hashes[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        ids, hashes = ids[fresh], hashes[fresh]
        bucket = (hashes >> (np.uint64(64) - bits)).astype(np.int64)
        order = np.lexsort((ids, bucket))
        ids, hashes, bucket = ids[order], hashes[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = [*cuts[1:].tolist(), len(ids)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), *[
            pa.array([v[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)], pa.binary()) for v in (ids, hashes)]], ["bucket", "ids", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, filled, held, n = between_spaces(), sent.value, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in pieces(batch.column(1)):
                words = words_of(batch.column(1).slice(a, b - a), table, lower=False)
                start, hashes = block_windows(words, window, filled)
                if len(start):
                    held.append((ids[a:b][np.searchsorted(words.first, start, "right") - 1], hashes))
                    n += len(start)
                if n >= CHUNK:
                    yield packed(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield packed(*map(np.concatenate, zip(*held)))

    def owned(group):
        ids = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("ids")])
        hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in group.column("hashes")])
        order = np.lexsort((ids, hashes))
        ids, hashes = ids[order], hashes[order]
        fresh = np.concatenate([[True], hashes[1:] != hashes[:-1]])
        ids, hashes = ids[fresh], hashes[fresh]
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], hashes[order]
        cuts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        ends = [*cuts[1:].tolist(), len(ids)]
        return pa.table({"id": pa.array(ids[cuts], pa.int64()),
                         "hashes": pa.array([hashes[a:b].tobytes() for a, b in zip(cuts.tolist(), ends)], pa.binary())})

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), text)
    return rows.mapInArrow(giving_back(run), "bucket int, ids binary, hashes binary").groupBy("bucket").applyInArrow(owned, "id long, hashes binary")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, out: str = "parsed") -> DataFrame:
    """Adds struct `parsed`: n_words, n_removed, kept (remaining words joined by a blank), factors (from, until).

    Words are runs between white space, unchanged. A window is `window` consecutive words; a
    word goes if a window over it also starts in a document with a smaller id, judged on
    the input. Rows with equal ids are one document in this sense; a row with a null id keeps all
    its words and is no reference. A null, empty or blank text has no words and keeps the empty text.
    Other columns pass through, an older `parsed` is replaced. Each document gets only the
    list of windows it is first for; a common passage costs one entry, however many have it.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(bloom.fill(stored(shared_anchors(docs, key, text, window), "anchors")))
    firsts = first_documents(docs, key, text, window, sent).groupBy(F.col("id").alias("_id")).agg(F.collect_list("hashes").alias("_first"))
    joined = docs.drop(out, "_id", "_first", "_both").join(firsts, F.col(key).cast("long") == F.col("_id"), "left").drop("_id")
    named = joined.withColumn("_both", F.struct(F.col(text).alias("text"), "_first", F.col(key).isNotNull().alias("named"))).drop("_first")
    schema = T.StructType([f for f in named.schema.fields if f.name != "_both"] + [T.StructField(out, PARSED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, filled = between_spaces(), sent.value
        for batch in batches:
            place = batch.schema.get_field_index("_both")
            both = batch.column(place)
            texts, first, known = both.field(0), both.field(1), both.field(2)
            rest = [c for i, c in enumerate(batch.columns) if i != place]
            for a, b in pieces(texts):
                made = parse(texts.slice(a, b - a), first.slice(a, b - a), known.slice(a, b - a), window, table, filled)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rest], made], schema.names)

    return named.mapInArrow(giving_back(run), schema)


def parse(texts: pa.Array, first: pa.Array, named: pa.Array, window: int, table: np.ndarray, filled: np.ndarray) -> pa.StructArray:
    """Factors of a batch of documents."""
    words = words_of(texts, table, lower=False)
    start, hashes = block_windows(words, window, filled)
    row = np.searchsorted(words.first, start, "right") - 1
    hit = np.zeros(len(start), bool)
    for i, (a, b) in enumerate(zip(np.searchsorted(row, np.arange(len(texts)), "left"), np.searchsorted(row, np.arange(len(texts)), "right"))):
        if b > a and named[i].as_py():
            own = first[i].as_py() or []
            hit[a:b] = ~np.isin(hashes[a:b], np.frombuffer(b"".join(own), np.uint64)) if own else True
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, start[hit], 1)
    np.add.at(edge, start[hit] + window, -1)
    gone = np.cumsum(edge)[:-1] > 0
    count = np.diff(words.first)
    text_of = np.repeat(np.arange(len(texts)), count)
    removed = np.bincount(text_of[gone], minlength=len(texts))
    begins = gone & ~(np.concatenate([[False], gone[:-1]]) & np.concatenate([[False], text_of[1:] == text_of[:-1]]))
    ends = gone & ~(np.concatenate([gone[1:], [False]]) & np.concatenate([text_of[1:] == text_of[:-1], [False]]))
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    base = words.first[text_of[begin]]
    spans = pa.StructArray.from_arrays([pa.array(begin - base, pa.int32()), pa.array(end - base, pa.int32())], ["from", "until"])
    per_row = np.concatenate([[0], np.cumsum(np.bincount(text_of[begin], minlength=len(texts)))]).astype(np.int32)
    kept, raw = [], words.raw.tobytes()
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        stay = ~gone[a:b]
        kept.append(b" ".join(raw[s:e] for s, e in zip(words.start[a:b][stay].tolist(), words.end[a:b][stay].tolist())).decode())
    return pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
                                       pa.ListArray.from_arrays(pa.array(per_row), spans)], PARSED.names)
