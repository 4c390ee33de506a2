"""Hard negatives: for each anchor, rows of other labels nearly as close as its positives.

Rows are scored in blocks against blocks of anchors. Pair scores that can matter are packed
into (anchor, descending score, id) keys; keys are dealt out by anchor and sorted inside
their partitions (the DataFrame form of repartitionAndSortWithinPartitions), and an iterator
over the sorted keys opens a window at each positive and hands out negatives until the
window is full. It holds the open windows of one anchor, never an anchor's rows.

A task sends no pair that its own rows already beat: an anchor's first positives lie among
each task's first, and a window's first negatives among each task's first inside it. So the
shuffle carries tasks x anchors x windows keys instead of rows x anchors pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.words import stored
from faultline.session import scratch_path

ANCHOR_BYTES = 32 << 20  # vectors of the anchors that one pass sends to the tasks
BLOCK_VALUES = 1 << 20  # scores, and vector components, held at once in a task
TOP = 2**63 - 1  # scores stay within -TOP to TOP
KEY = np.dtype([("anchor", ">u8"), ("anchor_content", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8"), ("content", ">u8")])
POSITIVE, NEGATIVE = 0, 1
RESULT = T.StructType([T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()), T.StructField("rank", T.IntegerType()),
                       T.StructField("negative_id", T.LongType()), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])


class Rows(NamedTuple):
    id: np.ndarray
    label: np.ndarray
    values: np.ndarray  # scaled whole components, rows x width
    content: Callable[[int], int]  # hash of a row's label and vector


class Anchors(NamedTuple):
    id: np.ndarray
    content: np.ndarray
    label: np.ndarray  # place in `labels`
    labels: list
    values: np.ndarray


class Found(NamedTuple):
    """Scored rows of some groups (anchors, or windows of anchors)."""

    group: np.ndarray
    score: np.ndarray
    id: np.ndarray
    content: np.ndarray


def content_hash(label: str, vector: np.ndarray) -> int:
    code = hashlib.blake2b((vector + 0.0).tobytes(), digest_size=8)  # -0.0 is 0.0
    code.update(label.encode())
    return int.from_bytes(code.digest(), "big")


def flat_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lists, their values as doubles (null: NaN)."""
    column = column.cast(pa.large_list(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)
    return offsets[:-1], offsets[1:], values


def read_rows(batch: pa.RecordBatch, labels: list | None, width: int | None, scale: float) -> Iterator[Rows]:
    """Blocks of the rows that take part, by ascending id, each row once.

    Labels become places in `labels` (-1: in none), or stay texts without it. Vectors are cut
    or filled with zeros to `width`, the widest of the block by default.
    """
    ids, names, vectors = (batch.column(i) for i in range(3))
    start, end, flat = flat_lists(vectors)
    bad = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(~np.isfinite(flat), out=bad[1:])
    whole = bad[end] == bad[start]
    for column in (ids, names, vectors):
        whole &= column.is_valid().to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(whole)
    numbers = pc.fill_null(ids, 0).to_numpy().astype(np.int64)
    keep = keep[np.argsort(numbers[keep], kind="stable")]
    texts = names.to_pylist()
    codes = None if labels is None else pc.fill_null(pc.index_in(names, value_set=pa.array(labels, pa.string())), -1).to_numpy()
    place = 0
    while place < len(keep):
        part = keep[place:place + max(1, BLOCK_VALUES // max(1, width or int((end - start)[keep].max())))]
        place += len(part)
        part = distinct(part, numbers, texts, start, end, flat)
        wide = int((end - start)[part].max()) if width is None else width
        values = np.zeros((len(part), wide))
        length = np.minimum((end - start)[part], wide)
        if len(set(length.tolist())) == 1:
            values[:, :length[0]] = flat[start[part][:, None] + np.arange(length[0])]
        else:
            for row, (i, n) in enumerate(zip(part, length)):
                values[row, :n] = flat[start[i]:start[i] + n]
        with np.errstate(over="ignore"):
            values = np.nan_to_num(np.floor(values * scale))
        own = part
        yield Rows(numbers[part], np.array([texts[i] for i in part], object) if codes is None else codes[part], values,
                   lambda r, own=own: content_hash(texts[own[r]], flat[start[own[r]]:end[own[r]]]))


def distinct(part: np.ndarray, numbers: np.ndarray, texts: list, start: np.ndarray, end: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Rows equal in id, label and vector count once."""
    own = numbers[part]
    same = np.zeros(len(part), bool)
    same[1:] = own[1:] == own[:-1]
    if not same.any():
        return part
    seen, kept = set(), []
    for i in part:
        key = (numbers[i], content_hash(texts[i], flat[start[i]:end[i]]))
        if key not in seen:
            seen.add(key)
            kept.append(i)
    return np.array(kept)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, held within -TOP to TOP."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -TOP, TOP).astype(np.int64)


def first_columns(score: np.ndarray, usable: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of each row's k highest usable scores; equal scores by the lower column."""
    n = score.shape[1]
    few = usable.sum(axis=1)
    rows = np.flatnonzero(few)
    if not len(rows):
        return rows, rows
    score, usable, k = score[rows], usable[rows], min(k, n)
    if abs(int(score.max())) < 2**61 // n and abs(int(score.min())) < 2**61 // n:
        rank = np.where(usable, score * n + (n - 1 - np.arange(n)), -TOP)
        best = np.argpartition(rank, n - k, axis=1)[:, n - k:]
    else:
        best = np.stack([sorted(range(n), key=lambda c, r=r: (not usable[r, c], -int(score[r, c]), c))[:k] for r in range(len(rows))])
    good = np.take_along_axis(usable, best, axis=1)
    return np.repeat(rows, k)[good.ravel()], best.ravel()[good.ravel()]


def first_of_groups(found: list[Found], k: int) -> Found:
    """Each group's first k by descending score, id and content; equal entries count once."""
    group, score, id_, content = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((content, id_, -score, group))
    all_ = np.stack([group[order].astype(np.uint64), score[order].view(np.uint64), id_[order].view(np.uint64), content[order]])
    new = np.ones(len(order), bool)
    new[1:] = (all_[:, 1:] != all_[:, :-1]).any(axis=0)
    order = order[new]
    starts = np.flatnonzero(np.diff(group[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[rank < k]
    return Found(group[order], score[order], id_[order], content[order])


def pack(anchors: Anchors, anchor: np.ndarray, kind: int, found: Found) -> pa.Array:
    keys = np.zeros(len(anchor), KEY)
    keys["anchor"] = anchors.id[anchor].view(np.uint64) ^ np.uint64(1 << 63)
    keys["anchor_content"] = anchors.content[anchor]
    keys["down"] = np.uint64(TOP) - found.score.view(np.uint64)
    keys["kind"] = kind
    keys["id"] = found.id.view(np.uint64) ^ np.uint64(1 << 63)
    keys["content"] = found.content
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(keys), [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())


def unpack(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, their scores and their ids."""
    keys = np.frombuffer(b"".join(x.as_py() for x in column), KEY)
    return keys, (np.uint64(TOP) - keys["down"].astype(np.uint64)).view(np.int64), (keys["id"].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def compare(batches: Iterator[pa.RecordBatch], anchors: Anchors, scale: float, kind: int, k: int,
            windows: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """Keys of a task's first k rows for each anchor (same label), or for each window of scores (other labels)."""
    per_anchor = 1 if windows is None else windows[0].shape[1]
    found, held = [], 0
    by_id = np.argsort(anchors.id, kind="stable")
    for batch in batches:
        for rows in read_rows(batch, anchors.labels, anchors.values.shape[1], scale):
            known: dict[int, int] = {}

            def content(r: int, rows=rows, known=known) -> int:
                if r not in known:
                    known[r] = rows.content(r)
                return known[r]

            own: dict[int, list[int]] = {}  # rows that are an anchor themselves
            lo, hi = np.searchsorted(anchors.id[by_id], rows.id), np.searchsorted(anchors.id[by_id], rows.id, "right")
            for r in np.flatnonzero(hi > lo):
                for a in by_id[lo[r]:hi[r]]:
                    if anchors.content[a] == content(r):
                        own.setdefault(int(a), []).append(int(r))
            step = max(1, BLOCK_VALUES // max(1, len(rows.id), anchors.values.shape[1]))
            for a in range(0, len(anchors.id), step):
                score = scores(anchors.values[a:a + step], rows.values)
                alike = anchors.label[a:a + step, None] == rows.label[None, :]
                for j in range(per_anchor):
                    if windows is None:
                        usable = alike
                        for x in range(a, min(a + step, len(anchors.id))):
                            usable[x - a, own.get(x, [])] = False
                    else:
                        usable = ~alike & (score >= windows[0][a:a + step, j, None]) & (score <= windows[1][a:a + step, j, None])
                    row, column = first_columns(score, usable, k)
                    codes = np.array([content(c) for c in column.tolist()], np.uint64)
                    found.append(Found((row + a) * per_anchor + j, score[row, column], rows.id[column], codes))
                    held += len(row)
            if held > 4 * k * per_anchor * len(anchors.id):
                found = [first_of_groups(found, k)]
                held = len(found[0].id)
    if held:
        best = first_of_groups(found, k)
        keys = pc.unique(pack(anchors, best.group // per_anchor, kind, best))
        for a in range(0, len(keys), 10_000):
            yield pa.record_batch([keys.slice(a, 10_000)], ["key"])


def by_anchor(keys: DataFrame) -> DataFrame:
    """The secondary sort: an anchor's keys in one partition, by descending score and id."""
    return keys.repartition(F.substring("key", 1, 16)).sortWithinPartitions("key")


def first_positives(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, last, n = None, None, 0
        for batch in batches:
            kept = []
            for key in batch.column(0).to_pylist():
                if key[:16] != anchor:
                    anchor, n = key[:16], 0
                if key != last and n < k:
                    kept.append(key)
                    n += 1
                last = key
            yield pa.record_batch([pa.array(kept, pa.binary())], ["key"])

    return stream


def open_windows(low: int, high: int, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Positives precede negatives of their score; a window ends when it is full or the scores fall below it."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, last, windows = None, None, []
        for batch in batches:
            rows = []
            keys, all_scores, all_ids = unpack(batch.column(0))
            anchor_ids = (keys["anchor"].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).tolist()
            for key, kind, who, score, id_ in zip(batch.column(0).to_pylist(), keys["kind"].tolist(), anchor_ids, all_scores.tolist(), all_ids.tolist()):
                if key == last:
                    continue
                last = key
                if key[:16] != anchor:
                    anchor, windows = key[:16], []
                if kind == POSITIVE:
                    windows.append([id_, score, 0])
                    continue
                windows = [w for w in windows if w[2] < k and low * w[1] <= 100 * score]
                for window in windows:
                    if 100 * score <= high * window[1]:
                        window[2] += 1
                        rows.append((who, window[0], window[2], id_, window[1], score))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.record_batch([pa.array(c, pa.int32() if f.name == "rank" else pa.int64()) for c, f in zip(columns, RESULT)], RESULT.names)

    return stream


def score_bounds(anchors: Anchors, positives: list[bytes], low: int, high: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of each anchor's windows; a missing window is empty."""
    place = {(int(i), int(c)): a for a, (i, c) in enumerate(zip(anchors.id, anchors.content))}
    least, most = np.full((len(anchors.id), k), TOP), np.full((len(anchors.id), k), -TOP)
    taken = [0] * len(anchors.id)
    if positives:
        keys, all_scores, _ = unpack(pa.array(positives, pa.binary()))
        ids = (keys["anchor"].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
        for i, c, score in zip(ids.tolist(), keys["anchor_content"].tolist(), all_scores.tolist()):
            a = place[i, c]
            least[a, taken[a]] = max(-TOP, min(TOP, -(-low * score // 100)))
            most[a, taken[a]] = max(-TOP, min(TOP, high * score // 100))
            taken[a] += 1
    return least, most


def anchor_groups(anchors: DataFrame, vector: str, limit: int) -> tuple[DataFrame, int]:
    """Anchors with a group number, few enough that no group's vectors, filled up to its widest, exceed `limit` bytes."""
    table = stored(anchors.withColumn("_code", F.xxhash64("*")), "anchors")
    n = 1
    while True:
        group = F.pmod(F.col("_code"), F.lit(n))
        largest = table.groupBy(group).agg((F.max(F.size(vector)).cast("long") * 8 * F.count("*")).alias("bytes"), F.count("*").alias("n")).agg(
            F.max("bytes"), F.max("n")).first()
        if (largest[0] or 0) <= limit or largest[1] == 1 or n >= 1 << 20:
            return table.withColumn("_group", group), n
        n *= 2


def load_anchors(rows: list, scale: float) -> Anchors:
    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                             pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["id", "label", "vector"])
    width = max((len(r[2]) for r in rows if r[2] is not None), default=0)
    blocks = list(read_rows(batch, None, width, scale))
    ids, names, values, contents = [], [], [], []
    for block in blocks:
        ids.append(block.id)
        names.extend(block.label)
        values.append(block.values)
        contents.extend(block.content(r) for r in range(len(block.id)))
    labels = sorted(set(names))
    places = {name: i for i, name in enumerate(labels)}
    return Anchors(np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(contents, np.uint64), np.array([places[n] for n in names], np.int64), labels,
                   np.concatenate(values) if values else np.zeros((0, width)))


def mine_negatives(rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = 256.0,
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each anchor and positive.

    A component x becomes floor(scale * x); a score is the whole inner product with the
    anchor, held within the range of a long. An anchor's positives are the first `positives`
    other rows of its label by descending score, then id; the negatives of one are the first
    `negatives` rows of other labels with low * positive <= 100 * negative <= high * positive
    scores. `high` is at most 100, so the descending stream meets a positive before the
    negatives of its window.

    Rows with a null id, label or vector or a component that is null or not finite take no
    part. Missing components of a shorter vector count as 0; an empty vector scores 0. Rows
    equal in id, label and vector count once, as an anchor, a positive or a negative; rows
    that share only their id are rows of their own, ordered by a hash of their content. An
    anchor without positives or negatives has no result. Other columns are left out.

    Anchors are taken in groups of at most `anchor_bytes` of vectors, one pass over the rows
    for the positives and one for the negatives of each group.
    """
    if high > 100:
        raise ValueError("negatives may not score above their positive")
    spark = rows.sparkSession
    plain = rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vector"), is_anchor.alias("chosen"))
    chosen = plain.filter("chosen AND id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").select("id", "label", "vector").distinct()
    anchors, n = anchor_groups(chosen, "vector", anchor_bytes)
    plain = plain.select("id", "label", "vector")
    out = scratch_path(spark, "negatives")
    spark.createDataFrame([], RESULT).write.parquet(out)
    for group in range(n):
        held = load_anchors(anchors.filter(F.col("_group") == group).select("id", "label", "vector").collect(), scale)
        if not len(held.id):
            continue
        sent = spark.sparkContext.broadcast(held)
        near = by_anchor(plain.mapInArrow(lambda b: compare(b, sent.value, scale, POSITIVE, positives, None), "key binary")).mapInArrow(first_positives(positives), "key binary")
        near = stored(near, "positives")
        bounds = spark.sparkContext.broadcast(score_bounds(held, [r[0] for r in near.collect()], low, high, positives))
        far = plain.mapInArrow(lambda b: compare(b, sent.value, scale, NEGATIVE, negatives, bounds.value), "key binary")
        by_anchor(near.unionByName(far)).mapInArrow(open_windows(low, high, negatives), RESULT).write.mode("append").parquet(out)
        sent.unpersist()
        bounds.unpersist()
    return spark.read.schema(RESULT).parquet(out)
