"""Benchmark decontamination by winnowing: shared fingerprints of documents and test items, extended to whole hits."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.words import letters_and_digits, lists, map_texts, windows, within, words_of

SPAN = T.StructType([T.StructField("from", T.IntegerType()), T.StructField("until", T.IntegerType()),
                     T.StructField("item", T.StringType())])
HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)),
                     T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))])
PAIRS = 1 << 19  # fingerprint pairs compared at once


class Index(NamedTuple):
    """Words and fingerprints of one block of items."""
    window: int
    gram: int
    ids: list  # item ids as text, null for a null id
    word: np.ndarray
    item: np.ndarray  # item of each word
    prints: np.ndarray  # sorted fingerprints of the items with a whole window
    at: np.ndarray  # their word positions
    short: dict  # length -> (sorted hashes, items) of the items with fewer words


def winnow(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the last least gram of every `width` neighbouring ones."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        better = grams[j:j + n] <= least
        least[better] = grams[j:j + n][better]
        at[better] = np.flatnonzero(better) + j
    return at[np.flatnonzero(np.diff(at, prepend=-1))]


def winnow_texts(hashes: np.ndarray, first: np.ndarray, gram: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their word positions; each text is winnowed on its own.

    Grams that cross texts count as largest, so they never displace one inside a text.
    A window of `width` grams inside one text therefore yields its own least gram.
    """
    grams = windows(hashes, gram)
    grams[~within(first, gram, len(grams))] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = winnow(grams, width)
    at = at[grams[at] != np.uint64(0xFFFFFFFFFFFFFFFF)]
    return grams[at], at


def build_index(rows: list, window: int, gram: int) -> Index:
    """Fingerprints of a block of (item id as text, text) rows."""
    words = words_of(pa.array([r[1] for r in rows], pa.string()), letters_and_digits(), lower=True)
    count = np.diff(words.first)
    item = np.repeat(np.arange(len(rows)), count)
    prints, at = winnow_texts(words.hash, words.first, gram, window - gram + 1)
    whole = count[item[at]] >= window
    prints, at = prints[whole], at[whole]
    order = np.argsort(prints, kind="stable")
    short = {}
    for n in range(1, window):
        own = np.flatnonzero(count == n)
        if len(own):
            hashes = windows(words.hash, n)[words.first[own]]
            by = np.argsort(hashes, kind="stable")
            short[n] = (hashes[by], own[by])
    return Index(window, gram, [r[0] for r in rows], words.hash, item, prints[order], at[order], short)


def matches(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (position in keys, position in sorted table) of equal values."""
    low, high = np.searchsorted(table, keys, "left"), np.searchsorted(table, keys, "right")
    count = high - low
    left = np.repeat(np.arange(len(keys)), count)
    place = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
    return left, np.repeat(low, count) + place


def extend(words: np.ndarray, text: np.ndarray, p: np.ndarray, index: Index, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each pair of equal grams agrees to either side, as far as a window with the gram reaches."""
    reach = []
    for step in (-1, 1):
        alive, length = np.ones(len(p), bool), np.zeros(len(p), np.int64)
        edge = 0 if step < 0 else index.gram - 1
        for j in range(1, index.window - index.gram + 1):
            a, b = p + edge + step * j, q + edge + step * j
            alive &= (a >= 0) & (a < len(words)) & (b >= 0) & (b < len(index.word))
            a, b = np.where(alive, a, p), np.where(alive, b, q)
            alive &= (words[a] == index.word[b]) & (text[a] == text[p]) & (index.item[b] == index.item[q])
            length += alive
        reach.append(length)
    return reach[0], reach[1]


def find_spans(words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, item) of every occurrence of an item window, overlapping ones joined per fingerprint."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    found = []
    if len(index.prints):
        prints, at = winnow_texts(words.hash, words.first, index.gram, index.window - index.gram + 1)
        likely = np.isin(prints, index.prints)
        prints, at = prints[likely], at[likely]
        count = np.searchsorted(index.prints, prints, "right") - np.searchsorted(index.prints, prints, "left")
        total, a = np.cumsum(count), 0
        while a < len(prints):
            b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + PAIRS, "right")))
            left, right = matches(prints[a:b], index.prints)
            p, q = at[a:b][left], index.at[right]
            before, after = extend(words.hash, text, p, index, q)
            full = before + index.gram + after >= index.window
            spans = np.stack([(p - before)[full], (p + index.gram + after)[full], index.item[q[full]]], 1)
            found.append(np.unique(spans, axis=0))
            a = b
    for n, (hashes, items) in index.short.items():
        grams = windows(words.hash, n)
        likely = np.flatnonzero(within(words.first, n, len(grams)) & np.isin(grams, hashes))
        left, right = matches(grams[likely], hashes)
        found.append(np.stack([likely[left], likely[left] + n, items[right]], 1))
    spans = np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)
    return spans[:, 0], spans[:, 1], spans[:, 2]


def item_blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> list:
    """Blocks of items of about `block_bytes` of text each, as functions that fetch their rows."""
    rows = benchmark.select(F.col(item).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // block_bytes))
    return [rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = 13, gram: int = 5, block_bytes: int = 32 << 20, out: str = "hits") -> DataFrame:
    """Adds struct `hits`: n_words, spans (from, until, item) of word positions, n_hit, items (sorted ids).

    Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A window is
    `window` consecutive words of an item; an item of fewer words, but not none, is one window
    itself. Of every `window - gram + 1` neighbouring grams the last least hash is kept on
    both sides, so every shared window holds a shared fingerprint, which is extended
    word by word. The items are the stated query set: they are sent to the tasks in blocks of
    `block_bytes` of text, one pass each, whatever their number; documents are not shuffled.
    A null or empty text has no words and no hits; the text of an item with a null id can hit
    but is not listed; repeated rows stay; an empty benchmark hits nothing. Columns of
    `docs` pass through, an older `hits` is replaced.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must lie between 1 and window")
    sc = docs.sparkSession.sparkContext
    found = docs
    for number, block in enumerate(item_blocks(benchmark, item, item_text, block_bytes)):
        index = sc.broadcast(build_index([tuple(r) for r in block.collect()], window, gram)._asdict())
        found = one_block(found, text, index, out if number == 0 else f"_{out}_more")
        if number:
            merged = F.col(out).withField("spans", F.concat(f"{out}.spans", f"_{out}_more.spans"))
            found = found.withColumn(out, merged).drop(f"_{out}_more")
    return totals(found, out)


def one_block(docs: DataFrame, text: str, index, out: str) -> DataFrame:
    kind = T.StructType(HITS.fields[:2])

    def start():
        table, block = letters_and_digits(), Index(**index.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            words = words_of(texts, table, lower=True)
            a, b, item = find_spans(words, block)
            row = np.searchsorted(words.first, a, "right") - 1
            order = np.lexsort((item, b, a))
            a, b, item, row = a[order], b[order], item[order], row[order]
            base = words.first[row]
            per_row = np.bincount(row, minlength=len(texts))
            spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int32()), pa.array(b - base, pa.int32()),
                                                pa.array([block.ids[i] for i in item], pa.string())], SPAN.names)
            ends = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
            return [pa.array(np.diff(words.first), pa.int64()), pa.ListArray.from_arrays(ends, spans)]

        return work

    return map_texts(docs, text, out, kind, start)


def totals(found: DataFrame, out: str) -> DataFrame:
    """Hit words (spans overlap) and the distinct items of each row."""
    spans = F.array_sort(f"{out}.spans")
    begin = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def covered(s, x):
        grown = F.greatest(F.lit(0), x["until"] - F.greatest(s["end"], x["from"]))
        return F.struct((s["n"] + grown).alias("n"), F.greatest(s["end"], x["until"]).alias("end"))

    n_hit = F.aggregate(spans, begin, covered, lambda s: s["n"])
    items = F.array_sort(F.array_distinct(F.filter(F.transform(f"{out}.spans", lambda x: x["item"]), lambda x: x.isNotNull())))
    return found.withColumn(out, F.struct(F.col(f"{out}.n_words").alias("n_words"), F.col(f"{out}.spans").alias("spans"),
                                          n_hit.alias("n_hit"), items.alias("items")))


def is_contaminated(out: str = "hits"):
    return (F.col(f"{out}.n_hit") > 0) & (20 * F.col(f"{out}.n_hit") >= F.col(f"{out}.n_words"))
