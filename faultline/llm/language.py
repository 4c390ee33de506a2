"""Language identification with language-bitmask n-gram filters."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.words import FACTOR, giving_back, map_texts, mix, pieces, powers, stored

ORDERS = (1, 2, 3, 4, 5)
PROBES = 3
FLUSH = 1 << 19  # distinct grams a task holds before it passes their counts on
PREDICTION = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("grams", T.LongType())])


class Filters(NamedTuple):
    """slots[w, i]: bits of up to 64 languages each, for every filter slot."""
    langs: list
    slots: np.ndarray
    wrong: np.ndarray  # false-positive rate of each language


def letter_table() -> np.ndarray:
    """Code points that are letters or marks."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class Grams(NamedTuple):
    """A batch of texts as distinct words and their n-grams."""
    row: np.ndarray  # text of each word
    word: np.ndarray  # distinct word of each word
    of: np.ndarray  # distinct word of each n-gram
    gram: np.ndarray


def word_grams(texts: list, letters: np.ndarray) -> Grams:
    """The n-grams of the lower-cased words, with one blank at either end; each distinct word is cut up once."""
    joined = [f" {(t or '').lower()} " for t in texts]
    code = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in joined])
    inside = letters[code]
    start = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    length = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - start
    if not len(start):
        none = np.zeros(0, np.int64)
        return Grams(none, none, none, none.astype(np.uint64))
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    power = powers(0xD6E8FEB86659FD93, min(1 << 16, int(length.max()) + 1))
    hashes = np.add.reduceat(mix(code[inside].astype(np.uint64) * FACTOR) * power[place & 0xFFFF], at)
    _, chosen, word = np.unique(mix(hashes + length.astype(np.uint64)), return_index=True, return_inverse=True)
    size = length[chosen] + 2
    first = np.cumsum(size) - size
    of = np.repeat(np.arange(len(size)), size)
    code = code[np.arange(len(of)) - first[of] + (start[chosen] - 1)[of]].astype(np.uint64)
    code[first] = code[first + size - 1] = 32
    left = size[of] - (np.arange(len(of)) - first[of])  # entries from here to the end of the word
    value, found_of, found = np.zeros(len(code), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        value = value * np.uint64(0x110000 + 7) + np.roll(code, 1 - n) + np.uint64(n)
        if n in ORDERS:
            good = np.flatnonzero(left >= n) if n > 1 else np.flatnonzero(code != 32)
            found_of.append(of[good])
            found.append((mix(value[good] * FACTOR) & ~np.uint64(7)) | np.uint64(n))
    return Grams(row[start], word, np.concatenate(found_of), np.concatenate(found))


def count_grams(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram, n over all labelled rows; tasks pass on sums, not occurrences."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held, size = letter_table(), {}, 0

        def flush():
            for name, parts in held.items():
                gram, count = total(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram.view(np.int64)),
                                                  pa.array(count, pa.int64())], schema.names)
            held.clear()

        for batch in batches:
            for a, b in pieces(batch.column(0)):
                texts, names = batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist()
                for name in sorted(set(names)):
                    own = word_grams([t for t, x in zip(texts, names) if x == name], letters)
                    times = np.bincount(own.word)[own.of] if len(own.word) else own.of
                    held[name] = [total([*held.get(name, []), (own.gram, times)])]
                size = sum(len(p[0][0]) for p in held.values())
                if size > FLUSH:
                    yield from flush()
        yield from flush()

    counted = labelled.select(text, lang).mapInArrow(giving_back(run), schema)
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def total(parts: list) -> tuple[np.ndarray, np.ndarray]:
    gram, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return gram, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def learn_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                    rows_per_lang: int = 20_000, least_share: float = 2e-5, bits_per_gram: int = 16) -> Filters:
    """Filters from labelled rows; rows without text or language are left out.

    At most about `rows_per_lang` rows of each language are used, chosen by a hash of
    their key (the documented sample bound). A language keeps an n-gram when it makes up at
    least `least_share` of the language's n-grams of that length, and at least two of them,
    so it holds at most 5 / least_share of them however much text there is, and the filter is
    bounded by the number of languages. Ties in nothing: the sets do not depend on row order.
    """
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_lang / n))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    counts = stored(count_grams(rows.filter(draw < share[F.col(lang)]), text, lang), "language-grams")
    order = F.col("gram").bitwiseAND(7)
    sums = counts.groupBy("lang", order.alias("_o")).agg(F.sum("n").alias("_all")).withColumnRenamed("lang", "_l")
    kept = counts.join(F.broadcast(sums), (F.col("lang") == F.col("_l")) & (order == F.col("_o"))).filter(
        (F.col("n") >= 2) & (F.col("n") >= F.col("_all") * least_share)).select("lang", "gram").toPandas()
    sets = {name: group.to_numpy().astype(np.int64).view(np.uint64) for name, group in kept.groupby("lang")["gram"]}
    most = max((len(g) for g in sets.values()), default=1)
    width = 1 << int(np.ceil(np.log2(max(64, most * bits_per_gram))))
    slots = np.zeros((-(-len(langs) // 64), width), np.uint64)
    wrong = np.zeros(len(langs))
    for i, name in enumerate(langs):
        bit = np.uint64(1 << (i % 64))
        for places in probes(sets.get(name, np.zeros(0, np.uint64)), width):
            slots[i // 64][places] |= bit
        wrong[i] = np.mean((slots[i // 64] & bit) != 0) ** PROBES
    return Filters(langs, slots, wrong)


def probes(grams: np.ndarray, width: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield (mix(grams + np.full(1, k + 1, np.uint64) * FACTOR) & np.uint64(width - 1)).astype(np.int64)


def languages_of(grams: np.ndarray, filters: Filters) -> np.ndarray:
    """Bit masks (groups of 64 languages x grams): every language that holds the gram, in one probe per hash."""
    found = np.full((len(filters.slots), len(grams)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for places in probes(grams, filters.slots.shape[1]):
        found &= filters.slots[:, places]
    return found


def predict_language(docs: DataFrame, filters: Filters, text: str = "text", out: str = "language") -> DataFrame:
    """Adds struct `language`: lang, score (0 to 1), grams (n-grams of the text).

    The filter returns all languages of each n-gram; their counts, less the false positives
    expected of each language's filter, decide. score is the corrected share of the text's
    n-grams that the chosen language holds. A text that is null or has no letters is `und` with
    score 0, and so is all text if no language was learned; with letters but no known
    n-gram, or on a tie, the first language by name wins. Columns of `docs` pass
    through, an older `language` is replaced; repeated rows stay.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters._asdict())

    def start():
        letters, known = letter_table(), Filters(**sent.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            own = word_grams(texts.to_pylist(), letters)
            distinct = int(own.word.max(initial=-1)) + 1
            n = np.bincount(own.row, np.bincount(own.of, minlength=distinct)[own.word], len(texts)).astype(np.int64)
            if not known.langs:
                return [pa.array(["und"] * len(texts)), pa.array(np.zeros(len(texts))), pa.array(n, pa.int64())]
            found = languages_of(own.gram, known)
            share = np.zeros((len(known.langs), len(texts)))
            for i in range(len(known.langs)):
                held = (found[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits = np.bincount(own.row, np.bincount(own.of, held.astype(np.float64), distinct)[own.word], len(texts))
                share[i] = (hits - n * known.wrong[i]) / np.maximum(n * (1 - known.wrong[i]), 1e-9)
            best = share.argmax(axis=0)
            score = np.where(n > 0, np.clip(share[best, np.arange(len(texts))], 0, 1), 0.0)
            names = [known.langs[b] if k else "und" for b, k in zip(best, n)]
            return [pa.array(names, pa.string()), pa.array(score), pa.array(n, pa.int64())]

        return work

    return map_texts(docs, text, out, PREDICTION, start)
