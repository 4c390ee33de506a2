"""Words of UTF-8 texts as numpy arrays: the shared first step of the operators on word windows.

Texts come as Arrow strings, so a batch is one byte buffer; words, their hashes and the
hashes of word windows are array operations over it. Two words are taken as equal when
their 64-bit hashes are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import scratch_path

PIECE_BYTES = 2 << 20  # text handled at once inside a task
HASH_BYTES = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    start: np.ndarray  # first byte of each word in `raw`
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # index of the first word of each text, and the number of words at the end
    raw: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def between_spaces() -> np.ndarray:
    """Byte table of `[^\\x20\\x09-\\x0D]`."""
    table = np.ones(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def letters_and_digits() -> np.ndarray:
    """Byte table of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased."""
    table = np.zeros(256, bool)
    table[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    return table


def words_of(texts: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """All words of a batch of texts; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = table[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(raw)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    code = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * FACTOR)
    if lower:
        code[0x41:0x5B] = code[0x61:0x7B]
    length = end - start
    hashes = np.zeros(len(start), np.uint64)
    power = powers(0xD6E8FEB86659FD93, min(1 << 16, int(length.max(initial=0)) + 1))
    total = np.cumsum(length)
    a = 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(total, total[a] - length[a] + HASH_BYTES, "right")))
        own = length[a:b]
        at = np.cumsum(own) - own
        place = np.arange(int(own.sum())) - np.repeat(at, own)
        value = code[raw[place + np.repeat(start[a:b], own)]] * power[place & 0xFFFF]
        hashes[a:b] = np.add.reduceat(value, at)
        a = b
    hashes = mix(hashes + length.astype(np.uint64) * FACTOR)
    return Words(start, end, hashes, np.searchsorted(start, offsets), raw)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` entries (also those that cross texts); one linear pass."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = 0xA24BAED4963EE407
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=sums[1:])
    back = powers(pow(base, -1, 1 << 64), n)
    return mix((sums[size:] - sums[:n]) * back + np.uint64(size))


def within(first: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of the first `n` runs of `size` words lie inside one text."""
    room = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + size <= room


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer text is a range of its own."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else np.zeros(0)
    a = 0
    while a < len(texts):
        base = size[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(size, base + limit, "right")))
        yield a, b
        a = b


def give_back() -> None:
    """Returns freed memory to the system. Python workers outlive their tasks, and what they keep adds up over the stages of a job."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same task function, before and after which its worker gives back freed memory.

    Spark lets idle workers take turns, so one that kept its peak would do so beside those that work.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        yield from run(batches)
        give_back()

    return task


def map_texts(df: DataFrame, text: str, out: str, kind: T.StructType,
              start: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """Adds the struct column `out` (an older one of that name goes), computed from column `text`.

    `start` runs once in each task and returns the function from a batch of texts to the
    fields. All other columns and repeated rows pass through as they are.
    """
    kept = df.drop(out)
    schema = T.StructType([*kept.schema.fields, T.StructField(out, kind)])
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in pieces(column):
                made = pa.StructArray.from_arrays(work(column.slice(a, b - a)), names)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*batch.schema.names, out])

    return kept.mapInArrow(giving_back(run), schema)


def lists(values: np.ndarray, per_row: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow lists from flat values and the number of values in each row."""
    ends = np.zeros(len(per_row) + 1, np.int32)
    np.cumsum(per_row, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, kind))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later jobs and lost executors start from it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_rest(column: str, divisor: int):
    """crc32 of a number written as text, modulo `divisor`; a null has the remainder of an empty text (0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor
