"""A Bloom filter over 64-bit numbers that tasks fill together; a hit too many only costs work."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.words import mix

PER_ENTRY = 16
MOST_BITS = 1 << 30  # 128 MB; beyond it the filter lets more through, and no entry is lost


def places(numbers: np.ndarray, size: int) -> list[np.ndarray]:
    x = numbers.astype(np.int64, copy=False).view(np.uint64)
    return [(mix(x + np.full(1, k, np.uint64)) & np.uint64(size - 1)).astype(np.int64) for k in (1, 2, 3)]


def fill(numbers: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Filter words for the one long column of `numbers`; its size follows the count up to `most_bits`."""
    size = 1 << 16
    count = numbers.count()
    while size < most_bits and size < PER_ENTRY * count:
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                at = np.concatenate(places(batch.column(0).to_numpy(), size))
                word, place = np.unique(at >> 6, return_inverse=True)
                held = np.zeros(len(word), np.uint64)
                np.bitwise_or.at(held, place, np.uint64(1) << (at & 63).astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(held.view(np.int64))], ["word", "bits"])

    words = numbers.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(size // 64, np.uint64)
    out[words["word"].to_numpy().astype(np.int64)] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def holds(numbers: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Which numbers the filter may hold."""
    good = np.ones(len(numbers), bool)
    for at in places(numbers, len(filled) * 64):
        good &= (filled[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return good
