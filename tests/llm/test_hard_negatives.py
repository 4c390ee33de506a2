import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultline.llm import hard_negatives
from faultline.llm.hard_negatives import mine_negatives
from faultline.llm.queries import QUERIES

ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows, chosen):
    """Every rule read off the contract, pair by pair, in whole Python numbers."""
    whole = {(i, tuple(v), l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(256 * x) for x in v], l, n) for n, (i, v, l) in enumerate(sorted(whole))]
    out = []
    for i, v, label, n in whole:
        if not chosen(i):
            continue
        score = {m: max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))) for _, w, _, m in whole}
        ranked = sorted((r for r in whole if r[3] != n), key=lambda r: (-score[r[3]], r[0]))
        for p in [r for r in ranked if r[2] == label][:5]:
            ps = score[p[3]]
            fit = [r for r in ranked if r[2] != label and 80 * ps <= 100 * score[r[3]] <= 100 * ps][:5]
            out += [(i, p[0], k + 1, r[0], ps, score[r[3]]) for k, r in enumerate(fit)]
    return sorted(out)


def mined(spark, rows, step=10, parts=3, schema=ROWS, **how):
    table = spark.createDataFrame(rows, schema).repartition(parts)
    return sorted(tuple(r) for r in mine_negatives(table, F.col("vec_id") % step == 0, **how).collect())


@pytest.fixture(scope="module")
def near_rows():
    """Close vectors, so windows are full; few different values, so scores tie."""
    rng = random.Random(5)
    return [(i, [rng.choice([0.5, 0.25, 0.125, -0.125]) for _ in range(6)], rng.randrange(4)) for i in range(240)]


def test_whole_table(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    turned = [(i, v, (l + 1) % 10 if i % 7 == 0 else l) for i, v, l in rows]
    assert sorted(tuple(r) for r in QUERIES["op11_hard_negatives"](spark, small).collect()) == brute(turned, lambda i: i % 100 == 0)


def test_ties_and_anchor_groups(spark, near_rows):
    expected = brute(near_rows, lambda i: i % 10 == 0)
    assert len(expected) > 300
    assert mined(spark, near_rows) == expected
    assert mined(spark, near_rows, parts=7, anchor_bytes=200) == expected


def test_small_blocks(spark, near_rows, monkeypatch):
    """Blocks of a few rows; the test calls the task's function itself, as tasks have their own copy of the module."""
    monkeypatch.setattr(hard_negatives, "BLOCK_VALUES", 40)
    held = hard_negatives.load_anchors([(i, str(l), v) for i, v, l in near_rows if i % 10 == 0], 256.0)
    batch = pa.record_batch([pa.array([r[0] for r in near_rows]), pa.array([str(r[2]) for r in near_rows]), pa.array([r[1] for r in near_rows])], ["id", "label", "vector"])
    near = b"".join(k.as_py() for b in hard_negatives.compare(iter([batch]), held, 256.0, hard_negatives.POSITIVE, 5, None) for k in b.column(0))
    want = sorted({(a, p, s) for a, p, _, _, s, _ in brute(near_rows, lambda i: i % 10 == 0)})
    keys, score, ids = hard_negatives.unpack(pa.array([near[i:i + 41] for i in range(0, len(near), 41)]))
    anchors = (keys["anchor"].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    assert set(want) <= set(zip(anchors.tolist(), ids.tolist(), score.tolist()))
    assert len(keys) == 5 * len(held.id)
    assert mined(spark, near_rows) == brute(near_rows, lambda i: i % 10 == 0)


def test_nulls_infinities_and_lengths(spark):
    rows = [(0, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.5], 1), (3, [], 1), (4, [0.5, 0.45, 9.0], 2), (5, [0.49, None], 2), (6, [math.inf, 0.5], 2),
            (7, [math.nan, 0.5], 1), (8, None, 1), (9, [0.5, 0.5], None), (None, [0.5, 0.5], 2), (10, [], 2), (11, [0.44, 0.3], 3), (12, [-0.0, 0.0], 3)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []


def test_repeated_rows_count_once_and_shared_ids_are_rows(spark):
    rows = [(0, [1.0, 0.0], 1)] * 3 + [(1, [0.9, 0.0], 1)] * 4 + [(2, [0.8, 0.1], 2)] * 9 + [(2, [0.8, 0.2], 2), (0, [0.85, 0.0], 1), (0, [0.86, 0.0], 3), (3, [0.75, 0.0], 2)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0) != []


def test_large_numbers(spark):
    rows = [(i, [2.0**e * (1 + i / 64), 3.0], i % 2) for e in (40, 300) for i in range(0, 20)]
    assert mined(spark, rows, parts=2) == brute(rows, lambda i: i % 10 == 0) != []


def test_half_of_all_rows_are_one_vector(spark):
    rows = [(i, [0.5, 0.5], 1) for i in range(400)] + [(i, [0.5, 0.4 + i / 4000], 2 + i % 3) for i in range(400, 800)]
    assert mined(spark, rows, step=100) == brute(rows, lambda i: i % 100 == 0) != []


def test_empty_and_clashing_columns(spark):
    schema = ROWS + ", key string, chosen int, _group int, id string, vector string"
    assert mined(spark, [], schema=schema) == []
    rows = [(i, [0.5, i / 100], i % 2, "k", 0, 7, "x", "y") for i in range(30)]
    assert mined(spark, rows, schema=schema) == brute([r[:3] for r in rows], lambda i: i % 10 == 0) != []
