"""The language model's array steps: equal to the plain formulas; weight rows are sorted by 16-bit keys where they fit."""

import numpy as np
import pytest

from faultline.llm import maxent_lm


def model(rows=1 << 12, width=64, classes=32, seed=3):
    rng = np.random.default_rng(seed)
    columns = classes + maxent_lm.TAIL
    return maxent_lm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), width, rng.normal(size=columns).astype(np.float32),
                           rng.normal(size=(classes, width)).astype(np.float32), rng.normal(size=(rows, columns)).astype(np.float32),
                           rng.normal(size=(rows, width)).astype(np.float32))


def batch(own, n=4000, seed=5):
    rng = np.random.default_rng(seed)
    size = 32 * own.width
    rank = rng.integers(0, size + maxent_lm.TAIL, n)
    return own.features(rank, np.array([0, n // 3, n]))


def test_logs_equal_the_plain_softmax():
    own = model()
    kind, place, rows, before = batch(own)
    p, q = own.logs(kind, place, rows, before)
    x = own.class_bias.astype(float) + sum(own.a[r].astype(float) for r in rows)
    assert np.allclose(p, x[np.arange(len(kind)), kind] - np.log(np.exp(x).sum(axis=1)), atol=1e-4)
    inside = np.flatnonzero(place >= 0)
    w = own.word_rows(before[:, inside], kind[inside])
    y = own.word_bias[kind[inside]].astype(float) + sum(own.b[r].astype(float) for r in w)
    assert np.allclose(q[inside], y[np.arange(len(inside)), place[inside]] - np.log(np.exp(y).sum(axis=1)), atol=1e-4)
    assert (q[place < 0] == 0).all()


@pytest.mark.parametrize(("bits", "key"), [(16, 2), (17, 8)])
def test_weight_rows_are_sorted_by_the_narrowest_keys(monkeypatch, bits, key):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 1 << bits, (3, 500))
    rows[1, :50], rows[2, :50] = rows[0, :50] ^ (1 << bits - 1), rows[0, :50]
    gradient = rng.normal(size=(500, 8)).astype(np.float32)
    weights, memory = np.zeros((1 << bits, 8), np.float32), np.zeros((1 << bits, 8), np.float32)
    widths, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **options: (widths.append(a.dtype.itemsize), argsort(a, **options))[1])
    maxent_lm.update(weights, memory, rows, gradient, 0.5)
    assert widths == [key]
    total = np.zeros((1 << bits, 8))
    for feature in rows:
        np.add.at(total, feature, gradient.astype(float))
    assert np.allclose(memory, total * total, atol=1e-3)
    assert np.allclose(weights, -0.5 * total / np.sqrt(total * total + 1e-2), atol=1e-3)
