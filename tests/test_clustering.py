"""Density clustering against brute force, with duplicates, ties and every way of comparing cells."""

import numpy as np
import pytest

from faultline.operators import clustering


def brute(x, eps, least):
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label, c = -np.ones(len(x), int), 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], c
            while todo:
                for k in np.flatnonzero(near[todo.pop()] & core):
                    if label[k] < 0:
                        label[k] = c
                        todo.append(k)
            c += 1
    for i in np.flatnonzero(~core):
        touched = [label[k] for k in np.flatnonzero(near[i] & core)]
        label[i] = min(touched) if touched else -1
    return label


@pytest.mark.parametrize("dims,n,eps,exact", [(2, 250, 0.15, 20_000_000), (2, 300, 0.3, 1), (4, 200, 0.8, 1)])
def test_matches_brute_force(spark, monkeypatch, dims, n, eps, exact):
    monkeypatch.setattr(clustering, "EXACT_PAIRS", exact)
    rng = np.random.default_rng(dims * n)
    rows, want = [], {}
    for g in ("a", "b"):
        x = np.round(rng.normal(size=(n, dims)), 2)
        x[:40] = x[0]  # a group of copies
        for i, label in enumerate(brute(x, eps, 3)):
            rows.append((g, i, *[float(v) for v in x[i]]))
            want[g, i] = int(label)
    cols = [f"x{k}" for k in range(dims)]
    df = spark.createDataFrame(rows, "g STRING, i INT, " + ", ".join(f"{c} DOUBLE" for c in cols))
    for table in (df, df.orderBy("x0", "i")):
        got = {(r.g, r.i): r.cluster_id for r in clustering.dbscan(table, ["g"], cols, ["i"], eps, 3).collect()}
        assert got == want
        if exact == 1:
            break


def test_components_of_a_long_chain(spark):
    nodes = spark.range(60).toDF("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(58, 59)], "a LONG, b LONG")
    got = dict(map(tuple, clustering.connected_components(nodes, edges).collect()))
    assert got == {i: 0 if i < 40 else 58 if i >= 58 else i for i in range(60)}
