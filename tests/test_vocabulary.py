"""The vocabulary from merged summaries against counting all terms."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from faultline.operators import text


def docs_of(spark, words, seed, per_doc=40):
    rng = random.Random(seed)
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * per_doc:(i + 1) * per_doc])) for i in range(-(-len(words) // per_doc))]
    return spark.createDataFrame(rows, "d LONG, text STRING").repartition(7)


def vocabulary_of(words, size):
    top = sorted(Counter(words).items(), key=lambda x: (-x[1], x[0]))[:size]
    return sorted(t for t, _ in top)


@pytest.mark.parametrize("case,exact", [("steep", False), ("ties", True), ("even", True), ("few", False)])
def test_same_vocabulary_on_both_ways(spark, monkeypatch, case, exact):
    counts = {"steep": {f"w{i:04d}": 6000 // (i + 1) ** 2 + 1 for i in range(1000)}, "ties": {f"w{i:04d}": 30 if i < 6 else 7 for i in range(600)},
              "even": {f"w{i:04d}": 5 + i % 2 for i in range(900)}, "few": {"aa": 3, "bb": 1}}[case]
    words = [w for w, n in counts.items() for _ in range(n)]
    full = []
    plain = text.vocabulary
    monkeypatch.setattr(text, "vocabulary", lambda *a: full.append(1) or plain(*a))
    got = text.vocabulary_counts(docs_of(spark, words, 3), ["d"], size=20, tracked=10_000 if case == "steep" else 300)
    found = {r.term: (r.idx, r.n) for r in got.groupBy("idx", "term").agg(F.sum("tf").alias("n")).collect()}
    want = vocabulary_of(words, 20)
    assert found == {t: (i, counts[t]) for i, t in enumerate(want)}
    assert bool(full) == exact


def test_what_the_summary_leaves_out_is_no_more_frequent(spark):
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 5000}" for _ in range(40_000)]
    names, bound = text.heavy_terms(docs_of(spark, words, 1), size=20, tracked=200)
    assert max(n for w, n in Counter(words).items() if w not in set(names)) <= bound


def test_no_texts(spark):
    for rows in ([], [(1, None), (2, ""), (3, "a b c")]):
        df = spark.createDataFrame(rows, "d LONG, text STRING")
        assert text.tfidf(df, ["d"]).count() == 0
