import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import LOWER, SPACED
from pyspark.sql import functions as F

from faultline.llm import maxent_lm, queries
from faultline.llm.words import between_spaces, crc_rest, words_of


def plain(rows, training):
    """doc text -> (n_tokens, n_known, N, base score)."""
    split = lambda t: [*SPACED.findall((t or "").translate(LOWER)), None]
    counts = Counter(w for t in training for w in split(t))
    n, v = sum(counts.values()), len(counts)
    out = {}
    for t in rows:
        words = split(t)
        out[t] = (len(words), sum(counts[w] > 0 for w in words), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
    return out


def check(df, training):
    rows = df.collect()
    want = plain([r.copy for r in rows], training)
    for r in rows:
        n, known, total, base = want[r.copy]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9) and r.score < 0
    return rows


def test_whole_table_beats_the_base_on_held_out_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.col("text").alias("copy"), (crc_rest("doc_id", 7) == 2).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    rows = check(maxent_lm.score_texts(docs, training, shares=4), [r.text for r in training.collect()])
    held = [r for r in rows if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_joined_counts_equal_sent_ones(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.col("text").alias("copy"))
    training = docs.filter(crc_rest("doc_id", 7) != 2)
    one, other = ({(r.doc_id, r.copy): r for r in check(maxent_lm.score_texts(docs, training, rounds=0, known=k, classes=4, width=5), [r.text for r in training.collect()])} for k in (1 << 20, 50))
    assert all(one[k].score == pytest.approx(other[k].score, rel=1e-9) for k in one)


def test_probabilities_sum_to_one():
    """Over all classes, over all words of a class, and over the tail's words and its unknown event."""
    draw = np.random.default_rng(1)
    model = maxent_lm.Model(np.array([3, 7, 9], np.uint64), np.array([0, 2, 1]), 2, draw.normal(size=2 + maxent_lm.TAIL).astype(np.float32),
                            np.array([[0, 1], [0, -1e9]], np.float32), draw.normal(size=(64, 2 + maxent_lm.TAIL)).astype(np.float32), draw.normal(size=(64, 2)).astype(np.float32))
    rank = np.array([0, 1, 2, 5, 0])
    kind, place, rows, before = model.features(rank, np.array([0, 5]))
    total = np.zeros(5)
    for k in range(2 + maxent_lm.TAIL):
        for w in ([0, 1] if k < 2 else [-1]):
            p, q = model.logs(np.full(5, k), np.full(5, w), rows, before)
            total += np.exp(p + q)
    assert total == pytest.approx(np.ones(5), abs=1e-5)


def test_features_do_not_cross_texts():
    model = maxent_lm.Model(np.zeros(0, np.uint64), np.zeros(0, int), 2, np.zeros(1 + maxent_lm.TAIL, np.float32), np.zeros((1, 2), np.float32),
                            np.zeros((64, 1 + maxent_lm.TAIL), np.float32), np.zeros((64, 2), np.float32))

    def rows_of(texts):
        hashes, tail, first = maxent_lm.tokens(words_of(pa.array(texts), between_spaces(), lower=True))
        return model.features(model.ranks(hashes, tail), first)[2]

    alone = np.concatenate([rows_of([t]) for t in ("a b c", None, "d", "e f")], axis=1)
    assert (rows_of(["a b c", None, "d", "e f"]) == alone).all()


def test_edges(make):
    rows = [(1, None), (2, ""), (3, "a b\u000bA"), (3, "a b\u000bA"), (None, "x y"), (4, "w " * 100_000), (5, "unseen words only")]
    docs = make([(d, t, t) for d, t in rows], "doc_id long, text string, copy string").withColumn("score", F.lit("old"))
    training = docs.filter("doc_id in (1, 2, 3)")
    got = check(maxent_lm.score_texts(docs, training, rounds=2, shares=2), [None, "", "a b\u000bA", "a b\u000bA"])
    assert len(got) == len(rows) and len({r.score for r in got if r.doc_id == 3}) == 1
    check(maxent_lm.score_texts(docs, docs.filter("false")), [])
    assert maxent_lm.score_texts(make([]), training).collect() == []


def test_every_training_text_is_trained_on_by_default(make):
    """Each text has word pairs of its own; a text without gradient steps keeps its untrained score."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(4)) + " ") for i in range(48)]
    docs = make([(i, t * 50) for i, t in rows], "doc_id long, text string")
    trained, plain = ({r.doc_id: r.score for r in maxent_lm.score_texts(docs, docs, **o).collect()} for o in ({}, {"rounds": 0}))
    assert all(trained[i] > 0.99 * plain[i] for i, _ in rows)
    with pytest.raises(ValueError):
        maxent_lm.score_texts(docs, docs, rounds=4, shares=16)


def test_query_beats_the_base_on_held_out_texts(spark, small):
    held = [r for r in queries.op1_maxent_lm(spark, small).collect() if r.held_out]
    assert len(held) > 10 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_sizes_grow_with_the_distinct_tokens():
    assert maxent_lm.sizes(1000) == (64, 1 << 14) and maxent_lm.sizes(1 << 20) == (88, 1 << 16) and maxent_lm.sizes(1 << 30) == (128, 1 << 16)


def test_tasks_of_a_round_follow_the_tokens(spark, small, monkeypatch):
    assert [maxent_lm.round_tasks(n, 4) for n in (0, 1, 20_000_000, 20_000_001, 2_000_000_000)] == [1, 1, 1, 2, 100]
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.col("text").alias("copy")).repartition(9)
    monkeypatch.setattr(maxent_lm, "TASK_TOKENS", 4_000)
    training = docs.filter(crc_rest("doc_id", 7) != 2)
    rows = check(maxent_lm.score_texts(docs, training, shares=4), [r.text for r in training.collect()])
    assert len(rows) == docs.count()
