import random

import pytest
from brute import components

from faultline.llm import jaccard_join


def result(df):
    key = lambda r: tuple((x is not None, x) for x in r)
    return sorted(((r.id, r.n, r.component) for r in df.collect()), key=key), key


def check(docs, source, **options):
    got, key = result(jaccard_join.near_duplicates(docs, **options))
    assert got == sorted(components(source), key=key)
    return got


def edited(draw, words, rate):
    return " ".join(f"x{draw.randrange(10**6)}" if draw.random() < rate else w for w in words)


def cluster(seed, copies=60):
    """Chains and groups of near copies around the border of 0.8, exact copies and boilerplate."""
    draw = random.Random(seed)
    rows, number = [], 0
    for _ in range(4):
        words = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([12, 60, 200]))]
        for _ in range(copies // 4):
            if draw.random() < 0.3:
                words = edited(draw, words, 0.03).split()  # the group drifts
            rows.append((number, edited(draw, words, draw.choice([0, 0.005, 0.02, 0.03, 0.05]))))
            number += 1
    line = " ".join(f"b{i}" for i in range(40))
    rows += [(number + i, line + " " + " ".join(f"u{draw.randrange(10**6)}" for _ in range(30))) for i in range(20)]
    draw.shuffle(rows)
    return rows


def test_whole_table(spark, small, corpus):
    assert len({r[2] for r in check(spark.read.parquet(f"{small}/documents.parquet"), corpus)}) < len(corpus)


@pytest.mark.parametrize("seed", range(2))
def test_groups_of_near_copies(make, seed):
    rows = cluster(seed)
    check(make(rows), rows)


def test_frequent_path_small_groups_and_no_table(make, monkeypatch):
    rows = cluster(7)
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    monkeypatch.setattr(jaccard_join, "GROUP", 3)
    monkeypatch.setattr(jaccard_join, "SEEN", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 500)
    check(make(rows).repartition(5), rows)
    check(make(rows), rows, frequent=0)


def test_every_pair_is_found_without_the_star(make, monkeypatch):
    """The second round alone is complete."""
    rows = cluster(3)
    monkeypatch.setattr(jaccard_join, "star_pairs", lambda entries, share: entries.select("sig", jaccard_join.F.col("sig").alias("centre")).filter("false"))
    check(make(rows), rows)


def test_edges(make):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b c"), (9, "A B\u000bC"), (5, "a b c d"), (6, "a b c d e"), (6, "a b c d e"),
            (None, "a b c d e"), (None, "only one without id here x"), (None, None), (10, "x"), (7, "y " * 200_000), (8, "y y y y y")]
    check(make([(i, t, "extra", "n") for i, t in rows], "id long, text string, sig string, n string").withColumnRenamed("id", "doc_id"), rows)


def test_empty(make):
    assert jaccard_join.near_duplicates(make([])).collect() == []
