import random

import pytest
from brute import repeats

from faultline.llm import bloom, substring_dedup


def check(df, source, window=50):
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in df.select("doc_id", "parsed.n_words", "parsed.n_removed", "parsed.kept").collect())
    assert got == sorted((str(d), n, m, k) for d, n, m, k in repeats(source, window))
    return got


def test_whole_table(spark, small, corpus):
    assert any(r[2] for r in check(substring_dedup.deduplicate(spark.read.parquet(f"{small}/documents.parquet")), corpus))


@pytest.mark.parametrize("seed", range(3))
def test_passages_pieced_together(make, monkeypatch, seed):
    """Factors of several references that meet or overlap, in a small alphabet with many equal grams."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 200)
    monkeypatch.setattr(substring_dedup, "GRAM", 3)
    draw = random.Random(seed)
    stock = [draw.choice("abc") if seed else f"w{draw.randrange(40)}" for _ in range(400)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(draw.randrange(5)):
            a = draw.randrange(390)
            words += stock[a:a + draw.randrange(30)] + [f"u{draw.randrange(10**6)}"] * draw.randrange(2)
        rows.append((i, " ".join(words)))
    draw.shuffle(rows)
    check(substring_dedup.deduplicate(make(rows).repartition(4), window=12), rows, 12)


def test_a_full_filter_changes_nothing(make, monkeypatch, corpus):
    monkeypatch.setattr(bloom, "fill", lambda numbers: bloom.np.full(1 << 4, 0xFFFFFFFFFFFFFFFF, bloom.np.uint64))
    check(substring_dedup.deduplicate(make(corpus[:80])), corpus[:80])


def test_edges(make):
    long = " ".join(f"w{i}" for i in range(120_000))
    part = " ".join(f"w{i}" for i in range(70_000, 70_060))
    rows = [(5, long), (9, part), (9, part), (2, " ".join(f"w{i}" for i in range(70_005, 70_055))), (None, part), (None, None),
            (3, None), (4, ""), (6, " \n\t"), (7, "a b\u000bc"), (8, "x " * 49), (11, "x " * 50), (12, "x " * 51)]
    docs = make([(d, t, "k", "p") for d, t in rows], "doc_id long, text string, _first string, parsed string")
    check(substring_dedup.deduplicate(docs), rows)


def test_empty(make):
    assert substring_dedup.deduplicate(make([])).collect() == []
