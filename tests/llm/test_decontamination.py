import random

import pytest
from brute import contamination
from pyspark.sql import functions as F

from faultline.llm import decontamination

ITEMS = "item_id long, text string"


def rows_of(df):
    got = decontamination.is_contaminated()
    return df.select("text", "hits.n_words", "hits.n_hit", "hits.items", got.alias("bad")).collect()


def check(df, items):
    rows = rows_of(df)
    for r, (n, hit, ids) in zip(rows, contamination([r.text for r in rows], items)):
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, ids), r.text[:80]
        assert r.bad == (hit > 0 and 20 * hit >= n)
    return rows


def test_whole_table(spark, small):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = check(decontamination.decontaminate(docs, items), [tuple(r) for r in items.collect()])
    assert any(r.bad for r in rows) and not all(r.bad for r in rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_words_of_a_small_alphabet(make, seed):
    """Repeated words give equal grams everywhere, also inside items."""
    draw = random.Random(seed)

    def text(most):
        return " ".join(draw.choice("abcAB") for _ in range(draw.randint(0, most)))

    items = [(i, text(40)) for i in range(6)] + [(9, "b"), (9, "a b a"), (None, "c c a"), (8, ""), (7, None)]
    docs = make([(i, text(200)) for i in range(40)] + [(1, None), (2, ""), (3, "...")])
    check(decontamination.decontaminate(docs, make(items, ITEMS)), items)


def test_blocks_of_items_change_nothing(make, corpus):
    items = [(i, " ".join((t or "").split()[3:40])) for i, (_, t) in enumerate(corpus[:20])]
    docs = make(corpus[:60])
    one = decontamination.decontaminate(docs, make(items, ITEMS))
    many = decontamination.decontaminate(docs, make(items, ITEMS), block_bytes=1000)
    key = ["doc_id", "hits.n_words", "hits.n_hit", "hits.items"]
    assert sorted(map(tuple, one.select(*key).collect())) == sorted(map(tuple, many.select(*key).collect()))


def test_long_text_clashing_columns_and_empty_tables(make):
    words = [f"w{i}" for i in range(300_000)]
    items = [(1, " ".join(words[1000:1013])), (2, " ".join(words[200_000:200_020]))]
    docs = make([(1, " ".join(words), "x")], "doc_id long, text string, hits string")
    row = decontamination.decontaminate(docs, make(items, ITEMS)).select("hits.*").first()
    assert (row.n_words, row.n_hit, row["items"]) == (300_000, 33, ["1", "2"])
    empty = decontamination.decontaminate(docs, make([], ITEMS)).select("hits.*").first()
    assert (empty.n_hit, empty["items"]) == (0, [])
    assert decontamination.decontaminate(make([]), make(items, ITEMS)).filter(F.col("hits.n_hit") > 0).count() == 0
