from brute import crc, jump

from faultline.llm import sharding


def check(rows, source, shards=24):
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == sorted(
        (d is not None, d or 0, len((t or "").encode()) + 8, crc(t or "")) for d, t in source)
    slots = {}
    for r in rows:
        assert r.law == "key"
        assert r.shard == jump(r.doc_id or 0, shards) and r.grown_shard == jump(r.doc_id or 0, shards + 1)
        assert r.grown_shard in (r.shard, shards)
        slots.setdefault(r.shard, []).append(r.slot)
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_whole_table(spark, small, corpus):
    check(sharding.shard_rows(spark.read.parquet(f"{small}/documents.parquet")).collect(), corpus)


def test_nulls_repeats_long_texts_and_clashing_columns(make):
    rows = [(None, "a"), (None, None), (3, ""), (3, ""), (3, ""), (-5, "é" * 300_000), (2**63 - 1, "x"), (-2**63, None)]
    docs = make([(d, t, "9", "s") for d, t in rows], "doc_id long, text string, shard string, _bucket string")
    check(sharding.shard_rows(docs, rows_per_bucket=1, least_buckets=2).collect(), rows)


def test_empty(make):
    assert sharding.shard_rows(make([])).collect() == []


def test_plan_has_no_python(make):
    plan = sharding.shard_rows(make([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
