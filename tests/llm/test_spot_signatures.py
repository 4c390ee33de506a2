import re

from brute import sha

from faultline.llm import spot_signatures as spots

from pyspark.sql import functions as F

ANCHORS = frozenset(spots.ANCHORS)


def plain_set(text):
    words = [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]
    content = [w for w in words if w not in ANCHORS]
    out, k = set(), 0
    for w in words:
        if w in ANCHORS:
            out.add((w, *content[k:k + 2]))
        else:
            k += 1
    return out or {("", *content[i:i + 2]) for i in range(len(content))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check(df, source):
    docs = sorted(((d, t or "") for d, t in source if d is not None))
    after = {d: docs[(i + 1) % len(docs)][1] for i, (d, _) in enumerate(docs)}
    rows = df.collect()
    assert len(rows) == len(source)
    text = dict(source)
    for r in rows:
        own = text[r.doc_id] or ""
        half = len(own) // 2
        edited = own[:len(own) - half] + (after[r.doc_id][:half] if r.doc_id is not None else "")
        assert (r.n_chars, sha(r.edited)) == (len(own), sha(edited))
        assert abs(r.near_edited - jaccard(plain_set(own), plain_set(edited))) < 1e-9
        if r.doc_id is not None:
            assert abs(r.near_next - jaccard(plain_set(own), plain_set(after[r.doc_id]))) < 1e-9
        assert len(r.signatures) == len(plain_set(own)) and r.signatures == sorted(r.signatures)


def test_whole_table(spark, small, corpus):
    unique = list({d: (d, t) for d, t in corpus}.values())
    docs = spark.read.parquet(f"{small}/documents.parquet").dropDuplicates(["doc_id"])
    check(spots.compare_edited(docs), [(d, t) for d, t in unique])


def test_edges(make):
    rows = [(5, "The cat and the dog of Spain"), (9, None), (-3, "naïve Über-straße 漢字 und so"), (7, ""), (None, "the lone row here"),
            (2**40, "the " * 200_000 + "end"), (11, "no1 anch0r w0rds"), (12, "x")]
    docs = make([(d, t, "9", "z") for d, t in rows], "doc_id long, text string, _key string, n_chars string")
    check(spots.compare_edited(docs), rows)


def test_equal_ids_and_equal_texts(make):
    docs = make([(1, "the a b c"), (1, "the a b c"), (2, "the z y"), (2, "the q y"), (3, "the a b c")])
    rows = spots.compare_edited(docs).select("doc_id", "edited", spots.fingerprint(F.col("signatures")).alias("f")).collect()
    assert len(rows) == 5 and len({r.f for r in rows if r.doc_id != 2}) == 1
    assert {r.edited for r in rows if r.doc_id == 1} == {"the a" + "the "}


def test_empty_one_row_and_native(make):
    assert spots.compare_edited(make([])).collect() == []
    row = spots.compare_edited(make([(4, "the end of days")])).first()
    assert row.near_next == 1.0 and row.edited == "the end the end"[:8] + "the end"
    plan = spots.compare_edited(make([(4, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_pairs(spark, small, corpus, make):
    rows = list({d: (d, t) for d, t in corpus}.values())[:150] + [(10**6, corpus[0][1] + " the end"), (10**6 + 1, None), (10**6 + 2, "")]
    sets = {}
    for d, t in rows:
        if plain_set(t):
            k = frozenset(plain_set(t))
            sets[k] = min(d, sets.get(k, d))
    want = set()
    for x, a in sets.items():
        for y, b in sets.items():
            if a < b and 100 * len(x & y) >= 80 * len(x | y):
                want.add((a, b))
    got = {(r.a, r.b) for r in spots.spot_pairs(make(rows)).collect()}
    assert got == want and want
