import corpus_pipeline
import public_tokenizers
import tiktoken
from brute import components, contamination, repeats, sha

from faultline.llm import byte_pairs, language


def test_run_against_a_plain_version(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    filters = language.learn_languages(docs)
    kept = [(r.doc_id, r.text) for r in language.predict_language(docs, filters).collect()
            if r.language.lang != "und" and r.language.score >= corpus_pipeline.LEAST_SCORE]
    assert len(kept) == docs.count()  # all of it is clean prose
    text = dict(kept)
    own = sorted({(d, text[d]) for d, _, least in components(list(text.items())) if d == least})
    cut = [(d, k if gone else text[d]) for d, n, gone, k in repeats(own) if not gone or gone < n]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = [x for x, (n, hit, _) in zip(cut, contamination([t for _, t in cut], items)) if not (hit and 20 * hit >= n)]
    assert len(own) < len(text) and cut != own and len(clean) < len(cut)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want = []
    for d, t in clean:
        ids = library.encode_ordinary(t)
        want.append((d, len(ids), sha(b"".join(i.to_bytes(4, "little") for i in ids)), sha(t)))
    got = corpus_pipeline.run(spark, small)
    assert sorted(map(tuple, got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == sorted(want)


def test_stages_keep_columns_nulls_and_empty_tables(make, small, spark):
    rows = [(None, "the words of this text are in order", "en", None, None), (1, None, None, None, 3), (2, "", "en", "s", 0),
            (3, "the words of this text are in order", "en", "s", 1), (3, "the words of this text are in order", "en", "s", 1),
            (4, "12 34", "en", "s", 5)]
    for docs in (make(rows), make([])):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = corpus_pipeline.stored(stage(spark, docs, small), name)
            assert docs.columns == before or name == "byte_pairs"
    left = corpus_pipeline.stored(make(rows), "x")
    for name, stage in corpus_pipeline.STAGES[:2]:
        left = corpus_pipeline.stored(stage(spark, left, small), name)
    assert sorted(str(r.doc_id) for r in left.collect()) == ["3", "None"]
