import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from faultline.llm import byte_pairs, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_pairs.Encoder(byte_pairs.read_ranks(PATH), public_tokenizers.PATTERN)


def same(coder, library, texts):
    ids, size = coder.encode(texts)
    at = 0
    for t, n in zip(texts, size):
        assert ids[at:at + n].tolist() == library.encode_ordinary(t), t[:80]
        at += n


def test_query_on_the_whole_table(spark, small, corpus, library):
    def hexed(raw):
        return hashlib.sha256(raw).hexdigest()

    want = {d: library.encode_ordinary(t or "") for d, t in corpus}
    rows = queries.op3_byte_pairs(spark, small).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        ids = want[r.doc_id]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hexed(b"".join(i.to_bytes(4, "little") for i in ids))
        assert r.decoded_sha256 == hexed(dict(corpus)[r.doc_id].encode() if dict(corpus)[r.doc_id] else b"")


def test_splits_and_merges_on_random_texts(coder, library):
    draw = random.Random(5)
    letters = "ab'sStTrevmldLL 1²½\t\n  .,é漢ß'' \r<|endoftext|>"
    same(coder, library, ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(2000)])


def test_long_pieces(coder, library):
    draw = random.Random(2)
    mixed = ["".join(draw.choice("abcdefghij") for _ in range(n)) for n in (65, 300, 2000)]
    same(coder, library, ["a" * 300, "ab" * 500, " " * 1000, "x" + " " * 700 + "y", "=-" * 400, "\n" * 99 + "a", *mixed])


def test_another_pattern(library):
    ranks = byte_pairs.read_ranks(PATH)
    other = byte_pairs.Encoder(ranks, r"\S+|\s+")
    same(other, tiktoken.Encoding("x", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}), ["it's  a test", "", "ab\ncd"])


def test_edges(make, library):
    rows = [(1, None), (2, ""), (3, "it's here"), (3, "it's here"), (None, "é" * 5000), (4, "word " * 100_000), (5, "<|endoftext|>")]
    docs = make([(d, t, "7", "8") for d, t in rows], "doc_id long, text string, ids string, decoded string")
    got = byte_pairs.decode(byte_pairs.encode(docs, PATH), PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert byte_pairs.decode(byte_pairs.encode(make([]), PATH), PATH).collect() == []


def test_decode_alone(spark):
    coded = spark.createDataFrame([(1, [5, 6]), (2, None), (3, []), (4, [5, 10**7]), (5, [-1])], "id int, ids array<int>")
    got = {r["id"]: r.decoded for r in byte_pairs.decode(coded, PATH).collect()}
    back = {i: t for t, i in byte_pairs.read_ranks(PATH).items()}
    assert bytes(got[1]) == back[5] + back[6] and bytes(got[3]) == b"" and got[2] is None and got[4] is None and got[5] is None
