from faultline.llm import language
from faultline.llm.words import crc_rest

from pyspark.sql import functions as F


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = crc_rest("doc_id", 4) == 2
    filters = language.learn_languages(docs.filter(~held))
    rows = language.predict_language(docs.filter(held), filters).select("lang", "language.lang", "language.score").collect()
    assert len(rows) > 20 and sum(r[0] == r[1] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_filters_hold_every_kept_gram_and_correct_false_positives(make):
    docs = make([(1, "aaa bbb " * 40, "x"), (2, "ccc ddd " * 40, "y"), (3, None, "x"), (4, "zzz", None)])
    filters = language.learn_languages(docs)
    assert filters.langs == ["x", "y"] and (filters.wrong < 0.2).all()
    grams = language.word_grams(["aaa bbb"], language.letter_table()).gram
    assert (language.languages_of(grams, filters)[0] & 1).all()


def test_grams_stay_inside_words_and_texts():
    letters = language.letter_table()

    def grams(text):
        own = language.word_grams([text], letters)
        return sorted(g for w in own.word for g in own.gram[own.of == w])

    one = grams("ab")
    assert len(one) == 2 + 3 + 2 + 1 and one == grams("AB") == grams("1ab.")  # a b; _a ab b_; _ab ab_; _ab_
    assert grams("") == grams(None) == grams("7") == []
    assert len(grams("ab cd ab")) == 24 and set(one) <= set(grams("ab cd"))
    both = language.word_grams(["ab", None, "x ab"], letters)
    assert both.row.tolist() == [0, 2, 2] and both.word[0] == both.word[2]


def test_edges(make):
    docs = make([(1, "uno dos tres", "es"), (1, "uno dos tres", "es"), (2, None, "es"), (3, "", None), (4, "12 !?", "es"),
                 (None, "one two three", "en"), (5, "漢字", "en"), (6, "one two " * 100_000, "en")])
    clash = docs.withColumn("language", F.lit("old"))
    got = {(r.doc_id, r.text): r for r in language.predict_language(clash, language.learn_languages(docs)).collect()}
    assert all(got[k].language.lang == "und" and got[k].language.score == 0 for k in ((2, None), (3, ""), (4, "12 !?")))
    assert got[1, "uno dos tres"].language.lang == "es" and got[None, "one two three"].language.lang == "en"
    none = language.learn_languages(docs.filter("false"))
    assert {r.language.lang for r in language.predict_language(docs, none).collect()} == {"und"}
    assert language.predict_language(docs.filter("false"), none).count() == 0


def test_many_languages_use_more_bit_groups(make):
    names = [f"l{i:03d}" for i in range(70)]
    word = lambda i: chr(0x4E00 + 2 * i) + chr(0x4E01 + 2 * i)
    docs = make([(i, f"{word(i)} " * 30, n) for i, n in enumerate(names)])
    filters = language.learn_languages(docs)
    assert len(filters.slots) == 2
    assert all(r.lang == r.language.lang for r in language.predict_language(docs, filters).collect())
