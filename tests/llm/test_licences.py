import re

import pytest

from faultline.llm import licences, queries


def words(text):
    return re.findall(r"[a-z0-9]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))


def bigrams(text):
    w = words(text)
    return {tuple(w[i:i + 2]) for i in range(len(w) - 1)}


def stretches(text):
    lines = (text or "").split("\n")
    yield text or ""
    run = []
    for x in [*lines, ""]:
        if words(x):
            yield x
            run.append(x)
        elif run:
            yield "\n".join(run)
            run = []


def brute(text, templates, least=0.8):
    best = {}
    for part in stretches(text):
        a = bigrams(part)
        for name, t in templates:
            b = bigrams(t)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= least:
                best[name] = max(dice, best.get(name, 0))
    return sorted(best.items())


def check(df, templates=licences.TEMPLATES, least=0.8):
    rows = df.collect()
    for r in rows:
        got = [(m.licence, m.dice) for m in r.licences.matches]
        assert [(a, pytest.approx(b)) for a, b in got] == brute(r.text, templates, least), (r.text or "")[:100]
    return rows


def test_whole_table(spark, small):
    rows = check(licences.scan_licences(spark.read.parquet(f"{small}/documents.parquet")))
    assert any(r.licences.matches for r in rows) and not all(r.licences.matches for r in rows)


def test_whole_texts_lines_and_near_texts(make):
    mit, line = licences.TEMPLATES[0][1], licences.TEMPLATES[1][1]
    worn = mit.replace("free of charge", "at no cost").replace("\"Software\"", "'Program'").replace(". ", ".\n")
    rows = [(1, mit), (2, mit.lower().replace(" ", "\n")), (3, f"some prose here\n\n{worn}\n \nmore prose"), (4, f"prose\n{line}\nprose"),
            (5, f"{line} And then prose that goes on and on for quite a while"), (6, "the software is the software"), (7, None), (8, ""), (9, "mit"),
            (10, f"{line}\n\nLicensed under the Apache License, Version 2.0."), (11, "é " + line + " ü"), (4, f"prose\n{line}\nprose"), (12, "x " * 300_000 + "\n" + line)]
    docs = make([(d, t, "c") for d, t in rows], "doc_id long, text string, licences string")
    got = {r.doc_id: r.licences.matches for r in check(licences.scan_licences(docs))}
    assert [m.licence for m in got[10]] == ["Apache-2.0", "MIT"] and got[4][0].line == 1 and got[12][0].lines == 1
    assert [m.licence for m in got[1]] == [m.licence for m in got[3]] == ["MIT"] and not got[6]


def test_other_templates_bounds_and_empty(make):
    templates = [("a", "one two three four"), ("b", "one two"), ("c", "two three four five six")]
    docs = make([(1, "one two"), (2, "one two three"), (3, "two three four five"), (4, "x one two\none two three four")])
    for least in (0.3, 0.5, 0.8, 1.0):
        check(licences.scan_licences(docs, templates, least=least), templates, least)
    assert not any(r.licences.matches for r in licences.scan_licences(docs, []).collect())
    assert licences.scan_licences(make([])).collect() == []
    with pytest.raises(ValueError):
        licences.compile_templates([("bad", "word")])


def found(make, texts):
    docs = make(list(enumerate(texts)), "doc_id long, text string")
    rows = licences.scan_licences(docs, licences.all_templates(), inside=True).collect()
    return {r.doc_id: {m.licence: m.dice for m in r.licences.matches} for r in rows}


def test_paragraphs_and_sentences_inside_longer_texts(make):
    prose = "some prose of the author that goes on and on for quite a while"
    texts, want = [], []
    for name, t in licences.TEMPLATES:
        texts += [f"{prose}\n" + re.sub(r"[.:] ", ".\n *\n\n", t) + f"\n{prose}", f"{prose} {t} {prose}"]
        want += [name, name]
    got = found(make, texts)
    assert [sorted(got[i]) for i in range(len(texts))] == [[w] for w in want]
    assert all(d == pytest.approx(1) for x in got.values() for d in x.values())


def test_full_texts_and_near_names(make):
    full = licences.all_templates()[-7:]
    near = [("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"), ("CC-BY-4.0", "Licensed under CC BY 4.0."),
            ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("All-rights-reserved", "All rights reserved."),
            ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.")]
    got = found(make, [f"words before it\n{t}\nand after" for _, t in [*full, *near]])
    for i, (name, _) in enumerate([*full, *near]):
        assert name in got[i] and got[i][name] == pytest.approx(1)
    assert all(len(got[len(full) + i]) == 1 for i in range(len(near)))


def test_query_finds_the_planted_lines(spark, small):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "All-rights-reserved", "Released under the MIT License.": "MIT",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    got = {r.doc_id: r.licences.split(",") for r in queries.op6_licences(spark, small).collect()}
    planted = [(r.doc_id, name) for r in spark.read.parquet(f"{small}/documents.parquet").collect() for x, name in lines.items() if x in (r.text or "")]
    assert planted and all(name in got[d] for d, name in planted)
