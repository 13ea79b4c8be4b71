from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from tessera.llm import crf, language


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    lines = np.array([1, 4, 2, 6])
    odds, couple = rng.normal(size=lines.sum()) * 2, rng.normal(size=(2, 2))
    good, pairs, part = crf.marginals(odds, couple, lines)
    at = 0
    for c, n in enumerate(lines):
        o, weights = odds[at : at + n], {}
        for ys in itertools.product((0, 1), repeat=int(n)):
            weights[ys] = np.exp(sum(o[i] * y for i, y in enumerate(ys)) + sum(couple[a, b] for a, b in itertools.pairwise(ys)))
        z = sum(weights.values())
        assert part[c] == pytest.approx(np.log(z))
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(w for ys, w in weights.items() if ys[i]) / z)
        for a, b in itertools.product((0, 1), repeat=2):
            assert pairs[c, a, b] == pytest.approx(sum(w * sum(p == (a, b) for p in itertools.pairwise(ys)) for ys, w in weights.items()) / z)
        at += n


def test_line_features():
    x, chars, lines = crf.line_features(["One two.\n\nTHREE!! three!!", "", "a a a a", "é" * 3])
    assert x.shape == (6, 3 * 22 + 3) and list(lines) == [3, 1, 1, 1] and list(chars) == [7, 0, 14, 0, 4, 3]
    assert x[4, 14] == 1.0 and x[0, 14] == 0.0 and x[1, 0] == 1.0 and x[0, 18] == 1.0 and x[2, 22 + 0] == 1.0
    again, _, _ = crf.line_features(["same line here\nother one\nsame line here\nsame line"])
    assert list(again[:, 20]) == [0, 0, 1, 0]


def test_batches_do_not_change_scores(monkeypatch):
    texts = ["Good text is here.\nIt has lines.", "bad bad bad bad bad", None, "", "x\n" * 50, "BAD!! BAD!!"] * 20
    model = crf.fit([t or "" for t in texts], [int("ood" in (t or "")) for t in texts], [1.0] * len(texts), rounds=30)
    one, _ = crf.score_texts(texts, model)
    monkeypatch.setattr(crf, "_AT_ONCE", 40)
    two, _ = crf.score_texts(texts, model)
    assert np.allclose(one, two) and one[2] == one[3] == 0.0


def test_long_texts_in_pieces(monkeypatch):
    """op1: a text counted in pieces has the lines, and the score, that it has as a whole."""
    rng = np.random.default_rng(3)
    words = ["Good", "bad!", "a", "a", "é,", "#tag", "1234", "line.", "\n", "\n\n", "|", "UPPER"]
    texts = [" ".join(rng.choice(words, size=rng.integers(1, 400))) for _ in range(40)] + ["x" * 300, "\n" * 100, " ", "a\n" * 200]
    model = crf.fit(texts, [k % 2 for k in range(len(texts))], [1.0] * len(texts), rounds=30)
    whole, bad = crf.score_texts(texts, model)
    monkeypatch.setattr(crf, "_AT_ONCE", 37)
    monkeypatch.setattr(crf, "_LINES", 5)
    for t in texts:
        one, cut = crf._counted(t, np.zeros(1, np.int64), np.zeros(0, np.uint64), 0)[0], crf._long_text(t)
        if len(max(t.split(), key=len, default="")) < 37:
            assert (one.counts == cut.counts).all() and (one.hashed == cut.hashed).all() and (one.first == cut.first).all() and (one.last == cut.last).all()
    pieces, also_bad = crf.score_texts(texts[:40], model)
    assert np.allclose(whole[:40], pieces) and (bad[:40] == also_bad).all()


def test_long_marginals():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 10, 101, 1000):
        odds, couple = rng.normal(size=n) * 3, rng.normal(size=(2, 2))
        assert np.allclose(crf.long_marginals(odds, couple), crf.marginals(odds, couple, np.array([n]))[0])


def test_very_long_texts():
    """op1: 20 MB in lines, and in one, take bounded time and memory."""
    import resource
    import time

    model = crf.fit(["Good text is here.\nIt has lines."] * 4 + ["bad bad bad bad bad"] * 4, [1] * 4 + [0] * 4, [1.0] * 8, rounds=30)
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.process_time()
    score, bad = crf.score_texts(["Good text is here with a line.\n" * 650_000, "word " * 4_000_000, "x" * 20_000_000], model)
    assert time.process_time() - start < 60 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000
    assert ((score >= 0) & (score <= 1)).all()


def test_scores_do_not_depend_on_other_rows():
    model = crf.fit(["Good text is here.\nIt has lines."] * 4 + ["bad bad bad bad bad"] * 4, [1] * 4 + [0] * 4, [1.0] * 8, rounds=30)
    alone, _ = crf.score_texts(["bad one", "bad two"], model)
    assert alone[1] == crf.score_texts(["bad two"], model)[0][0] and crf.line_features(["a a", "a b"])[0][1, 14] == 0


def test_quality_odd_rows(spark):
    """op1: repeated rows, null ids, clashing names; the fit's bound holds before texts are collected."""
    docs = spark.createDataFrame([(1, "good words here.", "T", 1), (1, "good words here.", "U", 2), (None, "x", "V", 3), (2, None, "W", 4)], "Doc_ID long, text string, TEXT string, Score int")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (3, 0), (None, 1)], "doc_id long, Quality int")
    assert crf.classify(docs, None).columns == ["Doc_ID", "score", "predicted", "n_bad_lines"]
    assert crf.learn(docs, labels) is not None and crf.learn(docs, labels, chars=5) is None
    model = crf.fit(["good words here."] * 3 + ["x"] * 3, [1] * 3 + [0] * 3, [1.0] * 6)
    assert crf.keep_good(docs, model).columns == ["Doc_ID", "text", "Score"] and crf.keep_good(docs, model).count() == 2
    assert crf.classify(docs.limit(0), model).count() == 0


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = crf.op1_quality_classifier(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert ((got.score >= 0.3) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert ((both.predicted == both.quality).mean()) > 0.95


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, None, 6)], "doc_id long, text string, score int")
    none = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert crf.learn(docs, none) is None
    assert [r.score for r in crf.classify(docs, None).collect()] == [0.0, 0.0]
    assert crf.keep_good(docs, None).count() == 2


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op9_language_id(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    both = got[got.held_out].merge(docs, on="doc_id")
    assert len(got) == len(docs) and (both.lang_pred == both.lang).mean() > 0.98 and got.score.between(0, 1).all()


def test_language_cases(spark):
    rows = [("the cat and the dog", "en")] * 9 + [("der hund und die katze", "de")] * 9 + [("le chat et le chien", "fr")] * 9
    m = language.fit(rows)
    assert m.members == {"germanic": ["de", "en"], "romance": ["fr"]}
    docs = spark.createDataFrame([(1, None), (2, "123 !"), (3, "the dog"), (4, "die Katze"), (5, "LE CHIEN"), (6, "x" * 100_000)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, m).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5)] == ["und", "und", "en", "de", "fr"]
    assert language.fit([]) is None and {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(docs.limit(0), m).count() == 0


def test_remembered_words_do_not_change_scores(monkeypatch):
    m = language.fit([("the cat and dog", "en")] * 5 + [("der hund und katze", "de")] * 5)
    texts = [f"word{chr(97 + i)} the cat {chr(98 + i)}und" for i in range(20)]
    langs, one = language.Scorer(m)(texts)
    monkeypatch.setattr(language, "_REMEMBERED", 2)
    again, two = language.Scorer(m)(texts)
    assert langs == again and np.allclose(one, two)


def test_language_bounds_and_names(spark):
    """op9: the fit's bounds, languages beyond any number, a very long text, clashing names, repeated rows."""
    rows = [(k, f"{chr(97 + k % 20) * 3} {chr(98 + k % 20) * 4} text", f"l{k % 20}", "T") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, TEXT string")
    m = language.learn(docs, rows=200)
    assert sum(map(len, m.members.values())) == 20
    assert language.learn(docs, chars=10) is None and language.learn(docs.limit(0)) is None
    long = ["aaa bbbb text " * 1_500_000, "x" * 20_000_000, None]
    langs, score = language.Scorer(m)(long)
    assert langs[0] == "l0" and langs[2] == "und" and score.shape == (3,)
    w = "".join(np.random.default_rng(1).choice(list("abcdé"), 50_001))
    whole = language.Scorer(m)
    whole._add([w])
    assert np.allclose(language.Scorer(m)._piecewise(w), whole._table[0])
    assert np.allclose(language.Scorer(m)._text("aaa bbbb text " * 100_000), language.Scorer(m).sums(["aaa", "bbbb", "text"]) * 100_000)
    given = spark.createDataFrame([(1, "aaa bbbb", 5, "x"), (1, "aaa bbbb", 5, "x"), (None, "", 6, "y")], "doc_id long, text string, SCORE int, Lang_Pred string")
    got = language.identify(given, m)
    assert got.columns == ["doc_id", "lang_pred", "score"] and [r.lang_pred for r in got.collect()] == ["l0", "l0", "und"]
