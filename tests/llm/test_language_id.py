import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.llm import language_id
from comarca.llm.queries import op4_kneser_ney


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = op4_kneser_ney(spark, sf_dir).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    judged = [r for r in got if r.held_out and r.lang and any(c.isalpha() for c in r.text or "")]
    assert np.mean([r.lang == r.lang_pred for r in judged]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)
    # score is calibrated on other texts than the model learnt, so it holds on the held-out ones
    error = abs(np.mean([r.score for r in judged]) - np.mean([r.lang == r.lang_pred for r in judged]))
    assert error < 0.05, error
    assert np.mean([r.rejected for r in judged]) < 0.05


def reference_model(words, order):
    """Interpolated Kneser-Ney with dictionaries: p(c | h) of one language."""
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for w, n in words.items():
        p = " " * (order - 1) + w + " "
        for i in range(len(w) + 1):
            counts[order][p[i:i + order]] += n
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    def discount(k):
        n1, n2 = (sum(v == x for v in counts[k].values()) for x in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    d = {k: discount(k) for k in range(1, order + 1)}
    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(counts[1]) + 1)
        same = [c for x, c in counts[k].items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(counts[k][g] - d[k], 0) / sum(same) + d[k] * len(same) / sum(same) * p(g[1:])
    return p


def test_tables_against_dictionaries(spark):
    words = {"x": Counter("aba abba ab ba cab abc abc".split()), "y": Counter("zz zyz yz zzz aba".split())}
    rows = [(lang, " ".join(w.elements())) for lang, w in words.items()]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["x", "y"]
    asked = ["aba", "abq", "q", "zzyz", "cabab"]
    got = language_id.word_scores(model, asked)
    for j, lang in enumerate(model.languages):
        p = reference_model(words[lang], language_id.ORDER)
        for i, w in enumerate(asked):
            padded = " " * (language_id.ORDER - 1) + w + " "
            want = sum(-math.log2(p(padded[k:k + language_id.ORDER])) for k in range(len(w) + 1))
            assert got[i, j] == pytest.approx(want, rel=1e-9)


def test_null_empty_letterless_and_unlabelled(spark):
    rows = [(1, "the cat sat", "en"), (2, "die katze sitzt", "de"), (3, None, "en"), (4, "12 % !", "de"), (5, "", None), (6, "the cat", None),
            (7, "die katze", "de"), (8, "the cat", "en"), (None, "the the", "en"), (9, "the cat sat", "en"), (10, "die katze", "de"), (11, "the cat", "en")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    for und in (3, 4, 5):
        assert got[und].lang_pred == "und" and got[und].score == 0
    assert got[6].lang_pred == "en" and got[2].lang_pred == "de"
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(docs.where("false")).count() == 0
    assert [w for t in language_id.tokens("a²b ǅx c1d") for w in language_id.letters(t)] == ["a", "b", "ǆx", "c", "d"]


def test_no_count_is_left_out(spark, monkeypatch):
    words = {"x": Counter("aba abba ab ba cab abc abc aba aba".split()), "y": Counter("zz".split())}
    rows = [(lang, " ".join(w.elements())) for lang, w in words.items()]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    # any limit would bite at five rows: then the small language and the rare n-grams were gone
    limit = type(labelled).limit
    monkeypatch.setattr(type(labelled), "limit", lambda self, n: limit(self, 5))
    model = language_id.train(labelled)
    assert model.languages == ["x", "y"]
    got = language_id.word_scores(model, ["abba", "zz"])
    for j, lang in enumerate(model.languages):
        p = reference_model(words[lang], language_id.ORDER)
        for i, w in enumerate(["abba", "zz"]):
            padded = " " * (language_id.ORDER - 1) + w + " "
            assert got[i, j] == pytest.approx(sum(-math.log2(p(padded[k:k + language_id.ORDER])) for k in range(len(w) + 1)), rel=1e-9)


def test_the_calibration_fold_is_not_learnt(spark):
    rows = [("en", f"the cat number {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} sat") for i in range(100)] * 2
    rows += [("de", "die katze sitzt")] * 40 + [("fr", "le chat")]
    labelled = spark.createDataFrame(rows, "lang string, text string")
    learnt, fold = language_id.calibration_fold(labelled)
    a, b = ({(r.lang, r.text) for r in part.collect()} for part in (learnt, fold))
    assert a | b == set(rows) and b and len(b) < 40
    assert {lang for lang, _ in a} == {"en", "de", "fr"}  # a language is learnt even if its only text is in the fold
    assert all(lang != "en" for lang, _ in a & b)
    wide_learnt, wide = language_id.calibration_fold(labelled, 0)
    assert wide.count() == 0 and wide_learnt.count() == len(rows)
    only = labelled.where("lang = 'fr'")
    for text in ("x", "y", "z", "le chat"):
        learnt, _ = language_id.calibration_fold(only.withColumn("text", F.lit(text)))
        assert learnt.count() == 1


def test_very_long_texts_and_clashing_columns(spark):
    long = "the cat sat on the mat " * 60_000
    rows = [(i, t, lang, 0.5, True, "x") for i, (t, lang) in enumerate([("the cat sat", "en"), ("die katze sitzt", "de")] * 20)]
    rows += [(100, long, None, 0.5, True, "x"), (101, "the" * 400_000, None, 0.5, True, "x"), (102, "die katze", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, rejected boolean, entropy string")
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert got[100].lang_pred == "en" and got[102].lang_pred == "de" and 101 in got
