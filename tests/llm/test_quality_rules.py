from collections import Counter

import pandas as pd
from hypothesis import given, settings, strategies as st

from comarca.llm import quality_rules
from comarca.llm.quality_rules import QualityRules


def counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é#|<\n \t\x0b\x1c\xa0")), max_size=60))
def test_counts_of_any_text(text):
    assert tuple(quality_rules.text_counts(pd.Series([text])).iloc[0]) == counts(text)


def test_documents_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    for r in quality_rules.judged(docs).collect():
        own = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own
        assert r.base_failed == (own[0] < 10 or 100 * own[4] > 20 * own[0])
        assert not (r.kept and r.base_failed)


def test_sketch_quartiles_are_near_and_merge(spark):
    values = [(i * 7919) % 100_003 for i in range(20_000)]
    rows = spark.createDataFrame([("x", str(i % 7), False, v, 0, 0, 0) for i, v in enumerate(values)],
                                 "lang string, source string, base_failed boolean, word_length long, symbols long, dup_lines long, repeats long")
    sketches = quality_rules.sketch(rows)
    for keys in (["lang"], [], ["lang", "source"]):
        for q in quality_rules.quartiles(sketches, keys).where("measure = 'word_length'").collect():
            own = sorted(v for i, v in enumerate(values) if "source" not in keys or str(i % 7) == q.source)
            for part, got in ((0.25, q.q1), (0.75, q.q3)):
                true = own[int(part * len(own)) - 1]
                assert abs(got - true) <= true / 16
    again = quality_rules.sketch(rows.repartition(5)).exceptAll(sketches)
    assert again.count() == 0


def test_groups_follow_their_own_thresholds(spark):
    plain = "word " * 200
    rows = [(i, plain, "en", "clean") for i in range(200)] + [(1000 + i, "|word " * 200, "en", "tables") for i in range(200)]
    rows = [(i, " ".join(f"{w.strip()}{k}" for k, w in enumerate(t.split())), a, b) for i, t, a, b in rows]
    rows += [(5000, rows[300][1], "en", "clean"), (5001, rows[300][1], "en", "tables"), (5002, None, "en", "clean"), (5003, "", None, None),
             (None, rows[0][1], None, "clean"), (None, rows[0][1], None, "clean")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, lang string, source string, n_words int").repartition(4)
    kept = {(r.doc_id, r.source): r.kept for r in quality_rules.judged(docs).collect()}
    assert not kept[5000, "clean"] and kept[5001, "tables"]  # the same text, judged by its group
    assert not kept[5002, "clean"] and not kept[5003, None]
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns and good.count() == 200 + 200 + 1 + 2
    assert quality_rules.judged(docs.where("false")).count() == 0
    assert quality_rules.keep_good(docs.where("false")).count() == 0
    assert QualityRules().least_rows == 100


def test_a_bad_row_takes_no_good_row_of_its_doc_id_along(spark):
    good = " ".join(f"word{k}" for k in range(50))
    rows = [(None, good), (None, "bad"), (None, None), (1, good + " end"), (1, "bad"), (2, "bad"), (3, "")]
    docs = spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, source string")
    assert sorted(r.text for r in quality_rules.keep_good(docs).collect()) == sorted([good, good + " end"])


def test_each_measure_rejects_an_outlier(spark):
    rows = [(i, " ".join(f"word{(i * 331 + k * 17) % 9000}" for k in range(200))) for i in range(300)]
    word = lambda k: f"word{k}"
    outliers = {
        1001: " ".join(f"averyverylongword{k}" for k in range(200)),                                     # words
        1002: " ".join(f"{word(k)}{'#' * (k % 4 == 0)}" for k in range(200)),                            # symbols
        1003: "\n".join(f"again\n{word(3 * k)} {word(3 * k + 1)} {word(3 * k + 2)}" for k in range(50)),  # lines
        1004: " ".join([*map(word, range(170)), *map(word, range(15))]) + " end of it",                  # windows, 16 %
    }
    docs = spark.createDataFrame([(*r, "en", "s") for r in [*rows, *outliers.items()]], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judged(docs).collect()}
    assert all(got[i].kept for i, _ in rows)
    assert not any(got[i].base_failed for i in outliers) and not any(got[i].kept for i in outliers)
    # each for its own measure: the others alone would have kept it
    for i, m in zip(outliers, quality_rules.MEASURES):
        wide = tuple(10 ** 7 if other == m else own for other, own in zip(quality_rules.MEASURES, QualityRules().least_spread))
        assert {r.doc_id: r.kept for r in quality_rules.judged(docs, QualityRules(least_spread=wide)).collect()}[i]


def test_long_texts_are_counted_alike(monkeypatch):
    texts = [" ".join(f"w{(k * k) % 997}" for k in range(n)) for n in (6, 7, 50, 3000)] + ["a b c d e " * 40, "x " * 300, "a b c d e f a b c d e"]
    short = quality_rules.text_counts(pd.Series(texts))
    monkeypatch.setattr(quality_rules, "MANY_WORDS", 5)
    assert quality_rules.text_counts(pd.Series(texts)).equals(short)
    monkeypatch.undo()
    long = " ".join(f"v{k}" for k in range(1_500_000)) + " v1 v2 v3 v4 v5"
    assert tuple(quality_rules.text_counts(pd.Series([long])).iloc[0])[4] == 10
