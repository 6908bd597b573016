import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from comarca.llm import spelling
from comarca.llm.queries import op11_spelling_variants

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(word, letters):
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    return out - {word}


def brute(words):
    letters, form, near = {c for w in words for c in w}, {}, {}
    for w, n in words.items():
        near[w] = [v for v in one_edit(w, letters) if v in words]
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def same(df, want):
    got = rows_of(df)
    assert len(got) == len(set(got)) and set(got) == want


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute(brute_words([(r.doc_id, r.text) for r in docs]))
    assert any(w[1] for w in want)
    same(op11_spelling_variants(spark, sf_dir), want)


@pytest.mark.parametrize("crowd, together", [(4096, 16_384), (40, 30), (3, 2)])
@pytest.mark.parametrize("letters, first", [("ab", ""), ("abcéÿ", ""), ("abcdefgh", "samestart"), ("ab", "é")])
def test_words_of_few_letters(spark, crowd, together, letters, first, monkeypatch):
    """Crowded prefixes, words that continue other words, long words and ties of counts."""
    monkeypatch.setattr(spelling, "CROWD", crowd)
    monkeypatch.setattr(spelling, "TOGETHER", together)
    rng = random.Random(len(letters) + crowd)
    words = {}
    for _ in range(600):
        w = first + "".join(rng.choice(letters) for _ in range(rng.choice([6, 6, 7, 7, 8, 9, 12])))
        words[w] = rng.choice([5, 6, 25, 30, 125, 700, 10 ** 12])
    stem = "".join(rng.choice(letters) for _ in range(300))
    words |= {stem: 5, stem[:150] + stem[151:]: 30, "x" + stem: 200, stem + "x": 200}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    same(spelling.variants(df), brute(words))


def test_scan_of_a_sorted_list():
    words = sorted({"abcdef", "abcdefg", "abcdeg", "abcxef", "abcdxef", "abcef", "abcdefgh", "abczzz"})
    queries = ["abcdef", "abcdefg", "abcqqq"]
    lo, hi = np.zeros(3, np.int64), np.full(3, len(words))
    found = sorted(zip(*[x.tolist() for x in spelling.SortedList(words).scan(queries, lo, hi)]))
    assert [(q, words[w]) for q, w in found] == [(0, "abcdefg"), (0, "abcdeg"), (0, "abcdxef"), (0, "abcef"), (0, "abcxef"),
                                                (1, "abcdef"), (1, "abcdefgh"), (1, "abcdeg")]


def test_thinned_pairs_nulls_empty_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG", 1000)
    monkeypatch.setattr(spelling, "HELD", 7)
    word = "Straßenbahn ÄÖÜäöü×÷ KELVINK ſtraße"
    rows = [(i % 700 if i % 50 else None, f"{word} Example{'abc'[i % 3]} 12 non-letters", i) for i in range(1400)]
    rows += [(None, None, 0), (5, "", 0), (7, " ".join(f"{word} exampled" for _ in range(400)), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    want = brute_words([(d, t) for d, t, _ in rows])
    got = spelling.vocabulary(docs.repartition(3))
    assert {r.word: r.n for r in got.collect()} == want
    assert any(len(w) == 7 and w in "examplea" for w in want) or len(want) > 8
    same(spelling.variants(got), brute(want))
    assert spelling.variants(spelling.vocabulary(docs.where("false"))).count() == 0


def test_roots_follow_the_longest_chain(spark):
    chain = [(f"word{i:02}", f"word{i + 1:02}") for i in range(27)]
    got = {r.word: r.root for r in spelling.with_roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "word27" for w, _ in chain}
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([("example", 5)], "word string, n long"), times=4)
    assert F is not None
