import random

import pytest

from comarca.llm import license_scan as ls


def brute(text, templates, containment=0.8):
    """Templates of which some stretch of words holds enough shingles, looking at every stretch."""
    words = ls.words_of(text or "")
    found = set()
    for name, body in templates.items():
        own = ls.words_of(body)
        width = min(ls.WORDS, len(own))
        shingles = {tuple(own[i:i + width]) for i in range(len(own) - width + 1)}
        at = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
        reach = len(own) - width + 1
        for i in range(len(at)):
            if len(shingles & set(at[i:i + reach])) >= containment * len(shingles):
                found.add(name)
    return found


def test_every_planted_notice_is_found(spark, sf_dir):
    rng = random.Random(4)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect()]
    texts = []
    for i, (_, text) in enumerate(docs):
        words, notice = text.split(), list(ls.TEMPLATES.values())[i % len(ls.TEMPLATES)].split()
        if i % 3 == 1 and len(notice) > 40:
            notice[20] = "changed"  # five of at least 36 shingles differ
        at = rng.randrange(len(words) + 1)
        texts.append((i, " ".join(words[:at] + notice + words[at:])))
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: {m.template for m in r.matches} for r in ls.scan(rows).collect()}
    for i, text in texts:
        true = brute(text, ls.TEMPLATES)
        assert true <= got[i]  # a window may be longer than the template, so it may hold more
        assert list(ls.TEMPLATES)[i % len(ls.TEMPLATES)] in got[i]


def test_matches_are_exact(spark):
    text = "intro Licensed under CC BY-NC 4.0. middle All rights reserved. and (all RIGHTS reserved)"
    row = ls.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [(m.template, m.first_word, m.last_word, m.containment) for m in row.matches] == [
        ("CC-BY-NC-4.0 (notice)", 1, 5, 1.0), ("all rights reserved", 7, 9, 1.0), ("all rights reserved", 11, 13, 1.0)]


def test_bands_keep_their_promise():
    for jaccard in (0.1, 0.25, 0.5, 0.9):
        assert 1 - (1 - jaccard) ** ls.bands_for(jaccard) >= 0.999
    assert all(1 - (1 - s.jaccard) ** s.bands >= 0.999 for s in ls.scanners(ls.TEMPLATES))


def test_null_empty_repeated_and_bad_templates(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "All rights", 0), (4, "All rights reserved.", 0), (4, "All rights reserved.", 0)],
                                 "doc_id long, text string, template int")
    got = ls.scan(docs).collect()
    assert sorted((r.doc_id, len(r.matches)) for r in got) == [(1, 0), (2, 0), (3, 0), (4, 1), (4, 1)]
    assert ls.scan(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        ls.scan(docs, {"none": " "})


def test_whole_texts_and_commented_headers(spark):
    header = ls.TEMPLATES["Apache-2.0"].split()
    lines = [" ".join(header[i:i + 8]) for i in range(0, len(header), 8)]
    table = ls.all_templates()
    texts = ["/*\n" + "\n".join(f" * {x}" for x in lines) + "\n */", "\n".join(f"# {x}" for x in lines), "\n".join(f"// {x}" for x in lines),
             "\n".join(f"-- {x}" for x in lines), *(f"intro {t} end" for t in table.values())]
    got = [r.matches for r in ls.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    for found in got[:4]:
        assert [m.containment for m in found if m.template == "Apache-2.0"] == [1.0]
    assert next((m.first_word, m.last_word) for m in got[0] if m.template == "Apache-2.0") == (2, len(texts[0].split()) - 2)
    for name, found in zip(table, got[4:]):
        assert any(m.template == name and m.containment == 1.0 for m in found), name
    assert ls.words_of("a * // é -- #1") == [b"a", "é".encode(), b"#1"]


def brute_windows(text, templates, containment=0.8):
    """Every window against every template, on words: (template, found) of the best window, without bands and hashes."""
    words, found = ls.words_of(text or ""), {}
    for name, body in templates.items():
        own = ls.words_of(body)
        width = min(ls.WORDS, len(own))
        shingles = {tuple(own[i:i + width]) for i in range(len(own) - width + 1)}
        size = 1 << (len(own) - width).bit_length()
        window, step = (1, 1) if size == 1 else (2 * size, max(1, size // 2))
        at = [tuple(words[i:i + width]) for i in range(len(words) - width + 1)]
        best = max((len(shingles & set(at[i:i + window])) for i in range(0, len(at), step)), default=0)
        if best >= containment * len(shingles):
            found[name] = best
    return found


def test_equal_to_all_windows_with_changed_whole_texts(spark):
    table, rng = ls.all_templates(), random.Random(9)
    texts = []
    for name, body in table.items():
        words = body.split()
        for gap in (23, 40, 90):  # a word changed in every so many: about 5 / gap of the shingles differ
            changed = [f"changed{i}" if i % gap == gap - 1 else w for i, w in enumerate(words)]
            filler = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(90))]
            texts.append(" ".join(filler + changed + filler[::-1]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(16)
    got = {r.doc_id: r.matches for r in ls.scan(rows).collect()}
    for i, text in enumerate(texts):
        best = {}
        for m in got[i]:
            best[m.template] = max(best.get(m.template, 0), m.found_shingles)
        assert best == brute_windows(text, table)


def test_equal_hashes_of_other_words_are_no_match(monkeypatch):
    honest = ls.shingle_hashes
    monkeypatch.setattr(ls, "shingle_hashes", lambda words, width: honest(words, width) % 3 << 60)  # nearly all shingles collide
    body = ls.TEMPLATES["BSD-2-Clause"]
    (scanner,) = ls.scanners({"BSD-2-Clause": body})
    own, other = ls.words_of(body), [b"w%d" % i for i in range(40)]

    def matches(words):
        hashes = ls.shingle_hashes(ls.hashed_words(words, {}), scanner.width)
        return [m[0] for m in scanner(hashes, lambda i: tuple(words[i:i + scanner.width]))]

    assert matches(other + own) and not matches(other + other)


def test_very_long_text(spark):
    text = "word other " * 300_000 + ls.TEMPLATES["MIT"]
    found = ls.scan(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, containment string")).first()
    assert [m.template for m in found.matches] == ["MIT"] and found.containment == "x"
