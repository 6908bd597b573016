import hashlib
import random

import pytest
from pyspark.sql import functions as F

from comarca.llm import suffix_dedup
from comarca.llm.queries import op7_prefix_free_parsing


def brute(rows, length=suffix_dedup.LENGTH):
    seen, out = set(), {}
    for doc, raw in rows:
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            string = raw[i:i + length]
            if string in seen:
                gone[i:i + length] = [True] * length
            seen.add(string)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc] = (len(raw), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept)
    return out


def results(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.result.n_bytes, r.result.n_removed, r.result.n_spans, bytes(r.result.kept))
            for r in suffix_dedup.without_repeats(docs.repartition(5, "doc_id")).collect()}


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    true = brute([(r.doc_id, (r.text or "").encode()) for r in rows])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op7_prefix_free_parsing(spark, sf_dir).collect()}
    assert got == {d: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for d, x in true.items()}
    assert sum(x[1] for x in got.values()) > 0


@pytest.mark.parametrize("crowd, hot_in_batch", [(0, 16), (1000, 16), (0, 2)])
@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh éü日"])
def test_planted_and_periodic_repeats(spark, alphabet, crowd, hot_in_batch, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "_HOT_IN_BATCH", hot_in_batch)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    passages = [word(n) for n in (99, 100, 101, 150, 260, 700)]
    texts = []
    for _ in range(40):
        parts = [word(rng.randrange(0, 180)) for _ in range(3)]
        texts.append(parts[0] + rng.choice(passages) + parts[1] + rng.choice(passages)[rng.randrange(40):] + parts[2])
    texts += [texts[3], texts[5][7:], "", "x", texts[8] + texts[9], None]
    assert results(spark, texts) == brute([(i, (t or "").encode()) for i, t in enumerate(texts)])


def test_what_follows_a_very_common_line(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 20)
    rng = random.Random(2)
    line = "".join(rng.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(60)) + line + "".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    keyed = suffix_dedup._keyed(docs, "text").select(*suffix_dedup.KEY, "__text")
    assert len(suffix_dedup.hot_triggers(keyed)) > 0
    assert results(spark, texts) == brute([(i, t.encode()) for i, t in enumerate(texts)])


def test_a_text_longer_than_one_run_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "RUN", 1500)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(4000))
    texts = [long, long[5000:9000] + long[:200], "lead " + long[300:7000], long[3:]]
    assert results(spark, texts) == brute([(i, t.encode()) for i, t in enumerate(texts)])


def test_null_repeated_and_clashing_columns(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghij ") for _ in range(300))
    rows = [(2, text, "r1"), (2, text, "r2"), (None, text[20:], "r3"), (3, None, "r4"), (4, "é" + text, "r5")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, version string, lo int")
    got = {r.version: r.result.n_removed for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == {"r1": 280, "r2": 280, "r3": 0, "r4": 0, "r5": 300}
    done = suffix_dedup.remove_repeats(docs)
    assert done.columns == docs.columns
    assert {r.version: r.text for r in done.collect()} == {"r1": text[:20], "r2": text[:20], "r3": text[20:], "r4": "", "r5": "é"}
    assert suffix_dedup.without_repeats(docs.where("false")).count() == 0
    assert suffix_dedup.without_repeats(docs.withColumn("doc_id", F.lit(None).cast("long"))).count() == 5


def by_hash(spark, texts):
    """``texts`` in the order that rows of one doc_id have."""
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    return [r["__text"] for r in suffix_dedup._keyed(docs, "text").orderBy("__v", "__w").collect()]


@pytest.mark.parametrize("doc_id", [7, None])
def test_rows_of_one_id_whose_short_hashes_agree(spark, doc_id):
    """Texts that share 23 bits of their hash, of equal and of different length, stay apart."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    many = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 512).alias("x"), F.col("id"))
    text = F.concat("x", "x", "x", F.substring("x", 1, (F.col("id") % 50).cast("int")))
    pairs = (many.select(text.alias("text"), F.shiftrightunsigned(F.xxhash64(text), 41).alias("h")).groupBy("h")
             .agg(F.sort_array(F.collect_list("text")).alias("t")).where("size(t) > 1").orderBy("h").limit(6).collect())
    assert len(pairs) >= 2
    texts = [t for r in pairs for t in r.t] + [word(400)]
    third = texts[0][:300]  # a document of another id repeats one of them only
    rows = [(doc_id, t) for t in texts] + [(9, third)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["__key"]: r.result.n_removed for r in suffix_dedup.without_repeats(docs.withColumn("__key", F.col("text"))).collect()}
    true = brute([(t, t.encode()) for t in by_hash(spark, texts)] + [("third", third.encode())])
    assert got == {**{t: true[t][1] for t in texts}, third: true["third"][1]}
    assert true["third"][1] == 300


def test_ten_thousand_rows_without_an_id(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(rng.randrange(90, 160))) for _ in range(10_000)]
    texts += ["lead " + t for t in texts[:3]]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(8)
    got = {r["__key"]: r.result.n_removed for r in suffix_dedup.without_repeats(docs.withColumn("__key", F.col("text"))).collect()}
    true = brute([(t, t.encode()) for t in by_hash(spark, texts)])
    assert got == {t: x[1] for t, x in true.items()}
