import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

import test_line_dedup
import test_simhash
import test_suffix_dedup
from comarca.llm import quality_rules


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.judged(docs).collect() if r.kept}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    whole = dict(rows)
    rows = sorted((d, t) for d, t in test_line_dedup.brute(rows, 2).items() if t == whole[d] or t.split())
    groups = test_simhash.expected(rows)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    rows = [(d, x[3].decode("utf-8", "ignore")) for d, x in test_suffix_dedup.brute([(d, t.encode()) for d, t in rows]).items()]
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = {d: len(encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}

    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_columns_are_kept_and_empty_tables_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(30), sf_dir)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
