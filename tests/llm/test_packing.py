import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from comarca.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids + [2]


def check(packed, ids_by_doc, longest=4096):
    """Every id in exactly one piece, sequences gapless, checksums right; returns padding."""
    for doc, ids in ids_by_doc.items():
        own = packed[packed.doc_id == doc].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids)
        assert (own.doc_tokens == len(ids)).all()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes())
    padding = 0
    for _, pieces in packed.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
        n = int(pieces.length.sum())
        assert 0 < n <= longest
        padding += 0 if n & (n - 1) == 0 else longest - n
    return padding


def test_pieces_cover_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = packing.with_crc32(packing.pack(docs, VOCABULARY)).toPandas()
    rows = docs.select("doc_id", "text").toPandas()
    ids = {d: ids_of(t) for d, t in zip(rows.doc_id, rows.text)}
    assert check(packed, ids) <= 2 * 4096
    per_step = packed.groupby("step").length.sum()
    assert per_step.max() <= packing.Packing().step_tokens * 1.2


def test_null_empty_repeated_and_special_texts(spark):
    texts = [(1, None), (2, ""), (3, "a <|endoftext|> b <|ENDOFTEXT|> C"), (4, "ΑΣ. ΑΣ, İ.  É́. é, x y z"),
             (5, "It's THE 'S x's. 12.5%  \t\r\n end."), (6, "word, " * 9000)]
    docs = spark.createDataFrame([(d, t, "clash", 7) for d, t in texts], "doc_id long, text string, start string, n int")
    packed = packing.with_crc32(packing.pack(docs, VOCABULARY)).toPandas()
    check(packed, {d: ids_of(t) for d, t in texts})
    twice = packing.with_crc32(packing.pack(docs.union(docs), VOCABULARY)).toPandas()
    assert twice.length.sum() == 2 * packed.length.sum()
    assert packing.pack(docs.where("false"), VOCABULARY).count() == 0
    assert packing.pack(docs.withColumn("doc_id", F.lit(None).cast("long")), VOCABULARY).count() > 0


@pytest.mark.parametrize("lengths", [[513] * 40, [3] * 50, [4096] * 3, [2049, 1, 1025], [700, 300, 20, 5000, 9000] * 7, [1]])
def test_plan_leaves_little_padding(spark, lengths):
    rows = spark.createDataFrame(list(enumerate(lengths)), "row_id long, n long")
    got = packing.plan(rows).toPandas()
    assert got.groupby("row_id").length.sum().to_dict() == dict(enumerate(lengths))
    short = 0
    for _, pieces in got.sort_values("offset").groupby("sequence_id"):
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]]
        n = int(pieces.length.sum())
        assert n <= pieces.tier.iloc[0] and pieces.step.nunique() == 1
        short += n < pieces.tier.iloc[0]
    assert short <= 2


WHOLE, WORDS_OF = Tokenizer.from_file(VOCABULARY), packing.WordEncoder(VOCABULARY, "I")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAbé.,'!sSΣİ́<|> \t\n 　\x1c12ßǅﬁ")), max_size=24))
def test_words_encode_alike_alone(text):
    true = WHOLE.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WORDS_OF(packing.words_in(text)), "<u4").tolist() == true
