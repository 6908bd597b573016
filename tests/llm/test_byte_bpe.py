import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from comarca.llm import byte_bpe
from comarca.llm.queries import op5_byte_bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(VOCABULARY)


@pytest.fixture(scope="module")
def true(ranks):
    return tiktoken.Encoding("true", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges(ranks):
    return byte_bpe.merges_of(ranks)


@pytest.fixture(scope="module")
def encoder(ranks, merges):
    return byte_bpe._Encoder(ranks, merges, PATTERN)


@pytest.fixture(scope="module")
def back(ranks):
    return byte_bpe._Decoder(ranks)


def test_query_against_tiktoken(spark, sf_dir, true):
    got = op5_byte_bpe(spark, sf_dir).toPandas().set_index("doc_id")
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    assert len(got) == len(texts)
    for doc, text in zip(texts.doc_id, texts.text):
        ids = true.encode_ordinary(text or "")
        row = got.loc[doc]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_the_library_agrees_on_texts_and_on_every_token(true, encoder, ranks, merges, spark, sf_dir):
    fast = byte_bpe._tokenizer(ranks, merges, PATTERN)
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("text").take(60)]
    for text in texts:
        assert fast.encode(text, add_special_tokens=False).ids == true.encode_ordinary(text)
    for token in ranks:
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        assert encoder(text + "x") == np.array(true.encode_ordinary(text + "x"), "<u4").tobytes()


def test_every_byte_and_token_decodes(ranks, back):
    for token, rank in ranks.items():
        assert back(np.array([rank], "<u4").tobytes()) == token
    with pytest.raises(IndexError):
        back(np.array([max(ranks.values()) + 1], "<u4").tobytes())


def test_very_long_texts_are_whole_and_not_kept(true, encoder):
    for text in ("ab\u3000 c" * 40_000, "a" * 300_000, "x" * 50_000 + "\t \n" + "é" * 50_000):
        ids = encoder(text)
        assert ids == np.array(true.encode_ordinary(text), "<u4").tobytes()
    assert max(map(len, encoder.known)) <= byte_bpe.CACHE_LENGTH and max(map(len, encoder.single)) <= byte_bpe.CACHE_LENGTH


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text_against_tiktoken(true, encoder, back, text):
    ids = encoder(text)
    assert ids == np.array(true.encode_ordinary(text), "<u4").tobytes()
    assert back(ids).decode() == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aAé'sll12 \n\t\r 　\x1c\x85.,!日本😀́")), max_size=30))
def test_pieces_are_cut_where_the_pattern_cuts(true, encoder, text):
    ids = true.encode_ordinary(text)
    assert encoder(text) == np.array(ids, "<u4").tobytes()


def test_null_empty_and_split_characters(spark, ranks):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "héé 😀日本", "x"), (3, "héé 😀日本", "x")], "doc_id long, text string, decoded string")
    ids = byte_bpe.encode(docs.withColumnRenamed("decoded", "other"), VOCABULARY, PATTERN)
    back = byte_bpe.decode(ids.selectExpr("*", "ids as again"), VOCABULARY)
    back = byte_bpe.offsets(back.withColumnRenamed("again", "ids"), VOCABULARY).orderBy("doc_id").collect()
    assert [bytes(r.decoded).decode() for r in back] == [r.decoded_text for r in back] == ["", "", "héé 😀日本", "héé 😀日本"]
    assert [len(r.offsets) for r in back][:2] == [0, 0]
    spans = back[2].offsets
    assert spans[0].start == 0 and spans[-1].end == len("héé 😀日本")
    assert all(a.end >= b.start and a.start <= b.start for a, b in zip(spans, spans[1:]))
    cut = ids.where("doc_id = 3").selectExpr("substring(ids, 1, length(ids) - 4) as ids").limit(1)
    assert byte_bpe.decode(cut, VOCABULARY).first().decoded_text.startswith("héé ")
    assert byte_bpe.encode(docs.where("false"), VOCABULARY, PATTERN).count() == 0
