"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before it kept, and its decisions take effect:
documents that fail the quality rules go, later copies of line runs are deleted, of each
group of near-duplicates one document stays, repeated bytes are removed, and what remains
is packed.  Between stages the documents are written as Parquet in the shared folder and
read again, so a lost executor costs one stage at most.

All stages but the last return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm import line_dedup, packing, quality_rules, simhash, suffix_dedup
from comarca.llm.common import checkpoint_folder, read_table, remove_table


def _with_chars(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, n_chars (where there is one) counted anew."""
    return docs.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the thresholds of their group."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; one that was nothing else goes."""
    done = line_dedup.delete_repeated_runs(docs)
    something = (F.col("n_removed") == 0) | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")
    return _with_chars(done.where(F.coalesce(something, F.lit(True))), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash links."""
    return simhash.keep_one_of_each(docs)


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 100 bytes that start earlier."""
    return _with_chars(suffix_dedup.remove_repeats(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences: doc_id, start, length, ids_crc32, ..."""
    packed = packing.with_crc32(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")


STAGES = [("quality rules", quality), ("line dedup", lines), ("simhash near-dedup", near_duplicates),
          ("suffix-array dedup", suffixes), ("packing", pack)]

#: XXH64 fingerprints and tokenizers have no SQL; tests/llm/test_pipeline.py has a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:  # the next stage reads what this one wrote
            remove_table(spark, f"{folder}/{number - 1}")
    return docs
