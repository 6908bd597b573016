"""Near-duplicates by SimHash, found through an index of bytes at their positions.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their
eight bytes: at least six bytes are equal at their positions.  The index lists
fingerprints by bytes at positions.  One byte alone makes lists that grow with the corpus
(1/256 of it each), so a list is kept per *four* positions: the bytes form four
neighbouring pairs, two of which are equal in any linked fingerprints, hence six lists per
fingerprint, of 32 equal bits each.  Fingerprints that meet in a list are tallied: pairs
with fewer than six equal bytes go, the rest are verified by counting differing bits.

A list longer than ``LONG_LIST`` (many near copies of one text) is not paired.  Its
members are written under their own value and under every value one bit away (33 keys).
Two members share a key exactly if they differ in at most two bits, and a key has at most
33 members, so each key links its members to the smallest one.  This is exact too, and
linear in the length of the list.

Equal fingerprints are one class first; copies are never expanded into pairs.

Defined results: NULL, empty and blank texts have fingerprint zero and link like any
other; rows of one doc_id are fingerprinted each; a NULL doc_id is never the smallest of
a component, unless there is no other (then component_id is NULL); an empty table gives
no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import components, cut

WORDS, SEED, MAX_BITS, MIN_BYTES = 3, 42, 2, 6
LONG_LIST = 64
_PAIRS = [0xFFFF << s for s in (0, 16, 32, 48)]
#: the six sets of four byte positions
POSITIONS = [a | b for i, a in enumerate(_PAIRS) for b in _PAIRS[i + 1:]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints_of(texts: pd.Series) -> pd.Series:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for row, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        first = np.concatenate([[0], ends[:-1] + 1])
        last = ends[WORDS - 1:] if len(words) > WORDS else ends[-1:]
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist())),
                             np.uint64, len(last))
        set_ = np.zeros(64, np.int64)
        for part in range(0, len(hashes), 1 << 16):
            octets = hashes[part:part + (1 << 16)].view(np.uint8).reshape(-1, 8)
            set_ += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = np.packbits(2 * set_ > len(hashes), bitorder="little").view(np.uint64)[0]
    return pd.Series(out.view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    return docs.withColumn(out, F.pandas_udf(fingerprints_of, "long")(F.col(text)))


def equal_bytes(a: str, b: str):
    """How many of the eight bytes of two columns are equal at their positions."""
    return sum(((F.col(a).bitwiseXOR(F.col(b)).bitwiseAND(F.lit(_signed(0xFF << s)))) == 0).cast("int") for s in range(0, 64, 8))


def links(distinct: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp``; all that keep every component together.

    Short lists give each pair of at most two differing bits, long lists stars of such pairs.
    """
    postings = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bytes"), F.lit(_signed(~m & (1 << 64) - 1)).alias("free"))
        for i, m in enumerate(POSITIONS)])).alias("p")).select("fp", "p.*")
    sizes = postings.groupBy("at", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    listed = cut(postings.join(sizes, ["at", "bytes"]))

    short = listed.where(F.col("n") <= long_list)
    met = (short.select("at", "bytes", F.col("fp").alias("a"))
           .join(short.select("at", "bytes", F.col("fp").alias("b")), ["at", "bytes"]).where("a < b"))
    pairs = (met.where(equal_bytes("a", "b") >= MIN_BYTES)
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS).select("a", "b"))

    bits = F.array(*[F.lit(_signed(1 << i)) for i in range(64)])
    keys = F.concat(F.array(F.lit(0).cast("long")), F.filter(bits, lambda x: x.bitwiseAND(F.col("free")) != 0))
    stars = (listed.where(F.col("n") > long_list).select("at", "fp", F.explode(keys).alias("flip"))
             .groupBy("at", F.col("fp").bitwiseXOR(F.col("flip")).alias("key"))
             .agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
             .select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest doc_id reachable over links."""
    rows = cut(with_fingerprint(docs.select("doc_id", F.col(text).alias("text"))).select("doc_id", "fp"))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = components(links(classes.select("fp")))
    labelled = classes.join(linked, classes.fp == linked.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.join(smallest, "root").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(named, rows.fp == F.col("__fp")).select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its component.

    A row without doc_id stays; a doc_id with several rows stays if any of them would.
    """
    stays = near_duplicates(docs).groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    gone = stays.where("NOT stays").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti").select(docs.columns)
