"""Hierarchical packing of documents into sequences of several context sizes.

Every document becomes token ids plus an end id.  Then, on (row, length) alone:

1. Route.  Whole multiples of the longest size are sequences by themselves.  What is left
   of a document goes to the smallest size (tier) that holds it; in the shortest tier it
   is *short*.
2. Fill.  The gaps of longer windows, longest tier first, lie end to end on one line, the
   short documents on another.  Laid over each other, they say which part of which short
   document fills which gap, to the last token.
3. Rest.  Short documents beyond all gaps are packed end to end in windows of the shortest
   tier; documents whose gap the short ones do not reach are packed end to end in windows
   of the longest.  At most two sequences of the whole corpus end in padding.
4. Balance.  Sequences of each tier are dealt evenly over the training steps, so steps hold
   the same number of tokens and the same mix of lengths.

Positions on a line are running totals by bucket (``running_total``): no task sees all
rows.  Overlaps are an equality join on cells of the line.  The driver sees nine sums.

Defined results: NULL and empty texts are the end id alone; a NULL doc_id and repeated rows
are packed as they are; an empty table gives no pieces; other columns are not looked at.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.byte_bpe import byte_characters
from comarca.llm.common import cut, running_total, written

#: Words that a task keeps encoded, in each of two generations (the result does not change).
CACHE_WORDS = 300_000
PIECES = "array<struct<start:long,length:long,sequence_id:long,offset:long,tier:int,step:long>>"


@dataclass(frozen=True)
class Packing:
    """Context sizes (powers of two, longest first), end id, tokens per training step."""

    tiers: tuple[int, ...] = (4096, 2048, 1024, 512)
    end_id: int = 2
    step_tokens: int = 64 * 4096


def words_in(text: str) -> list[str]:
    """What the vocabulary takes apart at white space."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blank to Python, but not to the vocabulary
        return [text]
    # only the spelling "<|...|>" of a special token is one, so such texts keep their case
    return text.lower().split() if text.isascii() and "<|" not in text else text.split()


class WordEncoder:
    """Ids of words without white space; a task encodes equal words once."""

    def __init__(self, vocabulary: str, kind: str):
        import os
        import re

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kind, self.shown = Tokenizer.from_file(vocabulary), kind, byte_characters()
        self.closed = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-`{-~]+)", re.S).fullmatch  # marks but the apostrophe
        #: two generations: what was not asked for since the last change of generation is forgotten
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, word: str) -> bytes:
        if word.isalpha():
            if word.isascii():
                shown = word.lower()
            else:
                lower = unicodedata.normalize("NFC", word).lower()
                shown = "".join(map(self.shown.__getitem__, lower.encode())) if lower.isalpha() and "\u03a3" not in word else None
            if shown:  # letters are one piece of the pattern, so the merges can be asked at once
                return array(self.kind, [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return array(self.kind, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def part(self, word: str) -> bytes:
        """Ids of a word, known or new."""
        if (ids := self.known.get(word)) is None:
            if (ids := self.older.get(word)) is None:
                ids = self.encoded(word)
            self.known[word] = ids
        return ids

    def learn(self, words: list[str]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for word in words:
            if word in known:
                continue
            if (ids := older.get(word)) is None:
                # marks that close a word of letters are a piece of their own
                m = self.closed(word) if not word.isalpha() and "<|" not in word else None
                ids = (self.part(m[1]) + self.part(m[2]) if m and m[1].isalpha() and m[1].lower().isalpha()
                       else self.encoded(word))
            known[word] = ids

    def __call__(self, words: list[str]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(words)
            return b"".join(map(self.known.__getitem__, words))


def tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, text: str = "text") -> DataFrame:
    """(row_id, doc_id, n, ids): ids of each whole text and the end id, 16 or 32 bits each.

    The vocabulary drops white space and never joins over it, so words encode alike alone;
    a task encodes equal words once.
    """
    from tokenizers import Tokenizer

    wide = Tokenizer.from_file(vocabulary).get_vocab_size() > 1 << 16 or end_id >= 1 << 16
    kind, width = ("I", 4) if wide else ("H", 2)  # of array: little-endian wherever Spark runs

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words_of = WordEncoder(vocabulary, kind)
        end = array(kind, [end_id]).tobytes()
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                rows.append(words_of(words_in(t or "")) + end)
            yield pa.array(rows, pa.binary())

    ids = F.arrow_udf(run, "binary")(F.col(text))
    return written(docs.select("doc_id", ids.alias("ids"))
                   .select(F.monotonically_increasing_id().alias("row_id"), "doc_id",
                           (F.length("ids") / width).cast("long").alias("n"), "ids"))


def plan(lengths: DataFrame, packing: Packing = Packing()) -> DataFrame:
    """Where every token goes: (row_id, start, length, sequence_id, offset, tier, step).

    ``lengths`` has row_id (unique) and n >= 1.
    """
    longest, shortest = packing.tiers[0], packing.tiers[-1]
    rest = F.col("n") % longest
    tier = F.expr("CASE " + " ".join(f"WHEN n % {longest} > {t} THEN {u}" for u, t in zip(packing.tiers, packing.tiers[1:]))
                  + f" WHEN n % {longest} > 0 THEN {shortest} ELSE 0 END")
    routed = lengths.select("row_id", "n", (F.col("n") - rest).alias("done"), (F.col("n") / longest).cast("long").alias("whole"),
                            rest.alias("rest"), tier.alias("tier")).withColumns({
                                "gap": F.when(F.col("tier") > shortest, F.col("tier") - F.col("rest")).otherwise(0),
                                "one": F.lit(1)})
    # per tier: running totals of whole windows, of gaps, of tokens, of rows
    routed = cut(running_total(routed, {"whole_at": "whole", "gap_at": "gap", "rest_at": "rest", "row_at": "one"},
                               "row_id", by="tier"))
    sums = {r["tier"]: r for r in routed.groupBy("tier").agg(
        F.sum("whole").alias("whole"), F.sum("gap").alias("gap"), F.sum("rest").alias("rest"), F.count("*").alias("rows")).collect()}
    have = lambda t, c: int(sums[t][c]) if t in sums else 0
    long_tiers, supply = packing.tiers[:-1], have(shortest, "rest")

    # whole windows are numbered tier by tier
    whole_shift, at = {}, 0
    for t in (*packing.tiers, 0):
        whole_shift[t], at = at, at + have(t, "whole")
    n_whole = at
    gap_shift, gap_line = {}, 0
    for t in long_tiers:
        gap_shift[t], gap_line = gap_line, gap_line + have(t, "gap")

    def by_tier(shift: dict[int, int]):
        return F.expr("CASE tier " + " ".join(f"WHEN {t} THEN {s}L" for t, s in shift.items()) + " ELSE 0L END")

    windows = (routed.where(F.col("tier") > shortest).withColumn("gap_at", F.col("gap_at") + by_tier(gap_shift))
               .withColumn("filled", F.col("gap_at") + F.col("gap") <= supply))
    # filled windows of a tier are the first in its order; the others follow it
    state = {(r["tier"], r["filled"]): r for r in windows.groupBy("tier", "filled").agg(
        F.count("*").alias("rows"), F.sum("gap").alias("gap"), F.sum("rest").alias("rest")).collect()}
    of = lambda t, f, c: int(state[t, f][c]) if (t, f) in state else 0
    used = sum(of(t, True, "gap") for t in long_tiers)
    window_shift, late_shift, late, at = {}, {}, 0, n_whole
    for t in long_tiers:
        window_shift[t], at = at, at + of(t, True, "rows")
        # tokens of late windows: those of the tier before are subtracted by the running total
        late_shift[t], late = late - of(t, True, "rest"), late + of(t, False, "rest")
    short_first, short_tokens = at, supply - used
    late_first = short_first + -(-short_tokens // shortest)

    whole = (routed.where("whole > 0").withColumn("first", F.col("whole_at") + by_tier(whole_shift))
             .select("row_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("i"), "first")
             .select("row_id", (F.col("i") * longest).alias("start"), F.lit(longest).cast("long").alias("length"),
                     (F.col("first") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    filled = windows.where("filled").withColumn("sequence_id", F.col("row_at") + by_tier(window_shift))
    heads = filled.select("row_id", F.col("done").alias("start"), F.col("rest").alias("length"), "sequence_id",
                          F.lit(0).cast("long").alias("offset"))
    short = routed.where(F.col("tier") == shortest)

    cell = shortest  # of the line; neither side has more than one row per token in a cell
    cells = lambda lo, hi: F.explode(F.expr(f"sequence({lo} DIV {cell}, ({hi} - 1) DIV {cell})"))
    gaps = (filled.where("gap > 0").select("sequence_id", F.col("rest").alias("filled_to"), "gap_at", (F.col("gap_at") + F.col("gap")).alias("gap_to"))
            .withColumn("cell", cells("gap_at", "gap_to")))
    parts = (short.where(F.col("rest_at") < used).select("row_id", "done", "rest_at", (F.col("rest_at") + F.col("rest")).alias("rest_to"))
             .withColumn("cell", cells("rest_at", "rest_to")))
    low, high = F.greatest("gap_at", "rest_at"), F.least("gap_to", "rest_to")
    fills = (gaps.join(parts, "cell").where((low < high) & (F.col("cell") == F.floor(low / cell)))
             .select("row_id", (F.col("done") + low - F.col("rest_at")).alias("start"), (high - low).alias("length"), "sequence_id",
                     (F.col("filled_to") + low - F.col("gap_at")).alias("offset")))

    def end_to_end(rows: DataFrame, size: int, first: int) -> DataFrame:
        """Pieces of rows laid end to end (row_id, from_, at, length) and cut at every ``size``."""
        return (rows.withColumn("w", F.explode(F.expr(f"sequence(at DIV {size}, (at + length - 1) DIV {size})")))
                .withColumns({"lo": F.greatest(F.col("at"), F.col("w") * size), "hi": F.least(F.col("at") + F.col("length"), (F.col("w") + 1) * size)})
                .select("row_id", (F.col("from_") + F.col("lo") - F.col("at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"),
                        (F.col("w") + first).alias("sequence_id"), (F.col("lo") - F.col("w") * size).alias("offset")))

    beyond = (short.where(F.col("rest_at") + F.col("rest") > used)
              .select("row_id", F.greatest(F.col("rest_at"), F.lit(used)).alias("at_"), "rest_at", "rest", "done")
              .select("row_id", (F.col("done") + F.col("at_") - F.col("rest_at")).alias("from_"), (F.col("at_") - used).alias("at"),
                      (F.col("rest_at") + F.col("rest") - F.col("at_")).alias("length")))
    unfilled = (windows.where("NOT filled")
                .select("row_id", F.col("done").alias("from_"), (F.col("rest_at") + by_tier(late_shift)).alias("at"), F.col("rest").alias("length")))

    steps = max(1, -(-(n_whole * longest + sum(of(t, True, "rows") * t for t in long_tiers) + short_tokens + late) // packing.step_tokens))
    kinds = [(whole, longest, 0, n_whole), *[(x.where((F.col("sequence_id") >= window_shift[t]) & (F.col("sequence_id") < window_shift[t] + of(t, True, "rows"))), t, window_shift[t], of(t, True, "rows")) for t in long_tiers for x in (heads, fills)],
             (end_to_end(beyond, shortest, short_first), shortest, short_first, -(-short_tokens // shortest)),
             (end_to_end(unfilled, longest, late_first), longest, late_first, -(-late // longest))]
    out = None
    for rows, size, first, count in kinds:
        one = rows.select("row_id", "start", "length", "sequence_id", "offset", F.lit(size).alias("tier"),
                          F.expr(f"(sequence_id - {first}L) * {steps}L DIV {max(count, 1)}L").alias("step"))
        out = one if out is None else out.unionByName(one)
    return out


def pack(docs: DataFrame, vocabulary: str, packing: Packing = Packing(), text: str = "text") -> DataFrame:
    """One row per piece, with its ids: doc_id, start, length, ids (32-bit binary),
    doc_tokens, sequence_id, offset, tier, step."""
    table = tokens(docs, vocabulary, packing.end_id, text)
    pieces = plan(table.select("row_id", "n"), packing)
    by_row = pieces.groupBy("row_id").agg(
        F.collect_list(F.struct("start", "length", "sequence_id", "offset", "tier", "step")).alias("pieces"))
    placed = (by_row.join(table, "row_id")
              .select("doc_id", "n", "ids", F.explode("pieces").alias("p")).select("doc_id", "n", "p.*", "ids"))
    width = F.length("ids") / F.col("n")
    return placed.select("doc_id", "start", "length",
                         F.substring(F.col("ids"), (F.col("start") * width).cast("int") + 1, (F.col("length") * width).cast("int")).alias("ids"),
                         F.col("n").alias("doc_tokens"), "sequence_id", "offset", "tier", "step", width.cast("int").alias("id_bytes"))


def with_crc32(packed: DataFrame) -> DataFrame:
    """Add ids_crc32, over the ids as little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, widths in batches:
            yield pa.array([zlib.crc32(np.frombuffer(x.as_buffer(), f"<u{w}").astype("<u4").tobytes())
                            for x, w in zip(ids, widths.to_pylist())], pa.int64())

    return packed.withColumn("ids_crc32", F.arrow_udf(run, "long")(F.col("ids"), F.col("id_bytes")))
