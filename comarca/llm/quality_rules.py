"""Quality rules with thresholds that follow each language and source.

A document is measured once (whole text).  Four ratios are then judged against their own
group: a quantile sketch per (lang, source) gives the group's quartiles, and a document is
rejected where a ratio lies beyond the upper (or lower) fence

    quartile +/- max(spread * interquartile range, least_spread of the ratio) * width,

where width is 1 from ``steady_words`` words on and grows with the root of their lack, as a
ratio over few words says less.

The sketch is a histogram of whole numbers in logarithmic bins, 32 bins per power of two
(relative error 1/32 at most).  It is a table (group, measure, bin, n), so sketches merge
by adding rows: the same rows give the sketch of a language (all its sources) and of the
corpus.  A group of fewer than ``least_rows`` documents borrows its language's thresholds,
and a language of fewer the corpus'.  The bins are whole-number arithmetic: any order and
any split of the rows gives the same thresholds.

Each of the four can reject what the base rules pass: words too long or short, symbols, lines
that occur before, and repeated windows from half of the base rule's share on.

Defined results: texts of any length are read whole; NULL and empty texts count zero words and fail the base rules; NULL lang
or source is a group of its own; repeated rows are judged each; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.common import cut, null_safe

SYMBOLS = "#*$%&|<>"
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: The ratios that are judged, as whole numbers per ten thousand words.
MEASURES = ("word_length", "symbols", "dup_lines", "repeats")


@dataclass(frozen=True)
class QualityRules:
    """Parameters: base rules, and the distance of the fences from the quartiles."""

    min_words: int = 10
    max_repeat_percent: int = 20
    spread: int = 6
    #: least distance of a fence, in the unit of the measure (1/10,000)
    least_spread: tuple[int, int, int, int] = (20_000, 1_000, 1_000, 1_000)
    steady_words: int = 100
    least_rows: int = 100


#: Windows of texts of more words are compared as numbers, 20 bytes each, instead of as words.
MANY_WORDS = 20_000


def _repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more, of a long text."""
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
    windows = np.stack([ids[i:len(ids) - 4 + i] for i in range(5)], axis=1)
    order = np.lexsort(windows.T)
    same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    again = np.zeros(len(windows), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for i in range(5):
        covered[i:i + len(windows)] |= again
    return int(covered.sum())


def text_counts(texts: pd.Series) -> pd.DataFrame:
    """Counts of every whole text.  Words are runs of bytes other than ASCII white space."""
    rows = []
    for text in texts:
        if not text:
            rows.append((0, 0, 0, 0, 0))
            continue
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        symbols = sum(map(text.count, SYMBOLS))
        seen, dup = set(), 0
        if "\n" in text:
            for line in text.split("\n"):
                if line.strip(" \t\n\x0b\x0c\r"):
                    if line in seen:
                        dup += 1
                    else:
                        seen.add(line)
        repeated = 0
        if n > MANY_WORDS:
            repeated = _repeated_words(words)
        elif n > 5:
            windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
            if len(first := set(windows)) < len(windows):
                counts: dict = {}
                for w in windows:
                    counts[w] = counts.get(w, 0) + 1
                end = 0  # words before this one are counted
                for i, w in enumerate(windows):
                    if counts[w] > 1:
                        repeated += i + 5 - max(i, end)
                        end = i + 5
            del first
        rows.append((n, chars, symbols, dup, repeated))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")])


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``counts``, a struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return docs.withColumn("counts", F.pandas_udf(text_counts, COUNTS)(F.col(text)))


#: The bin of a value: below 64 each value its own, then 32 bins per power of two.
_BIN = """CASE WHEN v < 64 THEN v
          ELSE (length(conv(v, 10, 2)) - 6) * 32 + shiftright(v, length(conv(v, 10, 2)) - 6) END"""
#: The smallest value of a bin.
_BIN_LOW = "CASE WHEN bin < 64 THEN bin ELSE shiftleft(bin % 32 + 32, CAST(bin DIV 32 AS INT) - 1) END"


def sketch(measured: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the quantile sketches of all groups."""
    values = measured.where(~F.col("base_failed")).select(
        "lang", "source",
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])).alias("x"))
    return (values.select("lang", "source", "x.measure", "x.v").withColumn("bin", F.expr(_BIN))
            .groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n")))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches over ``keys`` and read (rows, q1, q3) of every measure from the bins."""
    merged = sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    ranked = merged.select(*keys, "measure", "bin", F.expr(_BIN_LOW).alias("low"), "n",
                           F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("rows"))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows"), F.col("low"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("rows") * 3, F.col("low"))).alias("q3"))


def thresholds(sketches: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """(lang, source) with q1, q3 and spread of every measure; small groups borrow from larger ones."""
    least = F.create_map(*[F.lit(x) for m, s in zip(MEASURES, rules.least_spread) for x in (m, s)])
    parts = ("q1", "q3", "spread")

    def fences(keys: list[str]) -> DataFrame:
        q = quartiles(sketches, keys).withColumn(
            "spread", F.greatest((F.col("q3") - F.col("q1")) * rules.spread, F.element_at(least, F.col("measure"))))
        return q.groupBy(*keys).agg(F.max("rows").alias("rows"), *[
            F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{m}_{e}") for m in MEASURES for e in parts])

    names = [f"{m}_{e}" for m in MEASURES for e in parts]
    corpus, enough = fences([]).first(), F.col("rows") >= rules.least_rows  # twelve numbers
    languages = fences(["lang"]).select("lang", *[F.when(enough, F.col(c)).otherwise(F.lit(corpus[c])).alias(f"__{c}") for c in names])
    return null_safe(fences(["lang", "source"]), languages, ["lang"]).select(
        "lang", "source", *[F.when(enough, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in names])


#: Two hashes of a text: with lang and source they decide a row's verdict.
HASHES = ["__text_a", "__text_b"]


def _hashes(text: str) -> list:
    return [F.xxhash64(text).alias(HASHES[0]), F.xxhash64(F.lit(1), text).alias(HASHES[1])]


def measured(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """(doc_id, lang, source, counts..., base_failed, ratios) of every row, computed once."""
    flat = (with_counts(docs.select("doc_id", "lang", "source", text, *_hashes(text)), text)
            .select("doc_id", "lang", "source", *HASHES, "counts.*"))
    per_word = lambda c: F.expr(f"{c} * 10000 DIV greatest(n_words, 1)")
    return cut(flat.withColumns({
        "base_failed": (F.col("n_words") < rules.min_words)
        | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent),
        "word_length": per_word("word_chars"), "symbols": per_word("n_symbols"),
        "dup_lines": per_word("n_dup_lines"), "repeats": per_word("n_repeat_words")}))


def _verdicts(docs: DataFrame, rules: QualityRules, text: str) -> DataFrame:
    rows = measured(docs, rules, text)
    limits = cut(thresholds(cut(sketch(rows)), rules))
    verdict = F.lit(True)
    width = F.sqrt(F.greatest(F.lit(1.0), rules.steady_words / F.greatest(F.col("n_words"), F.lit(1))))
    for m in MEASURES:
        beyond = F.greatest(F.col(m) - F.col(f"{m}_q3"), F.col(f"{m}_q1") - F.col(m))
        verdict &= beyond <= F.col(f"{m}_spread") * width
    # every group of a row that passed the base rules has thresholds
    return (null_safe(rows, limits, ["lang", "source"], "left")
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict, F.lit(True))))


def judged(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text: counts, base_failed and kept."""
    return _verdicts(docs, rules, text).select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                               "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that pass, each by its own text, lang and source, whatever its doc_id."""
    keys = ["lang", "source", *HASHES]
    bad = _verdicts(docs, rules, "text").where(~F.col("kept")).select(keys).distinct()
    return null_safe(docs.select("*", *_hashes("text")), bad, keys, "left_anti").select(docs.columns)
