"""Language identification by interpolated Kneser-Ney character models.

A text is its runs of letters, lower-cased, each between boundary marks.  Every labelled
training document, whole, gives n-grams of ``ORDER`` characters with their counts, added up per
task (by way of its distinct words) before they are shuffled.  From these, built-in aggregations make the
Kneser-Ney tables: the highest order counts occurrences, lower orders count the different
characters an n-gram follows, and each order has its own discount n1 / (n1 + 2 n2):

    p(c | h) = max(count(hc) - D, 0) / count(h) + D * types(h) / count(h) * p(c | shorter h)

The model is, per order, an array of n-gram hashes in order with the probability of each
under each language, and one of contexts with the weight each hands down.  The hash of up
to four characters of 16 bits is the characters themselves (those beyond U+FFFF are one),
so it has no collisions.  A character is looked up from the longest context down.  The
language of the lowest cross-entropy per character wins.

``score`` is the softmax of the entropies over a temperature that is fitted, with the
entropy each language rejects beyond, on texts that the model has not learnt: a calibration
fold of the labelled texts, chosen by a hash of the text, so exact copies stay together (at
most about ``calibration_docs``, and a tenth of the texts).  A language with nothing
but its fold learns from the fold, too.  ``rejected`` marks texts whose entropy lies beyond that of all but one
in a thousand texts of the fold in their language; lang_pred is still the best language.

What reaches the driver is the model, whole: every n-gram of every language, with its
language as a number, and the sample's entropies.  No count is left out, so discounts, totals
and types are those of all texts.  The model grows with the different n-grams of the
labelled languages (not with their occurrences) and has to fit the driver and a worker.

Defined results: NULL texts and texts without a letter are ``und`` with score 0; ties go to
the first language by name; without any labelled training text everything is ``und``; lang,
source and doc_id are no input of a prediction; repeated rows count and are judged each; very
long texts are counted and scored whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.common import cut

ORDER = 4
MARK = " "
RUNS = re.compile(r"[^\W\d_]+")
#: Tokens of which a task keeps the scores; others are scored when they come (the result does not change).
CACHE_WORDS = 300_000
#: Texts that are scored at a time.
SLICE = 200


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: from the highest order: hashes of n-grams, probabilities, hashes of contexts, weights (a column per language)
    orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: probability of a character never seen, by language
    unseen: np.ndarray


def tokens(text: str | None) -> list[str]:
    """What stands between white space, lower-cased; no run of letters is longer."""
    return text.lower().split() if text else []


def letters(token: str) -> list[str]:
    """Runs of letters."""
    if token.isalpha():
        return [token]
    found = RUNS.findall(token)
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each character of the words (and the mark behind), and their number by word."""
    joined = "".join([MARK * (ORDER - 1) + w + MARK for w in words])
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF).astype(np.uint64)
    whole = codes[:-3] << np.uint64(48) | codes[1:-2] << np.uint64(32) | codes[2:-1] << np.uint64(16) | codes[3:]
    counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(counts + ORDER - 1) - (counts + ORDER - 1)
    at = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return whole[at], counts


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(lang, g, c): n-grams over whole texts, as numbers; each task adds up before it hands on."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                counts.setdefault(lang, Counter()).update(tokens(text))
            for lang, found in counts.items():
                words: Counter = Counter()
                for token, n in found.items():
                    for word in letters(token):
                        words[word] += n
                if words:
                    grams, each = grams_of(list(words))
                    names, of = np.unique(grams, return_inverse=True)
                    n = np.bincount(of, weights=np.repeat(np.fromiter(words.values(), np.float64, len(words)), each))
                    yield pd.DataFrame({"lang": lang, "g": names.view(np.int64), "c": n.astype(np.int64)})

    return (labelled.select("lang", "text").where("text IS NOT NULL AND lang IS NOT NULL")
            .mapInPandas(run, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c")))


def train(labelled: DataFrame) -> Model:
    """Kneser-Ney models of every language of ``labelled`` (lang, text)."""
    last = lambda k: F.col("g").bitwiseAND((1 << 16 * k) - 1)  # noqa: E731  the last k characters
    grams = [cut(gram_counts(labelled))]
    languages = sorted(r["lang"] for r in grams[0].select("lang").distinct().collect())
    number = (F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1).cast("int").alias("lang")
    for k in range(ORDER - 1, 0, -1):  # how many different characters an n-gram follows
        grams.append(cut(grams[-1].groupBy("lang", last(k).alias("g")).agg(F.count("*").alias("c"))))
    lower, tables = None, []
    for k, table in zip(range(1, ORDER + 1), reversed(grams)):
        # a row per language: what follows is dealt by context, never by language
        by_lang = table.groupBy("lang").agg(F.count(F.when(F.col("c") == 1, 1)).alias("n1"), F.count(F.when(F.col("c") == 2, 1)).alias("n2"),
                                            F.count("*").alias("seen"))
        counted = table.join(F.broadcast(by_lang), "lang").withColumn("h", F.shiftrightunsigned("g", 16))
        discount = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        context = Window.partitionBy("lang", "h")
        weighed = counted.withColumn("d", discount).withColumns({
            "all": F.sum("c").over(context), "handed": F.col("d") * F.count("*").over(context) / F.sum("c").over(context)})
        own = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("all")
        if lower is None:  # below single characters: every character seen, and one unseen, alike
            done = weighed.withColumn("p", own + F.col("handed") / (F.col("seen") + 1))
        else:
            suffix = lower.select("lang", F.col("g").alias("__g"), F.col("p").alias("__p"))
            done = weighed.withColumn("__g", last(k - 1)).join(suffix, ["lang", "__g"]).withColumn("p", own + F.col("handed") * F.col("__p"))
        lower = cut(done.select("lang", "g", "h", "p", "handed"))
        tables.append(lower.select(number if languages else F.lit(0).alias("lang"), "g", "h", "p", "handed").toPandas())

    def array_of(table: pd.DataFrame, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
        keys = table[key].to_numpy(np.int64).view(np.uint64)
        names = np.unique(keys)
        values = np.zeros((len(names), len(languages)))
        values[np.searchsorted(names, keys), table["lang"].to_numpy(np.int64)] = table[value]
        return names, values

    unseen = np.array([1 / ((tables[0]["lang"] == i).sum() + 1) for i in range(len(languages))])
    return Model(languages, [(*array_of(t, "g", "p"), *array_of(t, "h", "handed")) for t in reversed(tables)], unseen)


def _found(hashes: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The values of the hashes asked for; zero where there is none."""
    at = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
    return np.where((hashes[at] == asked)[:, None], values[at], 0.0)


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    """Negative log2 probability of each word under each language, boundary mark at its end included."""
    grams, counts = grams_of(words)
    names, of = np.unique(grams, return_inverse=True)
    p, weight = np.zeros((len(names), len(model.languages))), np.ones((len(names), len(model.languages)))
    for k, (hashes, probabilities, heads, handed) in zip(range(ORDER, 0, -1), model.orders):
        gram = names & np.uint64((1 << 16 * k) - 1)
        value, share = _found(hashes, probabilities, gram), _found(heads, handed, gram >> np.uint64(16))
        open_ = p == 0
        p = np.where(open_ & (value > 0), weight * value, p)
        weight = np.where(share > 0, weight * share, weight)
    bits = -np.log2(np.maximum(np.where(p == 0, weight * model.unseen, p), 1e-30))
    return np.add.reduceat(bits[of], np.cumsum(counts) - counts, axis=0)


def entropies(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``entropy``: cross-entropy per character under each language; NULL without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # every n-gram of the labelled languages

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, known = shared.value, {}
        width = len(model.languages) + 1  # of each word: bits by language, characters
        table, used = np.zeros((1 << 16, width)), 0
        for texts in batches:
            rows = []
            for at in range(0, len(texts), SLICE):
                words = [tokens(t) for t in texts.iloc[at:at + SLICE]]
                places = [np.fromiter(map(known.get, own, repeat(-1)), np.int64, len(own)) for own in words]
                missing = [np.flatnonzero(p < 0).tolist() for p in places]
                new = list(dict.fromkeys(own[i] for own, m in zip(words, missing) for i in m))
                if new and model.languages:
                    if used + len(new) > len(table):
                        table = np.concatenate([table[:used], np.zeros((used + 2 * len(new), width))])
                    runs = [letters(w) for w in new]
                    of = np.repeat(np.arange(used, used + len(new)), [len(r) for r in runs])
                    flat = [w for r in runs for w in r]
                    table[used:used + len(new)] = 0
                    if flat:
                        np.add.at(table, of, np.column_stack([word_scores(model, flat), [len(w) + 1 for w in flat]]))
                    fresh = dict(zip(new, range(used, used + len(new))))
                    for own, p, m in zip(words, places, missing):
                        p[m] = [fresh[own[i]] for i in m]
                    if used < CACHE_WORDS:
                        known.update(fresh)
                        used += len(new)
                for p in places:
                    total = table[p].sum(axis=0) if len(p) and model.languages else None
                    rows.append(None if total is None or not total[-1] else total[:-1] / total[-1])
            yield pd.Series(rows, dtype=object)

    return docs.withColumn("entropy", F.pandas_udf(run, "array<double>")(F.col(text)))


def _softmax(h: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp(-(h - h.min(axis=1, keepdims=True)) / temperature)
    return e / e.sum(axis=1, keepdims=True)


def calibration_fold(labelled: DataFrame, calibration_docs: int = 5_000) -> tuple[DataFrame, DataFrame]:
    """(to learn, to calibrate): ``labelled`` without and with the calibration fold.

    Languages that have no other rows are in both.  What is gathered is a row per language.
    """
    bits = 1 << 20
    place = F.pmod(F.xxhash64(F.lit(4), "text"), F.lit(bits))
    total = labelled.count()
    share = int(min(0.1, calibration_docs / max(total, 1)) * bits)
    folds = labelled.groupBy("lang").agg(F.min((place < share).cast("int")).alias("all_in")).where("all_in = 1").collect()
    only = [r["lang"] for r in folds]
    rest = (place >= share) | F.col("lang").isin(only) if only else place >= share
    return labelled.where(rest), labelled.where(place < share)


def calibrate(fold: DataFrame, model: Model) -> tuple[float, list[float]]:
    """Temperature, and per language the entropy of all but one in a thousand of its texts.

    ``fold`` (lang, text) is a bounded share of the texts; its copies count once, so what is gathered is bounded, too.
    """
    texts = fold.select("lang", "text").dropDuplicates()
    rows = entropies(texts, model).where("entropy IS NOT NULL").select("lang", "entropy").collect()
    at = {lang: i for i, lang in enumerate(model.languages)}
    rows = [r for r in rows if r["lang"] in at]
    if not rows:
        return 1.0, [float("inf")] * len(model.languages)
    h, true = np.array([r["entropy"] for r in rows]), np.array([at[r["lang"]] for r in rows])
    own = h[np.arange(len(h)), true]
    losses = {t: -np.log(np.maximum(_softmax(h, t)[np.arange(len(h)), true], 1e-12)).mean() for t in (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)}
    limits = [float(np.quantile(own[true == i], 0.999)) if (true == i).any() else float("inf") for i in range(len(model.languages))]
    return min(losses, key=losses.get), limits


def predict(docs: DataFrame, model: Model, calibration: tuple[float, list[float]], text: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected."""
    temperature, limits = calibration
    scored = entropies(docs, model, text)
    best = F.array_min("entropy")
    at = (F.array_position("entropy", best)).cast("int")
    name = F.element_at(F.array(*[F.lit(x) for x in model.languages]), at) if model.languages else F.lit(None).cast("string")
    share = F.aggregate("entropy", F.lit(0.0), lambda s, h: s + F.exp(-(h - best) / temperature))
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), at) if limits else F.lit(None).cast("double")
    return scored.withColumns({
        "lang_pred": F.when(F.col("entropy").isNotNull(), name).otherwise(F.lit("und")), "score": F.coalesce(1 / share, F.lit(0.0)),
        "rejected": F.coalesce(best > limit, F.lit(True))}).drop("entropy")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo five; fold zero is held out."""
    return F.crc32(doc_id.cast("string")) % 5


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs`` that are not held out and predict all of them."""
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    learnt, unlearnt = calibration_fold(labelled)
    model = train(learnt)
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, calibrate(unlearnt, model)).drop("text")
