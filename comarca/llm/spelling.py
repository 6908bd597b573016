"""Group spelling variants: words one inserted, deleted or replaced code point apart.

* Vocabulary.  Runs of letters of whole texts are counted, first within a task, then over
  all.  A stated share of the (document, run) pairs loses a code point first.
* Sorted lists.  Two words of six code points or more that are one edit apart share their
  first three or their last three code points.  So the vocabulary is sorted twice, by the
  word and by the word backwards, and cut into ranges whose words share their first
  ``ANCHOR`` code points; a range of more than ``CROWD`` words is cut again where its words
  part.  A pair that shares its first three code points is found in the first list, every
  other pair in the second, so none comes twice.
* Edit matrix by ranges.  In a sorted list the words that share a prefix are neighbours, and
  the rows of their edit matrices agree as far as their longest common prefix with the word
  before.  All words of a range are therefore scanned at once, one code point deeper each
  step: a row (its three cells around the diagonal, no other can hold one edit) is worked
  out once per shared prefix, and a range whose shared prefix holds more than one edit is
  skipped as a whole.
* The ranges that a word of a crowded prefix has to visit are found by the same scan, over
  the sorted list of what the words of each range share.

Defined results: NULL and empty texts have no words; rows that repeat doc_id and text count
each; a NULL doc_id is empty text where a pair is chosen; a text of any length is read to
its end, its words counted as they come; ties of two forms go to the smaller word in
code-point order; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comarca.llm.common import cut, written

RUN = "[A-Za-zÀ-ÿ]+"
#: Words shorter than twice ANCHOR have no near words.
ANCHOR = 3
#: So many words of a list meet in one range.
CROWD = 4096
#: Ranges are scanned together up to so many words.
TOGETHER = 16_384
#: Texts longer than so many characters are counted as they are read, not as a list of words.
LONG = 1 << 20
#: A task hands on its counts at so many different words.
HELD = 300_000
#: A form has at least five times the count of its word, so from a count of one (at most
#: 2 ** 63 in the end) no chain is longer than 27 steps, and 5 doublings reach its end.
DOUBLINGS = 5


def _thinned(prefix: str, word: str, one_in: int) -> str:
    """``word``, or where one_in divides its hash, ``word`` without the code point the hash names."""
    h = zlib.crc32((prefix + word).encode())
    if h % one_in:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(docs: DataFrame, run: str = RUN, least_length: int = 2 * ANCHOR, least_count: int = 5,
               one_in: int = 199) -> DataFrame:
    """(word, n): the words of at least ``least_length`` code points that occur ``least_count`` times.

    Words are runs of ``run`` with A-Z in lower case; in one of ``one_in`` (document, run)
    pairs, by crc32, a code point is missing.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = re.compile(run), Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: A-Z only
                found = Counter(words.findall(text)) if len(text) <= LONG else Counter(m.group() for m in words.finditer(text))
                doc = doc.as_py()
                prefix = f"{'' if doc is None else doc}:"
                for word, n in found.items():
                    word = _thinned(prefix, word, one_in)
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _codes(words: list[str]):
    """Code points of all words in one array, where each begins, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.concatenate([flat, np.zeros(2, np.uint32)]), np.cumsum(lengths) - lengths, lengths


def _common_prefixes(flat, begins, lengths) -> np.ndarray:
    """Length of the longest common prefix of each word with the one before (the first: 0)."""
    lcp = np.zeros(len(begins), np.int64)
    same, depth = np.arange(1, len(begins)), 0
    while len(same):
        same = same[(lengths[same] > depth) & (lengths[same - 1] > depth)]
        same = same[flat[begins[same] + depth] == flat[begins[same - 1] + depth]]
        depth += 1
        lcp[same] = depth
    return lcp


class SortedList:
    """A sorted list of different words, scanned by ranges that share a prefix."""

    def __init__(self, words: list[str]):
        self.flat, self.begins, self.lengths = _codes(words)
        lcp = _common_prefixes(self.flat, self.begins, self.lengths)
        self._order = np.argsort(lcp, kind="stable")  # places where the list parts, by depth
        self._lcp = lcp[self._order]

    def _parts(self, depth: int) -> np.ndarray:
        lo, hi = np.searchsorted(self._lcp, [depth, depth + 1])
        return self._order[lo:hi]

    def scan(self, queries: list[str], lo: np.ndarray, hi: np.ndarray, prefixes: bool = False):
        """(query, word) numbers of the words of each query's range [lo, hi) one edit from it.

        The words of a range and its query share their first ANCHOR code points.  With
        ``prefixes``: all words of which the query has a prefix within one edit.
        """
        q_flat, q_begins, q_lengths = _codes(queries)
        query = np.flatnonzero(hi > lo)
        lo, hi, depth = lo[query], hi[query], ANCHOR
        # the row of a shared prefix: distance to the query's first depth - 1, depth, depth + 1 code points
        row = np.array([[1], [0], [1]], np.int8).repeat(len(query), axis=1)
        found = []

        def ended():
            last = self.lengths[lo] == depth
            if prefixes:
                hit = last
            else:
                cell = q_lengths[query] - depth + 1
                hit = last & (cell >= 0) & (cell <= 2)
                hit[hit] = row[cell[hit], np.flatnonzero(hit)] == 1
            found.append((query[hit], lo[hit]))
            return last

        last = ended()
        while len(query):
            # one code point deeper: every range parts where the common prefix ends
            parts = self._parts(depth)
            first, beyond = np.searchsorted(parts, lo, "right"), np.searchsorted(parts, hi, "left")
            own = 1 - last.astype(np.int64)  # a word that ends here is no part
            count = own + beyond - first
            total = int(count.sum())
            if not total:
                break
            item = np.repeat(np.arange(len(query)), count)
            nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            at = first[item] + nth - own[item]  # its place among the parts; before the first: the range's own start
            at_own = at < first[item]
            new_lo = np.where(at_own, lo[item], parts[np.maximum(at, 0)] if len(parts) else 0)
            follows = at + 1 < beyond[item]
            new_hi = np.where(follows, parts[np.minimum(at + 1, len(parts) - 1)] if len(parts) else 0, hi[item])
            query, old = query[item], row[:, item]
            letter = self.flat[self.begins[new_lo] + depth]
            begin, length = q_begins[query], q_lengths[query]

            def differs(at):  # the query's code point at (beyond its end: no cell)
                return np.where(at < length, q_flat[begin + np.minimum(at, length - 1)] != letter, 9).astype(np.int8)

            row = np.empty_like(old)
            row[0] = np.minimum(old[1] + 1, old[0] + differs(depth - 1))
            row[1] = np.minimum(np.minimum(old[2] + 1, old[1] + differs(depth)), row[0] + 1)
            row[2] = np.minimum(old[2] + differs(depth + 1), row[1] + 1)
            beyond_end = np.arange(depth, depth + 3)[:, None] > length
            row[beyond_end] = 9
            depth += 1
            alive = row.min(axis=0) <= 1
            query, lo, hi, row = query[alive], new_lo[alive], new_hi[alive], row[:, alive]
            last = ended()
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return map(np.concatenate, zip(*found))


def _lists(words: DataFrame) -> DataFrame:
    """(side, key, n): every word in the list by its beginning (0) and in the one by its end (1)."""
    return words.select(F.posexplode(F.array("word", F.reverse("word"))).alias("side", "key"), "n")


def _parting(low: str, high: str) -> int:
    return next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))


def _cut_ranges(crowded: DataFrame) -> list[tuple[int, str]]:
    """(side, shared prefix) of the ranges of at most CROWD words that crowded prefixes are cut into.

    Every round cuts all crowded ranges where their words part, so a range has at most one
    part per letter, and there are no more ranges than (words / CROWD) x letters x rounds.
    """
    ranges, spark = [], crowded.sparkSession
    inside = crowded.select("side", "key", "p")
    while True:
        groups = inside.groupBy("side", "p").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        ranges += [(g.side, g.p) for g in groups if g.n <= CROWD]
        crowds = [(g.side, g.p, _parting(g.low, g.high) + 1) for g in groups if g.n > CROWD]
        if not crowds:
            return sorted(ranges)
        parts = spark.createDataFrame(crowds, "side int, p string, upto int")
        inside = inside.join(F.broadcast(parts), ["side", "p"]).select("side", "key", F.expr("substring(key, 1, upto)").alias("p"))


def _visits(ranges: list[tuple[int, str]]):
    """For words of crowded prefixes: the range they lie in, and all others that may hold a near word."""
    sides = {side: [p for s, p in ranges if s == side] for side in (0, 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {side: SortedList(ps) for side, ps in sides.items()}
        firsts = {side: np.array([p[:ANCHOR] for p in ps], object) for side, ps in sides.items()}
        for batch in batches:
            for side in (0, 1):
                part = batch.filter(pa.compute.equal(batch.column(0), side))
                for at in range(0, part.num_rows, TOGETHER):
                    some = part.slice(at, TOGETHER)
                    keys = some.column(1).to_pylist()
                    own = np.array([k[:ANCHOR] for k in keys], object)
                    query, to = lists[side].scan(keys, np.searchsorted(firsts[side], own, "left"),
                                                 np.searchsorted(firsts[side], own, "right"), prefixes=True)
                    home: dict[int, int] = {}
                    for q, t in zip(query.tolist(), to.tolist()):
                        p = sides[side][t]
                        if keys[q].startswith(p) and len(p) > len(sides[side][home[q]] if q in home else ""):
                            home[q] = t
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([side] * len(query), pa.int32()), pa.array([keys[q] for q in query.tolist()], pa.string()),
                         some.column(2).take(pa.array(query)), pa.array([sides[side][t] for t in to.tolist()], pa.string()),
                         pa.array([home[q] == t for q, t in zip(query.tolist(), to.tolist())], pa.bool_())],
                        ["side", "key", "n", "p", "listed"])
    return run


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by side, range and key → what each row's word has near it in that range."""
    def near(side: int, table: pa.Table) -> pa.RecordBatch:
        keys, p = table.column("key").to_pylist(), table.column("p").to_pylist()
        listed, n = table.column("listed").to_numpy(), table.column("n").to_numpy()
        words = [k for k, x in zip(keys, listed.tolist()) if x]
        changes = np.array([True, *(a != b for a, b in zip(p, p[1:]))])
        group = np.cumsum(changes) - 1
        upto = np.concatenate([[0], np.cumsum(listed)])  # listed rows before
        starts = np.flatnonzero(changes)
        lo, hi = upto[starts][group], upto[np.append(starts[1:], len(keys))][group]
        query, word = SortedList(words).scan(keys, lo, hi)
        at = np.flatnonzero(listed)[word]  # the row of the near word
        plain = keys if side == 0 else [k[::-1] for k in keys]
        if side == 1:  # pairs with equal beginnings are in the other list
            begins = np.array([w[:ANCHOR] for w in plain], object)
            other = begins[query] != begins[at]
            query, at = query[other], at[other]
        smaller = {w: i for i, w in enumerate(sorted({plain[i] for i in at.tolist()}))}
        order = np.lexsort([np.array([smaller[plain[i]] for i in at.tolist()], np.int64), -n[at], query])
        query, at = query[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(query)))
        return pa.RecordBatch.from_arrays(
            [pa.array([plain[i] for i in query[first].tolist()], pa.string()), pa.array(count, pa.int64()),
             pa.array([plain[i] for i in at[first].tolist()], pa.string()), pa.array(n[at[first]], pa.int64())],
            ["word", "n_near", "form", "form_n"])

    held: list[pa.RecordBatch] = []

    def whole_ranges(more: bool):
        """Scans what is held, but for the last range if ``more`` of it may come."""
        table = pa.Table.from_batches(held)
        sides, p = table.column("side").to_numpy(), table.column("p")
        upto = table.num_rows
        if more:
            last = (sides != sides[-1]) | pa.compute.not_equal(p, p[-1]).to_numpy()
            upto = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        held[:] = table.slice(upto).combine_chunks().to_batches()
        for side in (0, 1):
            lo, hi = np.searchsorted(sides[:upto], [side, side + 1])
            if hi > lo:
                yield near(side, table.slice(lo, hi - lo).combine_chunks())

    tried = 0
    for batch in batches:
        held.append(batch)
        size = sum(b.num_rows for b in held)
        if size >= max(TOGETHER, 2 * tried):
            yield from whole_ranges(True)
            tried = sum(b.num_rows for b in held)
    if held and sum(b.num_rows for b in held):
        yield from whole_ranges(False)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n): number of near words, the most frequent of them and its count.

    ``words`` (word, n) are different words; those without a near word do not come back.
    """
    lists = _lists(words.where(F.char_length("word") >= 2 * ANCHOR)).withColumn("p", F.substring("key", 1, ANCHOR))
    crowds = F.broadcast(lists.groupBy("side", "p").count().where(F.col("count") > CROWD).drop("count"))  # words / CROWD rows at most
    crowded = lists.join(crowds, ["side", "p"])
    ranges = _cut_ranges(crowded)
    rows = lists.withColumn("listed", F.lit(True))
    if ranges:
        rows = (lists.join(crowds, ["side", "p"], "left_anti").withColumn("listed", F.lit(True))
                .unionByName(crowded.select("side", "key", "n").mapInArrow(_visits(ranges), "side int, key string, n long, p string, listed boolean")))
    found = (rows.repartition("side", "p").sortWithinPartitions("side", "p", "key", F.col("listed").desc())
             .mapInArrow(_scanned, "word string, n_near long, form string, form_n long"))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
            .select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the form's form and so on to the last."""
    links = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(DOUBLINGS):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return links


def variants(words: DataFrame, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n).

    The form is the most frequent near word if it occurs at least ``times`` (5 or more) as
    often as the word; the root is where the forms end.
    """
    if times < 5:
        raise ValueError("a form has to be at least five times as frequent as its word")
    words = written(words)
    has_form = F.col("form_n") >= times * F.col("n")
    near = words.join(near_words(words), "word", "left")
    near = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               *[F.when(has_form, F.col(c)).alias(c) for c in ("form", "form_n")]))
    roots = with_roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
