"""Remove repeated byte strings by prefix-free parsing.

Every byte that is covered by a string of ``LENGTH`` bytes which also starts earlier
(smaller doc_id, or the same document and an earlier start) is removed, judged on the
input, overlaps included, never across documents.

* Parse.  A rolling hash of ``GRAM`` bytes runs over the text.  Each string of LENGTH bytes
  has a trigger: the leftmost of its smallest hashes, which its own bytes decide.  Strings
  that follow each other and share a trigger form a phrase, about one per
  (LENGTH - GRAM) / 2 bytes.  A phrase reaches LENGTH - 1 bytes into the next, as phrases of
  a prefix-free parse overlap, so each string of LENGTH bytes lies in exactly one phrase.
* Dictionary.  Phrases with equal trigger hash and equal bytes (by hash) are one entry, at
  its first place.  Every other occurrence of an entry is removed whole.
* Suffixes.  Equal strings have equal triggers.  So an entry whose trigger no other entry
  has holds no string of any other entry: nothing is compared.  Only entries that share a
  trigger are contested.  Their bytes meet by trigger, where the suffixes (of LENGTH bytes)
  are brought in order, by (trigger, hash of the LENGTH bytes, place in the corpus); all but
  the first of each class are removed.

A match has a fixed length and never leaves its phrase, so the order of what follows the
phrase (the suffix array of the parse) decides nothing here and is not built.

Only phrases and contested entries are shuffled, never all positions.  Copies within an
Arrow batch are decided in the batch, so a phrase that a third of all documents share
reaches the shuffle once per batch.  What a trigger has in common with too many entries (the
end of a very common line, and all that follows it) never meets in one task: a first pass
finds triggers of more than one in ``HOT`` rows (at most HOT of them, so they are
broadcast), whose entries are dealt by their bytes and all count as contested; those, and
triggers of more than ``CROWD`` rows, write their suffixes one by one, which meet by two
hashes of their LENGTH bytes, again once per batch.  Entries are told apart by the 64-bit hash of the
trigger and a 64-bit hash of their bytes together.

Defined results: NULL and empty texts have no bytes; rows that repeat doc_id and text are
one document and treated alike; rows of one doc_id (or without one) with different texts are
documents of their own, told apart by 96 bits of two hashes of the text, and come in the order
of those; a NULL doc_id comes before all others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.common import cut, written

LENGTH, GRAM = 100, 20
#: So many occurrences of a trigger meet in one task (rows of at most 200 bytes).
CROWD = 1000
#: A trigger of more than one in so many rows is dealt by the bytes of its entries ...
HOT = 20_000
#: ... as far as it has so many entries in an Arrow batch.
_HOT_IN_BATCH = 16
_HOT_FLAG = 1 << 24
#: Texts are hashed in runs of about so many bytes (a phrase cut there is told apart by its
#: suffixes, so the result does not depend on it).
RUN = 1 << 18
#: A run is shorter than 2 ** PLACE_BITS.
PLACE_BITS = 20
_START_BITS = 31


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


class Hashes:
    """Hashes of all windows of a byte string, by joining windows of half the length."""

    FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                                      0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]

    def __init__(self, data: np.ndarray):
        with np.errstate(over="ignore"):
            table = np.arange(1, 257, dtype=np.uint64) * self.FACTORS[0]
            table = _mix(_mix(table))
            self.levels = [table[data]]
            for k in range(6):  # windows of 1, 2, 4, ..., 64 bytes
                h, n = self.levels[-1], 1 << k
                joined = h[:-n] * self.FACTORS[k] + h[n:]
                self.levels.append(_mix(joined) if k in (2, 4) else joined)

    def of(self, length: int) -> np.ndarray:
        """Hashes of all windows of ``length`` bytes (64 to 128, or below 64 by its powers)."""
        out, at = None, 0
        for k in range(6, -1, -1):
            while length - at >= 1 << k:
                part = self.levels[k][at:]
                out = part if out is None else out[:len(part)] * self.FACTORS[6] + part[:len(out)]
                at += 1 << k
        return _mix(out[:len(self.levels[0]) - length + 1].copy())


def _phrases(data: np.ndarray, valid: np.ndarray):
    """First window, windows, trigger hash and bytes hash of every phrase.

    ``valid`` marks the windows of LENGTH bytes that lie in one document.
    """
    hashes = Hashes(data)
    whole, gram = hashes.of(LENGTH), hashes.of(GRAM)
    bits = PLACE_BITS
    # the smallest hash and, if equal, the leftmost: its place is in the low bits
    low = (gram >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(gram), dtype=np.uint64)
    width, reach = LENGTH - GRAM + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    low = np.minimum(low[:len(low) - (width - reach)], low[width - reach:]) if reach < width else low
    trigger = (low & np.uint64((1 << bits) - 1)).astype(np.int64)[:len(valid)]
    starts = np.flatnonzero(valid & np.concatenate([[True], (trigger[1:] != trigger[:-1]) | ~valid[:-1]]))
    ends = np.flatnonzero(valid & np.concatenate([(trigger[1:] != trigger[:-1]) | ~valid[1:], [True]]))
    count = ends - starts + 1
    with np.errstate(over="ignore"):  # first and last window overlap, so they and their distance are the phrase
        body = _mix(whole[starts] * Hashes.FACTORS[1] + _mix(whole[ends] ^ count.astype(np.uint64) * Hashes.FACTORS[2]))
    return starts, count, gram[trigger[starts]], body


def _runs_of(texts: list[bytes]):
    """Joins texts to runs of about RUN bytes: (bytes, [(row, offset in the text, start, end)])."""
    joined, parts, size = [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), RUN):
            piece = text[at:at + RUN + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            joined.append(piece)
            parts.append((row, at, size, size + len(piece)))
            size += len(piece)
            if size >= RUN:
                yield b"".join(joined), parts
                joined, parts, size = [], [], 0
    if parts:
        yield b"".join(joined), parts


def _later_of_equal(keys: list[np.ndarray], doc: np.ndarray, version: np.ndarray, place: np.ndarray):
    """Order by keys, then place; which rows open a key; which come later than its first place."""
    order = np.lexsort([place, version, doc, *reversed(keys)])
    same = np.ones(len(order), bool)
    for k in keys:
        same[1:] &= k[order][1:] == k[order][:-1]
    same[:1] = False
    again = same.copy()  # the same place, of a repeated row
    for k in (doc, version, place):
        again[1:] &= k[order][1:] == k[order][:-1]
    return order, ~same, same & ~again


def _merged(doc: np.ndarray, version: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Unions of intervals of places that touch, within each document."""
    order = np.lexsort([lo, version, doc])
    out: list[list[int]] = []
    for d, v, a, b in zip(doc[order].tolist(), version[order].tolist(), lo[order].tolist(), hi[order].tolist()):
        if out and out[-1][:2] == [d, v] and a <= out[-1][3]:
            out[-1][3] = max(out[-1][3], b)
        else:
            out.append([d, v, a, b])
    return np.array(out, np.int64).reshape(-1, 4).T


#: A row stands for ``n`` strings of LENGTH bytes from a place on: a candidate of the class
#: (a, b), or, if n is negative, decided strings that go.  A document is its doc_id, a hash of
#: its text (version) and 32 bits of another, which are in one number with the start (place).
CANDIDATES = "a long, b long, doc_id long, version long, place long, n int"


def _place(other: np.ndarray, start: np.ndarray) -> np.ndarray:
    return other.astype(np.int64) << _START_BITS | start


def _batch(*columns) -> pa.RecordBatch:
    names = ["a", "b", "doc_id", "version", "place", "n", "raw"]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names[:len(columns)])


def _decided_here(a, b, doc, version, place, n):
    """What an Arrow batch can say by itself: the first place of each class is a candidate, the others go."""
    order, first, later = _later_of_equal([a, b], doc, version, place)
    go, stay = order[later], order[first]
    if len(go):
        d, v, lo, hi = _merged(doc[go], version[go], place[go], place[go] + n[go])
        yield d, lo, d, v, lo, -(hi - lo).astype(np.int32)
    yield a[stay].view(np.int64), b[stay].view(np.int64), doc[stay], version[stay], place[stay], n[stay].astype(np.int32)


def _parsed(batches: Iterator[pa.RecordBatch]):
    """Phrases by Arrow batch: trigger, bytes, doc_id, version, place, number of strings."""
    for batch in batches:
        docs, versions, others = (batch.column(i).to_numpy() for i in range(3))
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(3).to_pylist()]
        found = []
        for data, parts in _runs_of(texts):
            valid = np.zeros(len(data) - LENGTH + 1, bool)
            row, shift = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
            for r, at, lo, hi in parts:
                valid[lo:hi - LENGTH + 1] = True
                row[lo:hi], shift[lo:hi] = r, at - lo
            starts, count, trigger, body = _phrases(np.frombuffer(data, np.uint8), valid)
            found.append((row[starts], starts + shift[starts], count, trigger, body))
        if found:
            row, start, count, trigger, body = map(np.concatenate, zip(*found))
            yield trigger, body, docs[row], versions[row], _place(others[row], start), count


def _crowds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Triggers with many entries in a batch, and (without trigger) all phrases."""
    for trigger, body, *_ in _parsed(batches):
        entries = np.unique(np.stack([trigger, body], axis=1), axis=0)
        names, n = np.unique(entries[:, 0], return_counts=True)
        many = n >= _HOT_IN_BATCH
        yield pa.RecordBatch.from_arrays([pa.array([None, *names[many].view(np.int64).tolist()], pa.int64()),
                                          pa.array([len(trigger), *n[many].tolist()], pa.int64())], ["a", "n"])


def hot_triggers(keyed: DataFrame) -> np.ndarray:
    """At most HOT triggers, in order: those of more than one in HOT phrases."""
    counts = keyed.mapInArrow(_crowds, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.where("a IS NULL").agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("a").isNotNull() & (F.col("n") > max(CROWD, total // HOT))).select("a").collect()
    return np.sort(np.array([r.a for r in hot], np.int64).view(np.uint64))


def _parse_with(hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triggers = hot.value
        for trigger, body, doc, version, place, count in _parsed(batches):
            if len(triggers):
                at = np.minimum(np.searchsorted(triggers, trigger), len(triggers) - 1)
                dealt = triggers[at] == trigger
                trigger = np.where(dealt, _mix(trigger ^ _mix(body.copy())), trigger)
                count = np.where(dealt, count | _HOT_FLAG, count)
            for a, b, doc_, version_, place_, n in _decided_here(trigger, body, doc, version, place, count & (_HOT_FLAG - 1)):
                if len(triggers):  # candidates of hot triggers keep their mark
                    own = np.sort(trigger[count >= _HOT_FLAG])
                    if len(own):
                        at = np.minimum(np.searchsorted(own, a.view(np.uint64)), len(own) - 1)
                        n = np.where((n > 0) & (own[at] == a.view(np.uint64)), n | _HOT_FLAG, n).astype(np.int32)
                yield _batch(a, b, doc_, version_, place_, n)
    return run


def _windows(raws: list[bytes]):
    """Of byte strings of at least LENGTH bytes: the row, shift and two hashes of all their suffixes."""
    row, shift, whole, other, at = [], [], [], [], 0
    while at < len(raws):
        to, size = at, 0
        while to < len(raws) and size < RUN:
            size += len(raws[to])
            to += 1
        own_hashes = Hashes(np.frombuffer(b"".join(raws[at:to]), np.uint8))
        hashes, halves = own_hashes.of(LENGTH), own_hashes.levels[6]
        lengths = np.array([len(r) for r in raws[at:to]])
        counts = lengths - LENGTH + 1
        own = np.repeat(np.arange(at, to), counts)
        inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        row.append(own)
        shift.append(inside)
        first = np.repeat(np.cumsum(lengths) - lengths, counts) + inside
        whole.append(hashes[first])
        other.append(_mix(halves[first] * Hashes.FACTORS[3] + halves[first + LENGTH - 64]))
        at = to
    return map(np.concatenate, (row, shift, whole, other))


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contested entries with their bytes; of crowded triggers their suffixes one by one."""
    for batch in batches:
        docs, versions, others = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("__d", "__v", "__w"))
        texts, phrases = (batch.column(batch.schema.get_field_index(c)) for c in ("__text", "phrases"))
        alone, crowd = [], []

        def suffixes():
            row, shift, whole, other = _windows([c[5] for c in crowd])
            doc, version, place = (np.array([c[i] for c in crowd], np.int64)[row] for i in (1, 2, 3))
            for rows in _decided_here(other, whole, doc, version, place + shift, np.ones(len(row), np.int32)):
                yield _batch(*rows, pa.nulls(len(rows[0]), pa.binary()))

        for row in range(batch.num_rows):
            raw = texts[row].as_py().encode("utf-8", "surrogatepass")
            for p in phrases[row].as_py():
                place = int(others[row]) << _START_BITS | p["start"]
                one = (p["a"], int(docs[row]), int(versions[row]), place, p["n"], raw[p["start"]:p["start"] + p["n"] + LENGTH - 1])
                (crowd if p["crowded"] else alone).append(one)
            if len(alone) >= 20_000 or row + 1 == batch.num_rows:
                if alone:
                    a, doc, version, place, n, raws = zip(*alone)
                    yield _batch(pa.array(a, pa.int64()), pa.array([0] * len(a), pa.int64()), pa.array(doc, pa.int64()), pa.array(version, pa.int64()),
                                 pa.array(place, pa.int64()), pa.array(n, pa.int32()), pa.array(raws, pa.binary()))
                alone = []
            if len(crowd) >= 20_000 or row + 1 == batch.num_rows:
                if crowd:
                    yield from suffixes()
                crowd = []


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes to remove.  Rows come ordered by ``a``, so all entries of a trigger come together."""
    names = ["doc_id", "version", "place", "n"]

    def later(table: pa.Table):
        a, b, doc, version, place, n = (table.column(i).to_numpy() for i in range(6))
        known = np.array([not x for x in table.column(6).is_valid().to_pylist()], bool)
        row, shift, whole = np.flatnonzero(known), np.zeros(int(known.sum()), np.int64), b[known].view(np.uint64)
        if not known.all():
            own = np.flatnonzero(~known)
            r, s, w, _ = _windows(table.column(6).filter(pa.array(~known)).to_pylist())
            row, shift, whole = np.concatenate([row, own[r]]), np.concatenate([shift, s]), np.concatenate([whole, w])
        order, _, gone = _later_of_equal([a[row].view(np.uint64), whole], doc[row], version[row], place[row] + shift)
        go = order[gone]
        if len(go):
            d, v, lo, hi = _merged(doc[row[go]], version[row[go]], place[row[go]] + shift[go], place[row[go]] + shift[go] + 1)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, v, lo, (hi - lo).astype(np.int32))], names)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        decided = pa.compute.less(batch.column(5), 0)
        done, rest = batch.filter(decided), batch.filter(pa.compute.invert(decided))
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([*(done.column(i) for i in (2, 3, 4)), pa.compute.negate(done.column(5))], names)
        for at in range(0, rest.num_rows, 5_000):
            held.append(rest.slice(at, 5_000))
            if sum(h.num_rows for h in held) < 20_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))  # the last trigger may go on
            if cut:
                yield from later(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held:
        yield from later(pa.Table.from_batches(held).combine_chunks())


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __text and its key: __d (NULL doc_ids are the smallest number), __v and __w."""
    return docs.withColumns({"__text": F.coalesce(F.col(text), F.lit("")), "__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))),
                             "__v": F.xxhash64(text), "__w": F.shiftrightunsigned(F.xxhash64(F.lit("other"), text), 32)}).drop(text)


#: What tells a document in ``_keyed``.
KEY = ["__d", "__v", "__w"]


def _document() -> list:
    """The same, of a row of ``CANDIDATES``."""
    return [F.col("doc_id").alias("__doc"), F.col("version").alias("__version"), F.shiftright("place", _START_BITS).alias("__other")]


def _same_document():
    return (F.col("__d") == F.col("__doc")) & (F.col("__v") == F.col("__version")) & (F.col("__w") == F.col("__other"))


def repeated_bytes(keyed: DataFrame) -> DataFrame:
    """(__doc, __version, __other, lo, hi): bytes to remove, as intervals that may overlap."""
    texts = keyed.where(F.length("__text") >= LENGTH // 4).select(*KEY, "__text")
    hot = keyed.sparkSession.sparkContext.broadcast(hot_triggers(texts))  # at most HOT numbers
    parsed = texts.mapInArrow(_parse_with(hot), CANDIDATES)
    # one shuffle by trigger serves all: the entries, their first places, who shares a trigger
    trigger = Window.partitionBy("a")
    entries = written(
        parsed.repartition("a").withColumns({
            "later": (F.col("n") < 0) | (F.rank().over(Window.partitionBy("a", "b").orderBy("doc_id", "version", "place")) > 1),
            "contested": (F.col("n") >= _HOT_FLAG) | (F.col("n") > 0) & (F.min("b").over(trigger) != F.max("b").over(trigger)),
            "crowded": (F.col("n") >= _HOT_FLAG) | (F.count("*").over(trigger) > CROWD)})
        .where("later OR contested")
        .select("a", "doc_id", "version", "place", F.when(F.col("n") < 0, -F.col("n")).otherwise(F.col("n").bitwiseAND(_HOT_FLAG - 1)).alias("n"),
                "later", "crowded"))
    start = F.col("place").bitwiseAND((1 << _START_BITS) - 1)
    by_doc = (entries.where("NOT later")
              .groupBy(*_document())
              .agg(F.collect_set(F.struct(start.alias("start"), "n", "a", "crowded")).alias("phrases")))
    contested = keyed.join(by_doc, _same_document())
    suffixes = (contested.mapInArrow(_entries, CANDIDATES + ", raw binary").repartition("a").sortWithinPartitions("a")
                .mapInArrow(_classes, "doc_id long, version long, place long, n int"))
    spans = entries.where("later").select("doc_id", "version", "place", "n").union(suffixes)
    return spans.select(*_document(), start.alias("lo"), (start + F.col("n") + (LENGTH - 1)).alias("hi"))


RESULT = "struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>"


def without_repeats(docs: DataFrame, text: str = "text", out: str = "result") -> DataFrame:
    """``out`` instead of ``text``: n_bytes, n_removed, n_spans and kept, the remaining bytes."""
    keyed = _keyed(docs, text)  # the contested entries and the result share its shuffle
    spans = repeated_bytes(keyed).groupBy("__doc", "__version", "__other").agg(F.collect_list(F.struct("lo", "hi")).alias("__spans"))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            rows = []
            for t, found in zip(texts.to_pylist(), spans.to_pylist()):
                raw = (t or "").encode("utf-8", "surrogatepass")
                kept, at, n_spans = [], 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in found or ()):
                    if n_spans and lo <= at:
                        at = max(at, hi)
                    else:
                        kept.append(raw[at:lo])
                        at, n_spans = hi, n_spans + 1
                kept = b"".join([*kept, raw[at:]])
                rows.append({"n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": n_spans, "kept": kept})
            yield pa.array(rows, pa.struct([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))

    joined = keyed.join(spans, _same_document(), "left")
    return joined.select(*[c for c in docs.columns if c not in (text, out)],
                         F.arrow_udf(run, RESULT)(F.col("__text"), F.col("__spans")).alias(out))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a character cut in two goes whole,
    a NULL text becomes empty."""
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for kept in batches:
            yield pa.array([bytes(k).decode("utf-8", "ignore") for k in kept.to_pylist()], pa.string())

    return (without_repeats(docs, out="__result").withColumn("text", F.arrow_udf(run, "string")(F.col("__result.kept")))
            .select(docs.columns))
