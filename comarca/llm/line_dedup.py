"""Delete repeated runs of lines, by a suffix array over line ids (built-in functions only).

Lines that hold a word are numbered within their document and become 128-bit ids.  Prefix
doubling orders the suffixes of all documents' id sequences by their first 1, 2, 4, ...
lines: the rank of 2m lines comes from the ranks of m lines at a place and m lines on.
A suffix whose first lines occur once has no repeat and leaves; the others keep the rank
(how many suffixes come before), so suffixes of one rank form an interval of the suffix
array whose longest common prefix is at least that long.  Only the intervals of common
prefix ``min_lines`` are needed to know each maximal repeated run: a run is the union of
the places that lie in such an interval.  So doubling ends at ``min_lines``.  A line of
``long_words`` words or more (a passage or a notice that stands alone) is a run by itself:
its intervals are those of the first step.

In each interval the first place stays and every later one is deleted: a line goes if a
run of ``min_lines`` lines that covers it, or the long line itself, also starts earlier
(smaller doc_id, or the same document and an earlier line).  Overlaps count; runs never
cross documents.  Lines without a word belong to no run, but go with one that surrounds
them.  Short lines that repeat alone stay: they are headings, brackets and the like.

Ranks are counts per distinct pair, summed in buckets of their order, so no task sees all
suffixes, and a line that a third of all documents share is counted before it is shuffled.

Defined results: NULL texts stay NULL and empty texts empty; rows that repeat doc_id and
text are one document and treated alike; a NULL doc_id comes before all others; an empty
table gives no rows; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comarca.llm.common import cut, null_safe

MIN_LINES = 2
#: Words of a line that is a run by itself.
LONG_WORDS = 8
KEY = ["__doc", "__version"]
#: Ranks are summed in so many buckets per side (their square in all, if full).
SIDE = 64


def lines(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(__doc, __version, i, line, long, a, b): the lines that hold a word, numbered, with their ids."""
    blank, word = r"[ \t\n\x0B\f\r]", r"[^ \t\n\x0B\f\r]"
    enough = f"^{blank}*+(?:{word}++{blank}++){{{max(0, long_words - 1)}}}{word}"
    each = (docs.where("text IS NOT NULL").select(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__version"), F.expr(
        "filter(transform(split(text, '\\n', -1), (x, n) -> struct(n AS line, x AS t)),"
        " s -> s.t RLIKE '[^ \\\\t\\\\n\\\\x0B\\\\f\\\\r]')").alias("l")))
    return (each.select(*KEY, F.posexplode("l").alias("i", "l"))
            .select(*KEY, "i", F.col("l.line").alias("line"), F.col("l.t").rlike(enough).alias("long"), F.xxhash64("l.t").alias("a"),
                    F.xxhash64(F.lit(1), "l.t").alias("b"))
            .dropDuplicates([*KEY, "i"]))  # repeated rows


def _ranked(suffixes: DataFrame, first: str, second: str, bucket: list) -> DataFrame:
    """Suffixes whose pair (first, second) occurs again, with ``rank`` and ``earliest`` place.

    ``rank``: how many suffixes of a repeated pair come before.  ``bucket``: columns that
    grow with (first, second).
    """
    pairs = cut(suffixes.groupBy(first, second).agg(F.count("*").alias("n"), F.min(F.struct(*KEY, "i")).alias("earliest"))
                .where("n > 1").withColumn("bucket", F.struct(*bucket)))
    totals = pairs.groupBy("bucket").agg(F.sum("n").alias("before"))
    shifts = totals.select("bucket", (F.sum("before").over(Window.orderBy("bucket")) - F.col("before")).alias("before"))
    within = Window.partitionBy("bucket").orderBy(first, second).rowsBetween(Window.unboundedPreceding, 0)
    ranks = (pairs.withColumn("upto", F.sum("n").over(within) - F.col("n"))
             .join(F.broadcast(shifts), "bucket")  # at most SIDE * SIDE rows
             .select(F.col(first).alias("__first"), F.col(second).alias("__second"), (F.col("upto") + F.col("before")).alias("rank"), "earliest"))
    return suffixes.join(ranks, (F.col(first) == F.col("__first")) & (F.col(second) == F.col("__second"))).drop("__first", "__second")


def repeated_lines(docs: DataFrame, long_words: int = LONG_WORDS) -> DataFrame:
    """(__doc, __version, i, line, long, last_line, rank, earliest): lines that occur again."""
    # ids are even over the whole range of a long: their upper bits are a bucket
    return cut(_ranked(lines(docs, long_words), "a", "b", [F.shiftright("a", 52)])
               .select(*KEY, "i", "line", "long", F.col("line").alias("last_line"), "rank", "earliest"))


def intervals(again: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(__doc, __version, i, line, last_line, rank, earliest): places whose ``min_lines`` lines
    occur again; rank names the interval, earliest is its first place."""
    now = base = again.drop("long")
    length = 1
    while length < min_lines:
        step = min(length, min_lines - length)  # the last step may overlap
        ahead = Window.partitionBy(*KEY).orderBy("i")
        paired = (now.select(*KEY, "i", "line", F.col("rank").alias("r"),
                             F.first("rank").over(ahead.rangeBetween(step, step)).alias("r_next"),
                             F.first("last_line").over(ahead.rangeBetween(step, step)).alias("last_line"))
                  .where("r_next IS NOT NULL"))
        width = F.greatest(F.lit(1), F.ceil(F.lit(max(1, base.agg(F.max("rank")).first()[0] or 1)) / SIDE))
        now = cut(_ranked(paired, "r", "r_next", [F.floor(F.col("r") / width).alias("x"), F.floor(F.col("r_next") / width).alias("y")])
                  .select(*KEY, "i", "line", "last_line", "rank", "earliest"))
        length += step
    return now


def runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """(__doc, __version, first_line, last_line): maximal runs of lines to delete."""
    def later(places: DataFrame, length: int) -> DataFrame:
        return (places.where(F.struct(*KEY, "i") > F.col("earliest"))
                .select(*KEY, "i", (F.col("i") + length - 1).alias("end"), "line", "last_line"))

    again = repeated_lines(docs, long_words)
    gone = later(intervals(again, min_lines), min_lines).union(later(again.where("long"), 1))
    order = Window.partitionBy(*KEY).orderBy("i", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("i") > before + 1, F.lit(True))
    grouped = gone.withColumn("begins", begins.cast("int")).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*KEY, "run").agg(F.min("line").alias("first_line"), F.max("last_line").alias("last_line")).drop("run")


def delete_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with ``text`` without the later copies, n_lines, n_removed and n_runs."""
    found = (runs(docs, min_lines, long_words).groupBy(*KEY)
             .agg(F.collect_list(F.struct("first_line", "last_line")).alias("__runs")))
    joined = null_safe(docs.withColumns({"__doc": F.col("doc_id"), "__version": F.xxhash64("text")}), found, KEY, "left")
    all_lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(all_lines, lambda x, n: F.struct(n.alias("n"), x.alias("t"))),
                    lambda s: ~F.exists("__runs", lambda r: (s.n >= r.first_line) & (s.n <= r.last_line)))
    n_removed = F.coalesce(F.aggregate("__runs", F.lit(0), lambda s, r: s + r.last_line - r.first_line + 1), F.lit(0))
    new = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s.t), "\n"))
    columns = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed", "n_runs")]
    return joined.select(*columns, new.alias("text"), F.coalesce(F.size(all_lines), F.lit(0)).cast("long").alias("n_lines"),
                         n_removed.cast("long").alias("n_removed"),
                         F.coalesce(F.when(F.col("__runs").isNotNull(), F.size("__runs")), F.lit(0)).cast("long").alias("n_runs"))
