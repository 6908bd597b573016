"""Scan texts for secrets through an incremental ledger of blobs.

* Content address.  Every version of every text is a blob, named by the SHA-256 of its
  bytes.  Paths (rows) with equal texts share a blob.
* Ledger.  A table in a folder, one row per blob and scan: which versions of rules have seen
  the blob, and what they found.  A version of a rule is the digest of its name, pattern and
  lengths, so an edited rule is a new version and an old one is never mistaken for it.
* Scan.  Only pairs of blob and rule version that the ledger lacks are scanned, each blob
  once however many rows hold it, and appended as a new part of the ledger.  Parts are
  written whole or not at all; a pair that two scans wrote at once counts once.
* Join.  The findings of the wanted rule versions go back to all rows by content address.

Copies meet as one row per task and blob before texts are shuffled, and only blobs with
findings are joined to the rows, so copies of one text, however many, gather nowhere.

Spans are code points from 0, the end not included; a match whose secret is too short is
dropped after the search, as the next match starts behind it.

Defined results: NULL and empty texts are one blob without findings; rows that repeat
everything come back as often; a NULL id stays; texts of any length are read whole, in
linear time; an empty table gives no rows (and adds nothing); other columns stay, but for
those of a new column's name.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm.common import checkpoint_folder


class Rule(NamedTuple):
    """``pattern`` finds candidates; its group ``group`` has at least ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(tuple(self)).encode()).hexdigest()[:16]


#: The base rules, then formats of credentials that their issuers have made public (fixed values).
RULES = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", r"-----BEGIN [A-Z]{0,12}\x20?PRIVATE KEY-----", 0, 1),
)

#: What a part of the ledger holds.
LEDGER = "blob binary, versions array<string>, spans array<struct<version:string,start:int,end:int>>"
_FOUND = "versions array<string>, spans array<struct<version:string,start:int,end:int>>"


def blob(text: Column | str) -> Column:
    """Content address of a text; NULL is the empty text."""
    return F.unhex(F.sha2(F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8"), 256))


def spans_of(text: str, rule: Rule) -> list[tuple[int, int]]:
    """(start, end) of the leftmost matches of a rule that do not overlap and are long enough."""
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m.group(rule.group)) >= rule.least]


def _scanner(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [r.version for r in rules]
        for batch in batches:
            seen = batch.column(2).to_pylist()
            versions, spans = [], []
            for text, done in zip(batch.column(1), seen):
                text = text.as_py()
                todo = [r for r in rules if not done or r.version not in done]
                versions.append(every if not done else [r.version for r in todo])
                spans.append([{"version": r.version, "start": a, "end": b} for r in todo for a, b in spans_of(text, r)])
            kind = pa.list_(pa.struct([("version", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(versions, pa.list_(pa.string())), pa.array(spans, kind)],
                                             ["blob", "versions", "spans"])
    return run


class Ledger:
    """The ledger in ``folder``; a folder that does not exist is an empty ledger."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def parts(self) -> list[str]:
        """Folders of the scans that were written to their end."""
        there = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = there.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(there):
            return []
        listed = [f.getPath() for f in files.listStatus(there) if f.isDirectory()]
        done = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(p.toString() for p in listed if files.exists(done(p, "_SUCCESS")))

    def read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(*parts)

    def scan(self, texts: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> str:
        """Scans the unseen pairs of blob and rule version; the folder of the new part.

        Every blob that lacks a rule version is in the part once, with the versions it lacked.
        """
        addressed = texts.select(blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        known, wanted = self.parts(), [r.version for r in rules]
        if known:  # which blobs lack something is decided on addresses; only their texts move
            seen = (self.read(known).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen")))
            lacking = (addressed.select("blob").distinct().join(seen, "blob", "left")
                       .where(F.size(F.array_except(F.array(*map(F.lit, wanted)), F.coalesce("seen", F.array().cast("array<string>")))) > 0))
            todo = addressed.join(lacking, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("seen").alias("seen"))
        else:
            todo = addressed.groupBy("blob").agg(F.first("text").alias("text")).withColumn("seen", F.lit(None).cast("array<string>"))
        part = f"{self.folder}/scan-{uuid.uuid4().hex}"
        todo.select("blob", "text", "seen").mapInArrow(_scanner(tuple(rules)), "blob binary, " + _FOUND).write.parquet(part)
        if not any(p.endswith(part.rsplit("/", 1)[-1]) for p in self.parts()):
            raise RuntimeError(f"{part} has no _SUCCESS: the ledger needs the marks of whole parts")
        return part

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, found): of every blob with findings, (start, number of the rule, end) of all, in order."""
        number = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.version, i)])
        parts = self.parts()
        if not parts:
            return self.spark.createDataFrame([], "blob binary, found array<struct<start:int,kind:int,end:int>>")
        wanted = F.filter("spans", lambda s: s["version"].isin([r.version for r in rules]))
        spans = self.read(parts).select("blob", wanted.alias("spans")).where(F.size("spans") > 0)
        found = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), number[s["version"]].alias("kind"), s["end"].alias("end")))
        return spans.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias("found"))


def scan(texts: DataFrame, folder: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``texts`` without ``text``, with blob and found (array of start, end and kind, by start,
    then by the order of the rules).

    ``folder`` is the ledger's; without one a new ledger is made in the shared folder.
    """
    spark = texts.sparkSession
    ledger = Ledger(spark, folder or f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}")
    ledger.scan(texts, rules, text)
    through = [c for c in texts.columns if c not in (text, "blob", "found")]
    rows = texts.select(*through, blob(text).alias("blob"))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    found = ledger.findings(rules).select(F.col("blob").alias("__blob"), F.transform("found", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.get(kinds, s["kind"]).alias("kind"))).alias("found"))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    return (rows.join(found, rows["blob"] == found["__blob"], "left").drop("__blob")
            .withColumn("found", F.coalesce("found", empty)))


def digest(found: str = "found", kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:end of the spans (of ``kinds``, or all), joined by commas."""
    spans = F.col(found) if kinds is None else F.filter(found, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
