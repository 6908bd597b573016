import pytest
from pyspark.sql import functions as F

from comarca.llm import line_dedup


def brute(rows, min_lines, long_words=line_dedup.LONG_WORDS):
    """Kept text of every document, by looking at every run of min_lines lines and every long line."""
    seen, seen_lines, out = set(), set(), {}
    for doc, text in rows:
        all_lines = text.split("\n")
        at = [i for i, x in enumerate(all_lines) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        for i in range(len(at) - min_lines + 1):
            run = tuple(all_lines[j] for j in at[i:i + min_lines])
            if run in seen:
                gone.update(range(at[i], at[i + min_lines - 1] + 1))
            seen.add(run)
        for i in at:
            if len(all_lines[i].encode().split()) >= long_words:
                if (all_lines[i],) in seen_lines:
                    gone.add(i)
                seen_lines.add((all_lines[i],))
        # what lies between two deleted runs that touch goes too
        numbers = [k for k, i in enumerate(at) if i in gone]
        for a, b in zip(numbers, numbers[1:]):
            if b == a + 1:
                gone.update(range(at[a], at[b]))
        out[doc] = "\n".join(x for i, x in enumerate(all_lines) if i not in gone)
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_documents_against_brute_force(spark, sf_dir, min_lines):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text")
    docs = docs.union(docs.select((F.col("doc_id") + 1000).alias("doc_id"), F.concat(F.lit("new\n\n"), "text", F.lit("\nend")).alias("text")))
    rows = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_runs(docs, min_lines).collect()}
    assert got == brute(rows, min_lines)


def test_overlaps_ties_blank_lines_and_hot_lines(spark):
    texts = ["a\na\na\na", "x\n\ny\nz", "q\nx\n\n \ny\nz\n", "y\nz\nx\ny\nz", "a", "", "b\nc\na\na", "only"] + ["hot\nline\nhot\nline"] * 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for min_lines in (2, 3, 4):
        got = {r.doc_id: r.text for r in line_dedup.delete_repeated_runs(docs, min_lines).collect()}
        assert got == brute(list(enumerate(texts)), min_lines)


def test_ranks_are_those_of_the_suffix_array(spark):
    texts = ["b\na\nb\na\nb", "a\nb\na\nb\na", "c\nc\nc\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = line_dedup.intervals(line_dedup.repeated_lines(docs), 4).collect()
    by_prefix = {}
    for r in got:
        by_prefix.setdefault(r["rank"], set()).add(tuple(texts[r["__doc"]].split("\n")[r.i:r.i + 4]))
    assert by_prefix and all(len(p) == 1 for p in by_prefix.values())  # one prefix per rank
    assert len({next(iter(p)) for p in by_prefix.values()}) == len(by_prefix)


def test_null_empty_repeated_and_clashing_columns(spark):
    rows = [(1, "a\nb\nc", "r1"), (1, "a\nb\nc", "r2"), (None, "a\nb", "r3"), (2, None, "r4"), (3, "", "r5"), (4, "a\nb\nc\nd", "r6")]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id long, text string, version string, rank int, n_runs int")
    got = {r.version: r.text for r in line_dedup.delete_repeated_runs(docs, 2).collect()}
    # the NULL doc_id comes first; the repeated rows are one document
    assert got == {"r1": "c", "r2": "c", "r3": "a\nb", "r4": None, "r5": "", "r6": "d"}
    assert line_dedup.delete_repeated_runs(docs.where("false"), 2).count() == 0


def test_a_long_line_is_a_run_by_itself(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    notice = "All rights reserved by the owner of this"          # eight words
    texts = [f"a\n{passage}\nb", f"c\n{passage}\nd\n{notice}", f"{notice}\ne\n\n{passage}\nf", f"g\n}}\n{notice}\n  {notice}", "h\n}", f"}}\n{notice} not",
             notice, f"{passage}\n{notice}\n{passage}"] + [f"line {i}\n{notice}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_runs(docs).collect()}
    assert got == brute(list(enumerate(texts)), 2)
    assert got[1] == f"c\nd\n{notice}" and got[2] == "e\n\nf" and got[3] == f"g\n}}\n  {notice}" and got[4] == "h\n}" and got[6] == "" and got[67] == "line 59"
    assert {r.doc_id: r.text for r in line_dedup.delete_repeated_runs(docs, 2, 9).collect()}[2] == f"{notice}\ne\n\nf"


def test_very_long_lines_and_texts(spark):
    line = "x " * 300_000
    texts = [line + "\nend", "a\n" + line, "\n".join(f"short {i}" for i in range(100_000)), "\n".join(f"short {i}" for i in range(50_000, 100_002))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.text for r in line_dedup.delete_repeated_runs(docs).collect()}
    assert got == {0: texts[0], 1: "a", 2: texts[2], 3: "short 100000\nshort 100001"}
