import random

import pytest
import xxhash
from pyspark.sql import functions as F

from comarca.llm import simhash
from comarca.llm.queries import op9_simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes):
    """Smallest member by union-find over all pairs of distinct values."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {n: find(n) for n in nodes}


def expected(rows):
    fps = {d: fingerprint(t) for d, t in rows}
    root = components(set(fps.values()))
    first = {}
    for d, f in fps.items():
        first[root[f]] = min(d, first.get(root[f], d))
    return {d: (f"{f:016x}", first[root[f]]) for d, f in fps.items()}


def test_query_against_all_pairs(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op9_simhash(spark, sf_dir).collect()}
    assert got == expected(rows)
    assert len({c for _, c in got.values()}) < len(got)


@pytest.mark.parametrize("long_list", [0, 3, 64])
def test_links_are_whole_in_short_and_long_lists(spark, long_list):
    rng = random.Random(5)
    values = {rng.getrandbits(64) for _ in range(60)}
    for base in list(values)[:6]:
        for _ in range(60):
            base ^= 1 << rng.randrange(64) | (1 << rng.randrange(64))
            values.add(base)
    near = next(iter(values))
    values |= {near ^ 1 << i ^ 1 << j for i in range(5) for j in range(40, 64)}
    rows = spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")
    links = [(a & (1 << 64) - 1, b & (1 << 64) - 1) for a, b in simhash.links(rows, long_list).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    got = {r.node: r.root for r in simhash.components(simhash.links(rows, long_list)).collect()}
    groups = {}
    for v, r in components(values).items():
        groups.setdefault(r, set()).add(simhash._signed(v))
    mine = {}
    for v in values:
        v = simhash._signed(v)
        mine.setdefault(got.get(v, v), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_null_empty_repeated_and_clashing_columns(spark):
    rows = [(3, None), (1, ""), (2, " \t\n"), (4, "a b"), (4, "a b"), (None, "a b"), (6, "x y z w"), (5, "X  Y z\nw"), (7, "ÄB c d"), (8, "äb c d")]
    docs = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, fp int, root string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    assert {r.component_id for r in got if r.doc_id in (4, None)} == {4}
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (5, 6)} == {5: 5, 6: 5}
    kept = simhash.keep_one_of_each(docs)
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 4, 4, 5, 7, 8]
    assert kept.columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs.withColumn("doc_id", F.lit(None).cast("long"))).where("component_id is null").count() == len(rows)
