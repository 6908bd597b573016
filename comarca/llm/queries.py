"""The operators as queries over the whole test tables, with SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comarca.llm import (byte_bpe, language_id, license_scan, line_dedup, packing, quality_rules, secret_scan, simhash, spelling, suffix_dedup,
                         vantage_trees, warc, whitening)
from comarca.llm.common import read_table


def op1_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage_trees.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    packed = packing.with_crc32(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step")


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read_table(spark, sf_dir, "documents")).drop("lang", "source")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_id.identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, vocabulary, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs).select("doc_id", F.inline("matches"))


def op7_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.without_repeats(docs).select(
        "doc_id", "result.n_bytes", "result.n_removed", "result.n_spans", F.sha2("result.kept", 256).alias("kept_sha256"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.record_bytes(warc.derive(warc.responses(read_table(spark, sf_dir, "pages"))))
    return records.drop("block").withColumn("record", F.decode("record", "UTF-8"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.delete_repeated_runs(docs).select("doc_id", "n_lines", "n_removed", "n_runs", "text")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(read_table(spark, sf_dir, "documents")))


def op12_bit_sliced_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op13_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ("assign", "access", "hex")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in base]
    return found.select("doc_id", *counts, F.sha2(F.encode(secret_scan.digest("found", base), "UTF-8"), 256).alias("base_sha256"),
                        secret_scan.digest("found").alias("spans"))


QUERIES = {f.__name__: f for f in (op1_vantage_trees, op2_hierarchical_packing, op3_adaptive_quality, op4_kneser_ney, op5_byte_bpe,
                                  op6_license_scan, op7_prefix_free_parsing, op8_warc_derivatives, op9_simhash, op10_line_runs, op11_spelling_variants,
                                  op12_bit_sliced_whitening, op13_secret_ledger)}
ORACLE: dict[str, str] = {}

ORACLE["op1_vantage_trees"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
usable AS (SELECT * FROM v WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
           AND len(list_filter(v, lambda x: x <> 0)) > 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
           FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""

#: op3: words, then the counts, then the sketches (bins), quartiles and fences of each group.
ORACLE["op3_adaptive_quality"] = r"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM w WHERE len(words) >= 5),
gram AS (SELECT doc_id, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] || ' ' || words[i+3] || ' ' || words[i+4] AS g FROM grams),
twice AS (SELECT doc_id, i FROM gram QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
c AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words,
             length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             [word_chars * 10000 // greatest(n_words, 1), n_symbols * 10000 // greatest(n_words, 1),
              n_dup_lines * 10000 // greatest(n_words, 1), n_repeat_words * 10000 // greatest(n_words, 1)] AS r FROM c),
values_ AS (SELECT lang, source, k, r[k] AS v FROM m, range(1, 5) t(k) WHERE NOT base_failed),
bins AS (SELECT lang, source, k, CASE WHEN v < 64 THEN v ELSE (length(bin(v)) - 6) * 32 + (v >> (length(bin(v)) - 6)::BIGINT) END AS b,
                count(*) AS n FROM values_ GROUP BY ALL),
merged AS (SELECT 1 AS level, lang, source, k, b, n FROM bins
           UNION ALL SELECT 2, lang, NULL, k, b, sum(n) FROM bins GROUP BY lang, k, b
           UNION ALL SELECT 3, NULL, NULL, k, b, sum(n) FROM bins GROUP BY k, b),
ranked AS (SELECT *, CASE WHEN b < 64 THEN b ELSE (b % 32 + 32) << (b // 32 - 1) END AS low,
                  sum(n) OVER (PARTITION BY level, lang, source, k ORDER BY b) AS upto,
                  sum(n) OVER (PARTITION BY level, lang, source, k) AS rows_ FROM merged),
q AS (SELECT level, lang, source, k, max(rows_) AS rows_, min(low) FILTER (upto * 4 >= rows_) AS q1,
             min(low) FILTER (upto * 4 >= rows_ * 3) AS q3 FROM ranked GROUP BY ALL),
f AS (SELECT *, greatest((q3 - q1) * 6, [20000, 1000, 1000, 1000][k]) AS spread FROM q),
chosen AS (SELECT a.lang, a.source, a.k,
                  CASE WHEN a.rows_ >= 100 THEN a.q1 WHEN b.rows_ >= 100 THEN b.q1 ELSE c.q1 END AS q1,
                  CASE WHEN a.rows_ >= 100 THEN a.q3 WHEN b.rows_ >= 100 THEN b.q3 ELSE c.q3 END AS q3,
                  CASE WHEN a.rows_ >= 100 THEN a.spread WHEN b.rows_ >= 100 THEN b.spread ELSE c.spread END AS spread
           FROM f a JOIN f b ON b.level = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.k = b.k
           JOIN f c ON c.level = 3 AND a.k = c.k WHERE a.level = 1),
beyond AS (SELECT DISTINCT m.doc_id FROM m JOIN chosen x ON m.lang IS NOT DISTINCT FROM x.lang AND m.source IS NOT DISTINCT FROM x.source
           WHERE greatest(r[x.k] - q3, q1 - r[x.k]) > spread * sqrt(greatest(1.0::DOUBLE, 100::DOUBLE / n_words)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM beyond) AS kept FROM m"""

ORACLE["op7_prefix_free_parsing"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, octet_length(raw) - 99)) AS s FROM d WHERE octet_length(raw) >= 100),
strings AS MATERIALIZED (SELECT doc_id, s, md5_number(substr(h, 2 * s + 1, 200)) AS k FROM starts),
found AS (SELECT doc_id, s FROM strings QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
marked AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS opens FROM found),
spans AS (SELECT doc_id, min(s) AS lo, max(s) + 100 AS hi FROM
          (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM marked) GROUP BY doc_id, g),
kept AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(raw)::BIGINT AS n_bytes,
       coalesce(list_sum(list_transform(range(1, len(los) + 1), lambda i: his[i] - los[i])), 0)::BIGINT AS n_removed,
       coalesce(len(los), 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN los IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(los) + 1),
              lambda i: substr(h, CASE WHEN i = 0 THEN 1 ELSE 2 * his[i] + 1 END,
                          2 * (CASE WHEN i = len(los) THEN octet_length(raw) ELSE los[i + 1] END - CASE WHEN i = 0 THEN 0 ELSE his[i] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

ORACLE["op10_line_runs"] = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
each AS (SELECT doc_id, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM l),
word AS (SELECT doc_id, line, t, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM each WHERE regexp_matches(t, '[^ \t\n\x0B\f\r]')),
pair AS (SELECT doc_id, i, line, t, lead(t) OVER o AS t2, lead(line) OVER o AS last_line FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
later AS (SELECT doc_id, i, i + 1 AS e, line, last_line FROM pair WHERE t2 IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY t, t2 ORDER BY doc_id, i) > 1),
alone AS (SELECT doc_id, i, i AS e, line, line AS last_line FROM word
          WHERE len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) >= 8 QUALIFY row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1),
marked AS (SELECT *, CASE WHEN i <= max(e) OVER (PARTITION BY doc_id ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1
                          THEN 0 ELSE 1 END AS opens FROM (SELECT * FROM later UNION ALL SELECT * FROM alone)),
runs AS (SELECT doc_id, min(line) AS lo, max(last_line) AS hi FROM
         (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i, e ROWS UNBOUNDED PRECEDING) AS g FROM marked) GROUP BY doc_id, g),
gone AS (SELECT doc_id, count(*) AS n_runs, sum(hi - lo + 1) AS n_removed FROM runs GROUP BY doc_id),
kept AS (SELECT e.doc_id, string_agg(e.t, chr(10) ORDER BY e.line) AS text FROM each e
         WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.doc_id = e.doc_id AND e.line BETWEEN r.lo AND r.hi) GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(len(l.ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_runs, 0)::BIGINT AS n_runs,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: op11: crc32 byte by byte over all (document, run) pairs at once; near words by the code point that is left out or replaced.
ORACLE["op11_spelling_variants"] = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
pairs AS (SELECT run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM runs GROUP BY doc_id, run),
steps AS (SELECT i AS b, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
          UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT h, 0 AS i, 4294967295::BIGINT AS c FROM pairs
        UNION ALL SELECT h, i + 1, xor(c >> 8, v) FROM crc
        JOIN steps ON k = 8 AND b = xor(c & 255, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) WHERE 2 * i < length(h)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h FROM pairs JOIN crc USING (h) WHERE 2 * i = length(h)),
thin AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM thin WHERE length(word) >= 6 GROUP BY word HAVING sum(thin.n) >= 5),
holes AS (SELECT word, n, left(word, p) AS a, substr(word, p + 2) AS z FROM (SELECT *, unnest(range(length(word)))::INT AS p FROM words)),
near AS (SELECT DISTINCT * FROM (
         SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y ON x.a = y.a AND x.z = y.z AND x.word <> y.word
         UNION ALL SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.a || h.z
         UNION ALL SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.a || h.z)),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (SELECT word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near,
                 CASE WHEN m >= 5 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, 0 AS far FROM words
          UNION ALL SELECT chain.word, forms.form, far + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT word, form, arg_max(root, far) AS root, n, n_near, form_n FROM forms JOIN chain USING (word) GROUP BY ALL"""

#: op13: places of matches from the lengths of what lies between them; before a jwt one character is taken along.
ORACLE["op13_secret_ledger"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
rules AS (SELECT * FROM (VALUES
    (1, 'assign', '(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)', 6),
    (2, 'access', '(AKIA[A-Z0-9]+)', 20), (3, 'hex', '([0-9a-f]+)', 24), (4, 'github', '(gh[pousr]_[A-Za-z0-9]+)', 40),
    (5, 'slack', '(xox[abprs]-[A-Za-z0-9-]+)', 20), (6, 'google', '(AIza[A-Za-z0-9_-]+)', 39),
    (7, 'jwt', '(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)', 40),
    (8, 'pem', '(-----BEGIN [A-Z]{0,12} ?PRIVATE KEY-----)', 1)) v(number, kind, p, least)),
cut AS (SELECT r, number, kind, p, least, regexp_extract_all(t, p) AS m, list_transform(string_split_regex(t, p), lambda x: length(x)) AS s FROM d, rules),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM cut),
found AS (SELECT r, number, kind, list_sum(s[1:i]) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, m[i] AS x,
                 regexp_extract(m[i], p, 1) AS g, least FROM each),
spans AS (SELECT r, number, kind, CASE WHEN kind = 'jwt' THEN a + length(x) - length(g) ELSE a END AS a, a + length(x) AS b FROM found WHERE length(g) >= least),
lists AS (SELECT r, count(*) FILTER (number = 1) AS n_assign, count(*) FILTER (number = 2) AS n_access, count(*) FILTER (number = 3) AS n_hex,
                 string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, number) FILTER (number <= 3) AS base,
                 string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, number) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN lists USING (r)"""
