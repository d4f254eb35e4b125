"""Queries opN_<name> over the whole tables, and the SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import bpe, dedup, forest, licenses, llr, ogg, packing, pii, qda, warc
from keelson.llm.common import table

#: The key of surrogates; a deployment passes its own.
PII_KEY = b"an example key of the test queries"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return llr.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op4_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_media(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return qda.classify(documents, qda.train(documents, table(spark, sf_dir, "labels")))


def op9_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.jaccard_classes(table(spark, sf_dir, "documents"))


def op10_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# parts of results that SQL can express where it cannot express the whole


def base_of_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_of_op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pieces_of_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, and whether all of them lie in a bin that has room for what is in it."""
    rows = op5_best_fit_packing(spark, sf_dir)
    bins = rows.where("bin_id is not null").groupBy("bin_id").agg((F.sum("length") <= F.max("bin_size")).alias("fits"), (F.max(F.col("bin_offset") + F.col("length")) == F.sum("length")).alias("dense"))
    return rows.join(bins, "bin_id", "left").select("doc_id", "piece", "start", "length", (F.coalesce("fits", F.lit(True)) & F.coalesce("dense", F.lit(True))).alias("placed"))


def payload_of_op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_ogg_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_license_scan, op3_pii_surrogates, op4_bpe_replay, op5_best_fit_packing, op6_ogg_media, op7_suffix_dedup, op8_quality_qda, op9_forest_join, op10_warc_chain, pipeline, base_of_op1, base_of_op2, pieces_of_op5, payload_of_op6)}

_WARC_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
b AS (
  SELECT p.*, m.top, list_reduce(list_transform(range(1, 41),
    lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
                4 * (strpos('0123456789abcdef', substr(p.h, i, 1)) - 1) + 1, 4)), lambda x, y: x || y) AS bits
  FROM p JOIN m ON p.h = m.h)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
      + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT)
      + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM b
"""

_REPEATS_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS INT), 100) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.p FROM w JOIN f ON f.s = w.s WHERE f.least < w.doc_id),
g AS (SELECT doc_id, p, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 1 ELSE 0 END AS jump FROM r),
i AS (SELECT doc_id, p, sum(jump) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g),
c AS (SELECT doc_id, n, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY doc_id, n),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM c),
t AS (SELECT k.doc_id, string_agg(substr(h, CAST(2 * before + 1 AS INT), CAST(2 * (a - before) AS INT)), '' ORDER BY a)
    || substr(any_value(h), CAST(2 * max(b) + 1 AS INT)) AS kept, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans
  FROM k JOIN d ON d.doc_id = k.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
    ELSE list_transform(range(1, len(l) - 3), lambda i: array_to_string(list_slice(l, i, i + 4), ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT o.a, o.b FROM o JOIN n p ON p.doc_id = o.a JOIN n q ON q.doc_id = o.b WHERE 5 * k >= 4 * (p.n + q.n - k)),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other),
m AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id),
l AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
"""

_RULES_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS l FROM d),
x AS (SELECT doc_id, unnest(l) AS word, generate_subscripts(l, 1) AS i FROM w),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY i) AS three FROM x),
r AS (SELECT doc_id, three FROM g WHERE three IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g JOIN r USING (doc_id, three), (VALUES (0), (1), (2)) AS v(k) GROUP BY 1),
y AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(l, lambda s: length(s))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(y.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
  len(l) < 50 OR 100 * coalesce(c.n, 0) > 50 * len(l) AS base_failed
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN y ON y.doc_id = w.doc_id
"""

_PHRASES_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS a, generate_subscripts(l, 1) - 1 AS i FROM w),
y AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS d FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, i, 'gpl' AS label FROM y WHERE a = 'gnu' AND b = 'general' AND c = 'public' AND d = 'license' UNION ALL SELECT doc_id, i, 'apache' FROM y WHERE a = 'apache' AND b = 'license'
  UNION ALL SELECT doc_id, i, 'cc-by' FROM y WHERE a = 'cc' AND b = 'by' UNION ALL SELECT doc_id, i, 'mit' FROM y WHERE a = 'mit' AND b = 'license'),
f AS (SELECT doc_id, count(*) AS n, CAST(min(i) AS BIGINT) AS lo, CAST(max(i) AS BIGINT) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM p GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN f ON f.doc_id = w.doc_id
"""

_PIECES_SQL = """
WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, n, unnest(range(0, greatest(1, (n + 16383) // 16384))) AS piece FROM d)
SELECT doc_id, piece, 16384 * piece AS "start", least(16384, n - 16384 * piece) AS length, true AS placed FROM p
"""

_PAYLOAD_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
p AS (SELECT *, 576 * greatest(1, (n + 575) // 576) AS size FROM d)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(unhex(h || repeat('FF', CAST(size - n AS INT)))) AS payload_sha256 FROM p
"""

SQL = {"op7_suffix_dedup": _REPEATS_SQL, "op9_forest_join": _JACCARD_SQL, "op10_warc_chain": _WARC_SQL, "base_of_op1": _RULES_SQL, "base_of_op2": _PHRASES_SQL, "pieces_of_op5": _PIECES_SQL, "payload_of_op6": _PAYLOAD_SQL}
