"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxaflow.llm import canonical, leaks, ocr, repetition, splits, tokenizer


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.tied_papers(_read(spark, d, "training_index"))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return splits.paper_classes(_read(spark, d, "training_index"))


def p1_forest(spark: SparkSession, d: str) -> DataFrame:
    return splits.forest(_read(spark, d, "training_index"))


def p1_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.split(_read(spark, d, "training_index"))


def _canonical(spark: SparkSession, d: str) -> DataFrame:
    records = _read(spark, d, "training_index").select("rec_id", "binomial", "genus")
    return canonical.canonical(records, _read(spark, d, "ref_taxa"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _canonical(spark, d).select("rec_id", "taxon_id")


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched(_canonical(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ocr.noise(_read(spark, d, "training_index").select("rec_id", "paper", "page", "caption_raw"))


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    return ocr.repair(_read(spark, d, "training_index").select("rec_id", "paper", "page", "caption_raw")).select("rec_id", "text")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode(_read(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    e = tokenizer.encode(_read(spark, d, "documents").select("doc_id", "text"))
    return tokenizer.decode(e).selectExpr("doc_id", "size(ids) AS n_ids", "decoded = coalesce(text, '') AS exact")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    items = _read(spark, d, "eval_items")
    return leaks.report(leaks.find(_read(spark, d, "documents"), items), items)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.within(_read(spark, d, "documents")).filter("share >= 0.3").select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.within(_read(spark, d, "documents"))


def p10_lines(spark: SparkSession, d: str) -> DataFrame:
    return repetition.line_frequency(_read(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_classes, p1_forest, p1_split, p2_found, p2_unmatched, p7_found, p7_text, p8_ids, p8_roundtrip, p9_found, p9_report, p10_found, p10_shares, p10_lines)}

_P10 = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, gram) AS lo FROM g) WHERE i > lo),
c AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM r, (VALUES (0), (1), (2), (3), (4)) t(k) GROUP BY doc_id),
s AS (SELECT doc_id, coalesce(repeated, 0) AS repeated, len(ws) AS words, CASE WHEN len(ws) > 0 THEN coalesce(repeated, 0) / len(ws) ELSE 0.0 END AS share FROM w LEFT JOIN c USING (doc_id))
"""

_P1 = """WITH RECURSIVE t AS (SELECT 'p:' || paper AS p, 's:' || string_split(id, '__')[1] AS s, 'i:' || string_split(id, '__')[-1] AS i FROM training_index),
e AS (SELECT DISTINCT p AS a, s AS b FROM t WHERE p IS NOT NULL AND s IS NOT NULL UNION SELECT DISTINCT s, p FROM t WHERE p IS NOT NULL AND s IS NOT NULL
  UNION SELECT DISTINCT s, i FROM t WHERE s IS NOT NULL UNION SELECT DISTINCT i, s FROM t WHERE s IS NOT NULL),
k AS (SELECT a, b FROM e WHERE NOT (starts_with(b, 'i:') AND b IN (SELECT a FROM e GROUP BY a HAVING count(*) = 1)) AND NOT (starts_with(a, 'i:') AND a IN (SELECT a FROM e GROUP BY a HAVING count(*) = 1))),
r AS (SELECT DISTINCT p AS start, p AS node FROM t WHERE p IS NOT NULL UNION SELECT r.start, k.b FROM r JOIN k ON k.a = r.node)
"""

SQL = {
    "p1_found": _P1 + """SELECT substring(start, 3) AS paper_a, substring(node, 3) AS paper_b FROM r WHERE starts_with(node, 'p:') AND start < node""",
    "p1_classes": _P1
    + """, c AS (SELECT start, min(node) AS class_id, count(DISTINCT node) AS papers FROM r WHERE starts_with(node, 'p:') GROUP BY start),
n AS (SELECT p, count(DISTINCT s) AS links FROM t WHERE p IS NOT NULL AND s IS NOT NULL GROUP BY p)
SELECT substring(start, 3) AS paper, substring(class_id, 3) AS class_id, papers, links FROM c JOIN n ON n.p = c.start""",
    "p10_found": _P10 + "SELECT doc_id FROM s WHERE share >= 0.3",
    "p10_shares": _P10 + "SELECT doc_id, repeated, words::BIGINT AS words, share FROM s",
    "p10_lines": """WITH l AS (SELECT doc_id, coalesce(source, '') AS source, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x{85}\\x{2028}\\x{2029}]')) AS line FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, source, length(line) AS n, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS norm FROM l),
z AS (SELECT coalesce(source, '') AS source, count(DISTINCT doc_id) AS all_docs FROM documents GROUP BY ALL),
f AS (SELECT source, norm FROM k JOIN z USING (source) WHERE length(norm) >= 12 GROUP BY source, norm, all_docs HAVING count(DISTINCT doc_id) > 5 AND count(DISTINCT doc_id) > 0.001 * all_docs),
p AS (SELECT doc_id, count(*) AS lines, count(f.norm) AS removed, sum(n) AS all_chars, sum(CASE WHEN f.norm IS NULL THEN n ELSE 0 END) AS kept FROM k LEFT JOIN f USING (source, norm) GROUP BY doc_id),
s AS (SELECT d.doc_id, coalesce(lines, 0) AS lines, coalesce(removed, 0) AS removed, coalesce(CASE WHEN all_chars > 0 THEN kept / all_chars ELSE 1.0 END, 1.0) AS kept_share FROM documents d LEFT JOIN p USING (doc_id))
SELECT *, kept_share < 0.5 AS rejected FROM s""",
}
