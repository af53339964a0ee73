"""Queries of the general data-quality operators (p3 to p6) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaflow.operators import drift, hierarchy, nested, orphans

LABELS = {"resolution.candidates[]": "candidate", "resolution.candidates[].blocks[]": "block"}
NESTED = ["classifier", "resolution"]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.references(_read(spark, d, "aquatic_hyphomycetes_graph"))
    return refs, orphans.versions(_read(spark, d, "graph_nodes"), _read(spark, d, "graph_terms"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.track(*_references(spark, d)).orphans().select("edge_id", "endpoint", "kind", F.date_format("t", "yyyy-MM").alias("load_month"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(orphans.track(*_references(spark, d)).orphans())


def p3_history(spark: SparkSession, d: str) -> DataFrame:
    return orphans.history(*_references(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    b = nested.bridge(_read(spark, d, "training_index"), "rec_id", NESTED, LABELS)
    at = lambda i: F.coalesce(F.get("ordinals", F.lit(i)), F.lit(0))
    return b.select("rec_id", "child", at(0).alias("cand_pos"), at(1).alias("block_pos"))


def p4_bridge(spark: SparkSession, d: str) -> DataFrame:
    b = nested.bridge(_read(spark, d, "training_index"), "rec_id", NESTED, LABELS)
    return b.select("rec_id", "child", "node", "parent", F.array_join(F.col("ordinals").cast("array<string>"), ".").alias("ordinals"))


def p4_objects(spark: SparkSession, d: str) -> DataFrame:
    return nested.objects(_read(spark, d, "training_index"), "rec_id", NESTED, LABELS)


def _level(path: str):
    return lambda spark, d: nested.flat_table(_read(spark, d, "training_index"), "rec_id", path)


p4_classifier, p4_resolution = _level("classifier"), _level("resolution")
p4_candidates, p4_blocks = _level("resolution.candidates[]"), _level("resolution.candidates[].blocks[]")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(_read(spark, d, "training_index_raw"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.unify(_read(spark, d, "training_index_raw"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.parent_links(_read(spark, d, "aquatic_hyphomycetes_graph"))
    return hierarchy.hierarchy(links, paths=False).select("node_id", "root_id", "depth")


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.parent_links(_read(spark, d, "aquatic_hyphomycetes_graph"))
    return hierarchy.hierarchy(links).select("node_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.parent_links(_read(spark, d, "aquatic_hyphomycetes_graph"))
    return hierarchy.descendants(hierarchy.hierarchy(links))


def p6_cycles(spark: SparkSession, d: str) -> DataFrame:
    links = hierarchy.parent_links(_read(spark, d, "aquatic_hyphomycetes_graph"))
    return hierarchy.cycles(links, hierarchy.hierarchy(links, paths=False))


QUERIES = {"p4_classifier": p4_classifier, "p4_resolution": p4_resolution, "p4_candidates": p4_candidates, "p4_blocks": p4_blocks}
QUERIES |= {f.__name__: f for f in (p3_found, p3_report, p3_history, p4_found, p4_bridge, p4_objects, p5_found, p5_table, p6_found, p6_paths, p6_descendants, p6_cycles)}

_P3 = """WITH r AS (SELECT edge_id, 'start' AS endpoint, start_node_id AS k, loaded_at AS t FROM aquatic_hyphomycetes_graph
  UNION ALL SELECT edge_id, 'end', end_node_id, loaded_at FROM aquatic_hyphomycetes_graph),
v AS (SELECT id AS k, loaded_at AS l, deleted_at AS d FROM graph_nodes UNION ALL SELECT id, loaded_at, deleted_at FROM graph_terms),
j AS (SELECT edge_id, endpoint, t, count(v.k) AS n, min(l) AS f, count(CASE WHEN l <= t AND (d IS NULL OR d > t) THEN 1 END) AS a
  FROM r LEFT JOIN v USING (k) WHERE regexp_matches(r.k, '\\S') GROUP BY edge_id, endpoint, t),
o AS (SELECT edge_id, endpoint, CASE WHEN n = 0 THEN 'missing' WHEN f > t THEN 'late' ELSE 'deleted' END AS kind,
  strftime(t, '%Y-%m') AS load_month FROM j WHERE a = 0)
"""
_LINKS = """WITH RECURSIVE e AS (SELECT start_node_id AS node_id, end_node_id AS parent_id,
    row_number() OVER (PARTITION BY start_node_id ORDER BY loaded_at DESC NULLS LAST, edge_id DESC) AS rn
  FROM aquatic_hyphomycetes_graph WHERE upper(regexp_replace(type, '^\\s+|\\s+$', '', 'g')) LIKE 'BELONGS\\_TO\\_%' ESCAPE '\\'
    AND regexp_matches(start_node_id, '\\S') AND regexp_matches(end_node_id, '\\S')),
l AS (SELECT node_id, parent_id FROM e WHERE rn = 1),
t AS (SELECT DISTINCT parent_id AS node_id, parent_id AS root_id, 0 AS depth, parent_id AS path FROM e
    WHERE parent_id NOT IN (SELECT node_id FROM l)
  UNION ALL SELECT l.node_id, t.root_id, t.depth + 1, t.path || '/' || l.node_id FROM t JOIN l ON l.parent_id = t.node_id),
n AS (SELECT node_id, root_id, depth, path FROM t
  UNION ALL SELECT node_id, '', -1, NULL FROM l WHERE node_id NOT IN (SELECT node_id FROM t))
"""
_P4_LEVELS = """WITH c AS (SELECT rec_id, resolution, classifier, unnest(resolution.candidates) AS c, generate_subscripts(resolution.candidates, 1) AS cp FROM training_index),
b AS (SELECT rec_id, cp, unnest(c.blocks) AS b, generate_subscripts(c.blocks, 1) AS bp FROM c),
bf AS (SELECT rec_id, cp, bp FROM b WHERE coalesce(b.block_no::VARCHAR, b.bbox.x0::VARCHAR, b.bbox.y0::VARCHAR, b.bbox.x1::VARCHAR, b.bbox.y1::VARCHAR, b.text) IS NOT NULL),
cf AS (SELECT rec_id, cp FROM c WHERE coalesce(c.binomial, c.strategy, c.confidence::VARCHAR, c.dist::VARCHAR, c.note) IS NOT NULL
  UNION SELECT rec_id, cp FROM bf)
"""
_P4 = _P4_LEVELS + """, rf AS (SELECT rec_id FROM training_index WHERE coalesce(resolution.binomial, resolution.genus, resolution.epithet, resolution.strategy, resolution.confidence::VARCHAR) IS NOT NULL
  UNION SELECT rec_id FROM cf)
SELECT rec_id, 'classifier' AS child, 0 AS cand_pos, 0 AS block_pos FROM training_index WHERE coalesce(classifier.image_type, classifier.confidence::VARCHAR,
  classifier.sat_mean::VARCHAR, classifier.white_bg_ratio::VARCHAR, classifier.edge_density::VARCHAR, classifier.hist_entropy::VARCHAR,
  classifier.blue_dominance::VARCHAR, classifier.width::VARCHAR, classifier.height::VARCHAR, classifier.rule_fired) IS NOT NULL
UNION ALL SELECT rec_id, 'resolution', 0, 0 FROM rf
UNION ALL SELECT rec_id, 'candidate', cp::INT, 0 FROM cf
UNION ALL SELECT rec_id, 'block', cp::INT, bp::INT FROM bf"""

SQL = {
    "p3_found": _P3 + "SELECT * FROM o",
    "p3_history": """WITH r AS (SELECT 'start' AS endpoint, start_node_id AS k, loaded_at AS t FROM aquatic_hyphomycetes_graph
  UNION ALL SELECT 'end', end_node_id, loaded_at FROM aquatic_hyphomycetes_graph),
v AS (SELECT id AS k, loaded_at AS l, deleted_at AS d FROM graph_nodes UNION ALL SELECT id, loaded_at, deleted_at FROM graph_terms),
s AS (SELECT date_trunc('month', min(t)) AS lo, max(t) AS hi FROM (SELECT t FROM r WHERE regexp_matches(k, '\\S') UNION ALL SELECT l FROM v WHERE k IS NOT NULL)),
g AS (SELECT lo + to_months(CAST(6 * (i + 1) AS INT)) AS ts FROM s, range(0, 20000) x(i) WHERE lo + to_months(CAST(6 * i AS INT)) <= hi),
c AS (SELECT endpoint, k, ts, count(*) AS n FROM r JOIN g ON t < ts WHERE regexp_matches(k, '\\S') GROUP BY ALL),
u AS (SELECT k, ts, max(coalesce(d, TIMESTAMP '9999-12-31')) AS until FROM v JOIN g ON l < ts GROUP BY ALL),
o AS (SELECT ts AS snapshot_at, endpoint, CASE WHEN until IS NULL THEN 'missing' WHEN until <= ts THEN 'deleted' END AS state, n FROM c LEFT JOIN u USING (k, ts))
SELECT snapshot_at, endpoint, state, sum(n)::BIGINT AS open_refs FROM o WHERE state IS NOT NULL GROUP BY ALL""",
    "p3_report": _P3 + "SELECT endpoint, load_month, kind, count(*) AS orphans FROM o GROUP BY ALL",
    "p4_found": _P4,
    "p4_classifier": """SELECT rec_id, classifier.* FROM training_index WHERE coalesce(classifier.image_type, classifier.confidence::VARCHAR, classifier.sat_mean::VARCHAR,
  classifier.white_bg_ratio::VARCHAR, classifier.edge_density::VARCHAR, classifier.hist_entropy::VARCHAR, classifier.blue_dominance::VARCHAR,
  classifier.width::VARCHAR, classifier.height::VARCHAR, classifier.rule_fired) IS NOT NULL""",
    "p4_resolution": _P4_LEVELS + """SELECT rec_id, r.binomial, r.genus, r.epithet, r.strategy, r.confidence FROM (SELECT rec_id, resolution AS r FROM training_index)
  WHERE coalesce(r.binomial, r.genus, r.epithet, r.strategy, r.confidence::VARCHAR) IS NOT NULL OR rec_id IN (SELECT rec_id FROM cf)""",
    "p4_candidates": _P4_LEVELS + """SELECT rec_id, cp::INT AS candidates_pos, c.binomial, c.strategy, c.confidence, c.dist, c.note FROM c JOIN cf USING (rec_id, cp)""",
    "p4_blocks": _P4_LEVELS + """SELECT rec_id, cp::INT AS candidates_pos, bp::INT AS blocks_pos, b.block_no, b.bbox.x0 AS bbox_x0, b.bbox.y0 AS bbox_y0, b.bbox.x1 AS bbox_x1, b.bbox.y1 AS bbox_y1, b.text
  FROM b JOIN bf USING (rec_id, cp, bp)""",
    "p6_found": _LINKS + "SELECT node_id, root_id, depth FROM n",
    "p6_paths": _LINKS + "SELECT node_id, root_id, depth, path FROM n",
    "p6_cycles": _LINKS
    + ", x AS (SELECT node_id, parent_id FROM l WHERE node_id NOT IN (SELECT node_id FROM t)),"
    + " w AS (SELECT node_id AS s, parent_id AS x FROM x UNION SELECT w.s, x.parent_id FROM w JOIN x ON x.node_id = w.x)"
    + " SELECT min(x) AS cycle_id, s AS node_id FROM w GROUP BY s HAVING bool_or(x = s)",
    "p6_descendants": _LINKS
    + ", a AS (SELECT node_id, parent_id AS ancestor_id, 1 AS distance FROM l WHERE node_id IN (SELECT node_id FROM t)"
    + " UNION ALL SELECT a.node_id, l.parent_id, a.distance + 1 FROM a JOIN l ON l.node_id = a.ancestor_id)"
    + " SELECT ancestor_id, node_id, distance FROM a",
}
