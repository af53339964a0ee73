"""Named queries of the graph, text, record, similarity and image operators, and their SQL.

Each runs over whole tables. SQL is given where it can say the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taxaflow.functions import naming, vectors
from taxaflow.functions import patterns as P
from taxaflow.operators import captions, graph, legend, pipelines, records, similarity, vision
from taxaflow.runtime import SharedTables, numbered, spread, stamp
from taxaflow.sources.readers import Vocabulary

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.current_nodes(_read(spark, d, "graph_nodes"), _read(spark, d, "graph_terms"))


def _stated(spark: SparkSession, d: str) -> DataFrame:
    return graph.stated_edges(_read(spark, d, "aquatic_hyphomycetes_graph"))


#: The stored graph of each session and state of its tables.
_GRAPHS: dict[tuple, tuple[DataFrame, DataFrame]] = {}


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The graph of the tables in a folder, stored when it is first asked for, and again once a file has changed."""
    names = ("aquatic_hyphomycetes_graph", "graph_nodes", "graph_terms")
    raw = [_read(spark, d, n) for n in names]
    key = (spark.sparkContext.applicationId, d, *(stamp(spark, f"{d}/{n}.parquet") for n in names))
    if key not in _GRAPHS:
        _GRAPHS[key] = graph.stored(*raw)
    return _GRAPHS[key]


_G = """WITH raw AS (SELECT id, label, name, properties, loaded_at, deleted_at FROM graph_nodes
  UNION ALL SELECT id, label, name, properties, loaded_at, deleted_at FROM graph_terms),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, coalesce(name, '') DESC, coalesce(properties, '') DESC, coalesce(label, '') DESC) AS rn FROM raw WHERE id IS NOT NULL),
n AS (SELECT id, label, name FROM last WHERE rn = 1 AND deleted_at IS NULL),
s AS (SELECT edge_id, start_node_id AS src, upper(trim(type)) AS type, end_node_id AS dst FROM aquatic_hyphomycetes_graph
  WHERE regexp_matches(start_node_id, '\\S') AND regexp_matches(end_node_id, '\\S')),
e AS (SELECT DISTINCT src, type, dst FROM s WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
h AS (SELECT e.type, a.id AS a_id, a.label AS a_label, a.name AS a_name, b.id AS b_id, b.label AS b_label, b.name AS b_name
  FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id)
"""


# --- graph -------------------------------------------------------------------


@query(
    _G
    + """, kv AS (SELECT id, k, unnest(map_extract(MAP_FROM_ENTRIES([(x, json_extract_string(properties, '$."' || x || '"')) FOR x IN json_keys(properties)]), k)) AS v, loaded_at
  FROM (SELECT id, properties, loaded_at, unnest(json_keys(properties)) AS k FROM raw WHERE properties IS NOT NULL AND id IS NOT NULL)),
kl AS (SELECT id, k, v FROM (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY loaded_at DESC, v DESC) AS rn FROM kv) WHERE rn = 1),
p AS (SELECT id, string_agg(k || '=' || v, ';' ORDER BY k) AS props FROM kl GROUP BY id)
SELECT l.id, l.label, l.name, l.deleted_at IS NOT NULL AS deleted, coalesce(p.props, '') AS props FROM last l LEFT JOIN p USING (id) WHERE rn = 1"""
)
def w2_node_upsert(spark: SparkSession, d: str) -> DataFrame:
    u = graph.upsert_nodes(_read(spark, d, "graph_nodes"), _read(spark, d, "graph_terms"))
    kv = F.array_join(F.transform(F.array_sort(F.map_entries("properties")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";")
    return u.select("id", "label", "name", F.col("deleted_at").isNotNull().alias("deleted"), kv.alias("props"))


@query(_G + "SELECT src, type, dst, NOT EXISTS (SELECT 1 FROM s o WHERE o.edge_id % 2 = 0 AND o.src = e.src AND o.type = e.type AND o.dst = e.dst) AS created FROM e")
def w3_edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Edges with an even edge_id count as there before."""
    s = _stated(spark, d)
    return graph.upsert_edges(s, _nodes(spark, d), s.filter("edge_id % 2 = 0"))


@query("SELECT id, count(*) AS n FROM (SELECT id FROM graph_nodes UNION ALL SELECT id FROM graph_terms) GROUP BY id HAVING count(*) > 1")
def w4_constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    return graph.repeated_ids(_read(spark, d, "graph_nodes"), _read(spark, d, "graph_terms"))


_TAX = """, o AS (SELECT a_id, b_id AS o_id, b_name AS o FROM h WHERE type = 'BELONGS_TO_ORDER' AND b_label = 'Order'),
c AS (SELECT a_id, b_id AS c_id, b_name AS c FROM h WHERE type = 'BELONGS_TO_CLASS' AND b_label = 'Class'),
p AS (SELECT a_id, b_name AS p FROM h WHERE type = 'BELONGS_TO_PHYLUM' AND b_label = 'Phylum'),
m AS (SELECT a_id, b_name AS m FROM h WHERE type = 'HAS_MORPHOTYPE' AND b_label = 'ConidialMorphotype'),
g AS (SELECT a_id, b_name AS g FROM h WHERE type = 'USES_CONIDIOGENESIS' AND b_label = 'Conidiogenesis')
"""


@query(
    _G
    + _TAX
    + """, r AS (SELECT n.id AS genus_id, n.name AS genus, o AS order_name, c AS class_name, p AS phylum, m AS morphotype, g AS conidiogenesis,
  row_number() OVER (PARTITION BY n.id ORDER BY o ASC NULLS LAST, c ASC NULLS LAST, p ASC NULLS LAST, m ASC NULLS LAST, g ASC NULLS LAST) AS rn
  FROM n LEFT JOIN o ON o.a_id = n.id LEFT JOIN c ON c.a_id = o.o_id LEFT JOIN p ON p.a_id = c.c_id LEFT JOIN m ON m.a_id = n.id LEFT JOIN g ON g.a_id = n.id WHERE n.label = 'Genus')
SELECT genus_id, genus, order_name, class_name, phylum, morphotype, conidiogenesis FROM r WHERE rn = 1"""
)
def j1_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    return graph.taxonomy(*_graph(spark, d))


@query(_G + "SELECT a_id AS genus_id, a_name AS genus, b_name AS morphotype FROM h WHERE type = 'HAS_MORPHOTYPE' AND a_label = 'Genus' AND b_label = 'ConidialMorphotype' AND lower(b_name) LIKE '%form%'")
def j2_genera_of_morphotype(spark: SparkSession, d: str) -> DataFrame:
    return graph.genera_of_morphotype(*_graph(spark, d), "FORM")


@query(_G + "SELECT a_id AS genus_id, a_name AS genus, b_name AS morphotype FROM h WHERE type = 'HAS_MORPHOTYPE' AND a_label = 'Genus' AND b_label = 'ConidialMorphotype' AND b_name = 'Starform'")
def d9_genera_of_exact_morphotype(spark: SparkSession, d: str) -> DataFrame:
    return graph.genera_of_morphotype(*_graph(spark, d), "Starform", exact=True)


@query(
    _G
    + """SELECT x.a_id AS species_id, x.a_name AS species, x.b_name AS region, y.b_name AS genus FROM h x JOIN h y ON y.a_id = x.a_id AND y.type = 'BELONGS_TO_GENUS' AND y.b_label = 'Genus'
WHERE x.type = 'OCCURS_IN' AND x.a_label = 'Species' AND x.b_label = 'GeographicRegion' AND lower(x.b_name) LIKE '%orsa%'"""
)
def j3_species_distribution(spark: SparkSession, d: str) -> DataFrame:
    return graph.species_of_region(*_graph(spark, d), "Orsa")


@query(_G + "SELECT a_name AS morphotype, b_name AS attribute FROM h WHERE type = 'MEASURED_BY' AND a_label = 'ConidialMorphotype' AND b_label = 'MorphologicalAttribute' AND lower(a_name) LIKE '%form%'")
def j4_attributes(spark: SparkSession, d: str) -> DataFrame:
    return graph.attributes_of_morphotype(*_graph(spark, d), "form")


@query(_G + _TAX + "SELECT n.id AS genus_id, n.name AS genus, o AS order_name, c AS class_name, p AS phylum FROM n JOIN o ON o.a_id = n.id JOIN c ON c.a_id = o.o_id JOIN p ON p.a_id = c.c_id WHERE n.label = 'Genus'")
def j6_lineage(spark: SparkSession, d: str) -> DataFrame:
    return graph.lineage(*_graph(spark, d))


_PATH = """, l AS (SELECT n.id AS genus_id, n.name AS genus, o AS order_name, c AS class_name, p AS phylum FROM n JOIN o ON o.a_id = n.id JOIN c ON c.a_id = o.o_id JOIN p ON p.a_id = c.c_id WHERE n.label = 'Genus')
"""


@query(
    _G
    + _TAX
    + _PATH
    + """SELECT h.a_id AS species_id, h.a_name AS species, l.genus, order_name, class_name, phylum FROM h JOIN l ON l.genus_id = h.b_id
WHERE h.type = 'BELONGS_TO_GENUS' AND h.a_label = 'Species' AND h.b_label = 'Genus'"""
)
def j6_species_lineage(spark: SparkSession, d: str) -> DataFrame:
    return graph.species_lineage(*_graph(spark, d))


@query(_G + _TAX + _PATH + "SELECT l.*, m AS morphotype FROM l JOIN m ON m.a_id = l.genus_id")
def j5_lineage_with_morphotype(spark: SparkSession, d: str) -> DataFrame:
    return graph.lineage_with_morphotype(*_graph(spark, d))


@query(_G + "SELECT id, name, row_number() OVER (ORDER BY name, id) AS place FROM n WHERE label = 'Genus' AND name IS NOT NULL QUALIFY place <= 100")
def k10_first_genera(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred genera by name: a top-k report."""
    nodes, _ = _graph(spark, d)
    top = graph.in_order(nodes.filter("label = 'Genus' AND name IS NOT NULL").select("id", "name"), [F.col("name"), F.col("id")], 100)
    return top.withColumn("place", F.row_number().over(W.orderBy("name", "id")).cast("long"))  # a hundred rows


_ANCHORS = """, gm AS (SELECT src AS genus_id, max(dst) AS morphotype_id FROM e WHERE type = 'HAS_MORPHOTYPE' GROUP BY src),
a AS (SELECT morphotype_id, min(genus_id) AS anchor FROM gm GROUP BY morphotype_id)
"""


def _anchors(edges: DataFrame) -> DataFrame:
    """The first genus of each class."""
    return graph.genus_classes(edges).groupBy("morphotype_id").agg(F.min("genus_id").alias("genus_id")).select("genus_id")


@query(_G + _ANCHORS + "SELECT anchor, genus_id FROM a JOIN gm USING (morphotype_id) WHERE anchor <> genus_id")
def j7_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    _, e = _graph(spark, d)
    return graph.hard_negatives(e, _anchors(e))


@query(_G + _ANCHORS + "SELECT anchor, genus_id FROM a JOIN gm ON a.morphotype_id <> gm.morphotype_id")
def j8_easy_negatives(spark: SparkSession, d: str) -> DataFrame:
    _, e = _graph(spark, d)
    return graph.easy_negatives(e, _anchors(e))


@query(_G + "SELECT id, label, name FROM n WHERE id NOT IN (SELECT src FROM s UNION SELECT dst FROM s)")
def j9_orphans(spark: SparkSession, d: str) -> DataFrame:
    return graph.orphans(_nodes(spark, d), _stated(spark, d))


@query(_G + "SELECT edge_id, 'Missing start: ' || src AS item FROM s WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT edge_id, 'Missing end: ' || dst FROM s WHERE dst NOT IN (SELECT id FROM n)")
def j10_broken_references(spark: SparkSession, d: str) -> DataFrame:
    return graph.broken_references(_nodes(spark, d), _stated(spark, d))


@query(
    _G
    + """, r(label, type, rule) AS (VALUES ('Class', 'BELONGS_TO_PHYLUM', 'Classes without phylum'), ('Order', 'BELONGS_TO_CLASS', 'Orders without class'),
  ('Genus', 'BELONGS_TO_ORDER', 'Genera without order'), ('Species', 'BELONGS_TO_GENUS', 'Species without genus'))
SELECT rule, id, name FROM n JOIN r USING (label) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.src = n.id AND s.type = r.type)"""
)
def j11_hierarchy_gaps(spark: SparkSession, d: str) -> DataFrame:
    return graph.hierarchy_gaps(_nodes(spark, d), _stated(spark, d))


@query(_G + "SELECT id, name FROM n WHERE label = 'Genus' AND id NOT IN (SELECT src FROM s WHERE type = 'HAS_MORPHOTYPE')")
def j12_genera_without_morphotype(spark: SparkSession, d: str) -> DataFrame:
    return graph.lacking(_nodes(spark, d), _stated(spark, d), "Genus", "HAS_MORPHOTYPE")


@query(_G + "SELECT id, name FROM n WHERE label = 'Species' AND id NOT IN (SELECT src FROM s WHERE type = 'OCCURS_IN')")
def j13_species_without_region(spark: SparkSession, d: str) -> DataFrame:
    return graph.lacking(_nodes(spark, d), _stated(spark, d), "Species", "OCCURS_IN")


_MT = """, mt AS (SELECT genus_key, genus, morphotype FROM (SELECT lower(a_name) AS genus_key, a_name AS genus, replace(b_id, 'morphotype_', '') AS morphotype,
  row_number() OVER (PARTITION BY lower(a_name) ORDER BY a_id DESC, b_id DESC, a_name DESC) AS rn FROM h WHERE type = 'HAS_MORPHOTYPE' AND a_name IS NOT NULL) WHERE rn = 1)
"""


@query(_G + _MT + "SELECT t.rec_id, coalesce(mt.morphotype, 'unknown') AS morphotype FROM training_index t LEFT JOIN mt ON lower(t.genus) = mt.genus_key")
def j15_morphotype_lookup(spark: SparkSession, d: str) -> DataFrame:
    t = graph.morphotype_table(*_graph(spark, d))
    return graph.morphotypes_of(_read(spark, d, "training_index").select("rec_id", "genus"), "genus", t).select("rec_id", "morphotype")


@query(_G + _MT + "SELECT genus FROM mt WHERE morphotype = 'stauroid'")
def j16_genera_of_class(spark: SparkSession, d: str) -> DataFrame:
    return graph.genera_of_class(graph.morphotype_table(*_graph(spark, d)), "stauroid")


@query(_G + _MT + "SELECT morphotype, count(*) AS genera FROM mt GROUP BY morphotype")
def j16_genera_by_class(spark: SparkSession, d: str) -> DataFrame:
    return graph.genera_by_class(graph.morphotype_table(*_graph(spark, d)))


@query(
    _G
    + _MT
    + """, p AS (SELECT rec_id, genus AS predicted_genus, coalesce(image_type, 'none') AS observed FROM training_index WHERE genus IS NOT NULL)
SELECT rec_id, predicted_genus, mt.morphotype AS expected, coalesce(contains(lower(observed), lower(mt.morphotype)) OR contains(lower(mt.morphotype), lower(observed)), false) AS valid,
 CASE WHEN mt.morphotype IS NULL THEN 'Genus ''' || predicted_genus || ''' not found in graph'
 WHEN contains(lower(observed), lower(mt.morphotype)) OR contains(lower(mt.morphotype), lower(observed)) THEN 'Consistent'
 ELSE 'Mismatch: ' || predicted_genus || ' expects ' || mt.morphotype || ', got ' || observed END AS reason
FROM p LEFT JOIN mt ON lower(predicted_genus) = mt.genus_key"""
)
def j22_prediction_check(spark: SparkSession, d: str) -> DataFrame:
    t = graph.morphotype_table(*_graph(spark, d))
    p = _read(spark, d, "training_index").filter("genus IS NOT NULL").select("rec_id", F.col("genus").alias("predicted_genus"), F.coalesce("image_type", F.lit("none")).alias("observed"))
    return graph.check_predictions(p, t).drop("observed")


@query(
    _G
    + "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE label = 'Genus') AS genera, (SELECT count(*) FROM n WHERE label = 'Species') AS species, (SELECT count(*) FROM n WHERE label = 'ConidialMorphotype') AS morphotypes, (SELECT count(*) FROM e) AS relationships"
)
def a1_graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(*_graph(spark, d))


@query(_G + "SELECT a_id AS genus_id, a_name AS genus, string_agg(b_name, '|' ORDER BY b_name) AS classes FROM h WHERE type = 'POLYPHYLETIC_IN' AND a_label = 'Genus' AND b_label = 'Class' GROUP BY a_id, a_name")
def a2_polyphyletic(spark: SparkSession, d: str) -> DataFrame:
    return graph.polyphyletic(*_graph(spark, d)).select("genus_id", "genus", F.when(F.size("classes") > 0, F.array_join("classes", "|")).alias("classes"))


@query(_G + "SELECT b_name AS region, count(*) AS species_count FROM h WHERE type = 'OCCURS_IN' AND a_label = 'Species' AND b_label = 'GeographicRegion' AND (b_name LIKE '%orsa%' OR b_name IN ('Karst belt', 'White fens')) GROUP BY b_name")
def a3_richness(spark: SparkSession, d: str) -> DataFrame:
    return graph.richness(*_graph(spark, d), "orsa", ["Karst belt", "White fens"])


_DEG = ", d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM s UNION ALL SELECT dst FROM s) GROUP BY id)\n"


@query(_G + _DEG + "SELECT avg(degree) AS avg_degree, max(degree) AS max_degree, (SELECT id FROM d ORDER BY degree DESC, id LIMIT 1) AS max_id FROM d")
def a4_degree_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.degree_summary(_stated(spark, d))


@query(_G + _DEG + "SELECT t.id, n.name, n.label, t.degree FROM (SELECT * FROM d ORDER BY degree DESC, id LIMIT 10) t LEFT JOIN n USING (id)")
def k7_top_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_degrees(_stated(spark, d), _nodes(spark, d))


@query(_G + "SELECT src, type, dst, count(*) - 1 AS extra FROM s GROUP BY src, type, dst HAVING count(*) > 1")
def a6_duplicate_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.duplicate_edges(_stated(spark, d))


_AUDIT = """, gap AS (SELECT rule, id, name FROM n JOIN (VALUES ('Class', 'BELONGS_TO_PHYLUM', 'Classes without phylum'), ('Order', 'BELONGS_TO_CLASS', 'Orders without class'),
  ('Genus', 'BELONGS_TO_ORDER', 'Genera without order'), ('Species', 'BELONGS_TO_GENUS', 'Species without genus')) r(label, type, rule) USING (label)
  WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.src = n.id AND s.type = r.type)),
f(category, bad, message, n) AS (
  SELECT 'Orphan Nodes', 'ERROR', ' nodes without any connections', count(*) FROM n WHERE id NOT IN (SELECT src FROM s UNION SELECT dst FROM s)
  UNION ALL SELECT 'Broken References', 'ERROR', ' broken edge references', (SELECT count(*) FROM s WHERE src NOT IN (SELECT id FROM n)) + (SELECT count(*) FROM s WHERE dst NOT IN (SELECT id FROM n))
  UNION ALL SELECT 'Duplicate Edges', 'WARNING', ' duplicate relationships', (SELECT count(*) FROM s) - (SELECT count(*) FROM (SELECT DISTINCT src, type, dst FROM s))
  UNION ALL SELECT 'Morphotype Coverage', 'WARNING', ' genera without morphotype', count(*) FROM n WHERE label = 'Genus' AND id NOT IN (SELECT src FROM s WHERE type = 'HAS_MORPHOTYPE')
  UNION ALL SELECT 'Geographic Distribution', 'WARNING', ' species without distribution', count(*) FROM n WHERE label = 'Species' AND id NOT IN (SELECT src FROM s WHERE type = 'OCCURS_IN')),
a AS (SELECT category, CASE WHEN n > 0 THEN bad ELSE 'INFO' END AS severity, n::VARCHAR || message AS message, n FROM f
  UNION ALL SELECT 'Taxonomic Hierarchy', CASE WHEN count(g.id) = 0 OR (rule = 'Genera without order' AND count(g.id) = 1 AND coalesce(contains(min(g.name), 'Anguillospora'), false)) THEN 'INFO' ELSE 'WARNING' END,
  rule || ': ' || count(g.id), count(g.id) FROM (VALUES ('Classes without phylum'), ('Orders without class'), ('Genera without order'), ('Species without genus')) r(rule) LEFT JOIN gap g USING (rule) GROUP BY rule)
"""


@query(_G + _AUDIT + "SELECT category, severity, message, n FROM a")
def a5_audit(spark: SparkSession, d: str) -> DataFrame:
    return graph.audit(_nodes(spark, d), _stated(spark, d))


@query(_G + _AUDIT + "SELECT severity, count(*) AS findings, sum(n)::BIGINT AS items, (SELECT coalesce(sum(n), 0) = 0 FROM a WHERE severity = 'ERROR') AS passes FROM a GROUP BY severity")
def a5_audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.audit_summary(graph.audit(_nodes(spark, d), _stated(spark, d)))


@query(_G + "SELECT label, count(*) AS n FROM n GROUP BY label UNION ALL SELECT 'edges', count(*) FROM e")
def u2_counts(spark: SparkSession, d: str) -> DataFrame:
    n, e = _graph(spark, d)
    return n.groupBy("label").agg(F.count("*").alias("n")).union(e.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))


# --- records -----------------------------------------------------------------

_FLAT = """WITH f AS (SELECT rec_id, id, paper, page, fig_index, image_type, image_type_raw, saved_to, caption_raw, classifier,
  coalesce(resolution.binomial, resolution.genus, resolution.epithet, resolution.strategy, resolution.confidence::VARCHAR) IS NOT NULL AS nw, resolution AS r, epithet AS p FROM training_index),
flat AS (SELECT rec_id, id, coalesce(paper, '') AS paper, coalesce(page, 0) AS page, coalesce(fig_index, 0) AS fig_index, coalesce(image_type, 'AMBIGUOUS') AS image_type,
  coalesce(image_type_raw, image_type, 'AMBIGUOUS') AS image_type_raw, coalesce(saved_to, '') AS saved_to, substring(coalesce(caption_raw, ''), 1, 500) AS caption_raw,
  nullif(CASE WHEN nw THEN r.binomial ELSE p.binomial END, '') AS binomial, nullif(CASE WHEN nw THEN r.genus ELSE p.genus END, '') AS genus,
  nullif(CASE WHEN nw THEN r.epithet ELSE p.species END, '') AS species, coalesce(CASE WHEN nw THEN r.confidence ELSE p.confidence END, 0.0) AS epithet_confidence,
  coalesce(CASE WHEN nw THEN r.strategy ELSE p.rule END, '') AS epithet_rule, coalesce(classifier.rule_fired, '') AS classifier_rule, coalesce(classifier.width, 0) AS width,
  coalesce(classifier.height, 0) AS height, coalesce(classifier.sat_mean, 0.0) AS sat_mean, coalesce(classifier.edge_density, 0.0) AS edge_density, coalesce(classifier.white_bg_ratio, 0.0) AS white_bg_ratio FROM f)
"""


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return records.normalised(_read(spark, d, "training_index"))


@query(_FLAT + "SELECT * FROM flat")
def f6_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _flat(spark, d)


_SPECIES = "sp AS (SELECT binomial AS name, coalesce(genus, '') AS genero, coalesce(species, '') AS epiteto FROM (SELECT *, row_number() OVER (PARTITION BY binomial ORDER BY rec_id) AS rn FROM flat WHERE binomial IS NOT NULL) WHERE rn = 1)"


@query(_FLAT + ", " + _SPECIES + " SELECT * FROM sp WHERE name NOT IN (SELECT name FROM ref_taxa)")
def w7_species_nodes(spark: SparkSession, d: str) -> DataFrame:
    return records.species_nodes(_flat(spark, d), _read(spark, d, "ref_taxa").select("name"))


@query(_FLAT + "SELECT DISTINCT genus AS name FROM flat WHERE genus IS NOT NULL AND genus NOT IN (SELECT name FROM ref_taxa)")
def w8_genus_nodes(spark: SparkSession, d: str) -> DataFrame:
    return records.genus_nodes(_flat(spark, d), _read(spark, d, "ref_taxa").select("name"))


@query(
    _FLAT
    + """SELECT DISTINCT id AS src, 'EXTRAIDA_DE' AS type, paper AS dst FROM flat WHERE paper IN (SELECT paper FROM documents WHERE paper IS NOT NULL)
UNION SELECT id, 'EXEMPLIFICA_ESPECIE', binomial FROM flat WHERE binomial IS NOT NULL UNION SELECT id, 'PERTENCE_A_GENERO', genus FROM flat WHERE genus IS NOT NULL"""
)
def w6_record_links(spark: SparkSession, d: str) -> DataFrame:
    return records.links(_flat(spark, d), _read(spark, d, "documents").select(F.col("paper").alias("filename")).filter("filename IS NOT NULL"))


@query(
    _FLAT
    + """, t AS (SELECT t.rec_id, t.image_type, f.binomial, f.genus FROM training_index t JOIN flat f USING (rec_id))
SELECT coalesce(image_type, '?') AS image_type, count(*) AS n, count(binomial) AS with_binomial, count(*) FILTER (binomial IS NULL AND genus IS NOT NULL) AS genus_only,
 count(*) FILTER (binomial IS NULL AND genus IS NULL) AS unnamed FROM t GROUP BY 1"""
)
def a7_type_counts(spark: SparkSession, d: str) -> DataFrame:
    raw = _read(spark, d, "training_index")
    return records.type_counts(records.normalised(raw).drop("image_type").join(raw.select("rec_id", "image_type"), "rec_id"))


@query(_FLAT + "SELECT round(avg((image_type = 'AMBIGUOUS')::INT), 6) AS ambiguous_share, round(avg((binomial IS NOT NULL)::INT), 6) AS binomial_rate FROM flat")
def a18_coverage(spark: SparkSession, d: str) -> DataFrame:
    return records.coverage(_flat(spark, d)).select(F.round("ambiguous_share", 6).alias("ambiguous_share"), F.round("binomial_rate", 6).alias("binomial_rate"))


#: The rules of the image types, written out apart from those of the engine (fixed values).
_RULES = [
    ("R1", "white_bg_ratio > 0.55 AND sat_mean < 28 AND edge_density > 0.030", "DRAWING", 0.90),
    ("R2", "blue_dominance > 0.18 OR sat_mean > 55", "MICROSCOPY", 0.85),
    ("R3", "white_bg_ratio > 0.70 AND edge_density > 0.020", "DRAWING", 0.80),
    ("R4", "sat_mean < 15 AND edge_density < 0.010", "MICROSCOPY", 0.70),
    ("R5", "white_bg_ratio > 0.60 AND edge_density > 0.015", "DRAWING", 0.72),
    ("R6", "white_bg_ratio < 0.30 AND edge_density < 0.025", "MICROSCOPY", 0.68),
    ("R7", "hist_entropy > 3.8 AND white_bg_ratio < 0.45", "MICROSCOPY", 0.65),
    ("R8", "sat_mean < 3 AND white_bg_ratio < 0.40", "MICROSCOPY", 0.68),
    ("R9", "sat_mean < 3 AND white_bg_ratio >= 0.40 AND edge_density < 0.022", "DRAWING", 0.68),
    ("R10", "white_bg_ratio > 0.75 AND edge_density < 0.010", "DRAWING", 0.65),
]
_CASE = " ".join(f"WHEN {c} THEN '{r}'" for r, c, _, _ in _RULES)
_TYPE = " ".join(f"WHEN {c} THEN '{t}'" for _, c, t, _ in _RULES)
_CONF = " ".join(f"WHEN {c} THEN {p}" for _, c, _, p in _RULES)


@query(
    f"""SELECT rec_id, CASE {_CASE} ELSE 'R11' END AS rule, CASE {_TYPE} ELSE 'AMBIGUOUS' END AS image_type, CASE {_CONF} ELSE 0.40 END::DOUBLE AS confidence
FROM (SELECT rec_id, classifier.sat_mean AS sat_mean, classifier.white_bg_ratio AS white_bg_ratio, classifier.edge_density AS edge_density, classifier.hist_entropy AS hist_entropy, classifier.blue_dominance AS blue_dominance FROM training_index)"""
)
def f22_rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    f = _read(spark, d, "training_index").select("rec_id", *(F.col(f"classifier.{c}").alias(c) for c in ("sat_mean", "white_bg_ratio", "edge_density", "hist_entropy", "blue_dominance")))
    return records.classified(f).select("rec_id", "rule", "image_type", "confidence")


_ASCII = "regexp_replace(regexp_replace(regexp_replace(coalesce({}, ''), '[\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]', ' ', 'g'), '[^\\x00-\\x7F\\p{{L}}\\p{{M}}\\p{{N}}]', '#', 'g'), '[^\\x00-\\x7F]', '_', 'g')"


_RELABEL = (
    "WITH t AS (SELECT rec_id, saved_to, caption_raw, " + _ASCII.format("caption_raw") + " AS a FROM training_index WHERE image_type = 'AMBIGUOUS'),\n"
    "r AS (SELECT rec_id, saved_to, CASE WHEN <noise> THEN 'NOISE' WHEN regexp_matches(a, '<tree>') THEN 'DRAWING' WHEN regexp_matches(a, '<micro>') THEN 'MICROSCOPY' ELSE 'AMBIGUOUS' END AS new_raw FROM t)\n"
    "SELECT rec_id, new_raw, CASE WHEN new_raw = 'NOISE' THEN 'AMBIGUOUS' ELSE new_raw END AS new_type, regexp_extract(saved_to, '^(.*?)[^/]*/[^/]*$', 1)"
    " || CASE WHEN new_raw = 'NOISE' THEN 'ambiguous/noise' ELSE lower(new_raw) END || '/' || regexp_extract(saved_to, '([^/]*)$', 1) AS new_path FROM r"
)


_RELABEL = (
    _RELABEL.replace("<noise>", " OR ".join(f"contains(lower(coalesce(caption_raw, '')), '{k}')" for k in P.NOISE_KEYWORDS))
    .replace("<tree>", P.TREE_CAPTION.replace("(?iU)", "(?i)"))
    .replace("<micro>", P.MICROSCOPY_CAPTION.replace("(?iU)", "(?i)").replace("ó", "_"))
)


@query(
    _RELABEL.replace("WITH t AS (SELECT rec_id,", f"WITH t AS (SELECT CASE WHEN sat_mean IS NULL THEN 'AMBIGUOUS' {_TYPE} ELSE 'AMBIGUOUS' END AS seen, rec_id,")
    .replace("FROM training_index", "FROM (SELECT *, classifier.sat_mean AS sat_mean, classifier.white_bg_ratio AS white_bg_ratio, classifier.edge_density AS edge_density, classifier.hist_entropy AS hist_entropy, classifier.blue_dominance AS blue_dominance FROM training_index)")
    .replace("THEN 'NOISE' WHEN", "THEN 'NOISE' WHEN seen <> 'AMBIGUOUS' THEN seen WHEN")
)
def f24_relabelled_by_image(spark: SparkSession, d: str) -> DataFrame:
    """Ambiguous records whose image was measured get the type its features give, before the caption is asked."""
    t = _read(spark, d, "training_index")
    named = [F.col(f"classifier.{c}").alias(c) for c in ("sat_mean", "white_bg_ratio", "edge_density", "hist_entropy", "blue_dominance")]
    seen = records.classified(t.filter("classifier.sat_mean IS NOT NULL").select("rec_id", *named)).select("rec_id", F.col("image_type").alias("seen"))
    r = records.relabelled(t.select("rec_id", "image_type", "caption_raw", "saved_to").join(seen, "rec_id", "left"), F.col("seen"))
    return r.select("rec_id", "new_raw", "new_type", records.moved_to(F.col("saved_to"), F.col("new_raw")).alias("new_path"))


@query(_RELABEL)
def f24_relabelled(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index")
    r = records.relabelled(t.select("rec_id", "image_type", "caption_raw", "saved_to"))
    return r.select("rec_id", "new_raw", "new_type", records.moved_to(F.col("saved_to"), F.col("new_raw")).alias("new_path"))


@query("SELECT doc_id FROM documents WHERE " + " OR ".join(f"contains(lower(text), '{k}')" for k in P.NOISE_KEYWORDS))
def f8_noise(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").filter(P.noisy(F.col("text"))).select("doc_id")


@query(
    _FLAT
    + ", "
    + _SPECIES
    + """ SELECT 'TrainingImage' AS label, count(*) AS n, count(DISTINCT id) AS ids FROM flat UNION ALL SELECT 'Genero', count(DISTINCT genus), count(DISTINCT genus) FROM flat UNION ALL SELECT 'Especie', count(*), count(*) FROM sp"""
)
def u1_export_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.exported(_flat(spark, d)).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


@query(
    _FLAT
    + """, sp AS (SELECT binomial, first(coalesce(genus, '') ORDER BY rec_id) AS g FROM flat WHERE binomial IS NOT NULL GROUP BY binomial)
SELECT 'TrainingImage' AS label, id, json_object('id', id, 'name', id, 'imageType', image_type, 'imageTypeRaw', image_type_raw, 'paper', paper, 'binomial', coalesce(binomial, ''), 'genus', coalesce(genus, ''),
  'species', coalesce(species, ''), 'confidence', epithet_confidence, 'captionRaw', substring(caption_raw, 1, 300), 'savedTo', saved_to)::VARCHAR AS properties FROM flat
UNION ALL SELECT DISTINCT 'Genero', genus, json_object('id', genus, 'name', genus, 'origem', 'training')::VARCHAR FROM flat WHERE genus IS NOT NULL
UNION ALL SELECT 'Especie', binomial, json_object('id', binomial, 'name', binomial, 'generoNome', g, 'origem', 'training')::VARCHAR FROM sp"""
)
def u1_export(spark: SparkSession, d: str) -> DataFrame:
    return records.exported(_flat(spark, d))


@query(
    """SELECT rec_id, substring(lower(regexp_replace(regexp_replace(coalesce(paper, ''), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 80) AS slug,
 substring(regexp_replace(coalesce(paper, ''), '[^A-Za-z0-9_.\\-]+', '_', 'g'), 1, 80) AS safe, substring(sha1(coalesce(caption_raw, '')), 1, 6) AS hash,
 CASE WHEN len(string_split(id, '__')) >= 5 THEN array_to_string(string_split(id, '__')[1:4], '__') ELSE id END AS base FROM training_index"""
)
def n3_names(spark: SparkSession, d: str) -> DataFrame:
    paper = F.coalesce("paper", F.lit(""))
    return _read(spark, d, "training_index").select(
        "rec_id", naming.slug(paper).alias("slug"), naming.safe(paper).alias("safe"), naming.short_hash(F.coalesce("caption_raw", F.lit(""))).alias("hash"), naming.base_of_name(F.col("id")).alias("base")
    )


_SLUG = "substring(lower(regexp_replace(regexp_replace({}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 80)"


@query(
    "SELECT rec_id, " + _SLUG.format("coalesce(paper, 'none')") + """ || printf('__p%03d__fig%02d__', coalesce(page, 0), coalesce(fig_index, 0)) || substring(sha1(coalesce(caption_raw, '')), 1, 6) || '__'
 || CASE WHEN trim(coalesce(epithet.genus, '')) = '' THEN 'UNKNOWN_UNKNOWN' ELSE """
    + _SLUG.format("trim(epithet.genus) || '_' || coalesce(nullif(trim(epithet.species), ''), 'sp')")
    + """ END AS name,
 id || '__' || CASE WHEN coalesce(epithet.confidence, 0.0) < 0.35 THEN 'UNCERTAIN_' ELSE '' END || substring(regexp_replace(coalesce(epithet.genus, 'UNKNOWN'), '[^A-Za-z0-9_.\\-]+', '_', 'g'), 1, 80) || '_'
 || substring(regexp_replace(coalesce(epithet.species, 'sp'), '[^A-Za-z0-9_.\\-]+', '_', 'g'), 1, 80) || printf('__conf%02d', round_even(coalesce(epithet.confidence, 0.0) * 100, 0)::INT) || '.png' AS file FROM training_index"""
)
def n7_record_names(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index")
    base = naming.record_id(F.coalesce("paper", F.lit("none")), F.coalesce("page", F.lit(0)), F.coalesce("fig_index", F.lit(0)), naming.short_hash(F.coalesce("caption_raw", F.lit(""))))
    out = naming.output_name(F.col("id"), F.coalesce("epithet.genus", F.lit("UNKNOWN")), F.coalesce("epithet.species", F.lit("sp")), F.coalesce("epithet.confidence", F.lit(0.0)), F.lit(".png"))
    return t.select("rec_id", naming.record_name(base, F.col("epithet.genus"), F.col("epithet.species")).alias("name"), out.alias("file"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.name'), event_type) AS name FROM events")
def n20_json(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.name"), "event_type").alias("name"))


# --- text --------------------------------------------------------------------

_E1 = (
    "WITH t AS (SELECT rec_id, caption_raw AS c, " + _ASCII.format("caption_raw") + " AS a FROM training_index),\n"
    "m AS (SELECT rec_id, c, a, regexp_extract_all(a, '\\b[A-Z][a-z]{2,}[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f]+[a-z]{4,}\\b') AS b, regexp_extract_all(a, '\\b([A-Z][a-z]{2,})\\b', 1) AS g FROM t),\n"
    "k AS (SELECT rec_id, c, a, [array_to_string(string_split_regex(x, '\\s+'), ' ') FOR x IN b IF NOT list_contains(<e>, string_split_regex(x, '\\s+')[2]) AND NOT list_contains(<n>, string_split_regex(x, '\\s+')[1])] AS p,\n"
    " [x FOR x IN g IF NOT list_contains(<n>, x)] AS g FROM m)\n"
    "SELECT rec_id, CASE WHEN c IS NULL OR NOT regexp_matches(a, '\\S') THEN 'empty-caption' WHEN regexp_matches(a, <blocked>) THEN 'blocked-section' WHEN len(p) > 0 THEN 'binomial-strict' WHEN len(g) > 0 THEN 'genus-only' ELSE 'no-match' END AS rule,\n"
    " CASE WHEN c IS NULL OR NOT regexp_matches(a, '\\S') OR regexp_matches(a, <blocked>) THEN NULL WHEN len(p) > 0 THEN string_split(p[1], ' ')[1] ELSE g[1] END AS genus,\n"
    " CASE WHEN c IS NULL OR NOT regexp_matches(a, '\\S') OR regexp_matches(a, <blocked>) THEN NULL ELSE p[1] END AS binomial FROM k"
)


def _list(xs) -> str:
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


@query(_E1.replace("<e>", _list(P.NOT_EPITHETS)).replace("<n>", _list(P.NOT_GENERA)).replace("<blocked>", "'" + P.BLOCKED_SECTION.replace("(?iU)", "(?i)") + "'"))
def e1_caption_names(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index").select("rec_id", captions.epithet(F.col("caption_raw"), None).alias("e"))
    return t.select("rec_id", "e.rule", "e.genus", "e.binomial")


@query()
def e1_built_in_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index").select("rec_id", captions.epithet(F.col("caption_raw")).alias("e"))
    return t.groupBy("e.rule").agg(F.count("*").alias("n"))


@query()
def e2_names_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every caption of a paper as a page of its own, by page, figure and record; those without a number come after the others.

    Captions that are blank, and so part no name, come last.
    """
    t = _read(spark, d, "training_index").filter("paper IS NOT NULL AND caption_raw IS NOT NULL").select("paper", "page", "fig_index", "rec_id", F.col("caption_raw").alias("text"))
    pages = numbered(t.withColumnRenamed("page", "sheet"), [F.col("paper"), ~F.col("text").rlike(r"(?U)\S"), F.asc_nulls_last("sheet"), F.asc_nulls_last("fig_index"), F.col("rec_id")], "page")
    return captions.epithet_of_pages(pages, "paper", None).select("paper", "epithet.rule", "epithet.genus", "epithet.binomial")


_E1_SQL = _E1.replace("<e>", _list(P.NOT_EPITHETS)).replace("<n>", _list(P.NOT_GENERA)).replace("<blocked>", "'" + P.BLOCKED_SECTION.replace("(?iU)", "(?i)") + "'")


@query(
    f"SELECT c.rec_id, CASE WHEN c.binomial IS NOT NULL OR c.genus IS NOT NULL THEN c.rule ELSE s.rule END AS rule, CASE WHEN c.binomial IS NOT NULL OR c.genus IS NOT NULL THEN c.binomial ELSE s.binomial END AS binomial"
    f" FROM ({_E1_SQL}) c JOIN ({_E1_SQL.replace("caption_raw", "epithet.context_snippet")}) s USING (rec_id)"
)
def e3_name_or_page(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index")
    e = captions.epithet_or_page(F.col("caption_raw"), F.col("epithet.context_snippet"))
    return t.select("rec_id", e.alias("e")).select("rec_id", "e.rule", "e.binomial")


_DASH = "WITH t AS (SELECT rec_id, " + _ASCII.format("caption_raw") + " AS a FROM training_index)\n"


@query(
    _DASH
    + """, m AS (SELECT rec_id, [x FOR x IN regexp_extract_all(a, '\\b[A-Z][a-z]{3,}[ \\t\\n\\x0B\\f\\r\\x1c-\\x1f]+[a-z]{4,}\\b-?') IF NOT ends_with(x, '-')] AS b FROM t)
SELECT rec_id, regexp_replace(b[1], '\\s+', '_') AS name FROM m"""
)
def e7_first_binomial(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "training_index").select("rec_id", P.first_binomial(F.coalesce("caption_raw", F.lit(""))).alias("name"))


_SPACE, _LETTER = "[\\s\\x{0B}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]*", "([\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}])"


@query(f"SELECT rec_id, regexp_replace(coalesce(caption_raw, ''), '{_LETTER}-{_SPACE}\\n{_SPACE}{_LETTER}', '\\1\\2', 'g') AS text FROM training_index")
def n9_dehyphenated(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "training_index").select("rec_id", P.dehyphenated(F.coalesce("caption_raw", F.lit(""))).alias("text"))


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    """Text blocks of each page: those that its records' candidates were read from, each once."""
    t = _read(spark, d, "training_index").filter("paper IS NOT NULL AND page IS NOT NULL")
    c = t.select("paper", "page", F.explode("resolution.candidates").alias("c")).select("paper", "page", F.explode("c.blocks").alias("b"))
    return c.select("paper", "page", "b.block_no", *(F.col(f"b.bbox.{x}").alias(x) for x in ("x0", "y0", "x1", "y1")), "b.text").filter("x0 IS NOT NULL AND text IS NOT NULL").distinct()


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index").filter("paper IS NOT NULL AND page IS NOT NULL AND size(bbox_pdf_points) = 4")
    b = lambda i: F.get("bbox_pdf_points", F.lit(i))
    return t.select("paper", "page", F.col("rec_id").alias("image_id"), b(0).alias("x0"), b(1).alias("y0"), b(2).alias("x1"), b(3).alias("y1"))


_BL = """WITH c AS (SELECT paper, page, unnest(resolution.candidates) AS c FROM training_index WHERE paper IS NOT NULL AND page IS NOT NULL),
b0 AS (SELECT paper, page, unnest(c.blocks) AS b FROM c),
bl AS (SELECT DISTINCT paper, page, b.block_no AS block_no, b.bbox.x0 AS bx0, b.bbox.y0 AS by0, b.bbox.x1 AS bx1, b.bbox.y1 AS by1, b.text AS text FROM b0 WHERE b.bbox.x0 IS NOT NULL AND b.text IS NOT NULL),
im AS (SELECT paper, page, rec_id AS image_id, bbox_pdf_points[1] AS x0, bbox_pdf_points[2] AS y0, bbox_pdf_points[3] AS x1, bbox_pdf_points[4] AS y1 FROM training_index
  WHERE paper IS NOT NULL AND page IS NOT NULL AND len(bbox_pdf_points) = 4)
"""


@query(
    _BL
    + """, r AS (SELECT paper, page, image_id, block_no, trim(text) AS text, regexp_matches(trim(text), '(?i)^(fig|figure|figura|plate|prancha)') AS fig,
  CASE WHEN by0 - y1 >= 0 AND by0 - y1 <= 120 THEN by0 - y1 WHEN by0 - y1 < 0 AND y1 - by0 <= 60 THEN y1 - by0 + 20 END AS near
  FROM im JOIN bl USING (paper, page) WHERE regexp_matches(text, '\\S') AND least(bx1, x1) - greatest(bx0, x0) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY paper, page, image_id ORDER BY fig DESC, near, block_no, text) AS rn FROM r WHERE near IS NOT NULL),
g AS (SELECT paper, page, image_id, string_agg(text, ' ' || chr(10) || ' ' ORDER BY rn) AS caption FROM k WHERE rn <= 3 GROUP BY ALL)
SELECT im.paper, im.page, im.image_id, coalesce(caption, '') AS caption FROM im LEFT JOIN g USING (paper, page, image_id)"""
)
def j17_captions_of_boxes(spark: SparkSession, d: str) -> DataFrame:
    return captions.captions_of_boxes(_boxes(spark, d), _blocks(spark, d), ["paper", "page"])


def _crops(boxes: DataFrame) -> DataFrame:
    return boxes.select("paper", "page", F.col("image_id").alias("crop_id"), ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))


@query(
    _BL
    + """, r AS (SELECT paper, page, image_id AS crop_id, block_no, text, sqrt(((bx0 + bx1) / 2 - (x0 + x1) / 2) ** 2 + ((by0 + by1) / 2 - (y0 + y1) / 2) ** 2) AS dist FROM im JOIN bl USING (paper, page)),
k AS (SELECT *, row_number() OVER (PARTITION BY paper, page, crop_id ORDER BY dist, block_no, text) AS rank FROM r)
SELECT paper, page, crop_id, block_no, text, round(dist, 4) AS dist FROM k WHERE rank <= 8 AND dist <= 250"""
)
def j18_nearest_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = legend.nearest_blocks(_crops(_boxes(spark, d)), _blocks(spark, d), ["paper", "page"])
    return n.select("paper", "page", "crop_id", "block_no", "text", F.round("dist", 4).alias("dist"))


def _layout(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(blocks, pages), each written once: a legend reads three pages at a time, a resolution their blocks as well."""
    tables = SharedTables(spark, "layout")
    blocks = tables.save(_blocks(spark, d).withColumnRenamed("paper", "pdf"), "blocks")
    return blocks, tables.save(_pages(blocks), "pages")


def _pages(b: DataFrame) -> DataFrame:
    """Pages as the text of their blocks, in order of number."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]), "\n")
    return b.groupBy("pdf", "page").agg(text.alias("text"))


def _genera(spark: SparkSession, d: str) -> list[str]:
    """All genera of the reference; more than a vocabulary can hold are an error."""
    g = _read(spark, d, "ref_taxa").filter("taxon_rank = 'genus'").select("genus").distinct()
    return Vocabulary([r["genus"] for r in g.limit(Vocabulary.MOST + 1).collect()], "ref_taxa").names


def _entries(source: str, text: str, pattern: str, strategy: str, extra: str = "0") -> str:
    """SQL of the valid entries that a pattern finds, with their place in the text."""
    part = lambda i: f"unnest(regexp_extract_all({text}, '{pattern}', {i}))"
    return (
        f"SELECT pdf, page, '{strategy}' AS strategy, {extra} AS side, i, n::INT AS number, g, e FROM (SELECT *, {part(1)} AS n, {part(2)} AS g, {part(3)} AS e,"
        f" generate_subscripts(regexp_extract_all({text}, '{pattern}', 1), 1) AS i FROM {source}) WHERE valid_name(g, e)"
    )


_STRICT = r"(?m)(?:^|[.;]\s*|,\s+)(\d{1,3})\s*[.)\-–:]\s*([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})"
_LOOSE = r"(\d{1,3})\s*[.,:)\-–]\s*([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})"
_PAIRS = r"(\d{1,3})\s*[.,;:)\-–]\s*([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})"
_FIGURE = r"(?is)(?:Figs?\.?|Figures?|Plate|Prancha)\s*[\d.,\-–\s]+[.:\-–]\s*(.+)"
_SHORT = r"(\d{1,3})\s*[.,;:)\-–]\s*([A-Z])\.\s*([a-z][a-z\-]{2,25})"
_VALID = (
    "(length(e) >= 5 AND length(g) >= 4 AND NOT regexp_matches(g, '(aceae|ales|idae|inae|oideae|mycota|mycetes|ing|tion|sion|ment|ness|less|ance|ence|ical|ular|ious|eous|able)$')"
    f" AND NOT list_contains({_list(P.NOT_LEGEND_GENERA)}, g) AND NOT list_contains({_list(P.NOT_LEGEND_EPITHETS)}, e))"
)
_LEGENDS = (
    _BL
    + """, p AS (SELECT paper AS pdf, page, string_agg(text, chr(10) ORDER BY block_no NULLS FIRST, text) AS text FROM bl GROUP BY ALL),
near AS (SELECT a.pdf, a.page, b.text, CASE WHEN b.page < a.page THEN 1 ELSE 2 END AS side FROM p a JOIN p b ON a.pdf = b.pdf AND (b.page = a.page - 1 OR b.page = a.page + 1)),
fig AS (SELECT pdf, page, regexp_extract(text, '"""
    + _FIGURE
    + """', 1) AS text FROM p),
h1 AS ("""
    + _entries("p", "text", _STRICT, "legend_strict")
    + """), h2 AS ("""
    + _entries("p", "text", _LOOSE, "legend_loose")
    + """), h3 AS ("""
    + _entries("fig", "text", _PAIRS, "caption_pairs")
    + """), h5 AS ("""
    + _entries("near", "text", _STRICT, "adjacent_pages", "side")
    + """),
a1 AS (SELECT *, 1 AS way FROM h1 QUALIFY row_number() OVER (PARTITION BY pdf, page, number ORDER BY i) = 1),
a2 AS (SELECT * FROM a1 UNION ALL (SELECT *, 2 FROM h2 WHERE (SELECT count(*) FROM a1 WHERE a1.pdf = h2.pdf AND a1.page = h2.page) < 2
    AND NOT EXISTS (SELECT 1 FROM a1 WHERE a1.pdf = h2.pdf AND a1.page = h2.page AND a1.number = h2.number) QUALIFY row_number() OVER (PARTITION BY pdf, page, number ORDER BY i) = 1)),
a3 AS (SELECT * FROM a2 UNION ALL (SELECT *, 3 FROM h3 WHERE (SELECT count(*) FROM a2 WHERE a2.pdf = h3.pdf AND a2.page = h3.page) < 2
    AND NOT EXISTS (SELECT 1 FROM a2 WHERE a2.pdf = h3.pdf AND a2.page = h3.page AND a2.number = h3.number) QUALIFY row_number() OVER (PARTITION BY pdf, page, number ORDER BY i) = 1)),
modal AS (SELECT pdf, page, g FROM (SELECT pdf, page, g, count(*) AS n, min(way * 1000000 + i) AS seen FROM a3 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pdf, page ORDER BY n DESC, seen) = 1),
s4 AS (SELECT p.pdf, p.page, modal.g, unnest(regexp_extract_all(text, '"""
    + _SHORT
    + """', 1)) AS n, unnest(regexp_extract_all(text, '"""
    + _SHORT
    + """', 2)) AS initial, unnest(regexp_extract_all(text, '"""
    + _SHORT
    + """', 3)) AS e, generate_subscripts(regexp_extract_all(text, '"""
    + _SHORT
    + """', 1), 1) AS i FROM p JOIN modal USING (pdf, page)),
a4 AS (SELECT * FROM a3 UNION ALL (SELECT pdf, page, 'abbreviated', 0, i, n::INT, g, e, 4 FROM s4 WHERE initial = substring(g, 1, 1) AND valid_name(g, e)
    AND NOT EXISTS (SELECT 1 FROM a3 WHERE a3.pdf = s4.pdf AND a3.page = s4.page AND a3.number = s4.n::INT) QUALIFY row_number() OVER (PARTITION BY pdf, page, n::INT ORDER BY i) = 1)),
a5 AS (SELECT * FROM a4 UNION ALL (SELECT *, 5 FROM h5 WHERE NOT EXISTS (SELECT 1 FROM a4 WHERE a4.pdf = h5.pdf AND a4.page = h5.page) QUALIFY row_number() OVER (PARTITION BY pdf, page, number ORDER BY side, i) = 1))
SELECT pdf, page, number, g AS genus, e AS epithet, strategy, CASE WHEN g IN (SELECT genus FROM ref_taxa WHERE taxon_rank = 'genus')
  THEN CASE strategy WHEN 'legend_strict' THEN 0.95 WHEN 'legend_loose' THEN 0.85 WHEN 'caption_pairs' THEN 0.8 WHEN 'abbreviated' THEN 0.7 ELSE 0.65 END
  ELSE CASE strategy WHEN 'legend_strict' THEN 0.522 WHEN 'legend_loose' THEN 0.468 WHEN 'caption_pairs' THEN 0.44 WHEN 'abbreviated' THEN 0.385 ELSE 0.358 END END::DOUBLE AS confidence FROM a5"""
).replace("valid_name(g, e)", _VALID)


@query(_LEGENDS)
def e4_legends(spark: SparkSession, d: str) -> DataFrame:
    g = _genera(spark, d)
    p = legend.legends(_layout(spark, d)[1], g)
    return p.select("pdf", "page", F.explode("legend").alias("l")).select("pdf", "page", "l.*")


_NAME = r"\b([A-Z][a-z]{2,20})\s+([a-z][a-z\-]{2,25})\b"
_RESOLVED = (
    _LEGENDS.rsplit("SELECT pdf, page, number,", 1)[0]
    + ", l AS (SELECT pdf, page, number,"
    + _LEGENDS.rsplit("SELECT pdf, page, number,", 1)[1]
    + """), voc AS (SELECT DISTINCT genus FROM ref_taxa WHERE taxon_rank = 'genus'),
nr AS (SELECT * FROM (SELECT paper AS pdf, page, image_id AS crop_id, block_no, text, sqrt(((bx0 + bx1) / 2 - (x0 + x1) / 2) ** 2 + ((by0 + by1) / 2 - (y0 + y1) / 2) ** 2) AS dist,
    row_number() OVER (PARTITION BY paper, page, image_id ORDER BY dist, block_no, text) AS rank FROM im JOIN bl USING (paper, page)) WHERE rank <= 8 AND dist <= 250),
nu AS (SELECT *, unnest(regexp_extract_all(text, '\\b(\\d{1,3})\\b', 1)) AS n, generate_subscripts(regexp_extract_all(text, '\\b(\\d{1,3})\\b', 1), 1) AS pos FROM nr),
ca AS (SELECT pdf, page, crop_id, 0 AS way, rank, pos, genus || ' ' || epithet AS binomial, strategy, confidence, round(dist, 2) AS dist FROM nu JOIN l USING (pdf, page) WHERE n::INT = number),
nb AS (SELECT *, unnest(regexp_extract_all(text, '"""
    + _NAME
    + """', 1)) AS g, unnest(regexp_extract_all(text, '"""
    + _NAME
    + """', 2)) AS e, generate_subscripts(regexp_extract_all(text, '"""
    + _NAME
    + """', 1), 1) AS pos FROM nr),
cb AS (SELECT pdf, page, crop_id, 1 AS way, rank, pos, g || ' ' || e AS binomial, 'proximity_binomial' AS strategy, 0.55::DOUBLE AS confidence, round(dist, 2) AS dist FROM nb WHERE valid_name(g, e) AND g IN (SELECT genus FROM voc)),
pf AS (SELECT pdf, page, unnest(regexp_extract_all(text, '"""
    + _NAME
    + """', 1)) AS g, unnest(regexp_extract_all(text, '"""
    + _NAME
    + """', 2)) AS e, generate_subscripts(regexp_extract_all(text, '"""
    + _NAME
    + """', 1), 1) AS pos FROM p),
cc AS (SELECT im.paper AS pdf, im.page, image_id AS crop_id, 2 AS way, 0 AS rank, 0 AS pos, g || ' ' || e AS binomial, 'page_fallback' AS strategy, 0.4::DOUBLE AS confidence, NULL::DOUBLE AS dist FROM im
  JOIN (SELECT * FROM pf WHERE valid_name(g, e) AND g IN (SELECT genus FROM voc) QUALIFY row_number() OVER (PARTITION BY pdf, page ORDER BY pos) = 1) f ON f.pdf = im.paper AND f.page = im.page),
al AS (SELECT * FROM ca UNION ALL SELECT * FROM cb UNION ALL SELECT * FROM cc),
tp AS (SELECT *, row_number() OVER (PARTITION BY pdf, page, crop_id ORDER BY confidence DESC, dist ASC NULLS LAST, way, rank, pos) AS place FROM al),
st AS (SELECT pdf, page, crop_id, count(*) AS n FROM tp WHERE place <= 5 GROUP BY ALL)
SELECT im.paper AS pdf, im.page, image_id AS crop_id, binomial, string_split(binomial, ' ')[1] AS genus, string_split(binomial, ' ')[2] AS epithet, coalesce(strategy, 'pdf_filename') AS strategy,
  coalesce(confidence, 0.15) AS confidence, CASE WHEN binomial IS NULL THEN 'PDF stem=' || regexp_replace(substring(regexp_replace(regexp_replace(regexp_replace(im.paper, '\\.[^.]*$', ''), '[^\\p{L}\\p{N}_\\s\\-]', '', 'g'),
  '[\\s\\-]+', '_', 'g'), 1, 30), '_[^_]*$', '') END AS note, coalesce(n, 0)::INT AS n_candidates
FROM im LEFT JOIN (SELECT * FROM tp WHERE place = 1) t ON t.pdf = im.paper AND t.page = im.page AND t.crop_id = im.image_id LEFT JOIN st ON st.pdf = im.paper AND st.page = im.page AND st.crop_id = im.image_id"""
).replace("valid_name(g, e)", _VALID)


@query(_RESOLVED)
def e5_resolved(spark: SparkSession, d: str) -> DataFrame:
    g = _genera(spark, d)
    blocks, pages = _layout(spark, d)
    pages = legend.legends(pages, g)
    crops = _crops(_boxes(spark, d)).withColumnRenamed("paper", "pdf")
    return legend.resolve(crops, blocks, pages, g)


# --- similarity --------------------------------------------------------------


@query("SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings) WHERE rn <= 8")
def k1_class_cap(spark: SparkSession, d: str) -> DataFrame:
    return similarity.capped(_read(spark, d, "embeddings"), ["label"], [F.col("vec_id")]).select("vec_id", "label")


_KNN = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, e.vec_id AS id, e.label, list_dot_product(q.v, e.embedding::DOUBLE[]) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s),
t AS (SELECT * FROM k WHERE rank <= 5),
c AS (SELECT query_id, label, sum(greatest(sim, 0.0)) AS w FROM t GROUP BY query_id, label),
v AS (SELECT query_id, label, w / (sum(w) OVER (PARTITION BY query_id) + 1e-12) AS share, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, label) AS place FROM c)
"""


def _neighbours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries are the vectors whose id is divisible by 50, against all vectors."""
    e = _read(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = similarity.neighbours(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return found, e.select(F.col("vec_id").alias("id"), "label", F.lit(1.0).alias("label_confidence"))


@query(_KNN + "SELECT query_id, id, round(sim, 4) AS sim, rank FROM t")
def j21_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d)[0].select("query_id", "id", F.round("sim", 4).alias("sim"), "rank")


@query(_KNN + "SELECT query_id, label, round(share, 4) AS share, place FROM v WHERE place <= 3")
def a9_knn_vote(spark: SparkSession, d: str) -> DataFrame:
    found, labels = _neighbours(spark, d)
    return similarity.votes(found, labels, ["label"]).withColumn("share", F.round("share", 4))


@query(
    _KNN
    + """, b AS (SELECT query_id, max(share) AS conf, min_by(label, place) AS best FROM v WHERE place <= 3 GROUP BY query_id),
j AS (SELECT query_id, '[' || string_agg('{"place":' || place || ',"label":"' || label || '","share":"' || printf('%.4f', share) || '"}', ',' ORDER BY place) || ']' AS top_json FROM (SELECT query_id, place, label, share FROM v WHERE place <= 3) GROUP BY query_id)
SELECT query_id, best::VARCHAR AS best, round(conf, 4) AS confidence, conf < 0.35 AS uncertain, top_json FROM b JOIN j USING (query_id)"""
)
def w14_predictions(spark: SparkSession, d: str) -> DataFrame:
    found, labels = _neighbours(spark, d)
    p = similarity.predictions(similarity.votes(found, labels.withColumn("label", F.col("label").cast("string")), ["label"]), "label")
    return p.withColumn("confidence", F.round("confidence", 4))


@query(
    _KNN
    + """, b AS (SELECT query_id, max(share) AS conf, min_by(label, place) AS best FROM v WHERE place <= 3 GROUP BY query_id)
SELECT 'point' || (query_id % 7) AS sampling_point, 'point' || (query_id % 7) || '/v' || query_id || '.PNG' AS target_path, 'Class' || best AS best_genus, 'sp' AS best_species, printf('%.4f', conf) AS confidence,
  'point' || (query_id % 7) || '/v' || query_id || '__' || CASE WHEN conf < 0.35 THEN 'UNCERTAIN_' ELSE '' END || 'Class' || best || '_sp__conf' || printf('%02d', CAST(round_even(conf * 100, 0) AS INT)) || '.png' AS output_path FROM b"""
)
def w14_named_predictions(spark: SparkSession, d: str) -> DataFrame:
    found, labels = _neighbours(spark, d)
    labels = labels.select("id", F.concat(F.lit("Class"), F.col("label").cast("string")).alias("genus"), F.lit("sp").alias("species"), "label_confidence")
    targets = found.select("query_id").distinct().withColumn("path", F.concat(F.lit("point"), F.col("query_id") % 7, F.lit("/v"), F.col("query_id"), F.lit(".PNG")))
    return similarity.named_predictions(similarity.votes(found, labels, ["genus", "species"]), targets).drop("top3_json")


@query(
    """WITH q AS (SELECT vec_id AS query_id, label AS truth, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
c AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
x AS (SELECT * FROM (VALUES (1), (5), (10)) t(shots)),
s AS (SELECT shots, query_id, truth, c.vec_id AS id, c.label, list_dot_product(q.v, c.v) AS sim FROM x JOIN c ON c.r <= shots JOIN q ON q.query_id <> c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY shots, query_id ORDER BY sim DESC, id) AS rank FROM s),
w AS (SELECT shots, query_id, truth, label, sum(greatest(sim, 0.0)) AS w FROM k WHERE rank <= 5 GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY shots, query_id ORDER BY w DESC, label) AS place FROM w)
SELECT shots, count(*) AS queries, count(CASE WHEN label = truth THEN 1 END) AS hits, count(CASE WHEN label = truth THEN 1 END) / count(*) AS accuracy FROM b WHERE place = 1 GROUP BY shots"""
)
def d4_few_shot(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return similarity.few_shot(q, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), "label"))


@query(_KNN + "SELECT e.label AS truth, v.label AS guess, count(*) AS n FROM v JOIN embeddings e ON e.vec_id = v.query_id WHERE place = 1 GROUP BY ALL")
def d4_confusion(spark: SparkSession, d: str) -> DataFrame:
    found, labels = _neighbours(spark, d)
    best = similarity.votes(found, labels, ["label"], 1).select("query_id", F.col("label").alias("guess"))
    truth = labels.select(F.col("id").alias("query_id"), F.col("label").alias("truth"))
    return similarity.confusion(best.join(truth, "query_id"), "truth", "guess")


@query(
    _KNN
    + """, b AS (SELECT e.label AS truth, v.label AS guess FROM v JOIN embeddings e ON e.vec_id = v.query_id WHERE place = 1),
l AS (SELECT truth AS label FROM b UNION SELECT guess FROM b),
u AS (SELECT label, (SELECT count(*) FROM b WHERE truth = label) AS support, (SELECT count(*) FROM b WHERE guess = label) AS guessed, (SELECT count(*) FROM b WHERE truth = label AND guess = label) AS hit FROM l),
p AS (SELECT label, support, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0.0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall FROM u)
SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, support FROM p"""
)
def d4_scores(spark: SparkSession, d: str) -> DataFrame:
    found, labels = _neighbours(spark, d)
    best = similarity.votes(found, labels, ["label"], 1).select("query_id", F.col("label").alias("guess"))
    return similarity.scores(best.join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("truth")), "query_id"), "truth", "guess")


@query("SELECT paper, image_type, count(*) AS n, sum(count(*)) OVER (PARTITION BY paper)::BIGINT AS total FROM training_index GROUP BY paper, image_type")
def a8_rollup(spark: SparkSession, d: str) -> DataFrame:
    return similarity.rollup_counts(_read(spark, d, "training_index"), "paper", "image_type")


@query("SELECT rec_id, image_type, unnest(generate_series(1, greatest(ceil(900.0 / n), 1)::INT))::INT AS copy FROM training_index JOIN (SELECT image_type, count(*) AS n FROM training_index GROUP BY 1) USING (image_type)")
def d2_oversampled(spark: SparkSession, d: str) -> DataFrame:
    return similarity.oversampled(_read(spark, d, "training_index").select("rec_id", "image_type"), "image_type", 900)


@query(
    """SELECT a.vec_id, round(list_dot_product(a.e, b.e), 4) AS dot, round(list_distance(a.e, b.e), 4) AS dist, round(list_cosine_similarity(a.e, b.e), 4) AS cosine,
 round(CASE WHEN a.label = b.label THEN list_distance(a.e, b.e) ** 2 ELSE greatest(1.0 - list_distance(a.e, b.e), 0) ** 2 END, 4) AS loss
FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1"""
)
def n17_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings").select("vec_id", "label", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("l2"), F.col("embedding").alias("e2"))
    a, b = F.col("embedding"), F.col("e2")
    dist = vectors.distance(a, b)
    r = lambda c: F.round(c, 4)
    return e.join(n, "vec_id").select("vec_id", r(vectors.dot(a, b)).alias("dot"), r(dist).alias("dist"), r(vectors.cosine(a, b)).alias("cosine"), r(vectors.contrastive(dist, F.col("label") == F.col("l2"))).alias("loss"))


# --- images ------------------------------------------------------------------


def _images(spark: SparkSession, d: str, side: int = 256) -> DataFrame:
    """Grey images made of the vectors: 8 x 8 values, each a square with an ellipse of ink whose size is the value."""
    import numpy as np
    import pandas as pd

    def draw(batches):
        cell = side // 8
        y, x = np.mgrid[0:cell, 0:cell] - (cell - 1) / 2
        for b in batches:
            data = []
            for v in b["embedding"]:
                a = np.asarray(v, np.float64).reshape(8, 8)
                radius = (np.abs(a) / max(np.abs(a).max(), 1e-9)) * cell * 0.7
                inside = np.sqrt(y**2 + x**2)[None, None] <= radius[:, :, None, None]
                data.append(np.where(inside, 30, 250).astype(np.uint8).transpose(0, 2, 1, 3).reshape(side, side).tobytes())
            yield pd.DataFrame({"image_id": b["vec_id"], "height": side, "width": side, "channels": 1, "data": data})

    return spread(_read(spark, d, "embeddings").select("vec_id", "embedding")).mapInPandas(draw, "image_id long, height int, width int, channels int, data binary")


@query()
def v12_image_types(spark: SparkSession, d: str) -> DataFrame:
    return vision.image_types(_images(spark, d))


@query()
def v3_specimens(spark: SparkSession, d: str) -> DataFrame:
    return vision.specimens(_images(spark, d)).drop("crop")


def _coloured(spark: SparkSession, d: str) -> DataFrame:
    """Colour images made of the vectors: 4 x 4 cells of 64 pixels, each with a rectangle of dark red, green or blue whose sides follow from a value."""
    import numpy as np
    import pandas as pd

    def draw(batches):
        for b in batches:
            data = []
            for i, v in zip(b["vec_id"], b["embedding"], strict=True):
                n = np.floor(np.abs(np.asarray(v, np.float64)[:16]) * 1000).astype(int)
                img = np.full((256, 256, 3), 250, np.uint8)
                ink = np.full(3, 20, np.uint8)
                ink[i % 3] = 120
                for k in range(16):
                    y, x = 64 * (k // 4) + 8, 64 * (k % 4) + 8
                    img[y : y + 24 + n[k] // 25 % 25, x : x + 24 + n[k] % 25] = ink
                data.append(img.tobytes())
            yield pd.DataFrame({"image_id": b["vec_id"], "height": 256, "width": 256, "channels": 3, "data": data})

    return spread(_read(spark, d, "embeddings").select("vec_id", "embedding")).mapInPandas(draw, "image_id long, height int, width int, channels int, data binary")


_RECT = """WITH n AS (SELECT vec_id, k, CAST(floor(abs(embedding[k + 1]::DOUBLE) * 1000) AS INT) AS n FROM embeddings, range(16) t(k)),
r AS (SELECT vec_id AS image_id, (64 * (k % 4) + 8)::INT AS x, (64 * (k // 4) + 8)::INT AS y, 24 + n % 25 AS w, 24 + n // 25 % 25 AS h FROM n)
"""


@query(_RECT + "SELECT image_id, x, y, w, h FROM r")
def v3_rectangles(spark: SparkSession, d: str) -> DataFrame:
    return vision.specimens(_coloured(spark, d)).select("image_id", "x", "y", "w", "h")


@query(_RECT + "SELECT image_id, x, y, w, h FROM r")
def v6_rectangles(spark: SparkSession, d: str) -> DataFrame:
    return vision.drawings(_coloured(spark, d)).select("image_id", "x", "y", "w", "h")


@query(
    _RECT
    + """, f AS (SELECT image_id, sum(w * h) / 65536.0 AS ink FROM r GROUP BY image_id)
SELECT image_id, 256 AS width, 256 AS height, round(ink * 213, 4) AS sat_mean, round(1 - ink, 4) AS white_bg_ratio, CASE WHEN image_id % 3 = 2 THEN round(ink, 4) ELSE 0.0 END AS blue_dominance FROM f"""
)
def v1_features(spark: SparkSession, d: str) -> DataFrame:
    f = vision.features(_coloured(spark, d))
    return f.select("image_id", "width", "height", *(F.round(c, 4).alias(c) for c in ("sat_mean", "white_bg_ratio", "blue_dominance")))


@query(
    """WITH s AS (SELECT vec_id, 'plate' || (vec_id % 7) AS pdf, vec_id // 7 % 5 + 1 AS page, vec_id // 35 + 1 AS img, unnest(generate_series(1, 16)) AS k FROM embeddings WHERE vec_id % 11 <> 0)
SELECT printf('%s_pg%03d_img%02d_cond%02d.png', CASE WHEN page % 2 = 0 THEN 'Tetracladium_marchalianum' ELSE pdf END, page, img, k) AS name FROM s"""
)
def e9_specimen_files(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.specimen_files(*_plates(spark, d)).select("name")


@query(
    """SELECT 'plate' || (vec_id % 7) || '.pdf' AS pdf, count(*) AS images, count(CASE WHEN vec_id % 11 = 0 THEN 1 END) AS failed, 16 * count(CASE WHEN vec_id % 11 <> 0 THEN 1 END) AS drawings
FROM embeddings GROUP BY ALL"""
)
def e9_totals(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.specimen_totals(_plates(spark, d)[1])


def _plates(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages, images): the coloured images as those of seven documents of five pages; every eleventh can't be read."""
    i = F.col("image_id")
    images = _coloured(spark, d).withColumns(
        {
            "pdf": F.concat(F.lit("plate"), (i % 7).cast("string"), F.lit(".pdf")),
            "page": (F.floor(i / 7) % 5 + 1).cast("int"),
            "img_no": (F.floor(i / 35) + 1).cast("int"),
            "data": F.when(i % 11 == 0, F.substring("data", 1, 100)).otherwise(F.col("data")),
        }
    )
    named = F.when(F.col("page") % 2 == 0, "Fig. 3. Tetracladium marchalianum, conidia").otherwise("no name here")
    return _read(spark, d, "embeddings").select(
        F.concat(F.lit("plate"), (F.col("vec_id") % 7).cast("string"), F.lit(".pdf")).alias("pdf"), (F.floor(F.col("vec_id") / 7) % 5 + 1).cast("int").alias("page")
    ).distinct().withColumn("text", named), images


@query()
def v6_drawings(spark: SparkSession, d: str) -> DataFrame:
    return vision.drawings(_images(spark, d)).drop("crop")


@query()
def v11_plates(spark: SparkSession, d: str) -> DataFrame:
    return vision.plates(_images(spark, d))


@query()
def v7_merged_boxes(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index").filter("paper IS NOT NULL AND page IS NOT NULL AND size(bbox_pixel) = 4")
    b = lambda i: F.get("bbox_pixel", F.lit(i))
    boxes = t.select("paper", "page", F.col("rec_id").alias("seq"), b(0).alias("x"), b(1).alias("y"), b(2).alias("w"), b(3).alias("h")).na.drop()
    return vision.merged_boxes(boxes, ["paper", "page"])


@query("SELECT image_type, round(quantile_cont(classifier.sat_mean, 0.05), 4) AS p5, round(quantile_cont(classifier.sat_mean, 0.95), 4) AS p95, round(median(classifier.sat_mean), 4) AS mid FROM training_index GROUP BY image_type")
def a16_percentiles(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("classifier.sat_mean")
    q = lambda p: F.round(F.percentile(s, F.lit(p)), 4)
    return _read(spark, d, "training_index").groupBy("image_type").agg(q(0.05).alias("p5"), q(0.95).alias("p95"), q(0.5).alias("mid"))


# --- pipelines ---------------------------------------------------------------


def _image_table(spark: SparkSession, d: str) -> DataFrame:
    """Boxes with what a pipeline knows of an image: figure number, hash of its content, type seen."""
    t = _read(spark, d, "training_index").select(F.col("rec_id").alias("image_id"), "fig_index", F.element_at(F.split("id", "__"), -1).alias("content_hash"), "image_type", "classifier")
    return _boxes(spark, d).join(t, "image_id").withColumnRenamed("paper", "pdf").withColumn("fig_index", F.coalesce("fig_index", F.lit(0)))


@query()
def e10_page_records(spark: SparkSession, d: str) -> DataFrame:
    g = _genera(spark, d)
    i = _image_table(spark, d)
    crops = i.select("pdf", "page", F.col("image_id").alias("crop_id"), "fig_index", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), "content_hash")
    kinds = i.select(F.col("image_id").alias("crop_id"), "image_type", "classifier.confidence", F.col("classifier.rule_fired").alias("rule"))
    return pipelines.page_records(crops, *_layout(spark, d), kinds, g)


@query()
def e11_caption_records(spark: SparkSession, d: str) -> DataFrame:
    i = _image_table(spark, d)
    return pipelines.caption_records(i.drop("classifier", "image_type"), *_layout(spark, d), i.select("image_id", "image_type"))


@query(
    "SELECT t.rec_id, coalesce(n.new_type, t.image_type) AS image_type, coalesce(n.new_raw, t.image_type_raw) AS image_type_raw, t.caption_raw, coalesce(n.new_path, t.saved_to) AS saved_to"
    f" FROM training_index t LEFT JOIN ({_RELABEL}) n USING (rec_id)"
)
def e13_relabel(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index").select("rec_id", "image_type", "image_type_raw", "caption_raw", "saved_to")
    return pipelines.relabel(t)[0]


@query()
def e12_identified(spark: SparkSession, d: str) -> DataFrame:
    e = _read(spark, d, "embeddings")
    vecs = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = vecs.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", F.lit("starform").alias("observed"))
    return pipelines.identified(q, vecs, e.select(F.col("vec_id").alias("id"), F.col("label").alias("genus"), F.lit(1.0).alias("label_confidence")), graph.morphotype_table(*_graph(spark, d)))


_MD5 = "('0x' || substring(md5({}), 1, 13))::BIGINT"


@query(
    f"SELECT rec_id, id, CASE WHEN h < 0.70 THEN 'train' WHEN h < 0.85 THEN 'val' ELSE 'test' END AS split FROM (SELECT rec_id, id, {_MD5.format("coalesce(id, '')")} % 1000000 / 1000000 AS h FROM training_index)"
)
def d1_hash_split(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.hash_split(_read(spark, d, "training_index").select("rec_id", "id"), "id")


@query(
    _G
    + _ANCHORS
    + f""", w AS (SELECT anchor, genus_id, a.morphotype_id = gm.morphotype_id AS hard FROM a CROSS JOIN gm WHERE anchor <> genus_id),
x AS (SELECT *, row_number() OVER (PARTITION BY anchor, hard ORDER BY {_MD5.format("anchor || '|' || genus_id")}, genus_id) AS r FROM w)
SELECT anchor, genus_id, hard FROM x WHERE r <= 5"""
)
def d3_sampled_pairs(spark: SparkSession, d: str) -> DataFrame:
    _, e = _graph(spark, d)
    return pipelines.sampled_pairs(e, _anchors(e))


@query(
    """SELECT paper, image_type AS truth, count(*) AS n, round(avg((image_type = classifier.image_type)::INT), 6) AS accuracy FROM training_index
WHERE paper IS NOT NULL AND image_type IS NOT NULL GROUP BY ROLLUP (paper, image_type)"""
)
def d5_accuracy(spark: SparkSession, d: str) -> DataFrame:
    t = _read(spark, d, "training_index").filter("paper IS NOT NULL AND image_type IS NOT NULL").select("paper", F.col("image_type").alias("truth"), F.col("classifier.image_type").alias("guess"))
    return pipelines.accuracy(t, "paper", "truth", "guess").withColumn("accuracy", F.round("accuracy", 6))


QUERIES = Q
