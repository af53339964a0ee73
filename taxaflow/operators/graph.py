"""A property graph over node and edge tables: upserts, template matches, look-ups, sampling.

Nodes are (id, label, name, properties), edges (src, type, dst). Relations are
narrow in type, so each hop filters edges before it joins; look-up sides are
broadcast by the planner's own size estimate, never by a hint on data that grows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taxaflow.functions.naming import morphotype_of
from taxaflow.runtime import SharedTables

MORPHOTYPES = ["stauroid", "scolecoid", "appendaged", "helicoid", "clavate"]
UNKNOWN = "unknown"
#: Classes of a graph, which its look-ups take as a list.
MOST_CLASSES = 1000
#: Edge types that each label must have (fixed values).
HIERARCHY = [
    ("Class", "BELONGS_TO_PHYLUM", "Classes without phylum"),
    ("Order", "BELONGS_TO_CLASS", "Orders without class"),
    ("Genus", "BELONGS_TO_ORDER", "Genera without order"),
    ("Species", "BELONGS_TO_GENUS", "Species without genus"),
]


# --- loading -----------------------------------------------------------------


def coerced(value: Column, lists_of_strings: bool = True) -> Column:
    """A JSON property as text: strings and scalars as they are, lists and objects as JSON, null as ``null``.

    Node properties keep lists of strings as lists (here: JSON of the list);
    edges have no lists, so both give JSON text.
    """
    v = F.parse_json(value)
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.variant_get(v, "$", "string")).when(kind == "VOID", "null").otherwise(F.to_json(v))


def properties(rows: DataFrame, key: str = "id", order: str = "loaded_at") -> DataFrame:
    """(key, properties): each property's last value over all rows of a key, as a map.

    Property by property, so no key's rows are ever gathered into a list.
    """
    kv = rows.select(key, order, F.explode(F.from_json("properties", "map<string,string>")).alias("k", "v"))
    last = kv.groupBy(key, "k").agg(F.max_by(F.coalesce("v", F.lit("null")), F.struct(F.col(order), F.coalesce("v", F.lit("")))).alias("v"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))


def upsert_nodes(*tables: DataFrame) -> DataFrame:
    """(id, label, name, deleted_at, properties): the last row of each id, with properties merged over all its rows."""
    rows = reduce(DataFrame.union, [t.select("id", "label", "name", "properties", "loaded_at", "deleted_at") for t in tables]).filter("id IS NOT NULL")
    at = F.struct("loaded_at", F.coalesce("name", F.lit("")).alias("n"), F.coalesce("properties", F.lit("")).alias("p"), F.coalesce("label", F.lit("")).alias("l"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("label", "name", "deleted_at"), at).alias("r")).select("id", "r.*")
    return last.join(properties(rows), "id", "left").withColumn("properties", F.coalesce("properties", F.from_json(F.lit("{}"), "map<string,string>")))


def current_nodes(*tables: DataFrame) -> DataFrame:
    """(id, label, name) of the nodes whose last row is not deleted."""
    rows = reduce(DataFrame.union, [t.select("id", "label", "name", "properties", "loaded_at", "deleted_at") for t in tables]).filter("id IS NOT NULL")
    at = F.struct("loaded_at", F.coalesce("name", F.lit("")).alias("n"), F.coalesce("properties", F.lit("")).alias("p"), F.coalesce("label", F.lit("")).alias("l"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("label", "name", "deleted_at"), at).alias("r"))
    return last.filter("r.deleted_at IS NULL").select("id", "r.label", "r.name")


def stated_edges(raw: DataFrame) -> DataFrame:
    """(src, type, dst, edge_id) as stated, with types spelt evenly and without null and blank ids."""
    return raw.filter(F.col("start_node_id").rlike(r"\S") & F.col("end_node_id").rlike(r"\S")).select(
        F.col("start_node_id").alias("src"), F.upper(F.trim("type")).alias("type"), F.col("end_node_id").alias("dst"), "edge_id"
    )


def upsert_edges(edges: DataFrame, nodes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(src, type, dst, created): each edge once whose two ends are nodes; created if ``existing`` lacks it."""
    ids = nodes.select("id")
    e = edges.select("src", "type", "dst").distinct()
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "type", "dst")
    if existing is None:
        return e.withColumn("created", F.lit(True))
    old = existing.select("src", "type", "dst").distinct().withColumn("old", F.lit(True))
    return e.join(old, ["src", "type", "dst"], "left").select("src", "type", "dst", F.col("old").isNull().alias("created"))


def stored(raw: DataFrame, *tables: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The current nodes and the edges between them, each written once to the shared folder.

    A query of several hops reads them once per hop, instead of merging all rows
    of the node tables for each. Edges are sorted by type within their files, so
    that a hop reads the parts with its type.
    """
    store = SharedTables(raw.sparkSession, "graph")
    nodes = store.save(current_nodes(*tables), "nodes")
    edges = upsert_edges(stated_edges(raw), nodes)
    return nodes, store.save(edges.sortWithinPartitions("type", "src"), "edges")


def repeated_ids(*tables: DataFrame) -> DataFrame:
    """(id, n): ids in more than one row, which a uniqueness constraint would refuse."""
    return reduce(DataFrame.union, [t.select("id") for t in tables]).groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, whose evaluation fails if a key stands in two rows."""
    n = F.count("*").over(W.partitionBy(*keys))
    ok = F.assert_true(n == 1, F.concat(F.lit("repeated key: "), F.to_json(F.struct(*keys))))
    return df.withColumn("_ok", ok).filter("_ok IS NULL").drop("_ok")


# --- template matches --------------------------------------------------------


def labelled(nodes: DataFrame, label: str, as_: str) -> DataFrame:
    return nodes.filter(F.col("label") == label).select(F.col("id").alias(f"{as_}_id"), F.col("name").alias(as_))


def hop(rows: DataFrame, nodes: DataFrame, edges: DataFrame, start: str, kind: str, label: str, as_: str, how: str = "inner", back: bool = False) -> DataFrame:
    """Adds (as_id, as) reached from ``start`` over edges of a type, to nodes of a label."""
    s, t = ("dst", "src") if back else ("src", "dst")
    e = edges.filter(F.col("type") == kind).select(F.col(s).alias("_from"), F.col(t).alias(f"{as_}_id"))
    to = e.join(labelled(nodes, label, as_), f"{as_}_id")
    return rows.join(to, F.col(f"{start}_id") == F.col("_from"), how).drop("_from")


def taxonomy(nodes: DataFrame, edges: DataFrame, genus: str | None = None) -> DataFrame:
    """One row per genus: order_name, class_name, phylum, morphotype, conidiogenesis, null where there is none.

    Where a genus fans out to several rows, the first by all names is kept.
    """
    g = labelled(nodes, "Genus", "genus")
    if genus is not None:
        g = g.filter(F.col("genus") == genus)
    r = hop(g, nodes, edges, "genus", "BELONGS_TO_ORDER", "Order", "order_name", "left")
    r = hop(r, nodes, edges, "order_name", "BELONGS_TO_CLASS", "Class", "class_name", "left")
    r = hop(r, nodes, edges, "class_name", "BELONGS_TO_PHYLUM", "Phylum", "phylum", "left")
    r = hop(r, nodes, edges, "genus", "HAS_MORPHOTYPE", "ConidialMorphotype", "morphotype", "left")
    r = hop(r, nodes, edges, "genus", "USES_CONIDIOGENESIS", "Conidiogenesis", "conidiogenesis", "left")
    cols = ["order_name", "class_name", "phylum", "morphotype", "conidiogenesis"]
    key = F.struct(*(x for c in cols for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c))))
    return r.groupBy("genus_id", "genus").agg(F.min(key).alias("k")).select("genus_id", "genus", *(F.col(f"k.{c}") for c in cols))


def lineage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(genus, order_name, class_name, phylum) of all complete paths."""
    r = labelled(nodes, "Genus", "genus")
    for start, kind, label, as_ in (("genus", "BELONGS_TO_ORDER", "Order", "order_name"), ("order_name", "BELONGS_TO_CLASS", "Class", "class_name"), ("class_name", "BELONGS_TO_PHYLUM", "Phylum", "phylum")):
        r = hop(r, nodes, edges, start, kind, label, as_)
    return r.select("genus_id", "genus", "order_name", "class_name", "phylum")


def species_lineage(nodes: DataFrame, edges: DataFrame, genus: str | None = None) -> DataFrame:
    """(species_id, species, genus, order_name, class_name, phylum) of all complete paths from a species up, of one genus if given."""
    r = hop(labelled(nodes, "Species", "species"), nodes, edges, "species", "BELONGS_TO_GENUS", "Genus", "genus")
    if genus is not None:
        r = r.filter(F.col("genus") == genus)
    return r.join(lineage(nodes, edges).drop("genus"), "genus_id").select("species_id", "species", "genus", "order_name", "class_name", "phylum")


def lineage_with_morphotype(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(genus_id, genus, order_name, class_name, phylum, morphotype): complete paths of the genera that have a morphotype, one row for each."""
    return hop(lineage(nodes, edges), nodes, edges, "genus", "HAS_MORPHOTYPE", "ConidialMorphotype", "morphotype").drop("morphotype_id")


def in_order(rows: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """``rows`` sorted, and cut to the first ``limit`` if that is asked for."""
    rows = rows.orderBy(*order)
    return rows if limit is None else rows.limit(limit)


def genera_of_morphotype(nodes: DataFrame, edges: DataFrame, text: str, exact: bool = False) -> DataFrame:
    """(genus_id, genus, morphotype) of genera whose morphotype's name holds ``text`` in any case, or equals it."""
    r = hop(labelled(nodes, "Genus", "genus"), nodes, edges, "genus", "HAS_MORPHOTYPE", "ConidialMorphotype", "morphotype")
    m = F.col("morphotype")
    return r.filter(m == text if exact else F.lower(m).contains(text.lower())).select("genus_id", "genus", "morphotype")


def species_of_region(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(species_id, species, region, genus) of species that occur in regions whose name holds ``text``."""
    r = hop(labelled(nodes, "Species", "species"), nodes, edges, "species", "OCCURS_IN", "GeographicRegion", "region")
    r = r.filter(F.lower("region").contains(text.lower()))
    return hop(r, nodes, edges, "species", "BELONGS_TO_GENUS", "Genus", "genus").select("species_id", "species", "region", "genus")


def attributes_of_morphotype(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(morphotype, attribute) measured for morphotypes whose name holds ``text``."""
    r = hop(labelled(nodes, "ConidialMorphotype", "morphotype"), nodes, edges, "morphotype", "MEASURED_BY", "MorphologicalAttribute", "attribute")
    return r.filter(F.lower("morphotype").contains(text.lower())).select("morphotype", "attribute")


def polyphyletic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(genus_id, genus, classes): names of the classes each polyphyletic genus stands in, in order."""
    r = hop(labelled(nodes, "Genus", "genus"), nodes, edges, "genus", "POLYPHYLETIC_IN", "Class", "class_name")
    return r.groupBy("genus_id", "genus").agg(F.array_sort(F.collect_list("class_name")).alias("classes"))


def richness(nodes: DataFrame, edges: DataFrame, text: str = "", names: list[str] | None = None) -> DataFrame:
    """(region, species_count) of regions whose name holds ``text`` or is one of ``names``."""
    r = hop(labelled(nodes, "Species", "species"), nodes, edges, "species", "OCCURS_IN", "GeographicRegion", "region")
    want = F.col("region").contains(text)
    if names:
        want = want | F.col("region").isin(*names)
    return r.filter(want).groupBy("region").agg(F.count("*").alias("species_count"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): both ends of each stated edge count, so a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def top_degrees(edges: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(id, name, label, degree) of the ``k`` best-linked ids; name and label null without a node."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(k)
    return top.join(nodes, "id", "left").select("id", "name", "label", "degree")


def degree_summary(edges: DataFrame) -> DataFrame:
    """(avg_degree, max_degree, max_id) over the ids that have edges."""
    return degrees(edges).agg(F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("m")).select("avg_degree", "max_degree", F.col("m.id").alias("max_id"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, genera, species, morphotypes, relationships), one row."""
    of = lambda label: F.count_if(F.col("label") == label)
    rows = nodes.select("label", F.lit(True).alias("node")).union(edges.select(F.lit(None).cast("string"), F.lit(False)))
    return rows.agg(
        F.count_if("node").alias("nodes"), of("Genus").alias("genera"), of("Species").alias("species"), of("ConidialMorphotype").alias("morphotypes"), F.count_if(~F.col("node")).alias("relationships")
    )


# --- morphotype look-up and negatives ---------------------------------------


def morphotype_table(nodes: DataFrame, edges: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """(genus_key, genus, morphotype): the class of each genus name in lower case; of several the last by node ids."""
    names = nodes.filter("name IS NOT NULL").select(F.col("id").alias("src"), F.col("name").alias("genus"))
    m = edges.filter("type = 'HAS_MORPHOTYPE'").select("src", "dst", morphotype_of(F.col("dst"), classes).alias("morphotype")).filter("morphotype IS NOT NULL")
    r = m.join(names, "src").withColumn("genus_key", F.lower("genus"))
    return r.groupBy("genus_key").agg(F.max(F.struct("src", "dst", "genus", "morphotype")).alias("m")).select("genus_key", "m.genus", "m.morphotype")


def morphotypes_of(rows: DataFrame, genus: str, table: DataFrame) -> DataFrame:
    """``rows`` with ``morphotype``, looked up in any case; 'unknown' for a genus that the table lacks."""
    t = table.select(F.col("genus_key").alias("_g"), "morphotype")
    return rows.join(t, F.lower(genus) == F.col("_g"), "left").drop("_g").withColumn("morphotype", F.coalesce("morphotype", F.lit(UNKNOWN)))


def genera_by_class(table: DataFrame) -> DataFrame:
    """(morphotype, genera): how many genera each class has."""
    return table.groupBy("morphotype").agg(F.count("*").alias("genera"))


def genera_of_class(table: DataFrame, morphotype: str) -> DataFrame:
    """(genus): all genera of a class, none for a class that the table lacks."""
    return table.filter(F.col("morphotype") == morphotype).select("genus")


def genus_classes(edges: DataFrame) -> DataFrame:
    """(genus_id, morphotype_id): the class of each genus, the last by id if there are several."""
    return edges.filter("type = 'HAS_MORPHOTYPE'").groupBy(F.col("src").alias("genus_id")).agg(F.max("dst").alias("morphotype_id"))


def hard_negatives(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, genus_id): genera of the anchor's class, without itself. ``anchors`` (genus_id) are the stated query set."""
    g = genus_classes(edges)
    a = g.join(anchors.select("genus_id").distinct(), "genus_id").select(F.col("genus_id").alias("anchor"), "morphotype_id")
    return a.join(g, "morphotype_id").filter("anchor <> genus_id").select("anchor", "genus_id")


def easy_negatives(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor, genus_id): genera of other classes than the anchor's.

    The classes are a list of bounded length, so each anchor names the others
    itself and meets their genera by a join on the class.
    """
    g = genus_classes(edges)
    a = g.join(anchors.select("genus_id").distinct(), "genus_id").select(F.col("genus_id").alias("anchor"), F.col("morphotype_id").alias("own"))
    classes = [r[0] for r in g.select("morphotype_id").distinct().limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    others = F.filter(F.array(*(F.lit(c) for c in sorted(classes))).cast("array<string>"), lambda c: c != F.col("own"))
    return a.select("anchor", F.explode(others).alias("morphotype_id")).join(g, "morphotype_id").select("anchor", "genus_id")


def check_predictions(predictions: DataFrame, table: DataFrame) -> DataFrame:
    """Adds (expected, valid, reason) to (predicted_genus, observed): valid if one name holds the other, in any case."""
    t = table.select(F.col("genus_key").alias("_g"), F.col("morphotype").alias("expected"))
    r = predictions.join(t, F.lower("predicted_genus") == F.col("_g"), "left").drop("_g")
    o, e = F.lower("observed"), F.lower("expected")
    valid = F.coalesce(F.contains(o, e) | F.contains(e, o), F.lit(False))
    return r.withColumn("valid", valid).withColumn(
        "reason",
        F.when(F.col("expected").isNull(), F.format_string("Genus '%s' not found in graph", "predicted_genus"))
        .when(F.col("valid"), "Consistent")
        .otherwise(F.format_string("Mismatch: %s expects %s, got %s", "predicted_genus", "expected", "observed")),
    )


# --- audit -------------------------------------------------------------------


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label, name) of nodes on no edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return nodes.join(ends, "id", "left_anti").select("id", "label", "name")


def broken_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(edge_id, item): ``Missing start: id`` and ``Missing end: id``, one row per side."""
    sides = edges.select("edge_id", F.explode(F.array(F.struct(F.lit("start").alias("side"), F.col("src").alias("id")), F.struct(F.lit("end").alias("side"), F.col("dst").alias("id")))).alias("s")).select("edge_id", "s.*")
    return sides.join(nodes.select("id"), "id", "left_anti").select("edge_id", F.format_string("Missing %s: %s", "side", "id").alias("item"))


def duplicate_edges(edges: DataFrame) -> DataFrame:
    """(src, type, dst, extra): how many repeats of each edge follow its first statement."""
    return edges.groupBy("src", "type", "dst").agg((F.count("*") - 1).alias("extra")).filter("extra > 0")


def lacking(nodes: DataFrame, edges: DataFrame, label: str, kind: str) -> DataFrame:
    """(id, name) of nodes of a label from which no edge of the type starts."""
    linked = edges.filter(F.col("type") == kind).select(F.col("src").alias("id"))
    return nodes.filter(F.col("label") == label).join(linked, "id", "left_anti").select("id", "name")


def hierarchy_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id, name) over all rules of HIERARCHY, by one anti-join on (id, type)."""
    spark = nodes.sparkSession
    rules = F.broadcast(spark.createDataFrame([(a, b, c) for a, b, c in HIERARCHY], "label string, type string, rule string"))  # as many rows as HIERARCHY
    need = nodes.join(rules, "label").select("rule", "type", "id", "name")
    return need.join(edges.select(F.col("src").alias("id"), "type"), ["id", "type"], "left_anti").select("rule", "id", "name")


def audit(nodes: DataFrame, edges: DataFrame, may_lack_order: str = "Anguillospora") -> DataFrame:
    """(category, severity, message, n): one row per check.

    A single genus without order whose name holds ``may_lack_order`` is no
    warning. Counts are sums of partial aggregates; no list of items is kept.
    """

    def row(category: str, bad: str, message: str, found: DataFrame, n: Column | None = None) -> DataFrame:
        count = F.coalesce(F.sum(n) if n is not None else F.count("*"), F.lit(0)).cast("long")
        return found.agg(count.alias("n")).select(
            F.lit(category).alias("category"), F.when(F.col("n") > 0, bad).otherwise("INFO").alias("severity"), F.format_string(message, "n").alias("message"), "n"
        )

    rows = [
        row("Orphan Nodes", "ERROR", "%d nodes without any connections", orphans(nodes, edges)),
        row("Broken References", "ERROR", "%d broken edge references", broken_references(nodes, edges)),
        row("Duplicate Edges", "WARNING", "%d duplicate relationships", duplicate_edges(edges), F.col("extra")),
        row("Morphotype Coverage", "WARNING", "%d genera without morphotype", lacking(nodes, edges, "Genus", "HAS_MORPHOTYPE")),
        row("Geographic Distribution", "WARNING", "%d species without distribution", lacking(nodes, edges, "Species", "OCCURS_IN")),
    ]
    gaps = hierarchy_gaps(nodes, edges).groupBy("rule").agg(F.count("*").alias("n"), F.min("name").alias("one"))
    spark = nodes.sparkSession
    rules = spark.createDataFrame([(c,) for _, _, c in HIERARCHY], "rule string").join(gaps, "rule", "left").select("rule", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "one")
    fine = (F.col("n") == 0) | ((F.col("rule") == "Genera without order") & (F.col("n") == 1) & F.coalesce(F.col("one").contains(may_lack_order), F.lit(False)))
    rows.append(rules.select(F.lit("Taxonomic Hierarchy").alias("category"), F.when(fine, "INFO").otherwise("WARNING").alias("severity"), F.format_string("%s: %d", "rule", "n").alias("message"), "n"))
    return reduce(DataFrame.union, rows)


def audit_summary(findings: DataFrame) -> DataFrame:
    """(severity, findings, items) and whether the graph passes: no item of severity ERROR."""
    per = findings.groupBy("severity").agg(F.count("*").alias("findings"), F.sum("n").alias("items"))
    return per.withColumn("passes", F.sum(F.when(F.col("severity") == "ERROR", F.col("items")).otherwise(0)).over(W.partitionBy(F.lit(1))) == 0)


def audit_text(findings: list, details: dict[str, list[str]] | None = None, most: int = 5) -> tuple[str, bool]:
    """(a report as text, whether the graph passes) from collected findings, with up to ``most`` details each."""
    out = []
    for r in findings:
        out.append(f"{r['severity']:8} {r['category']}: {r['message']}")
        items = (details or {}).get(r["category"], [])
        out += [f"    {x}" for x in items[:most]]
        if len(items) > most:
            out.append(f"    +{len(items) - most} more")
    return "\n".join(out), not any(r["severity"] == "ERROR" and r["n"] for r in findings)
