"""A small graph with exactly one violation of each rule, and the look-ups over it."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException

from taxaflow.operators import graph as G

T = datetime(2024, 1, 1)
NODES = [
    ("p1", "Phylum", "Ascomycota"), ("c1", "Class", "Leotiomycetes"), ("c2", "Class", "Dothideomycetes"), ("o1", "Order", "Helotiales"),
    ("g1", "Genus", "Tetracladium"), ("g2", "Genus", "Alatospora"), ("g3", "Genus", "Anguillospora"), ("g4", "Genus", "Lunulospora"),
    ("s1", "Species", "Tetracladium marchalianum"), ("s2", "Species", "Alatospora acuminata"), ("r1", "GeographicRegion", "Mata Atlântica"),
    ("morphotype_stauroid", "ConidialMorphotype", "Stauroid"), ("morphotype_scolecoid", "ConidialMorphotype", "Scolecoid"), ("morphotype_odd", "ConidialMorphotype", "Odd"),
    ("k1", "Conidiogenesis", "Thallic"), ("lost", "Habitat", "Nowhere"),
]
EDGES = [
    ("c1", "BELONGS_TO_PHYLUM", "p1"), ("c2", "BELONGS_TO_PHYLUM", "p1"), ("o1", "BELONGS_TO_CLASS", "c1"), ("g1", "BELONGS_TO_ORDER", "o1"), ("g2", "BELONGS_TO_ORDER", "o1"),
    ("g4", "BELONGS_TO_ORDER", "o1"), ("s1", "BELONGS_TO_GENUS", "g1"), ("s2", "BELONGS_TO_GENUS", "g2"), ("s1", "OCCURS_IN", "r1"), ("g1", "HAS_MORPHOTYPE", "morphotype_stauroid"),
    ("g2", "HAS_MORPHOTYPE", "morphotype_stauroid"), ("g3", "HAS_MORPHOTYPE", "morphotype_scolecoid"), ("g3", "POLYPHYLETIC_IN", "c1"), ("g3", "POLYPHYLETIC_IN", "c2"),
    ("g1", "USES_CONIDIOGENESIS", "k1"), ("g1", "HAS_MORPHOTYPE", "morphotype_odd"), ("s1", "OCCURS_IN", "r1"), ("s1", "COMPARED_WITH", "s1"), ("nope", "OCCURS_IN", "r1"), ("s2", "COMPARED_WITH", "gone"),
]


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame(NODES, "id string, label string, name string")
    e = spark.createDataFrame([(i, *x) for i, x in enumerate(EDGES)], "edge_id long, src string, type string, dst string")
    return n, e


def test_audit_finds_each_violation_once(g):
    n, e = g
    found = {(r.category, r.message): (r.severity, r.n) for r in G.audit(n, e).collect()}
    assert found == {
        ("Orphan Nodes", "1 nodes without any connections"): ("ERROR", 1),
        ("Broken References", "2 broken edge references"): ("ERROR", 2),
        ("Duplicate Edges", "1 duplicate relationships"): ("WARNING", 1),
        ("Morphotype Coverage", "1 genera without morphotype"): ("WARNING", 1),
        ("Geographic Distribution", "1 species without distribution"): ("WARNING", 1),
        ("Taxonomic Hierarchy", "Classes without phylum: 0"): ("INFO", 0),
        ("Taxonomic Hierarchy", "Orders without class: 0"): ("INFO", 0),
        ("Taxonomic Hierarchy", "Genera without order: 1"): ("INFO", 1),
        ("Taxonomic Hierarchy", "Species without genus: 0"): ("INFO", 0),
    }
    assert not G.audit_summary(G.audit(n, e)).first().passes
    assert {r.item for r in G.broken_references(n, e).collect()} == {"Missing start: nope", "Missing end: gone"}


def test_one_missing_order_is_a_warning_unless_allowed(g):
    n, e = g
    rows = G.audit(n, e, may_lack_order="Something").filter("message = 'Genera without order: 1'").collect()
    assert [r.severity for r in rows] == ["WARNING"]


def test_taxonomy_keeps_one_row_of_a_fan_out(g):
    n, e = g
    got = {r.genus: (r.order_name, r.class_name, r.phylum, r.morphotype, r.conidiogenesis) for r in G.taxonomy(n, e).collect()}
    assert got["Tetracladium"] == ("Helotiales", "Leotiomycetes", "Ascomycota", "Odd", "Thallic")
    assert got["Anguillospora"] == (None, None, None, "Scolecoid", None) and len(got) == 4
    assert G.taxonomy(n, e, "Nope").count() == 0
    assert {r.genus for r in G.lineage(n, e).collect()} == {"Tetracladium", "Alatospora", "Lunulospora"}


def test_lookups(g):
    n, e = g
    t = G.morphotype_table(n, e, G.MORPHOTYPES)
    q = n.sparkSession.createDataFrame([("ALATOSPORA",), ("alatospora",), ("Tetracladium",), ("Anguillospora",), ("NonexistentGenus",), (None,)], "genus string")
    got = [(r.genus, r.morphotype) for r in G.morphotypes_of(q, "genus", t).collect()]
    assert sorted(got, key=str) == sorted([("ALATOSPORA", "stauroid"), ("alatospora", "stauroid"), ("Tetracladium", "stauroid"), ("Anguillospora", "scolecoid"), ("NonexistentGenus", "unknown"), (None, "unknown")], key=str)
    assert {(r.morphotype, r.genera) for r in G.genera_by_class(t).collect()} == {("stauroid", 2), ("scolecoid", 1)}
    p = n.sparkSession.createDataFrame([("tetracladium", "Stauroid conidia"), ("Anguillospora", "stauroid"), ("Nope", "x")], "predicted_genus string, observed string")
    assert {r.predicted_genus: r.valid for r in G.check_predictions(p, t).collect()} == {"tetracladium": True, "Anguillospora": False, "Nope": False}


def test_negatives_cover_all_genera(g):
    n, e = g
    all_ = {r.genus_id for r in G.genus_classes(e).collect()}
    a = G.genus_classes(e).select("genus_id")
    hard = {(r.anchor, r.genus_id) for r in G.hard_negatives(e, a).collect()}
    easy = {(r.anchor, r.genus_id) for r in G.easy_negatives(e, a).collect()}
    assert not hard & easy and hard | easy | {(x, x) for x in all_} == {(x, y) for x in all_ for y in all_}


def test_upserts(spark):
    a = spark.createDataFrame([("x", "L", "one", '{"a": 1, "b": ["q"], "n": null}', T, None), ("x", "L", "two", '{"a": 2}', datetime(2024, 2, 1), None), ("d", "L", "z", None, T, T), (None, "L", "z", None, T, None)], "id string, label string, name string, properties string, loaded_at timestamp, deleted_at timestamp")
    got = {r.id: (r.name, r.properties) for r in G.upsert_nodes(a).collect()}
    assert got == {"x": ("two", {"a": "2", "b": '["q"]', "n": "null"}), "d": ("z", {})}
    assert {r.id for r in G.current_nodes(a).collect()} == {"x"}
    assert {r.id: r.name for r in G.upsert_nodes(a, a).collect()} == {r.id: r.name for r in G.upsert_nodes(a).collect()}
    n = spark.createDataFrame([("x",), ("y",)], "id string")
    e = spark.createDataFrame([("x", "T", "y"), ("x", "T", "y"), ("y", "T", "x"), ("x", "T", "gone")], "src string, type string, dst string")
    old = spark.createDataFrame([("x", "T", "y")], "src string, type string, dst string")
    assert sorted(tuple(r) for r in G.upsert_edges(e, n, old).collect()) == [("x", "T", "y", False), ("y", "T", "x", True)]


def test_unique_keys_are_enforced(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "id int")
    assert G.assert_unique(df.filter("id = 1"), "id").count() == 1
    with pytest.raises(PySparkException):
        G.assert_unique(df, "id").collect()


def test_property_values(spark):
    df = spark.createDataFrame([('"s"',), ("1",), ("1.5",), ("true",), ('["a","b"]',), ("[1]",), ('{"k":null}',), ("null",), ("[]",)], "v string")
    assert [r[0] for r in df.select(G.coerced(df.v)).collect()] == ["s", "1", "1.5", "true", '["a","b"]', "[1]", '{"k":null}', "null", "[]"]


def test_empty_graph(g):
    n, e = g
    n, e = n.limit(0), e.limit(0)
    assert G.audit(n, e).filter("n > 0").count() == 0 and G.degree_summary(e).first().avg_degree is None
    assert G.taxonomy(n, e).count() == 0 and G.stats(n, e).first().nodes == 0


def test_report(g):
    n, e = g
    text, passes = G.audit_text(G.audit(n, e).collect(), {"Broken References": [f"x{i}" for i in range(7)]})
    assert not passes and "+2 more" in text and "x4" in text and "x5" not in text
