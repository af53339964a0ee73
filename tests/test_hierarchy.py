from datetime import datetime

from taxaflow.operators import hierarchy as H

EDGES = "edge_id long, type string, start_node_id string, end_node_id string, loaded_at timestamp, node_id string, depth int"
T1, T2 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def edges(spark, *rows):
    """Extra columns have names that the operator itself uses."""
    return spark.createDataFrame([(*r, "clash", 99) for r in rows], EDGES)


def solved(df):
    links = H.parent_links(df)
    h = H.hierarchy(links)
    return links, h, {r.node_id: (r.root_id, r.depth) for r in h.collect()}


def test_links_spelling_blank_ids_and_replacement(spark):
    df = edges(
        spark,
        (1, " belongs_to_x ", "b", "a", T1),
        (2, "BELONGS_TO_X", "b", "c", T2),
        (3, "BELONGS_TO_Y", "b", "d", T2),
        (4, "BELONGS_TO_Y", "b", "e", None),
        (5, "HAS", "q", "a", T1),
        (6, "BELONGS_TO_X", " ", "a", T1),
        (7, "BELONGS_TO_X", "z", None, T1),
        (8, None, "y", "a", T1),
        (3, "BELONGS_TO_Y", "b", "d", T2),
    )
    _, _, got = solved(df)
    # the parents of links that were replaced stand on links too
    assert got == {"b": ("d", 1), **{x: (x, 0) for x in "acde"}}


def test_a_replaced_parent_may_have_a_parent_itself(spark):
    df = edges(spark, (1, "BELONGS_TO_X", "b", "a", T1), (2, "BELONGS_TO_X", "b", "c", T2), (3, "BELONGS_TO_X", "a", "c", T1), (4, "BELONGS_TO_X", "c", "b", None))
    assert solved(df)[2] == {x: ("", -1) for x in "abc"}


def test_cycles_and_what_leads_into_them(spark):
    df = edges(spark, (1, "BELONGS_TO_A", "a", "b", T1), (2, "BELONGS_TO_A", "b", "c", T1), (3, "BELONGS_TO_A", "c", "a", T1), (4, "BELONGS_TO_A", "t", "a", T1), (5, "BELONGS_TO_A", "u", "t", T1), (6, "BELONGS_TO_A", "s", "s", T1), (7, "BELONGS_TO_A", "k", "r", T1))
    links, h, got = solved(df)
    assert got == {**{x: ("", -1) for x in "abctus"}, "k": ("r", 1), "r": ("r", 0)}
    assert {(r.cycle_id, r.node_id) for r in H.cycles(links, h).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("s", "s")}


def test_a_long_cycle_has_one_name(spark):
    df = edges(spark, *[(i, "BELONGS_TO_A", f"n{i:02d}", f"n{(i + 1) % 37:02d}", T1) for i in range(37)])
    links, h, _ = solved(df)
    got = H.cycles(links, h).collect()
    assert len(got) == 37 and {r.cycle_id for r in got} == {"n00"}


def test_deep_chain_paths_and_descendants(spark):
    df = edges(spark, *[(i, "BELONGS_TO_A", f"n{i + 1:02d}", f"n{i:02d}", T1) for i in range(30)])
    _, h, got = solved(df)
    assert got["n30"] == ("n00", 30)
    d = H.descendants(h).collect()
    assert len(d) == 30 * 31 // 2
    assert {(r.node_id, r.distance) for r in d if r.ancestor_id == "n27"} == {("n28", 1), ("n29", 2), ("n30", 3)}


def test_empty(spark):
    links, h, got = solved(edges(spark))
    assert got == {} and H.cycles(links, h).count() == 0
