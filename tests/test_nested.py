import json

from pyspark.sql import types as T

from taxaflow.operators import nested

SCHEMA = """k long, other string, s struct<a: string, n: double, deep: struct<x: int, y: int>, tags: array<string>,
 items: array<struct<v: string, box: struct<p: double, q: double>, parts: array<struct<w: int>>>>>"""


def rows(spark, *records):
    return spark.read.schema(SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))


def found(df):
    return {(r.k, r.child, tuple(r.ordinals)) for r in nested.bridge(df, "k", ["s"]).collect()}


def test_objects_that_hold_nothing_have_no_rows(spark):
    df = rows(
        spark,
        {"k": 1, "s": None},
        {"k": 2, "s": {}},
        {"k": 3, "s": {"deep": {"x": None}, "tags": [None], "items": [None, {}, {"parts": []}, {"parts": [None, {}]}]}},
        {"k": 4, "s": {"tags": [], "items": []}},
    )
    assert found(df) == set()


def test_positions_count_empty_elements(spark):
    df = rows(spark, {"k": 1, "s": {"items": [None, {"parts": [{}, None, {"w": 0}]}, {"box": {"p": 1.5}}]}})
    assert found(df) == {(1, "s", ()), (1, "s.items[]", (2,)), (1, "s.items[].parts[]", (2, 3)), (1, "s.items[]", (3,))}


def test_an_empty_string_is_a_value(spark):
    assert found(rows(spark, {"k": 1, "s": {"a": ""}})) == {(1, "s", ())}


def test_equal_objects_are_stored_once_and_linked(spark):
    one = {"a": "x", "items": [{"v": "u", "parts": [{"w": 1}, {"w": 1}]}]}
    df = rows(spark, {"k": 1, "s": one}, {"k": 2, "s": one}, {"k": 2, "s": one})
    objects = {r.children[0]: (r.places) for r in nested.objects(df, "k", ["s"]).collect()}
    assert objects == {"s": 3, "s.items[]": 3, "s.items[].parts[]": 6}
    b = nested.bridge(df, "k", ["s"]).collect()
    ids = {r.child: r.node for r in b}
    assert all(r.parent == {"s": None, "s.items[]": ids["s"], "s.items[].parts[]": ids["s.items[]"]}[r.child] for r in b)


def test_order_and_place_of_values_matter(spark):
    df = rows(spark, {"k": 1, "s": {"items": [{"v": "a"}, {"v": "b"}]}}, {"k": 2, "s": {"items": [{"v": "b"}, {"v": "a"}]}}, {"k": 3, "s": {"items": [{"v": "a"}, None, {"v": "b"}]}})
    tops = {r.node for r in nested.bridge(df, "k", ["s"]).filter("child = 's'").collect()}
    assert len(tops) == 3


def test_empty_table_clashing_columns_and_long_texts(spark):
    assert found(rows(spark)) == set()
    df = rows(spark, {"k": None, "s": {"a": "y" * 100_000}}).withColumnRenamed("other", "node")
    assert [(r.k, r.child) for r in nested.bridge(df, "k", ["s"]).collect()] == [(None, "s")]


def test_round_trip_of_leaves(spark):
    df = rows(spark, {"k": 7, "s": {"a": "x", "n": 2.5, "items": [{"v": "p"}, {"v": "q", "parts": [{"w": 3}]}]}})
    content = {r.child: json.loads(r.content) for r in nested.occurrences(df, "k", ["s"]).collect()}
    assert content["s"]["a:string"] == "x" and content["s"]["n:float"] == "2.5" and content["s.items[].parts[]"] == {"w:int": "3"}


def test_map_columns(spark):
    t = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StructType([T.StructField("m", T.MapType(T.StringType(), T.IntegerType()))]))])
    df = spark.createDataFrame([(1, ({"b": 1, "a": 2},)), (2, ({"a": 2, "b": 1},)), (3, (None,))], t)
    got = {r.k: r.node for r in nested.bridge(df, "k", ["s"]).collect()}
    assert set(got) == {1, 2} and got[1] == got[2]


def nodes(spark, schema, *records):
    df = spark.read.schema(f"k long, s struct<{schema}>").json(spark.sparkContext.parallelize([json.dumps({"k": i, "s": r}) for i, r in enumerate(records)]))
    return [r.node for r in nested.bridge(df, "k", ["s"]).orderBy("k").collect()]


def test_identity_is_by_name_and_type_not_by_position(spark):
    (one,) = nodes(spark, "a string, b string", {"a": "x", "b": "y"})
    assert nodes(spark, "b string, a string", {"a": "x", "b": "y"}) == [one]
    assert nodes(spark, "z int, a string, b string, more struct<q: int>", {"a": "x", "b": "y"}) == [one]
    assert nodes(spark, "a string, q string", {"a": "x", "q": "y"}) != [one]
    assert nodes(spark, "a int", {"a": 1}) == nodes(spark, "a long", {"a": 1}) != nodes(spark, "a string", {"a": "1"})


def test_an_object_at_two_levels_is_stored_once(spark):
    t = "k long, s struct<one: array<struct<v: string>>, two: array<struct<v: string>>>"
    df = spark.read.schema(t).json(spark.sparkContext.parallelize([json.dumps({"k": 1, "s": {"one": [{"v": "a"}], "two": [{"v": "a"}, {"v": "b"}]}})]))
    got = {tuple(r.children): r.places for r in nested.objects(df, "k", ["s"]).collect()}
    assert got == {("s",): 1, ("s.one[]", "s.two[]"): 2, ("s.two[]",): 1}


def test_flat_tables_keep_types_keys_and_links(spark):
    df = rows(
        spark,
        {"k": 1, "s": {"a": "x", "deep": {"y": 3}, "tags": ["t", None], "items": [None, {"v": "p", "box": {"p": 1.5}}, {"parts": [{}, {"w": 7}]}]}},
        {"k": 2, "s": {"items": []}},
        {"k": 3},
    )
    top = nested.flat_table(df, "k", "s", identities=True)
    assert dict(top.dtypes) == {"k": "bigint", "node": "string", "parent": "string", "a": "string", "n": "double", "deep_x": "int", "deep_y": "int", "tags": "array<string>"}
    assert [(r.k, r.a, r.deep_y, r.tags, r.parent) for r in top.collect()] == [(1, "x", 3, ["t", None], None)]
    items = nested.flat_table(df, "k", "s.items[]", identities=True).collect()
    assert [(r.k, r.items_pos, r.v, r.box_p) for r in items] == [(1, 2, "p", 1.5), (1, 3, None, None)]
    parts = nested.flat_table(df, "k", "s.items[].parts[]", identities=True).collect()
    assert [(r.k, r.items_pos, r.parts_pos, r.w) for r in parts] == [(1, 3, 2, 7)]
    links = {(r.child, tuple(r.ordinals)): (r.node, r.parent) for r in nested.bridge(df, "k", ["s"]).collect()}
    for name, table in (("s", top.collect()), ("s.items[]", items), ("s.items[].parts[]", parts)):
        for r in table:
            at = tuple(r[c] for c in ("items_pos", "parts_pos") if c in r.asDict())
            assert links[name, at] == (r.node, r.parent)
    assert nested.flat_table(df.limit(0), "k", "s.items[]").count() == 0


def test_flat_table_with_clashing_names(spark):
    df = spark.createDataFrame([(1, ([(5, 6)],))], "k long, s struct<items: array<struct<k: int, items_pos: int>>>")
    assert [r.asDict() for r in nested.flat_table(df, "k", "s.items[]").collect()] == [{"k": 1, "items_pos": 1, "k_": 5, "items_pos_": 6}]
