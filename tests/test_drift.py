import json

from taxaflow.operators import drift as D

RAW = "raw_id long, series string, file_name string, file_seq int, line_no int, record_json string, path string, change string"


def raw(spark, *files):
    """files: (series, seq, [records or lines])."""
    rows, n = [], 0
    for s, q, lines in files:
        for i, r in enumerate(lines):
            n += 1
            rows.append((n, s, f"{s}{q}", q, i, r if r is None or isinstance(r, str) else json.dumps(r), "clash", "clash"))
    return spark.createDataFrame(rows, RAW)


def got(df):
    return sorted(tuple(r) for r in D.changes(df).collect())


def test_renamed_needs_equal_values(spark):
    a = [{"id": "1", "x": {"old": 5, "gone": "q"}}, {"id": "2", "x": {"old": 6, "gone": "w"}}]
    b = [{"id": "1", "x": {"new": 5.0, "come": "z"}}, {"id": "3", "x": {"new": 1}}]
    assert got(raw(spark, ("s", 1, a), ("s", 2, b))) == [("s2", "", "x.come", "added"), ("s2", "x.gone", "", "removed"), ("s2", "x.old", "x.new", "renamed")]


def test_without_a_common_id_nothing_is_renamed(spark):
    assert got(raw(spark, ("s", 1, [{"id": "1", "a": 1}]), ("s", 2, [{"id": "2", "b": 1}]))) == [("s2", "", "b", "added"), ("s2", "a", "", "removed")]


def test_without_a_common_id_the_scores_decide(spark):
    a = [{"id": "1", "epithet": {"confidence": 0.5, "rule": "x"}, "n": 1}]
    b = [{"id": "2", "epithet": {"confidence_score": 0.7, "rule": "y"}, "zz": "t"}]
    assert got(raw(spark, ("s", 1, a), ("s", 2, b))) == [("s2", "", "zz", "added"), ("s2", "epithet.confidence", "epithet.confidence_score", "renamed"), ("s2", "n", "", "removed")]
    # values that differ outweigh the scores
    b[0]["id"] = "1"
    assert ("s2", "epithet.confidence", "", "removed") in got(raw(spark, ("s", 1, a), ("s", 2, b)))


def test_scores_decide_between_equal_values(spark):
    a = [{"id": "1", "conf": 1, "score": 1}]
    b = [{"id": "1", "score_value": 1}]
    assert got(raw(spark, ("s", 1, a), ("s", 2, b))) == [("s2", "conf", "", "removed"), ("s2", "score", "score_value", "renamed")]


def test_a_null_member_is_not_an_absent_one(spark):
    a = [{"id": "1", "o": {"p": 1, "q": None}}]
    assert got(raw(spark, ("s", 1, a), ("s", 2, [{"id": "1", "n": {"p": 1}}]))) == [("s2", "", "n", "added"), ("s2", "o", "", "removed")]
    assert got(raw(spark, ("s", 1, a), ("s", 2, [{"id": "1", "n": {"q": None, "p": 1.0}}]))) == [("s2", "o", "n", "renamed")]


def test_a_file_name_in_two_series(spark):
    rows = [(i, s, "f.jsonl" if q == 2 else f"{s}{q}", q, 0, json.dumps(r), "", "") for i, (s, q, r) in enumerate([("s", 1, {"id": "1", "a": 1}), ("s", 2, {"id": "1", "b": 1}), ("t", 1, {"id": "1", "a": 2}), ("t", 2, {"id": "1", "a": 2})])]
    df = spark.createDataFrame(rows, RAW)
    assert got(df) == [("f.jsonl", "a", "b", "renamed")]
    assert sorted((r.series, r.record.a) for r in D.unify(df).collect()) == [("s", 1), ("s", 1), ("t", 2), ("t", 2)]


def test_nothing_below_a_reported_path(spark):
    a = [{"id": "1", "o": {"p": 1, "q": [{"r": 1}]}, "t": {"u": 1}}]
    b = [{"id": "1", "n": {"p": 1, "q": [{"r": 1}]}, "t": "text"}]
    assert got(raw(spark, ("s", 1, a), ("s", 2, b))) == [("s2", "o", "n", "renamed"), ("s2", "t", "t", "retyped")]


def test_arrays(spark):
    a = [{"id": "1", "l": [{"m": "a"}, None, {"m": "b"}], "k": []}]
    b = [{"id": "1", "l": [{"n": "a"}, {"n": "b"}], "k": [1]}]
    c = [{"id": "1", "l": ["a"], "k": [1]}]
    assert got(raw(spark, ("s", 1, a), ("s", 2, b), ("s", 3, c))) == [("s2", "l[].m", "l[].n", "renamed"), ("s3", "l[]", "l[]", "retyped")]


def test_nulls_unreadable_lines_and_several_series(spark):
    lines = [None, "", "  ", "[1]", "3", '{"id": "1", "a"', {"id": "1", "a": None, "b": True}]
    df = raw(spark, ("s", 1, lines), ("s", 4, [{"id": "1", "b": 1}]), ("t", 2, [{"id": "1", "z": 1}]), ("t", 9, ["", "{"]))
    assert got(df) == [("s4", "b", "b", "retyped"), ("t9", "id", "", "removed"), ("t9", "z", "", "removed")]


def test_ties_take_each_path_once(spark):
    a = [{"id": "1", "conf": 1, "score": 1}]
    b = [{"id": "1", "confidence": 1, "score_value": 1}]
    assert got(raw(spark, ("s", 1, a), ("s", 2, b))) == [("s2", "conf", "confidence", "renamed"), ("s2", "score", "score_value", "renamed")]


def test_empty_and_repeated_rows(spark):
    assert got(raw(spark)) == []
    f = ("s", 1, [{"id": "1", "a": 1}])
    assert got(raw(spark, f).union(raw(spark, f))) == []


def test_flooding_prefers_names_and_structure():
    old = {"a": 8, "a.conf": 2, "a.rule": 1, "b": 8, "b.conf": 2}
    new = {"a": 8, "a.confidence": 2, "a.regra": 1, "b": 8, "b.conf": 2}
    s = D.flood(old, new)
    assert s.at["a.conf", "a.confidence"] > s.at["a.conf", "a.regra"]
    assert s.at["a.conf", "a.confidence"] > s.at["a.conf", "b"]
    assert D.flood({}, new).empty


def test_one_table(spark):
    a = [{"id": "1", "x": {"old": 5}}]
    b = [{"id": "1", "x": {"new": 5}}, {"id": "2", "x": {"new": 7}}]
    c = [{"id": "2", "y": {"new": 7}}, {"id": "4", "y": {"new": "seven"}}]
    df = raw(spark, ("s", 1, a), ("s", 2, b), ("s", 3, c))
    u = D.unify(df, None, "x struct<old: int>")
    assert sorted((r.file_name, r.id, r.record.x.old) for r in u.collect()) == [("s1", "1", 5), ("s2", "1", 5), ("s2", "2", 7), ("s3", "2", 7), ("s3", "4", None)]


def table(spark, *files):
    df = raw(spark, *files)
    return D.unify(df).orderBy("raw_id")


def test_retyped_values_are_cast(spark):
    a = [{"id": "1", "page": 95853, "version": "4.2", "c": {"confidence": 0.5, "width": 7}, "u": True, "mixed": 1}]
    b = [{"id": "2", "page": "95853", "version": 3.0, "c": {"confidence": "0.07214", "width": "1352"}, "u": "false", "mixed": "one"}]
    b += [{"id": "3", "page": "4", "version": 3.1, "c": {"confidence": "1e-3", "width": "8"}, "u": 1, "mixed": "two"}]
    u = table(spark, ("s", 1, a), ("s", 2, b))
    t = "struct<c:struct<confidence:double,width:bigint>,id:string,mixed:string,page:bigint,u:boolean,version:string>"
    assert dict(u.dtypes)["record"] == t
    assert [(r.record.page, r.record.c.confidence, r.record.c.width, r.record.u, r.record.version, r.record.mixed) for r in u.collect()] == [
        (95853, 0.5, 7, True, "4.2", "1"), (95853, 0.07214, 1352, False, "3.0", "one"), (4, 0.001, 8, True, "3.1", "two"),
    ]
    df = raw(spark, ("s", 1, a), ("s", 2, b))
    given = D.unify(df, None, "page int, c struct<confidence: double, width: int>, mixed int").orderBy("raw_id").collect()
    assert [(r.record.page, r.record.c.confidence, r.record.c.width, r.record.mixed) for r in given] == [(95853, 0.5, 7, 1), (95853, 0.07214, 1352, None), (4, 0.001, 8, None)]


def test_objects_held_as_text_single_objects_and_joined_lists(spark):
    e = {"genus": "Q", "names": ["A b", "C d"], "cand": [{"dist": 1.5}, None, {"dist": 2}]}
    text = {"id": "2", "e": json.dumps(e)}
    single = {"id": "3", "e": {"genus": "Q", "names": "A b; C d", "cand": {"dist": "2.5", "extra": True}}}
    inner = {"id": "4", "e": {"genus": "Q", "names": "A b", "cand": json.dumps(e["cand"])}}
    bad = {"id": "5", "e": "no object"}
    u = table(spark, ("s", 1, [{"id": "1", "e": e}]), ("s", 2, [text]), ("s", 3, [single]), ("t", 1, [inner]), ("u", 1, [bad]))
    assert dict(u.dtypes)["record"] == "struct<e:struct<cand:array<struct<dist:double,extra:boolean>>,genus:string,names:array<string>>,id:string>"
    got = [(r.record.e and r.record.e.asDict(True), json.loads(r.rest)["e"]) for r in u.collect()]
    whole = {"cand": [{"dist": 1.5, "extra": None}, None, {"dist": 2.0, "extra": None}], "genus": "Q", "names": ["A b", "C d"]}
    assert [g[0] for g in got] == [whole, whole, whole | {"cand": [{"dist": 2.5, "extra": True}]}, whole | {"names": ["A b"]}, None]
    assert got[4][1] == "no object"


def test_names_hold_through_wrapping_and_case(spark):
    a = [{"id": "1", "l": [{"rule": "x"}], "v": 1}]
    b = [{"id": "1", "l": [{"regra": "x"}], "v": 1}]
    c = [{"id": "1", "l": {"regra": "x"}, "V": 1}, {"id": "2", "l": {"regra": "y"}, "V": "2"}]
    u = table(spark, ("s", 1, a), ("s", 2, b), ("s", 3, c), ("t", 1, [{"id": "9", "L": [], "V": 5}]))
    assert dict(u.dtypes)["record"] == "struct<id:string,l:array<struct<rule:string>>,v:bigint>"
    assert [([x.rule for x in r.record.l], r.record.v) for r in u.collect()] == [(["x"], 1), (["x"], 1), (["x"], 1), (["y"], 2), ([], 5)]


def test_one_table_of_nothing(spark):
    assert table(spark, ("s", 1, ["", "{"])).count() == 0
