"""Rules, labels, files, similarity, splits."""

from pyspark.sql import functions as F

from taxaflow.operators import pipelines, records, similarity

FEATURES = "image_id int, sat_mean double, white_bg_ratio double, edge_density double, hist_entropy double, blue_dominance double"


def test_each_rule_and_each_threshold(spark):
    rows = [
        ("R1", 27, 0.56, 0.031, 0, 0), ("R2", 0, 0.1, 0.1, 0, 0.19), ("R2", 55.1, 0.1, 0.1, 0, 0), ("R3", 30, 0.71, 0.021, 0, 0), ("R4", 14.9, 0.5, 0.009, 0, 0), ("R5", 20, 0.61, 0.016, 0, 0),
        ("R6", 20, 0.29, 0.024, 0, 0), ("R7", 20, 0.44, 0.03, 3.9, 0), ("R8", 2.9, 0.39, 0.026, 0, 0), ("R9", 2.9, 0.40, 0.021, 0, 0), ("R10", 16, 0.76, 0.009, 0, 0), ("R11", 20, 0.5, 0.03, 0, 0),
        ("R11", 28, 0.55, 0.030, 3.8, 0.18), ("R11", 55, 0.5, 0.03, 0, 0.18),
    ]
    df = spark.createDataFrame([(i, *map(float, r[1:])) for i, r in enumerate(rows)], FEATURES)
    assert [r.rule for r in records.classified(df).orderBy("image_id").collect()] == [r[0] for r in rows]
    none = records.classified(spark.createDataFrame([(1, None, None, None, None, None)], FEATURES)).first()
    assert (none.rule, none.image_type, none.confidence) == ("R11", "AMBIGUOUS", 0.4)


def test_overrides_and_relabelling(spark):
    df = spark.createDataFrame(
        [(1, "AMBIGUOUS", "Maximum likelihood tree", "a/ambiguous/x.png"), (2, "AMBIGUOUS", "Conidia in foam", "a/ambiguous/y.png"), (3, "AMBIGUOUS", None, "z.png"), (4, "DRAWING", "Conidia", "q"), (5, "AMBIGUOUS", "All rights reserved; conidia", "a/ambiguous/n.png"), (6, "AMBIGUOUS", "microscopic view", "a/b/c.png")],
        "rec_id int, image_type string, caption_raw string, saved_to string",
    ).withColumn("image_type_raw", F.col("image_type"))
    out, counts = pipelines.relabel(df)
    got = {r.rec_id: (r.image_type, r.image_type_raw, r.saved_to) for r in out.collect()}
    assert got[1] == ("DRAWING", "DRAWING", "a/drawing/x.png") and got[2][0] == "MICROSCOPY" and got[4] == ("DRAWING", "DRAWING", "q")
    assert got[5] == ("AMBIGUOUS", "NOISE", "a/ambiguous/noise/n.png") and got[6][0] == "AMBIGUOUS" and got[3][0] == "AMBIGUOUS"
    assert {(r.new_raw, r.n) for r in counts.collect()} == {("DRAWING", 1), ("MICROSCOPY", 1), ("NOISE", 1), ("AMBIGUOUS", 2)}


def test_labels_of_files(spark):
    rows = [
        ("p1", "treino_desenho", "a__p001__fig01__ff__x.png", '{"resolution": {"binomial": "alatospora_ACUMINATA", "confidence": 0.8}}'),
        ("p2", "treino_lamina", "a.png", '{"resolution": {"binomial": "UNKNOWN sp"}, "epithet": {"genus": "TETRACLADIUM", "species": ""}}'),
        ("p3", "ambiguo", "b__p1__f1__h__lemonniera_aquatica.png", None),
        ("p4", "x", "b__p1__f1__h__lemonniera_sp.png", "not json"),
        ("p5", "x", "b__unknown_unknown.png", "{}"),
        ("p6", "x", "b__sp_aquatica.png", None),
    ]
    df = spark.createDataFrame(rows, "path string, folder string, name string, sidecar string")
    got = {r.path: (r.genus, r.species, r.source_kind, r.label_confidence) for r in records.labels_of_files(df).collect()}
    assert got == {"p1": ("Alatospora", "acuminata", "drawing", 0.8), "p2": ("Tetracladium", None, "microscopy", 1.0), "p3": ("Lemonniera", "aquatica", "ambiguous", 1.0), "p4": ("Lemonniera", None, "unknown", 1.0)}


def test_votes(spark):
    labels = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.5), (3, "b", 1.0), (4, "c", 1.0)], "id long, c string, label_confidence double")
    found = spark.createDataFrame([(9, 1, 0.2), (9, 2, 0.6), (9, 3, 0.5), (9, 4, -0.9), (8, 4, -0.5), (8, 3, -0.2)], "query_id long, id long, sim double")
    got = {(r.query_id, r.place): (r.c, round(r.share, 6)) for r in similarity.votes(found, labels, ["c"]).collect()}
    assert got == {(9, 1): ("a", 0.5), (9, 2): ("b", 0.5), (9, 3): ("c", 0.0), (8, 1): ("b", 0.0), (8, 2): ("c", 0.0)}
    p = {r.query_id: r for r in similarity.predictions(similarity.votes(found, labels, ["c"]), "c").collect()}
    assert p[9].best == "a" and not p[9].uncertain and p[8].uncertain


def test_neighbours_are_exact(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(similarity, "BLOCK", 3)
    rng = np.random.default_rng(0)
    v = rng.integers(-2, 3, (60, 5)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>").repartition(5)
    q = df.filter("id % 7 = 0").withColumnRenamed("id", "query_id")
    got = {(r.query_id, r["rank"]): r.id for r in similarity.neighbours(q, df, 4).collect()}
    want = {}
    for i in range(0, 60, 7):
        order = sorted((j for j in range(60) if j != i), key=lambda j: (-(v[i] @ v[j]), j))
        want |= {(i, k + 1): j for k, j in enumerate(order[:4])}
    assert got == want
    assert similarity.neighbours(q.limit(0), df).count() == 0
    assert similarity.neighbours(q, df.filter("id = 7")).filter("query_id = 7").count() == 0


def test_caps_nest_and_order_does_not_matter(spark):
    df = spark.createDataFrame([(i, i % 3, (i * 7) % 5 / 5) for i in range(60)], "id int, c int, conf double")
    cap = lambda d, n: {r.id for r in similarity.capped(d, ["c"], [F.desc("conf"), F.col("id")], n).collect()}
    assert cap(df, 3) < cap(df, 4) and cap(df, 3) == cap(df.repartition(7), 3) and len(cap(df, 3)) == 9


def test_scores_and_reports(spark):
    df = spark.createDataFrame([("p", "a", "a"), ("p", "a", "b"), ("q", "b", "b"), ("q", "c", "b")], "point string, t string, g string")
    got = {r.label: (r.precision, r.recall, r.support) for r in similarity.scores(df, "t", "g").collect()}
    assert got["a"] == (1.0, 0.5, 2) and got["b"] == (1 / 3, 1.0, 1) and got["c"] == (0.0, 0.0, 1)
    text = similarity.markdown(similarity.rollup_counts(df, "point", "t").collect(), "point", "t")
    assert text.startswith("## p (2)\n\n- a: 2\n\n## q (2)\n")
    assert {(r.point, r.t): r.n for r in pipelines.accuracy(df, "point", "t", "g").collect()}[(None, None)] == 4


def test_hash_split_is_stable(spark):
    a = {r.id: r.split for r in pipelines.hash_split(spark.range(4000), "id").collect()}
    b = {r.id: r.split for r in pipelines.hash_split(spark.range(2000), "id").collect()}
    assert all(a[k] == v for k, v in b.items())
    assert abs(sum(v == "train" for v in a.values()) / 4000 - 0.7) < 0.03


def test_oversampling(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 50, "c string")
    got = {r.c: r.n for r in similarity.oversampled(df, "c").groupBy("c").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 21, "b": 50}


def test_export_round_trip(spark, tmp_path):
    flat = spark.createDataFrame([(1, "i1", "p", "DRAWING", "DRAWING", "s", "c" * 400, "A b", "A", "b", 0.5), (2, "i2", "p", "DRAWING", None, "s", "", None, "A", None, 0.0)], "rec_id long, id string, paper string, image_type string, image_type_raw string, saved_to string, caption_raw string, binomial string, genus string, species string, epithet_confidence double")
    out = records.exported(flat)
    rows = {r.id: r for r in records.export_rows(out, "TrainingImage").collect()}
    assert len(rows["i1"].captionRaw) == 300 and rows["i2"].binomial == "" and rows["i2"].imageTypeRaw == ""
    assert [r.name for r in records.export_rows(out, "Genero").collect()] == ["A"] and [r.generoNome for r in records.export_rows(out, "Especie").collect()] == ["A"]
    assert len(records.export_tables("x.")) == 3


def test_embedding_leaves_out_what_fails(spark):
    df = spark.createDataFrame([(1, 1, 2, 1, bytearray([3, 4])), (2, 1, 2, 1, bytearray([0, 0])), (3, 9, 9, 1, bytearray([1]))], "image_id long, height int, width int, channels int, data binary")
    got = similarity.embedded(df, lambda: lambda a: a.ravel()).collect()
    assert [(r.image_id, [round(x, 6) for x in r.vector]) for r in got] == [(1, [0.6, 0.8])]


def test_repeated_query_ids_in_several_blocks(spark, monkeypatch):
    """Rows of one query id are never lost, however the blocks fall."""
    monkeypatch.setattr(similarity, "BLOCK", 2)
    index = spark.createDataFrame([(i, [float(i == j) for j in range(6)]) for i in range(6)], "id long, vector array<double>")
    queries = spark.createDataFrame([(100 + i // 2, [float(i == j) for j in range(6)]) for i in range(6)] + [(100, [1.0] + [0.0] * 5), (None, [1.0] * 6), (7, None)], "query_id long, vector array<double>")
    got = {(r.query_id, r.id) for r in similarity.neighbours(queries, index, 2).filter("sim = 1").collect()}
    assert got == {(100 + i // 2, i) for i in range(6)}
    assert similarity.neighbours(queries.limit(0), index).count() == 0


def test_named_predictions(spark):
    ranked = spark.createDataFrame([(1, "Tetracladium", "marchalianum", 0.6, 1), (1, "Lemonniera", "aquatica", 0.4, 2), (2, "Alatospora", "sp", 0.345, 1)], "query_id long, genus string, species string, share double, place int")
    targets = spark.createDataFrame([(1, "river one/a b.PNG"), (2, "c.jpg"), (3, "x/y/d")], "query_id long, path string")
    got = {r.target_path: r for r in similarity.named_predictions(ranked, targets).collect()}
    a, c, d = got["river one/a b.PNG"], got["c.jpg"], got["x/y/d"]
    assert a.asDict().keys() == {"sampling_point", "target_path", "best_genus", "best_species", "confidence", "top3_json", "output_path"}
    assert (a.sampling_point, a.confidence, a.output_path) == ("river one", "0.6000", "river_one/a_b__Tetracladium_marchalianum__conf60.png")
    assert (c.sampling_point, c.output_path) == ("RAIZ", "RAIZ/c__UNCERTAIN_Alatospora_sp__conf34.jpg")
    assert (d.best_genus, d.top3_json, d.output_path) == ("UNKNOWN", "[]", "x/d__UNCERTAIN_UNKNOWN__conf00")


def test_few_shot(spark):
    index = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0], i % 2) for i in range(1, 9)], "id long, vector array<double>, label int")
    got = {r.shots: (r.queries, r.hits) for r in similarity.few_shot(index.selectExpr("id AS query_id", "vector"), index.select("id", "vector"), index.select("id", "label"), (1, 3)).collect()}
    assert got[3] == (8, 8) and got[1][0] == 8
