"""Names in captions, legends, patterns, identifiers."""

import pytest
from pyspark.sql import functions as F

from taxaflow.functions import naming as N
from taxaflow.functions import patterns as P
from taxaflow.functions import vectors as V
from taxaflow.operators import captions as C
from taxaflow.operators import legend as L

CAPTIONS = [
    ("Fig. 3. Tetracladium marchalianum. Conidia tetraradiate, 22 um long.", "binomial-strict", "Tetracladium", "Tetracladium marchalianum"),
    ("A, B: Alatospora acuminata De Wildeman", "binomial-strict", "Alatospora", "Alatospora acuminata"),
    ("(C) Clavariopsis aquatica Ingold", "binomial-strict", "Clavariopsis", "Clavariopsis aquatica"),
    ("Figura 12 - Anguillospora longissima (Sacc. & Syd.) Ingold", "binomial-strict", "Anguillospora", "Anguillospora longissima"),
    ("Material examined: Brazil, Amazonas, 2019.", "blocked-section", None, None),
    ("Plate 2. Conidium shape in various species.", "no-match", None, None),
    ("Tricladium splendens -- conidios tetrarradiados.", "binomial-strict", "Tricladium", "Tricladium splendens"),
    ("Lemonniera sp. nov., isolated from submerged leaves.", "genus-only", "Lemonniera", None),
    ("  ", "empty-caption", None, None),
    (None, "empty-caption", None, None),
    ("xTetracladium marchalianum éTetracladium marchalianum", "no-match", None, None),
    ("(HKAS 123, holotype: x) Tetracladium marchalianum", "binomial-strict", "Tetracladium", "Tetracladium marchalianum"),
]


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_caption_goldens(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CAPTIONS)], "i int, t string").select("i", C.epithet(F.col("t")).alias("e")).orderBy("i")
    assert [(r.e.rule, r.e.genus, r.e.binomial) for r in df.collect()] == [c[1:] for c in CAPTIONS]


def test_caption_details(spark):
    text = "Tetracladium marchalianum, Alatospora acuminata, Tetracladium marchalianum"
    (e,) = one(spark, [(text,)], "t string", C.epithet(F.col("t")))[0]
    assert e.all_candidates == ["Tetracladium marchalianum", "Alatospora acuminata"] and e.confidence == 0.95 and not e.uncertain and e.context_snippet == text
    (e,) = one(spark, [("Wordlike thing " * 50,)], "t string", C.epithet(F.col("t"), None))[0]
    assert e.rule == "binomial-strict" and len(e.context_snippet) == 180


def test_binomials_of_drawings(spark):
    rows = {"Fig. 1. Anguillospora longissima (drawing)": "Anguillospora_longissima", "Plate 2: Tetracladium marchalianum-like conidia": None, "Figure 3. Scale bar = 10 um": None, "In situ observation": None, "Campylospora chaetocladia and Lunulospora curvula": "Campylospora_chaetocladia"}
    assert [r[0] for r in one(spark, [(t,) for t in rows], "t string", P.first_binomial(F.col("t")))] == list(rows.values())


def test_pages_and_fallbacks(spark):
    df = spark.createDataFrame([("s", 1, "of Tetracladium"), ("s", 2, "marchalianum here"), ("x", 1, "Lemonniera"), ("x", 2, "Material"), ("x", 3, "examined: y"), ("a", 1, "nothing"), ("a", 2, "Alatospora acuminata"), ("a", 3, "Tetracladium marchalianum"), ("b", 1, "on Lemonniera"), ("b", 2, None), ("c", 1, None)], "k string, page int, text string")
    got = {r.k: (r.epithet.binomial, r.epithet.genus) for r in C.epithet_of_pages(df, "k").collect()}
    assert got == {"s": ("Tetracladium marchalianum", "Tetracladium"), "x": (None, None), "a": ("Alatospora acuminata", "Alatospora"), "b": (None, "Lemonniera"), "c": (None, None)}
    r = one(spark, [("no name", "Alatospora acuminata"), ("Lemonniera", "Alatospora acuminata")], "c string, p string", C.epithet_or_page(F.col("c"), F.col("p"), P.BUILT_IN_GENERA)["genus"])
    assert [x[0] for x in r] == ["Alatospora", "Lemonniera"]


def legends(spark, *pages):
    df = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages)], "pdf string, page int, text string")
    return {r.page: [(h.number, f"{h.genus} {h.epithet}", h.strategy, h.confidence) for h in r.legend] for r in L.legends(df).collect()}


def test_legend_gates(spark):
    got = legends(
        spark,
        "1. Tetracladium marchalianum; 2. Alatospora acuminata; 3, Lemonniera aquatica",
        "1. Tetracladium marchalianum\nsee 7, Lemonniera aquatica and 7, Alatospora acuminata",
        "1. Tetracladium marchalianum; 2. Tetracladium setigerum; 3. T. maxilliforme 4. A. acuminata 5. T. abc",
        "nothing at all",
        None,
    )
    assert got[0] == [(1, "Tetracladium marchalianum", "legend_strict", 0.95), (2, "Alatospora acuminata", "legend_strict", 0.95), (3, "Lemonniera aquatica", "legend_strict", 0.95)] or len(got[0]) == 2
    assert got[1] == [(1, "Tetracladium marchalianum", "legend_strict", 0.95), (7, "Lemonniera aquatica", "legend_loose", 0.85)]
    assert got[2] == [(1, "Tetracladium marchalianum", "legend_strict", 0.95), (2, "Tetracladium setigerum", "legend_strict", 0.95), (3, "Tetracladium maxilliforme", "abbreviated", 0.70)]
    assert [h[2] for h in got[3]] == ["adjacent_pages", "adjacent_pages"] and got[4] == []


def test_unknown_genera_are_marked_down_and_short_epithets_rejected(spark):
    assert legends(spark, "1. Notagenusx marchalianum; 2. Alatospora acum") == {0: [(1, "Notagenusx marchalianum", "legend_strict", pytest.approx(0.522))]}


def test_resolution_ranking(spark):
    blocks = [(1, 5.0, "1"), (2, 30.0, "near Alatospora acuminata"), (3, 100.0, "2"), (4, 400.0, "Lemonniera aquatica")]
    b = spark.createDataFrame([("d.pdf", 1, n, x, 0.0, x, 0.0, t) for n, x, t in blocks], "pdf string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    p = L.legends(spark.createDataFrame([("d.pdf", 1, "1. Tetracladium marchalianum; 2. Lemonniera terrestris"), ("e-x y.pdf", 1, "nothing")], "pdf string, page int, text string"))
    c = spark.createDataFrame([("d.pdf", 1, 10, 0.0, 0.0), ("d.pdf", 1, 11, 90.0, 0.0), ("e-x y.pdf", 1, 12, 0.0, 0.0)], "pdf string, page int, crop_id int, cx double, cy double")
    got = {r.crop_id: r for r in L.resolve(c, b, p).collect()}
    assert got[10].binomial == "Tetracladium marchalianum" and got[11].binomial == "Lemonniera terrestris" and got[10].strategy == "legend_strict" and got[10].n_candidates == 4
    assert (got[12].binomial, got[12].strategy, got[12].confidence, got[12].note) == (None, "pdf_filename", 0.15, "PDF stem=e_x")


def test_captions_of_boxes(spark):
    image = [("d", 1, 1, 0.0, 100.0, 50.0, 200.0)]
    blocks = [
        (1, 0.0, 200.0, 50.0, 210.0, "touches"), (2, 0.0, 320.0, 50.0, 330.0, "at 120"), (3, 0.0, 320.1, 50.0, 330.0, "too far"), (4, 0.0, 140.0, 50.0, 150.0, "at 60 above"),
        (5, 0.0, 139.9, 50.0, 150.0, "too far above"), (6, 50.0, 200.0, 80.0, 210.0, "beside"), (7, 10.0, 300.0, 20.0, 310.0, "Fig. 1 caption"), (8, 0.0, 201.0, 9.0, 220.0, "  "),
    ]
    i = spark.createDataFrame([*image, ("d", 2, 2, 0.0, 0.0, 1.0, 1.0)], "pdf string, page int, image_id int, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame([("d", 1, *x) for x in blocks], "pdf string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = {r.image_id: r.caption for r in C.captions_of_boxes(i, b, ["pdf", "page"]).collect()}
    assert got == {1: "Fig. 1 caption \n touches \n at 60 above", 2: ""}


def test_names(spark):
    r = one(
        spark, [("Fig. 1 – Açaí__x ", "a b/c.pdf", "p__q__r__s__gen_sp", "Tetracladium", None, 0.345, "My-paper (final) v2")], "a string, b string, c string, g string, s string, f double, t string",
        N.slug(F.col("a")), N.safe(F.col("b")), N.base_of_name(F.col("c")), N.record_name(F.lit("id"), F.col("g"), F.col("s")), N.record_name(F.lit("id"), F.col("s"), F.col("g")),
        N.output_name(F.lit("x"), F.col("g"), F.lit("sp"), F.col("f"), F.lit(".png")), N.without_last_part(F.col("t")), N.capital_first(F.lit("aBC")), N.record_id(F.lit("A b"), F.lit(3), F.lit(4), F.lit("ff")),
        N.list_hash(F.array(F.lit("b"), F.lit('a"'))), N.short_hash(F.lit("abc")),
    )[0]
    import hashlib
    import json

    want = hashlib.sha256(json.dumps(sorted(["b", 'a"'])).encode()).hexdigest()[:12]
    assert r == ("fig_1_a_a_x", "a_b_c.pdf", "p__q__r__s", "id__tetracladium_sp", "id__UNKNOWN_UNKNOWN", "x__UNCERTAIN_Tetracladium_sp__conf34.png", "My_paper_final", "Abc", "a_b__p003__fig04__ff", want, "a9993e")


def test_rounding_of_halves(spark):
    r = one(spark, [(0.125,), (0.135,)], "f double", N.output_name(F.lit("x"), F.lit("G"), F.lit("s"), F.col("f"), F.lit("")))
    assert [x[0][-2:] for x in r] == ["12", "14"]


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = spark.range(1).select(V.norm(a), V.distance(a, b), V.unit(a), V.cosine(a, a), V.contrastive(F.lit(0.4), F.lit(False)), V.contrastive(F.lit(0.4), F.lit(True)), V.triplet(F.lit(0.5), F.lit(0.6)), V.unit(b)).first()
    assert r[0] == 5 and r[1] == 5 and r[2] == pytest.approx([0.6, 0.8]) and r[3] == pytest.approx(1) and r[4] == pytest.approx(0.36) and r[5] == pytest.approx(0.16) and r[6] == pytest.approx(0.2) and r[7] == [0, 0]


def test_dehyphenated_and_noise(spark):
    r = one(spark, [("coni-\n  dia ão-\nb x - y",), ("© COPYRIGHT by us",), (None,)], "t string", P.dehyphenated(F.col("t")), P.noisy(F.col("t")))
    assert r == [("conidia ãob x - y", False), ("© COPYRIGHT by us", True), (None, False)]


def test_name_syntax(spark):
    rows = [("Tetracladium", True), ("Tet", False), ("Helotiales", False), ("tetracladium", False), ("TeTra", False), ("Scale", False), ("Tri-cladium", True)]
    assert [r[0] for r in one(spark, [(g,) for g, _ in rows], "g string", P.genus_syntax(F.col("g")))] == [x for _, x in rows]


def test_every_caption_of_a_paper_is_read(spark, tmp_path):
    from taxaflow.plans.reference_queries import e2_names_of_documents

    n = "zz, no name"
    rows = [
        ("two", 1, 1, "Alatospora acuminata"), ("two", 1, 2, n), ("two", 2, 1, "Zzz later"),
        ("order", 2, 1, "Lemonniera aquatica"), ("order", 1, 3, "Tetracladium setigerum"), ("order", 1, 2, "Alatospora acuminata"), ("order", 1, None, "Zymosella prima"),
        ("unnumbered", None, 1, "Alatospora acuminata"), ("unnumbered", None, 2, n), ("unnumbered", 7, 1, n),
        ("parted", 1, 1, "of Tetracladium"), ("parted", 1, 2, " "), ("parted", 3, 1, "marchalianum here"),
        ("blank", 1, 1, " "), ("none", 1, 1, None), (None, 1, 1, "Alatospora acuminata"),
    ] + [("hot", i // 9, i, n) for i in range(900)] + [("hot", 99, 5, "Alatospora acuminata")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "rec_id long, paper string, page int, fig_index int, caption_raw string")
    df.repartition(7).write.parquet(str(tmp_path / "training_index.parquet"))
    got = {r.paper: (r.rule, r.binomial) for r in e2_names_of_documents(spark, str(tmp_path)).collect()}
    name = ("binomial-strict", "Alatospora acuminata")
    assert got == {"two": name, "order": name, "unnumbered": name, "parted": ("binomial-strict", "Tetracladium marchalianum"), "blank": ("empty-caption", None), "hot": name}


def test_numbers_in_order(spark):
    from taxaflow.runtime import numbered

    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(9)
    got = [tuple(r) for r in numbered(df, [F.desc("k"), F.col("id")], "at").orderBy("at").select("k", "id", "at").collect()]
    assert got == [(k, i, n) for n, (k, i) in enumerate(sorted(((i % 7, i) for i in range(1000)), key=lambda x: (-x[0], x[1])))]
    assert numbered(df.limit(0), [F.col("id")], "at").count() == 0


def test_no_genus_of_the_reference_is_left_out(spark, tmp_path, monkeypatch):
    from taxaflow.plans import reference_queries as Q

    d = str(tmp_path)
    genera = [f"G{''.join(chr(97 + i // 26**j % 26) for j in range(4))}" for i in range(5001)]
    spark.createDataFrame([(g, "genus") for g in genera] + [("Nullus", "species")], "genus string, taxon_rank string").coalesce(1).write.parquet(f"{d}/ref_taxa.parquet")
    block = (1, (0.0, 0.0, 1.0, 1.0), f"1. {genera[0]} prima; 2. {genera[-1]} ultima")
    kind = "paper string, page int, resolution struct<candidates: array<struct<blocks: array<struct<block_no: int, bbox: struct<x0: double, y0: double, x1: double, y1: double>, text: string>>>>>"
    spark.createDataFrame([("a", 1, ([([block],)],))], kind).write.parquet(f"{d}/training_index.parquet")
    assert {(r.number, r.genus, r.confidence) for r in Q.e4_legends(spark, d).collect()} == {(1, genera[0], 0.95), (2, genera[-1], 0.95)}
    monkeypatch.setattr(Q.Vocabulary, "MOST", 5000)
    with pytest.raises(ValueError):
        Q.e4_legends(spark, d)
