"""Readers, sinks and streams over files made here."""

import json
import sqlite3

import numpy as np
from pyspark.sql import functions as F

from taxaflow import sinks
from taxaflow.config import Settings
from taxaflow.operators import orphans
from taxaflow.sources import readers
from taxaflow.streaming import incremental


def test_graph_document(spark, tmp_path):
    doc = {"metadata": {"version": "1"}, "nodes": [{"id": "a", "label": "Genus", "properties": {"name": "A", "x": [1]}}], "relationships": [{"type": "T", "start_node_id": "a", "end_node_id": "b"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    n, e = readers.graph_document(spark, str(tmp_path / "g.json"))
    assert n.first().name == "A" and json.loads(n.first().properties) == {"name": "A", "x": [1]} and tuple(e.first()) == ("a", "T", "b", None)


def test_json_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1", "t": "a b"}\n\n  \n{"id": "2"}\n', encoding="utf-8")
    assert sorted((r.id, r.t) for r in readers.jsonl(spark, str(tmp_path / "r.jsonl"), "id string, t string").filter("id IS NOT NULL").collect()) == [("1", "a b"), ("2", None)]


def test_listings(spark, tmp_path):
    for f in ("Araujo_2020.pdf", "Santos_2019.PDF", "x.txt"):
        (tmp_path / f).write_bytes(b"%PDF")
    assert readers.pdfs(spark, str(tmp_path)).count() == 2
    assert [r.stem for r in readers.pdfs(spark, str(tmp_path), "ARAUJO").collect()] == ["Araujo_2020"]
    (tmp_path / "img" / "P1").mkdir(parents=True)
    png = readers.encode_png(np.zeros((3, 4), np.uint8))
    for f in ("img/a.PNG", "img/P1/b.png", "img/P1/c.json"):
        (tmp_path / f).write_bytes(png)
    assert {(r.path[-5:], r.sampling_point) for r in readers.grouped_images(spark, str(tmp_path / "img")).collect()} == {("a.PNG", "RAIZ"), ("b.png", "P1")}
    got = readers.rasters(readers.images(spark, str(tmp_path / "img"))).collect()
    assert [(r.height, r.width, r.channels, r.error) for r in got] == [(3, 4, 1, None)]
    (tmp_path / "img" / "bad.png").write_bytes(b"no")
    assert sorted(r.error is None for r in readers.rasters(readers.images(spark, str(tmp_path / "img"))).collect()) == [False, True]


def test_sidecars(spark):
    f = spark.createDataFrame([("p1", "a__b__c__d__e_f.png"), ("p2", "x.png"), ("p3", "y.png")], "path string, name string")
    s = spark.createDataFrame([("a__b__c__d", "{1}"), ("x", "{2}"), ("x", "{3}")], "stem string, json string")
    assert {r.path: r.sidecar for r in readers.with_sidecars(f, s).collect()} == {"p1": "{1}", "p2": "{2}", "p3": None}


def test_pdf_reader_is_optional(spark):
    df = spark.createDataFrame([("s", bytearray(b"x"))], "stem string, content binary")
    assert readers.pdf_pages(df).first().error


def test_vocabularies(tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"generos": ["B", " a ", "", None, "B"]}))
    with sqlite3.connect(tmp_path / "v.db") as con:
        con.execute("CREATE TABLE taxa (nome TEXT)")
        con.execute("INSERT INTO taxa VALUES ('Q'), (NULL)")
    v = readers.Vocabulary
    assert v.from_json(str(tmp_path / "v.json")).names == ["B", "a"] and v.from_sqlite(str(tmp_path / "v.db")).names == ["Q"]
    assert v.best(str(tmp_path / "none.json"), str(tmp_path / "v.db")).snapshot["source"] == "sqlite" and v.best().snapshot["source"] == "fallback"
    assert "Tetracladium" in v.built_in() and v.built_in().snapshot["size"] == len(v.built_in().names)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "DRAWING", 0.51234, "x", 1), ("b", "MICROSCOPY", 1.0, "x", 2)], "id string, image_type string, confidence double, point string, n int")
    sinks.by_type(df, str(tmp_path / "routed"))
    assert (tmp_path / "routed" / "image_type=DRAWING").is_dir()
    sinks.index(df, str(tmp_path / "index"))
    sinks.index(df, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).count() == 4
    sinks.predictions_csv(df, str(tmp_path / "csv"))
    assert {r.confidence for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"0.5123", "1.0000"}
    sinks.results(df.limit(1).withColumn("none", F.lit(None).cast("string")), str(tmp_path / "json"))
    text = "\n".join(r.value for r in spark.read.text(str(tmp_path / "json"), wholetext=True).collect())
    assert json.loads(text) == {"id": "a", "image_type": "DRAWING", "confidence": 0.51234, "point": "x", "n": 1, "none": None} and "\n  " in text
    sinks.summary(df, str(tmp_path / "s.md"), "point", "image_type")
    assert (tmp_path / "s.md").read_text().startswith("## x (2)")
    sinks.replace(df, str(tmp_path / "t"))
    sinks.replace(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    sinks.lines(spark.createDataFrame([('q"', '{"a":1}')], "label string, properties string"), str(tmp_path / "spg"))
    assert json.loads(spark.read.text(str(tmp_path / "spg")).first().value) == {"label": 'q"', "properties": {"a": 1}}
    crops = spark.createDataFrame([("c.png", 2, 3, bytearray(range(6)))], "name string, crop_h int, crop_w int, crop binary")
    sinks.images(crops, str(tmp_path / "png"))
    assert readers.decode((tmp_path / "png" / "c.png").read_bytes()).tolist() == [[0, 1, 2], [3, 4, 5]]


def test_chunks(spark, tmp_path):
    def send(rows):
        (tmp_path / f"{rows[0].id:04d}").write_text(str(len(rows)))

    sinks.in_chunks(spark.range(0, 120, 1, 1), send)
    assert sorted(int(p.read_text()) for p in tmp_path.iterdir()) == [20, 50, 50]


def test_upsert_stream_is_idempotent(spark, tmp_path):
    src, table = str(tmp_path / "in"), f"file://{tmp_path}/table"
    schema = "id string, v int, at int"
    write = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
    for rows in ([("a", 1, 1), ("b", 1, 1), ("a", 2, 2)], [("a", 3, 3), ("b", 0, 0)], []):
        if rows:
            write(rows)
        incremental.upsert_stream(spark, src, table, ["id"], "at", schema, parts=4).awaitTermination()
        last = incremental.latest(spark, table)
    assert sorted(tuple(r) for r in last.collect()) == [("a", 3, 3), ("b", 1, 1)]
    assert incremental.latest(spark, f"file://{tmp_path}/nothing") is None
    for v in range(4, 8):
        write([("a", v, v)])
        incremental.upsert_stream(spark, src, table, ["id"], "at", schema, parts=4).awaitTermination()
    # only the part of the one key was written again, and its old versions are gone
    assert sorted(tuple(r) for r in incremental.latest(spark, table).collect()) == [("a", 7, 7), ("b", 1, 1)]
    assert sorted(len(p) for p in incremental._parts(spark, table).values()) in ([2], [1, 2], [2, 2])


def test_streamed_counts(spark, tmp_path):
    df = spark.createDataFrame([(" t ", "2024-01-02 00:00:00"), ("T", "2024-01-03 00:00:00"), ("u", "2024-06-01 00:00:00")], "type string, at string").select("type", F.col("at").cast("timestamp").alias("loaded_at"))
    df.write.parquet(str(tmp_path / "e"))
    q = incremental.degree_stream(spark, str(tmp_path / "e"), "type string, loaded_at timestamp").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.type, r.edges) for r in spark.table("counts").collect()} == {("T", 2), ("U", 1)}


def test_orphans_by_batches(spark):
    from datetime import datetime as D

    e = lambda *r: spark.createDataFrame(list(r), "edge_id long, start_node_id string, end_node_id string, loaded_at timestamp_ntz")
    n = lambda *r: spark.createDataFrame(list(r), "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    state = orphans.OrphanState(spark)
    got = incremental.orphan_batches(state, [e((1, "a", "b", D(2024, 1, 2)))], [n(("a", D(2024, 1, 1), None))])
    assert [(r.edge_id, r.kind) for r in got.collect()] == [(1, "missing")]
    got = incremental.orphan_batches(state, [e((2, "b", "a", D(2024, 2, 3)))], [n(("b", D(2024, 2, 2), None))])
    assert [(r.edge_id, r.kind) for r in got.collect()] == [(1, "late")]


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"neighbours": 3, "few_shot": [1, 2]}')
    assert Settings.load(str(tmp_path / "s.json")).few_shot == (1, 2) and Settings.load().neighbours == 5
