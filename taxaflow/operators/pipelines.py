"""Whole pipelines: pages and images to figure records, relabelling, and the check of one specimen.

Each is one plan over the operators; nothing is gathered between its steps, and
a dry run is the plan without a sink.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.functions import naming
from taxaflow.functions import patterns as P
from taxaflow.operators import captions, graph, legend, records, similarity, vision

SCHEMA_VERSION, PIPELINE_VERSION = "figures.2", "taxaflow/0.1"


def page_records(crops: DataFrame, blocks: DataFrame, pages: DataFrame, kinds: DataFrame, vocabulary: Iterable[str] | None = P.LEGEND_GENERA) -> DataFrame:
    """Records of the newer kind: one per crop, with its type, the name resolved from its page, and an id from its content.

    Takes crops (pdf, page, crop_id, fig_index, cx, cy, content_hash), blocks
    and pages as ``legend.resolve`` does, and kinds (crop_id, image_type,
    confidence, rule).
    """
    resolved = legend.resolve(crops.select("pdf", "page", "crop_id", "cx", "cy"), blocks, legend.legends(pages, vocabulary), vocabulary)
    r = crops.join(resolved, ["pdf", "page", "crop_id"]).join(kinds.select("crop_id", "image_type", F.col("confidence").alias("type_confidence"), "rule"), "crop_id", "left")
    base = naming.record_id(F.regexp_replace("pdf", r"\.[^.]*$", ""), F.col("page"), F.col("fig_index"), F.col("content_hash"))
    return r.select(
        naming.record_name(base, F.col("genus"), F.col("epithet")).alias("id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(PIPELINE_VERSION).alias("pipeline_version"),
        F.col("pdf").alias("paper"),
        "page",
        "fig_index",
        F.coalesce("image_type", F.lit("AMBIGUOUS")).alias("image_type"),
        F.struct(F.col("image_type"), F.col("type_confidence").alias("confidence"), F.col("rule").alias("rule_fired")).alias("classifier"),
        F.struct("binomial", "genus", "epithet", "strategy", "confidence").alias("resolution"),
    )


def caption_records(images: DataFrame, blocks: DataFrame, pages: DataFrame, kinds: DataFrame, vocabulary: Iterable[str] | None = None) -> DataFrame:
    """Records of the older kind: the caption beside each image gives name and, if the image doesn't, type.

    Takes images (pdf, page, image_id, fig_index, x0, y0, x1, y1, content_hash),
    blocks (pdf, page, block_no, x0 ... y1, text), pages (pdf, page, text) and
    kinds (image_id, image_type).
    """
    c = captions.captions_of_boxes(images.select("pdf", "page", "image_id", "x0", "y0", "x1", "y1"), blocks, ["pdf", "page"])
    r = images.join(c, ["pdf", "page", "image_id"]).join(pages.select("pdf", "page", F.col("text").alias("_page")), ["pdf", "page"], "left").join(kinds.select("image_id", F.col("image_type").alias("image_type_raw")), "image_id", "left")
    r = r.withColumn("epithet", captions.epithet_or_page(F.col("caption"), F.coalesce("_page", F.lit("")), vocabulary))
    base = naming.record_id(F.regexp_replace("pdf", r"\.[^.]*$", ""), F.col("page"), F.col("fig_index"), F.col("content_hash"))
    raw = F.coalesce("image_type_raw", F.lit("AMBIGUOUS"))
    return r.select(
        naming.record_name(base, F.col("epithet.genus"), F.col("epithet.species")).alias("id"),
        F.col("pdf").alias("paper"),
        "page",
        "fig_index",
        records.overridden(raw, F.col("caption")).alias("image_type"),
        raw.alias("image_type_raw"),
        F.col("caption").alias("caption_raw"),
        "epithet",
    )


def specimen_files(pages: DataFrame, images: DataFrame) -> DataFrame:
    """(name, crop_h, crop_w, crop): numbered drawings of each page, under the page's first binomial, else its PDF's stem.

    Takes pages (pdf, page, text) and images (image_id, pdf, page, img_no,
    height, width, channels, data).
    """
    names = pages.select("pdf", "page", F.coalesce(P.first_binomial(F.coalesce("text", F.lit(""))), F.regexp_replace("pdf", r"\.[^.]*$", "")).alias("species"))
    found = vision.drawings(images).select("image_id", "box", "crop_h", "crop_w", "crop")
    r = found.join(images.select("image_id", "pdf", "page", "img_no"), "image_id").join(names, ["pdf", "page"])
    return r.select(F.format_string("%s_pg%03d_img%02d_cond%02d.png", naming.safe(F.col("species")), "page", "img_no", F.col("box") + 1).alias("name"), "crop_h", "crop_w", "crop")


def specimen_totals(images: DataFrame) -> DataFrame:
    """(pdf, images, failed, drawings): of each document its images, those that can't be read, and the drawings found in the others.

    Takes images (image_id, pdf, height, width, channels, data).
    """
    bad = F.col("data").isNull() | (F.length("data") != F.col("height") * F.col("width") * F.col("channels"))
    found = vision.drawings(images.filter(~bad)).groupBy("image_id").agg(F.count("*").alias("n"))
    i = images.select("image_id", "pdf", F.coalesce(bad, F.lit(True)).alias("bad")).join(found, "image_id", "left")
    return i.groupBy("pdf").agg(F.count("*").alias("images"), F.count_if("bad").alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("drawings"))


def relabel(all_records: DataFrame, seen: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records with their new types and paths, counts per new type). Takes records by ``rec_id``."""
    new = records.relabelled(all_records, seen).select("rec_id", "new_type", "new_raw", records.moved_to(F.col("saved_to"), F.col("new_raw")).alias("new_path"))
    r = all_records.join(new, "rec_id", "left")
    r = r.withColumn("image_type", F.coalesce("new_type", "image_type")).withColumn("image_type_raw", F.coalesce("new_raw", "image_type_raw")).withColumn("saved_to", F.coalesce("new_path", "saved_to"))
    return r.drop("new_type", "new_raw", "new_path"), new.groupBy("new_type", "new_raw").agg(F.count("*").alias("n"))


def identified(queries: DataFrame, index: DataFrame, labels: DataFrame, table: DataFrame | None = None, k: int = 5, least: float = 0.35) -> DataFrame:
    """(query_id, best, confidence, uncertain, top_json[, expected, valid, reason]): nearest neighbours, vote, check against the graph.

    ``queries`` has (query_id, vector[, observed]); labels (id, genus,
    label_confidence); ``table`` is a morphotype table to check against.
    """
    found = similarity.neighbours(queries.select("query_id", "vector"), index, k)
    p = similarity.predictions(similarity.votes(found, labels, ["genus"]), "genus", least)
    if table is None:
        return p
    q = p.join(queries.select("query_id", "observed"), "query_id").withColumn("predicted_genus", F.col("best").cast("string"))
    return graph.check_predictions(q, table).drop("predicted_genus")


def hashed(text: Column) -> Column:
    """A number from 0 on by the MD5 of a text, the same in every engine; that of an empty text for null."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 13), 16, 10).cast("long")


def hash_split(rows: DataFrame, key: str, shares: dict[str, float] | None = None) -> DataFrame:
    """``rows`` with ``split`` by a hash of the key alone: the same on every run and for every new row."""
    shares = shares or {"train": 0.70, "val": 0.15, "test": 0.15}
    total, edge, out = sum(shares.values()), 0.0, None
    u = hashed(F.col(key).cast("string")) % 1_000_000 / 1_000_000
    names = list(shares)
    for n in names[:-1]:
        edge += shares[n] / total
        out = F.when(u < edge, n) if out is None else out.when(u < edge, n)
    return rows.withColumn("split", F.lit(names[-1]) if out is None else out.otherwise(names[-1]))


def sampled_pairs(edges: DataFrame, anchors: DataFrame, hard_ratio: float = 0.5, per_anchor: int = 10) -> DataFrame:
    """(anchor, genus_id, hard): ``per_anchor`` negatives of each anchor, of which a share of ``hard_ratio`` are hard.

    Which ones is decided by a hash, so the sample is the same on every run.
    """
    from pyspark.sql.window import Window as W

    h = graph.hard_negatives(edges, anchors).withColumn("hard", F.lit(True))
    e = graph.easy_negatives(edges, anchors).withColumn("hard", F.lit(False))
    n = F.when(F.col("hard"), F.lit(round(per_anchor * hard_ratio))).otherwise(F.lit(per_anchor - round(per_anchor * hard_ratio)))
    order = W.partitionBy("anchor", "hard").orderBy(hashed(F.concat_ws("|", "anchor", "genus_id")), "genus_id")
    return h.union(e).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")


def accuracy(rows: DataFrame, point: str, truth: str, guess: str) -> DataFrame:
    """(point, truth, n, accuracy) per point and class, per point, and over all: a rollup."""
    return rows.rollup(point, truth).agg(F.count("*").alias("n"), F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))
