"""Figure records of mixed versions: one shape, links, coverage, labels, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taxaflow.functions import patterns as P
from taxaflow.functions.naming import capital_first, filled

#: The ordered rules of the image type: name, condition, type, confidence (fixed values). The first that holds decides.
RULES = [
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
OTHERWISE = ("R11", "AMBIGUOUS", 0.40)


def classified(features: DataFrame) -> DataFrame:
    """``features`` (columns of the seven image features) with (rule, image_type, confidence): one CASE chain."""
    pick = lambda i: reduce(lambda c, r: c.when(F.expr(r[1]), F.lit(r[i])), RULES[1:], F.when(F.expr(RULES[0][1]), F.lit(RULES[0][i])))
    return (
        features.withColumn("rule", pick(0).otherwise(OTHERWISE[0]))
        .withColumn("image_type", pick(2).otherwise(OTHERWISE[1]))
        .withColumn("confidence", pick(3).otherwise(F.lit(OTHERWISE[2])))
    )


def overridden(image_type: Column, caption: Column) -> Column:
    """An ambiguous type refined by the caption: trees are drawings, words of morphology mean microscopy."""
    c = F.coalesce(caption, F.lit(""))
    return F.when(image_type != "AMBIGUOUS", image_type).when(c.rlike(P.TREE_CAPTION), "DRAWING").when(c.rlike(P.MICROSCOPY_CAPTION), "MICROSCOPY").otherwise("AMBIGUOUS")


def relabelled(records: DataFrame, seen: Column | None = None) -> DataFrame:
    """Ambiguous records (id, caption_raw) with ``new_type`` and ``new_raw``.

    Notices are NOISE, stored as AMBIGUOUS with raw NOISE; else the type that
    the image gives (``seen``, null where there is no image), refined by the
    caption; else by the caption alone.
    """
    r = records.filter("image_type = 'AMBIGUOUS'")
    noise = P.noisy(F.col("caption_raw"))
    kind = overridden(F.coalesce(seen, F.lit("AMBIGUOUS")) if seen is not None else F.lit("AMBIGUOUS"), F.col("caption_raw"))
    return r.withColumn("new_raw", F.when(noise, "NOISE").otherwise(kind)).withColumn("new_type", F.when(noise, "AMBIGUOUS").otherwise(kind))


def moved_to(saved_to: Column, new_raw: Column) -> Column:
    """The path after relabelling: in the folder of the type, notices in ``noise``."""
    folder = F.when(new_raw == "NOISE", "ambiguous/noise").otherwise(F.lower(new_raw))
    return F.concat(F.regexp_extract(saved_to, r"^(.*?)[^/]*/[^/]*$", 1), folder, F.lit("/"), F.regexp_extract(saved_to, r"([^/]*)$", 1))


def _holds(c: str, fields: list[str]) -> Column:
    return F.coalesce(*(F.col(f"{c}.{f}").cast("string") for f in fields)).isNotNull()


def normalised(records: DataFrame) -> DataFrame:
    """One flat row per record of either version: the newer ``resolution`` if it holds anything, else ``epithet``.

    An empty string counts as absent; a caption is cut to 500 signs; the rule is
    that of ``epithet``, else the strategy.
    """
    new = _holds("resolution", ["binomial", "genus", "epithet", "strategy", "confidence"])
    either = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b))
    zero = F.lit(0)
    return records.select(
        "rec_id",
        "id",
        F.coalesce("paper", F.lit("")).alias("paper"),
        F.coalesce("page", zero).alias("page"),
        F.coalesce("fig_index", zero).alias("fig_index"),
        F.coalesce("image_type", F.lit("AMBIGUOUS")).alias("image_type"),
        F.coalesce("image_type_raw", "image_type", F.lit("AMBIGUOUS")).alias("image_type_raw"),
        F.coalesce("saved_to", F.lit("")).alias("saved_to"),
        F.substring(F.coalesce("caption_raw", F.lit("")), 1, 500).alias("caption_raw"),
        filled(either("resolution.binomial", "epithet.binomial")).alias("binomial"),
        filled(either("resolution.genus", "epithet.genus")).alias("genus"),
        filled(either("resolution.epithet", "epithet.species")).alias("species"),
        F.coalesce(either("resolution.confidence", "epithet.confidence"), F.lit(0.0)).alias("epithet_confidence"),
        F.coalesce(either("resolution.strategy", "epithet.rule"), F.lit("")).alias("epithet_rule"),
        F.coalesce("classifier.rule_fired", F.lit("")).alias("classifier_rule"),
        F.coalesce("classifier.width", zero).alias("width"),
        F.coalesce("classifier.height", zero).alias("height"),
        F.coalesce("classifier.sat_mean", F.lit(0.0)).alias("sat_mean"),
        F.coalesce("classifier.edge_density", F.lit(0.0)).alias("edge_density"),
        F.coalesce("classifier.white_bg_ratio", F.lit(0.0)).alias("white_bg_ratio"),
    )


def first_of(rows: DataFrame, key: str, columns: list[str], order: str = "rec_id") -> DataFrame:
    """(key, columns...) of the first row, by ``order``, that has each key."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*columns), F.col(order)).alias("_f")).select(key, *(F.col(f"_f.{c}").alias(c) for c in columns))


def species_nodes(flat: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(name, genero, epiteto): one node per binomial, as its first record has it; none that exist already."""
    s = first_of(flat, "binomial", ["genus", "species"])
    s = s.select(F.col("binomial").alias("name"), F.coalesce("genus", F.lit("")).alias("genero"), F.coalesce("species", F.lit("")).alias("epiteto"))
    return s if existing is None else s.join(existing.select("name"), "name", "left_anti")


def genus_nodes(flat: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    g = flat.filter("genus IS NOT NULL").select(F.col("genus").alias("name")).distinct()
    return g if existing is None else g.join(existing.select("name"), "name", "left_anti")


def links(flat: DataFrame, publications: DataFrame) -> DataFrame:
    """(src, type, dst): edges of each record to its publication if that exists, its species and its genus."""
    pub = flat.select("id", F.col("paper").alias("filename")).join(publications.select("filename").distinct(), "filename", "left_semi")
    return (
        pub.select(F.col("id").alias("src"), F.lit("EXTRAIDA_DE").alias("type"), F.col("filename").alias("dst"))
        .union(flat.filter("binomial IS NOT NULL").select("id", F.lit("EXEMPLIFICA_ESPECIE"), "binomial"))
        .union(flat.filter("genus IS NOT NULL").select("id", F.lit("PERTENCE_A_GENERO"), "genus"))
        .distinct()
    )


def type_counts(records: DataFrame) -> DataFrame:
    """(image_type, n, with_binomial, genus_only, unnamed); a missing type is '?'."""
    has = lambda c: F.col(c).isNotNull()
    return records.groupBy(F.coalesce("image_type", F.lit("?")).alias("image_type")).agg(
        F.count("*").alias("n"),
        F.count_if(has("binomial")).alias("with_binomial"),
        F.count_if(~has("binomial") & has("genus")).alias("genus_only"),
        F.count_if(~has("binomial") & ~has("genus")).alias("unnamed"),
    )


def coverage(records: DataFrame) -> DataFrame:
    """(ambiguous_share, binomial_rate), one row; null for an empty table."""
    return records.agg(F.avg((F.col("image_type") == "AMBIGUOUS").cast("double")).alias("ambiguous_share"), F.avg(F.col("binomial").isNotNull().cast("double")).alias("binomial_rate"))


def exported(flat: DataFrame) -> DataFrame:
    """(label, id, properties): images, genera and species as tagged records with JSON properties."""
    j = lambda **c: F.to_json(F.struct(*(v.alias(k) for k, v in c.items())), {"ignoreNullFields": "false"})
    e = lambda c: F.coalesce(F.col(c), F.lit(""))
    image = flat.select(
        F.lit("TrainingImage").alias("label"),
        "id",
        j(id=F.col("id"), name=F.col("id"), imageType=F.col("image_type"), imageTypeRaw=e("image_type_raw"), paper=e("paper"), binomial=e("binomial"), genus=e("genus"), species=e("species"), confidence=F.col("epithet_confidence"), captionRaw=F.substring("caption_raw", 1, 300), savedTo=e("saved_to")).alias("properties"),
    )
    genus = genus_nodes(flat).select(F.lit("Genero"), "name", j(id=F.col("name"), name=F.col("name"), origem=F.lit("training")))
    species = species_nodes(flat).select(F.lit("Especie"), "name", j(id=F.col("name"), name=F.col("name"), generoNome=F.col("genero"), origem=F.lit("training")))
    return image.union(genus).union(species)


def labels_of_files(files: DataFrame) -> DataFrame:
    """(path, genus, species, source_kind, label_confidence) of training images; files without a genus are left out.

    Takes (path, folder, name, sidecar) with the sidecar's JSON text or null. The
    name comes from the sidecar's resolution, else its epithet, else the file's
    name; UNKNOWN and sp are no names. A sidecar that can't be read counts as none.
    """
    meta = F.from_json("sidecar", "resolution struct<binomial:string,confidence:double>, epithet struct<genus:string,species:string>")
    f = files.withColumn("m", meta)
    b = F.when(~F.col("m.resolution.binomial").contains("UNKNOWN"), filled(F.replace(F.col("m.resolution.binomial"), F.lit("_"), F.lit(" "))))
    parts = F.filter(F.split(b, r"\s+"), lambda x: x != "")
    g1, s1 = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    g2, s2 = filled(F.col("m.epithet.genus")), filled(F.col("m.epithet.species"))
    g3, s3 = F.regexp_extract("name", P.NAME_IN_FILE, 1), F.regexp_extract("name", P.NAME_IN_FILE, 2)
    g3 = F.when((g3 != "") & ~F.lower(g3).isin("unknown", "sp"), g3)
    s3 = F.when(s3 != "sp", filled(s3))
    folder = F.lower("folder")
    kind = F.when(folder.contains("desenho"), "drawing").when(folder.contains("lamina") | folder.contains("lâmina"), "microscopy").when(folder.contains("ambig"), "ambiguous").otherwise("unknown")
    species = F.when(g1.isNotNull(), s1).when(g2.isNotNull(), s2).otherwise(s3)
    confidence = F.when(b.isNotNull(), F.coalesce("m.resolution.confidence", F.lit(1.0))).otherwise(F.lit(1.0))
    return f.select("path", capital_first(F.coalesce(g1, g2, g3)).alias("genus"), F.lower(species).alias("species"), kind.alias("source_kind"), confidence.alias("label_confidence")).filter("genus IS NOT NULL")


def consolidated(records: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last record of each key by ``order``."""
    return records.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


#: Entities of the export and their properties (fixed values).
EXPORT = {
    "TrainingImage": "id STRING, name STRING, imageType STRING, imageTypeRaw STRING, paper STRING, binomial STRING, genus STRING, species STRING, confidence DOUBLE, captionRaw STRING, savedTo STRING",
    "Genero": "id STRING, name STRING, origem STRING",
    "Especie": "id STRING, name STRING, generoNome STRING, origem STRING",
}


def export_tables(prefix: str = "") -> list[str]:
    """Statements that create the tables of the export where they aren't there."""
    return [f"CREATE TABLE IF NOT EXISTS {prefix}{name} ({columns}) USING parquet" for name, columns in EXPORT.items()]


def export_rows(exported_records: DataFrame, label: str) -> DataFrame:
    """The records of one entity as columns."""
    return exported_records.filter(F.col("label") == label).select(F.from_json("properties", EXPORT[label]).alias("p")).select("p.*")
