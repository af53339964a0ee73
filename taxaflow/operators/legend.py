"""Legends of numbered figures, and the name of each drawing from what stands near it.

The ways to read a legend are gated: a later way runs only where the earlier
ones left fewer entries than it takes. They are computed as columns of the page,
so the gates need no further pass over the text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taxaflow.functions import patterns as P
from taxaflow.functions.columns import let
from taxaflow.functions.naming import without_last_part

_HIT = "array<struct<number:int,genus:string,epithet:string,strategy:string,confidence:double>>"


def _rounded(strategy: str, vocabulary: Iterable[str] | None, genus: Column) -> Column:
    c = P.CONFIDENCE[strategy]
    return F.when(P.known_genus(genus, vocabulary), F.lit(c)).otherwise(F.bround(F.lit(c * P.UNKNOWN_GENUS_FACTOR), 3))


def _hits(text: Column, pattern: str, strategy: str, vocabulary: Iterable[str] | None) -> Column:
    """Valid entries (number, genus, epithet of at least 5 letters) in the order of the text."""
    g = lambda i: F.regexp_extract_all(text, F.lit(pattern), F.lit(i))
    z = F.arrays_zip(g(1).alias("n"), g(2).alias("g"), g(3).alias("e"))
    z = F.filter(z, lambda x: (F.length(x["e"]) >= 5) & P.valid_binomial(x["g"], x["e"]))
    return F.transform(z, lambda x: F.struct(x["n"].cast("int").alias("number"), x["g"].alias("genus"), x["e"].alias("epithet"), F.lit(strategy).alias("strategy"), _rounded(strategy, vocabulary, x["g"]).alias("confidence"))).cast(_HIT)


def _add(old: Column, new: Column) -> Column:
    """``old`` with those of ``new`` whose number is not there yet; of equal numbers the first."""
    return F.aggregate(
        new, old, lambda acc, x: F.when(F.exists(acc, lambda y: y["number"] == x["number"]), acc).otherwise(F.concat(acc, F.array(x)))
    )


def legends(pages: DataFrame, vocabulary: Iterable[str] | None = P.LEGEND_GENERA) -> DataFrame:
    """``pages`` (pdf, page, text) with ``legend``: entries (number, genus, epithet, strategy, confidence).

    1 strict entries; 2 loose ones, and 3 pairs in a figure's caption, while
    there are fewer than two; 4 abbreviated genera, if there is an entry, read
    as the most frequent genus (of equals the first seen) with that initial;
    5 strict entries of the pages before and after, if there is none.
    """
    none = F.array().cast(_HIT)
    text = F.coalesce("text", F.lit(""))
    # the pages before and after by number: joins on (pdf, page), as a window would take a whole document into one task
    beside = lambda step, name: pages.select("pdf", (F.col("page") + step).alias("page"), "text").groupBy("pdf", "page").agg(F.coalesce(F.min("text"), F.lit("")).alias(name))
    p = pages.join(beside(1, "_before"), ["pdf", "page"], "left").join(beside(-1, "_after"), ["pdf", "page"], "left")
    strict = _hits(text, P.LEGEND_STRICT, "legend_strict", vocabulary)
    loose = _hits(text, P.LEGEND_LOOSE, "legend_loose", vocabulary)
    paired = _hits(F.regexp_extract(text, P.FIGURE_CAPTION, 1), P.CAPTION_PAIRS, "caption_pairs", vocabulary)
    near = F.concat(_hits(F.coalesce("_before", F.lit("")), P.LEGEND_STRICT, "adjacent_pages", vocabulary), _hits(F.coalesce("_after", F.lit("")), P.LEGEND_STRICT, "adjacent_pages", vocabulary))
    grow = lambda more: lambda acc: F.when(F.size(acc) < 2, _add(acc, more)).otherwise(acc)
    stages = let(_add(none, strict), lambda a: let(grow(loose)(a), lambda b: let(grow(paired)(b), lambda c: let(_abbreviated(text, c, vocabulary), lambda e: F.when(F.size(e) == 0, _add(none, near)).otherwise(e)))))
    return p.withColumn("legend", stages).drop("_before", "_after")


def _modal(hits: Column) -> Column:
    """The most frequent genus; of equals the first seen."""
    genera = F.transform(hits, lambda x: x["genus"])
    counted = F.transform(F.array_distinct(genera), lambda g, i: F.struct(F.size(F.filter(genera, lambda h: h == g)).alias("n"), (-i).alias("i"), g.alias("g")))
    return F.array_max(counted)["g"]


def _abbreviated(text: Column, hits: Column, vocabulary: Iterable[str] | None) -> Column:
    """``hits`` with the entries whose genus is given by its initial, read as the most frequent genus."""
    short = lambda i: F.regexp_extract_all(text, F.lit(P.ABBREVIATED), F.lit(i))

    def entries(genus: Column) -> Column:
        z = F.arrays_zip(short(1).alias("n"), short(2).alias("g"), short(3).alias("e"))
        z = F.filter(z, lambda x: (x["g"] == F.substring(genus, 1, 1)) & (F.length(x["e"]) >= 5) & P.valid_binomial(genus, x["e"]))
        return F.transform(
            z, lambda x: F.struct(x["n"].cast("int").alias("number"), genus.alias("genus"), x["e"].alias("epithet"), F.lit("abbreviated").alias("strategy"), _rounded("abbreviated", vocabulary, genus).alias("confidence"))
        ).cast(_HIT)

    return F.when(F.size(hits) > 0, _add(hits, let(_modal(hits), entries))).otherwise(hits)


def page_fallback(text: Column, vocabulary: Iterable[str] | None = P.LEGEND_GENERA) -> Column:
    """The first binomial of a known genus on a page; null if there is none."""
    g = lambda i: F.regexp_extract_all(text, F.lit(P.RESOLVED_BINOMIAL), F.lit(i))
    z = F.filter(F.arrays_zip(g(1).alias("g"), g(2).alias("e")), lambda x: (F.length(x["e"]) >= 5) & P.valid_binomial(x["g"], x["e"], vocabulary))
    first = F.get(z, F.lit(0))
    return F.when(first.isNotNull(), F.concat_ws(" ", first["g"], first["e"]))


def nearest_blocks(crops: DataFrame, blocks: DataFrame, page: list[str], k: int = 8, radius: float = 250.0) -> DataFrame:
    """(page..., crop_id, block_no, text, dist): of the ``k`` nearest blocks of each crop by centre those within ``radius``."""
    b = blocks.select(*page, "block_no", "text", ((F.col("x0") + F.col("x1")) / 2).alias("bx"), ((F.col("y0") + F.col("y1")) / 2).alias("by"))
    d = crops.join(b, page).withColumn("dist", F.hypot(F.col("bx") - F.col("cx"), F.col("by") - F.col("cy")))
    order = W.partitionBy(*page, "crop_id").orderBy("dist", "block_no", "text")
    return d.withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= k) & (F.col("dist") <= radius)).select(*page, "crop_id", "block_no", "text", "dist", "rank")


def resolve(crops: DataFrame, blocks: DataFrame, pages: DataFrame, vocabulary: Iterable[str] | None = P.LEGEND_GENERA) -> DataFrame:
    """(pdf, page, crop_id, binomial, genus, epithet, strategy, confidence, candidates) of each crop.

    Takes crops (pdf, page, crop_id, cx, cy), blocks (pdf, page, block_no, x0,
    y0, x1, y1, text) and pages from ``legends`` (pdf, page, text, legend).
    Candidates are, in this order, entries of the legend whose number stands in
    a near block, known binomials in near blocks, and the page's first known
    binomial; ranked by confidence, then distance (none last), then order. The
    best five are kept. Without a candidate, strategy is pdf_filename.
    """
    key = ["pdf", "page", "crop_id"]
    near = nearest_blocks(crops, blocks, ["pdf", "page"])
    numbers = near.select(*key, "rank", "dist", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?U)\b(\d{1,3})\b"), F.lit(1))).alias("at", "n"))
    entries = pages.select("pdf", "page", F.explode("legend").alias("h")).select("pdf", "page", "h.*")
    a = numbers.join(entries, (numbers.pdf == entries.pdf) & (numbers.page == entries.page) & (F.col("n").cast("int") == F.col("number"))).select(
        numbers.pdf, numbers.page, "crop_id", F.lit(0).alias("way"), "rank", "at", F.concat_ws(" ", "genus", "epithet").alias("binomial"), "strategy", "confidence", F.round("dist", 2).alias("dist")
    )
    g = lambda i: F.regexp_extract_all("text", F.lit(P.RESOLVED_BINOMIAL), F.lit(i))
    z = F.filter(F.arrays_zip(g(1).alias("g"), g(2).alias("e")), lambda x: (F.length(x["e"]) >= 5) & P.valid_binomial(x["g"], x["e"], vocabulary))
    b = near.select(*key, "rank", "dist", F.posexplode(z).alias("at", "x")).select(
        *key, F.lit(1).alias("way"), "rank", "at", F.concat_ws(" ", "x.g", "x.e").alias("binomial"), F.lit("proximity_binomial").alias("strategy"), F.lit(P.CONFIDENCE["proximity_binomial"]).alias("confidence"), F.round("dist", 2).alias("dist")
    )
    fallback = pages.select("pdf", "page", page_fallback(F.col("text"), vocabulary).alias("binomial")).filter("binomial IS NOT NULL")
    c = crops.select(*key).join(fallback, ["pdf", "page"]).select(
        *key, F.lit(2).alias("way"), F.lit(0).alias("rank"), F.lit(0).alias("at"), "binomial", F.lit("page_fallback").alias("strategy"), F.lit(P.CONFIDENCE["page_fallback"]).alias("confidence"), F.lit(None).cast("double").alias("dist")
    )
    order = W.partitionBy(*key).orderBy(F.desc("confidence"), F.asc_nulls_last("dist"), "way", "rank", "at")
    top = a.union(b).union(c).withColumn("place", F.row_number().over(order)).filter("place <= 5")
    best = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "binomial", "strategy", "confidence", "dist"))).alias("candidates"))
    one = F.get("candidates", F.lit(0))
    r = crops.select(*key).join(best, key, "left")
    return r.select(
        *key,
        one["binomial"].alias("binomial"),
        F.get(F.split(one["binomial"], " "), F.lit(0)).alias("genus"),
        F.get(F.split(one["binomial"], " "), F.lit(1)).alias("epithet"),
        F.coalesce(one["strategy"], F.lit("pdf_filename")).alias("strategy"),
        F.coalesce(one["confidence"], F.lit(P.CONFIDENCE["pdf_filename"])).alias("confidence"),
        F.when(one.isNull(), F.concat(F.lit("PDF stem="), without_last_part(F.regexp_replace("pdf", r"\.[^.]*$", "")))).alias("note"),
        F.size(F.coalesce("candidates", F.array())).alias("n_candidates"),
    )
