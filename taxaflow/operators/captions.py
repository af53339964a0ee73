"""Names in captions and pages: one struct per text, from JVM expressions only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taxaflow.functions import patterns as P
from taxaflow.functions.columns import let


def _struct(genus, species, binomial, confidence: float, uncertain: bool, rule: str, found, snippet) -> Column:
    s = lambda v: (F.lit(None) if v is None else v).cast("string")
    return F.struct(
        s(genus).alias("genus"),
        s(species).alias("species"),
        s(binomial).alias("binomial"),
        F.lit(confidence).alias("confidence"),
        F.lit(uncertain).alias("uncertain"),
        F.lit(rule).alias("rule"),
        (found if found is not None else F.array()).cast("array<string>").alias("all_candidates"),
        s(snippet).alias("context_snippet"),
    )


def epithet(text: Column, vocabulary: Iterable[str] | None = P.BUILT_IN_GENERA) -> Column:
    """The name a caption gives: rule is empty-caption, blocked-section, binomial-strict, genus-only or no-match.

    With ``vocabulary`` (a bounded list) only its genera count; None takes any
    capitalised word that is not on the stop list. The first valid name in the
    order of the text is taken, all distinct ones are listed. A null text is an
    empty caption.
    """
    words = lambda m: F.split(m, r"(?U)\s+")
    genus = lambda m: F.get(words(m), F.lit(0))
    known = lambda g: ~g.isin(*P.NOT_GENERA) & P.known_genus(g, vocabulary)
    pairs = F.filter(F.regexp_extract_all(text, F.lit(P.BINOMIAL), F.lit(0)), lambda m: ~F.get(words(m), F.lit(1)).isin(*P.NOT_EPITHETS) & known(genus(m)))
    pairs = F.transform(pairs, lambda m: F.array_join(words(m), " "))
    genera = F.filter(F.regexp_extract_all(text, F.lit(P.GENUS), F.lit(1)), known)
    snippet = F.substring(text, 1, 180)
    names = lambda x: F.split(F.get(x["pairs"], F.lit(0)), " ")
    return let(
        F.struct(pairs.alias("pairs"), genera.alias("genera")),
        lambda x: F.when(~F.coalesce(text.rlike(r"(?U)\S"), F.lit(False)), _struct(None, None, None, 0.0, True, "empty-caption", None, None))
        .when(P.blocked(text), _struct(None, None, None, 0.0, True, "blocked-section", None, snippet))
        .when(F.size(x["pairs"]) > 0, _struct(F.get(names(x), F.lit(0)), F.get(names(x), F.lit(1)), F.get(x["pairs"], F.lit(0)), 0.95, False, "binomial-strict", F.array_distinct(x["pairs"]), snippet))
        .when(F.size(x["genera"]) > 0, _struct(F.get(x["genera"], F.lit(0)), None, None, 0.65, True, "genus-only", F.slice(x["genera"], 1, 1), snippet))
        .otherwise(_struct(None, None, None, 0.0, True, "no-match", None, snippet)),
    )


def epithet_of_pages(pages: DataFrame, key: str, vocabulary: Iterable[str] | None = P.BUILT_IN_GENERA) -> DataFrame:
    """(key, epithet): of the first page in order with a binomial, else of all pages' text together.

    Takes (key, page, text), pages numbered in order. What all pages together
    would give is put together from per-page results, so no document is ever
    gathered: a page is read together with the next one, for names and
    section titles that a page break divides; a blocked section anywhere blocks
    the whole, else the first such name counts, else the first genus.
    """
    head = pages.select(key, (F.col("page") - 1).alias("page"), F.col("text").alias("_head")).groupBy(key, "page").agg(F.min("_head").alias("_head"))
    e = pages.select(key, "page", F.coalesce("text", F.lit("")).alias("text")).join(head, [key, "page"], "left")
    full = F.concat_ws("\n", "text", "_head")
    e = e.select(key, "page", F.substring("text", 1, 180).alias("snippet"), epithet(F.col("text"), vocabulary).alias("own"), epithet(full, vocabulary).alias("wide"), P.blocked(full).alias("blocked"))
    first = lambda c, when: F.min_by(F.when(when, F.col(c)), F.when(when, F.col("page")))
    g = e.groupBy(key).agg(
        first("own", F.col("own.binomial").isNotNull()).alias("own"),
        F.max("blocked").alias("blocked"),
        first("wide", F.col("wide.binomial").isNotNull()).alias("wide"),
        first("own", F.col("own.genus").isNotNull()).alias("genus"),
        F.max((F.col("own.rule") != "empty-caption").cast("int")).alias("any"),
        F.min_by("snippet", "page").alias("snippet"),
    )
    none = lambda rule, snippet: _struct(None, None, None, 0.0, True, rule, None, snippet)
    return g.select(
        key,
        F.when(F.col("own").isNotNull(), F.col("own"))
        .when(F.col("any") == 0, none("empty-caption", None))
        .when(F.col("blocked"), none("blocked-section", F.col("snippet")))
        .when(F.col("wide").isNotNull(), F.col("wide"))
        .when(F.col("genus").isNotNull(), F.col("genus"))
        .otherwise(none("no-match", F.col("snippet")))
        .alias("epithet"),
    )


def epithet_or_page(caption: Column, page: Column, vocabulary: Iterable[str] | None = None) -> Column:
    """The caption's name; the page's if the caption gives neither a binomial nor a genus."""
    c = epithet(caption, vocabulary)
    return F.when(c["binomial"].isNotNull() | c["genus"].isNotNull(), c).otherwise(epithet(page, vocabulary))


def captions_of_boxes(images: DataFrame, blocks: DataFrame, page: list[str], window: float = 120.0) -> DataFrame:
    """(page..., image_id, caption): the up to three text blocks next to an image, joined by a line feed.

    Takes images (page..., image_id, x0, y0, x1, y1) and blocks (page...,
    block_no, x0, y0, x1, y1, text). A block counts from 0 to ``window`` points
    below the image, or up to half of that above it (with 20 points more), if
    it overlaps the image across. Blocks that begin as a figure's caption come
    first, then the nearest, then the lowest block_no. Images without a block
    get an empty caption. The join is on the page; ranking keeps three per image.
    """
    b = blocks.filter(F.col("text").rlike(r"(?U)\S")).select(*page, "block_no", F.trim("text").alias("text"), *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")))
    below = F.col("b_y0") - F.col("y1")
    across = F.least("b_x1", "x1") - F.greatest("b_x0", "x0")
    near = F.when((below >= 0) & (below <= window), below).when((below < 0) & (-below <= window / 2), -below + 20.0)
    r = images.join(b, page).withColumn("near", near).filter(F.col("near").isNotNull() & (across > 0))
    r = r.withColumn("fig", F.col("text").rlike(P.FIGURE_START))
    order = W.partitionBy(*page, "image_id").orderBy(F.desc("fig"), "near", "block_no", "text")
    top = r.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
    text = top.groupBy(*page, "image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " \n ").alias("caption"))
    return images.join(text, [*page, "image_id"], "left").select(*page, "image_id", F.coalesce("caption", F.lit("")).alias("caption"))
