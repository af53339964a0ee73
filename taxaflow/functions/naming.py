"""Names, identifiers, hashes and number formats of records and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(text: Column, most: int = 80) -> Column:
    """Letters and digits of ASCII, the rest as single underscores, none at the ends, lower case."""
    return F.substring(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")), 1, most)


def safe(text: Column, most: int = 80) -> Column:
    """A name for a file: other signs than letters, digits, ``_ . -`` as underscores."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", "_"), 1, most)


def short_hash(data: Column, n: int = 6) -> Column:
    return F.substring(F.sha1(data), 1, n)


def list_hash(items: Column, n: int = 12) -> Column:
    """Hash of a list of strings as sorted JSON text, with a blank after each comma."""
    quoted = F.transform(F.array_sort(items), lambda x: F.to_json(F.array(x)))
    text = F.concat(F.lit("["), F.array_join(F.transform(quoted, lambda q: F.substr(q, F.lit(2), F.length(q) - 2)), ", "), F.lit("]"))
    return F.substring(F.sha2(text, 256), 1, n)


def record_id(paper: Column, page: Column, figure: Column, content_hash: Column) -> Column:
    return F.format_string("%s__p%03d__fig%02d__%s", slug(paper), page, figure, content_hash)


def record_name(base: Column, genus: Column, species: Column) -> Column:
    """The id with the name it was given: ``_sp`` without a species, ``UNKNOWN_UNKNOWN`` without a genus."""
    full = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    name = F.when(full(genus).isNull(), F.lit("UNKNOWN_UNKNOWN")).otherwise(slug(F.concat_ws("_", full(genus), F.coalesce(full(species), F.lit("sp")))))
    return F.concat_ws("__", base, name)


def output_name(stem: Column, genus: Column, species: Column, confidence: Column, extension: Column, least: float = 0.35) -> Column:
    """``stem__[UNCERTAIN_]Genus_species__confNN.ext``; halves round to the even number."""
    percent = F.bround(confidence * 100).cast("int")
    mark = F.when(confidence < least, "UNCERTAIN_").otherwise("")
    return F.format_string("%s__%s%s_%s__conf%02d%s", stem, mark, safe(genus), safe(species), percent, extension)


def without_last_part(stem: Column) -> Column:
    s = F.substring(F.regexp_replace(F.regexp_replace(stem, r"(?U)[^\w\s\-]", ""), r"(?U)[\s\-]+", "_"), 1, 30)
    return F.regexp_replace(s, r"_[^_]*$", "")


def base_of_name(stem: Column) -> Column:
    """The first four parts of a stem of five or more; else the stem."""
    parts = F.split(stem, "__")
    return F.when(F.size(parts) >= 5, F.array_join(F.slice(parts, 1, 4), "__")).otherwise(stem)


def capital_first(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**30)))


def filled(c: Column) -> Column:
    """Null for an empty string, as both mean absent."""
    return F.when(F.length(c) > 0, c)


def morphotype_of(node_id: Column, classes: list[str] | None = None) -> Column:
    """The class in a node id of the form ``morphotype_<class>``; null for one outside ``classes``."""
    c = F.replace(node_id, F.lit("morphotype_"), F.lit(""))
    return c if classes is None else F.when(c.isin(*classes), c)


def to_points(pixels: Column, per_inch: float = 300.0) -> Column:
    return pixels * (72.0 / per_inch)


def padded_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: int = 20) -> Column:
    """Box widened by ``pad`` pixels and kept inside the page: struct (x0, y0, x1, y1)."""
    return F.struct(
        F.greatest(x - pad, F.lit(0)).alias("x0"),
        F.greatest(y - pad, F.lit(0)).alias("y0"),
        F.least(x + w + pad, width).alias("x1"),
        F.least(y + h + pad, height).alias("y1"),
    )
