"""Repetition within and across documents.

``within`` measures each document against itself: words in five-word runs that
began earlier in the same text. ``line_frequency`` is the cross-document method:
lines that too many documents of one host share are removed, and documents that
lose too much are rejected. The second can't tell the first, as it never looks
at one text alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.runtime import spread

WORD = re.compile(r"\w+")


def repeated_share(text: str | None, run: int = 5) -> tuple[int, int]:
    """(repeated words, all words): a word is repeated if it lies in ``run`` words in a row that also start earlier."""
    if not text:
        return 0, 0
    ids: dict[str, int] = {}
    words = [ids.setdefault(w, len(ids)) for w in WORD.findall(text.lower())]
    n = len(words)
    if n <= run or len(ids) == n:
        return 0, n
    seen: set[tuple] = set()
    repeated, upto = 0, 0
    for i, g in enumerate(zip(*(words[k:] for k in range(run)), strict=False)):
        if g in seen:
            repeated += i + run - max(i, upto)
            upto = i + run
        else:
            seen.add(g)
    return repeated, n


def within(docs: DataFrame, run: int = 5) -> DataFrame:
    """(doc_id, repeated, words, share) of each document; share is 0 for a text that is null, empty or shorter than a run."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pairs = [repeated_share(t, run) for t in b["text"]]
            out = pd.DataFrame(pairs, columns=["repeated", "words"], dtype="int64")
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    rows = spread(docs.select("doc_id", "text")).mapInPandas(measure, "doc_id long, repeated long, words long")
    return rows.withColumn("share", F.when(F.col("words") > 0, F.col("repeated") / F.col("words")).otherwise(F.lit(0.0)))


def _norm(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", "0"), r"[^\p{L}\p{N}]+", " "))


def line_frequency(docs: DataFrame, most_docs: int = 5, most_share: float = 0.001, least_chars: int = 12, least_kept: float = 0.5) -> DataFrame:
    """(doc_id, lines, removed, kept_share, rejected) of each document.

    Lines are compared in lower case, digits as 0, other signs as blanks; lines
    shorter than ``least_chars`` then are left alone. A line that stands in more
    than ``most_docs`` documents of one source, and in more than ``most_share``
    of them, is removed from all of them, and a document that keeps less than
    ``least_kept`` of its characters is rejected.
    A null source is a source of its own. A null or empty text has no lines and
    is not rejected.
    """
    lines = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.posexplode(F.split("text", r"\r\n|[\n\r\u0085\u2028\u2029]")).alias("at", "line")).withColumn("n", F.length("line"))
    lines = lines.withColumn("norm", _norm("line"))
    key = F.when(F.length("norm") >= least_chars, F.sha2("norm", 256))
    keyed = lines.select("doc_id", "source", "at", "n", key.alias("key"))
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count_distinct("doc_id").alias("all_docs"))
    frequent = (
        keyed.filter("key IS NOT NULL")
        .groupBy("source", "key", "doc_id")
        .agg(F.lit(1).alias("one"))
        .groupBy("source", "key")
        .agg(F.count("*").alias("docs"))
        .join(sizes, "source")
        .filter((F.col("docs") > most_docs) & (F.col("docs") > most_share * F.col("all_docs")))
        .select("source", "key", F.lit(True).alias("common"))
    )
    per = (
        keyed.join(frequent, ["source", "key"], "left")
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("lines"),
            F.count_if("common").alias("removed"),
            F.sum("n").alias("all_chars"),
            F.sum(F.when(F.col("common"), 0).otherwise(F.col("n"))).alias("kept"),
        )
    )
    share = F.when(F.col("all_chars") > 0, F.col("kept") / F.col("all_chars")).otherwise(F.lit(1.0))
    return (
        docs.select("doc_id")
        .join(per, "doc_id", "left")
        .select("doc_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce(share, F.lit(1.0)).alias("kept_share"))
        .withColumn("rejected", F.col("kept_share") < least_kept)
    )
