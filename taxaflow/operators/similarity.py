"""Class-capped exact nearest neighbours, weighted votes, and reports on them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taxaflow.functions.naming import output_name, safe

BLOCK = 2048


def capped(samples: DataFrame, by: list[str], order: list[Column], most: int = 8) -> DataFrame:
    """The first ``most`` rows of each class in ``order``, so that no class dominates an index."""
    return samples.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_r") <= most).drop("_r")


def neighbours(queries: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, sim, rank): the ``k`` rows of ``index`` (id, vector) with the largest inner product.

    ``queries`` (query_id, vector) are a stated query set: they are divided by a
    hash into blocks of about ``BLOCK``, each block as a matrix to all
    partitions of the index, which keep the best ``k`` per query; the bests are
    then ranked per query. Exact; ties go to the smaller id; an index row never
    answers itself. Repeated queries are one; an id with several vectors gets the
    best of all of them.
    """
    spark, out = index.sparkSession, None
    fields = "query_id long, id long, sim double"
    rows = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>")).filter("query_id IS NOT NULL AND vector IS NOT NULL").distinct()
    blocks = -(-rows.count() // BLOCK)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(max(blocks, 1))))
    for block in range(blocks):
        part = rows.filter(F.col("block") == block).orderBy("query_id", "vector").collect()
        if not part:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["query_id"] for r in part]), np.array([r["vector"] for r in part], dtype=np.float64)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qid, q = shared.value
            ids, sims = np.zeros((len(qid), 0), np.int64), np.zeros((len(qid), 0))
            for b in batches:
                if not len(b):
                    continue
                own = b["id"].to_numpy(np.int64)
                s = q @ np.stack(b["vector"].to_numpy()).astype(np.float64).T
                s[own[None] == qid[:, None]] = -np.inf
                ids, sims = np.concatenate((ids, np.broadcast_to(own, s.shape)), 1), np.concatenate((sims, s), 1)
                if ids.shape[1] > k:
                    keep = np.lexsort((ids, -sims), axis=1)[:, :k]
                    ids, sims = np.take_along_axis(ids, keep, 1), np.take_along_axis(sims, keep, 1)
            n = ids.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(qid, n), "id": ids.ravel(), "sim": sims.ravel()})

        found = index.select(F.col("id").cast("long"), F.col("vector").cast("array<double>")).filter("id IS NOT NULL AND vector IS NOT NULL").mapInPandas(search, fields).filter("sim > double('-infinity')")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], fields)
    out = out.groupBy("query_id", "id").agg(F.max("sim").alias("sim"))
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("sim"), "id"))).filter(F.col("rank") <= k)


def votes(found: DataFrame, labels: DataFrame, by: list[str], top: int = 3) -> DataFrame:
    """(query_id, by..., share, place) of the ``top`` classes per query.

    ``labels`` has (id, by..., label_confidence). A neighbour's weight is its
    similarity, not below 0, by its label's confidence; shares are of the sum
    plus 1e-12. Ties are ordered by class.
    """
    w = found.join(labels, "id").withColumn("w", F.greatest("sim", F.lit(0.0)) * F.col("label_confidence"))
    c = w.groupBy("query_id", *by).agg(F.sum("w").alias("w"))
    q = W.partitionBy("query_id")
    c = c.withColumn("share", F.col("w") / (F.sum("w").over(q) + 1e-12)).withColumn("place", F.row_number().over(q.orderBy(F.desc("w"), *by)))
    return c.filter(F.col("place") <= top).select("query_id", *by, "share", "place")


def predictions(ranked: DataFrame, label: str, least: float = 0.35) -> DataFrame:
    """(query_id, best, confidence, uncertain, top_json): one row per query from ``votes``."""
    top = F.array_sort(F.collect_list(F.struct("place", F.col(label).alias("label"), F.format_number("share", 4).alias("share"))))
    p = ranked.groupBy("query_id").agg(F.min_by(label, "place").alias("best"), F.max("share").alias("confidence"), top.alias("t"))
    return p.select("query_id", "best", "confidence", (F.col("confidence") < least).alias("uncertain"), F.to_json("t").alias("top_json"))


def named_predictions(ranked: DataFrame, targets: DataFrame, least: float = 0.35) -> DataFrame:
    """(sampling_point, target_path, best_genus, best_species, confidence, top3_json, output_path): one row per target.

    ``ranked`` is ``votes`` by genus and species; ``targets`` has (query_id,
    path), paths relative to their root. The sampling point is the first folder,
    RAIZ if there is none. The output's name holds the target's name, the best
    genus and species, ``UNCERTAIN_`` before them if the confidence is below
    ``least``, and the confidence in percent. A target without votes is UNKNOWN.
    """
    top = F.array_sort(F.collect_list(F.struct("place", "genus", "species", F.round("share", 4).alias("share"))))
    best = ranked.groupBy("query_id").agg(
        F.min_by("genus", "place").alias("best_genus"), F.min_by("species", "place").alias("best_species"), F.max("share").alias("confidence"), top.alias("t")
    )
    r = targets.join(best, "query_id", "left").withColumns(
        {
            "best_genus": F.coalesce("best_genus", F.lit("UNKNOWN")),
            "best_species": F.coalesce("best_species", F.lit("sp")),
            "confidence": F.coalesce("confidence", F.lit(0.0)),
            "parts": F.split("path", "/"),
        }
    )
    file = F.element_at("parts", -1)
    stem = F.when(file.contains("."), F.regexp_replace(file, r"\.[^.]*$", "")).otherwise(file)
    ending = F.lower(F.regexp_extract(file, r"(\.[^.]*)$", 1))
    point = F.when(F.size("parts") > 1, F.get("parts", F.lit(0))).otherwise("RAIZ")
    unnamed = lambda c: F.when(F.col("best_genus") == "UNKNOWN", F.regexp_replace(c, "UNKNOWN_sp__conf", "UNKNOWN__conf")).otherwise(c)
    out = F.concat(safe(point), F.lit("/"), unnamed(output_name(safe(stem), F.col("best_genus"), F.col("best_species"), F.col("confidence"), ending, least)))
    return r.select(
        point.alias("sampling_point"), F.col("path").alias("target_path"), "best_genus", "best_species", F.format_number("confidence", 4).alias("confidence"),
        F.to_json(F.coalesce("t", F.array().cast("array<struct<place:int,genus:string,species:string,share:double>>"))).alias("top3_json"), out.alias("output_path"),
    )


def few_shot(queries: DataFrame, index: DataFrame, labels: DataFrame, shots: Iterable[int] = (1, 5, 10), k: int = 5) -> DataFrame:
    """(shots, queries, hits, accuracy): how often the first vote is right if each class has so many rows in the index.

    ``index`` is (id, vector), ``labels`` (id, label); of each class the rows
    with the smallest ids stay. Queries are labelled by their own id.
    """
    out = None
    for n in shots:
        kept = capped(labels, ["label"], [F.col("id")], n)
        best = votes(neighbours(queries, index.join(kept.select("id"), "id"), k), kept.select("id", "label", F.lit(1.0).alias("label_confidence")), ["label"], 1)
        truth = labels.select(F.col("id").alias("query_id"), F.col("label").alias("truth"))
        r = best.join(truth, "query_id").agg(F.count("*").alias("queries"), F.count_if(F.col("label") == F.col("truth")).alias("hits"))
        r = r.select(F.lit(n).alias("shots"), "queries", "hits", F.when(F.col("queries") > 0, F.col("hits") / F.col("queries")).alias("accuracy"))
        out = r if out is None else out.union(r)
    return out


def rollup_counts(rows: DataFrame, group: str, item: str) -> DataFrame:
    """(group, item, n, total): counts per group and item, with the group's total."""
    c = rows.groupBy(group, item).agg(F.count("*").alias("n"))
    return c.withColumn("total", F.sum("n").over(W.partitionBy(group)))


def markdown(counts: list, group: str, item: str) -> str:
    """A summary as text, most frequent item first, from the collected rows of ``rollup_counts``."""
    out, groups = [], {}
    for r in counts:
        groups.setdefault(r[group], []).append(r)
    for g in sorted(groups, key=str):
        out.append(f"## {g} ({groups[g][0]['total']})\n")
        out += [f"- {r[item]}: {r['n']}" for r in sorted(groups[g], key=lambda r: (-r["n"], str(r[item])))]
        out.append("")
    return "\n".join(out)


def confusion(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n)."""
    return rows.groupBy(truth, guess).agg(F.count("*").alias("n"))


def scores(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, precision, recall, f1, support) of each label, from one aggregation per side."""
    t = rows.groupBy(F.col(truth).alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col(truth) == F.col(guess)).alias("hit"))
    g = rows.groupBy(F.col(guess).alias("label")).agg(F.count("*").alias("guessed"))
    r = t.join(g, "label", "full").select("label", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "hit", "guessed")))
    p, c = F.when(F.col("guessed") > 0, F.col("hit") / F.col("guessed")).otherwise(0.0), F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0)
    r = r.withColumn("precision", p).withColumn("recall", c)
    return r.withColumn("f1", F.when(p + c > 0, 2 * p * c / (p + c)).otherwise(0.0)).select("label", "precision", "recall", "f1", "support")


def oversampled(rows: DataFrame, by: str, least: int = 20) -> DataFrame:
    """``rows`` with ``copy``: rows of classes below ``least`` repeated until the class has at least as many."""
    n = rows.groupBy(by).agg(F.count("*").alias("_n"))
    times = F.greatest(F.ceil(F.lit(least) / F.col("_n")), F.lit(1)).cast("int")
    return rows.join(n, by).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_n")


def embedded(images: DataFrame, load) -> DataFrame:
    """(image_id, vector) by a model of the caller's, vectors of unit length.

    ``load()`` runs once per Python worker and returns a function from an
    image to a vector. Images that it can't take (an error, or a vector of
    zeros) are left out instead of standing in the index as zeros.
    """
    from taxaflow.operators.vision import pixels

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            ids, vecs = [], []
            for i, h, w, c, d in zip(b["image_id"], b["height"], b["width"], b["channels"], b["data"], strict=True):
                try:
                    v = np.asarray(model(pixels(d, int(h), int(w), int(c))), np.float64)
                except Exception:  # noqa: BLE001  one bad image must not end the job
                    continue
                n = np.linalg.norm(v)
                if n > 0:
                    ids.append(int(i))
                    vecs.append((v / n).astype(np.float32))
            yield pd.DataFrame({"image_id": pd.Series(ids, dtype="int64"), "vector": pd.Series(vecs, dtype=object)})

    return images.select("image_id", "height", "width", "channels", "data").mapInPandas(run, "image_id long, vector array<float>")
