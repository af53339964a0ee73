"""Splits that keep related records together.

Records are tied by their paper, source slug and picture, directly or through
other records. The ties form a graph of entities (papers, slugs, pictures), far
smaller than the records: an edge is a distinct (paper, slug) or (slug, picture)
pair, and pictures of one slug only are left out as they tie nothing.

Components come from Borůvka's method: each component takes its smallest
outgoing edge, the chosen edges are added to the forest (a persisted table) and
contracted by pointer doubling, and the remaining edges are relabelled, freed of
loops and reduced to the smallest per pair of components. The number of
components at least halves with every round.

The roots are then put into bands by the number of records (powers of two), and
dealt systematically to the splits within each band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from taxaflow.runtime import SharedTables, has_rows

GOLDEN = 0.6180339887498949


def entities(records: DataFrame) -> DataFrame:
    """(rec_id, paper, slug, pic) as node names; a null paper or id gives nulls."""
    parts = F.split("id", "__")
    return records.select(
        "rec_id",
        F.concat(F.lit("p:"), "paper").alias("paper"),
        F.concat(F.lit("s:"), F.get(parts, F.lit(0))).alias("slug"),
        F.concat(F.lit("i:"), F.element_at(parts, -1)).alias("pic"),
    )


def ties(ents: DataFrame) -> DataFrame:
    """Distinct edges (a, b) between entities that stand in one record."""
    ps = ents.filter("paper IS NOT NULL AND slug IS NOT NULL").select(F.col("paper").alias("a"), F.col("slug").alias("b")).distinct()
    pics = ents.filter("slug IS NOT NULL").groupBy(F.col("pic").alias("b")).agg(F.min("slug").alias("lo"), F.max("slug").alias("hi"))
    shared = pics.filter("lo <> hi").select("b")
    sp = ents.select(F.col("slug").alias("a"), F.col("pic").alias("b")).join(shared, "b", "left_semi").select("a", "b").distinct()
    return ps.union(sp)


def _smallest(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.min(F.struct("a", "b")).alias("e")).select(*by, "e.a", "e.b")


def spanning_forest(edges: DataFrame, tables: SharedTables) -> tuple[DataFrame, DataFrame]:
    """(labels, forest): (node, root) of every node on an edge, and the forest's edges (a, b)."""
    e = tables.save(edges.filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "a", "b"), "edges0")
    labels = e.select(F.col("u").alias("node")).union(e.select("v")).distinct().select("node", F.col("node").alias("root"))
    empty = edges.sparkSession.createDataFrame([], edges.select("a", "b").schema)
    labels = tables.save(labels, "labels-1")
    forest, n = [empty], 0
    while has_rows(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"), "a", "b"))
        # in a contracted graph, the other end of the smallest edge comes with it
        best = tables.save(
            both.groupBy("u").agg(F.min(F.struct("a", "b", "v")).alias("m")).select("u", F.col("m.v").alias("v"), "m.a", "m.b"), f"best{n}"
        )
        forest.append(best.select("a", "b").distinct())
        # two components that chose each other: the smaller name is the root
        back = best.select(F.col("u").alias("v"), F.col("v").alias("back"))
        hop = best.join(back, "v").select("u", F.when((F.col("back") == F.col("u")) & (F.col("u") < F.col("v")), F.col("u")).otherwise(F.col("v")).alias("p"))
        k = 0
        while True:
            hop = tables.save(hop, f"hop{n}_{k}")
            far = hop.select(F.col("u").alias("p"), F.col("p").alias("q"))
            nxt = hop.join(far, "p").select("u", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved"))
            nxt = tables.save(nxt, f"nxt{n}_{k}")
            hop = nxt.select("u", "p")
            k += 1
            if not has_rows(nxt.filter("moved")):
                break
        star = hop.withColumnRenamed("p", "r")
        labels = tables.save(
            labels.join(star.withColumnRenamed("u", "root"), "root", "left").select("node", F.coalesce("r", "root").alias("root")), f"labels{n}"
        )
        moved = e.join(star, "u").select(F.col("r").alias("u2"), "v", "a", "b").join(star.withColumnRenamed("u", "v"), "v").select(F.col("u2").alias("u"), F.col("r").alias("v"), "a", "b")
        e = tables.save(_smallest(moved.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "a", "b"), "u", "v"), f"edges{n + 1}")
        for done in (*(f"hop{n}_{i}" for i in range(k)), *(f"nxt{n}_{i}" for i in range(k)), f"edges{n}", f"labels{n - 1}"):
            tables.drop(done)
        n += 1
    return labels, reduce(DataFrame.union, forest)


def components(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(record components, entity labels, forest).

    The first has (rec_id, root) for each row of ``records``; a record without
    paper and id is alone. Repeated rows are in one component as they share all.
    """
    tables = SharedTables(records.sparkSession, "splits")
    ents = entities(records)
    labels, forest = spanning_forest(ties(ents), tables)
    alone = F.concat(F.lit("r:"), F.coalesce(F.col("rec_id").cast("string"), F.lit("")))
    by = ents.select("rec_id", F.coalesce("slug", "paper", alone).alias("node"))
    out = by.join(labels, "node", "left").select("rec_id", F.coalesce("root", "node").alias("root"))
    return out, labels, forest


def tied_papers(records: DataFrame) -> DataFrame:
    """(paper_a, paper_b) for each two different papers in one component, paper_a < paper_b."""
    _, labels, _ = components(records)
    p = labels.filter("startswith(node, 'p:')").select("root", F.substring("node", 3, 2**30).alias("paper"))
    return p.select("root", F.col("paper").alias("paper_a")).join(p.select("root", F.col("paper").alias("paper_b")), "root").filter("paper_a < paper_b").select("paper_a", "paper_b")


def paper_classes(records: DataFrame) -> DataFrame:
    """(paper, class_id, papers, links) of each paper on a tie: its class by the smallest paper, how many papers that has, how many ties the paper itself.

    The same classes as ``tied_papers``, whose pairs grow with the square of a
    class, in a row for each paper.
    """
    tables = SharedTables(records.sparkSession, "classes")
    edges = tables.save(ties(entities(records)), "ties")
    labels, _ = spanning_forest(edges, tables)
    p = labels.filter("startswith(node, 'p:')")
    classes = p.groupBy("root").agg(F.min("node").alias("class_id"), F.count("*").alias("papers"))
    links = edges.filter("startswith(a, 'p:')").groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    plain = lambda c: F.substring(c, 3, 2**30).alias("paper" if c == "node" else c)
    return p.join(classes, "root").join(links, "node").select(plain("node"), plain("class_id"), "papers", "links")


def forest(records: DataFrame) -> DataFrame:
    """(a, b): the edges of the spanning forest between papers (``p:``), slugs (``s:``) and pictures (``i:``)."""
    return components(records)[2]


def _rank(roots: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0 within each band in hash order, without a window over a whole band."""
    r = roots.withColumn("cell", F.pmod(F.xxhash64("root"), F.lit(1024)))
    cells = r.groupBy("band", "cell").agg(F.count("*").alias("n"))
    before = cells.select("band", "cell", F.coalesce(F.sum("n").over(W.partitionBy("band").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("band", "cell").orderBy(F.xxhash64("root"), "root"))
    return r.withColumn("inside", inside).join(before, ["band", "cell"]).withColumn("rank", F.col("before") + F.col("inside") - 1)


def split(records: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """(rec_id, root, split) for each record; all records of a component have one split.

    ``shares`` are the proportions (by default 0.8, 0.1, 0.1), the largest first.
    A component with more than half the records of the smallest split goes to
    the first split, whose share in the dealing is lessened by as many records.
    In each band of sizes the rank-th root goes to the split in whose interval
    the fraction of (rank + 0.5) times the golden ratio falls: any run of ranks
    is spread over the splits by their shares. An empty table gives no rows.
    """
    shares = shares or {"train": 0.8, "validation": 0.1, "test": 0.1}
    names, total = list(shares), sum(shares.values())
    parts = [shares[n] / total for n in names]
    comp, _, _ = components(records)
    tables = SharedTables(records.sparkSession, "split")
    roots = tables.save(comp.groupBy("root").agg(F.count("*").alias("n")), "roots")
    limit = min(parts) / 2
    sums = roots.agg(F.sum("n").alias("all")).collect()[0]["all"] or 0
    big = F.col("n") > limit * sums
    held = roots.filter(big).agg(F.sum("n")).collect()[0][0] or 0
    left = max(sums - held, 1)
    first = max(parts[0] * sums - held, 0) / left
    rest = sum(parts[1:]) or 1
    scaled = [first, *((1 - first) * p / rest for p in parts[1:])]
    at, chosen, edge = F.expr(f"(rank + 0.5D) * {GOLDEN}D - floor((rank + 0.5D) * {GOLDEN}D)"), None, 0.0
    for n, p in zip(names[:-1], scaled, strict=False):
        edge += p
        chosen = F.when(at < edge, n) if chosen is None else chosen.when(at < edge, n)
    chosen = F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1])
    dealt = _rank(roots.filter(~big).withColumn("band", F.floor(F.log2("n")))).select("root", chosen.alias("split"))
    plan = dealt.union(roots.filter(big).select("root", F.lit(names[0]).alias("split")))
    return comp.join(plan, "root").select("rec_id", "root", "split")
