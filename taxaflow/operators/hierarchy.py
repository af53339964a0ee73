"""Parent-child links of unknown depth to paths, depths, roots, descendants and cycles.

Level-wise frontier joins: level 0 holds the roots, each next level is one
equi-join of the last level with the links on the parent. A node is in exactly
one level as a child has one parent, so all levels together move each node once.
What no level reaches lies on a cycle or leads into one. Each level is written
to the shared folder, so lineage stays one join deep however deep the trees are,
and all levels are read back as one table. Links that led to a level are left
out once they are more than half of those kept, so that a deep tree doesn't
read all links for each of its levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaflow.runtime import SharedTables, has_rows


def parent_links(edges: DataFrame, prefix: str = "BELONGS_TO_") -> DataFrame:
    """(node_id, parent_id) of each id on any link; parent_id is null for an id that is nobody's child.

    A link is an edge whose type begins with ``prefix`` (case and outer blanks
    ignored) and whose ids are neither null nor blank. Of each child's links the
    one loaded last counts, then that of the largest edge_id; a null
    ``loaded_at`` is earlier than any other. The parent of a link that doesn't
    count is an id on a link all the same. Repeated edges count once. A link of
    a node to itself is a cycle.
    """
    kind = F.upper(F.regexp_replace("type", r"^\s+|\s+$", ""))
    at = F.struct("loaded_at", "edge_id")
    ends = F.array(
        F.struct(F.col("start_node_id").alias("node_id"), F.col("end_node_id").alias("parent_id"), at.alias("at")),
        F.struct(F.col("end_node_id").alias("node_id"), F.lit(None).alias("parent_id"), F.lit(None).alias("at")),
    )
    valid = edges.filter(kind.startswith(prefix) & F.col("start_node_id").rlike(r"\S") & F.col("end_node_id").rlike(r"\S"))
    return valid.select(F.explode(ends).alias("e")).groupBy(F.col("e.node_id").alias("node_id")).agg(F.max_by("e.parent_id", "e.at").alias("parent_id"))


def hierarchy(links: DataFrame, paths: bool = True) -> DataFrame:
    """(node_id, parent_id, root_id, depth, path) of each id of ``parent_links``.

    ``path`` (left out if ``paths`` is false) runs from the root to the node.
    Roots have depth 0, themselves as root_id and a null parent_id. Nodes on a
    cycle or leading into one have root_id '', depth -1 and a null path. No
    links give no rows.
    """
    tables = SharedTables(links.sparkSession, "hierarchy")
    path = lambda c: [c.alias("path")] if paths else []
    links = tables.save(links.select("node_id", "parent_id"), "links")
    depth0 = F.lit(0).alias("depth")
    root = links.filter("parent_id IS NULL").select("node_id", "parent_id", F.col("node_id").alias("root_id"), depth0, *path(F.array("node_id")))
    last = tables.save(root, "levels/0")
    left = links.filter("parent_id IS NOT NULL")
    kept = left.count()
    used, level = 0, 0
    while n := last.count() if kept > used else 0:
        f = last.select(F.col("node_id").alias("parent_id"), "root_id", "depth", *path(F.col("path")))
        reached = f.join(left, "parent_id").select("node_id", "parent_id", "root_id", (F.col("depth") + 1).alias("depth"), *path(F.concat("path", F.array("node_id"))))
        used += n if level else 0
        level += 1
        last = tables.save(reached, f"levels/{level}")
        if 2 * used > kept:
            left = tables.save(left.join(tables.all("levels", root.schema).select("node_id"), "node_id", "left_anti"), f"left{level}")
            kept, used = left.count(), 0
    trees = tables.all("levels", root.schema)
    lost = left.join(trees.select("node_id"), "node_id", "left_anti").select(
        "node_id", "parent_id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), *path(F.lit(None).cast("array<string>"))
    )
    return trees.union(lost)


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for each node and each of its ancestors, from ``hierarchy`` with paths."""
    return (
        nodes.filter("depth > 0")
        .select("node_id", "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))).alias("at", "ancestor_id"))
        .select("ancestor_id", "node_id", (F.col("depth") - F.col("at")).alias("distance"))
    )


def cycles(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cycle_id, node_id): the nodes that lie on a cycle; cycle_id is its smallest node.

    Of the nodes that no level reached those are peeled off that no other such
    node has as parent, until none goes; the rest are cycles, labelled by
    pointer doubling, with as many steps as the logarithm of the longest.
    """
    tables = SharedTables(links.sparkSession, "cycles")
    left = tables.save(nodes.filter("depth = -1").select("node_id").join(links, "node_id").select("node_id", "parent_id"), "left0")
    n, i = left.count(), 0
    while True:
        i += 1
        left = tables.save(left.join(left.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_semi"), f"left{i}")
        tables.drop(f"left{i - 1}")
        m = left.count()
        if m == n:
            break
        n = m
    hop = left.select("node_id", F.col("parent_id").alias("next"), F.least("node_id", "parent_id").alias("least"))
    size, i = 1, 0
    while size < n:
        hop = tables.save(
            hop.join(hop.select(F.col("node_id").alias("next"), F.col("next").alias("far"), F.col("least").alias("far_least")), "next").select(
                "node_id", F.col("far").alias("next"), F.least("least", "far_least").alias("least")
            ),
            f"hop{i}",
        )
        # one full turn has been covered once no label changes any more
        turned = hop.select(F.col("node_id").alias("next"), F.col("least").alias("of_next")).join(hop, "next").filter("least <> of_next")
        if not has_rows(turned):
            break
        size, i = size * 2, i + 1
    return hop.select(F.col("least").alias("cycle_id"), "node_id")
