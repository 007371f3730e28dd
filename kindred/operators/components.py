"""Connected components of an edge table, labelled by their smallest node.

Alternates the large-star and small-star steps of Kiveris et al. (2014) until
every component is a star around its smallest node.  All state is in edge
tables; the driver sees only whether the last table is a set of stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.skew import HOT_ROWS, HOT_SHARE
from kindred.sources.scratch import Scratch


def _relink(pairs: DataFrame, n_pairs: int, hot_rows: int, scratch: Scratch) -> DataFrame:
    """``u, v, low`` where ``low`` is the smallest of ``u`` and its ``v``.

    Nodes with very many neighbours (at most ``HOT_SHARE``) are joined by
    broadcast, so their neighbours are never shuffled to one task.
    """
    lows = (
        pairs.groupBy("u")
        .agg(F.min("v").alias("low"), F.count("*").alias("degree"))
        .select("u", F.least("u", "low").alias("low"), "degree")
    )
    share = max(hot_rows, n_pairs // HOT_SHARE)
    if n_pairs <= share:
        return pairs.join(lows.drop("degree"), "u")
    lows = scratch.keep(lows, "lows")
    hot = F.broadcast(lows.where(F.col("degree") > share).select("u", "low"))
    return pairs.join(hot, "u").unionByName(
        pairs.join(hot, "u", "left_anti").join(lows.where(F.col("degree") <= share).drop("degree"), "u")
    )


def small_star(edges: DataFrame, n_edges: int, hot_rows: int, scratch: Scratch) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    linked = _relink(edges, n_edges, hot_rows, scratch)
    return (
        linked.select(F.explode(F.array("u", "v")).alias("u"), F.col("low").alias("v"))
        .where("u <> v")
        .distinct()
    )


def large_star(edges: DataFrame, n_edges: int, hot_rows: int, scratch: Scratch) -> DataFrame:
    """Connect the larger neighbours of each node to its smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = _relink(both, 2 * n_edges, hot_rows, scratch)
    return linked.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()


def _shape(edges: DataFrame) -> tuple[bool, int]:
    """Whether all components are stars, and the number of edges.

    In a star no node has two parents or is both child and parent.
    """
    ends = F.expr("explode(array(struct(u as node, 1 as child, 0 as parent), struct(v as node, 0 as child, 1 as parent)))")
    nodes = (
        edges.select(ends.alias("end"))
        .groupBy("end.node")
        .agg(F.sum("end.child").alias("parents"), F.max("end.parent").alias("parent"))
    )
    other = F.bool_or(F.expr("parents > 1 or (parents = 1 and parent = 1)"))
    found = nodes.agg(F.coalesce(other, F.lit(False)), F.coalesce(F.sum("parents"), F.lit(0))).first()
    return not found[0], found[1]


def connected_components(
    links: DataFrame, scratch: Scratch, a: str = "a", b: str = "b", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """``node, root`` for every node of ``links`` that is not itself a root.

    ``root`` is the smallest node of the component.  Every edge table is
    written to the shared folder, and deleted once the next one exists.
    """
    edges = scratch.keep(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(),
        "edges",
    )
    n_edges, steps, stars = edges.count(), [small_star], False
    while not stars:
        for step in steps:
            linked = scratch.keep(step(edges, n_edges, hot_rows, scratch), step.__name__)
            scratch.drop(edges)
            edges = linked
        steps = [large_star, small_star]
        stars, n_edges = _shape(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
