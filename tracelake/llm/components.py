"""Connected components of a graph given as edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.skew import skew_join
from tracelake.runtime import Scratch


def _with_least(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m): of each node ``u`` the smallest among itself and its ``v``. A hub's pairs stay where they are: hubs are
    few (see ``skew_join``), so their minima are broadcast."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    return skew_join(pairs, least.select("u", "m"), ["u"], counts=least.select("u", "n"), total=total)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node ties its larger neighbours to the smallest node it knows."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _with_least(both, 2 * n).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node ties its smaller neighbours, and itself, to the smallest of them. Edges have a < b."""
    tied = _with_least(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), n)
    moved = tied.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
    return moved.unionByName(edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("a")).select("a", F.col("u").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    """Number and checksum of edges: what a round that changes nothing leaves as it was."""
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node of its component, for every node that has an edge (columns a, b).

    Large and small stars in turn (Kiveris et al. 2014) end in one star per component after a number of rounds that
    grows with the logarithm of the longest chain. Hubs, nodes with over a thousandth of all edges, are not dealt to one
    task. Each round is written to the shared folder, which cuts the lineage; the round before is then deleted. No node,
    edge or component reaches the driver, only an edge count.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    now = scratch.keep(now, "edges")
    mark = _mark(now)
    while True:
        large = scratch.keep(_large_star(now, mark[0]), "edges")
        after = scratch.keep(_small_star(large, mark[0]), "edges")
        scratch.drop(now)
        scratch.drop(large)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
