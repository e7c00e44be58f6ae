"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of an edge; the label is the component's least node.

    A large star links each larger neighbour of a node to the least of its neighbourhood, a small star does so with the
    smaller ones. Both are one aggregation with partial sums and one join that may split hot nodes. Rounds grow with
    the logarithm of the longest path; each ends in a written table. Loops and repeated edges do no harm.
    """
    now = materialize(_down(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "components")
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).distinct()
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
        now = materialize(_large_star(now, mark[0] // HOT_SHARE), "components")
        now = materialize(_small_star(now, mark[0] // HOT_SHARE), "components")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


#: A node with more than one in so many edges is hot; there are at most twice as many hot nodes as this.
HOT_SHARE = 1000


def _with_least(rows: DataFrame, least: DataFrame, most: int) -> DataFrame:
    """rows joined with least (u, m, n) by u. The few nodes with more than `most` edges are broadcast: their rows stay where they are."""
    hot = F.broadcast(least.where(F.col("n") > most).select("u", "m"))
    calm = least.where(F.col("n") <= most).select("u", "m")
    return rows.join(hot, "u").unionByName(rows.join(hot.select("u"), "u", "left_anti").join(calm, "u"))


def _down(edges: DataFrame) -> DataFrame:
    """Different edges from the larger to the smaller node."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(down: DataFrame, most: int) -> DataFrame:
    both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return _down(_with_least(both.where(F.col("v") > F.col("u")), least, most).select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(down: DataFrame, most: int) -> DataFrame:
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _with_least(down, least, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.unionByName(least.select("u", F.col("m").alias("v"))))
