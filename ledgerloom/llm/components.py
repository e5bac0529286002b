"""Connected components of a graph given as rows, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_spread, stored, stored_and


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """edges (u, v) with m, the least v of u. A u that very many edges share, as the smallest id of a
    large group does, is in no single task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
    return join_spread(edges, least, ["u"], "_n", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Join each node's larger neighbours to its smallest one."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Join each node and its smaller neighbours to the smallest of these. edges: u > v."""
    found = _with_least(edges, total)
    near = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return found.select(near.alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each node can reach. edges: u, v (long).

    Only nodes with an edge to another appear; loops, repeated edges and edges with a null are
    ignored. Each round is a few joins on nodes, stored in the shared folder; the number of rounds
    grows with the logarithm of the longest path. Nothing but a checksum comes to the driver.
    """
    figures = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    larger, smaller = F.greatest("u", "v").cast("long"), F.least("u", "v").cast("long")
    now, mark = stored_and(edges.select(larger.alias("u"), smaller.alias("v")).filter("u <> v").distinct(), *figures)
    before = None
    while mark != before and mark[0]:
        before = mark
        star = _large_star(now, mark[0])
        if mark[0] > BROADCAST_ROWS:  # read twice then
            star = stored(star)
        now, mark = stored_and(_small_star(star, mark[0]), *figures)
    ids = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
