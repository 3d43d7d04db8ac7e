"""Connected components of links between documents, as DataFrame operations (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))


def _state(edges: DataFrame) -> tuple:
    """Number of edges and two sums of hashes: alike only if a round changed nothing."""
    mixed = [F.sum(F.xxhash64("u", "v", F.lit(k)) % (1 << 40)) for k in (1, 2)]
    return tuple(edges.agg(F.count("*"), *mixed).first())


#: Pieces into which every node's edges are dealt for a join; a star with more is for the join itself to split.
SALTS = 4


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """`edges` (u, v) with the m of u, by a join in which a node's edges go to SALTS tasks."""
    dealt = edges.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return dealt.join(least.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["u", "_salt"]).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of `edges` (two long columns); component: the smallest node reachable.

    Large star: each node ties its larger neighbours to its smallest neighbour; small star: it ties its smaller ones.
    A node's smallest neighbour is a partial aggregate joined back in pieces, so a star's centre may hold any share of
    the edges. Rounds grow with the logarithm of the longest chain. Self-links are ignored as links; nulls
    are not allowed; no edges give no rows."""
    u, v = (F.col(c) for c in edges.columns)
    nodes = None
    edges = edges.select(u.cast("long").alias("u"), v.cast("long").alias("v"))
    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        both = _both(edges)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every edge now points from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.inline(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        edges = stored(small.filter("u <> v").distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v"), F.col("v")).distinct())
