"""Degrees, histograms, adjacency and offsets of a clean edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import prefix_sum


def degrees(e: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(v, deg); vertices listed in ``isolated`` without an edge have degree 0."""
    d = e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"))
    if isolated is None:
        return d
    return isolated.select("v").distinct().join(d, "v", "full").select("v", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))


def degree_stats(e: DataFrame) -> DataFrame:
    """One row: mean, population deviation and maximum of the degrees."""
    return degrees(e).agg(F.round(F.avg("deg"), 6).alias("mean_deg"), F.round(F.stddev_pop("deg"), 6).alias("std_deg"), F.max("deg").alias("max_deg"))


def degree_histogram(e: DataFrame) -> DataFrame:
    return degrees(e).groupBy("deg").agg(F.count(F.lit(1)).alias("n"))


def graph_size(e: DataFrame) -> DataFrame:
    """One row: vertices, and edges counted in both directions."""
    return degrees(e).agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("deg"), F.lit(0)).alias("e"))


def csr_offsets(e: DataFrame) -> DataFrame:
    """(v, deg, off): where each vertex's neighbours begin in the edge list sorted by source."""
    return prefix_sum(degrees(e), "deg", "v")


def adjacency(e: DataFrame) -> DataFrame:
    """(v, deg, nbrs): sorted neighbour lists."""
    return e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"), F.array_sort(F.collect_list("dst")).alias("nbrs"))


def edges_by_neighbour_degree(e: DataFrame) -> DataFrame:
    """Edges with the neighbour's degree, sorted by (src, dst_deg, dst)."""
    d = degrees(e).select(F.col("v").alias("dst"), F.col("deg").alias("dst_deg"))
    return e.join(d, "dst").select("src", "dst", "dst_deg").orderBy("src", "dst_deg", "dst")


def frontier(d: DataFrame, level: int) -> DataFrame:
    """Vertices of exactly this degree."""
    return d.where(F.col("deg") == level)


def hindex_round(e: DataFrame, est: DataFrame) -> DataFrame:
    """(v, h): for each vertex the greatest h such that h neighbours have an estimate of h or more.

    Neighbours are first counted by estimate, which combines on the map side: a
    hub becomes at most as many rows as there are different estimates.
    """
    return hindex_of(e.join(est.select(F.col("v").alias("dst"), F.col("est").alias("ne")), "dst"))


def hindex_of(near: DataFrame) -> DataFrame:
    """hindex_round from edges (src, ne) that hold their neighbour's estimate."""
    return hindex_of_counts(near.groupBy("src", "ne").agg(F.count(F.lit(1)).alias("c")), "src").select("v", "h")


def hindex_of_counts(c: DataFrame, *keys: str) -> DataFrame:
    """(v, h, cnt) from the number c of a vertex's neighbours of each estimate ne, one row for each key; cnt: neighbours of an estimate of h or more."""
    runs = F.array_sort(F.collect_list(F.struct((-F.col("ne")).alias("k"), F.col("c").alias("c"))))
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("seen"), none.alias("h"), none.alias("cnt"))

    def step(a, x):
        seen = a.seen + x.c
        h = F.greatest(a.h, F.least(-x.k, seen))
        return F.struct(seen.alias("seen"), h.alias("h"), F.when(-x.k >= h, seen).otherwise(a.cnt).alias("cnt"))

    got = c.groupBy(*keys).agg(F.aggregate(runs, start, step).alias("r"))
    return got.select(F.col("src").alias("v"), F.col("r")["h"].alias("h"), F.col("r")["cnt"].alias("cnt"))
