"""Cleaning and relabelling of edge lists: frames (src bigint, dst bigint).

The clean graph: no nulls, no self-loops, both directions of every edge, no
duplicates, ids unchanged. Vertices are the endpoints, plus an optional list of isolated ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import numbered


def remove_self_loops(e: DataFrame) -> DataFrame:
    return e.where("src <> dst")


def symmetrize(e: DataFrame, dedupe: bool = True) -> DataFrame:
    """Both directions; a multigraph keeps repeated edges (dedupe=False)."""
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct() if dedupe else both


def single_directed(e: DataFrame) -> DataFrame:
    """One row (src < dst) for each undirected edge."""
    return e.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def clean(e: DataFrame, dedupe: bool = True) -> DataFrame:
    """Casts, drops nulls and self-loops, symmetrizes; undirected duplicates go before the second direction is made."""
    e = e.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    if dedupe:
        one = single_directed(e)
        return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return symmetrize(remove_self_loops(e), False)


def vertices(e: DataFrame) -> DataFrame:
    """Distinct sources of a symmetric edge list."""
    return e.select(F.col("src").alias("v")).distinct()


def dense_mapping(e: DataFrame) -> DataFrame:
    """(v, idx): numbers 0..n-1 in the order of ids."""
    return numbered(vertices(e), "v")


def degree_desc_mapping(e: DataFrame) -> DataFrame:
    """(v, deg, idx): numbers by degree, largest first, ties by id."""
    return numbered(e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg")), F.desc("deg"), "v")


def relabel(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with ids replaced by mapping.idx."""
    a = mapping.select(F.col("v").alias("src"), F.col("idx").alias("s"))
    b = mapping.select(F.col("v").alias("dst"), F.col("idx").alias("d"))
    return e.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def restore(e: DataFrame, mapping: DataFrame) -> DataFrame:
    """The inverse of relabel, sorted by (src, dst)."""
    back = mapping.select(F.col("idx").alias("v"), F.col("v").alias("idx"))
    return relabel(e, back).orderBy("src", "dst")


def prepare_input(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean, densely numbered edges sorted by (src, dst), and the mapping."""
    c = clean(e)
    m = dense_mapping(c)
    return relabel(c, m).orderBy("src", "dst"), m
