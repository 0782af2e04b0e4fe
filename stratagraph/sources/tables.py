"""Graphs derived from the relational tables. Ids of bipartite graphs are 2k and 2k + 1, so that the sides don't meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)


def customer_part(spark: SparkSession, sf_dir: str, distinct: bool = True) -> DataFrame:
    """Directed customer -> part edges of all orders; repeated ones too, unless distinct."""
    li = _table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("o"), "l_partkey")
    o = _table(spark, sf_dir, "orders", F.col("o_orderkey").alias("o"), "o_custkey")
    e = li.join(o, "o").select((F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"))
    return e.distinct() if distinct else e


def supplier_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem", (F.col("l_suppkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()


def co_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on the same order, smaller id first; an order has few lines, so the join stays local to it."""
    li = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").distinct()
    a, b = li.select("l_orderkey", F.col("l_partkey").alias("src")), li.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return a.join(b, "l_orderkey").where("src < dst").select("src", "dst").distinct()


def co_purchase_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, x): a part and the different parts of an order that it is on, itself among them, for each order of two parts or more. Orders are gathered where their lines are dealt, once."""
    li = _table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").where("l_orderkey is not null and l_partkey is not null")
    orders = li.repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey").cast("long")).alias("x")).where(F.size("x") > 1)
    return orders.select(F.explode("x").alias("v"), "x")


def user_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and event types; a type's id is a hash of its name, kept odd."""
    t = (F.xxhash64("event_type").bitwiseAND(F.lit((1 << 40) - 1)) * 2 + 1).alias("dst")
    return _table(spark, sf_dir, "events", (F.col("user_id") * 2).alias("src"), t).distinct()


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and the addresses that they link to, ids as above."""
    p = _table(spark, sf_dir, "pages", "page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("href"))
    return p.select((F.col("page_id") * 2).alias("src"), (F.xxhash64("href").bitwiseAND(F.lit((1 << 40) - 1)) * 2 + 1).alias("dst")).distinct()
