"""Iteration control: lineage cuts in the shared checkpoint folder, and distributed numbering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def prepare(spark: SparkSession) -> None:
    """Takes the session's checkpoint folder; sets a local one only where none is named and the master is local, else it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (sc.master or "").split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratagraph-"))


def settle(df: DataFrame) -> DataFrame:
    """Writes the frame to the checkpoint folder and cuts its lineage; a lost executor loses nothing."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """Like ``settle``, for large frames: columns are encoded, a few bytes a row where ids lie together."""
    prepare(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The tables of an iteration in the shared checkpoint folder: each written by one job, which also gives
    aggregates of its rows (counted once a result task, so a lost executor doesn't matter); all deleted by ``clear``."""

    def __init__(self, spark: SparkSession):
        prepare(spark)
        self.spark, self.at, self.number = spark, f"{spark.sparkContext.getCheckpointDir()}/rounds-{uuid.uuid4().hex}", 0
        self.names: list[str] = []

    def keep(self, df: DataFrame, buckets: int = 0, **aggregates: Column) -> tuple[DataFrame, dict]:
        """buckets: the table is bucketed by v, so that joins on v move only their other side; frames dealt like that already are written as they are."""
        seen = Observation()
        path = f"{self.at}/{self.number}"
        self.number += 1
        df = df.observe(seen, *[c.alias(k) for k, c in aggregates.items()])
        if buckets:
            self.names.append(name := f"stratagraph_{uuid.uuid4().hex}")
            df.write.bucketBy(buckets, "v").option("path", path).format("parquet").saveAsTable(name)
            return self.spark.table(name), seen.get
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), seen.get

    def clear(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        delete(self.spark, self.at)


#: Rows of a few numbers each that may be broadcast; beyond, joins are shuffled.
BROADCAST_ROWS = 500_000
#: Edges of a bucket of a stored edge list, about.
BUCKET_EDGES = 4_000_000


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def met(df: DataFrame) -> DataFrame:
    """A side that a join meets where its rows are dealt. Many rounds have joins that Spark would broadcast, each by way of the driver."""
    return df.hint("shuffle_hash")


class Dealt:
    """Edges stored once, as a table bucketed and sorted by one end in the shared checkpoint folder: all rounds read it without an exchange
    of the edges, and a lost executor loses nothing. The edges of a hub are in several lots.

    A vertex of more than ``most`` edges (at least 100,000, and so many that such vertices are fewer than BROADCAST_ROWS) has a
    lot for each ``most`` of them; what is joined to the edges by ``spread`` goes to all lots of its vertex.
    """

    def __init__(self, e: DataFrame, key: str, edges: int, most: int = 100_000, largest: int | None = None):
        """Columns besides src and dst are kept. largest: the most edges of one vertex, if that is known."""
        spark, other = e.sparkSession, "dst" if key == "src" else "src"
        prepare(spark)
        most = max(most, -(-edges // BROADCAST_ROWS))
        self.spark, self.key, self.hubs, self.has_hubs = spark, key, None, False
        if largest is None or largest > most:
            self.hubs = settle(e.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("lots")).where("lots > 1"))
            self.has_hubs = self.hubs.limit(1).count() > 0
        by, dealt = [key], e
        if self.has_hubs:
            by, lot = [key, "lot"], F.pmod(F.xxhash64(other), F.coalesce("lots", F.lit(1)))
            dealt = e.join(F.broadcast(self.hubs), key, "left").select(*e.columns, lot.alias("lot"), F.col("lots").isNotNull().alias("hub"))
        self.buckets = buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges // BUCKET_EDGES))
        self.name = f"stratagraph_{uuid.uuid4().hex}"
        self.path = f"{spark.sparkContext.getCheckpointDir()}/{self.name}"
        # each task writes one bucket: one sorted file a bucket
        dealt.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", self.path).format("parquet").saveAsTable(self.name)
        self.edges = spark.table(self.name)

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows with a column named like the key, once for each lot of it."""
        lots = F.sequence(F.lit(0).cast("long"), F.coalesce("lots", F.lit(1)) - 1)
        return df.join(F.broadcast(self.hubs), self.key, "left").select(*df.columns, F.explode(lots).alias("lot"))

    def join(self, df: DataFrame, small: bool = False) -> DataFrame:
        """Edges with the columns of the frame's row for their key; ``small``: the frame has at most BROADCAST_ROWS rows."""
        if small or not self.has_hubs:
            return self.edges.join(F.broadcast(df) if small else met(df), self.key).drop("lot", "hub")
        return self.edges.join(met(self.spread(df)), [self.key, "lot"]).drop("lot", "hub")

    def clear(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")
        delete(self.spark, self.path)


def lookup(rows: DataFrame, key: str, values: DataFrame, small: bool, hubs: DataFrame | None = None) -> DataFrame:
    """Rows with the columns of the row of ``values`` for their key (there is one for each key).

    ``small`` values are broadcast. Else keys in ``hubs`` (a counted few, which many rows have) are met by a broadcast, and only the
    others are shuffled.
    """
    if small:
        return rows.join(F.broadcast(values), key)
    if hubs is None:
        return rows.join(met(values), key)
    few = hubs.select(key)
    hot = values.join(F.broadcast(few), key, "left_semi")
    cold = rows.join(F.broadcast(few), key, "left_anti").join(met(values), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def numbered(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """Numbers rows from 0 in a total order without gathering them in one partition.

    A range sort, then each row's place in its partition plus the sizes of the
    partitions before it (one number a partition comes to the driver).
    """
    s = settle(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    first, total = [], 0
    for r in s.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).orderBy("_p").collect():
        first.append((r._p, total))
        total += r.n
    at = df.sparkSession.createDataFrame(first, "_p int, _f long")
    return s.join(F.broadcast(at), "_p").withColumn(name, F.col("_k") + F.col("_f")).drop("_p", "_k", "_f")


def prefix_sum(df: DataFrame, value: str, *order: Column | str, name: str = "off") -> DataFrame:
    """Exclusive running total of a column in a total order, partition by partition."""
    s = settle(df.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()))
    first, total = [], 0
    for r in s.groupBy("_p").agg(F.sum(value).alias("n")).orderBy("_p").collect():
        first.append((r._p, total))
        total += r.n or 0
    at = df.sparkSession.createDataFrame(first, "_p int, _f long")
    before = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return s.join(F.broadcast(at), "_p").withColumn(name, before + F.col("_f")).drop("_p", "_k", "_f")
