"""Plumbing shared by the corpus operators: Arrow maps, checkpoints, components."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .textcore import CHUNK_BYTES, chunks, string_buffers

#: Rows and bytes of one Arrow batch: texts may be long, so both are far fewer than Spark's defaults.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
#: Rows that Spark's Parquet reader decodes at once.
READER_ROWS = 256


def _at_most(spark: SparkSession, key: str, value: int, default: int) -> None:
    now = spark.conf.get(key, str(default)).rstrip("b")
    if not now.lstrip("-").isdigit() or not 0 < int(now) <= value:
        spark.conf.set(key, str(value))


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: batches bounded by rows and bytes, and a checkpoint folder.

    The batch settings are lowered for the whole session (never raised), since frames are run later. The folder named in spark.checkpoint.dir is taken as it is. A local one is
    set only on a local master, as in tests; on a cluster a missing one is an error.
    """
    _at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, 10_000)
    _at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, 64 << 20)
    _at_most(spark, "spark.sql.parquet.columnarReaderBatchSize", READER_ROWS, 4096)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master or "").split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratagraph-"))


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have, whatever its case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def _gathered(batches: Iterator[pa.RecordBatch], text: int, limit: int) -> Iterator[pa.Table]:
    """Batches put together up to about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(text).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def give_back() -> None:
    """Returns freed memory to the system: a worker is used again, and others share its executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_text(df: DataFrame, text: str, make: Callable[[], Callable], fields: list[T.StructField], keep: list[str] | None = None, limit: int = CHUNK_BYTES, also: tuple[str, ...] = ()) -> DataFrame:
    """Adds columns computed from a text column, in bounded pieces and without a shuffle.

    ``make()`` runs once a task and gives f(raw bytes, offsets, rows) -> list of
    Arrow arrays for ``fields``; rows is the Arrow table of the piece. A null text
    comes as an empty one. ``keep`` are the columns passed through (all, if None);
    f sees those of ``also`` too. A new name that clashes with a kept column
    gets underscores added.
    """
    keep = df.columns if keep is None else keep
    fields = [T.StructField(fresh(df.select(*keep), x.name), x.dataType) for x in fields]
    inner = df.select(*dict.fromkeys([*keep, text, *also]))
    schema = T.StructType([inner.schema[c] for c in keep] + fields)
    names, at = inner.columns, inner.columns.index(text)
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for table in _gathered(batches, at, limit):
            off, raw = string_buffers(table.column(at))
            for lo, hi in chunks(off, limit):
                rows = table.slice(lo, hi - lo)
                out = f(raw[off[lo] - off[0] : off[hi] - off[0]], off[lo : hi + 1] - off[lo], rows)
                cols = [rows.column(names.index(c)).combine_chunks() for c in keep]
                cols = [pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c for c in cols] + out
                yield pa.RecordBatch.from_arrays([c.cast(t.type) if c.type != t.type else c for c, t in zip(cols, arrow, strict=True)], schema=arrow)
        del f
        give_back()

    return inner.mapInArrow(run, schema)


def flat_text(df: DataFrame, text: str, make: Callable[[], Callable], schema: T.StructType, limit: int = CHUNK_BYTES) -> DataFrame:
    """Like map_text, but f gives whole Arrow arrays of any length for ``schema``."""
    at = df.columns.index(text)
    arrow = to_arrow_schema(schema)

    def run(batches):
        f = make()
        for table in _gathered(batches, at, limit):
            off, raw = string_buffers(table.column(at))
            for lo, hi in chunks(off, limit):
                out = f(raw[off[lo] - off[0] : off[hi] - off[0]], off[lo : hi + 1] - off[lo], table.slice(lo, hi - lo))
                out = [pa.array(c, t.type) if isinstance(c, np.ndarray) else c for c, t in zip(out, arrow, strict=True)]
                for i in range(0, len(out[0]), 100_000):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 100_000) for c in out], schema=arrow)
        del f
        give_back()

    return df.mapInArrow(run, schema)


def ragged(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def blobs(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column: values[offsets[i]:offsets[i + 1]] as little-endian bytes."""
    data = np.ascontiguousarray(values)
    off = np.asarray(offsets, np.int64) * data.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def settle(df: DataFrame) -> DataFrame:
    """Writes the frame to the shared checkpoint folder and cuts its lineage."""
    return df.checkpoint(eager=True)


#: Rows of ids (16 to 64 bytes each) that may be broadcast to a scan of texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def small_or_not(ids: DataFrame, rows: int | None = None) -> DataFrame:
    """The frame marked for broadcast if its counted rows allow it, else as it is."""
    n = ids.count() if rows is None else rows
    return F.broadcast(ids) if n <= BROADCAST_ROWS else ids


#: The tables of the innermost ``scratch`` of this thread of control; None outside of one.
_RUN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("tables of a run", default=None)


def stored(df: DataFrame) -> DataFrame:
    """Writes the frame as a table in the shared checkpoint folder and reads it back; ``scratch`` deletes such tables."""
    prepare(df.sparkSession)
    run = _RUN.get()
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{'frame' if run is None else 'table'}-{uuid.uuid4().hex}"
    if run is not None:
        run.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, wherever they are."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables stored within it and no others: for work whose result is written before it ends."""
    mine: list[str] = []
    token = _RUN.set(mine)
    try:
        yield
    finally:
        _RUN.reset(token)
        delete(spark, *mine)


def with_group(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, least: int = 1000) -> DataFrame:
    """Inner join of rows with one row a key that holds the key's ``count`` of rows; hot keys are not dealt to one task.

    Keys of more than ``least`` and total / BROADCAST_ROWS rows are fewer than BROADCAST_ROWS, so
    they may be broadcast; the rest is shuffled.
    """
    most = max(least, -(-total // BROADCAST_ROWS))
    more = [c for c in groups.columns if c != key]
    hot = fresh(rows, "sg_hot")
    heavy = groups.where(F.col(count) > most).select(key, F.struct(*more).alias(hot))
    tagged = rows.join(F.broadcast(heavy), key, "left")
    here = tagged.where(F.col(hot).isNotNull()).select(*rows.columns, *(F.col(hot)[c].alias(c) for c in more))
    return here.unionByName(tagged.where(F.col(hot).isNull()).drop(hot).join(groups.where(F.col(count) <= most), key).select(*rows.columns, *more))


#: Edges behind one task that writes those of a round of components, at least.
TASK_EDGES = 200_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node.

    Alternates large-star and small-star steps; each is a group-by-node, so the
    work of a round is a few shuffles of the edges. Minima are pre-aggregated, and hubs'
    edges meet them by a bounded broadcast instead of in one task. Nodes without an edge don't appear.
    """
    e = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        total = 2 * e.count()
        # few edges lie in few files, whatever the number of shuffle partitions: each task of a round has files of its own
        parts = max(e.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_EDGES))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c")).select("a", F.least("a", "m").alias("m"), "c")
        large = settle(with_group(both, low, "a", "c", total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts))
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("c"))
        small = with_group(large, low, "a", "c", total)
        after = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b")
        e = settle(after.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().coalesce(parts))
        # settled: every node points at one root, and no root points on
        ends = e.select("a", F.lit(1).alias("out"), F.lit(0).alias("root")).union(e.select("b", F.lit(0), F.lit(1)))
        ends = ends.groupBy("a").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
        if not ends.where("out > 1 or (out > 0 and root > 0)").coalesce(parts).limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
