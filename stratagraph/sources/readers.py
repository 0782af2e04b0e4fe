"""Graph readers: every format becomes a frame (src bigint, dst bigint).

Text parsing is native. NumPy archives, zips and CSR caches in a store that Python can open are read by several tasks, by ranges of bytes
(``archives``); in a store that Spark alone reaches, and for HDF5 or a compressed copy of an archive, each file is opened once on an executor through the
binaryFile source, which takes files of up to 2 GB. Inputs are never changed.
"""

from __future__ import annotations

import gzip
import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives

SCHEMA = "src long, dst long"


def _split(lines: DataFrame) -> DataFrame:
    """Two leading integers of each line, split at white space or commas; other lines are dropped."""
    x = F.split(F.trim(F.regexp_replace("value", r"[\s,]+", " ")), " ")
    return lines.select(x.alias("x")).select(F.get("x", F.lit(0)).try_cast("bigint").alias("src"), F.get("x", F.lit(1)).try_cast("bigint").alias("dst")).where("src is not null and dst is not null")


def read_text(spark: SparkSession, path: str, comment: str = "#%") -> DataFrame:
    """Edge list; lines that begin with a comment character or hold no two integers (a `# V` header) are skipped. `.gz` is read as it is."""
    lines = spark.read.text(path).where(~F.substring(F.ltrim("value"), 1, 1).isin(*comment))
    return _split(lines)


def read_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(v): all ids below the number in a `# V` header line, for graphs with isolated vertices; none without a header."""
    n = spark.read.text(path).where(F.col("value").rlike(r"^#\s*\d+\s*$")).agg(F.max(F.regexp_extract("value", r"(\d+)", 1).cast("long"))).first()[0]
    return spark.range(n or 0).select(F.col("id").alias("v"))


def read_mtx(spark: SparkSession, path: str) -> DataFrame:
    """MatrixMarket: comments, then one size line of three integers, then entries (a value after them is ignored).

    The size line is the first line of a file that is no comment, found by its
    offset in the file, so files may be split. Of several files where some have a banner, the
    others are the further parts of one text and have no size line.
    """
    lines = spark.read.text(path, wholetext=False).withColumn("f", F.col("_metadata.file_path")).withColumn("at", F.col("_metadata.file_block_start")).withColumn("k", F.monotonically_increasing_id())
    comment = F.ltrim("value").startswith("%")
    # numbers first, a row for each piece of a file: the least struct alone would have all lines sorted, those of a compressed file in one task
    pieces = lines.groupBy("f", "at").agg(F.min(F.when(~comment & (F.trim("value") != ""), F.col("k"))).alias("k"), F.max(F.lower("value").startswith("%%matrixmarket")).alias("banner"))
    files = pieces.groupBy("f").agg(F.min(F.when(F.col("k").isNotNull(), F.struct("at", "k"))).alias("h"), F.max("banner").alias("banner"))
    banners = files.agg(F.max("banner")).first()[0]
    head = files.where("banner") if banners else files
    body = lines.where(~comment & (F.trim("value") != "")).join(F.broadcast(head.select("f", "h")), "f", "left")
    return _split(body.where(F.col("h").isNull() | (F.col("at") != F.col("h.at")) | (F.col("k") != F.col("h.k"))).select("value"))


def _neighbours(lines: DataFrame) -> DataFrame:
    """Edges of lines `v n1 n2 ...`."""
    x = F.transform(F.filter(F.split(F.trim("value"), r"\s+"), lambda s: s != ""), lambda s: s.try_cast("bigint"))
    lines = lines.where(~F.ltrim("value").startswith("#")).select(x.alias("x")).where("size(x) > 1")
    return lines.select(F.col("x")[0].alias("src"), F.explode(F.expr("slice(x, 2, size(x) - 1)")).alias("dst")).where("src is not null and dst is not null")


def read_adjlist(spark: SparkSession, path: str) -> DataFrame:
    """Lines `v n1 n2 ...`."""
    return _neighbours(spark.read.text(path))


def _binary(spark: SparkSession, path: str, load) -> DataFrame:
    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                content = bytes(content)
                src, dst = load(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
                for i in range(0, len(src), 100_000):
                    yield pd.DataFrame({"src": src[i : i + 100_000].astype("int64"), "dst": dst[i : i + 100_000].astype("int64")})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def read_npz(spark: SparkSession, path: str, names: tuple[str, str] = ("src", "dst"), range_bytes: int = archives.RANGE_BYTES) -> DataFrame:
    """NumPy archives with arrays src and dst: ranges of rows where they are stored, a stream a file where they are compressed."""
    if not path.endswith(".gz") and (at := archives.reachable(spark, path)):
        return archives.load(spark, archives.Arrays, at, names=",".join(names), range_bytes=range_bytes)

    def load(content):
        with np.load(io.BytesIO(content)) as z:
            return z[names[0]], z[names[1]]

    return _binary(spark, path, load)


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    """HDF5 files with datasets src and dst; needs h5py."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading HDF5 needs the h5py package, which is not installed") from e

    def load(content):
        import h5py

        with h5py.File(io.BytesIO(content)) as h:
            return h["src"][:], h["dst"][:]

    return _binary(spark, path, load)


def _member_lines(spark: SparkSession, path: str) -> DataFrame:
    """(kind, value) lines of zips in a store that only Spark reads, a file at a time."""

    def run(frames):
        for pdf in frames:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                    names = z.namelist()
                    if len(names) != 1:
                        raise ValueError(f"the archive holds {len(names)} members, not one")
                    kind = names[0].rpartition(".")[2].lower()
                    with z.open(names[0]) as f:
                        if kind == "npz":
                            with np.load(io.BytesIO(f.read())) as arrays:
                                src, dst = arrays["src"], arrays["dst"]
                            for i in range(0, len(src), 50_000):
                                yield pd.DataFrame({"kind": "txt", "value": [f"{a} {b}" for a, b in zip(src[i : i + 50_000].tolist(), dst[i : i + 50_000].tolist(), strict=True)]})
                            continue
                        held: list[str] = []
                        sized = kind != "mtx"  # a size line comes before the entries
                        for line in io.TextIOWrapper(f, "utf-8"):
                            if not sized and line.strip() and not line.lstrip().startswith("%"):
                                sized = True
                                continue
                            held.append(line)
                            if len(held) == 50_000:
                                yield pd.DataFrame({"kind": kind, "value": held})
                                held = []
                        yield pd.DataFrame({"kind": kind, "value": held}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "kind string, value string")


def read_zip(spark: SparkSession, path: str, range_bytes: int = archives.RANGE_BYTES) -> DataFrame:
    """A `.zip` of exactly one member, read by the member's extension: MatrixMarket, adjacency lists, a NumPy archive, or an edge list.

    A stored member is cut into ranges; a compressed one can't be, and passes through one task as a stream.
    """
    at = archives.reachable(spark, path)
    nested = at and any(archives.only_member(f).filename.lower().endswith(".npz") for f, _ in archives.files(at))
    text = _member_lines(spark, path) if at is None or nested else archives.load(spark, archives.Lines, at, range_bytes=range_bytes)
    edges = _split(text.where((F.col("kind") != "adjlist") & ~F.substring(F.ltrim("value"), 1, 1).isin("#", "%")))
    return edges.unionByName(_neighbours(text.where("kind = 'adjlist'")))


#: Neighbours of a block of the CSR cache: a vertex's row meets the blocks that its neighbours lie in.
CSR_BLOCK = 64


def read_csr(spark: SparkSession, path: str, range_bytes: int = archives.RANGE_BYTES) -> DataFrame:
    """The text cache `V E degrees offsets neighbours` (white space between numbers).

    Ranges of bytes give their numbers with their places in the range; the ranges' counts (one number each on the driver) give the places in the file. A
    neighbour's place finds its vertex by the offsets, in blocks of places, so that a hub's neighbours are dealt over many.
    """
    at = archives.reachable(spark, path)
    if at is None:

        def load(content):
            x = np.array(content.split(), np.int64)
            v, e = int(x[0]), int(x[1])
            off = x[2 + v : 3 + 2 * v]
            return np.repeat(np.arange(v), np.diff(off)), x[3 + 2 * v : 3 + 2 * v + e]

        return _binary(spark, path, load)
    x = archives.load(spark, archives.Numbers, at, range_bytes=range_bytes)
    v, e = archives.first_numbers(at, 2)
    first, total = [], 0
    for r in x.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        first.append((r.part, total))
        total += r.n
    if total != 3 + 2 * v + e:
        raise ValueError(f"{path}: {total} numbers, not {3 + 2 * v + e}")
    x = x.join(F.broadcast(spark.createDataFrame(first, "part int, before long")), "part").select((F.col("k") + F.col("before")).alias("i"), "value")
    deg = x.where((F.col("i") >= 2) & (F.col("i") < 2 + v)).select((F.col("i") - 2).alias("src"), F.col("value").alias("deg")).where("deg > 0")
    off = x.where((F.col("i") >= 2 + v) & (F.col("i") < 2 + 2 * v)).select((F.col("i") - (2 + v)).alias("src"), F.col("value").alias("lo"))
    block = lambda c: F.call_function("div", c, F.lit(CSR_BLOCK))
    own = deg.join(off, "src").withColumn("hi", F.col("lo") + F.col("deg")).withColumn("block", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi") - 1))))
    place = F.col("i") - (3 + 2 * v)
    near = x.where(F.col("i") >= 3 + 2 * v).select(place.alias("j"), block(place).alias("block"), F.col("value").alias("dst"))
    return near.join(own, "block").where("lo <= j and j < hi").select("src", "dst")


def read_query_graphs(spark: SparkSession, path: str) -> DataFrame:
    """Pattern files (first line the number of vertices, then directed edges): (query, src, dst)."""
    lines = spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("query"), F.split(F.trim("value"), r"\s+").alias("x"))
    return lines.where("size(x) >= 2").select("query", F.col("x")[0].cast("long").alias("src"), F.col("x")[1].cast("long").alias("dst"))


READERS = {"txt": read_text, "csv": read_text, "edges": read_text, "mtx": read_mtx, "npz": read_npz, "h5": read_hdf5, "hdf5": read_hdf5, "zip": read_zip, "adjlist": read_adjlist, "csr": read_csr}


def read_graph(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Reads by format, or by extension; after `.gz` the extension before it counts (an edge list, if there is none). A path without a known one is Parquet with columns src and dst."""
    name = path.rstrip("/").rpartition("/")[2].lower().split(".")
    if (fmt or name[-1]) == "gz":
        fmt = name[-2] if len(name) > 2 and name[-2] in READERS else "txt"
    fmt = fmt or name[-1]
    if fmt in READERS:
        return READERS[fmt](spark, path)
    return spark.read.parquet(path).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
