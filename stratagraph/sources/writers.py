"""Sinks for edge lists, core numbers and run profiles. Parquet is the format for anything large.

Text formats whose lines have an order are sorted as a whole and written as part files in that order: one
file up to ``ONE_FILE_ROWS`` lines, more beyond; put one after another they are the text. NumPy archives and zips are single files that the tasks write together,
each its blocks at places computed from running totals (``archives``), where the path is a mounted one. In another store they are made on the driver from at
most ``ARRAY_ROWS`` rows, as HDF5 is; more is an error. All other paths may be in any store that Spark writes to.
"""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.loop import kept, numbered, prefix_sum
from . import archives

ONE_FILE_ROWS = 1_000_000
ARRAY_ROWS = 20_000_000


def _write_lines(lines: DataFrame, path: str, rows: int, gzip: bool = False) -> None:
    """Lines (p, a, b, value) in the order of (p, a, b)."""
    out = lines.orderBy("p", "a", "b").select("value")
    w = (out.coalesce(1) if rows <= ONE_FILE_ROWS else out).write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).text(path)


def _head(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([(0, k, 0, v) for k, v in enumerate(values)], "p int, a long, b long, value string")


def _edge_lines(e: DataFrame) -> DataFrame:
    x, y = e.columns[:2]
    return e.select(F.lit(1).alias("p"), F.col(x).cast("long").alias("a"), F.col(y).cast("long").alias("b"), F.concat_ws(" ", x, y).alias("value"))


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def _arrays(df: DataFrame, names: tuple[str, str]) -> dict:
    rows = df.count()
    if rows > ARRAY_ROWS:
        raise ValueError(f"{rows} rows are too many for one archive of arrays (at most {ARRAY_ROWS}); write Parquet")
    t = df.toArrow()
    return {n: t[c].to_numpy() for n, c in zip(names, df.columns, strict=True)}


def write_text(df: DataFrame, path: str, sep: str = "\t", gzip: bool = False) -> None:
    """Columns joined by a separator, one row a line."""
    w = df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in df.columns]).alias("value")).write.mode("overwrite")
    (w.option("compression", "gzip") if gzip else w).text(path)


def _mtx_lines(e: DataFrame) -> tuple[DataFrame, int]:
    x, y = e.columns[:2]
    e = kept(e.select(x, y))
    top = e.agg(F.max(x).alias("a"), F.max(y).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return _head(e.sparkSession, "%%MatrixMarket matrix coordinate pattern general", f"{top.a or 0} {top.b or 0} {top.n}").unionByName(_edge_lines(e)), top.n


def write_mtx(e: DataFrame, path: str, gzip: bool = False) -> None:
    """MatrixMarket pattern: banner, size line (largest ids and entries), entries sorted."""
    _write_lines(*((x := _mtx_lines(e))[0], path, x[1]), gzip)


def write_header_text(e: DataFrame, path: str, gzip: bool = False) -> None:
    """`# V` (the largest id and one), then the edges sorted; isolated ids up to V survive in the header."""
    top = e.agg(F.greatest(F.max("src"), F.max("dst")).alias("m"), F.count(F.lit(1)).alias("n")).first()
    _write_lines(_head(e.sparkSession, f"# {0 if top.m is None else top.m + 1}").unionByName(_edge_lines(e)), path, top.n, gzip)


def write_adjlist(e: DataFrame, path: str, gzip: bool = False) -> None:
    """A line `v n1 n2 ...` for each vertex with its neighbours sorted; a vertex's line is made in one task."""
    n = e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("ns"))
    lines = n.select(F.lit(1).alias("p"), F.col("src").alias("a"), F.lit(0).cast("long").alias("b"), F.concat_ws(" ", F.col("src").cast("string"), F.array_join(F.col("ns").cast("array<string>"), " ")).alias("value"))
    _write_lines(lines, path, e.select("src").distinct().count(), gzip)


def write_csr(e: DataFrame, path: str) -> None:
    """The text cache `V E`, degrees, offsets, neighbours, a number a line, as part files in order; ids should be dense.

    e is clean (both directions, no repeats); V is the largest id and one, ids without an edge have degree 0. It is stored once, since
    size, degrees and neighbours all read it.
    """
    e = kept(e.select("src", "dst"))
    size = e.agg(F.min("src").alias("least"), F.max("src").alias("most"), F.count(F.lit(1)).alias("n")).first()
    if (size.least or 0) < 0:
        raise ValueError("ids of this format begin at 0")
    v = 0 if size.most is None else size.most + 1
    spark = e.sparkSession
    deg = spark.range(v).select(F.col("id").alias("v")).join(e.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg")), "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"))
    at = prefix_sum(deg, "deg", "v") if v else deg.withColumn("off", F.lit(0))
    part = lambda df, p, a, b, value: df.select(F.lit(p).alias("p"), F.col(a).alias("a"), b.cast("long").alias("b"), F.col(value).cast("string").alias("value"))
    lines = _head(spark, f"{v} {size.n}").unionByName(part(at, 1, "v", F.lit(0), "deg")).unionByName(part(at, 2, "v", F.lit(0), "off"))
    lines = lines.unionByName(spark.createDataFrame([(2, v, 0, str(size.n))], lines.schema)).unionByName(part(e, 3, "src", F.col("dst"), "dst"))
    lines.orderBy("p", "a", "b").select("value").write.mode("overwrite").text(path)


def write_npz(e: DataFrame, path: str, names: tuple[str, str] = ("src", "dst")) -> None:
    """A NumPy archive of two arrays, rows in the order of both columns: each task writes its rows at their place."""
    import numpy as np

    x, y = e.columns[:2]
    e = e.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"))
    at = archives.local_path(e.sparkSession, path)
    if at is None:
        data = io.BytesIO()
        np.savez(data, **_arrays(e.orderBy("x", "y"), names))
        put_bytes(e.sparkSession, path, data.getvalue())
        return
    rows = numbered(e, "x", "y", name="i")
    n = rows.count()
    head = archives.array_head(n)
    size = len(head) + 8 * n
    archives.store(rows.select("i", "x", "y"), at, [(f"{c}.npy", size) for c in names], 8, (len(head), size + len(head)), {0: head, size: head})


def write_hdf5(e: DataFrame, path: str, names: tuple[str, str] = ("src", "dst")) -> None:
    """An HDF5 file of two datasets; needs h5py."""
    try:
        import h5py
    except ImportError as x:
        raise RuntimeError("writing HDF5 needs the h5py package, which is not installed") from x
    data = io.BytesIO()
    with h5py.File(data, "w") as h:
        for k, v in _arrays(e.select(*e.columns[:2]), names).items():
            h[k] = v
    put_bytes(e.sparkSession, path, data.getvalue())


def write_zip(e: DataFrame, path: str, member: str = "graph.txt") -> None:
    """An archive of one stored text member: a sorted edge list, or MatrixMarket if it is called so. Each task writes its lines at their place."""
    spark = e.sparkSession
    lines, rows = _mtx_lines(e) if member.endswith(".mtx") else (_edge_lines(e), None)
    if (at := archives.local_path(spark, path)) is not None:
        placed = prefix_sum(lines.withColumn("n", F.octet_length("value") + 1), "n", "p", "a", "b")
        size = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        archives.store(placed.select("off", "value"), at, [(member, size)], 1, (0,))
        return
    rows = e.count() if rows is None else rows
    if rows > ARRAY_ROWS:
        raise ValueError(f"{rows} rows are too many for one archive in this store (at most {ARRAY_ROWS}); write Parquet or .gz")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w") as f:
        for r in lines.orderBy("p", "a", "b").select("value").toLocalIterator():
            f.write(r.value.encode() + b"\n")
    put_bytes(spark, path, data.getvalue())


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


WRITERS = {"txt": write_text, "edges": write_header_text, "mtx": write_mtx, "adjlist": write_adjlist, "csr": write_csr, "zip": write_zip, "npz": write_npz, "h5": write_hdf5, "hdf5": write_hdf5, "parquet": write_parquet}


def write_graph(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Writes by format, or by extension (`.gz` after that of a text format compresses; `.mtx.zip` names the member's format); Parquet if there is none known."""
    name = path.rstrip("/").rpartition("/")[2].lower().split(".")
    fmt, inner = fmt or name[-1], name[-2] if len(name) > 2 else ""
    if fmt == "gz":
        if inner not in ("txt", "edges", "mtx", "adjlist"):
            raise ValueError(f"{inner or 'this format'} is not written compressed")
        WRITERS[inner](df, path, gzip=True)
    elif fmt == "zip":
        write_zip(df, path, "graph.mtx" if inner == "mtx" else "graph.txt")
    else:
        WRITERS.get(fmt, write_parquet)(df, path)


def write_results(c: DataFrame, path: str, fmt: str | None = None) -> None:
    """Core numbers (v, core) by extension: JSON, text, MatrixMarket, arrays N and K in NumPy or HDF5 archives, or Parquet (also without an extension)."""
    name = path.rstrip("/").rpartition("/")[2]
    fmt = fmt or (name.rpartition(".")[2].lower() if "." in name else "parquet")
    c = c.select("v", "core")
    if fmt == "json":
        write_cores_json(c, path)
    elif fmt in ("txt", "tsv"):
        write_text(c.orderBy("v"), path)
    elif fmt == "mtx":
        write_mtx(c, path)
    elif fmt in ("npz", "h5", "hdf5", "hdf"):
        (write_npz if fmt == "npz" else write_hdf5)(c.orderBy("v"), path, ("N", "K"))
    elif fmt == "parquet":
        write_parquet(c, path)
    else:
        raise ValueError(f"results are not written as {fmt!r}: use json, txt, tsv, mtx, npz, h5 or parquet")


def serialized_name(path: str, fmt: str) -> str:
    """Where a graph read from ``path`` is cached: the extension replaced."""
    base = path.rstrip("/")
    stem = base.rpartition(".")[0] if "." in base.rpartition("/")[2] else base
    return f"{stem}.{fmt}"


def json_lines(c: DataFrame, zeros: bool = False) -> DataFrame:
    """(v, line): `{"v": core}` for each vertex, without those of core 0 unless asked for."""
    c = c if zeros else c.where("core > 0")
    return c.select("v", F.concat(F.lit('{"'), F.col("v").cast("string"), F.lit('": '), F.col("core").cast("string"), F.lit("}")).alias("line"))


def write_cores_json(c: DataFrame, path: str, zeros: bool = False, total: bool = False) -> None:
    """One JSON object of all vertices, its members written as sorted lines.

    ``total`` puts an entry {number of vertices: 0} first.
    """
    rows = c if zeros else c.where("core > 0")
    body = numbered(rows.select("v", "core"), "v", name="a").select(F.lit(1).alias("p"), "a", F.lit(0).cast("long").alias("b"), F.concat(F.when(F.col("a") > 0, F.lit(",")).otherwise(F.lit("")), F.lit('"'), F.col("v").cast("string"), F.lit('": '), F.col("core").cast("string")).alias("value"))
    n = c.count()
    first = "{" + (f'"{n}": 0' + ("," if rows.limit(1).count() else "") if total else "")
    ends = c.sparkSession.createDataFrame([(0, 0, 0, first), (2, 0, 0, "}")], "p int, a long, b long, value string")
    _write_lines(ends.unionByName(body), path, n)


def write_profile(spark: SparkSession, record: dict, path: str, append: bool = True) -> None:
    """Appends (or starts anew with) one row of a run profile as CSV; missing values are -1."""
    row = {k: -1 if v is None else v for k, v in record.items()}
    spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("append" if append else "overwrite").csv(path, header=True)


def to_gsi(patterns: DataFrame) -> DataFrame:
    """Query graphs (query, src, dst) as lines of the labelled exchange format: (query, k, line)."""
    # fixed values: the words of the format
    v = patterns.groupBy("query").agg((F.greatest(F.max("src"), F.max("dst")) + 1).alias("n"), F.count(F.lit(1)).alias("m"))
    head = v.select("query", F.lit(0).alias("k"), F.lit("t # 0").alias("line"))
    size = v.select("query", F.lit(1).alias("k"), F.concat_ws(" ", "n", "m", F.lit("1 1")).alias("line"))
    ids = v.select("query", F.lit(2).alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select("query", "k", F.concat(F.lit("v "), F.col("i"), F.lit(" 1")).alias("line"))
    edges = patterns.select("query", F.lit(3).alias("k"), F.concat(F.lit("bufTail "), F.col("src"), F.lit(" "), F.col("dst"), F.lit(" 1")).alias("line"))
    tail = v.select("query", F.lit(4).alias("k"), F.lit("t # -1").alias("line"))
    return head.unionByName(size).unionByName(ids).unionByName(edges).unionByName(tail)
