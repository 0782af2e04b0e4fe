import gzip
import io
import json
import os
import random
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratagraph.operators import clean as cl
from stratagraph.operators import cores
from stratagraph.plans.decomposition import Decomposition
from stratagraph.sources import archives, readers, writers

EDGES = [(0, 6), (1, 2), (1, 3), (2, 3), (3, 0), (6, 1)]


def rows(df):
    return sorted((r.src, r.dst) for r in df.collect())


def test_text_forms(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("# 7\n%x\n\n0 6\n1\t2\n 1   3 \n2,3\n3 0 0.5\nbad line\n6 1\n")
    assert rows(readers.read_graph(spark, str(p))) == EDGES
    with gzip.open(tmp_path / "h.txt.gz", "wt") as f:
        f.write(p.read_text())
    assert rows(readers.read_graph(spark, str(tmp_path / "h.txt.gz"))) == EDGES
    with zipfile.ZipFile(tmp_path / "h.zip", "w") as z:
        z.write(p, "g.txt")
    assert rows(readers.read_graph(spark, str(tmp_path / "h.zip"))) == EDGES
    a = tmp_path / "g.adjlist"
    a.write_text("# c\n0 6\n1 2 3\n2 3\n3 0\n6 1\n7\n")
    assert rows(readers.read_graph(spark, str(a))) == EDGES


def test_every_format_gives_the_same_graph(spark, tmp_path):
    e = spark.createDataFrame(EDGES, "src long, dst long")
    for ext in ("txt", "txt.gz", "zip", "edges", "mtx", "mtx.gz", "mtx.zip", "npz", "adjlist", "parquet"):
        path = str(tmp_path / f"g.{ext}")
        writers.write_graph(e, path)
        assert rows(readers.read_graph(spark, path)) == EDGES, ext
    v, near = 7, {}
    for a, b in EDGES + [(b, a) for a, b in EDGES]:
        near.setdefault(a, set()).add(b)
    deg = [len(near.get(i, ())) for i in range(v)]
    off = np.concatenate([[0], np.cumsum(deg)])
    p = tmp_path / "g.csr"
    p.write_text(" ".join(map(str, [v, sum(deg), *deg, *off, *[n for i in range(v) for n in sorted(near.get(i, ()))]])))
    assert rows(readers.read_graph(spark, str(p))) == rows(cl.clean(e))


def test_csr_round_trip_with_isolated_ids(spark, tmp_path):
    e = cl.clean(spark.createDataFrame([*EDGES, (9, 8)], "src long, dst long"))
    path = str(tmp_path / "g.csr")
    writers.write_graph(e, path)
    text = " ".join(open(f"{path}/{f}").read() for f in os.listdir(path) if f.startswith("part")).split()
    assert text[:2] == ["10", "14"] and text[2:12] == ["2", "3", "2", "3", "0", "0", "2", "0", "1", "1"] and text[22] == "14"
    assert rows(readers.read_graph(spark, path)) == rows(e)


def test_part_files_in_order(spark, tmp_path, monkeypatch):
    """Texts of many part files read as one, the banner and size line being in the first."""
    monkeypatch.setattr(writers, "ONE_FILE_ROWS", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    e = spark.createDataFrame([(i, i + 1) for i in range(500)], "src long, dst long").repartition(7)
    for ext in ("mtx", "mtx.gz", "edges"):
        path = str(tmp_path / f"g.{ext}")
        writers.write_graph(e, path)
        parts = sorted(f for f in os.listdir(path) if f.startswith("part"))
        assert len(parts) > 1 and rows(readers.read_graph(spark, path)) == rows(e)
        if ext == "edges":
            text = "".join(open(f"{path}/{f}").read() for f in parts)
            assert text == "# 501\n" + "".join(f"{i} {i + 1}\n" for i in range(500))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_are_not_sorted_for_their_head(spark, tmp_path):
    """A compressed file is read by one task: finding its size line must not sort all of its lines."""
    path = str(tmp_path / "g.mtx.gz")
    writers.write_graph(spark.createDataFrame(EDGES, "src long, dst long"), path)
    got = readers.read_graph(spark, path)
    steps = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(" in x or "Sort [" in x]
    assert rows(got) == EDGES and "HashAggregate(" in steps[-1]


def test_one_task_holds_a_block_of_an_archive(monkeypatch):
    """Rows reach the sink as they are and are put together there, a block of each column at a time, however many come."""
    import tracemalloc

    monkeypatch.setattr(archives, "BLOCK_BYTES", 1 << 16)
    batch = lambda i: pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 1000)), *[pa.array(np.arange(1000))] * 2], ["i", "x", "y"])
    tracemalloc.start()
    sizes = [len(data) for _, data in archives.joined((batch(i) for i in range(0, 400_000, 1000)), 8, (128, 4_000_000))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 2 * 8 * 400_000 and max(sizes) < 80_000 and peak < 1_000_000


def test_archives_take_rows_and_no_blocks(spark, tmp_path, monkeypatch):
    """What goes to the sink are rows of a few bytes: batches of large blocks would lie in memory together."""
    seen = []
    store = archives.store
    monkeypatch.setattr(archives, "store", lambda rows, *more: (seen.append([t for _, t in rows.dtypes]), store(rows, *more)))
    e = spark.createDataFrame(EDGES, "src long, dst long")
    for ext in ("npz", "zip"):
        writers.write_graph(e, str(tmp_path / f"g.{ext}"))
        assert rows(readers.read_graph(spark, str(tmp_path / f"g.{ext}"))) == EDGES
    assert seen == [["bigint", "bigint", "bigint"], ["bigint", "string"]]


def test_archives_elsewhere_have_a_limit(spark, tmp_path, monkeypatch):
    """In a store that can't be written at any place: the driver's way, with its limit, and whole files read by Spark."""
    monkeypatch.setattr(archives, "local_path", lambda spark, path: None)
    monkeypatch.setattr(archives, "reachable", lambda spark, path: None)
    e = spark.createDataFrame(EDGES, "src long, dst long")
    for ext in ("npz", "zip", "mtx.zip"):
        writers.write_graph(e, str(tmp_path / f"g.{ext}"))
        assert rows(readers.read_graph(spark, str(tmp_path / f"g.{ext}"))) == EDGES
    monkeypatch.setattr(writers, "ARRAY_ROWS", 3)
    for ext in ("npz", "zip"):
        with pytest.raises(ValueError, match="too many"):
            writers.write_graph(e, str(tmp_path / f"h.{ext}"))


def test_one_file_by_many_tasks(spark, tmp_path):
    """Archives written by several tasks are what NumPy and zipfile read, and are read again by many tasks."""
    r = random.Random(6)
    edges = sorted({(r.randrange(500), r.randrange(500)) for _ in range(3000)})
    e = spark.createDataFrame(edges, "src long, dst long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for ext in ("npz", "zip", "mtx.zip", "csr"):
        writers.write_graph(cl.clean(e) if ext == "csr" else e, str(tmp_path / f"g.{ext}"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    with np.load(tmp_path / "g.npz") as z:
        assert list(zip(z["src"].tolist(), z["dst"].tolist())) == edges
    with zipfile.ZipFile(tmp_path / "g.zip") as z:
        assert z.testzip() is None and z.read("graph.txt").decode() == "".join(f"{a} {b}\n" for a, b in edges)
    many = readers.read_npz(spark, str(tmp_path / "g.npz"), range_bytes=1000)
    assert many.rdd.getNumPartitions() > 20 and rows(many) == edges
    for name in ("g.zip", "g.mtx.zip"):
        many = readers.read_zip(spark, str(tmp_path / name), range_bytes=997)
        assert many.rdd.getNumPartitions() > 20 and rows(many) == edges, name
    for step in (97, 1 << 20):
        assert rows(readers.read_csr(spark, str(tmp_path / "g.csr"), range_bytes=step)) == rows(cl.clean(e))
    writers.write_graph(e.where("src < 0"), str(tmp_path / "none.npz"))
    assert rows(readers.read_graph(spark, str(tmp_path / "none.npz"))) == []


def test_compressed_archives_are_streams(spark, tmp_path):
    src, dst = np.arange(5000, dtype=np.uint32), np.arange(5000, dtype=np.uint32) % 7
    np.savez_compressed(tmp_path / "c.npz", src=src, dst=dst)
    assert rows(readers.read_graph(spark, str(tmp_path / "c.npz"))) == sorted(zip(src.tolist(), dst.tolist()))
    with zipfile.ZipFile(tmp_path / "c.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("g.mtx", "%%MatrixMarket matrix coordinate pattern general\n% x\n7 7 6\n" + "".join(f"{a}\t{b}\n" for a, b in EDGES))
    assert rows(readers.read_graph(spark, str(tmp_path / "c.zip"))) == EDGES
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.txt", "1 2\n")
        z.writestr("b.txt", "1 2\n")
    with pytest.raises(Exception, match="2 members"):
        readers.read_graph(spark, str(tmp_path / "two.zip")).collect()


@settings(max_examples=60, deadline=None)
@given(st.text(" \n12", max_size=40), st.integers(1, 9), st.integers(1, 7))
def test_ranges_hold_each_word_once(text, step, block):
    from unittest import mock

    data = text.encode()
    for ends, want in ((archives._SPACE, text.split()), (b"\n", [x for x in text.split("\n") if x])):
        got = []
        with mock.patch.object(archives, "BLOCK_BYTES", block):
            for lo, hi in archives._ranges(0, len(data), step):
                p = archives.Bytes("", 0, lo, hi, lo == 0, len(data))
                for part in archives._whole_words(io.BytesIO(data), p, ends):
                    got += [x.decode() for x in (part.split() if ends != b"\n" else part.split(b"\n")) if x]
        assert got == want


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_crc_of_both(a, b):
    assert archives.crc_of_both(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_results_by_extension(spark, tmp_path):
    c = spark.createDataFrame([(3, 2), (1, 0), (2, 5)], "v long, core int")
    writers.write_results(c, str(tmp_path / "r.npz"))
    with np.load(tmp_path / "r.npz") as z:
        assert z["N"].tolist() == [1, 2, 3] and z["K"].tolist() == [0, 5, 2]
    writers.write_results(c, str(tmp_path / "r.mtx"))
    assert rows(readers.read_graph(spark, str(tmp_path / "r.mtx"))) == [(1, 0), (2, 5), (3, 2)]
    writers.write_results(c, str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 3
    with pytest.raises(ValueError, match="xyz"):
        writers.write_results(c, str(tmp_path / "r.xyz"))


def test_zip_of_lists_and_arrays(spark, tmp_path):
    (tmp_path / "g.adjlist").write_text("# c\n0 6\n1 2 3\n2 3\n3 0\n6 1\n7\n")
    np.savez(tmp_path / "a.npz", src=np.array([a for a, _ in EDGES]), dst=np.array([b for _, b in EDGES]))
    for name in ("g.adjlist", "a.npz"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.write(tmp_path / name, name)
        assert rows(readers.read_graph(spark, str(tmp_path / f"{name}.zip"))) == EDGES
    with gzip.open(tmp_path / "a.npz.gz", "wb") as f:
        f.write((tmp_path / "a.npz").read_bytes())
    assert rows(readers.read_graph(spark, str(tmp_path / "a.npz.gz"))) == EDGES


def test_repeated_runs(spark, tmp_path):
    p = tmp_path / "g.txt"
    p.write_text("0 1\n1 2\n2 0\n")
    m = Decomposition(spark, str(p), strategy="local").measure(2)
    assert m["repeats"] == 2 and 0 < m["min_s"] <= m["mean_s"] <= m["max_s"] and m["peak_mb"] > 1
    assert m["executors"] and all(x["tasks"] > 0 and x["task_s"] > 0 for x in m["executors"].values())


def test_header_keeps_isolated_vertices(spark, tmp_path):
    from stratagraph.operators.degree import degrees

    path = str(tmp_path / "g.edges")
    writers.write_graph(spark.createDataFrame([*EDGES, (9, 8)], "src long, dst long"), path)
    e, v = readers.read_graph(spark, path), readers.read_vertices(spark, path)
    assert rows(e) == sorted([*EDGES, (9, 8)]) and v.count() == 10
    assert {r.v: r.deg for r in degrees(cl.clean(e), v).collect()}[5] == 0


def test_mtx_with_longer_header(spark, tmp_path):
    p = tmp_path / "x.mtx"
    p.write_text("%%MatrixMarket matrix coordinate real general\n% a\n% b\n7 7 3\n1 2 0.1\n2 3 0.2\n7 1 3\n")
    assert rows(readers.read_graph(spark, str(p))) == [(1, 2), (2, 3), (7, 1)]


def test_hdf5_is_optional(spark, tmp_path):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            readers.read_graph(spark, str(tmp_path / "x.h5"))


def test_patterns_and_exchange_format(spark, tmp_path):
    (tmp_path / "1.g").write_text("3\n0\t1\n1\t2\n")
    q = readers.read_query_graphs(spark, str(tmp_path))
    assert [r.line for r in writers.to_gsi(q).orderBy("k", "line").collect()] == ["t # 0", "3 2 1 1", "v 0 1", "v 1 1", "v 2 1", "bufTail 0 1 1", "bufTail 1 2 1", "t # -1"]


def test_run_over_a_file(spark, tmp_path):
    r = random.Random(1)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(80)]
    p = tmp_path / "g.txt"
    p.write_text("# header\n" + "".join(f"{a} {b}\n" for a, b in edges))
    want = {x.v: x.core for x in cores.core_numbers(cl.clean(spark.createDataFrame(edges, "src long, dst long")), "local").collect()}
    for relabel in (None, "dense", "degree_desc", "degeneracy"):
        d = Decomposition(spark, str(p), relabel=relabel, strategy="local")
        assert {x.v: x.core for x in d.run().collect()} == want
    d.write_results(str(tmp_path / "out.json"))
    text = "".join(open(tmp_path / "out.json" / f).read() for f in os.listdir(tmp_path / "out.json") if f.startswith("part"))
    assert {int(k): v for k, v in json.loads(text).items()} == {k: v for k, v in want.items() if v}
    d.write_profile(str(tmp_path / "prof"))
    d.write_profile(str(tmp_path / "prof"))
    assert spark.read.csv(str(tmp_path / "prof"), header=True).count() == 2
    assert d.profile()["max_core"] == max(want.values())
    with pytest.raises(ValueError):
        Decomposition(spark, str(p), prepared=True, cache_prepared=True)
    assert writers.serialized_name("/a/b.c/g.txt", "npz") == "/a/b.c/g.npz"


def test_entry_registers_queries(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "core_histogram" in q
