"""Approximate nearest neighbours over learned partitions.

A bounded sample of the vectors gives a k-nearest-neighbour graph, which balanced recursive
bisection (spectral order, then swaps that cut fewer edges) splits into parts. A small neural classifier learns to tell the part
from the vector. It assigns every row to its likeliest part; queries go to their
most probable parts, as many as the sample needs for the wanted recall, and are
reranked there with exact cosines in double precision.

Parts grow with the square root of the table. Beyond ``TOP_PARTS`` of them each part is split once more in
the same way, from a sample of its own rows and in a task of its own; rows and queries then go by the
product of both classifiers' probabilities.

Only samples (``SAMPLE`` vectors) and models (at most ``TOP_PARTS`` + 1) come to the driver or to one task. Parts are
cut into blocks of at most ``block_rows`` rows and ``block_queries`` queries, so that a part holding a third of all rows
is many tasks. Equal vectors of a block are scored once.

Vectors that are null, empty, zero, or hold a null or non-finite component take no part, neither as queries nor as rows;
nor do those of another length than most of the table's. Components of any size count: vectors are scaled by
a power of two first, so that norms neither overflow nor vanish. Ties go to
the smaller id; rows with a null id take no part; of rows with equal ids the nearest counts. With
fewer candidates than k all are returned. An empty table, or one without a usable vector, gives no rows. Other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .common import prepare, stored

SAMPLE = 6000
TOP_PARTS = 256
SUB_PARTS = 64
NEIGHBOURS = 10
HIDDEN = 128
BLOCK_ROWS = 20_000
BLOCK_QUERIES = 5_000
WANTED_RECALL = 0.97


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, which puts their largest component between 0.5 and 1 and leaves cosines as they are, to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def nearest(q: np.ndarray, x: np.ndarray, k: int, own: np.ndarray | None = None) -> np.ndarray:
    """Places of the k nearest rows of unit vectors x to each of q, block by block."""
    out = []
    for i in range(0, len(q), 512):
        s = q[i : i + 512] @ x.T
        if own is not None:
            s[np.arange(len(s)), own[i : i + 512]] = -9
        out.append(np.argpartition(-s, min(k, len(x) - 1) - 1, 1)[:, :k])
    return np.concatenate(out)


def bisect(a: np.ndarray, b: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """A balanced half of a graph with edges (a, b): spectral order by power iteration, refined by swaps."""
    deg = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
    v = rng.standard_normal(n)
    w = np.sqrt(deg)
    for _ in range(60):
        v -= w * (v @ w) / (w @ w)
        u = v / w
        v = v + (np.bincount(a, u[b], n) + np.bincount(b, u[a], n)) / w
        v /= np.sqrt(v @ v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v / w, kind="stable")[: n // 2]] = True
    for _ in range(20):
        other = np.bincount(a, side[b] != side[a], n) + np.bincount(b, side[a] != side[b], n)
        gain = 2 * other - (np.bincount(a, minlength=n) + np.bincount(b, minlength=n))
        l, r = np.flatnonzero(side), np.flatnonzero(~side)
        l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
        m = max(1, n // 100)
        ok = gain[l[:m][: len(r)]] + gain[r[:m][: len(l)]] > 2
        l, r = l[: len(ok)][ok], r[: len(ok)][ok]
        if not len(l):
            break
        before = (side[a] != side[b]).sum()
        side[l], side[r] = False, True
        if (side[a] != side[b]).sum() >= before:
            side[l], side[r] = True, False
            break
    return side


def partition_graph(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each node; parts (a power of two) are equal but for one node."""
    rng, n = np.random.default_rng(seed), len(near)
    src = np.repeat(np.arange(n), near.shape[1])
    part = np.zeros(n, np.int64)
    done = 1
    while done < parts:
        for p in range(done):
            own = np.flatnonzero(part == p)
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            a, b = at[src], at[near.ravel()]
            ok = (a >= 0) & (b >= 0)
            half = bisect(a[ok], b[ok], len(own), rng)
            part[own[~half]] = p + done
        done *= 2
    return part


@dataclass
class Router:
    """One hidden layer; gives the log-probability of each part, and how many parts to ask."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x)
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


class Routers:
    """The classifier of the table and, if parts are split, those of the parts; part p's sub-part s is number p + s * step."""

    def __init__(self, top: Router, subs: dict[int, Router], step: int):
        self.top, self.subs, self.step = top, subs, step
        self.probes = top.probes * max((r.probes for r in subs.values()), default=1)

    def route(self, x: np.ndarray, ask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each unit vector, likeliest first, and offsets: its home, and with ``ask`` all parts to search."""
        top = self.top.log_probability(x)
        order = np.argsort(-top, 1, kind="stable")
        wide = np.where(ask, self.top.probes, 1)
        row = np.repeat(np.arange(len(x)), wide)
        part = order[row, np.arange(len(row)) - np.repeat(np.cumsum(wide) - wide, wide)]
        if not self.subs:
            return part, np.concatenate([[0], np.cumsum(wide)])
        rows, parts, logs = [], [], []
        for p in np.unique(part).tolist():
            own = row[part == p]
            sub = self.subs.get(p)
            z = sub.log_probability(x[own]) if sub else np.zeros((len(own), 1))
            rows.append(np.repeat(own, z.shape[1]))
            parts.append(np.tile(p + np.arange(z.shape[1]) * self.step, len(own)))
            logs.append((z + top[own, p][:, None]).ravel())
        row, part, z = map(np.concatenate, (rows, parts, logs))
        # the home of a row that doesn't ask is the likeliest sub-part of its likeliest part; the same goes for those that ask
        first = part % self.step == order[row, 0]
        home = np.lexsort((part, -z, ~first, row))
        row, part, z = row[home], part[home], z[home]
        begin = np.searchsorted(row, np.arange(len(x)))
        lead = np.zeros(len(row), bool)
        lead[begin] = True
        by = np.lexsort((part, -z, ~lead, row))
        nth = np.arange(len(row)) - begin[row]
        keep = nth < np.where(ask, self.probes, 1)[row]
        part, row = part[by][keep], row[keep]
        return part, np.searchsorted(row, np.arange(len(x) + 1))


def fit_router(x: np.ndarray, target: np.ndarray, epochs: int = 30, seed: int = 7) -> Router:
    """Cross-entropy on soft targets (own part and neighbours' parts) with Adam."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, HIDDEN)) * (2 / d) ** 0.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, p)) * (1 / HIDDEN) ** 0.5, np.zeros(p)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    x = x * d**0.5
    for e in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            own = order[i : i + 256]
            h = np.maximum(x[own] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(1, keepdims=True))
            g = (z / z.sum(1, keepdims=True) - target[own]) / len(own)
            gh = (g @ w[2].T) * (h > 0)
            t += 1
            for k, gk in enumerate((x[own].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk * gk
                w[k] -= 0.003 * (1 - e / epochs) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(w[0] * d**0.5, w[1], w[2], w[3])


def train(x: np.ndarray, parts: int, k: int) -> Router:
    """Graph, parts, classifier and number of probes from sampled unit vectors."""
    n = len(x)
    parts = 1 << max(0, min(parts, max(1, n // 16)).bit_length() - 1)
    if parts < 2:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    near = nearest(x, x, min(NEIGHBOURS, n - 1), np.arange(n))
    part = partition_graph(near, parts)
    target = np.zeros((n, parts))
    np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
    target[np.arange(n), part] += 0.5
    # the number of probes: on held-out samples, with a model that hasn't seen them
    held = np.arange(n) % 5 == 0
    trial = fit_router(x[~held], target[~held])
    home, order = trial.scores(x).argmax(1), np.argsort(-trial.scores(x[held]), 1, kind="stable")
    true = nearest(x[held], x, min(k, n - 1), np.flatnonzero(held))
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], 1)
    need = np.take_along_axis(rank, home[true], 1)
    recall = [(need < p).mean() for p in range(1, parts + 1)]
    router = fit_router(x, target)
    router.probes = min(parts, 1 + next(i for i, r in enumerate(recall, 1) if r >= WANTED_RECALL))
    return router


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Usable vectors of one length as a matrix in double precision."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def best(q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, cosine) of the k nearest rows of each query, ties to smaller ids, without its own id."""
    order = np.argsort(ids, kind="stable")
    x, ids_sorted = x[order], ids[order]
    # equal vectors: scored once; of each the first k + 1 ids can matter
    _, first, kind = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(kind, kind="stable")
    nth = np.arange(len(by)) - np.searchsorted(kind[by], kind[by])
    by = by[nth <= k]
    begin = np.searchsorted(kind[by], np.arange(len(first) + 1))
    u = x[first]
    un, qn = np.sqrt((u * u).sum(1)), np.sqrt((q * q).sum(1))
    a, b, c = [], [], []
    for i in range(0, len(q), 128):
        s = (q[i : i + 128] @ u.T) / un / qn[i : i + 128, None]
        least = -np.partition(-s, min(k + 1, s.shape[1]) - 1, 1)[:, min(k + 1, s.shape[1]) - 1]
        rows, cols = np.nonzero(s >= least[:, None] - 1e-9)
        # the measure itself, in one order of operations whatever the block
        exact = (q[i + rows] * u[cols]).sum(1) / (qn[i + rows] * un[cols])
        size = begin[cols + 1] - begin[cols]
        rows, exact = np.repeat(rows, size), np.repeat(exact, size)
        place = by[np.repeat(begin[cols] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        keep = ids_sorted[place] != qid[i + rows]
        rows, exact, place = rows[keep], exact[keep], place[keep]
        o = np.lexsort((ids_sorted[place], -exact, rows))
        rows, exact, place = rows[o], exact[o], place[o]
        top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        a.append(i + rows[top])
        b.append(order[place[top]])
        c.append(exact[top])
    return np.concatenate(a), np.concatenate(b), np.concatenate(c)


def search(vectors: DataFrame, queries, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", parts: int | None = None, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The k nearest rows found for each query: query_id, rank, vec_id, score. ``queries``: a condition on vec_id."""
    spark = vectors.sparkSession
    prepare(spark)
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    v = v.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0))
    out = "query_id long, rank int, vec_id long, score double"
    most = v.groupBy(F.size("e").alias("dim")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    if not most:
        return spark.createDataFrame([], out)
    dim, rows = most
    v = v.where(F.size("e") == dim)

    def sampled(df: DataFrame, share: float) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, share)))

    sample = sampled(v, SAMPLE / rows).select("e").toArrow()
    if not sample.num_rows:
        sample = v.limit(SAMPLE).select("e").toArrow()  # a table too small for the hash to hit
    if parts is None:
        # as many parts as keeps a query's share of rows falling with the square root of the table
        parts = max(16, int(rows**0.5 / 4))
    # equal vectors say nothing new about the graph
    top = train(unit(np.unique(scaled(_matrix(sample.column(0), dim)), axis=0)), min(parts, TOP_PARTS), k)
    split = min(SUB_PARTS, 1 << (-(-parts // TOP_PARTS) - 1).bit_length())
    subs = {}
    if split > 1:
        sent = spark.sparkContext.broadcast(top)

        def homes(batches):
            for b in batches:
                x = scaled(_matrix(b.column(0), dim))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(sent.value.scores(unit(x)).argmax(1), pa.int32()), b.column(0)], names=["part", "e"])

        def learn(rows: pa.Table) -> pa.Table:
            x = unit(np.unique(scaled(_matrix(rows.column("e"), dim)), axis=0))[: 2 * SAMPLE]
            return pa.table({"part": rows.column("part").slice(0, 1), "model": pa.array([pickle.dumps(train(x, split, k))], pa.binary())})

        some = sampled(v, SAMPLE / rows * TOP_PARTS).select("e").mapInArrow(homes, "part int, e array<double>").distinct()
        size = some.groupBy("part").count().withColumn("share", F.lit(float(SAMPLE)) / F.col("count")).drop("count")
        # a part that many rows fall into has its sample thinned before it goes to one task
        some = some.join(F.broadcast(size), "part").where(F.pmod(F.xxhash64("e"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("part", "e")
        subs = {r.part: pickle.loads(bytes(r.model)) for r in some.groupBy("part").applyInArrow(learn, "part int, model binary").collect()}
    router = spark.sparkContext.broadcast(Routers(top, subs, TOP_PARTS))
    routed = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("e", T.ArrayType(T.DoubleType())), T.StructField("ask", T.BooleanType()), T.StructField("parts", T.ArrayType(T.IntegerType()))])

    def route(batches):
        r = router.value
        for b in batches:
            if b.num_rows:
                x = scaled(_matrix(b.column(1), dim))
                part, off = r.route(unit(x), np.array(b.column(2), bool))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel())), b.column(2), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(part, pa.int32()))], names=["vec_id", "e", "ask", "parts"])

    # once: all that follows reads the routed table
    r = stored(v.withColumn("ask", F.coalesce(queries(F.col("vec_id")), F.lit(False))).mapInArrow(route, routed))
    home = r.select("vec_id", "e", F.col("parts")[0].alias("part"))
    ask = r.where("ask").select(F.col("vec_id").alias("query_id"), F.col("e").alias("qe"), F.explode("parts").alias("part"))
    # blocks of each part: as many rows as there are parts, at most TOP_PARTS * SUB_PARTS
    n_rows = home.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("nb"))
    n_ask = ask.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block_queries).alias("nq"))
    grid = F.broadcast(n_rows.join(n_ask, "part"))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = home.join(grid, "part").select("part", F.pmod(F.xxhash64("vec_id"), F.col("nb")).alias("b"), spread("nq").alias("q"), "vec_id", "e")
    right = ask.join(grid, "part").select(F.col("part").alias("part_"), spread("nb").alias("b_"), F.pmod(F.xxhash64("query_id"), F.col("nq")).alias("q_"), "query_id", "qe")

    def rerank(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        m, q = _matrix(rows.column("e"), dim), _matrix(asked.column("qe"), dim)
        ids, qid = rows.column("vec_id").to_numpy(), asked.column("query_id").to_numpy()
        a, b, c = best(q, qid, m, ids, k)
        return pa.table({"query_id": qid[a], "vec_id": ids[b], "score": c})

    found = left.groupBy("part", "b", "q").cogroup(right.groupBy("part_", "b_", "q_")).applyInArrow(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
