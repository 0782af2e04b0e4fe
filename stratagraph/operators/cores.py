"""Core numbers, shells, cores and degeneracy orders.

core_numbers takes a clean (symmetric, loop-free, distinct) edge list. Strategies:

* hindex (and auto, the default): every vertex lowers its estimate (first its degree) to the h-index of its neighbours'
  estimates until nothing changes. Each keeps the number of neighbours at or above its estimate; a changed vertex tells its neighbours, which
  take off those that fell below them, and only vertices with too few left look at their neighbours again. Few rounds, no order of deletion.
* peel: level by level, all vertices of degree <= level go at once. Gives the round in
  the level, hence a degeneracy order. Empty levels are skipped; with ``compact_below`` the edges are
  restricted to the survivors when few are left.
* local: connected components of at most ``most_edges`` edges are each peeled in one task on arrays; larger ones go by hindex.

``shells`` gives peel's rounds from known core numbers, with the removals of all levels side by side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.loop import BROADCAST_ROWS, Dealt, Rounds, kept, lookup, met, numbered, settle
from .clean import relabel
from .degree import degrees, hindex_of_counts
from .expand import induced

#: Directed edges of a component that one task may peel.
LOCAL_EDGES = 20_000


def core_numbers(e: DataFrame, strategy: str = "auto", isolated: DataFrame | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(v bigint, core int); isolated vertices have core 0."""
    if strategy in ("auto", "hindex"):
        c = _hindex(e, max_rounds)
    elif strategy in ("peel", "compacting"):
        c = peel(e, 0.02 if strategy == "compacting" else 0.0).select("v", "core")
    elif strategy == "local":
        c = local_cores(e)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    if isolated is None:
        return c
    return isolated.select("v").distinct().join(c, "v", "full").select("v", F.coalesce("core", F.lit(0)).alias("core"))


def _hindex(e: DataFrame, max_rounds: int) -> DataFrame:
    """(v, core)."""
    return _estimates(e, max_rounds, False).select("v", F.col("est").cast("int").alias("core"))


def _estimates(e: DataFrame, jobs: int, early: bool) -> DataFrame:
    """(v, est, deg), by ``_settled`` where the estimates may be broadcast and no vertex is a hub, else by ``_told``; ``early``: after so many jobs, settled or not."""
    tables = Rounds(e.sparkSession)
    e, _ = tables.keep(e.select("src", "dst"), n=F.count(F.lit(1)))
    deg, seen = tables.keep(degrees(e), n=F.count(F.lit(1)), edges=F.sum("deg"), largest=F.max("deg"))
    dealt = Dealt(e, "src", seen["edges"] or 0, largest=seen["largest"] or 0)
    try:
        small = seen["n"] <= BROADCAST_ROWS
        if small and not dealt.has_hubs:
            # the h-index of neighbours' estimates never rises, so it takes their place
            est = _settled(dealt, tables, deg.select("v", F.col("deg").alias("x")), "size(filter(near, (y, i) -> y > i))", jobs, early).withColumnRenamed("x", "est")
        else:
            est = _told(dealt, tables, deg, small, jobs * ROUNDS_A_JOB if early else jobs, early)
        est = est.select("v", "est")
        return settle(est.join(deg if small else met(deg), "v"))
    finally:
        dealt.clear()
        tables.clear()


def early_order(e: DataFrame, jobs: int = 1) -> DataFrame:
    """(v, est, deg, ord): numbers by estimate after some rounds, degree and id, for work that any order gives right and a degeneracy order makes small.

    At most est neighbours have a higher estimate; those of an equal one add to them. Unlike the rounds of a peel, the work has a bound.
    """
    return numbered(_estimates(e, jobs, True), "est", "deg", "v", name="ord")


#: Rounds of one job where the values of all vertices are broadcast.
ROUNDS_A_JOB = 4


def _settled(dealt: Dealt, tables: Rounds, values: DataFrame, rule: str, max_rounds: int, early: bool = False) -> DataFrame:
    """(v, x): values of few vertices, each worked out from its neighbours' (``near``, largest first) until nothing changes.

    A round is one stage over the stored edges, where they lie: one broadcast of the values, no exchange. Some rounds make a job, which writes the
    values of the last one. ``rule`` may use further columns of the edges, equal for all edges of a vertex.
    """
    more = [c for c in dealt.edges.columns if c not in ("src", "dst")]
    for _ in range(max_rounds):
        for _ in range(ROUNDS_A_JOB):
            before = values
            seen = dealt.edges.join(F.broadcast(before.select(F.col("v").alias("dst"), "x")), "dst")
            near = seen.groupBy("src").agg(F.sort_array(F.collect_list("x"), asc=False).alias("near"), *[F.first(c).alias(c) for c in more])
            values = near.select(F.col("src").alias("v"), F.expr(rule).cast("long").alias("x"))
        both = values.join(F.broadcast(before.select("v", F.col("x").alias("was"))), "v", "left")
        values, seen = tables.keep(both, moved=F.count_if(~F.col("x").eqNullSafe(F.col("was"))))
        values = values.select("v", "x")
        if not seen["moved"]:
            return values
    if early:
        return values
    raise RuntimeError("values did not settle")


def _told(dealt: Dealt, tables: Rounds, deg: DataFrame, small: bool, max_rounds: int, early: bool = False) -> DataFrame:
    """(v, est), for graphs whose estimates are moved. State of a vertex: est, cnt (neighbours of an estimate of est or more, as far as it was told) and old (est before the last round).

    A round reads the edges of the vertices that changed in the round before, which go to their neighbours as counts, and those of
    the vertices that this leaves too few; what it moves falls with the changes. The stored edges themselves are never moved.
    """
    hubs = dealt.hubs.select(F.col("src").alias("dst")) if dealt.has_hubs else None
    own = (lambda df: df) if small else met
    # without hubs, rows are dealt once, by vertex and like the state, before they are counted: what follows moves nothing
    by_vertex = (lambda df, key: df) if small or dealt.has_hubs else (lambda df, key: df.repartition(dealt.buckets, key))
    moved = {"moved": F.count_if(F.col("est") < F.col("old")), "n": F.count(F.lit(1))}

    def found(near: DataFrame) -> DataFrame:
        """(v, h, cnt) from edges (src, ne)."""
        return hindex_of_counts(by_vertex(near, "src").groupBy("src", "ne").agg(F.count(F.lit(1)).alias("c")), "src")

    # all send their degrees: edges are symmetric, so what goes out along a stored edge is what its other end needs
    told = dealt.join(deg.select(F.col("v").alias("src"), F.col("deg").alias("ne")), small).select(F.col("dst").alias("src"), "ne")
    first = found(told).join(own(deg), "v").select("v", F.col("h").alias("est"), "cnt", F.col("deg").alias("old"))
    buckets = 0 if small else dealt.buckets
    state, seen = tables.keep(first.repartition(buckets, "v") if buckets else first, buckets, **moved)
    for _ in range(max_rounds):
        if not seen["moved"]:
            return state
        now = state.select(F.col("v").alias("dst"), "est")
        fell = state.where("est < old").select(F.col("v").alias("src"), "old", F.col("est").alias("new"))
        # neighbours that counted a vertex and no longer can
        lost = by_vertex(dealt.join(fell, small).select("dst", "old", "new"), "dst").groupBy("dst", "old", "new").agg(F.count(F.lit(1)).alias("c"))
        lost = lookup(lost, "dst", now, small).where("old >= est and est > new").groupBy(F.col("dst").alias("v")).agg(F.sum("c").alias("lost"))
        after = state.join(own(lost), "v", "left").select("v", "est", (F.col("cnt") - F.coalesce("lost", F.lit(0))).alias("cnt"))
        short = after.where("cnt < est").select(F.col("v").alias("src"), F.col("est").alias("top"))
        near = lookup(dealt.join(short, small), "dst", now, small, hubs).select("src", F.least("est", "top").alias("ne"))
        lower = found(near).select("v", "h", F.col("cnt").alias("base"))
        both = after.join(own(lower), "v", "left").select("v", F.coalesce("h", "est").alias("est"), F.coalesce("base", "cnt").alias("cnt"), F.col("est").alias("old"))
        state, seen = tables.keep(both, buckets, **moved)
    if early or not seen["moved"]:
        return state
    raise RuntimeError("estimates did not settle")


def shells(e: DataFrame, cores: DataFrame, max_rounds: int = 1_000_000) -> DataFrame:
    """(v, core, round): the rounds of ``peel``, from known core numbers.

    When its level begins, a vertex has its neighbours of equal or higher core left, and goes in the first round in which those of equal core that
    remain are no more than its room: its core less its neighbours of higher core. So the levels don't wait for each other: the removals of all of them
    run side by side, over edges inside shells alone, and there are as many rounds as the longest level has.

    Seen from a vertex, its round is one after that of the first neighbour too many: 1 + the (room + 1)-th largest round of its neighbours in the shell.
    """
    tables, cores = Rounds(e.sparkSession), settle(cores.select("v", "core"))
    e, _ = tables.keep(e.select("src", "dst"), n=F.count(F.lit(1)))
    n, inner = cores.count(), None
    small = n <= BROADCAST_ROWS
    a, b = cores.select(F.col("v").alias("src"), F.col("core").alias("cs")), cores.select(F.col("v").alias("dst"), F.col("core").alias("cd"))
    try:
        ends = (e.join(F.broadcast(a), "src").join(F.broadcast(b), "dst") if small else e.join(a, "src").join(b, "dst")).where("cd >= cs")
        start = ends.groupBy(F.col("src").alias("v")).agg(F.first("cs").alias("core"), F.count_if(F.col("cd") > F.col("cs")).alias("higher"), F.count_if(F.col("cd") == F.col("cs")).alias("inside"))
        stay, seen = tables.keep(start.select("v", "core", (F.col("core") - F.col("higher")).alias("room"), "inside"), edges=F.sum("inside"), largest=F.max("inside"), alive=F.count(F.lit(1)))
        edges, largest = seen["edges"] or 0, seen["largest"] or 0
        rooms = stay.select(F.col("v").alias("src"), "room")
        inside = ends.where("cd = cs").select("src", "dst")
        inner = Dealt(lookup(inside, "src", rooms, True) if small else inside, "src", edges, largest=largest)
        if small and not inner.has_hubs:
            rounds = _settled(inner, tables, stay.select("v", F.lit(1).cast("long").alias("x")), "if(size(near) <= room, 1, 1 + near[cast(room as int)])", max_rounds)
            return settle(stay.join(rounds, "v", "left").select("v", "core", F.coalesce("x", F.lit(1)).cast("int").alias("round")))
        gone, alive, at = [], seen["alive"], seen["alive"]
        state = stay.withColumnRenamed("inside", "left")
        for r in range(1, max_rounds):
            if not alive:
                break
            # those that go tell their neighbours, as partial counts
            front = state.where("left <= room")
            gone.append(front.select("v", "core", F.lit(r).alias("round")))
            if len(gone) >= 64:
                gone = [settle(_union(gone))]
            hits = inner.join(front.select(F.col("v").alias("src")), small).groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("hits"))
            rest = state.where("left > room").join(hits if small else met(hits), "v", "left")
            state, seen = tables.keep(rest.select("v", "core", "room", (F.col("left") - F.coalesce("hits", F.lit(0))).alias("left")), alive=F.count(F.lit(1)), edges=F.sum("left"))
            alive = seen["alive"]
            # the rest is a smaller problem of the same kind: its edges are stored anew, and few vertices end by broadcast
            if alive and (alive <= at // 2 or not small and alive <= BROADCAST_ROWS):
                at, small = alive, alive <= BROADCAST_ROWS
                few = _inside(inner.edges.select("src", "dst"), state, small)
                before, inner = inner, Dealt(lookup(few, "src", state.select(F.col("v").alias("src"), "room"), True) if small else few, "src", seen["edges"] or 0)
                before.clear()
                if small and not inner.has_hubs:
                    rounds = _settled(inner, tables, state.select("v", F.lit(1).cast("long").alias("x")), "if(size(near) <= room, 1, 1 + near[cast(room as int)])", max_rounds)
                    gone.append(state.join(F.broadcast(rounds), "v", "left").select("v", "core", (F.coalesce("x", F.lit(1)) + r).cast("int").alias("round")))
                    break
        else:
            raise RuntimeError("the rounds did not end")
        return settle(_union(gone) if gone else cores.select("v", "core", F.lit(1).alias("round")))
    finally:
        if inner is not None:
            inner.clear()
        tables.clear()


def _inside(e: DataFrame, vs: DataFrame, small: bool) -> DataFrame:
    """Edges with both ends in the set; ``small``: it may be broadcast."""
    side = F.broadcast if small else met
    a, b = vs.select(F.col("v").alias("src")), vs.select(F.col("v").alias("dst"))
    return e.join(side(a), "src", "left_semi").join(side(b), "dst", "left_semi").select("src", "dst")


def ordered(e: DataFrame, strategy: str = "auto") -> DataFrame:
    """(v, core, round): by known core numbers and ``shells``, or by ``peel``."""
    if strategy in ("peel", "compacting"):
        return peel(e, 0.02 if strategy == "compacting" else 0.0)
    e = kept(e)
    return shells(e, core_numbers(e, strategy))


def peel(e: DataFrame, compact_below: float = 0.0, max_rounds: int = 1_000_000) -> DataFrame:
    """(v, core, round): level-synchronous deletion; round counts from 1 within a level."""
    tables = Rounds(e.sparkSession)
    e, _ = tables.keep(e.select("src", "dst"), n=F.count(F.lit(1)))
    state, seen = tables.keep(degrees(e), alive=F.count(F.lit(1)), least=F.min("deg"), edges=F.sum("deg"), largest=F.max("deg"))
    dealt = Dealt(e, "src", seen["edges"] or 0, largest=seen["largest"] or 0)
    figures = {"alive": F.count(F.lit(1)), "least": F.min("deg"), "edges": F.sum("deg")}
    try:
        n, gone, level, r = seen["alive"], [], -1, 0
        small = n <= BROADCAST_ROWS
        for _ in range(max_rounds):
            if not seen["alive"]:
                break
            level, r = (seen["least"], 1) if seen["least"] > level else (level, r + 1)
            front = state.where(F.col("deg") <= level).select("v")
            gone.append(front.withColumn("core", F.lit(int(level))).withColumn("round", F.lit(r)))
            hits = dealt.join(front.select(F.col("v").alias("src")), small).groupBy(F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("hits"))
            rest = state.where(F.col("deg") > level).join(hits if small else met(hits), "v", "left").select("v", (F.col("deg") - F.coalesce("hits", F.lit(0))).alias("deg"))
            state, seen = tables.keep(rest, **figures)
            if len(gone) >= 16:
                gone = [settle(_union(gone))]
            left = seen["alive"]
            # large graphs are stored anew whenever half of the vertices are gone, so that what rounds read falls with what is left
            if left and left < max(compact_below, 0.0 if small else 0.5) * n:
                small = left <= BROADCAST_ROWS
                before, dealt, n = dealt, Dealt(_inside(dealt.edges.select("src", "dst"), state, small), "src", seen["edges"] or 0), left
                before.clear()
        return settle(_union(gone)) if gone else settle(state.select("v", F.lit(0).alias("core"), F.lit(0).alias("round")))
    finally:
        dealt.clear()
        tables.clear()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def connected_components(e: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(v, component): the least id reachable. Labels go out along the edges and then jump to their label's label.

    A hub's neighbours meet as partial minima, its own edges lie in lots, and a label of many vertices is looked up once.
    """
    tables = Rounds(e.sparkSession)
    e, seen = tables.keep(e.select("src", "dst"), n=F.count(F.lit(1)))
    dealt = Dealt(e, "src", seen["n"])
    try:
        lowest = dealt.edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("v"), F.least("src", "m").alias("component"))
        c, seen = tables.keep(lowest, n=F.count(F.lit(1)))
        small = seen["n"] <= BROADCAST_ROWS
        for _ in range(max_rounds):
            near = dealt.join(c.select(F.col("v").alias("src"), "component"), small).groupBy(F.col("dst").alias("v")).agg(F.min("component").alias("m"))
            step = c.join(near if small else met(near), "v").select("v", F.least("component", "m").alias("to"), F.col("component").alias("old"))
            far = c.select(F.col("v").alias("to"), F.col("component").alias("far"))
            if small:
                new = step.join(F.broadcast(far), "to")
            else:
                names, labels = tables.keep(step.select("to").distinct().join(met(far), "to"), n=F.count(F.lit(1)))
                new = lookup(step, "to", names, labels["n"] <= BROADCAST_ROWS)
            c, seen = tables.keep(new.select("v", F.least("to", "far").alias("component"), "old"), moved=F.count_if(F.col("component") != F.col("old")))
            c = c.select("v", "component")
            if not seen["moved"]:
                return settle(c)
        raise RuntimeError("components did not settle")
    finally:
        dealt.clear()
        tables.clear()


def peel_arrays(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, core numbers and rounds of a symmetric edge list in memory."""
    v, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    s, d = at[: len(src)], at[len(src) :]
    order = np.argsort(s, kind="stable")
    d = d[order]
    first = np.searchsorted(s[order], np.arange(len(v) + 1))
    deg = np.diff(first)
    core, rnd = np.full(len(v), -1), np.zeros(len(v), np.int64)
    left, level = len(v), -1
    while left:
        alive = core < 0
        level = max(level, int(deg[alive].min()))
        front, r = np.flatnonzero(alive & (deg <= level)), 0
        while len(front):
            r += 1
            core[front], rnd[front] = level, r
            left -= len(front)
            size = first[front + 1] - first[front]
            hit = d[np.repeat(first[front] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            hit, times = np.unique(hit[core[hit] < 0], return_counts=True)
            deg[hit] -= times
            front = hit[deg[hit] <= level]
    return v, core, rnd


def _split(e: DataFrame, most_edges: int) -> tuple[DataFrame, DataFrame]:
    """Edges of components of at most ``most_edges`` edges, with the component, and the edges of the others."""
    e = kept(e)
    parts = connected_components(e)
    # sizes come from degrees: nothing is written by edge but the edges of each kind
    sizes = parts.join(met(degrees(e)), "v").groupBy("component").agg(F.sum("deg").alias("n"))
    large = settle(sizes.where(F.col("n") > most_edges).select("component"))
    # at most edges / most_edges of them
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    small = settle(parts.join(large, "component", "left_anti").select(F.col("v").alias("src"), "component"))
    if not small.limit(1).count():
        return e.withColumn("component", F.lit(None).cast("long")).where("false"), e
    few = settle(parts.join(large, "component", "left_semi").select(F.col("v").alias("src")))
    return e.join(met(small), "src"), kept(e.join(met(few), "src", "left_semi").select("src", "dst"))


def _peel_small(tagged: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v, core, rnd = peel_arrays(pdf["src"].to_numpy(), pdf["dst"].to_numpy())
        return pd.DataFrame({"v": v, "core": core.astype("int32"), "round": rnd.astype("int32")})

    return tagged.groupBy("component").applyInPandas(run, "v long, core int, round int")


def local_cores(e: DataFrame, most_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, core) by connected components: small ones in a task each, larger ones by hindex."""
    tagged, rest = _split(e, most_edges)
    return _peel_small(tagged).select("v", "core").unionByName(_hindex(rest, 100_000))


def local_peel(e: DataFrame, most_edges: int = LOCAL_EDGES) -> DataFrame:
    """(v, core, round) by connected components: small ones in a task each, larger ones by ``shells``."""
    tagged, rest = _split(e, most_edges)
    return _peel_small(tagged).unionByName(shells(rest, _hindex(rest, 100_000)))


def degeneracy_order(peeled: DataFrame) -> DataFrame:
    """(v, core, round, ord): numbers by (core, round, id); each vertex has at most core later neighbours."""
    return numbered(peeled, "core", "round", "v", name="ord")


def degeneracy_relabel(e: DataFrame, order: DataFrame) -> DataFrame:
    return relabel(e, order.select("v", F.col("ord").alias("idx")))


def core_histogram(cores: DataFrame) -> DataFrame:
    """(core, n, removed): vertices of each core number, and how many are gone after its level.

    The running total goes over at most as many rows as there are core numbers.
    """
    from pyspark.sql import Window

    c = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("removed", F.sum("n").over(Window.orderBy("core").rowsBetween(Window.unboundedPreceding, 0)))


def core_summary(cores: DataFrame) -> DataFrame:
    return cores.agg(F.max("core").alias("max_core"), F.round(F.avg("core"), 6).alias("avg_core"), F.count(F.lit(1)).alias("n"))


def k_core(e: DataFrame, cores: DataFrame, k: int) -> DataFrame:
    """Edges among vertices of core number k or more."""
    return induced(e, cores.where(F.col("core") >= k).select("v"))


def k_shell(cores: DataFrame, k: int) -> DataFrame:
    return cores.where(F.col("core") == k)
