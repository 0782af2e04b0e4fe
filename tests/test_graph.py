import itertools
import os
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratagraph.operators import clean as cl
from stratagraph.operators import cliques, cores
from stratagraph.operators import degree as dg
from stratagraph.operators import expand as ex

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def samples():
    """The sample graphs of FIXTURES.md: (name, edges, cores)."""
    out = []
    for line in open(f"{ROOT}/FIXTURES.md", encoding="utf-8"):
        m = re.match(r"\| (\d\d) \| \d+ \| \d+ \| \d+ \| ([\d\- ]+) \| ([\d:,; ]+) \|", line)
        if m:
            edges = [tuple(map(int, e.split("-"))) for e in m[2].split()]
            core = {int(v): int(k) for k, vs in (x.split(":") for x in m[3].split(";")) for v in vs.split(",")}
            out.append((m[1], edges, core))
    return out


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def peel_by_hand(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out, k = {}, 0
    while near:
        low = [v for v in near if len(near[v]) <= k]
        if not low:
            k += 1
        for v in low:
            out[v] = k
        for v in low:
            for u in near.pop(v):
                near.get(u, set()).discard(v)
    return out


def random_edges(n, m, seed):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


def test_samples_read():
    assert len(samples()) == 14


@pytest.mark.parametrize("strategy", ["hindex", "peel", "local", "compacting"])
def test_samples_in_one_graph(spark, strategy):
    """All sample graphs side by side (ids shifted), with the edges turned, repeated and looped."""
    edges, want = [], {}
    for i, (_, es, core) in enumerate(samples()):
        edges += [(a + 1000 * i, b + 1000 * i) for a, b in es] + [(b + 1000 * i, a + 1000 * i) for a, b in es[::2]] + [(es[0][0] + 1000 * i,) * 2]
        want |= {v + 1000 * i: k for v, k in core.items()}
    got = cores.core_numbers(cl.clean(frame(spark, edges)), strategy)
    assert {r.v: r.core for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2])
def test_strategies_agree_on_random_graphs(spark, seed):
    edges = random_edges(60, 300, seed)
    e = cl.clean(frame(spark, edges))
    want = peel_by_hand(edges)
    for s in ("hindex", "local"):
        assert {r.v: r.core for r in cores.core_numbers(e, s).collect()} == want
    a, b = cores.peel(e), cores.local_peel(e)
    assert sorted(a.collect()) == sorted(b.select(*a.columns).collect())


@pytest.mark.parametrize("rows", [500_000, 3])
def test_shells_side_by_side(spark, monkeypatch, rows):
    """The rounds of a level-by-level peel, of graphs of many levels and of one with long levels; estimates broadcast or moved, hubs whole or in lots."""
    monkeypatch.setattr(cores, "BROADCAST_ROWS", rows)
    edges = random_edges(40, 150, 7) + [(100 + i, 101 + i) for i in range(17)] + [(a, b) for a in range(200, 207) for b in range(a)][-12:]
    e = cl.clean(frame(spark, edges))
    want = {}
    src, dst = (np.array(x, np.int64) for x in zip(*[(r.src, r.dst) for r in e.collect()]))
    for v, core, rnd in zip(*(x.tolist() for x in cores.peel_arrays(src, dst))):
        want[v] = (core, rnd)
    assert {r.v: (r.core, r.round) for r in cores.ordered(e).collect()} == want
    if rows == 3:
        from stratagraph.plans import loop

        monkeypatch.setattr(cores, "Dealt", lambda e, key, edges, largest=None: loop.Dealt(e, key, edges, most=5))
        assert {r.v: (r.core, r.round) for r in cores.ordered(e).collect()} == want


def test_rounds_read_stored_edges_without_an_exchange(spark):
    from stratagraph.plans.loop import Dealt

    e = cl.clean(frame(spark, random_edges(50, 300, 3)))
    d = Dealt(e, "src", e.count(), largest=50)
    value = spark.range(50).select(F.col("id").alias("src"), F.col("id").alias("x"))
    for met in (d.join(value, True), d.join(value.hint("merge"))):
        got = met.groupBy("src").agg(F.sum("x").alias("x"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        lines = plan.split("\n")
        at = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
        deep = lambda x: len(x) - len(x.lstrip(" :+-"))
        above, depth = [], deep(lines[at])
        for x in reversed(lines[:at]):  # the operators between the scan and the result
            if deep(x) < depth:
                depth = deep(x)
                above.append(x)
        assert not [x for x in above if "Exchange" in x], plan
        assert got.count() == cl.vertices(e).count()
    d.clear()


def test_order_is_a_degeneracy_order(spark):
    e = cl.clean(frame(spark, random_edges(50, 260, 5)))
    order = {r.v: r for r in cores.degeneracy_order(cores.peel(e)).collect()}
    assert sorted(r.ord for r in order.values()) == list(range(len(order)))
    later = {}
    for r in e.collect():
        later[r.src] = later.get(r.src, 0) + (order[r.dst].ord > order[r.src].ord)
    assert all(later[v] <= order[v].core for v in order)


def test_isolated_empty_and_odd_ids(spark):
    e = cl.clean(spark.createDataFrame([(1, 1), (None, 2), (3, None), (-5, 1 << 40), (1 << 40, -5)], "src long, dst long"))
    assert sorted((r.src, r.dst) for r in e.collect()) == [(-5, 1 << 40), (1 << 40, -5)]
    iso = spark.createDataFrame([(9,), (-5,)], "v long")
    assert {r.v: r.core for r in cores.core_numbers(e, "local", iso).collect()} == {-5: 1, 1 << 40: 1, 9: 0}
    assert {r.v: r.deg for r in dg.degrees(e, iso).collect()} == {-5: 1, 1 << 40: 1, 9: 0}
    none = cl.clean(frame(spark, []))
    for s in ("hindex", "peel", "local"):
        assert cores.core_numbers(none, s).count() == 0
    assert dg.csr_offsets(none).count() == 0
    assert dg.graph_size(none).first() == (0, 0)


def test_relabel_and_back(spark):
    edges = random_edges(40, 90, 8)
    e = cl.clean(frame(spark, edges))
    dense, m = cl.prepare_input(frame(spark, edges))
    assert {r.src for r in dense.collect()} == set(range(m.count()))
    assert sorted(cl.restore(dense, m).collect()) == sorted(e.collect())
    d = cl.degree_desc_mapping(e).orderBy("idx").collect()
    assert [r.deg for r in d] == sorted((r.deg for r in d), reverse=True)


def test_offsets_and_lists(spark):
    e = cl.clean(frame(spark, random_edges(30, 80, 9)))
    at = 0
    for r in dg.csr_offsets(e).orderBy("v").collect():
        assert r.off == at
        at += r.deg
    near = {}
    for r in e.collect():
        near.setdefault(r.src, []).append(r.dst)
    assert {r.v: r.nbrs for r in dg.adjacency(e).collect()} == {v: sorted(n) for v, n in near.items()}


def test_expand_hits_two_hop_diff(spark):
    e = cl.clean(frame(spark, [(1, 2), (2, 3), (3, 1), (3, 4)]))
    vs = spark.createDataFrame([(1,), (4,)], "v long")
    assert {(r.v, r.n) for r in ex.expand(vs, e).collect()} == {(1, 2), (1, 3), (4, 3)}
    assert {r.v: r.hits for r in ex.hit_count(vs, e).collect()} == {2: 1, 3: 2}
    assert {(r.src, r.dst) for r in ex.induced(e, spark.createDataFrame([(1,), (3,)], "v long")).collect()} == {(1, 3), (3, 1)}
    walks = [(r.s, r.d) for r in ex.two_hop(e).collect()]
    assert walks.count((1, 1)) == 2 and {r.s: r.n for r in ex.two_hop_counts(e).collect()} == {v: sum(s == v for s, _ in walks) for v in (1, 2, 3, 4)}
    assert ex.result_diff(vs, vs).count() == 0
    assert {(r.v, r.side) for r in ex.result_diff(vs, spark.createDataFrame([(1,), (5,)], "v long")).collect()} == {(4, "left"), (5, "right")}
    assert ex.common_neighbours(e, spark.createDataFrame([(1, 2)], "a long, b long")).first().both == [3]


@pytest.mark.parametrize("seed", [3, 4])
def test_cliques_against_brute_force(spark, seed):
    edges = random_edges(11, 34, seed)
    e = cl.clean(frame(spark, edges))
    near = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
    want = set()
    for k in range(2, 12):
        for c in itertools.combinations(sorted(near), k):
            if all(b in near[a] for a, b in itertools.combinations(c, 2)) and not any(all(u in near[v] for v in c) for u in near if u not in c):
                want.add(c)
    order = cores.degeneracy_order(cores.local_peel(e))
    place = {r.v: r.ord for r in order.collect()}
    rows = cliques.maximal_cliques(e, order).collect()
    got = [tuple(r.members) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want
    assert all(r.root == min(r.members, key=place.get) and r.size == len(r.members) for r in rows)
    assert cliques.clique_count(e, order).first().n == len(want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(-3, 12), st.integers(-3, 12)), max_size=60))
def test_peel_on_arrays(edges):
    pairs = sorted({(a, b) for x, y in edges if x != y for a, b in ((x, y), (y, x))})
    src, dst = np.array([a for a, _ in pairs], np.int64), np.array([b for _, b in pairs], np.int64)
    v, core, rnd = cores.peel_arrays(src, dst)
    want = peel_by_hand(edges)
    assert dict(zip(v.tolist(), core.tolist())) == want
    order = sorted(zip(core.tolist(), rnd.tolist(), v.tolist()))
    place = {x: i for i, (_, _, x) in enumerate(order)}
    assert all(sum(place[b] > place[a] for a, b in pairs if a == u) <= want[u] for u in want)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=30))
def test_bron_kerbosch(edges):
    near = {u: {b for a, b in edges if a == u != b} | {a for a, b in edges if b == u != a} for u in range(9)}
    got = [tuple(sorted(c)) for c in cliques.bron_kerbosch([sum(1 << v for v in near[u]) for u in range(9)])]
    want = set()
    for k in range(1, 10):
        for c in itertools.combinations(range(9), k):
            if all(b in near[a] for a, b in itertools.combinations(c, 2)) and not any(all(u in near[v] for v in c) for u in near if u not in c):
                want.add(c)
    assert sorted(got) == sorted(want)


def test_cliques_of_a_hub(spark):
    """A vertex joined to all, with more earlier neighbours than different sets of them: one row a set, cliques in several batches."""
    core = [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]
    e = cl.clean(frame(spark, core + [(0, v) for v in range(1, 45)] + [(1, v) for v in range(5, 25)]))
    order = cores.degeneracy_order(cores.local_peel(e))
    got = {tuple(r.members) for r in cliques.maximal_cliques(e, order, out_members=5).collect()}
    assert got == {(0, 1, 2, 3, 4), *((0, 1, v) for v in range(5, 25)), *((0, v) for v in range(25, 45))}
    assert cliques._subproblems(e, order).where("a is null").groupBy("root").count().agg(F.max("count")).first()[0] < 8
    none = e.where("src < 0")
    assert cliques.clique_count(none, order).first().n == 0 and cliques.maximal_cliques(none, order).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=30), st.integers(1, 8))
def test_bron_kerbosch_with_vertices_elsewhere(edges, inside):
    """Of the maximal cliques of a whole graph, those that lie inside a part of it."""
    near = {u: {b for a, b in edges if a == u != b} | {a for a, b in edges if b == u != a} for u in range(9)}
    mask = [sum(1 << v for v in near[u] if v < inside) for u in range(9)]
    got = {tuple(sorted(c)) for c in cliques.bron_kerbosch(mask[:inside], mask[inside:])}
    whole = {tuple(sorted(c)) for c in cliques.bron_kerbosch([sum(1 << v for v in near[u]) for u in range(9)])}
    assert got == {c for c in whole if all(v < inside for v in c)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=40), st.integers(1, 6), st.integers(1, 10))
def test_searches_stop_and_go_on(edges, steps, inside):
    """A search stopped every few steps and taken up from its rows gives the cliques of one that isn't."""
    near = {u: {b for a, b in edges if a == u != b} | {a for a, b in edges if b == u != a} for u in range(10)}
    mask = [sum(1 << v for v in near[u] if v < inside) for u in range(10)]
    want = sorted(tuple(sorted(c)) for c in cliques.bron_kerbosch(mask[:inside], mask[inside:]))
    todo, got = [cliques.Search(0, list(range(inside)), mask[:inside], [([], (1 << inside) - 1, 0, mask[inside:])])], []
    while todo:
        s = todo.pop()
        got += [tuple(sorted([*s.taken, *(s.ids[i] for i in c)])) for c in s.cliques(steps)]
        todo += [cliques.resumed(x) for x in s.open()]
    assert sorted(got) == want


def test_a_dense_core_is_many_tasks(spark):
    """A planted core (all pairs of 18 vertices but a matching: 512 cliques) under one root, searched in small steps."""
    core = [(a, b) for a in range(18) for b in range(a) if a - b != 9]
    e = cl.clean(frame(spark, core + [(100 + i, i % 18) for i in range(30)]))
    order = cores.degeneracy_order(cores.ordered(e))
    got = {r.size: r.n for r in cliques.clique_sizes(e, order, steps=20).collect()}
    assert got == {9: 512, 2: 30}
    rows = cliques.maximal_cliques(e, order, out_members=50, steps=20)
    assert rows.count() == 542 and rows.select("members").distinct().count() == 542
    assert len(rows.inputFiles()) > 8


def test_neighbour_sets(spark):
    e = cl.clean(frame(spark, [(1, 2), (1, 3), (2, 3), (1, 4)]))
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "a long, b long")
    assert {(r.a, r.b): r.only for r in ex.neighbour_difference(e, pairs).collect()} == {(1, 2): [4], (2, 1): []}


def test_hubs_are_dealt_in_lots(spark):
    """A star with a clique: the hub's edges go to several lots, and nothing is lost or doubled."""
    from stratagraph.plans.loop import Dealt

    star = [(0, i) for i in range(1, 60)] + [(a, b) for a in range(1, 5) for b in range(a + 1, 5)]
    e = cl.clean(spark.createDataFrame(star, "src long, dst long"))
    for key in ("src", "dst"):
        d = Dealt(e, key, e.count(), most=7)
        assert d.edges.where(f"{key} = 0").select("lot").distinct().count() > 4
        v = e.select(key).distinct().withColumn("w", F.col(key) * 2)
        got = d.join(v)
        assert sorted((r.src, r.dst) for r in got.collect()) == sorted((r.src, r.dst) for r in e.collect()) and got.where(f"w <> {key} * 2").count() == 0
        d.clear()
    want = {v: 4 if v < 5 else 1 for v in range(60)}
    for strategy in ("hindex", "peel", "compacting", "local"):
        assert {r.v: r.core for r in cores.core_numbers(e, strategy).collect()} == want, strategy


def test_large_estimates_are_not_broadcast(spark, monkeypatch):
    import random

    monkeypatch.setattr(cores, "BROADCAST_ROWS", 3)
    r = random.Random(5)
    e = cl.clean(spark.createDataFrame([(r.randrange(40), r.randrange(40)) for _ in range(150)], "src long, dst long"))
    assert {x.v: x.core for x in cores.core_numbers(e, "hindex").collect()} == {x.v: x.core for x in cores.core_numbers(e, "local").collect()}


def test_pairs_with_hubs(spark):
    star = [(0, i) for i in range(1, 30)] + [(1, 2), (2, 3)]
    e = cl.clean(spark.createDataFrame(star, "src long, dst long"))
    pairs = spark.createDataFrame([(0, 1), (0, 5), (1, 3), (2, 0), (7, 99)], "a long, b long")
    both = {(r.a, r.b): r.both for r in ex.common_neighbours(e, pairs).collect()}
    assert both == {(0, 1): [2], (0, 5): [], (1, 3): [0, 2], (2, 0): [1, 3]}
    n = {(r.a, r.b): (r.common, r.only) for r in ex.difference_counts(e, pairs).collect()}
    only = {(r.a, r.b): r.only for r in ex.neighbour_difference(e, pairs).collect()}
    assert n == {k: (len(both[k]), len(only[k])) for k in both}
    assert only[(0, 1)] == list(range(3, 30)) and only[(1, 3)] == [] and only[(2, 0)] == []


@pytest.mark.parametrize("heavy", [None, 6, 2])
def test_two_hop_ends(spark, heavy):
    """Light and heavy middles, starts that are hubs themselves, and a star."""
    edges = random_edges(40, 90, 12) + [(100, i) for i in range(25)] + [(101, i) for i in range(15, 40)] + [(200, 201), (202, 200)]
    e = cl.clean(frame(spark, edges))
    near = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
    want = {v: len(set().union(*(near[m] for m in near[v]))) for v in near}
    assert {r.s: r.ends for r in ex.two_hop_ends(e, heavy).collect()} == want


def test_a_star_is_not_squared(spark):
    """Leaves of a hub reach each other through one set of heavy middles: no operator makes more than a few times the edges."""
    n = 3000
    e = cl.clean(spark.range(1, n + 1).selectExpr("0L as src", "id as dst"))
    got = ex.two_hop_ends(e)
    assert {r.ends for r in got.where("s > 0").collect()} == {n} and got.where("s = 0").first().ends == 1
    plan = got._jdf.queryExecution().executedPlan()

    def rows(p):
        kids = p.children()
        if p.nodeName().startswith("AdaptiveSparkPlan"):
            yield from rows(p.executedPlan())
        if "QueryStage" in p.nodeName():
            yield from rows(p.plan())
        m = p.metrics().get("numOutputRows")
        if m.isDefined():
            yield m.get().value()
        for i in range(kids.size()):
            yield from rows(kids.apply(i))

    got._jdf.collectToPython()
    assert n <= max(rows(plan)) <= 6 * n
    pairs = spark.range(1, n + 1).selectExpr("0L as a", "id as b")
    counts = ex.difference_counts(e, pairs)
    assert {(r.common, r.only) for r in counts.collect()} == {(0, n - 1)}


def _plan_rows(p):
    """Rows that each operator of an executed plan gave."""
    kids = p.children()
    if p.nodeName().startswith("AdaptiveSparkPlan"):
        yield from _plan_rows(p.executedPlan())
    if "QueryStage" in p.nodeName():
        yield from _plan_rows(p.plan())
    m = p.metrics().get("numOutputRows")
    if m.isDefined():
        yield m.get().value()
    for i in range(kids.size()):
        yield from _plan_rows(kids.apply(i))


def test_common_neighbours_make_no_rows_for_wedges(spark):
    """All pairs of a complete graph: rows of the plan stay about the edges, not edges times degree."""
    n = 60
    e = cl.clean(spark.range(n).selectExpr("id as src").crossJoin(spark.range(n).selectExpr("id as dst")))
    pairs = e.where("src < dst").toDF("a", "b")
    got = ex.difference_counts(e, pairs)
    plan = got._jdf.queryExecution().executedPlan()
    got._jdf.collectToPython()
    assert max(_plan_rows(plan)) <= 3 * n * n
    assert {(r.common, r.only) for r in got.collect()} == {(n - 2, 0)} and got.count() == n * (n - 1) // 2


@pytest.mark.parametrize("block", [7, None])
def test_shared_lists(spark, block):
    """Lists in blocks of any size, hubs of several tasks, one far longer than its visitors' lists, and visits without a list."""
    from stratagraph.operators.intersect import shared

    edges = random_edges(40, 160, 3) + [(99, i) for i in range(300, 1500)] + [(99, 3), (98, 99), (98, 300), (98, 3)]
    lists = {}
    for a, b in edges:
        lists.setdefault(a, set()).add(b)
    rows = spark.createDataFrame([(v, x, -v) for v in lists for x in lists[v]], "v long, x long, own long")
    visits = [(v, u, v * 7 + u) for v in lists for u in [*list(lists)[:12], 98, 99, 5000]]
    df = spark.createDataFrame(visits, "v long, u long, tag long")
    got = sorted((r.v, r.own, r.u, r.tag, sorted(r.both)) for r in shared(rows, df, True, block).collect())
    assert got == sorted((v, -v, u, t, sorted(lists[v] & lists.get(u, set()))) for v, u, t in visits)
    got = sorted((r.v, r.u, r.tag, r.n, r.linked) for r in shared(rows, df, False, block).collect())
    assert got == sorted((v, u, t, len(lists[v] & lists.get(u, set())), v in lists.get(u, set())) for v, u, t in visits)


def test_cliques_over_blocks_of_lists(spark, monkeypatch):
    """Later neighbours meet in blocks of a few entries: the same cliques as in one block."""
    from stratagraph.operators import intersect

    e = cl.clean(frame(spark, random_edges(40, 160, 3)))
    order = cores.early_order(e)
    want = {tuple(r.members) for r in cliques.maximal_cliques(e, order).collect()}
    seen, shared = [], cliques.shared
    monkeypatch.setattr(intersect, "MOST", 9)
    monkeypatch.setattr(cliques, "shared", lambda *a, **k: (seen.append(a), shared(*a, **k))[1])
    assert {tuple(r.members) for r in cliques.maximal_cliques(e, order).collect()} == want and seen


def test_rounds_of_large_graphs(spark, monkeypatch):
    """Shells and peels with edges stored anew as vertices go: the first rounds by shuffles, the last by broadcast."""
    r = random.Random(8)
    chain = [(100 + i, 101 + i) for i in range(40)]
    e = cl.clean(frame(spark, [(r.randrange(30), r.randrange(30)) for _ in range(120)] + chain))
    want = {x.v: (x.core, x.round) for x in cores.local_peel(e, 10_000).collect()}
    monkeypatch.setattr(cores, "BROADCAST_ROWS", 12)
    stored, dealt = [], cores.Dealt
    monkeypatch.setattr(cores, "Dealt", lambda *a, **k: (stored.append(a), dealt(*a, **k))[1])
    known = e.sparkSession.createDataFrame([(v, c) for v, (c, _) in want.items()], "v long, core int")
    assert {x.v: (x.core, x.round) for x in cores.shells(e, known).collect()} == want and len(stored) >= 3
    stored.clear()
    assert {x.v: (x.core, x.round) for x in cores.peel(e).collect()} == want and len(stored) >= 3


def test_rounds_of_large_estimates_move_rows_once(spark, monkeypatch):
    """Without hubs, what changed vertices tell and what their neighbours read are dealt by vertex, like the state: few exchanges, no broadcast."""
    monkeypatch.setattr(cores, "BROADCAST_ROWS", 3)
    r = random.Random(5)
    e = cl.clean(frame(spark, [(r.randrange(40), r.randrange(40)) for _ in range(150)])).repartition(3)
    plans, keep = [], cores.Rounds.keep
    monkeypatch.setattr(cores.Rounds, "keep", lambda self, df, buckets=0, **x: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(self, df, buckets, **x))[1])
    got = {x.v: x.core for x in cores.core_numbers(e, "hindex").collect()}
    assert got == {x.v: x.core for x in cores.core_numbers(e, "peel").collect()}
    rounds = [p for p in plans if "base" in p]
    assert rounds and all(p.count("Exchange hashpartitioning") <= 6 and "Broadcast" not in p for p in rounds), [p.count("Exchange hashpartitioning") for p in rounds]


def test_large_lookups_send_nothing_to_the_driver(spark):
    """Beyond the counted bound, even a small side is met by a shuffle: rounds have many such joins."""
    from stratagraph.plans.loop import lookup

    df = lookup(spark.range(50).selectExpr("id % 7 as k", "id"), "k", spark.range(7).selectExpr("id as k", "id * 2 as x"), False)
    assert df.count() == 50 and "Broadcast" not in df._jdf.queryExecution().toString()


def test_two_hop_lists_go_to_blocks(spark):
    """Ends counted in blocks of any size are right, and what is moved is lists times blocks, not lists times edges."""
    from stratagraph.operators import expand
    from stratagraph.plans.loop import kept

    r = random.Random(5)
    pairs = {(2 * r.randrange(60), 2 * r.randrange(60) + 1) for _ in range(900)} | {(1000, 1001), (-4, 7)}
    e = kept(spark.createDataFrame([x for a, b in pairs for x in ((a, b), (b, a))], "src long, dst long"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {v: len({d for m in ms for d in near[m]}) for v, ms in near.items()}
    for walks in (4000, 1 << 40):
        assert {x.s: x.ends for x in expand._ends_in_blocks(e, expand.two_hop_counts(e), walks).collect()} == want
    got = expand.two_hop_figures(e)
    assert {x.s: (x.n, x.ends) for x in got.collect()} == {v: (sum(len(near[m]) for m in ms), want[v]) for v, ms in near.items()}
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    one_way = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (1, 9)], "src long, dst long")
    assert [tuple(x) for x in expand.two_hop_ends(one_way).collect()] == [(1, 1)]


def _shared_mb(spark, pattern):
    import glob
    from urllib.parse import urlparse

    at = urlparse(spark.sparkContext.getCheckpointDir()).path
    return {f: os.path.getsize(f) for f in glob.glob(f"{at}/{pattern}/*")}


def test_local_split_writes_no_edges_as_rows(spark):
    """Edges are stored encoded: what core_local leaves in checkpointed frames is a few rows a vertex, not the edges over and over."""
    r = random.Random(2)
    one = {(2 * r.randrange(300), 2 * r.randrange(300) + 1) for _ in range(14_000)}
    pairs = sorted(one) + [(5000, 5001), (5001, 5002), (5000, 5002), (6000, 6001)]
    e = spark.createDataFrame([x for a, b in pairs for x in ((a, b), (b, a))], "src long, dst long")
    before = set(_shared_mb(spark, "rdd-*"))
    got = {x.v: x.core for x in cores.local_cores(e).collect()}
    assert got == {x.v: x.core for x in cores.core_numbers(e).collect()} and got[5001] == 2 and got[6001] == 1
    written = sum(n for f, n in _shared_mb(spark, "rdd-*").items() if f not in before)
    assert written < 8 * 2 * len(pairs)


@pytest.mark.parametrize("block", [7, None])
def test_differences_are_formed(spark, block, monkeypatch):
    """The counts are those of differences formed member by member, in blocks of any size and with hubs; a co-purchase edge moves with a list, not as a row."""
    from stratagraph.operators import intersect

    edges = random_edges(40, 160, 3) + [(99, i) for i in range(300, 400)] + [(99, 3), (98, 99), (98, 300), (98, 3), (0, 500), (0, 501)]
    e = cl.clean(frame(spark, edges))
    near = {}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
    want = {(a, b): (len(near[a] & near[b]), len(near[a] - near[b] - {b})) for a in near for b in near[a]}
    if block:
        monkeypatch.setattr(intersect, "LEAST", block)
        monkeypatch.setattr(intersect, "MOST", block)
        monkeypatch.setattr(intersect, "CELLS", 11)
    lists = intersect.packed_lists(e.toDF("v", "x"))
    rows = ex.edge_differences(lists).collect()
    assert len(rows) == len(want) // 2 and {(r.a, r.b): (r.common, r.only) for r in rows} == {k: n for k, n in want.items() if k[0] < k[1]}
    assert {(r.a, r.b, r.common) for r in ex.edge_common(lists).collect()} == {(r.a, r.b, r.common) for r in rows}
    got = ex.difference_counts(e, e.toDF("a", "b")).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.common, r.only) for r in got} == want
    inside = intersect.Block([(1, 0, np.array([2, 3, 9])), (2, 0, np.array([1, 3]))])
    n, only = inside.differ(np.array([1, 2]), np.array([1, 3, 5]), 4, np.array([True, False]))
    assert n.tolist() == [1, 2] and only.tolist() == [1, 0]


def test_packed_lists(spark):
    from stratagraph.operators.intersect import pack, packed_lists, unpack

    for x in ([], [5], [-3, 0, 70_000], [1, 2, 3], [4, 2], [-(1 << 63), (1 << 63) - 1], [0, 1 << 33]):
        assert unpack(pack(np.array(x, np.int64))).tolist() == x
    rows = spark.createDataFrame([(1, [1, 2, 3]), (1, [3, 9]), (2, [2])], "v long, x array<long>")
    assert {r.v: (r.k, unpack(r.l).tolist()) for r in packed_lists(rows, loops=False).collect()} == {1: (3, [2, 3, 9])}


def test_cliques_lists_lie_by_id(spark, monkeypatch):
    """Later neighbours meet in blocks by id, not by place in the order: a list of near ids goes to few blocks, however the order mixes them."""
    from stratagraph.operators import intersect

    copies = [(a + 1000 * c, b + 1000 * c) for c in range(8) for a, b in random_edges(12, 30, 4)]
    e = cl.clean(frame(spark, copies))
    order = cores.early_order(e)
    monkeypatch.setattr(intersect, "LEAST", 30)
    monkeypatch.setattr(intersect, "MOST", 30)
    moved, met = [], intersect._met
    monkeypatch.setattr(intersect, "_met", lambda rows, *a: (moved.append(rows.where("kind = 1").count()), met(rows, *a))[1])
    rows = cliques._subproblems(e, order).where("a is not null").collect()
    assert len(rows) == e.count() // 2 and moved[0] <= 2 * e.select("src").distinct().count()
    near, place = {}, {r.v: r.ord for r in order.collect()}
    for r in e.collect():
        near.setdefault(r.src, set()).add(r.dst)
    later = {v: {u for u in near[v] if place[u] > place[v]} for v in near}
    assert {(r.root, r.a): set(r.near) for r in rows} == {(v, u): later[v] & later[u] for v in near for u in later[v]}


def test_two_hop_blocks_are_read_off_lists(spark):
    """In a symmetric graph no edge moves to find the blocks that a middle's list goes to; the same ends as the general way, which directed edges need."""
    from stratagraph.operators import expand

    e = cl.clean(frame(spark, random_edges(40, 160, 3)))
    want = {x.s: x.ends for x in expand._ends_in_blocks(e, expand.two_hop_counts(e), 300).collect()}
    got = expand._ends_in_blocks(e, expand.two_hop_counts(e), 300, symmetric=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert {x.s: x.ends for x in got.collect()} == want
    one_way = frame(spark, [(1, 2), (2, 3), (2, 4), (5, 6), (1, 9), (7, 2), (9, 3)])
    assert {x.s: x.ends for x in expand._ends_in_blocks(one_way, expand.two_hop_counts(one_way), 2).collect()} == {1: 2, 7: 2}
