"""Registered graph queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.pairing import associative_pairing, cantor_pairing
from .operators import clean as cl
from .operators import cliques, cores
from .operators import degree as dg
from .operators import expand as ex
from .operators.intersect import packed_lists
from .plans.loop import kept, prepare
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name; ``sql`` follows the common table expressions of GRAPH."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().lower().startswith("with") else GRAPH + sql
        return f

    return keep


# raw: customer-part edges with repeats; e: distinct; a: the clean symmetric graph; d: degrees
GRAPH = """with recursive raw as (select o_custkey * 2 src, l_partkey * 2 + 1 dst from lineitem join orders on l_orderkey = o_orderkey),
e as (select distinct src, dst from raw), a as (select src, dst from e union select dst, src from e),
d as (select src v, count(*) deg from a group by src)
"""
# the h-index fixpoint; 60 rounds are far more than the tables need
CORES = (
    GRAPH.rstrip()
    + """, it as (select v, deg est, 0 i from d union all
  select v, max(case when r <= ne then r else 0 end), i + 1 from (select a.src v, n.est ne, n.i i, row_number() over (partition by a.src order by n.est desc) r from a join it n on a.dst = n.v where n.i < 60) group by v, i),
c as (select v, cast(est as integer) core from it where i = (select max(i) from it))
"""
)
# the peel by levels with its rounds: state of all vertices, one removal an iteration
PEEL = (
    GRAPH.rstrip()
    + """, st as (select v, deg, -1 core, 0 rnd, -1 k, 0 sub, 0 i from d union all
  select s.v, s.deg - coalesce(h.c, 0), case when s.core < 0 and s.deg <= s.kk then s.kk else s.core end, case when s.core < 0 and s.deg <= s.kk then s.ss else s.rnd end, s.kk, s.ss, s.i + 1
  from (select *, greatest(k, m) kk, case when m > k then 1 else sub + 1 end ss from (select *, min(case when core < 0 then deg end) over () m from st) where m is not null) s
  left join (select a.dst v, count(*) c from (select v, deg, core, greatest(k, min(case when core < 0 then deg end) over ()) kk from st) f join a on a.src = f.v where f.core < 0 and f.deg <= f.kk group by a.dst) h on h.v = s.v),
p as (select v, cast(core as integer) core, rnd as round from st where i = (select max(i) from st)),
o as (select v, core, round, row_number() over (order by core, round, v) - 1 ord from p)
"""
)


def _raw(spark, sf_dir):
    prepare(spark)
    return tables.customer_part(spark, sf_dir, distinct=False)


def _graph(spark, sf_dir):
    """The clean customer-part graph."""
    prepare(spark)
    return cl.clean(tables.customer_part(spark, sf_dir, distinct=False))


def _cores(spark, sf_dir):
    return cores.core_numbers(_graph(spark, sf_dir))


def _order(e):
    return cores.degeneracy_order(cores.ordered(e))


@query("select src, dst from raw where src <> dst")
def clean_no_loops(spark, sf_dir):
    return cl.remove_self_loops(_raw(spark, sf_dir))


@query("select src, dst from a")
def symmetrize(spark, sf_dir):
    return cl.symmetrize(_raw(spark, sf_dir))


@query("select distinct least(src, dst) src, greatest(src, dst) dst from raw where src <> dst")
def single_directed(spark, sf_dir):
    return cl.single_directed(_raw(spark, sf_dir))


@query("select v, row_number() over (order by v) - 1 idx from d")
def dense_relabel(spark, sf_dir):
    return cl.dense_mapping(_graph(spark, sf_dir))


@query("select v, deg, row_number() over (order by deg desc, v) - 1 idx from d")
def degree_desc_relabel(spark, sf_dir):
    return cl.degree_desc_mapping(_graph(spark, sf_dir))


@query("select x.i src, y.i dst from a join (select v, row_number() over (order by v) - 1 i from d) x on x.v = a.src join (select v, row_number() over (order by v) - 1 i from d) y on y.v = a.dst")
def prepare_input(spark, sf_dir):
    return cl.prepare_input(_raw(spark, sf_dir))[0]


@query("select src, dst from a")
def edge_roundtrip(spark, sf_dir):
    return cl.restore(*cl.prepare_input(_raw(spark, sf_dir)))


@query("select v, deg from d")
def degree(spark, sf_dir):
    return dg.degrees(_graph(spark, sf_dir))


@query("select v, count(*) deg from (select src v from raw union all select dst from raw) group by v")
def multigraph_degree(spark, sf_dir):
    return dg.degrees(cl.clean(_raw(spark, sf_dir), dedupe=False))


def _frontier(e):
    d = dg.degrees(e)
    return dg.frontier(d, d.agg(F.min("deg")).first()[0])


@query("select v, deg from d where deg = (select min(deg) from d)")
def frontier_select(spark, sf_dir):
    return _frontier(_graph(spark, sf_dir))


@query("select f.v, a.dst n from d f join a on a.src = f.v where f.deg = (select min(deg) from d)")
def expand_frontier(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return ex.expand(_frontier(e), e)


@query("select a.dst v, count(*) hits from d f join a on a.src = f.v where f.deg = (select min(deg) from d) group by a.dst")
def hit_count(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return ex.hit_count(_frontier(e), e)


@query("select round(avg(deg), 6) mean_deg, round(stddev_pop(deg), 6) std_deg, max(deg) max_deg from d")
def degree_stats(spark, sf_dir):
    return dg.degree_stats(_graph(spark, sf_dir))


@query("select deg, count(*) n from d group by deg")
def degree_histogram(spark, sf_dir):
    return dg.degree_histogram(_graph(spark, sf_dir))


@query("select count(*) v, sum(deg)::bigint e from d")
def graph_size(spark, sf_dir):
    return dg.graph_size(_graph(spark, sf_dir))


@query("select v from d")
def vertex_set(spark, sf_dir):
    return cl.vertices(_graph(spark, sf_dir))


@query("select v, deg, coalesce(sum(deg) over (order by v rows between unbounded preceding and 1 preceding), 0)::bigint off from d")
def csr_offsets(spark, sf_dir):
    return dg.csr_offsets(_graph(spark, sf_dir))


@query("select src, dst, deg dst_deg from a join d on d.v = a.dst")
def edges_sorted_by_nbr_degree(spark, sf_dir):
    return dg.edges_by_neighbour_degree(_graph(spark, sf_dir))


@query("select src v, count(*) deg, string_agg(cast(dst as varchar), ',' order by dst) nbrs from a group by src")
def adjacency_lists(spark, sf_dir):
    return dg.adjacency(_graph(spark, sf_dir)).withColumn("nbrs", F.array_join(F.col("nbrs").cast("array<string>"), ","))


@query("select v, max(case when r <= ne then r else 0 end)::bigint h from (select a.src v, d.deg ne, row_number() over (partition by a.src order by d.deg desc) r from a join d on d.v = a.dst) group by v")
def hindex_one_round(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return dg.hindex_round(e, dg.degrees(e).withColumnRenamed("deg", "est"))


@query("select x.src s, count(*) n, count(distinct y.dst) ends from a x join a y on x.dst = y.src group by x.src")
def two_hop(spark, sf_dir):
    return ex.two_hop_figures(_graph(spark, sf_dir))


@query("select a.src, a.dst from a join d x on x.v = a.src join d y on y.v = a.dst where x.deg >= (select avg(deg) from d) and y.deg >= (select avg(deg) from d)")
def induced_subgraph(spark, sf_dir):
    e = _graph(spark, sf_dir)
    d = dg.degrees(e)
    return ex.induced(e, d.where(F.col("deg") >= d.agg(F.avg("deg")).first()[0]))


@query("select v, x.deg, 'left' side from d x where not exists (select 1 from (select src v, count(*) deg from (select src from raw union all select dst from raw) group by src) y where y.v = x.v and y.deg = x.deg) union all select v, y.deg, 'right' from (select src v, count(*) deg from (select src from raw union all select dst from raw) group by src) y where not exists (select 1 from d x where y.v = x.v and y.deg = x.deg)")
def result_diff(spark, sf_dir):
    """Vertices whose degree differs between the simple graph and the multigraph."""
    return ex.result_diff(degree(spark, sf_dir), multigraph_degree(spark, sf_dir))


@query("with s as (select distinct l_suppkey * 2 src, l_partkey * 2 + 1 dst from lineitem) select src, dst, (src + dst) * (src + dst + 1) // 2 + dst code from s")
def pairing_cantor(spark, sf_dir):
    return tables.supplier_part(spark, sf_dir).withColumn("code", cantor_pairing(F.col("src"), F.col("dst")))


@query("with s as (select distinct l_suppkey * 2 src, l_partkey * 2 + 1 dst from lineitem) select src, dst, greatest(src, dst) * (greatest(src, dst) + 1) // 2 + least(src, dst) code from s")
def pairing_assoc(spark, sf_dir):
    return tables.supplier_part(spark, sf_dir).withColumn("code", associative_pairing(F.col("src"), F.col("dst")))


@query(CORES + "select v, core from c")
def core_hindex(spark, sf_dir):
    return cores.core_numbers(_graph(spark, sf_dir), "hindex")


@query(PEEL + "select v, core, round::integer as round from p")
def core_peel(spark, sf_dir):
    return cores.peel(_graph(spark, sf_dir))


@query(CORES + "select v, core from c")
def core_local(spark, sf_dir):
    return cores.core_numbers(_graph(spark, sf_dir), "local")


@query(CORES + "select v, core from c")
def core_compacting(spark, sf_dir):
    return cores.core_numbers(_graph(spark, sf_dir), "compacting")


@query(CORES + "select core, count(*) n, sum(count(*)) over (order by core)::bigint removed from c group by core")
def core_histogram(spark, sf_dir):
    return cores.core_histogram(_cores(spark, sf_dir))


@query(CORES + "select max(core) kmax from c")
def core_kmax(spark, sf_dir):
    return _cores(spark, sf_dir).agg(F.max("core").alias("kmax"))


@query(CORES + "select max(core) max_core, round(avg(core), 6) avg_core, count(*) n from c")
def core_summary(spark, sf_dir):
    return cores.core_summary(_cores(spark, sf_dir))


@query(CORES + "select count(*) filter (deg = 1) degree1, count(*) filter (core = 1) core1, count(*) n from c join d using (v)")
def degree1_core1(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return dg.degrees(e).join(cores.core_numbers(e), "v").agg(F.count_if(F.col("deg") == 1).alias("degree1"), F.count_if(F.col("core") == 1).alias("core1"), F.count(F.lit(1)).alias("n"))


@query(CORES + "select src, dst from a where src in (select v from c where core = (select max(core) from c)) and dst in (select v from c where core = (select max(core) from c))")
def k_core_subgraph(spark, sf_dir):
    """The innermost core."""
    e = _graph(spark, sf_dir)
    c = cores.core_numbers(e)
    return cores.k_core(e, c, c.agg(F.max("core")).first()[0])


@query(CORES + "select v, core from c where core = (select max(core) - 1 from c)")
def k_shell(spark, sf_dir):
    """The shell next to the innermost."""
    c = _cores(spark, sf_dir)
    return cores.k_shell(c, c.agg(F.max("core")).first()[0] - 1)


@query(PEEL + "select v, core, round::integer as round, ord from o")
def degeneracy_order(spark, sf_dir):
    return _order(_graph(spark, sf_dir))


@query(PEEL + "select x.ord src, y.ord dst from a join o x on x.v = a.src join o y on y.v = a.dst")
def degeneracy_relabel(spark, sf_dir):
    e = _graph(spark, sf_dir)
    return cores.degeneracy_relabel(e, _order(e))


@query(PEEL + "select x.v, count(*) filter (y.ord > x.ord) later, count(*) filter (y.ord < x.ord) earlier, coalesce(string_agg(cast(y.v as varchar), ',' order by y.v) filter (y.ord > x.ord), '') p from o x join a on a.src = x.v join o y on y.v = a.dst group by x.v")
def clique_roots(spark, sf_dir):
    e = kept(_graph(spark, sf_dir))
    r = cliques.clique_roots(e, _order(e))
    return r.select("v", F.size("p").cast("long").alias("later"), F.size("x").cast("long").alias("earlier"), F.array_join(F.col("p").cast("array<string>"), ",").alias("p"))


PURCHASE = """with recursive l as (select distinct l_orderkey, l_partkey from lineitem),
e as (select distinct x.l_partkey src, y.l_partkey dst from l x join l y on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey),
n as (select v, list(u) ns from (select src v, dst u from e union all select dst, src from e) group by v),
k as (select [src, dst] c, list_intersect(x.ns, y.ns) b from e join n x on x.v = src join n y on y.v = dst
  union all select list_append(c, q), list_intersect(b, n.ns) from (select c, b, unnest(b) q from k) join n on n.v = q where q > c[len(c)])
"""


def _purchases(spark, sf_dir):
    prepare(spark)
    # each edge is there once, smaller id first
    return kept(cl.symmetrize(tables.co_purchase(spark, sf_dir), dedupe=False))


@query(PURCHASE + "select count(*) n from k where len(b) = 0")
def maximal_clique_count(spark, sf_dir):
    e = _purchases(spark, sf_dir)
    return cliques.clique_count(e, cores.early_order(e))


@query(PURCHASE + "select len(c)::integer size, count(*) n from k where len(b) = 0 group by len(c)")
def clique_size_histogram(spark, sf_dir):
    e = _purchases(spark, sf_dir)
    return cliques.clique_sizes(e, cores.early_order(e))


BOTH = """with l as (select distinct l_orderkey, l_partkey from lineitem),
e as (select distinct x.l_partkey a, y.l_partkey b from l x join l y on x.l_orderkey = y.l_orderkey and x.l_partkey < y.l_partkey),
s as (select a, b from e union all select b, a from e)
"""


@query(BOTH + "select e.a, e.b, count(y.b) n from e left join s x on x.a = e.a left join s y on y.a = e.b and y.b = x.b group by e.a, e.b")
def common_neighbours(spark, sf_dir):
    """For each co-purchase edge, how many triangles it is in."""
    return ex.edge_common(packed_lists(tables.co_purchase_sets(spark, sf_dir), loops=False)).select("a", "b", F.col("common").alias("n"))


@query(BOTH + "select e.a, e.b, count(*) filter (y.b is null and x.b <> e.b) n from e join s x on x.a = e.a left join s y on y.a = e.b and y.b = x.b group by e.a, e.b")
def neighbour_difference(spark, sf_dir):
    """For each co-purchase edge, the first end's neighbours that the second one doesn't have."""
    return ex.edge_differences(packed_lists(tables.co_purchase_sets(spark, sf_dir), loops=False)).select("a", "b", F.col("only").alias("n"))


@query("with e as (select distinct user_id, event_type from events) select count(distinct user_id) users, count(distinct event_type) types, count(*) n from e")
def user_event_graph(spark, sf_dir):
    e = tables.user_event(spark, sf_dir)
    return e.agg(F.countDistinct("src").alias("users"), F.countDistinct("dst").alias("types"), F.count(F.lit(1)).alias("n"))


@query("""with p as (select page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) href from pages) select page_id * 2 v, count(distinct href) deg from p group by page_id""")
def page_link_degrees(spark, sf_dir):
    return tables.page_links(spark, sf_dir).groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("deg"))


@query(CORES + """select v, '{"' || v || '": ' || core || '}' line from c where core > 0""")
def cores_json(spark, sf_dir):
    """One JSON object a vertex, zeros left out; ``write_cores_json`` joins them to a single object."""
    from .sources.writers import json_lines

    return json_lines(_cores(spark, sf_dir))


def _round_trip(spark, e, ext):
    """What comes back of a graph written in a format to the session's shared folder."""
    from .sources import readers, writers

    path = f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}/g.{ext}"
    writers.write_graph(e, path)
    return readers.read_graph(spark, path)


def _io(name: str, ext: str) -> None:
    def f(spark, sf_dir):
        return _round_trip(spark, _graph(spark, sf_dir), ext)

    f.__name__ = name
    query("select src, dst from a")(f)


for _name, _ext in (("io_text", "txt"), ("io_text_gz", "txt.gz"), ("io_text_zip", "zip"), ("io_header_text", "edges"), ("io_mtx", "mtx"), ("io_mtx_gz", "mtx.gz"), ("io_mtx_zip", "mtx.zip"), ("io_adjlist", "adjlist"), ("io_npz", "npz"), ("io_parquet", "parquet")):
    _io(_name, _ext)


@query(ORACLES["prepare_input"].removeprefix(GRAPH))
def io_csr(spark, sf_dir):
    """The densely numbered graph through the CSR text cache."""
    return _round_trip(spark, cl.prepare_input(_raw(spark, sf_dir))[0], "csr")


@query("select (select max(greatest(src, dst)) from a) + 1 n")
def io_header_vertices(spark, sf_dir):
    """The number of ids in the header of a text file."""
    from .sources import readers, writers

    e = _graph(spark, sf_dir)
    path = f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}/g.edges"
    writers.write_graph(e, path)
    return readers.read_vertices(spark, path).agg(F.count(F.lit(1)).alias("n"))


@query(CORES + "select v, core from c where core > 0")
def io_cores_json(spark, sf_dir):
    """Core numbers written as one JSON object and read line by line."""
    from .sources import writers

    c = _cores(spark, sf_dir)
    path = f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}/cores.json"
    writers.write_results(c, path)
    x = r'^,?"(-?\d+)": (\d+)$'
    return spark.read.text(path).where(F.col("value").rlike(x)).select(F.regexp_extract("value", x, 1).cast("long").alias("v"), F.regexp_extract("value", x, 2).cast("int").alias("core"))


@query(CORES + "select v, core from c")
def io_cores_mtx(spark, sf_dir):
    """Core numbers written as MatrixMarket entries and read back."""
    from .sources import readers, writers

    c = _cores(spark, sf_dir)
    path = f"{spark.sparkContext.getCheckpointDir()}/io-{uuid.uuid4().hex}/cores.mtx"
    writers.write_results(c, path)
    return readers.read_graph(spark, path).select(F.col("src").alias("v"), F.col("dst").cast("int").alias("core"))
