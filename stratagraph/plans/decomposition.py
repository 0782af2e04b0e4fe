"""One run over one graph file: read, clean, decompose, write results and a profile."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as cl
from ..operators import cores
from ..sources import readers, writers
from .loop import prepare, settle


class Decomposition:
    """Reads ``path``, prepares the graph and finds core numbers.

    prepare=False takes the file's edges as clean already (symmetric, distinct, no loops);
    relabel is None, 'dense', 'degree_desc' or 'degeneracy'; dedupe=False keeps repeated edges in the
    degrees. ``cache`` keeps the (prepared, if cache_prepared) edges beside the input in that format.
    """

    def __init__(self, spark: SparkSession, path: str, fmt: str | None = None, prepared: bool = False, strategy: str = "auto", relabel: str | None = None, dedupe: bool = True, cache: str | None = None, cache_prepared: bool = False, comment: str = "", verbose: int = 0):
        if prepared and cache_prepared:
            raise ValueError("a graph that isn't prepared can't be cached as prepared")
        prepare(spark)
        self.spark, self.path, self.strategy, self.comment, self.verbose = spark, path, strategy, comment, verbose
        self.times: dict[str, float] = {}
        t = time.time()
        raw = readers.read_graph(spark, path, fmt)
        self.edges: DataFrame = settle(raw if prepared else cl.clean(raw, dedupe))
        self.times["load_s"] = time.time() - t
        if cache:
            writers.write_graph(self.edges if cache_prepared else raw, writers.serialized_name(path, cache), cache)
        self.mapping: DataFrame | None = None
        if relabel == "dense":
            self.mapping = cl.dense_mapping(self.edges)
        elif relabel == "degree_desc":
            self.mapping = cl.degree_desc_mapping(self.edges)
        elif relabel == "degeneracy":
            order = cores.degeneracy_order(cores.ordered(self.edges))
            self.mapping = order.select("v", F.col("ord").alias("idx"))
        elif relabel:
            raise ValueError(f"unknown relabelling {relabel!r}")
        if self.mapping is not None:
            self.edges = settle(cl.relabel(self.edges, self.mapping))
        self.cores: DataFrame | None = None

    def run(self) -> DataFrame:
        """(v, core), with the ids of the input."""
        t = time.time()
        c = cores.core_numbers(self.edges, self.strategy)
        if self.mapping is not None:
            c = c.join(self.mapping.select(F.col("idx").alias("v"), F.col("v").alias("o")), "v").select(F.col("o").alias("v"), "core")
        self.cores = settle(c)
        self.times["decompose_s"] = time.time() - t
        if self.verbose:
            for r in cores.core_histogram(self.cores).orderBy("core").toLocalIterator():
                print(f"level {r.core}: {r.n} vertices, {r.removed} removed")
        return self.cores

    def profile(self) -> dict:
        """One flat record of the run."""
        if self.cores is None:
            self.run()
        s = cores.core_summary(self.cores).first()
        size = self.edges.count()
        return {"input": self.path, "strategy": self.strategy, "vertices": s.n, "edges": size, "max_core": s.max_core, "avg_core": s.avg_core, **{k: round(v, 3) for k, v in self.times.items()}, "comment": self.comment}

    def executors(self) -> dict[str, dict]:
        """By executor (the driver is one on a local master): tasks, seconds in them, MB read by shuffles, and peak MB of heap and off-heap memory as the executor itself reported them.

        Peaks come with the executors' heartbeats and are 0 before the first.
        """
        store = self.spark.sparkContext._jsc.sc().statusStore()
        summaries, out = store.executorList(False), {}
        for i in range(summaries.size()):
            x = summaries.apply(i)
            peaks = x.peakMemoryMetrics()
            mb = lambda *names: round(sum(peaks.get().getMetricValue(n) for n in names) / 2**20, 1) if peaks.isDefined() else 0.0  # noqa: B023,E731
            out[x.id()] = {
                "tasks": x.totalTasks(),
                "task_s": round(x.totalDuration() / 1000, 3),
                "shuffle_read_mb": round(x.totalShuffleRead() / 2**20, 1),
                "heap_mb": mb("JVMHeapMemory"),
                "off_heap_mb": mb("JVMOffHeapMemory"),
                "python_mb": mb("ProcessTreePythonRSSMemory"),
            }
        return out

    def measure(self, repeats: int = 5) -> dict:
        """Runs again and again: mean, least and most seconds, what each executor did meanwhile (``executors``), and the largest executor's peak in MB.

        Before an executor has reported a peak (in the first seconds of a session) that of the driver's JVM stands for it.
        """
        took, before = [], self.executors()
        for _ in range(repeats):
            self.run()
            took.append(self.times["decompose_s"])
        by = self.executors()
        for k, x in by.items():
            for c in ("tasks", "task_s", "shuffle_read_mb"):
                x[c] = round(x[c] - before.get(k, {}).get(c, 0), 3)
        peak = max((x["heap_mb"] + x["off_heap_mb"] + x["python_mb"] for x in by.values()), default=0)
        if not peak:
            pools = self.spark._jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
            peak = sum(p.getPeakUsage().getUsed() for p in pools) / 2**20
        return {"repeats": repeats, "mean_s": round(sum(took) / len(took), 3), "min_s": round(min(took), 3), "max_s": round(max(took), 3), "peak_mb": round(peak, 1), "executors": by}

    def write_results(self, path: str, fmt: str | None = None) -> None:
        """By extension, as in writers.write_results."""
        if self.cores is None:
            self.run()
        writers.write_results(self.cores, path, fmt)

    def write_profile(self, path: str, append: bool = True) -> None:
        writers.write_profile(self.spark, self.profile(), path, append)
