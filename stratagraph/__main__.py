"""Command line: python -m stratagraph INPUT [options]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.decomposition import Decomposition


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="stratagraph", description="Core numbers of a graph file.")
    a.add_argument("input")
    a.add_argument("--format", help="txt, mtx, npz, hdf5, zip, adjlist, csr or parquet; by extension if left out")
    a.add_argument("--prepared", action="store_true", help="the edges are clean already")
    a.add_argument("-o", "--output", help="where to write the core numbers (.json, .txt, .mtx, .npz, .h5 or Parquet)")
    a.add_argument("-p", "--profile", help="CSV folder that gets a row about the run")
    a.add_argument("--profile-new", action="store_true", help="start the profile anew")
    a.add_argument("-c", "--comment", default="", help="a remark kept in the profile")
    a.add_argument("-v", "--verbose", type=int, choices=(0, 1, 2), default=1)
    a.add_argument("--cache", choices=("none", "hdf5", "npz", "mtx", "txt", "parquet"), default="none")
    a.add_argument("--cache-prepared", action="store_true")
    a.add_argument("--relabel", choices=("dense", "degree_desc", "degeneracy"))
    a.add_argument("--no-run", action="store_true", help="only read, prepare and cache")
    a.add_argument("-m", "--mode", choices=("auto", "hindex", "peel", "compacting", "local"), default="auto")
    a.add_argument("--repeat", type=int, default=1, help="runs this often and prints mean seconds and peak memory")
    x = a.parse_args(argv)
    spark = SparkSession.builder.appName("stratagraph").getOrCreate()
    d = Decomposition(spark, x.input, x.format, x.prepared, x.mode, x.relabel, True, None if x.cache == "none" else x.cache, x.cache_prepared, x.comment, max(0, x.verbose - 1))
    if x.no_run:
        return
    d.run()
    if x.repeat > 1:
        print(", ".join(f"{k} {v}" for k, v in d.measure(x.repeat).items()))
    if x.verbose:
        print(", ".join(f"{k} {v}" for k, v in d.profile().items()))
    if x.output:
        d.write_results(x.output)
    if x.profile:
        d.write_profile(x.profile, not x.profile_new)


if __name__ == "__main__":
    main()
