"""python -m nearfield COMMAND: build, search, truth, recall and convert from the shell, over Parquet tables or vector files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield import api
from nearfield.operators import exact, stats
from nearfield.plans.report import sweep
from nearfield.sources import files


def _points(spark: SparkSession, path: str, dtype: str) -> DataFrame:
    if path.endswith((".fvecs", ".bvecs", ".ivecs")):
        return files.read_vecs(spark, path, {"f": "float", "b": "uint8", "i": "int32"}[path[-5]])
    if path.endswith(".tsv"):
        return files.read_tsv(spark, path)
    return files.read_matrix(spark, path, dtype) if path.endswith((".bin", ".fbin", ".i8bin", ".u8bin")) else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="nearfield", description=__doc__)
    parser.add_argument("--dtype", default="float", choices=("float", "int8", "uint8"))
    parser.add_argument("--metric", default="l2")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, words in {
        "build": ("data", "index"),
        "search": ("index", "queries", "truth"),
        "truth": ("data", "queries", "out"),
        "recall": ("truth", "results"),
        "convert": ("data", "out"),
        "norms": ("data",),
    }.items():
        sub = commands.add_parser(name)
        for w in words:
            sub.add_argument(w)
        if name in ("search", "truth", "recall"):
            sub.add_argument("-k", type=int, default=10)
        if name == "search":
            sub.add_argument("-L", type=int, nargs="+", default=[10, 20, 50, 100])
            sub.add_argument("--fail-below", type=float)
        if name == "build":
            sub.add_argument("-R", type=int, default=64)
            sub.add_argument("-L", type=int, default=100)
            sub.add_argument("--code-bytes", type=float)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("nearfield").getOrCreate()
    asked = lambda p: _points(spark, p, a.dtype).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    if a.command == "build":
        points = _points(spark, a.data, a.dtype)
        if a.code_bytes is None:
            api.build_memory_index(points, a.metric, path=a.index, dtype=a.dtype, graph_degree=a.R, complexity=a.L)
        else:
            api.build_disk_index(points, a.metric, a.index, dtype=a.dtype, graph_degree=a.R, complexity=a.L, code_bytes=a.code_bytes)
    elif a.command == "search":
        sweep(api.Index.load(spark, a.index), asked(a.queries), spark.read.parquet(a.truth), a.k, a.L, fail_below=a.fail_below).show()
    elif a.command == "truth":
        exact.exact_knn(_points(spark, a.data, a.dtype), asked(a.queries), a.k, a.metric).write.parquet(a.out)
    elif a.command == "recall":
        stats.recall(spark.read.parquet(a.truth), spark.read.parquet(a.results), a.k).show()
    elif a.command == "norms":
        stats.norm_percentiles(_points(spark, a.data, a.dtype)).orderBy("percentile").show(100)
    elif a.out.endswith((".fvecs", ".bvecs")):
        files.write_vecs(_points(spark, a.data, a.dtype), a.out, "float" if a.out.endswith("fvecs") else "uint8")
    elif a.out.endswith((".bin", ".fbin")):
        files.write_matrix(_points(spark, a.data, a.dtype), a.out, a.dtype)
    elif a.out.endswith(".tsv"):
        files.write_tsv(_points(spark, a.data, a.dtype), a.out)
    else:
        _points(spark, a.data, a.dtype).write.parquet(a.out)


if __name__ == "__main__":
    main()
