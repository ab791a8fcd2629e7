"""Search reports, request tables and inspection of an index."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators import search, stats
from nearfield.operators.graph import edges_of
from nearfield.operators.points import random_points
from nearfield.plans.index import Index, requests, respond
from nearfield.storage import materialise


def sweep(index: Index, queries: DataFrame, truth: DataFrame, k: int, widths: Sequence[int], shards: int = 4, fail_below: float | None = None) -> DataFrame:
    """A row for each list width L of at least k: qps, mean hops and comparisons, and recall at k in percent.

    truth has (qid, rank, id, distance) beyond k, for ties. With fail_below, a best recall under it raises.
    """
    rows, n = [], queries.count()
    for width in widths:
        if width < k:
            continue
        began = time.perf_counter()
        found = materialise(index.search(queries, k, width, shards), "sweep")
        took = time.perf_counter() - began
        work = search.ann_search(index.shards, index.centres, index.prepared(queries), k, width, index.config.metric, shards, index.config.universal_label, stats=True).agg(F.avg("hops"), F.avg("cmps")).first()
        rows.append((width, n / took, float(work[0] or 0), float(work[1] or 0), float(stats.recall(truth, found, k).first()[0])))
    if fail_below is not None and max((r[-1] for r in rows), default=0.0) < fail_below:
        raise RuntimeError(f"best recall of {max((r[-1] for r in rows), default=0.0):.2f} is below {fail_below}")
    return index.spark.createDataFrame(rows, "L int, qps double, hops double, cmps double, recall double")


def tune_beam(index: Index, queries: DataFrame, k: int, width: int, most: int = 32) -> DataFrame:
    """beam, qps: beams of 1, 2, 4, ... up to `most`, as long as one is faster than the last; the last row but one, or the only one, is the best."""
    n, rows, beam = queries.count(), [], 1
    while beam <= most:
        began = time.perf_counter()
        materialise(index.beam(queries, k, width, beam), "tune")
        rows.append((beam, n / (time.perf_counter() - began)))
        if len(rows) > 1 and rows[-1][1] <= rows[-2][1]:
            break
        beam *= 2
    return index.spark.createDataFrame(rows, "beam int, qps double")


def warm_up(index: Index, queries: DataFrame | None = None, n: int = 100, k: int = 1, width: int = 20) -> int:
    """Search with the given queries, or with n random ones, so that tables are read once before anything is timed; how many results came."""
    if queries is None:
        queries = random_points(index.spark, n, index.config.dim, 1.0, 1).select(F.col("id").alias("qid"), F.col("vec").cast("array<double>").alias("qvec"))
    return index.search(queries, k, width).count()


def answer(index: Index, lines: DataFrame) -> DataFrame:
    """query_id, response: JSON answers to JSON requests (see requests), with an error where a request is wrong.

    Requests are answered together at the largest width asked for; each gets the first k of its own results. Where the request's query_id is the id of
    a row, that row comes before others at the same distance, so that copies of a stored vector don't take its place.
    """
    asked = materialise(requests(lines), "requests")
    fine = asked.filter("error is null")
    most = fine.agg(F.max("width")).first()[0]
    wrong = asked.filter("error is not null").select(F.col("qid").alias("query_id"), F.to_json(F.struct(F.col("qid").alias("query_id"), "error")).alias("response"))
    if most is None:
        return wrong
    sized = fine.filter(F.size("qvec") == index.config.dim)
    other = fine.filter(F.size("qvec") != index.config.dim).select(F.col("qid").alias("query_id"), F.to_json(F.struct(F.col("qid").alias("query_id"), F.lit("wrong number of coordinates").alias("error"))).alias("response"))
    order = Window.partitionBy("qid").orderBy("distance" if index.config.metric != "mips" else F.desc("distance"), F.col("id") != F.col("qid"), "id")
    every = index.search(sized.select("qid", "qvec", "qlabel"), most, most).withColumn("rank", F.row_number().over(order).cast("int"))
    found = every.join(sized.select("qid", "k"), "qid").filter(F.col("rank") <= F.col("k")).drop("k")
    tags = found.join(index.points.select("id", "tag"), "id").select("qid", "rank", "id", "distance", "tag")
    return respond(tags, sized).select(F.col("qid").alias("query_id"), "response").unionByName(wrong).unionByName(other)


def inspect(index: Index) -> dict[str, DataFrame]:
    """The index as flat tables for export: nodes with their degree, edges, shards, and codes if there are any."""
    g = index.graph()
    out = {
        "nodes": index.points.join(g, "id").select("id", "tag", F.size("nbrs").alias("degree"), F.array_join(F.col("vec").cast("array<string>"), ",").alias("vec")),
        "edges": edges_of(g),
        "shards": index.shards.groupBy("shard").agg(F.count("*").alias("rows"), F.max(F.when(F.col("entry"), F.col("id"))).alias("entry")),
    }
    if index.codes is not None:
        out["codes"] = index.codes.select("id", F.hex("codes").alias("codes"))
    return out


def nodes_near(graph: DataFrame, starts: DataFrame, most: int, levels: int = 32) -> DataFrame:
    """id, level: nodes reached first from the start ids, level by level, until a level would pass `most`; what is worth keeping in memory."""
    edges = edges_of(graph).withColumnRenamed("src", "id")
    seen = materialise(starts.select("id").distinct().withColumn("level", F.lit(0)), "near")
    frontier = seen
    for level in range(1, levels + 1):
        step = edges.join(frontier.select("id"), "id", "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = materialise(step.join(seen, "id", "left_anti").withColumn("level", F.lit(level)), "near")
        n = frontier.count()
        if not n or n + seen.count() > most:
            break
        seen = seen.unionByName(frontier)
    return seen
