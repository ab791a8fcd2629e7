"""Aggregates over vectors, graphs and results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import distance as D
from nearfield.storage import discard, global_rank, materialise


def centroid(points: DataFrame) -> list[float]:
    """The mean vector: one aggregate for each coordinate, combined before the shuffle."""
    first = points.select(F.size("vec")).first()
    if first is None:
        return []
    return [float(x) for x in points.agg(*[F.avg(F.col("vec")[i].cast("double")) for i in range(first[0])]).first()]


def medoid(points: DataFrame) -> DataFrame:
    """id, distance: the point nearest to the mean by l2, the least id on a tie."""
    mean = centroid(points)
    centre = F.array(*[F.lit(x) for x in mean]) if mean else F.array().cast("array<double>")
    best = points.agg(F.min(F.struct(D.l2(F.col("vec"), centre).alias("distance"), F.col("id"))).alias("b"))
    return best.select("b.id", "b.distance").filter("id is not null")


def label_medoids(points: DataFrame, seed: int = 0) -> DataFrame:
    """label, entry_id: one member of each label, drawn by a seeded hash."""
    members = points.select("id", F.explode("labels").alias("label"))
    return members.groupBy("label").agg(F.min(F.struct(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("id"))).alias("m")).select("label", F.col("m.id").alias("entry_id"))


def index_percentiles(values: DataFrame, shares: Sequence[float]) -> DataFrame:
    """percentile, value: the element at index floor(p * n) of the sorted values (the last for p = 1)."""
    n = values.count()
    if not n:
        return values.sparkSession.createDataFrame([], "percentile double, value double")
    wanted = [(100.0 * p, min(n - 1, int(p * n))) for p in shares]
    ranked = global_rank(values.select("value"), ["value", F.rand(0)], "_r")
    asked = values.sparkSession.createDataFrame(wanted, "percentile double, _r long")
    return ranked.join(F.broadcast(asked), "_r").select("percentile", "value")


def norm_percentiles(points: DataFrame, shares: Sequence[float] | None = None) -> DataFrame:
    return index_percentiles(points.select(D.norm(F.col("vec")).alias("value")), shares or [*(p / 100 for p in range(0, 100, 5)), 1.0])


def query_statistics(values: DataFrame, shares: Sequence[float] = (0.5, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """Percentiles of per-query figures (value) with their mean in every row."""
    mean = values.agg(F.avg("value")).first()[0]
    return index_percentiles(values, shares).withColumn("mean", F.lit(mean))


def recall(truth: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """One row, recall in percent: results (qid, rank, id) up to k among the truth (qid, rank, id, distance) up to k and its ties.

    Truth beyond rank k counts if it is as near as the k-th. The number of queries is the truth's.
    """
    kth = truth.filter(F.col("rank") == k).select("qid", F.col("distance").alias("_kth"))
    good = truth.join(kth, "qid", "left").filter((F.col("rank") <= k) | (F.col("distance") == F.col("_kth"))).select("qid", "id").distinct()
    ours = results.filter(F.col("rank") <= k).select("qid", "id").distinct()
    n = truth.agg(F.countDistinct("qid").alias("n"))
    hits = good.join(ours, ["qid", "id"]).agg(F.count("*").alias("h"))
    return hits.withColumn("_k", F.lit(1)).join(n.withColumn("_k", F.lit(1)), "_k").select((F.col("h") * 100.0 / (F.col("n") * k)).alias("recall"))


def recall_active(truth: DataFrame, results: DataFrame, k: int, active: DataFrame) -> DataFrame:
    """Recall where only truth among active ids counts; ranks close up over the others."""
    live = truth.join(active.select("id"), "id", "left_semi")
    w = Window.partitionBy("qid").orderBy("distance", "id")
    return recall(live.withColumn("rank", F.row_number().over(w)), results, k)


def range_recall(truth: DataFrame, results: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the mean over queries of found / true in percent (100 where nothing is to be found), and the ratio of the sums."""
    g = truth.groupBy("qid").agg(F.count("*").alias("g"))
    h = truth.select("qid", "id").join(results.select("qid", "id").distinct(), ["qid", "id"]).groupBy("qid").agg(F.count("*").alias("h"))
    every = queries.select("qid").distinct().join(g, "qid", "left").join(h, "qid", "left").select(F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("h", F.lit(0)).alias("h"))
    share = F.when(F.col("g") == 0, 100.0).otherwise(F.col("h") * 100.0 / F.col("g"))
    return every.agg(F.avg(share).alias("recall"), F.when(F.sum("g") > 0, F.sum("h") * 100.0 / F.sum("g")).otherwise(100.0).alias("ratio"))


def degree_statistics(graph: DataFrame) -> DataFrame:
    """One row: most, mean and least out-degree, and how many nodes have fewer than two edges."""
    n = F.size("nbrs")
    return graph.agg(F.max(n).alias("max_degree"), F.avg(n).alias("avg_degree"), F.min(n).alias("min_degree"), F.count_if(n < 2).alias("low_degree"))


#: Nodes of a frontier that still go to every task; eight bytes each.
FRONTIER = 1_000_000


def bfs_levels(graph: DataFrame, starts: DataFrame, most: int = 32) -> DataFrame:
    """level, nodes: how many nodes are first reached in each step from the start ids.

    Edges are written once, and one table of reached nodes is kept; the frontier is broadcast while it is small (FRONTIER rows), else joined.
    """
    edges = materialise(graph.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst")), "edges")
    spark = graph.sparkSession
    seen = materialise(starts.select(F.col("id"), F.lit(0).alias("level")).distinct(), "seen")
    n, levels = seen.count(), []
    for level in range(most):
        if not n:
            break
        levels.append((level, n))
        frontier = seen.filter(F.col("level") == level).select(F.col("id").alias("src"))
        step = edges.join(F.broadcast(frontier) if n <= FRONTIER else frontier, "src", "left_semi").select(F.col("dst").alias("id"), F.lit(level + 1).alias("level"))
        old, seen = seen, materialise(seen.unionByName(step).groupBy("id").agg(F.min("level").alias("level")), "seen")
        discard(old)
        n = seen.filter(F.col("level") == level + 1).count()
    return spark.createDataFrame(levels, "level int, nodes long")


def hottest(visits: DataFrame, n: int) -> DataFrame:
    """id, visits: the n nodes that a search trace (qid, id) visits most."""
    return visits.groupBy("id").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "id").limit(n)


def active_tags(points: DataFrame, tombstones: DataFrame | None = None) -> DataFrame:
    """Distinct tags that are neither hidden (0) nor deleted."""
    live = points.filter(F.col("tag") != 0).select("tag").distinct()
    return live if tombstones is None else live.join(tombstones.select("tag"), "tag", "left_anti")


def simulate_aggregate_recall(spark, k_each: int, k: int, partitions: int, runs: int, seed: int = 0) -> DataFrame:
    """One row, recall in percent: how many of the k best survive if each of `partitions` random parts gives its k_each best."""
    one = spark.range(runs).select(F.col("id").alias("run"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("i"))
    dealt = one.withColumn("part", F.pmod(F.xxhash64("run", "i", F.lit(seed)), F.lit(partitions))).groupBy("run", "part").agg(F.least(F.count("*"), F.lit(k_each)).alias("kept"))
    return dealt.groupBy("run").agg(F.sum("kept").alias("kept")).agg((F.avg("kept") * 100.0 / k).alias("recall"))


def vector_norms(points: DataFrame) -> DataFrame:
    return points.select("id", D.squared_norm(F.col("vec")).alias("norm2"))
