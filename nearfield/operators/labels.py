"""Operators over a labelled table (id, labels[, vec]): dictionary, universal label, dense points, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.config import check_positive
from nearfield.storage import global_rank


def label_counts(points: DataFrame) -> DataFrame:
    """label, points: how many points carry each label. Null and empty label arrays count for none."""
    return points.select("id", F.explode(F.array_distinct("labels")).alias("label")).groupBy("label").agg(F.count("*").alias("points"))


def label_dictionary(points: DataFrame, universal: str | None = None) -> DataFrame:
    """label, label_id: numbers from 1 in the order of the labels; the universal label is 0."""
    names = points.select(F.explode("labels").alias("label")).distinct()
    if universal is None:
        return global_rank(names, ["label"], "n").select("label", (F.col("n") + 1).cast("int").alias("label_id"))
    plain = global_rank(names.filter(F.col("label") != universal), ["label"], "n").select("label", (F.col("n") + 1).cast("int").alias("label_id"))
    return plain.unionByName(points.sparkSession.createDataFrame([(universal, 0)], "label string, label_id int"))


def encode_labels(points: DataFrame, dictionary: DataFrame) -> DataFrame:
    """id, label_ids: sorted numbers of each point's labels; points without labels have an empty array."""
    pairs = points.select("id", F.explode("labels").alias("label")).join(dictionary, "label").groupBy("id").agg(F.sort_array(F.collect_set("label_id")).alias("label_ids"))
    return points.select("id").distinct().join(pairs, "id", "left").select("id", F.coalesce("label_ids", F.array().cast("array<int>")).alias("label_ids"))


def decode_labels(encoded: DataFrame, dictionary: DataFrame) -> DataFrame:
    pairs = encoded.select("id", F.explode("label_ids").alias("label_id")).join(dictionary, "label_id").groupBy("id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return encoded.select("id").distinct().join(pairs, "id", "left").select("id", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def encode_queries(queries: DataFrame, dictionary: DataFrame, universal: str | None = None) -> DataFrame:
    """queries with qlabel_id; an unknown label becomes the universal one (0), or raises when the plan runs if there is none."""
    known = queries.join(dictionary.select(F.col("label").alias("qlabel"), F.col("label_id").alias("_known")), "qlabel", "left")
    other = F.lit(0) if universal is not None else F.raise_error(F.concat(F.lit("unknown label: "), F.col("qlabel"))).cast("int")
    return known.withColumn("qlabel_id", F.when(F.col("_known").isNotNull(), F.col("_known")).when(F.col("qlabel").isNotNull(), other)).drop("_known")


def expand_universal(points: DataFrame, universal: str) -> DataFrame:
    """Points with the universal label get every label of the table, by a join on that one fact."""
    every = points.select(F.explode("labels").alias("l")).filter(F.col("l") != universal).distinct().groupBy().agg(F.sort_array(F.collect_list("l")).alias("_all"))
    marked = points.withColumn("_u", F.coalesce(F.array_contains("labels", universal), F.lit(False)))
    joined = marked.join(every.withColumn("_u", F.lit(True)), "_u", "left")
    return joined.withColumn("labels", F.when(F.col("_u"), F.col("_all")).otherwise(F.col("labels"))).drop("_u", "_all")


def break_dense_points(points: DataFrame, most: int) -> DataFrame:
    """Points with more than `most` labels become replicas with the same vector and at most that many labels each.

    Replica 0 keeps the first labels. Results over replicas are results over ids, as replicas share them.
    """
    check_positive(most=most)
    n = F.greatest(F.lit(1), F.ceil(F.size("labels") / F.lit(most))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.struct(r.alias("replica"), F.slice(F.col("labels"), r * most + 1, F.lit(most)).alias("labels")))
    others = [c for c in points.columns if c != "labels"]
    return points.withColumn("labels", F.coalesce("labels", F.array().cast("array<string>"))).select(*others, F.inline(parts))


def label_statistics(points: DataFrame, density: int = 10) -> DataFrame:
    """One row: points, labels, mean labels of a point, mean points of a label, and the share of points with `density` labels or more."""
    per_point = points.agg(F.count("*").alias("points"), F.avg(F.size(F.coalesce("labels", F.array().cast("array<string>")))).alias("labels_per_point"), F.avg((F.size(F.coalesce("labels", F.array().cast("array<string>"))) >= density).cast("double")).alias("dense_share"))
    per_label = label_counts(points).agg(F.count("*").alias("labels"), F.avg("points").alias("points_per_label"), F.max("points").alias("largest"), F.min("points").alias("smallest"))
    one = F.lit(1)
    return per_point.withColumn("_k", one).join(per_label.withColumn("_k", one), "_k").drop("_k")


def label_count_percentiles(points: DataFrame, step: int = 5) -> DataFrame:
    """percentile, points: the count at index floor(p * n) of the sorted label counts, for p from 0 on in steps, and the largest at 100."""
    from nearfield.operators.stats import index_percentiles

    return index_percentiles(label_counts(points).select(F.col("points").cast("double").alias("value")), [p / 100 for p in range(0, 100, step)] + [1.0]).withColumnRenamed("value", "points")


def top_labels(points: DataFrame, n: int = 3) -> DataFrame:
    return label_counts(points).orderBy(F.desc("points"), "label").limit(n)


def clamp_k(points: DataFrame, label: str, k: int, universal: str | None = None) -> int:
    """k, but at most the number of points that the label lets through."""
    from nearfield.functions.labels import matches

    return min(k, points.filter(matches(F.col("labels"), label, universal)).count())


def sample_labels(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n labels drawn in proportion to how often they occur, with the seed's order."""
    return points.select("id", F.explode("labels").alias("label")).orderBy(F.xxhash64("id", "label", F.lit(seed)), "id", "label").limit(n).select("label")
