"""Filters, samples, synthetic data and conversions of point tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_points(points: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A Bernoulli sample by a seeded hash of the id: the same rows on every run and every layout."""
    return points.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def live_points(points: DataFrame, tombstones: DataFrame) -> DataFrame:
    return points.join(tombstones.select("tag"), "tag", "left_anti").filter(F.col("tag") != 0)


def first_points(points: DataFrame, n: int) -> DataFrame:
    return points.filter(F.col("id") < n)


def points_between(points: DataFrame, offset: int, count: int) -> DataFrame:
    return points.filter(F.col("id").between(offset, offset + count - 1))


def attach_tags(points: DataFrame, tags: DataFrame) -> DataFrame:
    """points with tag, joined by id; unequal row counts raise, as does a tag that occurs twice."""
    n, m = points.count(), tags.count()
    if n != m:
        raise ValueError(f"{m} tags for {n} points")
    if tags.filter("tag <> 0").groupBy("tag").count().filter("count > 1").limit(1).count():
        raise ValueError("tags must be unique")
    return points.join(tags.select("id", "tag"), "id")


def random_points(spark: SparkSession, n: int, dim: int, norm: float | None = None, seed: int = 0, dtype: str = "float", scale: bool = False) -> DataFrame:
    """id, vec: normal coordinates, scaled to a norm if given, and by a factor of its own from 1 to 10 for each row if scale.

    Each row's numbers depend on the seed and its id alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i in batch["id"]:
                rng = np.random.default_rng([seed, int(i)])
                v = rng.normal(size=dim)
                if norm is not None:
                    v *= norm / max(np.linalg.norm(v), 1e-30)
                if scale:
                    v *= rng.uniform(1, 10)
                if dtype != "float":
                    v = np.clip(np.rint(v + (128 if dtype == "uint8" else 0)), *((0, 255) if dtype == "uint8" else (-128, 127)))
                out.append(v.tolist())
            yield pd.DataFrame({"id": batch["id"], "vec": out})

    kind = {"float": "array<float>", "int8": "array<tinyint>", "uint8": "array<smallint>"}[dtype]
    return spark.range(n).mapInPandas(run, "id long, vec array<double>").select("id", F.col("vec").cast(kind).alias("vec"))


def random_labels(spark: SparkSession, n: int, labels: int, kind: str = "zipf", seed: int = 0) -> DataFrame:
    """id, labels: label i with chance 0.7 / i (zipf), each with chance a half (random), or exactly one (one_per_point).

    Points that draw none carry label 0.
    """
    if kind not in ("zipf", "random", "one_per_point"):
        raise ValueError(f"labels are zipf, random or one_per_point, not {kind!r}")
    unit = lambda i: F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    if kind == "one_per_point":
        return spark.range(n).select("id", F.array((F.floor(unit(F.lit(0)) * labels) + 1).cast("string")).alias("labels"))
    chance = (lambda i: F.lit(0.7) / i) if kind == "zipf" else (lambda i: F.lit(0.5))
    drawn = F.transform(F.filter(F.sequence(F.lit(1), F.lit(labels)), lambda i: unit(i) < chance(i)), lambda i: i.cast("string"))
    return spark.range(n).select("id", drawn.alias("labels")).withColumn("labels", F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("0"))))


def start_on_sphere(dim: int, radius: float, seed: int = 0) -> list[float]:
    """A start point at random on a sphere around the origin."""
    v = np.random.default_rng(seed).normal(size=dim)
    return (v * radius / np.linalg.norm(v)).tolist()
