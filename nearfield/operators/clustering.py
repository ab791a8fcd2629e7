"""k-means and partitioning into shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.config import check_positive
from nearfield.functions.distance import matrix
from nearfield.operators.exact import TILE
from nearfield.operators.points import sample_points

#: Rows that seeding looks at on the driver.
SEEDING_ROWS = 20_000


def nearest(centres: np.ndarray, vectors: np.ndarray, k: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and distances of each vector's k nearest centres by (distance, number), TILE distances at a time."""
    k = min(k, len(centres))
    numbers, far = np.empty((len(vectors), k), dtype=np.int64), np.empty((len(vectors), k))
    step = max(1, TILE // max(1, len(centres)))
    for s in range(0, len(vectors), step):
        d = matrix("l2", centres, vectors[s : s + step])
        every = np.arange(len(d))
        order = np.argsort(d, axis=1, kind="stable")[:, :k] if k > 8 else None
        for j in range(k):
            at = d.argmin(axis=1) if order is None else order[:, j]
            numbers[s : s + step, j], far[s : s + step, j] = at, d[every, at]
            if order is None:
                d[every, at] = np.inf
    return numbers, far


def seed_centres(sample: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """k-means++: each next centre is drawn in proportion to the squared distance to those chosen."""
    rng = np.random.default_rng(seed)
    if len(sample) <= k:
        return sample.copy()
    chosen = [int(rng.integers(len(sample)))]
    near = matrix("l2", sample, sample[chosen])[0]
    while len(chosen) < k:
        total = near.sum()
        pick = int(rng.choice(len(sample), p=near / total)) if total > 0 else int(rng.integers(len(sample)))
        chosen.append(pick)
        near = np.minimum(near, matrix("l2", sample, sample[[pick]])[0])
    return sample[chosen].copy()


def lloyd(sample: np.ndarray, centres: np.ndarray, most: int = 12, change: float = 1e-5) -> tuple[np.ndarray, np.ndarray, float]:
    """Centres, assignment and residual after Lloyd rounds in memory; an empty cluster's centre becomes zero."""
    residual = np.inf
    for _ in range(most):
        near, d = nearest(centres, sample)
        at, now = near[:, 0], float(d.sum())
        sums = np.zeros_like(centres)
        np.add.at(sums, at, sample)
        counts = np.bincount(at, minlength=len(centres))[:, None]
        centres = np.divide(sums, counts, out=np.zeros_like(sums), where=counts > 0)
        if now == 0 or (np.isfinite(residual) and abs(residual - now) <= change * now):
            residual = now
            break
        residual = now
    near, d = nearest(centres, sample)
    return centres, near[:, 0], float(d.sum())


def bounded_sample(points: DataFrame, rows: int = SEEDING_ROWS, seed: int = 0) -> np.ndarray:
    """At most `rows` vectors, spread by a hash of the id, in the order of the hash."""
    n = points.count()
    some = points if n <= rows else sample_points(points, min(1.0, 1.2 * rows / n), seed)
    got = some.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(rows).select(F.col("vec").cast("array<double>")).collect()
    return np.array([r[0] for r in got], dtype=np.float64)


def kmeans(points: DataFrame, k: int, most: int = 12, change: float = 1e-5, seed: int = 0) -> np.ndarray:
    """k centres of all points: seeded and started on a bounded sample, then Lloyd rounds over the table.

    A round sends k partial sums for each batch of rows, never the rows.
    """
    check_positive(k=k, most=most)
    sample = bounded_sample(points, seed=seed)
    if not len(sample):
        return np.zeros((0, 0))
    centres = seed_centres(sample, k, seed)
    centres, _, _ = lloyd(sample, centres, most, change)
    if points.limit(len(sample) + 1).count() <= len(sample):
        return centres
    residual = None
    for _ in range(most):
        shared = points.sparkSession.sparkContext.broadcast(centres)

        def sums(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            c = shared.value
            total, count, lost = np.zeros_like(c), np.zeros(len(c), dtype=np.int64), np.zeros(len(c))
            for batch in batches:
                if len(batch):
                    x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
                    d = matrix("l2", c, x)
                    at = d.argmin(axis=1)
                    np.add.at(total, at, x)
                    count += np.bincount(at, minlength=len(c))
                    np.add.at(lost, at, d[np.arange(len(x)), at])
            yield pd.DataFrame({"centre": np.arange(len(c)), "total": list(total), "n": count, "lost": lost})

        parts = points.select(F.col("vec").cast("array<double>").alias("vec")).mapInPandas(sums, "centre long, total array<double>, n long, lost double")
        got = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"), *[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(centres.shape[1])]).collect()
        fresh = np.zeros_like(centres)
        for r in got:
            if r["n"]:
                fresh[r["centre"]] = np.array([r[f"s{i}"] for i in range(centres.shape[1])]) / r["n"]
        now = sum(r["lost"] for r in got)
        centres = fresh
        if residual is not None and abs(residual - now) <= change * max(now, 1e-300):
            break
        residual = now
    return centres


def nearest_centres(points: DataFrame, centres: np.ndarray, k: int = 1) -> DataFrame:
    """points with `near`: the numbers of the k nearest centres by (distance, number)."""
    c = np.asarray(centres, dtype=np.float64)

    @F.pandas_udf("array<int>")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(nearest(c, np.stack(batch.to_numpy()).astype(np.float64), k)[0].astype(np.int32)))

    return points.withColumn("near", near(F.col("vec").cast("array<double>")))


def partition(points: DataFrame, centres: np.ndarray, replicas: int = 1) -> DataFrame:
    """points with `shard`, one row for each of the `replicas` nearest centres."""
    rows = nearest_centres(points, centres, min(replicas, len(centres)))
    return rows.select(*points.columns, F.explode("near").alias("shard"))


def shard_ids(points: DataFrame, centres: np.ndarray, replicas: int = 1) -> DataFrame:
    """shard, id only; joining points on id gives a shard's rows back."""
    return partition(points, centres, replicas).select("shard", "id")


def estimate_shard_sizes(points: DataFrame, centres: np.ndarray, replicas: int = 1, share: float = 1.0, seed: int = 1) -> dict[int, int]:
    """Rows of each shard, from a sample of the given share."""
    counted = partition(sample_points(points, share, seed) if share < 1 else points, centres, replicas).groupBy("shard").count().collect()
    return {int(r["shard"]): round(r["count"] / min(1.0, share)) for r in counted}


def partition_for_budget(points: DataFrame, rows: int, replicas: int = 2, seed: int = 0, first: int = 3, step: int = 2) -> tuple[np.ndarray, DataFrame]:
    """Centres and sharded points such that no shard holds more than `rows` rows.

    One shard if all rows fit. Otherwise the number of parts starts at `first`, or where an even split would fit, and grows by `step` until the
    largest estimate fits; sizes are estimated on a bounded sample. Then the rows of each centre are counted. Where they don't fit, as with a great
    number of equal vectors or more rows than the sample can tell apart, they are dealt by a hash of their id to several shards, so few to each
    that it keeps within `rows` (by five standard deviations or so), and the centre stands in the result once for each of them.
    """
    n = points.count()
    if n <= rows:
        return np.zeros((1, len(points.select("vec").first()[0]) if n else 0)), points.withColumn("shard", F.lit(0))
    replicas = min(replicas, first)
    sample = bounded_sample(points, seed=seed)
    parts = min(max(first, -(-n * replicas // rows)), max(first, len(sample) // 8))
    while True:
        centres, _, _ = lloyd(sample, seed_centres(sample, parts, seed))
        centres = np.unique(centres, axis=0)
        near, _ = nearest(centres, sample, replicas)
        sizes = np.bincount(near.ravel(), minlength=len(centres)) * n / len(sample)
        if sizes.max() <= rows or parts >= len(sample) // 8 or len(centres) < parts:
            break
        parts = min(parts + max(step, parts // 4), max(first, len(sample) // 8))
    dealt = partition(points, centres, replicas)
    counted = np.zeros(len(centres), dtype=np.int64)
    for r in dealt.groupBy("shard").count().collect():
        counted[r["shard"]] = r["count"]
    room = max(rows / 4, (((25 + 4 * rows) ** 0.5 - 5) / 2) ** 2)  # rows, less five standard deviations of what a hash deals to a shard
    copies = np.where(counted > rows, np.ceil(counted / room), 1).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(copies)[:-1]])
    if (copies > 1).any():
        table = points.sparkSession.createDataFrame([(i, int(a), int(c)) for i, (a, c) in enumerate(zip(start, copies, strict=True))], "shard int, _first int, _copies int")
        dealt = dealt.join(F.broadcast(table), "shard").withColumn("shard", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_copies"))).cast("int")).select(*points.columns, "shard")
    return np.repeat(centres, copies, axis=0), dealt


def shards_of(vectors: np.ndarray, centres: np.ndarray, parts: int) -> list[list[int]]:
    """For each vector the shards of its `parts` nearest centres, all copies of each."""
    unique, at = np.unique(centres, axis=0, return_inverse=True)
    members = [np.flatnonzero(at == i) for i in range(len(unique))]
    order, _ = nearest(unique, vectors, parts)
    return [np.concatenate([members[c] for c in row]).tolist() for row in order]


def centre_table(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "shard int, centre array<double>")
