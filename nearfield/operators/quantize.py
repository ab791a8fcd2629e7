"""Product quantisation: training, encoding, table look-ups and two-stage search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.config import check_metric, check_positive
from nearfield.functions import distance as D
from nearfield.operators.clustering import bounded_sample, lloyd, seed_centres
from nearfield.operators.exact import PAIRS, RESULT, TILE, _blocks, pick, top_k
from nearfield.operators.search import Nearest
from nearfield.storage import materialise

CENTRES, TRAINING_ROWS, ROUNDS, ROTATIONS = 256, 100_000, 12, 20
MAX_CHUNKS = 512


def chunk_bounds(dim: int, chunks: int) -> np.ndarray:
    """Where the chunks of neighbouring coordinates begin and end; longer ones come first."""
    if not 1 <= chunks <= dim:
        raise ValueError(f"chunks must lie between 1 and {dim}, not {chunks}")
    short, long = divmod(dim, chunks)
    return np.cumsum([0, *([short + 1] * long), *([short] * (chunks - long))])


def chunks_for_budget(budget_bytes: float, rows: int, dim: int) -> int:
    """Bytes that each row may take, within 1 and the dimension, and 512 at most."""
    check_positive(rows=rows, dim=dim)
    return int(max(1, min(dim, MAX_CHUNKS, budget_bytes // rows)))


@dataclass(frozen=True)
class Codebook:
    """pivots[c, x] are the coordinates bounds[x]..bounds[x+1] of centre c of the chunk that holds x."""

    pivots: np.ndarray
    centroid: np.ndarray
    bounds: np.ndarray
    rotation: np.ndarray | None = None

    @property
    def chunks(self) -> int:
        return len(self.bounds) - 1

    def prepare(self, vectors: np.ndarray) -> np.ndarray:
        moved = np.asarray(vectors, dtype=np.float64) - self.centroid
        return moved if self.rotation is None else moved @ self.rotation

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        x = self.prepare(vectors)
        codes = np.empty((len(x), self.chunks), dtype=np.uint8)
        for c, (a, b) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
            codes[:, c] = D.matrix("l2", self.pivots[:, a:b], x[:, a:b]).argmin(axis=1)
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        out = np.empty((len(codes), self.pivots.shape[1]))
        for c, (a, b) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
            out[:, a:b] = self.pivots[codes[:, c], a:b]
        return (out if self.rotation is None else out @ self.rotation.T) + self.centroid

    def tables(self, queries: np.ndarray, metric: str = "l2") -> np.ndarray:
        """Partial distances of each query to each centre of each chunk: (queries, chunks, centres)."""
        q = np.asarray(queries, dtype=np.float64)
        if metric == "mips":  # codebooks for products aren't centred
            x = q if self.rotation is None else q @ self.rotation
        else:
            x = self.prepare(q)
        parts = [D.matrix(metric if metric == "mips" else "l2", self.pivots[:, a:b], x[:, a:b]) for a, b in zip(self.bounds, self.bounds[1:], strict=False)]
        return np.stack(parts, axis=1)

    def look_up(self, tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate distances (queries, rows): the sum over chunks of the table's entries for each row's codes."""
        out = np.zeros((len(tables), len(codes)))
        for c in range(self.chunks):
            out += tables[:, c, :][:, codes[:, c]]
        return out


def train(sample: np.ndarray, chunks: int, centred: bool = True, rotations: int = 0, seed: int = 0, centres: int = CENTRES) -> Codebook:
    """Centres of every chunk by k-means, of the sample less its mean; with rotations, alternate with the rotation that fits the
    reconstruction best. Fewer rows than centres leave the other centres at zero."""
    x = np.asarray(sample, dtype=np.float64)
    centroid = x.mean(axis=0) if centred and not rotations and len(x) else np.zeros(x.shape[1])
    x = x - centroid
    bounds = chunk_bounds(x.shape[1], chunks)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1],) * 2))[0] if rotations else None
    pivots = np.zeros((centres, x.shape[1]))
    for r in range(max(1, rotations)):
        turned = x if rotation is None else x @ rotation
        rebuilt = np.empty_like(turned)
        for c, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            first = seed_centres(turned[:, a:b], centres, seed + c) if r == 0 else pivots[: min(centres, len(x)), a:b]
            found, at, _ = lloyd(turned[:, a:b], first, ROUNDS if not rotations else 8)
            pivots[: len(found), a:b] = found
            rebuilt[:, a:b] = found[at]
        if rotation is not None:
            u, _, v = np.linalg.svd(x.T @ rebuilt)
            rotation = u @ v
    return Codebook(pivots, centroid, bounds, rotation)


def train_codebook(points: DataFrame, chunks: int, metric: str = "l2", optimised: bool = False, seed: int = 0, rows: int = TRAINING_ROWS, centres: int = CENTRES) -> Codebook:
    """Train on at most `rows` rows of the table. Products and optimised rotations aren't centred."""
    metric = check_metric(metric)
    sample = bounded_sample(points, rows, seed)
    if not len(sample):
        raise ValueError("no vectors to train on")
    return train(sample, chunks, centred=metric != "mips" and not optimised, rotations=ROTATIONS if optimised else 0, seed=seed, centres=centres)


def encode_column(v: Column, book: Codebook) -> Column:
    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([c.tobytes() for c in book.encode(np.stack(batch.to_numpy()))] if len(batch) else [], dtype=object)

    return run(v.cast("array<double>"))


def decode_column(codes: Column, book: Codebook) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            if not len(batch):
                yield pd.Series([], dtype=object)
                continue
            yield pd.Series(list(book.decode(np.frombuffer(b"".join(batch), dtype=np.uint8).reshape(len(batch), -1))))

    return run(codes)


def shortlist(codes: DataFrame, queries: DataFrame, width: int, book: Codebook, metric: str = "l2") -> DataFrame:
    """qid, rank, id, distance: the `width` nearest rows of (id, codes) by table look-up.

    Queries go to the tasks in blocks, where tables are made for a few at a time, and a task keeps `width` rows for each; the codes stay where they are.
    """
    check_positive(width=width)
    spark = codes.sparkSession
    found = None
    for block in _blocks(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")), max(book.pivots.shape[1], 4 * width)):
        if not block:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in block]), np.array([r["qvec"] for r in block], dtype=np.float64)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, matrix = shared.value
            best = Nearest(len(qids), width)
            for batch in batches:
                if not len(batch):
                    continue
                ids, own = batch["id"].to_numpy(), np.frombuffer(b"".join(batch["codes"]), dtype=np.uint8).reshape(len(batch), -1)
                step = max(1, TILE // len(batch))
                for s in range(0, len(matrix), step):
                    d = book.look_up(book.tables(matrix[s : s + step], metric), own)
                    keep = d <= best.limit[s : s + step, None]
                    if d.shape[1] > width:
                        keep &= d <= np.partition(d, width - 1, axis=1)[:, width - 1 : width]
                    q, b = np.nonzero(keep)
                    best.add(q + s, ids[b], d[q, b])
            q, ids, d = best.best()
            for s in range(0, len(q), PAIRS):
                yield pd.DataFrame({"qid": qids[q[s : s + PAIRS]], "id": ids[s : s + PAIRS], "distance": d[s : s + PAIRS]})

        part = codes.select("id", "codes").mapInPandas(run, RESULT)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "qid long, rank int, id long, distance double")
    return top_k(found, width)


def rerank(points: DataFrame, queries: DataFrame, candidates: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k best of each query's candidates (qid, id) by true distance: two equi-joins on ids."""
    metric = check_metric(metric)
    pairs = candidates.select("qid", "id").distinct().join(points.select("id", "vec"), "id").join(queries.select("qid", "qvec"), "qid")
    return top_k(pairs.select("qid", "id", D.distance(metric, F.col("vec"), F.col("qvec")).alias("distance")), k, metric)


def two_stage_search(points: DataFrame, codes: DataFrame, queries: DataFrame, k: int, width: int, book: Codebook, metric: str = "l2", reorder: int | None = None, complete: bool = False) -> DataFrame:
    """A shortlist of `width` by codes, or its reorder * k best, then true distances; with complete, what these miss as well (see missed; not for cosine)."""
    metric = check_metric(metric)
    if complete and metric == "cosine":
        raise ValueError("codes bound no cosine distances")
    short = shortlist(codes, queries, width, book, "mips" if metric == "mips" else "l2")
    if reorder is not None:
        short = short.filter(F.col("rank") <= reorder * k)
    best = rerank(points, queries, short, k, metric)
    return top_k(missed(points, codes, queries, best, k, book, metric), k, metric) if complete else best


def missed(points: DataFrame, codes: DataFrame, queries: DataFrame, best: DataFrame, k: int, book: Codebook, metric: str = "l2") -> DataFrame:
    """qid, id, distance: all rows that are no farther than the k-th of a query's best (qid, rank, id, distance), and so its k nearest among them.

    A row is no nearer than what its codes stand for, less their distance from the row. Only rows that this doesn't exclude for some query are compared.
    """
    spark = points.sparkSession
    worst = best.filter(F.col("rank") == k).select("qid", (-F.col("distance") if metric == "mips" else F.col("distance")).alias("worst"))
    asked = materialise(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).join(worst, "qid", "left"), "asked")
    rows = points.select("id", F.col("vec").cast("array<double>").alias("vec")).join(codes.select("id", "codes"), "id")
    found = None
    for block in _blocks(asked, book.pivots.shape[1]):
        if not block:
            continue
        shared = spark.sparkContext.broadcast((np.array([r["qid"] for r in block]), np.array([r["qvec"] for r in block], dtype=np.float64), np.array([np.inf if r["worst"] is None else r["worst"] for r in block])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qids, matrix, worst = shared.value
            lengths = (matrix * matrix).sum(axis=1)
            for batch in batches:
                if not len(batch):
                    continue
                ids, x, own = batch["id"].to_numpy(), np.stack(batch["vec"].to_numpy()), np.frombuffer(b"".join(batch["codes"]), dtype=np.uint8).reshape(len(batch), -1)
                off, step = np.sqrt(((x - book.decode(own)) ** 2).sum(axis=1)), max(1, TILE // len(batch))
                for s in range(0, len(matrix), step):
                    q, limit, length = matrix[s : s + step], worst[s : s + step], lengths[s : s + step, None]
                    d = book.look_up(book.tables(q, "mips" if metric == "mips" else "l2"), own)
                    if metric == "mips":
                        least = d - np.sqrt(length) * off
                    else:
                        least = np.maximum(0, np.sqrt(np.maximum(d, 0)) - off) ** 2 - (length if metric == "fast_l2" else 0)
                    near = least <= limit[:, None] + 1e-9 * (1 + length + np.abs(d))
                    at, to = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
                    for i, j, far in pick(metric, x[to], q[at], k, limit[at]) if len(at) else ():
                        yield pd.DataFrame({"qid": qids[at[i] + s], "id": ids[to[j]], "distance": far})

        part = rows.mapInPandas(run, RESULT)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], RESULT) if found is None else found


def quantisation_error(points: DataFrame, book: Codebook) -> DataFrame:
    """One row: the mean squared distance between vectors and what their codes stand for."""
    rebuilt = points.withColumn("_r", decode_column(encode_column(F.col("vec"), book), book))
    return rebuilt.agg(F.avg(D.l2(F.col("vec"), F.col("_r"))).alias("error"))

