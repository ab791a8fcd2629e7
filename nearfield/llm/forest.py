"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them, exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample that trees are fitted on; it goes to the driver, and the trees with it to every task. More rows make finer trees.
SAMPLE_ROWS = 20_000
TREES = 4
#: Leaves aim at N / LEAVES rows, within these limits.
LEAVES, MIN_LEAF, MAX_LEAF = 400, 16, 512
#: A leaf with more rows than this is dealt to several tasks, and its queries to each of them.
BLOCK_ROWS = 4_096
#: Recall on the sample that the search budget is set for.
TARGET, CALIBRATION_QUERIES = 0.96, 300


@dataclass
class Forest:
    """Inner nodes have a unit normal and threshold; child c >= 0 is a node and ~c a leaf. weight is a leaf's share of the rows."""

    normals: np.ndarray
    thresholds: np.ndarray
    children: np.ndarray
    roots: list[int]
    weights: np.ndarray
    members: list[np.ndarray]
    budget: float = 1.0

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root, dtype=np.int64)
            while (inner := np.flatnonzero(at >= 0)).size:
                n = at[inner]
                right = np.einsum("ij,ij->i", vectors[inner], self.normals[n]) > self.thresholds[n]
                at[inner] = self.children[n, right.astype(np.int64)]
            out[:, t] = ~at
        return out

    def leaves(self, query: np.ndarray) -> Iterator[int]:
        """Leaves of all trees in order of the squared margins crossed to reach them, from one shared queue."""
        margins = self.normals @ query - self.thresholds if len(self.normals) else self.thresholds
        queue = [(0.0, i, root) for i, root in enumerate(self.roots)]
        heapq.heapify(queue)
        pushed = len(queue)
        while queue:
            crossed, _, n = heapq.heappop(queue)
            while n >= 0:
                m = float(margins[n])
                side = int(m > 0)
                heapq.heappush(queue, (crossed + m * m, pushed, int(self.children[n, 1 - side])))
                pushed += 1
                n = int(self.children[n, side])
            yield ~n

    def search(self, query: np.ndarray) -> list[int]:
        """Leaves until their rows, counted once for each tree, make up the budget."""
        found, seen = [], 0.0
        for leaf in self.leaves(query):
            found.append(leaf)
            seen += self.weights[leaf]
            if seen >= self.budget:
                break
        return found


def fit(sample: np.ndarray, leaf: float, trees: int = TREES, seed: int = 7) -> Forest:
    """Split at the median of projections on the difference of two random rows, down to `leaf` rows of the sample.

    A node whose rows are all equal, or that no projection splits, is a leaf.
    """
    rng = np.random.default_rng(seed)
    normals, thresholds, children, roots, members = [], [], [], [], []

    def split(rows: np.ndarray):
        for _ in range(8):
            a, b = rng.choice(len(rows), 2, replace=False)
            normal = sample[rows[a]] - sample[rows[b]]
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                projected = sample[rows] @ normal
                threshold = float(np.median(projected))
                right = projected > threshold
                if 0 < np.count_nonzero(right) < len(rows):
                    return normal, threshold, right
        return None

    for _ in range(trees):
        todo = [(np.arange(len(sample)), -1, 0)]
        root = None
        while todo:
            rows, parent, side = todo.pop()
            cut = split(rows) if len(rows) > max(leaf, 2) else None
            if cut is None:
                at = ~len(members)
                members.append(rows)
            else:
                at = len(normals)
                normals.append(cut[0])
                thresholds.append(cut[1])
                children.append([0, 0])
                todo += [(rows[~cut[2]], at, 0), (rows[cut[2]], at, 1)]
            if parent < 0:
                root = at
            else:
                children[parent][side] = at
        roots.append(root)
    d = sample.shape[1]
    weights = np.array([len(m) for m in members], dtype=np.float64) / max(1, len(sample))
    return Forest(np.array(normals, dtype=np.float64).reshape(-1, d), np.array(thresholds), np.array(children, dtype=np.int64).reshape(-1, 2), roots, weights, members)


def calibrate(forest: Forest, sample: np.ndarray, k: int, target: float, queries: int = CALIBRATION_QUERIES) -> float:
    """The least budget that finds the target share of true neighbours within the sample, with a tenth more for safety."""
    if len(sample) <= k + 1:
        return float(len(forest.roots))
    need = []
    norms = np.einsum("ij,ij->i", sample, sample)
    for q in np.linspace(0, len(sample) - 1, min(queries, len(sample))).astype(int):
        d = norms - 2 * sample @ sample[q]
        d[q] = np.inf
        missing, seen = set(np.argpartition(d, k)[:k].tolist()), 0.0
        for leaf in forest.leaves(sample[q]):
            seen += forest.weights[leaf]
            hit = missing.intersection(forest.members[leaf].tolist())
            need += [seen] * len(hit)
            missing -= hit
            if not missing:
                break
    need.sort()
    return float(1.1 * need[min(len(need) - 1, int(target * len(need)))])


def _stack(values: pd.Series, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=dtype).reshape(len(values), -1).astype(np.float64) if len(values) else np.zeros((0, 0))


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector (doubles): rows with an id and a vector that isn't null, zero, or holds null or non-finite components.

    Vectors of another length than most rows have take no part either.
    """
    v = F.col("vector")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    fine = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    lengths = fine.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    return fine.filter(F.size("vector") == (lengths[0]["d"] if lengths else 0))


def nearest(
    vectors: DataFrame, *, every: int = 100, k: int = 10, trees: int = TREES, sample_rows: int = SAMPLE_ROWS, target: float = TARGET, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by `every`, by Euclidean distance.

    Trees are fitted on a sample of at most sample_rows rows, spread by a hash of the id; every row is indexed. The search budget is
    the share of rows that reaches the target recall within the sample. Equal vectors are indexed by their k + 1 smallest ids, as
    others can't be among k nearest with ties to smaller ids. Candidates meet their queries leaf by leaf, in
    blocks of bounded size, and only rows at least as near as the k-th nearest sample row in the query's own leaves go on. A repeated id counts once, with the least of its vectors; an
    empty table gives no rows; other columns are ignored. See `usable` for the rows that take no part.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "<f8"  # floats travel as they are
    fine = usable(vectors, id_column, vector_column).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    same = Window.partitionBy("vector").orderBy("vec_id")
    index = fine.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") <= k + 1).drop("_n")
    queries = fine.filter(F.pmod("vec_id", F.lit(every)) == 0)

    total = fine.count()
    order = F.xxhash64("vec_id")
    share = 1.2 * sample_rows / max(1, total)
    some = index if share >= 1 else index.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    taken = some.orderBy(order, "vec_id").limit(sample_rows).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not taken:
        return spark.createDataFrame([], schema)
    sample, sample_ids = np.array([r["vector"] for r in taken], dtype=np.float64), np.array([r["vec_id"] for r in taken])
    leaf_rows = min(MAX_LEAF, max(MIN_LEAF, total // LEAVES))
    forest = fit(sample, max(8.0, leaf_rows * len(sample) / total), trees)
    forest.budget = calibrate(forest, sample, k, target)
    blocks = np.maximum(1, np.ceil(forest.weights * total / BLOCK_ROWS)).astype(np.int64)
    shared = spark.sparkContext.broadcast((forest, sample, sample_ids, blocks))  # bounded by sample_rows

    def place_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, _, _, blocks = shared.value
        for batch in batches:
            if not len(batch):
                continue
            ids, matrix = batch["vec_id"].to_numpy(), np.stack(batch["vector"].to_numpy())
            leaves, raw = forest.route(matrix), [v.tobytes() for v in matrix.astype(kind)]
            for t in range(leaves.shape[1]):
                yield pd.DataFrame({"leaf": leaves[:, t], "block": (ids * 2_654_435_761 >> 7) % blocks[leaves[:, t]], "vec_id": ids, "vector": raw})

    def place_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, sample, sample_ids, blocks = shared.value
        for batch in batches:
            for qid, vector in zip(batch["vec_id"], batch["vector"], strict=True):
                leaves = forest.search(vector)
                near = np.unique(np.concatenate([forest.members[x] for x in leaves]))
                near = near[sample_ids[near] != qid]
                d = np.sort(((sample[near] - vector) ** 2).sum(axis=1))
                bound = float(d[k - 1]) if len(d) >= k else float("inf")
                where = np.repeat(leaves, blocks[leaves])
                yield pd.DataFrame({"leaf": where, "block": np.concatenate([np.arange(blocks[x]) for x in leaves]), "query_id": qid, "bound": bound, "vector": vector.astype(kind).tobytes()})

    def rerank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        a, q = _stack(rows["vector"], kind), _stack(asked["vector"], kind)
        ids, qids, bound = rows["vec_id"].to_numpy(), asked["query_id"].to_numpy(), asked["bound"].to_numpy()
        qi, ai = [], []
        aa, qq = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", q, q)
        for s in range(0, len(q), 512):
            block = slice(s, s + 512)
            rough = aa[None, :] + qq[block, None] - 2 * (q[block] @ a.T)
            slack = 1e-9 * (aa.max() + qq[block, None])
            rough[qids[block, None] == ids[None, :]] = np.inf
            if len(ids) > k:  # the k nearest of this block, and all that rounding might have put behind them
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
                limit = np.minimum(kth, bound[block, None]) + slack
            else:
                limit = np.full((len(rough), 1), np.inf)
                limit = np.minimum(limit, bound[block, None] + slack)
            x, y = np.nonzero((rough <= limit) & np.isfinite(rough))
            qi.append(x + s)
            ai.append(y)
        qi, ai = np.concatenate(qi), np.concatenate(ai)
        return pd.DataFrame({"query_id": qids[qi], "vec_id": ids[ai], "score": np.sqrt(((q[qi] - a[ai]) ** 2).sum(axis=1))})

    placed = index.mapInPandas(place_rows, "leaf long, block long, vec_id long, vector binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = queries.repartition(parts, F.xxhash64("vec_id"))  # not by vec_id itself: rows already lie so, in as few tasks as their size asks for
    asked = spread.mapInPandas(place_queries, "leaf long, block long, query_id long, bound double, vector binary")
    found = placed.groupBy("leaf", "block").cogroup(asked.groupBy("leaf", "block")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
