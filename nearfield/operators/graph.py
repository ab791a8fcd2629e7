"""Proximity graphs: pruning and building within a shard, and merging, stitching and repairing graphs as edge tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.config import IndexConfig
from nearfield.functions import distance as D

# Fixed value: the factor between one round of pruning and the next, stricter one.
STEP = 1.2


def levels(alpha: float) -> list[float]:
    """Factors of the rounds: 1, and what STEP makes of it up to alpha."""
    out = [1.0]
    while out[-1] * STEP <= alpha + 1e-9:
        out.append(out[-1] * STEP)
    return out


def covered(metric: str, level: float, far: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Which candidates a chosen neighbour stands in for: those that are nearer to it than to the point by more than the factor.

    far are their distances to the point, between those to the neighbour. Products (negated in both) are compared as likenesses.
    """
    return between < level * far if metric == "mips" else level * between < far


def alike(vectors: np.ndarray, labels: Sequence[frozenset] | None = None) -> np.ndarray:
    """A number for each row, the same for copies: rows with equal vectors and equal labels. Distances tell them only to rounding."""
    known: dict[tuple, int] = {}
    return np.array([known.setdefault((v.tobytes(), None if labels is None else labels[i]), len(known)) for i, v in enumerate(vectors + 0.0)], dtype=np.int64)


def link_copies(nbrs: list[np.ndarray], vectors: np.ndarray, degree: int, labels: Sequence[frozenset] | None = None) -> None:
    """Links the copies of each row (see alike) in a ring, so that a walk that meets one meets them all.

    The link to the next copy takes the place of a link to another one, else a free place, else that of the farthest neighbour.
    """
    kind = alike(vectors, labels)
    for rows in np.split(np.argsort(kind, kind="stable"), np.cumsum(np.bincount(kind))[:-1]) if len(kind) else []:
        for i, after in zip(rows, np.roll(rows, -1), strict=True) if len(rows) > 1 else ():
            own = nbrs[i]
            if after in own:
                continue
            copy = np.flatnonzero(kind[own] == kind[i])
            if not len(copy) and len(own) >= degree:
                copy = D.matrix("l2", vectors[own], vectors[i][None, :])[0].argmax(keepdims=True)
            nbrs[i] = np.unique(np.append(np.delete(own, copy[:1]), after))


def prune(ids: np.ndarray, d: np.ndarray, vectors: np.ndarray, degree: int, alpha: float, metric: str = "l2", pool: int = 750, labels: Sequence[frozenset] | None = None, saturate: bool = False, copies: bool = False) -> list[int]:
    """At most `degree` diverse neighbours among candidates (row numbers ids, their distances d to the point).

    In each round of `levels`, the nearest candidate that no neighbour covers becomes one, until none or no place is left; later rounds let
    candidates in again that the earlier factor shut out. With labels, a neighbour covers only those whose labels it all has. A neighbour also covers
    copies of itself (see alike; not with products), so that copies of the point don't take all places; copies turns that off, for graphs whose
    copies aren't linked otherwise (see link_copies). saturate fills free places with the nearest left out.
    """
    order = np.lexsort((ids, d))[:pool]
    ids, d = ids[order], d[order]
    rows = vectors[ids]
    between = D.matrix(metric, rows, rows) if len(ids) else np.zeros((0, 0))
    within = None if labels is None else [frozenset(labels[i]) for i in ids]
    kind = np.arange(len(ids))
    if not copies and metric != "mips" and len(ids) and np.triu(between <= D.rounding(metric, rows, rows), 1).any():
        kind = alike(rows, within)
    chosen: list[int] = []

    def shut(c: int, level: float) -> np.ndarray:
        out = covered(metric, level, d, between[c]) | (kind == kind[c])
        return out if within is None else out & np.fromiter((h <= within[c] for h in within), dtype=bool, count=len(within))

    for level in levels(alpha):
        free = np.ones(len(ids), dtype=bool)
        free[chosen] = False
        for c in chosen:
            free &= ~shut(c, level)
        while len(chosen) < degree and free.any():
            c = int(free.argmax())
            chosen.append(c)
            free[c] = False
            free &= ~shut(c, level)
    if saturate and alpha > 1:
        rest = np.setdiff1d(np.arange(len(ids)), chosen)
        chosen += rest[: degree - len(chosen)].tolist()
    return [int(ids[c]) for c in chosen]


def build(vectors: np.ndarray, config: IndexConfig, labels: Sequence[frozenset] | None = None) -> list[np.ndarray]:
    """Out-neighbours of every row of one shard.

    Candidates are a row's nearest by exact distances, the nearest that share one of its labels, and a few rows at random that keep distant parts
    connected; pruning, reverse edges and a second pruning of overfull nodes follow.
    """
    n = len(vectors)
    metric = "l2" if config.metric == "fast_l2" else config.metric
    x = np.asarray(vectors, dtype=np.float64)
    rng = np.random.default_rng(config.seed)
    wide = min(n - 1, max(config.build_width, 2 * config.degree))
    out: list[list[int]] = []
    universal = config.universal_label

    by_label: dict[str, np.ndarray] = {}
    if labels is not None:
        for label in set().union(*labels) if labels else ():
            by_label[label] = np.flatnonzero([label in h or universal in h or label == universal for h in labels])
    for s in range(0, n, 512):
        block = D.matrix(metric, x, x[s : s + 512])
        for r, row in enumerate(block):
            i = s + r
            row[i] = np.inf
            near = np.argpartition(row, wide - 1)[:wide] if 0 < wide < n else np.arange(n)
            pools = [near, rng.integers(0, n, 16)]
            if labels is not None:
                for label in labels[i]:
                    own = by_label[label]
                    pools.append(own[np.argsort(row[own], kind="stable")[: config.label_width]])
            ids = np.unique(np.concatenate(pools))
            ids = ids[ids != i]
            out.append(prune(ids, row[ids], x, config.degree, config.alpha, metric, config.pool, labels, config.saturate))
    incoming: list[list[int]] = [[] for _ in range(n)]
    for i, nbrs in enumerate(out):
        for j in nbrs:
            incoming[j].append(i)
    most = int(config.slack * config.degree)
    done = []
    for i in range(n):
        ids = np.unique(np.array(out[i] + incoming[i], dtype=np.int64))
        if len(ids) > most:
            ids = np.array(prune(ids, D.matrix(metric, x[ids], x[i][None, :])[0], x, config.degree, config.alpha, metric, config.pool, labels, config.saturate), dtype=np.int64)
        done.append(ids)
    for i in range(n):  # no node keeps more than its degree
        if len(done[i]) > config.degree:
            ids = done[i]
            done[i] = np.array(prune(ids, D.matrix(metric, x[ids], x[i][None, :])[0], x, config.degree, config.alpha, metric, config.pool, labels, config.saturate), dtype=np.int64)
    if metric != "mips":
        link_copies(done, x, config.degree, labels)
    return done


def entry_row(vectors: np.ndarray) -> int:
    """The row nearest to the mean."""
    return int(D.matrix("l2", vectors, vectors.mean(axis=0)[None, :])[0].argmin())


def build_shards(points: DataFrame, config: IndexConfig) -> DataFrame:
    """shard, id, vec, labels, nbrs, entry: a graph for each shard of points (shard, id, vec[, labels]); shards are bounded by the caller."""
    labelled = "labels" in points.columns
    rows = points.select("shard", "id", F.col("vec").cast("array<double>").alias("vec"), (F.coalesce("labels", F.array().cast("array<string>")) if labelled else F.array().cast("array<string>")).alias("labels"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").drop_duplicates("id").reset_index(drop=True)
        x = np.stack(group["vec"].to_numpy()).astype(np.float64)
        labels = [frozenset(h) for h in group["labels"]] if labelled else None
        ids = group["id"].to_numpy()
        nbrs = build(x, config, labels)
        entry = np.zeros(len(ids), dtype=bool)
        entry[entry_row(x)] = True
        return group.assign(nbrs=[ids[n].tolist() for n in nbrs], entry=entry)

    return rows.groupBy("shard").applyInPandas(one, "shard int, id long, vec array<double>, labels array<string>, nbrs array<long>, entry boolean")


def edges_of(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("id").alias("src"), F.explode("nbrs").alias("dst"))


def graph_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, nbrs: distinct neighbours, sorted; nodes without edges have an empty array."""
    some = edges.filter(F.col("src") != F.col("dst")).groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("dst")).alias("nbrs"))
    if nodes is None:
        return some
    return nodes.select("id").distinct().join(some, "id", "left").select("id", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))


def stitch(graphs: Sequence[DataFrame], nodes: DataFrame | None = None) -> DataFrame:
    """One graph with every edge of the given ones, at most once for each ordered pair."""
    every = edges_of(graphs[0])
    for g in graphs[1:]:
        every = every.unionByName(edges_of(g))
    return graph_of(every.distinct(), nodes)


def merge_shards(shards: DataFrame, degree: int, seed: int = 0) -> DataFrame:
    """id, nbrs: the shards' graphs as one; a node with more than `degree` distinct neighbours keeps those first in a seeded hash order."""
    edges = edges_of(shards).distinct()
    w = Window.partitionBy("src").orderBy(F.xxhash64("src", "dst", F.lit(seed)), "dst")
    kept = edges.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= degree).drop("_n")
    return graph_of(kept, shards)


def prune_all(graph: DataFrame, points: DataFrame, degree: int, alpha: float = 1.2, metric: str = "l2", pool: int = 750, labels: bool = False, saturate: bool = False) -> DataFrame:
    """id, nbrs: every node's neighbours pruned to `degree` with true distances; one group is a node and its neighbours."""
    p = points.select("id", F.col("vec").cast("array<double>").alias("vec"), (F.coalesce("labels", F.array().cast("array<string>")) if labels else F.array().cast("array<string>")).alias("labels"))
    own = p.select(F.col("id").alias("src"), F.col("id").alias("dst"), "vec", "labels")
    far = edges_of(graph).join(p.withColumnRenamed("id", "dst"), "dst").select("src", "dst", "vec", "labels")
    rows = graph.select(F.col("id").alias("src")).join(own, "src").select("src", "dst", "vec", "labels").unionByName(far)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        src = int(group["src"].iloc[0])
        group = group.drop_duplicates("dst").sort_values("dst")
        ids, x = group["dst"].to_numpy(), np.stack(group["vec"].to_numpy()).astype(np.float64)
        me = int(np.flatnonzero(ids == src)[0])
        others = np.flatnonzero(ids != src)
        d = D.matrix(metric, x[others], x[me][None, :])[0] if len(others) else np.zeros(0)
        names = [frozenset(h) for h in group["labels"]] if labels else None
        kept = prune(others, d, x, degree, alpha, metric, pool, names, saturate, copies=True) if len(others) else []
        return pd.DataFrame({"id": [src], "nbrs": [sorted(int(ids[i]) for i in kept)]})

    return rows.groupBy("src").applyInPandas(one, "id long, nbrs array<long>")


def build_per_label(points: DataFrame, config: IndexConfig, stitched_degree: int) -> DataFrame:
    """One graph for each label, stitched and pruned: id, nbrs. A label with more points than a shard holds is built in parts.

    The universal label's points belong to every label.
    """
    from nearfield.operators.labels import expand_universal

    p = expand_universal(points, config.universal_label) if config.universal_label is not None else points
    rows = p.select("id", "vec", F.explode("labels").alias("label"))
    sizes = rows.groupBy("label").agg(F.ceil(F.count("*") / config.shard_rows).alias("parts"))
    dealt = rows.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    numbered = dealt.select("label", "part", "id", F.col("vec").cast("array<double>").alias("vec"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").drop_duplicates("id").reset_index(drop=True)
        ids = group["id"].to_numpy()
        nbrs = build(np.stack(group["vec"].to_numpy()), config)
        return pd.DataFrame({"id": ids, "nbrs": [ids[n].tolist() for n in nbrs]})

    graphs = numbered.groupBy("label", "part").applyInPandas(one, "id long, nbrs array<long>")
    return prune_all(stitch([graphs], points), points, stitched_degree, 1.2, "l2", 750)


def repair(graph: DataFrame, points: DataFrame, deleted: DataFrame, config: IndexConfig) -> DataFrame:
    """The graph without deleted ids (id): nodes that pointed at one get its neighbours as candidates instead, and are pruned if
    they then have too many."""
    edges = edges_of(graph)
    gone = deleted.select(F.col("id").alias("dst")).distinct()
    live = edges.join(gone.withColumnRenamed("dst", "src"), "src", "left_anti")
    bad = live.join(gone, "dst", "left_semi")
    through = bad.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")), "dst").select("src", F.col("next").alias("dst"))
    fresh = live.unionByName(through).join(gone, "dst", "left_anti").filter(F.col("src") != F.col("dst")).distinct()
    nodes = graph.select("id").join(gone.withColumnRenamed("dst", "id"), "id", "left_anti")
    repaired = graph_of(fresh, nodes)
    touched = bad.select(F.col("src").alias("id")).distinct()
    over = repaired.filter(F.size("nbrs") > config.degree).join(touched, "id", "left_semi")
    pruned = prune_all(over, points, config.degree, config.alpha, "l2" if config.metric == "fast_l2" else config.metric, config.pool)
    return repaired.join(over.select("id"), "id", "left_anti").unionByName(pruned)


def repair_shards(shards: DataFrame, deleted: DataFrame, config: IndexConfig) -> DataFrame:
    """A table of shards (see build_shards) without the deleted ids (id).

    Only shards that hold one are worked on, each by one task: a node that pointed at deleted rows takes over their neighbours, and is pruned if it
    then has too many; copies are linked anew; a shard whose entry went gets a new one.
    """
    metric = "l2" if config.metric == "fast_l2" else config.metric
    marked = shards.join(deleted.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left").withColumn("_gone", F.coalesce("_gone", F.lit(False)))
    hit = marked.filter("_gone").select("shard").distinct()

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id").reset_index(drop=True)
        ids, gone = group["id"].to_numpy(), group["_gone"].to_numpy(dtype=bool)
        if gone.all():
            return group[~gone][["shard", "id", "vec", "labels", "nbrs", "entry"]]
        x, near = np.stack(group["vec"].to_numpy()).astype(np.float64), adjacency(ids, group["nbrs"])
        names = [frozenset(h) for h in group["labels"]] if any(len(h) for h in group["labels"]) else None
        out = []
        for i in np.flatnonzero(~gone):
            own = near[i][near[i] >= 0]
            lost = own[gone[own]]
            if len(lost):
                through = near[lost].ravel()
                own = np.unique(np.concatenate([own, through[through >= 0]]))
                own = own[~gone[own] & (own != i)]
                if len(own) > config.degree:
                    own = np.array(prune(own, D.matrix(metric, x[own], x[i][None, :])[0], x, config.degree, config.alpha, metric, config.pool, names, config.saturate), dtype=np.int64)
            out.append(own)
        if metric != "mips":
            place, live = np.cumsum(~gone) - 1, np.flatnonzero(~gone)
            near = [place[own] for own in out]
            link_copies(near, x[live], config.degree, None if names is None else [names[i] for i in live])
            out = [live[own] for own in near]
        kept = group[~gone].assign(nbrs=[ids[own].tolist() for own in out])
        if len(kept) and not kept["entry"].any():
            kept["entry"] = np.arange(len(kept)) == entry_row(x[~gone])
        return kept[["shard", "id", "vec", "labels", "nbrs", "entry"]]

    fixed = marked.join(hit, "shard", "left_semi").groupBy("shard").applyInPandas(one, "shard int, id long, vec array<double>, labels array<string>, nbrs array<long>, entry boolean")
    return marked.join(hit, "shard", "left_anti").select(*fixed.columns).unionByName(fixed)


def adjacency(ids: np.ndarray, nbrs: Iterator) -> np.ndarray:
    """Neighbours as row numbers, padded with -1; neighbours outside ids are dropped. ids must be sorted."""
    lists = []
    for n in nbrs:
        n = np.asarray(n, dtype=np.int64)
        at = np.searchsorted(ids, n)
        at = at[(at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == n)] if len(n) else n
        lists.append(at)
    out = np.full((len(lists), max([1, *(len(x) for x in lists)])), -1, dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out
