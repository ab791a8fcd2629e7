"""Building, saving, loading and searching an index: a directory of tables."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.config import IndexConfig, search_width
from nearfield.functions import vectors as V
from nearfield.operators import exact, graph, quantize, search
from nearfield.operators.clustering import centre_table, partition_for_budget
from nearfield.storage import materialise


def choose_kernel(base_rows: int, queries: int, k: int, labelled_share: float = 1.0, exact_pairs: int = 50_000_000) -> str:
    """exact if comparing all pairs is cheap or the label is rare, else graph."""
    return "exact" if base_rows * labelled_share * queries <= exact_pairs or base_rows * labelled_share <= 4 * k else "graph"


@dataclass
class Index:
    """An index as tables: shards (shard, id, vec, labels, nbrs, entry), points (id, tag, vec, labels), and the shards' centres."""

    config: IndexConfig
    points: DataFrame
    shards: DataFrame
    centres: np.ndarray
    codes: DataFrame | None = None
    book: quantize.Codebook | None = None

    @property
    def spark(self) -> SparkSession:
        return self.points.sparkSession

    # building ---------------------------------------------------------------------------------------------------------

    @classmethod
    def build(cls, points: DataFrame, config: IndexConfig, chunks: int | None = None, optimised: bool = False, on_codes: bool = False) -> Index:
        """points (id, vec[, tag][, labels]) to an index; with chunks, also product-quantised codes.

        on_codes links the graph by the distances of what the codes stand for; searches still use the true vectors. Products have no such build.
        Rows whose vector is null, of the wrong length or not finite are left out. As many shards are made as keep each within
        config.shard_rows; every row goes to its config.replicas nearest shards.
        """
        have = set(points.columns)
        rows = exact.checked(points, config.dim).select(
            F.col("id").cast("long").alias("id"), (F.col("tag").cast("long") if "tag" in have else F.col("id").cast("long") + 1).alias("tag"), F.col("vec").cast("array<double>").alias("vec"), *(["labels"] if "labels" in have else [])
        )
        rows = materialise(rows, "points")
        if on_codes and (chunks is None or config.metric == "mips"):
            raise ValueError("a build on codes needs chunks and another metric than mips")
        if config.max_vectors is not None and rows.count() > config.max_vectors:
            raise ValueError(f"more than {config.max_vectors} vectors")
        shaped = rows.withColumn("vec", V.normalise(F.col("vec"))) if config.metric == "cosine" else rows
        centres, dealt = partition_for_budget(shaped, config.shard_rows, config.replicas, config.seed)
        if dealt.schema["shard"].dataType.simpleString() != "int":
            dealt = dealt.withColumn("shard", F.col("shard").cast("int"))
        book = None
        if chunks is not None:
            book = quantize.train_codebook(rows, chunks, config.metric if config.metric != "cosine" else "l2", optimised, config.seed)
        if on_codes:
            coarse = quantize.decode_column(quantize.encode_column(F.col("vec"), book), book)
            linked = materialise(graph.build_shards(dealt.withColumn("vec", coarse), config), "linked")
            shards = materialise(linked.drop("vec").join(shaped.select("id", "vec"), "id").select(*linked.columns), "shards")
        else:
            shards = materialise(graph.build_shards(dealt, config), "shards")
        index = cls(config, rows, shards, centres)
        if book is not None:
            index.book = book
            index.codes = materialise(rows.select("id", quantize.encode_column(F.col("vec"), index.book).alias("codes")), "codes")
        return index

    # searching --------------------------------------------------------------------------------------------------------

    def prepared(self, queries: DataFrame) -> DataFrame:
        return queries.withColumn("qvec", V.normalise(F.col("qvec"))) if self.config.metric == "cosine" else queries

    def search(self, queries: DataFrame, k: int, width: int = 100, shards: int | None = 4) -> DataFrame:
        """qid, rank, id, distance by graph walks in the nearest `shards` shards or more (see ann_search; None: every shard)."""
        return search.ann_search(self.shards, self.centres, self.prepared(queries), k, search_width(k, width), self.config.metric, shards, self.config.universal_label)

    def search_tags(self, queries: DataFrame, k: int, width: int = 100, with_vectors: bool = False) -> DataFrame:
        """As search, with tag in place of id and, if asked for, the vector; hidden points (tag 0) aren't returned."""
        found = self.search(queries, width, width)
        rows = found.join(self.points.filter(F.col("tag") != 0).select("id", "tag", *(["vec"] if with_vectors else [])), "id")
        best = Window.partitionBy("qid").orderBy("distance" if self.config.metric != "mips" else F.desc("distance"), "id")
        return rows.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k).select("qid", "rank", "tag", "distance", *(["vec"] if with_vectors else []))

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        return exact.exact_knn(self.points, queries, k, self.config.metric, self.config.universal_label)

    def best(self, queries: DataFrame, k: int, width: int = 100) -> DataFrame:
        """Exact or by graph, whichever suits the sizes."""
        return self.exact(queries, k) if choose_kernel(self.points.count(), queries.count(), k) == "exact" else self.search(queries, k, width)

    def quantised(self, queries: DataFrame, k: int, width: int = 100, reorder: int | None = None) -> DataFrame:
        if self.codes is None or self.book is None:
            raise ValueError("the index has no codes; build it with chunks")
        return quantize.two_stage_search(self.points, self.codes, queries, k, search_width(k, width), self.book, self.config.metric, reorder)

    def beam(self, queries: DataFrame, k: int, width: int = 100, beam: int = 2, shards: int | None = 4, stats: bool = False) -> DataFrame:
        """As search, with walks that codes steer, `beam` nodes a step, and true distances that rank; with stats, hops (nodes read) and comparisons."""
        if self.codes is None or self.book is None:
            raise ValueError("the index has no codes; build it with chunks")
        coded = self.shards.join(self.codes.select("id", "codes"), "id")
        book = self.book
        if self.config.metric == "cosine":  # shards hold unit vectors, codes what the vectors were
            coded = coded.withColumn("codes", quantize.encode_column(F.col("vec"), book))
        return search.ann_search(coded, self.centres, self.prepared(queries), k, search_width(k, width), self.config.metric, shards, self.config.universal_label, stats=stats, book=book, beam=beam)

    def range(self, queries: DataFrame, radius: float, least: int = 16, most: int = 512) -> DataFrame:
        return search.ann_range_search(self.shards, self.centres, self.prepared(queries), radius, least, most, self.config.metric)

    def graph(self) -> DataFrame:
        """id, nbrs: the shards' graphs as one, within the degree."""
        return graph.merge_shards(self.shards, self.config.degree, self.config.seed)

    # storage ----------------------------------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Tables under one directory, rows sorted by id within files so that row groups prune; nothing is overwritten."""
        parts = max(1, min(200, -(-self.points.count() // 1_000_000)))
        self.points.repartitionByRange(parts, "id").sortWithinPartitions("id").write.parquet(f"{path}/points")
        self.shards.repartition("shard").sortWithinPartitions("shard", "id").write.parquet(f"{path}/shards")
        centre_table(self.spark, self.centres).coalesce(1).write.parquet(f"{path}/centres")
        meta = json.dumps({"config": asdict(self.config), "points": self.points.count(), "dim": self.config.dim, "metric": self.config.metric})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{path}/meta")
        if self.codes is not None and self.book is not None:
            self.codes.write.parquet(f"{path}/codes")
            b = self.book
            rows = [("pivots", b.pivots.ravel().tolist()), ("centroid", b.centroid.tolist()), ("bounds", b.bounds.astype(float).tolist())]
            rows += [("rotation", b.rotation.ravel().tolist())] if b.rotation is not None else []
            self.spark.createDataFrame(rows, "name string, numbers array<double>").coalesce(1).write.parquet(f"{path}/book")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        """A saved index; row counts and dimension are checked against its metadata."""
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        config = IndexConfig(**meta["config"])
        points, shards = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/shards")
        n = points.count()
        if n != meta["points"] or shards.select("id").distinct().count() != n:
            raise ValueError(f"{path}: tables disagree about the number of points ({n}, not {meta['points']})")
        centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("shard").collect()], dtype=np.float64)
        codes = book = None
        try:
            stored = {r["name"]: np.array(r["numbers"]) for r in spark.read.parquet(f"{path}/book").collect()}
        except Exception as e:  # an index without codes has no such table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            codes, d = spark.read.parquet(f"{path}/codes"), config.dim
            rotation = stored.get("rotation")
            book = quantize.Codebook(stored["pivots"].reshape(-1, d), stored["centroid"], stored["bounds"].astype(int), None if rotation is None else rotation.reshape(d, d))
        return cls(config, points, shards, centres, codes, book)


def respond(results: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, response: JSON with query_id, k, indices, distances, and tags and partition where results have them."""
    extra = [c for c in ("tag", "partition") if c in results.columns]
    row = F.struct("rank", "id", "distance", *extra)
    got = results.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("r"))
    every = queries.select("qid").distinct().join(got, "qid", "left").withColumn("r", F.coalesce("r", F.array().cast(got.schema["r"].dataType)))
    parts = [F.col("qid").alias("query_id"), F.size("r").alias("k"), F.col("r.id").alias("indices"), F.col("r.distance").alias("distances"), *[F.col(f"r.{c}").alias("tags" if c == "tag" else c) for c in extra]]
    return every.select("qid", F.to_json(F.struct(*parts)).alias("response"))


def requests(lines: DataFrame, default_width: int = 100) -> DataFrame:
    """qid, qvec, k, width, qlabel, error from JSON lines (value) with query, k, query_id, Ls and filter; k must lie between 1 and the width."""
    body = F.from_json("value", "query array<double>, k int, query_id long, Ls int, filter string")
    rows = lines.select(body.alias("b")).select(
        F.col("b.query_id").alias("qid"), F.col("b.query").alias("qvec"), F.col("b.k").alias("k"), F.coalesce("b.Ls", F.lit(default_width)).alias("width"), F.col("b.filter").alias("qlabel")
    )
    problem = F.when(F.col("qvec").isNull(), "no query").when(F.col("k").isNull() | (F.col("k") < 1), "k must be above 0").when(F.col("k") > F.col("width"), "k exceeds Ls")
    return rows.withColumn("error", problem)

