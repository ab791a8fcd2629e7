"""The public calls: build, search, change, save and load, with DataFrames in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.config import IndexConfig, check_metric, check_nonnegative, check_positive, search_width
from nearfield.operators.labels import clamp_k
from nearfield.operators.quantize import chunks_for_budget
from nearfield.plans.index import Index
from nearfield.sources import files
from nearfield.streaming.dynamic import DynamicIndex


def _dim(points: DataFrame) -> int:
    first = points.filter("vec is not null").select("vec").first()
    if first is None:
        raise ValueError("no vectors")
    return len(first["vec"])


def build_memory_index(points: DataFrame, metric: str = "l2", *, path: str | None = None, dtype: str = "float", graph_degree: int = 64, complexity: int = 100, alpha: float = 1.2, filter_complexity: int = 0, universal_label: str | None = None, seed: int = 1, shard_rows: int = 5_000) -> Index:
    """Index points (id, vec[, tag][, labels]); save it if a path is given."""
    config = IndexConfig(
        _dim(points), check_metric(metric, dtype), dtype, graph_degree, complexity, alpha=alpha, filter_width=filter_complexity, universal_label=universal_label, seed=seed, shard_rows=shard_rows
    )
    index = Index.build(points, config)
    if path is not None:
        index.save(path)
    return index


def build_disk_index(points: DataFrame, metric: str, path: str, *, dtype: str = "float", graph_degree: int = 64, complexity: int = 100, code_bytes: float | None = None, optimised_rotation: bool = False, seed: int = 1, shard_rows: int = 5_000) -> Index:
    """An index with product-quantised codes of at most code_bytes in all (a quarter of the dimension for each row by default), saved."""
    dim, rows = _dim(points), points.count()
    config = IndexConfig(dim, check_metric(metric, dtype, "disk"), dtype, graph_degree, complexity, seed=seed, shard_rows=shard_rows)
    chunks = max(1, dim // 4) if code_bytes is None else chunks_for_budget(code_bytes, rows, dim)
    index = Index.build(points, config, chunks, optimised_rotation)
    index.save(path)
    return index


class StaticMemoryIndex:
    """A saved index for graph search."""

    def __init__(self, spark: SparkSession, path: str):
        self.index = Index.load(spark, path)

    def batch_search(self, queries: DataFrame, k_neighbors: int, complexity: int = 100) -> DataFrame:
        """qid, rank, id, distance for queries (qid, qvec[, qlabel])."""
        check_positive(k_neighbors=k_neighbors, complexity=complexity)
        return self.index.search(queries, k_neighbors, search_width(k_neighbors, complexity))

    def search(self, vector: list[float], k_neighbors: int, complexity: int = 100, filter_label: str | None = None) -> DataFrame:
        """rank, id, distance of one vector; with a label, k is at most the number of its points."""
        spark, k = self.index.spark, k_neighbors
        if filter_label is not None:
            k = clamp_k(self.index.points, filter_label, k, self.index.config.universal_label)
            if k == 0:
                raise ValueError(f"no point has label {filter_label!r}")
        query = spark.createDataFrame([(0, [float(x) for x in vector], filter_label)], "qid long, qvec array<double>, qlabel string")
        return self.batch_search(query if filter_label is not None else query.drop("qlabel"), k, max(k, complexity)).select("rank", "id", "distance")


class StaticDiskIndex(StaticMemoryIndex):
    """A saved index whose codes steer the walk, beam_width nodes a step, and whose true distances rank what it ends with."""

    def batch_search(self, queries: DataFrame, k_neighbors: int, complexity: int = 100, beam_width: int = 2) -> DataFrame:
        check_positive(k_neighbors=k_neighbors, complexity=complexity, beam_width=beam_width)
        return self.index.beam(queries, k_neighbors, search_width(k_neighbors, complexity), beam_width)


class DynamicMemoryIndex:
    """A changing index under a directory; ids are tags from 1 on."""

    def __init__(self, spark: SparkSession, path: str, metric: str, dimensions: int, max_vectors: int, *, dtype: str = "float", graph_degree: int = 64, complexity: int = 100, alpha: float = 1.2, shard_rows: int = 5_000):
        self._index = DynamicIndex(spark, path, IndexConfig(dimensions, check_metric(metric, dtype), dtype, graph_degree, complexity, alpha=alpha, max_vectors=max_vectors, shard_rows=shard_rows))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str) -> DynamicMemoryIndex:
        self = cls.__new__(cls)
        self._index = DynamicIndex.open(spark, path)
        return self

    def insert(self, vector: list[float], tag: int) -> int:
        """0, or -1 if the tag is live, 0 or the vector unfit."""
        check_nonnegative(tag=tag)
        row = self._index.spark.createDataFrame([(tag, [float(x) for x in vector])], "tag long, vec array<double>")
        return self.batch_insert(row).first()["status"]

    def batch_insert(self, rows: DataFrame) -> DataFrame:
        return self._index.insert(rows)

    def mark_deleted(self, tag: int) -> None:
        self._index.delete(self._index.spark.createDataFrame([(tag,)], "tag long"))

    def batch_mark_deleted(self, tags: DataFrame) -> DataFrame:
        return self._index.delete(tags)

    def consolidate_delete(self) -> DataFrame:
        return self._index.consolidate()

    def batch_search(self, queries: DataFrame, k_neighbors: int, complexity: int = 100) -> DataFrame:
        return self._index.search(queries, k_neighbors, search_width(k_neighbors, complexity))

    def search(self, vector: list[float], k_neighbors: int, complexity: int = 100) -> DataFrame:
        query = self._index.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, qvec array<double>")
        return self.batch_search(query, k_neighbors, complexity).select("rank", "tag", "distance")

    @property
    def status(self) -> DataFrame:
        return self._index.status()


vectors_from_file, vectors_to_file, tags_from_file, tags_to_file, vectors_metadata_from_file = files.read_matrix, files.write_matrix, files.read_tags, files.write_tags, files.header
