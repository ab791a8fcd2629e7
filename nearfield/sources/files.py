"""Vector files: readers that split by rows, and writers.

Layouts, little-endian throughout: a matrix file is int32 rows, int32 columns, then the elements row by row; fvecs, bvecs and ivecs files
repeat int32 columns before each row; a truth file is a matrix of uint32 ids that a matrix of float distances may follow; a range truth file is
int32 queries, int32 total, the counts, then the ids. Files are opened through pyarrow's file systems on the executors, each task its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.labels import parse_labels

ELEMENTS = {"float": "<f4", "int8": "i1", "uint8": "u1", "int32": "<i4", "uint32": "<u4", "int64": "<i8", "uint64": "<u8"}
COLUMN = {"float": "array<float>", "int8": "array<tinyint>", "uint8": "array<smallint>", "int32": "array<int>", "uint32": "array<long>", "int64": "array<long>", "uint64": "array<decimal(20,0)>"}
#: Rows that one task reads.
ROWS = 100_000


def _open(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system, inner


def _bytes(path: str, offset: int, length: int) -> bytes:
    system, inner = _open(path)
    with system.open_input_file(inner) as f:
        f.seek(offset)
        data = f.read(length)
    if len(data) != length:
        raise ValueError(f"{path}: {len(data)} bytes at {offset}, not {length}")
    return data


def file_size(path: str) -> int:
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if not info.is_file:
        raise FileNotFoundError(path)
    return info.size


def header(path: str) -> tuple[int, int]:
    """Rows and columns of a matrix file."""
    n, d = np.frombuffer(_bytes(path, 0, 8), dtype="<i4")
    return int(n), int(d)


def _check(dtype: str) -> np.dtype:
    if dtype not in ELEMENTS:
        raise TypeError(f"elements are {', '.join(ELEMENTS)}, not {dtype!r}")
    return np.dtype(ELEMENTS[dtype])


def _ranges(spark: SparkSession, n: int, step: int = ROWS) -> DataFrame:
    parts = max(1, -(-n // step))
    return spark.range(0, parts, 1, parts).select((F.col("id") * step).alias("start"), F.least((F.col("id") + 1) * step, F.lit(n)).alias("end"))


def read_matrix(spark: SparkSession, path: str, dtype: str = "float", offset: int = 0, count: int | None = None, at: int = 0) -> DataFrame:
    """id, vec of a matrix file, or of `count` rows from `offset` on; `at` is where in the file the matrix begins. A wrong file size raises."""
    kind = _check(dtype)
    n, d = (int(x) for x in np.frombuffer(_bytes(path, at, 8), dtype="<i4"))
    if at == 0 and file_size(path) != 8 + n * d * kind.itemsize:
        raise ValueError(f"{path}: {file_size(path)} bytes for {n} x {d} of {dtype}")
    last = n if count is None else min(n, offset + count)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in zip(batch["start"], batch["end"], strict=True):
                if end > start:
                    data = np.frombuffer(_bytes(path, at + 8 + start * d * kind.itemsize, (end - start) * d * kind.itemsize), dtype=kind).reshape(-1, d)
                    yield pd.DataFrame({"id": np.arange(start, end), "vec": list(data.astype(np.float64 if dtype == "float" else object if dtype == "uint64" else np.int64))})

    inner = "array<double>" if dtype == "float" else "array<string>" if dtype == "uint64" else "array<long>"
    if dtype == "uint64":
        plain = rows

        def rows(batches):  # the type is wider than Spark's integers
            for pdf in plain(batches):
                pdf["vec"] = [[str(x) for x in v] for v in pdf["vec"]]
                yield pdf

    parts = _ranges(spark, max(0, last - offset)).select((F.col("start") + offset).alias("start"), (F.col("end") + offset).alias("end"))
    return parts.mapInPandas(rows, f"id long, vec {inner}").select("id", F.col("vec").cast(COLUMN[dtype]).alias("vec"))


def read_vecs(spark: SparkSession, path: str, dtype: str = "float") -> DataFrame:
    """id, vec of an fvecs (float), bvecs (uint8) or ivecs (int32) file."""
    kind = _check(dtype)
    d = int(np.frombuffer(_bytes(path, 0, 4), dtype="<i4")[0])
    width = 4 + d * kind.itemsize
    size = file_size(path)
    if size % width:
        raise ValueError(f"{path}: {size} bytes aren't rows of {width}")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in zip(batch["start"], batch["end"], strict=True):
                raw = np.frombuffer(_bytes(path, start * width, (end - start) * width), dtype=np.uint8).reshape(-1, width)
                if len(raw) and (np.ascontiguousarray(raw[:, :4]).view("<i4") != d).any():
                    raise ValueError(f"{path}: rows of other lengths than {d}")
                yield pd.DataFrame({"id": np.arange(start, end), "vec": list(np.ascontiguousarray(raw[:, 4:]).view(kind).astype(np.float64 if dtype == "float" else np.int64))})

    inner = "array<double>" if dtype == "float" else "array<long>"
    return _ranges(spark, size // width).mapInPandas(rows, f"id long, vec {inner}").select("id", F.col("vec").cast(COLUMN[dtype]).alias("vec"))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """id, vec of lines of tab-separated numbers."""
    lines = read_lines(spark, path)
    return lines.select("id", F.split(F.rtrim("value"), "\t").cast("array<float>").alias("vec"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """id, value: lines with their number from 0. Splits of the file are read in parallel and numbered by their offsets."""
    from nearfield.storage import global_rank

    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m"))
    return global_rank(lines, ["_b", "_m"], "id").select("id", "value")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, labels: line i holds the labels of point i, separated by commas; sorted."""
    return read_lines(spark, path).select("id", F.sort_array(parse_labels(F.col("value"))).alias("labels"))


def read_label_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="label string, label_id int")


def read_query_labels(spark: SparkSession, path: str, unique: bool = False) -> DataFrame:
    """qid, qlabel: one label a line, up to the first empty line; a comma raises when the plan runs."""
    lines = read_lines(spark, path)
    stop = lines.filter(F.trim("value") == "").agg(F.min("id").alias("stop"))
    kept = lines.withColumn("_k", F.lit(1)).join(stop.withColumn("_k", F.lit(1)), "_k").filter(F.col("stop").isNull() | (F.col("id") < F.col("stop")))
    one = F.when(F.col("value").contains(","), F.raise_error(F.lit("one label a line")).cast("string")).otherwise(F.trim("value"))
    out = kept.select(F.col("id").alias("qid"), one.alias("qlabel"))
    return out.groupBy("qlabel").agg(F.min("qid").alias("qid")).select("qid", "qlabel") if unique else out


def read_tags(spark: SparkSession, path: str, points: int | None = None, dtype: str = "uint32") -> DataFrame:
    """id, tag; tag 0 is hidden. With points, another number of tags raises."""
    n, d = header(path)
    if d != 1 or (points is not None and n != points):
        raise ValueError(f"{path}: {n} x {d} tags for {points} points")
    return read_matrix(spark, path, dtype).select("id", F.col("vec")[0].cast("long").alias("tag"))


def read_deleted(spark: SparkSession, path: str) -> DataFrame:
    return read_matrix(spark, path, "uint32").select(F.explode("vec").alias("id"))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, rank, id, distance; distance is null where the file, by its size, holds ids only."""
    n, k = header(path)
    ids_only, both = 8 + 4 * n * k, 8 + 8 * n * k
    size = file_size(path)
    if size not in (ids_only, both):
        raise ValueError(f"{path}: {size} bytes for {n} x {k} results")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in zip(batch["start"], batch["end"], strict=True):
                m = end - start
                ids = np.frombuffer(_bytes(path, 8 + 4 * start * k, 4 * m * k), dtype="<u4").astype(np.int64)
                d = np.frombuffer(_bytes(path, 8 + 4 * n * k + 4 * start * k, 4 * m * k), dtype="<f4").astype(np.float64) if size == both else np.full(m * k, np.nan)
                yield pd.DataFrame({"qid": np.repeat(np.arange(start, end), k), "rank": np.tile(np.arange(1, k + 1), m), "id": ids, "distance": d})

    out = _ranges(spark, n).mapInPandas(rows, "qid long, rank int, id long, distance double")
    return out if size == both and k else out.withColumn("distance", F.lit(None).cast("double"))


def read_range_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, id of a range truth file; queries without results have no rows."""
    n, total = header(path)
    counts = np.frombuffer(_bytes(path, 8, 4 * n), dtype="<u4").astype(np.int64)
    if counts.sum() != total or file_size(path) != 8 + 4 * n + 4 * total:
        raise ValueError(f"{path}: counts add up to {counts.sum()}, not {total}")
    ends = np.cumsum(counts)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, end in zip(batch["start"], batch["end"], strict=True):
                ids = np.frombuffer(_bytes(path, 8 + 4 * n + 4 * start, 4 * (end - start)), dtype="<u4").astype(np.int64)
                yield pd.DataFrame({"qid": np.searchsorted(ends, np.arange(start, end), side="right"), "id": ids})

    return _ranges(spark, total).mapInPandas(rows, "qid long, id long")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """id, nbrs of a graph file: uint64 size, uint32 degree, uint32 start, uint64 frozen points, then a count and that many ids for each node.

    Nodes have no fixed width, so one task reads the file.
    """
    size = file_size(path)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _ in range(len(batch)):
                if int(np.frombuffer(_bytes(path, 0, 8), dtype="<u8")[0]) != size:
                    raise ValueError(f"{path}: its header gives another size than {size}")
                data, at, node = np.frombuffer(_bytes(path, 24, size - 24), dtype="<u4"), 0, 0
                while at < len(data):
                    k = int(data[at])
                    yield pd.DataFrame({"id": [node], "nbrs": [data[at + 1 : at + 1 + k].astype(np.int64).tolist()]})
                    at, node = at + 1 + k, node + 1

    return spark.range(1).mapInPandas(rows, "id long, nbrs array<long>")


# writers: a file of one piece in a foreign format is written by the driver, batch after batch, in the order of ids ------


def _batches(df: DataFrame, order: list[str]) -> Iterator[list]:
    rows, block = df.orderBy(*order).toLocalIterator(prefetchPartitions=True), []
    for r in rows:
        block.append(r)
        if len(block) == 10_000:
            yield block
            block = []
    if block:
        yield block


def write_matrix(points: DataFrame, path: str, dtype: str = "float", column: str = "vec") -> tuple[int, int]:
    kind = _check(dtype)
    n = points.count()
    first = points.select(F.size(column)).first()
    d = int(first[0]) if first else 0
    system, inner = _open(path)
    with system.open_output_stream(inner) as f:
        f.write(np.array([n, d], dtype="<i4").tobytes())
        for block in _batches(points.select("id", column), ["id"]):
            f.write(np.array([r[column] for r in block], dtype=kind).tobytes())
    return n, d


def write_vecs(points: DataFrame, path: str, dtype: str = "float") -> None:
    kind = _check(dtype)
    system, inner = _open(path)
    with system.open_output_stream(inner) as f:
        for block in _batches(points.select("id", "vec"), ["id"]):
            for r in block:
                f.write(np.array([len(r["vec"])], dtype="<i4").tobytes() + np.array(r["vec"], dtype=kind).tobytes())


def write_tsv(points: DataFrame, path: str) -> None:
    """A directory of text files in the order of ids."""
    points.repartitionByRange("id").sortWithinPartitions("id").select(F.array_join(F.col("vec").cast("array<string>"), "\t").alias("value")).write.text(path)


def write_truth(results: DataFrame, path: str, k: int, distances: bool = True) -> None:
    """Results (qid from 0, rank, id, distance) as a truth file; a query with fewer than k raises."""
    per_query = results.filter(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "distance"))).alias("r"))
    n = per_query.count()
    if per_query.filter(F.size("r") != k).limit(1).count():
        raise ValueError(f"some queries have fewer than {k} results")
    system, inner = _open(path)
    with system.open_output_stream(inner) as f:
        f.write(np.array([n, k], dtype="<i4").tobytes())
        for name, kind in (("id", "<u4"), ("distance", "<f4"))[: 2 if distances else 1]:
            for block in _batches(per_query.select("qid", F.col(f"r.{name}").alias("v")), ["qid"]):
                f.write(np.array([r["v"] for r in block], dtype=kind).tobytes())


def write_tags(points: DataFrame, path: str, dtype: str = "uint32") -> None:
    write_matrix(points.select("id", F.array("tag").alias("vec")), path, dtype)


def write_graph(graph: DataFrame, path: str, start: int = 0, frozen: int = 0) -> None:
    """id, nbrs as a graph file (see read_graph); ids must be 0, 1, 2, ... without gaps."""
    sums = graph.agg(F.count("*"), F.coalesce(F.sum(F.size("nbrs")), F.lit(0)), F.coalesce(F.max(F.size("nbrs")), F.lit(0)), F.max("id")).first()
    n, edges, degree, last = (int(x) if x is not None else -1 for x in sums)
    if last != n - 1 or graph.select("id").distinct().count() != n:
        raise ValueError("ids must be 0, 1, 2, ... without gaps")
    system, inner = _open(path)
    with system.open_output_stream(inner) as f:
        f.write(np.array([24 + 4 * (n + edges)], dtype="<u8").tobytes() + np.array([degree, start], dtype="<u4").tobytes() + np.array([frozen], dtype="<u8").tobytes())
        for block in _batches(graph.select("id", "nbrs"), ["id"]):
            f.write(b"".join(np.array([len(r["nbrs"]), *r["nbrs"]], dtype="<u4").tobytes() for r in block))


def write_labels(points: DataFrame, path: str) -> None:
    points.repartitionByRange("id").sortWithinPartitions("id").select(F.array_join("labels", ",").alias("value")).write.text(path)


def write_by_label(points: DataFrame, path: str) -> None:
    """One Parquet partition for each label; ids are columns, so no map back is needed."""
    points.select("*", F.explode("labels").alias("label")).write.partitionBy("label").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results of several list widths (L) side by side."""
    results.write.partitionBy("L").parquet(path)


def from_numpy(spark: SparkSession, vectors: np.ndarray, tags: np.ndarray | None = None) -> DataFrame:
    """id, vec[, tag] of arrays in the driver's memory."""
    x = np.asarray(vectors)
    if x.ndim != 2:
        raise ValueError(f"vectors must have two dimensions, not {x.ndim}")
    kind = {"f": "array<float>", "i": "array<tinyint>", "u": "array<smallint>"}.get(x.dtype.kind)
    if kind is None:
        raise TypeError(f"vectors of {x.dtype} can't be read")
    if tags is not None and len(tags) != len(x):
        raise ValueError(f"{len(tags)} tags for {len(x)} vectors")
    pdf = pd.DataFrame({"id": np.arange(len(x)), "vec": [v.tolist() for v in x]})
    schema = f"id long, vec {kind}"
    if tags is not None:
        pdf["tag"], schema = np.asarray(tags, dtype=np.int64), f"{schema}, tag long"
    return spark.createDataFrame(pdf, schema)
