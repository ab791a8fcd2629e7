"""Cutting lineage through tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a folder of our own only where that is unset (tests, local mode)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='nearfield-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; its file system removes it when the application ends."""
    path = f"{shared_dir(spark)}/nearfield-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        system.mkdirs(where)
        system.deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Lost executors then cost a reread instead of a recomputation, and every later use sees the same rows.
    An empty df keeps its schema. The tables go when the application ends, or before, by `discard`.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._nf_path = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Delete materialised tables that no later plan reads. Other data frames are left alone."""
    for df in tables:
        path = getattr(df, "_nf_path", None)
        if path is not None:
            jvm, spark = df.sparkSession.sparkContext._jvm, df.sparkSession
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, through Spark's reader alone, so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def global_rank(df: DataFrame, order: list, name: str = "_rank") -> DataFrame:
    """df with a gapless number from 0 for each row in the given order; equal rows get any of their numbers.

    Rows are dealt by range and sorted in their partitions, the result is written once, and only a row count for each partition
    goes to the driver. Add a unique column to the order, so that rows of one hot key spread over partitions.
    """
    from pyspark.sql import functions as F

    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_nf_m", F.monotonically_increasing_id())
    placed = ordered.withColumns({"_nf_p": F.shiftright("_nf_m", 33), "_nf_i": F.col("_nf_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_nf_m")
    placed = materialise(placed, "ranked")
    total, starts = 0, []
    for p, n in sorted((r[0], r[1]) for r in placed.groupBy("_nf_p").agg(F.count("*")).collect()):
        starts.append((p, total))
        total += n
    first = spark.createDataFrame(starts, "_nf_p long, _nf_first long")
    return placed.join(F.broadcast(first), "_nf_p").withColumn(name, F.col("_nf_first") + F.col("_nf_i")).drop("_nf_p", "_nf_i", "_nf_first")


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where it lies, whatever their working folder.

    On a cluster, ship it as any other dependency (--py-files).
    """
    from pathlib import Path

    root, env = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
