"""Mutations: inserts, lazy deletes, consolidation and count-based windows, as versioned tables.

A version is a small JSON manifest that names its tables. Writers add tables and then a manifest; readers take the newest manifest, so
they never see half a change, and a retried batch finds its number and does nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict
from datetime import UTC, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.config import IndexConfig
from nearfield.operators import exact, graph
from nearfield.operators.clustering import kmeans, nearest_centres
from nearfield.operators.exact import checked
from nearfield.plans.index import Index
from nearfield.storage import materialise

SCHEMA = "tag long, vec array<double>, labels array<string>, seq long"
#: Consolidation builds the index anew once this share of the live points came after it; else it repairs the shards that lost points.
REBUILD_SHARE = 0.2


class Conflict(RuntimeError):
    """Another writer has written the version that this one was about to write."""


class DynamicIndex:
    """Points by tag, under one directory: appended rows, tombstones, and an index over those that were there at the last
    consolidation. Rows since then are searched exactly, deleted ones never returned."""

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config
        self._state = {"version": 0, "rows": [], "deleted": [], "index": None, "indexed": 0, "next": 0, "batch": -1}

    # manifests --------------------------------------------------------------------------------------------------------

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> DynamicIndex:
        """The newest version of a directory."""
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests")
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        versions = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
        if not versions:
            raise ValueError(f"{path} holds no version")
        newest = json.loads(spark.read.text(f"{path}/manifests/{max(versions)}").first()[0])
        self = cls(spark, path, IndexConfig(**newest.pop("config")))
        self._state = newest
        return self

    def _commit(self, **changes) -> None:
        """Write the next version; fails, and changes nothing, if another writer has written it."""
        state = {**self._state, **changes, "version": self._state["version"] + 1}
        line = json.dumps({**state, "config": asdict(self.config)})
        try:
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("error").text(f"{self.path}/manifests/{state['version']:09d}")
        except AnalysisException as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                raise
            raise Conflict(f"{self.path}: version {state['version']} was written by another") from e
        self._state = state

    def _read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{n}" for n in names])

    def _write(self, df: DataFrame, kind: str) -> str:
        name = f"{kind}/{self._state['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    # state ------------------------------------------------------------------------------------------------------------

    def points(self) -> DataFrame:
        """Live points: tag, vec, labels, seq. A delete takes effect on rows inserted before it, so a tag can return."""
        rows = self._read(self._state["rows"], SCHEMA)
        gone = self._read(self._state["deleted"], "tag long, seq long").groupBy("tag").agg(F.max("seq").alias("_gone"))
        return rows.join(gone, "tag", "left").filter(F.col("_gone").isNull() | (F.col("seq") > F.col("_gone"))).drop("_gone")

    def tombstones(self) -> DataFrame:
        return self._read(self._state["deleted"], "tag long, seq long")

    def active_tags(self) -> DataFrame:
        return self.points().select("tag")

    def count(self) -> int:
        return self.points().count()

    # changes ----------------------------------------------------------------------------------------------------------

    def insert(self, rows: DataFrame, batch: int | None = None) -> DataFrame:
        """tag, status of every row of (tag, vec[, labels]): 0 inserted, -1 not.

        Not inserted are tag 0, null tags, wrong or unfinished vectors, tags that are live or come twice (the first by vector order goes in), and
        on a labelled index points without a label. Going over max_vectors consolidates if anything was deleted, and then raises if
        it is still too much. Batches are numbered upwards; a number up to the last one changes nothing.
        """
        asked = rows.select(F.col("tag").cast("long").alias("tag"), F.col("vec").cast("array<double>").alias("vec"), (F.col("labels") if "labels" in rows.columns else F.array().cast("array<string>")).alias("labels"))
        if batch is not None and batch <= self._state["batch"]:
            return asked.select("tag", F.lit(-1).alias("status"))
        fine = checked(asked.filter("tag is not null and tag <> 0"), self.config.dim)
        if self.config.universal_label is not None:
            fine = fine.filter(F.size("labels") > 0)
        first = fine.withColumn("_n", F.row_number().over(Window.partitionBy("tag").orderBy("vec", "labels"))).filter("_n = 1").drop("_n")
        new = first.join(self.active_tags(), "tag", "left_anti").withColumn("seq", F.lit(self._state["next"]).cast("long"))
        name = self._write(new, "rows")
        added = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        n = added.count()
        if self.config.max_vectors is not None and self.count() + n > self.config.max_vectors:
            if self._state["deleted"]:
                self.consolidate()
            if self.count() + n > self.config.max_vectors:
                raise RuntimeError(f"{n} more points don't fit below {self.config.max_vectors}")
            name = self._write(added, "rows")
            added = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{name}")
        self._commit(rows=[*self._state["rows"], name], next=self._state["next"] + 1, batch=self._state["batch"] if batch is None else batch)
        return asked.select("tag").join(added.select("tag", F.lit(0).alias("_ok")), "tag", "left").select("tag", F.coalesce("_ok", F.lit(-1)).alias("status"))

    def delete(self, tags: DataFrame) -> DataFrame:
        """Deletes tags (tag); searches stop returning them at once. Returns all tags that weren't live, as a table."""
        asked = tags.select(F.col("tag").cast("long").alias("tag")).distinct()
        live = self.active_tags()
        failed = materialise(asked.join(live, "tag", "left_anti"), "failed")
        hit = asked.join(live, "tag", "left_semi").withColumn("seq", F.lit(self._state["next"]).cast("long"))
        self._commit(deleted=[*self._state["deleted"], self._write(hit, "deleted")], next=self._state["next"] + 1)
        return failed

    def consolidate(self) -> DataFrame:
        """Rewrites live rows as one table and drops the tombstones; one row that reports on it.

        The index is repaired around the deleted rows; rows that came since it was built stay outside it until they are more than
        REBUILD_SHARE of the live ones, and then it is built anew over all.
        """
        began = datetime.now(UTC)
        before, live = self._read(self._state["rows"], SCHEMA).count(), self.points()
        deleted = self._read(self._state["deleted"], "tag long, seq long").select("tag").distinct().count()
        rows = self._write(live.repartition("tag"), "rows")
        kept = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{rows}")
        n = kept.count()
        at, indexed = None, self._state["next"]
        if n:
            at = f"index/{self._state['version'] + 1:09d}-{uuid.uuid4().hex[:8]}"
            old = kept.filter(F.col("seq") < self._state["indexed"])
            held = old.count()
            if self._state["index"] is not None and held >= (1 - REBUILD_SHARE) * n:
                index, indexed = Index.load(self.spark, f"{self.path}/{self._state['index']}"), self._state["indexed"]
                gone = index.points.select("id").join(old.select(F.col("tag").alias("id")), "id", "left_anti")
                shards = graph.repair_shards(index.shards, gone, index.config)
                Index(index.config, index.points.join(gone, "id", "left_anti"), materialise(shards, "repaired"), index.centres).save(f"{self.path}/{at}")
            else:
                Index.build(kept.select(F.col("tag").alias("id"), "tag", "vec", "labels"), self.config.with_options(max_vectors=None)).save(f"{self.path}/{at}")
        self._commit(rows=[rows], deleted=[], index=at, indexed=indexed)
        report = ("success", n, self.config.max_vectors, before - n, deleted, (datetime.now(UTC) - began).total_seconds())
        return self.spark.createDataFrame([report], "status string, active long, max_points long, slots_released long, deleted long, seconds double")

    # searches ---------------------------------------------------------------------------------------------------------

    def search(self, queries: DataFrame, k: int, width: int = 100, shards: int | None = 4) -> DataFrame:
        """qid, rank, tag, distance over live points: the index (its nearest `shards` shards or more, None: all), less deleted tags, with an
        exact search of what came since."""
        live = self.points()
        largest = self.config.metric == "mips"
        if self._state["index"] is None:
            found = exact.exact_knn(live.select(F.col("tag").alias("id"), "vec", "labels"), queries, k, self.config.metric, self.config.universal_label)
            return found.withColumnRenamed("id", "tag")
        index = Index.load(self.spark, f"{self.path}/{self._state['index']}")
        old = live.filter(F.col("seq") < self._state["indexed"]).select(F.col("tag").alias("id"))
        if self._state["deleted"]:  # deleted rows are walked through, not returned
            index.shards = index.shards.join(old.withColumn("live", F.lit(True)), "id", "left").withColumn("live", F.coalesce("live", F.lit(False)))
        walked = index.search(queries, k, max(k, width), shards).join(old, "id", "left_semi")
        fresh = live.filter(F.col("seq") >= self._state["indexed"]).select(F.col("tag").alias("id"), "vec", "labels")
        recent = exact.exact_knn(fresh, queries, k, self.config.metric, self.config.universal_label)
        return exact.merge_results([walked, recent], k, largest).select("qid", "rank", F.col("id").alias("tag"), "distance")

    def vectors(self, tags: list[int]) -> DataFrame:
        return exact.vectors_by_tag(self.points(), tags)

    def status(self) -> DataFrame:
        s = self._state
        return self.spark.createDataFrame([(s["version"], self.count(), self.config.max_vectors, self.tombstones().count(), s["index"] is not None)], "version long, active long, max_points long, tombstones long, indexed boolean")


def apply_stream(index: DynamicIndex, changes: DataFrame, checkpoint: str, **trigger):
    """Start a streaming query over changes (tag, vec[, labels], op 'insert' or 'delete'): in each micro-batch, inserts and then deletes.

    A batch that is run again after a failure is recognised by its number.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            index.insert(rows.filter("op = 'insert'"), batch=number)
            index.delete(rows.filter("op = 'delete'").select("tag"))
        finally:
            rows.unpersist()

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def consolidate_patiently(index: DynamicIndex, attempts: int = 5, wait: float = 5.0) -> DataFrame:
    """Consolidate; when another writer comes between, wait, open the newest version and try again. The last failure is raised."""
    for attempt in range(attempts):
        try:
            return index.consolidate()
        except Conflict:
            if attempt == attempts - 1:
                raise
            time.sleep(wait)
            index._state = DynamicIndex.open(index.spark, index.path)._state
    raise ValueError(f"attempts must be above 0, not {attempts}")


def insert_by_cluster(index: DynamicIndex, points: DataFrame, clusters: int, seed: int = 0) -> DataFrame:
    """Insert points (tag, vec[, labels]) cluster after cluster of a k-means over them, as neighbours tend to arrive together; tag, status."""
    centres = kmeans(points.select(F.col("tag").alias("id"), "vec"), clusters, seed=seed)
    dealt = materialise(nearest_centres(points, centres).withColumn("_c", F.col("near")[0]).drop("near"), "dealt")
    reports = [index.insert(dealt.filter(F.col("_c") == c).drop("_c")) for c in range(len(centres))]
    return reduce(DataFrame.unionByName, reports)


def slide(index: DynamicIndex, points: DataFrame, window: int, step: int, order: str = "id") -> list[DataFrame]:
    """Insert points (id, tag, vec) in chunks of `step` by their order column, keep the last `window`, and consolidate after each chunk
    that pushed others out. order numbers the points from 0 without gaps. Returns the consolidation reports."""
    total, reports = points.count(), []
    for start in range(0, total, step):
        index.insert(points.filter((F.col(order) >= start) & (F.col(order) < start + step)))
        end = min(total, start + step)
        if end > window:
            gone = points.filter((F.col(order) < end - window) & (F.col(order) >= end - window - step)).select("tag")
            index.delete(gone)
            reports.append(index.consolidate())
    return reports


def window_rows(points: DataFrame, window: int, order: str = "id") -> DataFrame:
    """The last `window` points of the sequence, in one plan: what is live after `slide`."""
    last = points.agg(F.max(order)).first()[0]
    return points.filter(F.col(order) > (last if last is not None else 0) - window)


def replay(events: DataFrame, delete_types: tuple[str, ...] = ("error",)) -> DataFrame:
    """tag, seq: tags that are live after a log of events (event_id, user_id, event_type): the listed types delete tag user_id + 1,
    others insert tag event_id + 1. The last change of a tag decides."""
    deletes = F.col("event_type").isin(*delete_types)
    log = events.select(F.when(deletes, F.col("user_id") + 1).otherwise(F.col("event_id") + 1).alias("tag"), (~deletes).alias("alive"), F.col("event_id").alias("seq"))
    last = log.groupBy("tag").agg(F.max(F.struct("seq", "alive")).alias("l"))
    return last.filter("l.alive").select("tag", F.col("l.seq").alias("seq"))

