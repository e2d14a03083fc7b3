"""Tables of projects: scans by project, appends, upserts, deletes, retention and the latest of each key."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder. Where none is set, one of our own serves in local mode (tests) only."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not shared and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows without their lineage, written to the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


class Store:
    """Parquet tables under one root, partitioned by project: scans of a project read its partition alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def scan(self, table: str, project: str) -> DataFrame:
        return self.spark.read.option("mergeSchema", "true").parquet(self.path(table)).where(F.col("project_id") == project)

    def append(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("project_id").parquet(self.path(table))

    def save_dataset(self, table: str, dataset: DataFrame, rows: DataFrame) -> None:
        """Rows first, then the dataset's own row: a dataset that is listed is whole. A fingerprint that the project has already is refused."""
        if self.exists("datasets"):
            seen = self.spark.read.parquet(self.path("datasets")).select("project_id", "fingerprint")
            if not dataset.join(seen, ["project_id", "fingerprint"], "left_semi").isEmpty():
                raise ValueError("this file was imported already")
        self.append(table, rows)
        self.append("datasets", dataset)

    def exists(self, table: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def delete_dataset(self, table: str, project: str, dataset: str) -> None:
        """Rewrites the project's partition without the dataset."""
        kept = cut(self.scan(table, project).where(F.col("dataset_id") != dataset))
        self._replace(table, project, kept)

    def delete_project(self, tables: Iterable[str], project: str) -> None:
        for table in tables:
            if self.exists(table):
                self._replace(table, project, None)

    def _replace(self, table: str, project: str, rows: DataFrame | None) -> None:
        """Writes the kept rows aside, then swaps folders: until the swap the project's old rows stay, and a writer lost before it changes nothing."""
        name = self.spark._jvm.org.apache.hadoop.fs.Path
        aside = f"{self.path(table)}/_swap-{uuid.uuid4().hex}"
        if rows is not None and not rows.isEmpty():
            rows.drop("project_id").write.parquet(f"{aside}/new")
        folder, new, old = (name(p) for p in (f"{self.path(table)}/project_id={project}", f"{aside}/new", f"{aside}/old"))
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(name(aside))
        if files.exists(folder) and not files.rename(folder, old):
            raise OSError(f"{folder} can't be moved")
        if files.exists(new) and not files.rename(new, folder):
            files.rename(old, folder)
            raise OSError(f"{new} can't be moved")
        files.delete(name(aside), True)

    def upsert_origin(self, projects: DataFrame) -> None:
        """Adds the projects (project_id, origin, ...) whose origin is new, one for each origin."""
        new = projects.withColumn("rank", F.row_number().over(Window.partitionBy("origin").orderBy("project_id"))).where("rank = 1").drop("rank")
        if self.exists("projects"):
            new = new.join(self.spark.read.parquet(self.path("projects")).select("origin").distinct(), "origin", "left_anti")
        self.append("projects", new)


def first_of_key(rows: DataFrame, keys: list[str], order: str, blank: str | None = None) -> DataFrame:
    """The first row of each key by ``order``; rows whose ``blank`` column is empty are all kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    keep = F.col("_rank") == 1
    if blank:
        keep = keep | (F.coalesce(F.col(blank), F.lit("")) == "")
    return rows.withColumn("_rank", rank).where(keep).drop("_rank")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key as a whole: a hash aggregation, no sort."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*keys, "_r.*")


def last_n(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The newest ``n`` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last value at the place of the first."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min(order).alias(order), F.max_by(F.struct(*others), order).alias("_r")).select(key, order, "_r.*")


def trim_conversation(messages: DataFrame, most: int = 20, contexts: int = 6) -> DataFrame:
    """The last ``most`` messages of each conversation, of which the last ``contexts`` context markers stay."""
    recent = last_n(messages, ["conv_id"], ["turn"], most)
    rank = F.row_number().over(Window.partitionBy("conv_id", "is_context").orderBy(F.desc("turn")))
    return recent.withColumn("_rank", rank).where(~F.col("is_context") | (F.col("_rank") <= contexts)).drop("_rank")


def newest_conversations(messages: DataFrame, most: int = 20) -> DataFrame:
    """The conversations updated last."""
    updated = messages.groupBy("conv_id").agg(F.max("turn").alias("turns"))
    return updated.orderBy(F.desc("turns"), F.desc("conv_id")).limit(most)


def change_record(rows: DataFrame, as_of: str) -> DataFrame:
    """Changes (project_id, channel, sem_dimension, days) with the time until which they are watched: days are 1 to 90, 7 if unknown."""
    days = F.least(F.lit(90), F.greatest(F.lit(1), F.coalesce("days", F.lit(7)))).cast("int")
    made = F.to_timestamp(F.lit(as_of))
    return rows.withColumns({"created_at": made, "learning_until": made + F.make_dt_interval(days)})


def only_new(rows: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't stored yet: what an append may add."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")
