"""Helpers that the text operators share: scratch tables, batching, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Characters of text that one inner batch of a Python task holds (a longer text is a batch of its own).
BATCH_CHARS = 2_000_000


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which all executors share. Only a driver that runs its own tasks may make one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/netgauge-{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in this application's shared one."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that this application wrote in between; for when its results have been written."""
    delete(spark, scratch_root(spark))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows once and reads them from there; the shuffle files of the writing job go as soon as it is done."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder and read from there."""
    return stored(df, scratch_dir(df.sparkSession))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the Arrow batches with about `limit` bytes of text each, and their texts (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                part = batch.slice(start, i - start)
                yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]
                start, total = i, 0
            total += int(n)
        part = batch.slice(start)
        yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated runs [starts[i], starts[i] + lengths[i])."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) - np.repeat(ends - lengths - starts, lengths)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component), component the smallest node reachable; nodes without links don't appear.

    Alternating large-star and small-star rounds: each node points to the
    smallest of its neighbours until nothing changes, about log(n) rounds. Every
    round is an aggregate and a splittable join, so a hub's links are never
    gathered in one place, and is written to the shared folder; the round before
    is removed then. Self links and repeated links are allowed; an empty input
    gives an empty result.
    """
    spark = edges.sparkSession

    def sign(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return row[0], row[1]

    path = scratch_dir(spark)
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    before = sign(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low2, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        old, path = path, scratch_dir(spark)
        e = stored(small, path)
        delete(spark, old)
        after = sign(e)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
