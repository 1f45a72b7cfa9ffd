"""Folders that all executors share, and small files on whatever file system Spark knows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only a driver that runs its own tasks may make one elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


class Store:
    """Small files on whatever file system Spark knows; a file appears whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def names(self, folder: str) -> list[str]:
        return [x.getPath().getName() for x in self.fs.listStatus(self.at(folder))] if self.exists(folder) else []

    def put(self, name: str, text: str) -> None:
        """Writes beside and renames. A file that is there already stays."""
        folder, _, last = name.rpartition("/")
        part = self.at(f"{folder}/.{last}.{uuid.uuid4().hex}")
        out = self.fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if self.exists(name) or not self.fs.rename(part, self.at(name)):
            self.fs.delete(part, False)

    def get(self, name: str) -> str:
        data = self.fs.open(self.at(name))
        try:
            return bytes(data.readAllBytes()).decode()
        finally:
            data.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written once to the shared folder and read from there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
