"""Tables that a stream's batches append to together."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from netgauge.sources.store import Store


class Ledger:
    """Tables below one root to which numbered batches append, all of a batch's tables or none.

    Every table of a batch is a folder of its own; they count once the batch's
    commit file stands, which is written last and appears whole. A batch that is
    done again before its commit overwrites what it left; after it, it does
    nothing. compact() gives the committed folders of a table as one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def commits(self) -> dict[int, dict]:
        """Batch number -> its commit; those that a compaction holds are one, under its last number."""
        found = {}
        for name in self.store.names("_commits"):
            if m := re.fullmatch(r"(batch|upto)-(\d+)\.json", name):
                found[m[1], int(m[2])] = name
        upto = max((n for kind, n in found if kind == "upto"), default=-1)
        keep = {n: name for (kind, n), name in found.items() if (kind == "upto" and n == upto) or (kind == "batch" and n > upto)}
        return {n: json.loads(self.store.get(f"_commits/{name}")) | {"compacted": name.startswith("upto")} for n, name in sorted(keep.items())}

    def done(self, number: int) -> bool:
        if self.store.exists(f"_commits/batch-{number}.json"):
            return True
        return any(int(m[1]) >= number for name in self.store.names("_commits") if (m := re.fullmatch(r"upto-(\d+)\.json", name)))

    def stage(self, number: int, table: str, rows: DataFrame) -> DataFrame:
        """Writes a batch's rows of a table, and reads them back: what is derived from them is derived from what was written."""
        path = f"{self.store.root}/{table}/batch={number}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def commit(self, number: int, tables: Iterable[str], **notes: object) -> None:
        self.store.put(f"_commits/batch-{number}.json", json.dumps({"folders": {t: f"{t}/batch={number}" for t in tables}} | notes))

    def read(self, table: str, schema: StructType | str) -> DataFrame:
        """The committed rows of a table."""
        folders = [f"{self.store.root}/{c['folders'][table]}" for c in self.commits().values() if table in c["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def compact(self, schemas: dict[str, StructType | str], fold: Callable[[str, DataFrame], DataFrame] = lambda _, rows: rows) -> int | None:
        """All that is committed becomes one folder a table, of fold(table, rows); readers see the old folders or the new ones. Gives the last batch's number."""
        commits = self.commits()
        if sum(not c["compacted"] for c in commits.values()) < 2:
            return None
        last, version = max(commits), uuid.uuid4().hex[:12]
        for table, schema in schemas.items():
            fold(table, self.read(table, schema)).write.parquet(f"{self.store.root}/{table}/upto={last}-{version}")
        self.store.put(f"_commits/upto-{last}.json", json.dumps({"folders": {t: f"{t}/upto={last}-{version}" for t in schemas}}))
        for n, c in commits.items():
            self.store.delete(f"_commits/{'upto' if c['compacted'] else 'batch'}-{n}.json")
            for folder in c["folders"].values():
                self.store.delete(folder)
        return last


def by_time(uid: str = "measurement_uid") -> list:
    """day, hour, cc and test of a uid `yyyymmddhhmmss.ffffff_CC_test_hash`; null where it isn't one."""
    p = F.split(uid, "_")
    ok = F.col(uid).rlike(r"^\d{14}[^_]*_[^_]+_[^_]+_[^_]+$")
    part = lambda i: F.when(ok, F.get(p, F.lit(i)))
    return [F.substring(part(0), 1, 8).alias("day"), F.substring(part(0), 9, 2).alias("hour"), part(1).alias("cc"), part(2).alias("test")]
