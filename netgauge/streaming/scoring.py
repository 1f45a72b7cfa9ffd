"""Scoring on arrival: posts become spooled bodies, fact rows and OpenVPN rows, with fingerprints that are read again while the stream runs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from netgauge.operators import confirm, lookup
from netgauge.streaming import ingest
from netgauge.streaming.sinks import Ledger, by_time

POSTS, FACTS, OPENVPN = "posts", "facts", "openvpn"
#: Columns of a fingerprint that scoring reads.
PRINT_COLUMNS = ("name", "pattern", "pattern_type", "location_found", "scope", "expected_countries")
PRINTS = "name string, pattern string, pattern_type string, location_found string, scope string, expected_countries array<string>"

Prints = tuple[DataFrame, DataFrame]


def unwrapped(v: Column) -> Column:
    """A body as it is, or what an envelope {"format": "json", "content": ...} holds; other formats give nothing."""
    content, form = F.try_variant_get(v, "$.content", "variant"), F.try_variant_get(v, "$.format", "string")
    return F.when(content.isNull() | form.isNull(), v).when(F.lower(form) == "json", content)


def kept(posts: DataFrame) -> DataFrame:
    """posts(measurement_uid, body) -> measurement_uid, v of those that are taken in."""
    opened = posts.select("measurement_uid", unwrapped(F.try_parse_json("body")).alias("v")).where("v is not null")
    return ingest.taken_in(opened)


def derived(posts: DataFrame, prints: Prints | None) -> dict[str, DataFrame]:
    """Rows of the tables that follow from posts: facts with the flags that fingerprints confirm, and OpenVPN rows."""
    rows = kept(posts)
    if prints is None:
        facts = ingest.fact_rows(rows)
    else:
        msms = rows.select(F.col("measurement_uid").alias("uid"), F.coalesce(F.try_variant_get("v", "$.test_name", "string"), F.lit("")).alias("test_name"), "v")
        found = confirm.scored(msms, *prints).select(F.col("uid").alias("measurement_uid"), F.col("scores").alias("_scores"), F.col("confirmed").alias("_sure"))
        facts = ingest.fact_rows(rows.join(found, "measurement_uid"), F.col("_scores"), F.col("_sure"))
    vpn = rows.where(F.try_variant_get("v", "$.test_name", "string") == "openvpn")
    return {FACTS: facts, OPENVPN: lookup.openvpn_observations(vpn)}


class Snapshots:
    """Fingerprints as files of the stream's own: a copy is made when the last is older than `seconds`; if that fails, the last stays in use."""

    def __init__(self, ledger: Ledger, load: Callable[[], Prints], seconds: float = 3600, **clock: Callable[[], float]):
        self.ledger, self.source = ledger, load
        self.current = ingest.Refreshed(self.copy, seconds, **clock)

    def copy(self) -> str:
        version = uuid.uuid4().hex[:12]
        for kind, table in zip(("dns", "http"), self.source(), strict=True):
            table.select(*PRINT_COLUMNS).write.parquet(f"{self.ledger.store.root}/_prints/{version}/{kind}")
        return version

    def __call__(self) -> tuple[str, Prints]:
        version = self.current()
        return version, self.read(version)

    def read(self, version: str) -> Prints:
        read = lambda kind: self.ledger.spark.read.schema(PRINTS).parquet(f"{self.ledger.store.root}/_prints/{version}/{kind}")
        return read("dns"), read("http")


def appended(ledger: Ledger, batch: DataFrame, number: int, prints: Snapshots | None = None) -> None:
    """One batch of (measurement_uid, body) into all tables, or into none.

    A uid that comes twice in a batch counts once, with the smaller body. Bodies are
    spooled as they came; everything else is derived from the spooled rows.
    """
    if ledger.done(number):
        return
    once = batch.groupBy("measurement_uid").agg(F.min("body").alias("body"))
    posts = ledger.stage(number, POSTS, once.select("measurement_uid", *by_time(), "body"))
    version, tables = prints() if prints else (None, None)
    for name, rows in derived(posts, tables).items():
        ledger.stage(number, name, rows)
    ledger.commit(number, (POSTS, FACTS, OPENVPN), prints=version)


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, load: Callable[[], Prints] | None = None, files: int = 100, once: bool = False, seconds: float = 3600, **clock: Callable[[], float]) -> StreamingQuery:
    """JSON lines (measurement_uid, body) that arrive below `source` are scored into the tables below `sink`, so many files a batch.

    load() gives the fingerprints (for answers, for responses); they are copied at
    the start and again by a batch that begins `seconds` after.
    """
    ledger = Ledger(spark, sink)
    prints = Snapshots(ledger, load, seconds, **clock) if load else None
    lines = spark.readStream.option("maxFilesPerTrigger", files).schema("measurement_uid string, body string").json(source)
    writer = lines.writeStream.foreachBatch(lambda batch, number: appended(ledger, batch, number, prints)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def schemas(spark: SparkSession) -> dict[str, object]:
    """The tables' schemas."""
    posts = spark.createDataFrame([], "measurement_uid string, day string, hour string, cc string, test string, body string")
    return {POSTS: posts.schema} | {name: rows.schema for name, rows in derived(posts, None).items()}


def read(spark: SparkSession, sink: str, table: str) -> DataFrame:
    """The committed rows of one of the tables."""
    return Ledger(spark, sink).read(table, schemas(spark)[table])


def compact(spark: SparkSession, sink: str) -> int | None:
    return Ledger(spark, sink).compact(schemas(spark))
