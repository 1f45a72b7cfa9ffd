"""Counters as a summing store: every batch appends its own partial sums, and reading or merging adds them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from netgauge.functions.scalar import bucket
from netgauge.streaming.sinks import Ledger

COUNTERS = "counters"
#: Per grain: its column, and what counts are told apart by beside the time.
GRAINS = {"day": ("probe_cc", "input"), "week": ("probe_cc", "probe_asn", "input")}


def keys_of(grain: str) -> list[str]:
    return [grain, *GRAINS[grain]]


def partial(rows: DataFrame, grain: str, time: Column | None = None) -> DataFrame:
    """Counts of rows(measurement_start_time, probe_cc, probe_asn, input) by day, or by Sunday week and network."""
    at = F.col("measurement_start_time") if time is None else time
    return rows.withColumn(grain, bucket(at, grain).cast("timestamp")).groupBy(*keys_of(grain)).agg(F.count("*").alias("msmt_cnt"))


def summed(sums: DataFrame, grain: str) -> DataFrame:
    return sums.groupBy(*keys_of(grain)).agg(F.sum("msmt_cnt").alias("msmt_cnt"))


def schema(grain: str) -> str:
    return f"{grain} timestamp, " + ", ".join(f"{c} {'bigint' if c == 'probe_asn' else 'string'}" for c in GRAINS[grain]) + ", msmt_cnt bigint"


def start(spark: SparkSession, rows: DataFrame, sink: str, checkpoint: str, grain: str = "day", once: bool = False) -> StreamingQuery:
    """Stream of measurements -> partial sums below sink, a batch at a time; it keeps no state, however late a row comes."""
    ledger = Ledger(spark, sink)

    def append(batch: DataFrame, number: int) -> None:
        if not ledger.done(number):
            ledger.stage(number, COUNTERS, typed(partial(batch, grain), grain))
            ledger.commit(number, [COUNTERS])

    writer = rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def typed(sums: DataFrame, grain: str) -> DataFrame:
    return sums.select(*[F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ") for x in schema(grain).split(", "))])


def read(spark: SparkSession, sink: str, grain: str = "day") -> DataFrame:
    """The counters, whatever has been merged."""
    return summed(Ledger(spark, sink).read(COUNTERS, schema(grain)), grain)


def merge(spark: SparkSession, sink: str, grain: str = "day") -> int | None:
    """Adds up all committed partial sums into one folder; counters read the same before, after and in between."""
    return Ledger(spark, sink).compact({COUNTERS: schema(grain)}, lambda _, rows: summed(rows, grain))
