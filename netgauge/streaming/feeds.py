"""Change events from state, snapshots of the means behind them, and feeds of the latest events, over a restart from a checkpoint or from a snapshot."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from netgauge.operators.detector import LOWER, UPPER, WEIGHT
from netgauge.streaming.sinks import Ledger

#: Events that a feed keeps.
FEED = 1000
CHANGES, MEANS, FEEDS = "changes", "means", "feeds"
#: The state store that can hold the state of these operators.
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "mean double, blocked boolean, ts timestamp, uid long, known_ts timestamp, known_uid long"
KIND_CHANGE, KIND_MEAN = "change", "mean"


def months_between(before: pd.Timestamp, after: pd.Timestamp) -> list[date]:
    """First days of months after one time, up to another."""
    out, year, month = [], before.year, before.month
    while (year, month) < (after.year, after.month):
        year, month = (year, month + 1) if month < 12 else (year + 1, 1)
        out.append(date(year, month, 1))
    return out


class Averages(StatefulProcessor):
    """Per key: the moving average, whether it says blocked, and the last row in it.

    Gives a row for each flip, and, at a key's first row of a later month, its mean
    as it was when that month began. Rows that a restored snapshot holds already
    (those up to its last) are left out, so that a re-read that overlaps counts once.
    """

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("average", STATE)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803  Spark's names
        r = initialState.iloc[0]
        self.state.update((float(r["mean"]), bool(r["blocked"]), r["ts"], int(r["uid"]), r["ts"], int(r["uid"])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mean, blocked, ts, uid, known_ts, known_uid = self.state.get() if self.state.exists() else (None, False, None, None, None, None)
        known = None if known_ts is None else (pd.Timestamp(known_ts), known_uid)
        last = None if ts is None else (pd.Timestamp(ts), uid)
        out = []
        for at, n, x, report in pd.concat(list(rows)).sort_values(["ts", "uid"])[["ts", "uid", "x", "report_id"]].itertuples(index=False):
            if pd.isna(x) or (known is not None and (at, n) <= known):
                continue
            if last is not None and at > last[0]:
                out += [(*key, KIND_MEAN, pd.Timestamp(m), None, None, mean, blocked) for m in months_between(last[0], at)]
            mean = float(x) if mean is None else (1 - WEIGHT) * mean + WEIGHT * float(x)
            now = True if mean > UPPER else False if mean < LOWER else blocked
            if now != blocked:
                out.append((*key, KIND_CHANGE, at, n, report, mean, now))
            blocked = now
            last = (at, n) if last is None else max(last, (at, n))
        if mean is not None and last is not None:
            self.state.update((mean, bool(blocked), last[0].to_pydatetime(), int(last[1]), None if known is None else known[0].to_pydatetime(), None if known is None else int(known[1])))
        yield pd.DataFrame(out, columns=[*self.keys, "kind", "ts", "uid", "report_id", "mean", "blocked"]).astype({"uid": "Int64"})

    def close(self) -> None:
        pass


def averages(values: DataFrame, keys: list[str], restored: DataFrame | None = None) -> DataFrame:
    """Stream of (keys, ts, uid, x, report_id) -> keys, kind, ts, uid, report_id, mean, blocked: flips (kind `change`) and means at the start of months (kind `mean`).

    restored(keys, mean, blocked, ts, uid), a snapshot, is what the state of a new checkpoint begins with.
    """
    types = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{types}, kind string, ts timestamp, uid long, report_id string, mean double, blocked boolean"
    begin = restored.select(*keys, "mean", "blocked", "ts", "uid").groupBy(*keys) if restored is not None else None
    return values.groupBy(*keys).transformWithStateInPandas(Averages(keys), outputStructType=schema, outputMode="append", timeMode="none", initialState=begin)


def state_of(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The averages in a checkpoint's state -> keys, mean, blocked, ts, uid."""
    s = spark.read.format("statestore").option("stateVarName", "average").load(checkpoint)
    return s.select("key.*", "value.mean", "value.blocked", "value.ts", "value.uid")


def snapshot(spark: SparkSession, sink: str, checkpoint: str, month: str, keys: list[str]) -> DataFrame:
    """The mean of each key when a month began, whatever the batches: of keys that went on after, as they said then; of the others, from the state."""
    start = F.lit(month).cast("timestamp")
    said = table(spark, sink, MEANS, keys).where(F.col("ts") == start).select(*keys, "mean")
    return said.unionByName(state_of(spark, checkpoint).where(F.col("ts") < start).select(*keys, "mean"))


def feed(changes: DataFrame, keys: list[str], limit: int = FEED) -> DataFrame:
    """The latest changes of each country: columns of changes and rank; those without an input aren't told, nor those without a report."""
    told = changes.where("coalesce(input, '') <> '' and report_id is not null")
    order = [F.desc("ts"), F.desc("uid"), *keys]
    return told.withColumn("rank", F.row_number().over(Window.partitionBy("probe_cc").orderBy(*order))).where(F.col("rank") <= limit)


def start(spark: SparkSession, values: DataFrame, sink: str, checkpoint: str, keys: list[str], restored: DataFrame | None = None, once: bool = False) -> StreamingQuery:
    """Appends changes and monthly means, and replaces the feeds of the countries that a batch changed; all of a batch or nothing.

    A country's feed is that of its last one and the batch's changes, so what a
    batch reads is bounded by its countries' feeds, whatever the history. The
    overall feed is the latest of all countries' (what is among the latest of all is
    among those of its country).
    """
    ledger = Ledger(spark, sink)

    def append(batch: DataFrame, number: int) -> None:
        if ledger.done(number):
            return
        rows = ledger.stage(number, "events", batch)
        changes = ledger.stage(number, CHANGES, rows.where(F.col("kind") == KIND_CHANGE).drop("kind"))
        ledger.stage(number, MEANS, rows.where(F.col("kind") == KIND_MEAN).drop("kind"))
        before = feeds(spark, sink, keys).drop("rank", "version").join(changes.select("probe_cc").distinct(), "probe_cc", "left_semi")
        ledger.stage(number, FEEDS, feed(before.select(*changes.columns).unionByName(changes), keys).withColumn("version", F.lit(number)))
        ledger.commit(number, (CHANGES, MEANS, FEEDS))

    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, PROVIDER)  # for this query alone, which keeps the settings it starts with
    try:
        writer = averages(values, keys, restored).writeStream.outputMode("append").foreachBatch(append).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)


def table(spark: SparkSession, sink: str, name: str, keys: list[str]) -> DataFrame:
    own = ", ".join(f"`{k}` string" for k in keys) + ", ts timestamp, uid long, report_id string, mean double, blocked boolean"
    return Ledger(spark, sink).read(name, own + (", rank int, version int" if name == FEEDS else ""))


def feeds(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """Each country's feed as the last batch that changed it left it."""
    every = table(spark, sink, FEEDS, keys)
    last = every.groupBy("probe_cc").agg(F.max("version").alias("version"))  # a row a country
    return every.join(last, ["probe_cc", "version"])


def overall(spark: SparkSession, sink: str, keys: list[str], limit: int = FEED) -> DataFrame:
    """The latest changes of all countries."""
    return feeds(spark, sink, keys).drop("rank", "version").orderBy(F.desc("ts"), F.desc("uid"), *keys).limit(limit)
