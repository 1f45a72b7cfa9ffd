"""Structured Streaming: scoring on arrival, continuous counters, stateful change detection."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netgauge.functions import scalar, scoring
from netgauge.operators.detector import LOWER, UPPER, WEIGHT


#: Columns of a fact row, in order.
TEXTS = {"software_version": "$.software_version", "architecture": "$.annotations.architecture", "engine_name": "$.annotations.engine_name", "engine_version": "$.annotations.engine_version", "test_version": "$.test_version", "test_helper_address": "$.test_helpers.backend.address", "test_helper_type": "$.test_helpers.backend.type"}


def taken_in(rows: DataFrame) -> DataFrame:
    """(v, ...) -> the rows without those of no report id, or of unknown country or network."""
    cc, asn = (F.coalesce(F.try_variant_get("v", f"$.{n}", "string"), F.lit("")) for n in ("probe_cc", "probe_asn"))
    return rows.where((F.upper(cc) != "ZZ") & (F.upper(asn) != "AS0") & F.try_variant_get("v", "$.report_id", "string").isNotNull())


def kept(bodies: DataFrame) -> DataFrame:
    """(measurement_uid, body) -> with v, without what isn't taken in: unparsable bodies, no report id, unknown country or network."""
    return taken_in(bodies.withColumn("v", F.try_parse_json("body")).where("v is not null"))


def fact_rows(rows: DataFrame, scores: Column | None = None, confirmed: Column | None = None) -> DataFrame:
    """(measurement_uid, v) -> the whole fact row, missing fields with their defaults.

    Scores are the test's own unless they are given (as by confirm.scored); a
    start that the uid's time contradicts takes the accuracy away.
    """
    v, uid = F.col("v"), F.col("measurement_uid")
    text = lambda path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    start = F.try_to_timestamp(F.try_variant_get(v, "$.measurement_start_time", "string"), F.lit("yyyy-MM-dd HH:mm:ss"))
    test, (input_, domain) = text("$.test_name"), scalar.input_and_domain(v)
    s = scoring.score(v, test) if scores is None else scores
    wrong = scalar.wrong_date(uid, start)
    d = rows.withColumn("scores", F.struct(s["blocking_general"].alias("blocking_general"), F.when(wrong, 0.0).otherwise(s["accuracy"]).alias("accuracy"), s["blocking_type"].alias("blocking_type")))
    link = F.map_values(F.map_filter(F.coalesce(F.try_variant_get(v, "$.annotations", "map<string,string>"), F.expr("cast(map() as map<string,string>)")), lambda k, _: k.endswith("run_link_id")))
    return d.select(
        uid, text("$.report_id").alias("report_id"), input_.alias("input"), domain.alias("domain"), F.upper(text("$.probe_cc")).alias("probe_cc"), scalar.asn_number(text("$.probe_asn")).alias("probe_asn"), test.alias("test_name"),
        F.try_to_timestamp(F.try_variant_get(v, "$.test_start_time", "string"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("test_start_time"), start.alias("measurement_start_time"), F.to_json("scores").alias("scores_json"), F.col("scores.blocking_general").alias("blocking_general"),
        F.coalesce(F.try_variant_get(v, "$.annotations.platform", "string"), F.lit("unset")).alias("platform"), F.coalesce(F.try_variant_get(v, "$.software_name", "string"), F.lit("unknown")).alias("software_name"),
        F.coalesce(F.try_variant_get(v, "$.test_runtime", "double"), F.lit(0.0)).alias("test_runtime"), *[text(path).alias(n) for n, path in TEXTS.items()], F.get(link, F.lit(0)).try_cast("long").alias("run_link_id"),
        F.coalesce("scores.blocking_type", F.lit("")).alias("blocking_type"), *[c.alias(n) for n, c in scoring.flags(F.col("scores")).items()], F.when(F.lit(False) if confirmed is None else confirmed, "t").otherwise("f").alias("confirmed"),
    )


def scored(bodies: DataFrame) -> DataFrame:
    """Stream or table of (measurement_uid, body) -> fact rows."""
    return fact_rows(kept(bodies))


def recent_web(fact: DataFrame, urls: DataFrame, now: Column) -> DataFrame:
    """Web measurements of listed URLs that are neither in the future nor 8 days old."""
    m = fact.where((F.col("test_name") == "web_connectivity") & (F.col("measurement_start_time") < now) & (F.col("measurement_start_time") > now - F.expr("interval 8 days")))
    return m.join(urls.select(F.col("url").alias("input")).distinct(), "input")


def daily_counters(web: DataFrame) -> DataFrame:
    """Counts by day, country and input; rows more than 8 days late are dropped."""
    return web.withWatermark("measurement_start_time", "8 days").groupBy(F.window("measurement_start_time", "1 day").alias("w"), "probe_cc", "input").agg(F.count("*").alias("msmt_cnt"))


def weekly_counters(web: DataFrame) -> DataFrame:
    """Counts by Sunday week, country, network and input; rows more than 8 days late are dropped."""
    return web.withWatermark("measurement_start_time", "8 days").groupBy(F.window("measurement_start_time", "7 days", "7 days", "3 days").alias("w"), "probe_cc", "probe_asn", "input").agg(F.count("*").alias("msmt_cnt"))


def blocking_changes(values: DataFrame, keys: list[str]) -> DataFrame:
    """values(keys, ts, uid, x) -> change events; mean and state of each key live in the state store."""
    types = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, blocked = state.get if state.exists else (None, False)
        out = []
        for ts, _, x in pd.concat(list(batches)).sort_values(["ts", "uid"])[["ts", "uid", "x"]].itertuples(index=False):
            if pd.isna(x):
                continue
            mean = float(x) if mean is None else (1 - WEIGHT) * mean + WEIGHT * float(x)
            now = True if mean > UPPER else False if mean < LOWER else blocked
            if now != blocked:
                out.append((*key, ts, mean, now))
            blocked = now
        if mean is not None:
            state.update((mean, bool(blocked)))
        yield pd.DataFrame(out, columns=[*keys, "ts", "mean", "blocked"])

    return values.groupBy(*keys).applyInPandasWithState(step, f"{types}, ts timestamp, mean double, blocked boolean", "mean double, blocked boolean", "append", GroupStateTimeout.NoTimeout)


T = TypeVar("T")


class Refreshed(Generic[T]):
    """A small reference table that is read again once it is older than `seconds`; if that fails the old copy stays."""

    def __init__(self, load: Callable[[], T], seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.load, self.seconds, self.clock = load, seconds, clock
        self.table, self.at = load(), clock()

    def __call__(self) -> T:
        if self.clock() - self.at >= self.seconds:
            try:
                self.table, self.at = self.load(), self.clock()
            except Exception as e:  # whatever the source raises, scoring goes on
                logging.getLogger(__name__).warning("refresh failed: %s", e)
        return self.table
