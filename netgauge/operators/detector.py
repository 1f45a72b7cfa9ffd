"""Blocked/unblocked changes from moving averages per target.

A series is cut into chunks by day and, within a day, by CHUNK rows. A mean over
a chunk is linear in the mean before it, so every chunk is folded by itself, the
chunks' few numbers are chained per key, and their starting means go back into
the chunks: no task needs a key's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT, UPPER, LOWER = 0.02, 0.10, 0.05
#: Rows of a chunk; the powers of 1 - WEIGHT that occur in one stay far from the limits of a double.
CHUNK = 1000


def moving_average(rows: DataFrame, keys: list[str], time: str = "ts", uid: str = "uid", value: str = "x") -> DataFrame:
    """Adds `mean`: the first value, then 0.98 of the mean plus 0.02 of the value, in order of time and uid; null values are skipped."""
    keep = F.lit(1 - WEIGHT)
    chunk = [*keys, "_day", "_part"]
    rows = rows.where(F.col(value).isNotNull()).withColumn("_day", F.to_date(time))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_day").orderBy(time, uid)))
    rows = rows.withColumn("_part", F.floor((F.col("_n") - 1) / CHUNK)).withColumn("_n", (F.col("_n") - 1) % CHUNK + 1)
    upto = Window.partitionBy(*chunk).orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_own", WEIGHT * F.pow(keep, "_n") * F.sum(F.col(value) / F.pow(keep, "_n")).over(upto))
    ends = rows.groupBy(*chunk).agg(F.max("_n").alias("n"), F.max_by("_own", "_n").alias("own"), F.min_by(value, "_n").cast("double").alias("first"))
    chained = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_day", "_part", "n", "own", "first"))).alias("chunks"))
    starts = F.aggregate(
        F.slice("chunks", 1, F.size("chunks") - 1),
        F.array(F.get("chunks", F.lit(0))["first"]),
        lambda means, c: F.concat(means, F.array(F.pow(keep, c["n"]) * F.element_at(means, -1) + c["own"])),
    )
    start = chained.select(*keys, F.explode(F.arrays_zip(F.col("chunks"), starts.alias("start"))).alias("z")).select(*keys, "z.chunks._day", "z.chunks._part", F.col("z.start").alias("_start"))
    mean = F.pow(keep, "_n") * F.col("_start") + F.col("_own")
    return rows.join(start, chunk).withColumn("mean", mean).drop("_day", "_part", "_n", "_own", "_start")


def crossed() -> Column:
    """Blocked above UPPER, clear below LOWER, null between."""
    return F.when(F.col("mean") > UPPER, True).when(F.col("mean") < LOWER, False)


def changes(means: DataFrame, keys: list[str], time: str = "ts", uid: str = "uid") -> DataFrame:
    """Rows at which the state flips: blocked above UPPER, cleared below LOWER, unchanged between. Days are worked on apart; each starts in the state that the last one left."""
    means = means.withColumn("_day", F.to_date(time)).withColumn("_crossed", crossed())
    last = means.groupBy(*keys, "_day").agg(F.max_by("_crossed", F.when(F.col("_crossed").isNotNull(), F.struct(time, uid))).alias("_last"))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    start = last.select(*keys, "_day", F.coalesce(F.last("_last", ignorenulls=True).over(before), F.lit(False)).alias("_start"))
    w = Window.partitionBy(*keys, "_day").orderBy(time, uid)
    state = F.coalesce(F.last("_crossed", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("_start"))
    s = means.join(start, [*keys, "_day"]).withColumn("blocked", state).withColumn("_before", F.coalesce(F.lag("blocked").over(w), F.col("_start")))
    return s.where(F.col("blocked") != F.col("_before")).drop("_before", "_day", "_start", "_crossed")


def snapshot(means: DataFrame, keys: list[str], until: str, time: str = "ts", uid: str = "uid") -> DataFrame:
    """The last mean of each key up to a date."""
    return means.where(F.col(time) < F.lit(until).cast("timestamp")).groupBy(*keys).agg(F.max_by("mean", F.struct(time, uid)).alias("mean"))


def busiest(rows: DataFrame, within: list[str], of: str, k: int = 20) -> DataFrame:
    """The k values of `of` with the most rows in each group: rows, points, rn."""
    c = rows.groupBy(*within, of).agg(F.count("*").alias("points"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("points"), of))).where(F.col("rn") <= k)


def clamped(time: Column, as_of: Column) -> Column:
    """Times in the future read as of now."""
    return F.least(time, as_of)
