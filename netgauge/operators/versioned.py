"""Merge semantics of append-only tables, dedupe, latest values, set differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Replacing merge: the row of highest version per key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(v) for v in version])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def collapsed(log: DataFrame, keys: list[str], sign: str = "sign") -> DataFrame:
    """Collapsing merge: keys whose signs add up to more than 0."""
    return log.groupBy(*keys).agg(F.sum(sign).alias("_s")).where("_s > 0").drop("_s")


def blanks_free(rules: DataFrame, keys: list[str]) -> DataFrame:
    """Blank fields of a rule mean any."""
    return rules.withColumns({k: F.when(F.trim(k) == "", "*").otherwise(F.col(k)) for k in keys if rules.schema[k].dataType.simpleString() == "string"})


def rule_update(log: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """The log with -1 rows for the old rules and +1 rows for the new, and apart the new rules that are refused: one of equal `unique` columns is alive, or comes twice."""
    log = log.unionByName(old.withColumn("sign", F.lit(-1)))
    new = blanks_free(new, unique).withColumn("_twice", F.count("*").over(Window.partitionBy(*unique)) > 1)
    alive = collapsed(log, keys).select(*unique).distinct().withColumn("_alive", F.lit(True))
    checked = new.join(alive, unique, "left").withColumn("_bad", F.coalesce("_alive", F.lit(False)) | F.col("_twice"))
    part = lambda bad: checked.where(F.col("_bad") == bad).select(*keys)
    return log.unionByName(part(False).withColumn("sign", F.lit(1))), part(True)


def edited_list(rows: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """A list without the old entries and with the new ones; an old entry that isn't there, or an edit without a change, is an error."""
    if not old.join(rows, rows.columns, "left_anti").isEmpty():
        raise ValueError("an entry to be replaced isn't in the list")
    if not old.join(new, rows.columns, "left_semi").isEmpty():
        raise ValueError("an edit changes nothing")
    return rows.join(old, rows.columns, "left_anti").unionByName(new)


def upsert(present: DataFrame, wanted: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Kept endpoints are touched, absent ones go, new ones come: action keep, add or delete per key."""
    p, w = present.select(*keys).distinct().withColumn("_p", F.lit(True)), wanted.select(*keys).distinct().withColumn("_w", F.lit(True))
    action = F.when(F.col("_p") & F.col("_w"), "keep").when(F.col("_w"), "add").otherwise("delete")
    return p.join(w, keys, "full").select(*keys, action.alias("action"), F.lit(as_of).cast("timestamp").alias("updated"))


def value_by(df: DataFrame, keys: list[str], value: str, order: list) -> DataFrame:
    """The value of the row that is last in an order, ties broken by the value."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order, F.col(value))).alias(value))


def churn(snapshots: DataFrame, key: str, order: str, items: str) -> DataFrame:
    """Share of items that came or went since the snapshot before, in percent of the list's size."""
    before = F.lag(items).over(Window.partitionBy(key).orderBy(order))
    change = F.size(F.array_except(items, before)) + F.size(F.array_except(before, F.col(items)))
    return snapshots.withColumn("churn", F.when(before.isNotNull(), 100 * change / F.size(items)))
