"""Readers and writers of measurement archives and reference lists."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgauge.functions.scalar import expected_countries, valid_url


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One measurement a line -> body, v (VARIANT); lines that don't parse are left out."""
    return spark.read.text(path).select(F.col("value").alias("body"), F.try_parse_json("value").alias("v")).where("v is not null")


def posts(spark: SparkSession, path: str) -> DataFrame:
    """Enveloped posts, one a file: {"format": "json", "content": ...} -> measurement_uid (the file's name), v."""
    d = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1).alias("measurement_uid"), F.try_parse_json("value").alias("e"))
    format_, content = F.try_variant_get("e", "$.format", "string"), F.try_variant_get("e", "$.content", "variant")
    return d.where(F.col("e").isNotNull() & (format_.isNull() | (format_ == "json"))).select("measurement_uid", F.when(format_ == "json", content).otherwise(F.col("e")).alias("v"))


def archive(spark: SparkSession, path: str, since: str, until: str, countries: list[str] | None = None, tests: list[str] | None = None) -> DataFrame:
    """Bundles partitioned by day, cc and test; only the partitions asked for are listed and read (until is exclusive)."""
    d = spark.read.option("basePath", path).text(path).where((F.col("_metadata.file_size") > 0) & (F.col("day").cast("string") >= since) & (F.col("day").cast("string") < until))
    if countries:
        d = d.where(F.col("cc").isin(*countries))
    return d.where(F.col("test").isin(*tests)) if tests else d


def url_lists(spark: SparkSession, path: str, least: int = 20_000, most: int = 1_000_000) -> DataFrame:
    """CSV files named by country (`global` is ZZ) -> url, cc, category_code; bad URLs go; the number of rows must be plausible."""
    d = spark.read.option("header", True).csv(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([a-z]+)\.csv$", 1)
    out = d.select("url", F.when(stem == "global", "ZZ").otherwise(F.upper(stem)).alias("cc"), "category_code").where(valid_url(F.col("url")) & (F.length("cc") == 2))
    return gated(out, least, most)


def asn_names(spark: SparkSession, path: str) -> DataFrame:
    """{asn: [[org, cc, yyyymmdd, aut, source], ...]} -> a row an entry."""
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("asn", "entries"))
    e = m.select(F.col("asn").cast("long").alias("asn"), F.explode("entries").alias("e"))
    return e.select("asn", *[F.get("e", F.lit(i)).alias(n) for i, n in ((0, "org_name"), (1, "cc"))], F.to_date(F.get("e", F.lit(2)), "yyyyMMdd").alias("changed"), *[F.get("e", F.lit(i)).alias(n) for i, n in ((3, "aut_name"), (4, "source"))])


def gated(df: DataFrame, least: int, most: int) -> DataFrame:
    """Refuses a refresh whose row count is implausible."""
    n = df.count()
    if not least <= n <= most:
        raise ValueError(f"{n} rows; expected {least} to {most}")
    return df


def export_months(fact: DataFrame, path: str, time: str = "measurement_start_time") -> None:
    """CSV by month; months without rows leave no file."""
    fact.withColumn("yyyymm", F.date_format(time, "yyyyMM")).write.partitionBy("yyyymm").option("header", True).option("compression", "gzip").mode("overwrite").csv(path)


def fingerprint_lists(spark: SparkSession, path: str) -> DataFrame:
    """CSV of fingerprints -> typed columns; expected countries as an array."""
    d = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return d.withColumns({"confidence_no_fp": F.col("confidence_no_fp").try_cast("int"), "expected_countries": expected_countries(F.coalesce("expected_countries", F.lit("")))})


def swapped(df: DataFrame, path: str, least: int, most: int) -> DataFrame:
    """Load and swap: the rows are written beside the current ones, counted there, and become current only if their number is plausible."""
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/{version}")
    gated(spark.read.parquet(f"{path}/{version}"), least, most)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}-current")
    return current(spark, path)


def current(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}-current').first()[0]}")


def without_secrets(posts_: DataFrame) -> DataFrame:
    """(measurement_uid, v) of posts -> v with only the fields that may be stored."""
    keep = ("content", "format", "protocol_version", "manifest_version")
    fields = F.map_filter(F.try_variant_get("v", "$", "map<string,variant>"), lambda k, _: k.isin(*keep))
    return posts_.withColumn("v", F.try_parse_json(F.to_json(fields)))


def export_chunks(table: DataFrame, path: str, rows: int = 100_000_000) -> None:
    """CSV files of at most so many rows each; the columns are the table's own."""
    table.write.option("maxRecordsPerFile", rows).option("header", True).option("compression", "gzip").mode("overwrite").csv(path)


def export_result(result: DataFrame, path: str) -> None:
    """CSV with the columns in alphabetical order; a result without rows is an empty file."""
    result = result.select(*sorted(result.columns))
    result.write.option("header", not result.isEmpty()).mode("overwrite").csv(path)


def export_table(spark: SparkSession, name: str, path: str) -> None:
    """A small table as one CSV file, the columns those of the catalog."""
    spark.table(name).select(*[c.name for c in spark.catalog.listColumns(name)]).coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def newer_rows(fact: DataFrame, key: str, watermark: object, until: object) -> DataFrame:
    """Rows that a table hasn't got yet: after the watermark and before `until`; missing inputs and domains become ''."""
    return fact.where((F.col(key) > watermark) & (F.col(key) < until)).withColumns({c: F.coalesce(c, F.lit("")) for c in ("input", "domain") if c in fact.columns})


def sync(fact: DataFrame, key: str, watermark: object, until: object, path: str) -> object:
    """Writes what is new and gives the next watermark, that of the rows written; it moves only after the write."""
    part = f"{path}/after={watermark}"  # a repeated sync after a failure overwrites its own rows
    newer_rows(fact, key, watermark, until).write.mode("overwrite").parquet(part)
    last = fact.sparkSession.read.parquet(part).agg(F.max(key)).first()[0]
    return watermark if last is None else last


def replayed_posts(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    """Failed posts as a stream, so many a batch; a file goes once its batch is done."""
    return spark.readStream.option("maxFilesPerTrigger", files).option("cleanSource", "delete").text(path, wholetext=True).select("value")
