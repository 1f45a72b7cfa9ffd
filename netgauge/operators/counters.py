"""Counter aggregates over scored measurements."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgauge.functions.scalar import bucket

AXES = ("blocking_type", "category_code", "domain", "input", "measurement_start_day", "probe_asn", "probe_cc", "test_name")
#: Days of a span -> grains allowed for it, the first of which is `auto`.
GRAINS = ((7, ("hour", "day")), (30, ("day", "week")), (365, ("day", "week", "month")), (10**9, ("day", "week", "month", "year")))


def counters() -> dict[str, Column]:
    """Disjoint counts of outcomes; with flags in t and f they add up to the total."""
    a, c, f = F.col("anomaly"), F.col("confirmed"), F.col("msm_failure")
    return {
        "anomaly_count": F.count_if((a == "t") & (c == "f") & (f == "f")),
        "confirmed_count": F.count_if((c == "t") & (f == "f")),
        "failure_count": F.count_if(f == "t"),
        "ok_count": F.count_if((a == "f") & (c == "f") & (f == "f")),
        "measurement_count": F.count("*"),
    }


def grain_for(since: str, until: str, asked: str) -> str:
    days = (datetime.fromisoformat(until) - datetime.fromisoformat(since)).days
    allowed = next(g for most, g in GRAINS if days <= most)
    if asked == "auto":
        return allowed[0]
    if asked not in allowed:
        raise ValueError(f"grain {asked} isn't allowed over {days} days; allowed: {', '.join(allowed)}")
    return asked


def filtered(m: DataFrame, since: str | None = None, until: str | None = None, **chosen: object) -> DataFrame:
    """since <= start < until, and columns equal to a value or among a list of values."""
    if since:
        m = m.where(F.col("measurement_start_time") >= F.lit(since).cast("timestamp"))
    if until:
        m = m.where(F.col("measurement_start_time") < F.lit(until).cast("timestamp"))
    for name, value in chosen.items():
        if value is not None:
            m = m.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return m


def aggregate(m: DataFrame, axes: tuple[str, ...] = (), urls: DataFrame | None = None, grain: str = "day", category_code: str | None = None, probe_cc: str | None = None, **chosen: object) -> DataFrame:
    """Counts along up to two axes, in their order. URL categories join only if they are asked for, and multiply rows as lists do."""
    if len(axes) > 2 or len(set(axes)) < len(axes) or not set(axes) <= set(AXES):
        raise ValueError(f"axes must be at most two different ones of {', '.join(AXES)}")
    m = filtered(m, probe_cc=probe_cc, **chosen)
    if "category_code" in axes or category_code:
        lists = urls.select(F.col("url").alias("input"), "category_code", F.col("cc").alias("list_cc"))
        if category_code:
            wanted = [c for c in ("zz", probe_cc and probe_cc.lower()) if c]
            lists = lists.where((F.col("category_code") == category_code) & F.lower("list_cc").isin(*wanted))
        m = m.join(lists.drop("list_cc"), "input")
    if "measurement_start_day" in axes:
        m = m.withColumn("measurement_start_day", bucket(F.col("measurement_start_time"), grain))
    if not axes:
        return m.agg(*[c.alias(n) for n, c in counters().items()])
    return m.groupBy(*axes).agg(*[c.alias(n) for n, c in counters().items()]).orderBy(*axes)


def dense(counts: DataFrame, days: DataFrame, keys: DataFrame | None, by: list[str], value: str) -> DataFrame:
    """Fills the grid of keys and days with 0 where there are no rows. Both sides of the grid are small: names times calendar days."""
    grid = days if keys is None else keys.crossJoin(days)
    return grid.join(counts, by, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def ground_truth(controls: DataFrame, cloud_asns: list[int]) -> DataFrame:
    """controls(hostname, ip, port, ip_asn, ip_as_org_name, *_failure) -> outcomes by endpoint, and of its host and address as windows over the aggregate."""
    seen = lambda c: F.col(f"{c}_failure").isNull()
    nx = F.col("dns_failure") == "dns_nxdomain_error"
    g = controls.groupBy("hostname", "ip", "port").agg(
        F.max("ip_asn").alias("asn"), F.max("ip_as_org_name").alias("as_org_name"), F.coalesce(F.bool_or(F.col("ip_asn").isin(*cloud_asns)), F.lit(False)).alias("is_cloud_provider"),
        F.count_if(seen("dns")).alias("row_dns_success_count"), F.count_if(nx).alias("row_dns_nxdomain_count"), F.count_if(~seen("dns") & ~nx).alias("row_dns_other_failure_count"),
        *[c.alias(f"{p}_{n}_count") for p in ("tcp", "tls") for n, c in (("success", F.count_if(seen(p))), ("failure", F.count_if(~seen(p))))],
    )
    host = Window.partitionBy("hostname")
    sums = {f"dns_{n}_count": F.sum(f"row_dns_{n}_count").over(host) for n in ("success", "nxdomain", "other_failure")}
    return g.withColumns({"in_dns_answers": F.col("row_dns_success_count") > 0, "tls_consistent": F.max(F.col("tls_success_count") > 0).over(Window.partitionBy("hostname", "ip"))} | sums)
