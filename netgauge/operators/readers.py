"""Readers over measurements, observations and analyses: filter sets, default windows, pages, wide aggregates."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgauge.functions.scalar import bucket
from netgauge.operators.quantiles import beside, quantiles
from netgauge.sources.store import written

#: Columns that a list of measurements may be ordered by.
MEASUREMENT_ORDERS = ("measurement_start_time", "input", "probe_cc", "probe_asn", "test_name")
OBSERVATION_ORDERS = ("measurement_start_time", "probe_cc", "probe_asn", "test_name", "hostname")
OBSERVATION_KEYS = ("timestamp", "failure", "hostname", "ip", "probe_cc", "probe_asn", "test_name", "measurement_uid")
MOST_DAYS = 180
PROTOCOLS, OUTCOMES = ("dns", "tcp", "tls"), ("blocked", "down", "ok")


def day_text(day: datetime) -> str:
    return day.strftime("%Y-%m-%d %H:%M:%S")


def window_of(since: str | None, until: str | None, as_of: str, days: int, most: int | None = None) -> tuple[str, str]:
    """A span with its defaults: until tomorrow's midnight, since so many days before; a longer one than `most` days is refused."""
    end = datetime.fromisoformat(until) if until else datetime.fromisoformat(as_of[:10]) + timedelta(days=1)
    begin = datetime.fromisoformat(since) if since else end - timedelta(days=days)
    if most and end - begin > timedelta(days=most):
        raise ValueError(f"a span of at most {most} days can be read at once")
    return day_text(begin), day_text(end)


def within(time: str, since: str, until: str, left: bool = False, right: bool = False) -> Column:
    """since < time < until, either end included on demand."""
    t, a, b = F.col(time), F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")
    return (t >= a if left else t > a) & (t <= b if right else t < b)


def among(df: DataFrame, **chosen: object) -> DataFrame:
    """Columns equal to a value, or among a list of values; None asks nothing."""
    for name, value in chosen.items():
        if value is not None:
            df = df.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    return df


def numbers(asns: list[str | int] | None) -> list[int] | None:
    """Networks as `AS123` or 123."""
    return None if asns is None else [int(str(a).upper().removeprefix("AS")) for a in asns]


def flagged(df: DataFrame, **asked: bool | None) -> DataFrame:
    """Flags in t and f that must be set, must not be, or (None) may be either."""
    return among(df, **{k: None if v is None else "t" if v else "f" for k, v in asked.items()})


def measurements(m: DataFrame, as_of: str, since: str | None = None, until: str | None = None, report_id: str | None = None, probe_cc: list[str] | None = None, probe_asn: list | None = None, anomaly: bool | None = None, confirmed: bool | None = None, failure: bool | None = None, input: str | None = None, domain: list[str] | None = None, category_code: str | None = None, urls: DataFrame | None = None, **chosen: object) -> DataFrame:  # noqa: A002
    """The list's rows: `since` is exclusive, `until` inclusive, an input overrides domain and category.

    Without a country or network the unknown ones are left out; without a report
    id the last 30 days are read.
    """
    if since or until or not report_id:
        m = m.where(within("measurement_start_time", *window_of(since, until, as_of, 30, MOST_DAYS), right=True))
    m = among(m, report_id=report_id, probe_cc=probe_cc, probe_asn=numbers(probe_asn), **chosen)
    m = m if probe_cc else m.where("probe_cc <> 'ZZ'")
    m = m if probe_asn else m.where("probe_asn <> 0")
    m = flagged(m, anomaly=anomaly, confirmed=confirmed, msm_failure=failure)
    if input:
        return among(m, input=input)
    m = among(m, domain=domain)
    return m.join(urls.where(F.col("category_code") == category_code).select(F.col("url").alias("input"), "category_code"), "input") if category_code else m


def observations(ob: DataFrame, as_of: str, since: str | None = None, until: str | None = None, report_id: list[str] | None = None, measurement_uid: list[str] | None = None, probe_asn: list | None = None, **chosen: object) -> DataFrame:
    """Observations of the last 7 days unless a report or a measurement is asked for; each with its target."""
    if since or until or not (report_id or measurement_uid):
        ob = ob.where(within("measurement_start_time", *window_of(since, until, as_of, 7)))
    ob = among(ob, report_id=report_id, measurement_uid=measurement_uid, probe_asn=numbers(probe_asn), **chosen)
    return ob.withColumn("target_id", target_of()) if "tls_server_name" in ob.columns else ob


def target_of() -> Column:
    """The host's name, else that which TLS was asked for."""
    return F.coalesce("hostname", "tls_server_name")


def analyses(an: DataFrame, as_of: str, since: str | None = None, until: str | None = None, measurement_uid: list[str] | None = None, probe_asn: list | None = None, **chosen: object) -> DataFrame:
    """Analyses of the last 30 days unless a measurement is asked for."""
    if since or until or not measurement_uid:
        an = an.where(within("measurement_start_time", *window_of(since, until, as_of, 30)))
    return among(an, measurement_uid=measurement_uid, probe_asn=numbers(probe_asn), **chosen)


def changepoints(cp: DataFrame, as_of: str, since: str | None = None, until: str | None = None, **chosen: object) -> DataFrame:
    """Change points of a span, both ends included; NaN reads null, a direction of -1 `down`, any other `up`."""
    cp = among(cp.where(within("ts", *window_of(since, until, as_of, 30), left=True, right=True)), **chosen)
    floats = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in cp.schema if f.dataType.simpleString() in ("float", "double")}
    direction = F.when(F.col("change_dir") == -1, "down").when(F.col("change_dir").isNotNull(), "up")
    return cp.withColumns(floats | {"change_dir": direction}).withColumnRenamed("ts", "start_time")


def ordered(rows: DataFrame, order_by: str, order: str, allowed: tuple[str, ...], unique: str) -> DataFrame:
    """By one of the columns allowed, ties by a unique one."""
    if order_by not in allowed or order.lower() not in ("asc", "desc"):
        raise ValueError(f"order by one of {', '.join(allowed)}, asc or desc")
    return rows.orderBy(F.col(order_by).asc() if order.lower() == "asc" else F.col(order_by).desc(), unique)


def page(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset not negative")
    return rows.offset(offset).limit(limit)


def page_facts(rows: DataFrame, offset: int, limit: int) -> DataFrame:
    """offset, limit, current_page, and count and pages, which are known (else -1) where the page is the last."""
    n = F.count("*")
    last = n < limit
    count = offset + n
    return page(rows, offset, limit).agg(F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), F.lit(-(-offset // limit) + 1).alias("current_page"), F.when(last, count).otherwise(-1).alias("count"), F.when(last, F.ceil(count / limit)).otherwise(-1).alias("pages"))


def without_detail(failure: Column) -> Column:
    return F.when(failure.startswith("unknown_failure"), "unknown_failure").otherwise(failure)


def first_failure() -> Column:
    """The first layer that failed, DNS by whose resolver it was; `none` if none did."""
    named = lambda prefix, c: F.concat(F.lit(prefix), without_detail(F.col(c)))
    dns = F.when(F.col("resolver_asn") == F.col("probe_asn"), named("dns_isp.", "dns_failure")).otherwise(named("dns_other.", "dns_failure"))
    http = F.when(F.col("tls_used"), named("https.", "http_failure")).otherwise(named("http.", "http_failure"))
    return F.when(F.col("dns_failure").isNotNull(), dns).otherwise(F.coalesce(named("tcp.", "tcp_failure"), named("tls.", "tls_failure"), http, F.lit("none")))


def observation_counts(ob: DataFrame, group_by: list[str], grain: str = "day", **chosen: list) -> DataFrame:
    """Counts by any of OBSERVATION_KEYS; a filter's column is grouped by too. Grouping by failure leaves out rows without a DNS failure or an address."""
    unknown = set(group_by) - set(OBSERVATION_KEYS)
    if unknown:
        raise ValueError(f"can't group by {', '.join(sorted(unknown))}")
    keys = list(dict.fromkeys([*group_by, *(k for k, v in chosen.items() if v)]))
    ob = among(ob, **{k: v or None for k, v in chosen.items()})
    if "failure" in keys:
        ob = ob.where("dns_failure is not null or ip is not null").withColumn("failure", first_failure())
    if "timestamp" in keys:
        ob = ob.withColumn("timestamp", bucket(F.col("measurement_start_time"), grain))
    return ob.groupBy(*keys).agg(F.count("*").alias("observation_count"))


def top_weighted(rows: DataFrame, keys: list[str], value: str, weight: Column, k: int = 10) -> DataFrame:
    """The k values of most weight for each key, exactly: rows (keys, value, weight, rank), nulls left out."""
    w = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("weight"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), value))).where(F.col("rank") <= k)


def likelihoods(an: DataFrame, keys: list[str]) -> DataFrame:
    """analyses -> for each key: quantiles of blocked, down and ok by protocol, the majority's label, the failure of most weight by protocol, what is likely blocked.

    The weights are the integer percentages of being blocked. `likely` lists the
    protocols above 0.5, the likeliest first, with their failures; `blocked_max`
    is its first, or `none` with 0.
    """
    dns = F.when(F.col("top_dns_failure").isin("android_dns_cache_no_data", "dns_nxdomain_error"), "nxdomain").otherwise(F.coalesce("top_dns_failure", F.lit("got_answer")))
    an = an.withColumns({"_dns": without_detail(dns), "_tcp": without_detail(F.col("top_tcp_failure")), "_tls": without_detail(F.col("top_tls_failure"))})
    targets = [(f"{p}_{o}", f"{p}_{o}", 0.95) for p in PROTOCOLS for o in OUTCOMES]
    # All that is counted comes from one grouped scan: a row for each label and combination of failures.
    counted = written(an.groupBy(*keys, "top_probe_analysis", *[f"_{p}" for p in PROTOCOLS]).agg(F.count("*").alias("c"), *[F.sum(F.floor(F.col(f"{p}_blocked") * 100 + 1e-7)).alias(f"{p}_weight") for p in PROTOCOLS]))
    labels = counted.groupBy(*keys, "top_probe_analysis").agg(F.sum("c").alias("c")).groupBy(*keys).agg(F.sum("c").alias("count"), F.min_by("top_probe_analysis", F.struct(-F.col("c"), F.col("top_probe_analysis"))).alias("probe_analysis"))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("protocol"), F.col(f"_{p}").alias("failure"), F.col(f"{p}_weight").alias("weight")) for p in PROTOCOLS])).alias("f")
    weighed = counted.select(*keys, each).where("f.failure is not null").groupBy(*keys, "f.protocol", "f.failure").agg(F.sum("f.weight").alias("weight"))
    first = [F.min(F.when(F.col("protocol") == p, F.struct((-F.col("weight")).alias("w"), "failure")))["failure"].alias(f"{p}_blocked_outcome") for p in PROTOCOLS]
    out = beside(quantiles(an, keys, targets), labels, keys)
    out = beside(out, weighed.groupBy(*keys).agg(*first), keys, "left").withColumns({f"{p}_blocked_outcome": F.coalesce(f"{p}_blocked_outcome", F.lit("")) for p in PROTOCOLS})
    protocols = F.array(*[F.struct((-F.col(f"{p}_blocked")).alias("o"), F.lit(i).alias("i"), F.concat(F.lit(f"{p}."), f"{p}_blocked_outcome").alias("name"), F.col(f"{p}_blocked").alias("blocked")) for i, p in enumerate(PROTOCOLS)])
    likely = F.transform(F.array_sort(F.filter(protocols, lambda x: x["blocked"] > 0.5)), lambda x: F.struct(x["name"].alias("name"), x["blocked"].alias("blocked")))
    none = F.struct(F.lit("none").alias("name"), F.lit(0.0).alias("blocked"))
    return out.withColumn("likely", likely).withColumn("blocked_max", F.coalesce(F.get("likely", F.lit(0)), none))


def any_heavy(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value of each key, the smallest of equally common ones."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_c"), F.col(value))).alias(value))


def canonical_domains(domains: DataFrame, urls: DataFrame) -> DataFrame:
    """domains(domain) -> canonical_domain, category_code: of the shortest URL under the domain, with or without `www.`, global lists first; MISC where no list has it."""
    bare = F.regexp_replace("domain", r"^www\.", "")
    forms = domains.select("domain", bare.alias("bare")).distinct().select("domain", "bare", F.explode(F.array(F.col("bare"), F.concat(F.lit("www."), "bare"))).alias("form"))
    best = F.min_by(F.struct("form", "category_code"), F.struct(F.upper("cc") != "ZZ", F.length("url"), F.col("url"), F.col("category_code")))
    listed = urls.select(F.col("domain").alias("form"), "cc", "url", "category_code")
    chosen = forms.join(listed, "form").groupBy("domain").agg(best.alias("b"))
    return forms.select("domain", "bare").distinct().join(chosen, "domain", "left").select("domain", F.coalesce("b.form", "bare").alias("canonical_domain"), F.coalesce("b.category_code", F.lit("MISC")).alias("category_code"))


def feedback(votes: DataFrame, account: object) -> DataFrame:
    """votes(measurement_uid, account_id, status, update_time), the last of each account counts -> n by measurement and status, and whether it is the account's own."""
    last = votes.groupBy("measurement_uid", "account_id").agg(F.max_by("status", F.struct("update_time", "status")).alias("status"))
    return last.groupBy("measurement_uid", "status").agg(F.count("*").alias("n"), F.max(F.col("account_id") == account).alias("mine"))
