"""All registered queries of the measurement engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netgauge.functions import legacy, scalar, scoring
from netgauge.operators import counters, detector, priority, versioned
from netgauge.operators.quantiles import beside, quantiles
from netgauge.plans import views
from netgauge.plans.views import AM, AS_OF, CZ, OB, RL, M

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

COUNTERS = """count(*) filter (where anomaly = 't' and confirmed = 'f' and msm_failure = 'f') as anomaly_count, count(*) filter (where confirmed = 't' and msm_failure = 'f') as confirmed_count,
  count(*) filter (where msm_failure = 't') as failure_count, count(*) filter (where anomaly = 'f' and confirmed = 'f' and msm_failure = 'f') as ok_count, count(*) as measurement_count"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def msm(s: SparkSession, d: str) -> DataFrame:
    return views.measurements(s, d)


def day() -> F.Column:
    return F.to_date("measurement_start_time")


# ---- counters ----


@query(f"with {M} select cast(measurement_start_time as date) as measurement_start_day, test_name, {COUNTERS} from m group by 1, 2")
def a1_counters_day_test(s: SparkSession, d: str) -> DataFrame:
    r = counters.aggregate(msm(s, d), ("measurement_start_day", "test_name"))
    return r.withColumn("measurement_start_day", F.to_date("measurement_start_day"))


@query(f"with {M} select {COUNTERS} from m where probe_cc in ('AZ', 'BY') and test_name = 'torsf'")
def a1_counters_total(s: SparkSession, d: str) -> DataFrame:
    return counters.aggregate(counters.filtered(msm(s, d), probe_cc=["AZ", "BY"], test_name="torsf"))


@query(f"with {M}, {CZ} select category_code, probe_cc, {COUNTERS} from m join cz on input = url group by 1, 2")
def j1_counters_by_category(s: SparkSession, d: str) -> DataFrame:
    return counters.aggregate(msm(s, d), ("category_code", "probe_cc"), urls=views.url_list(s, d))


@query(f"with {M}, {CZ} select domain, {COUNTERS} from (select m.* from m join cz on input = url where category_code = 'ECON' and cc in ('zz', 'az') and probe_cc = 'AZ') group by 1")
def j1_counters_one_category(s: SparkSession, d: str) -> DataFrame:
    return counters.aggregate(msm(s, d), ("domain",), urls=views.url_list(s, d), category_code="ECON", probe_cc="AZ")


@query(f"with {M} select date_trunc('week', measurement_start_time + interval 1 day) - interval 1 day as week, blocking_type, {COUNTERS} from m group by 1, 2")
def d2_counters_by_sunday_week(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).withColumn("week", scalar.bucket(F.col("measurement_start_time"), "week"))
    return m.groupBy("week", "blocking_type").agg(*[c.alias(n) for n, c in counters.counters().items()])


@query(f"with {M} select date_trunc('hour', measurement_start_time) as hour, probe_cc, {COUNTERS} from m where measurement_start_time >= timestamp '2024-01-10' and measurement_start_time < timestamp '2024-01-17' group by 1, 2")
def a2_counters_by_hour(s: SparkSession, d: str) -> DataFrame:
    since, until = "2024-01-10", "2024-01-17"
    m = counters.filtered(msm(s, d), since, until).withColumn("hour", scalar.bucket(F.col("measurement_start_time"), counters.grain_for(since, until, "auto")))
    return m.groupBy("hour", "probe_cc").agg(*[c.alias(n) for n, c in counters.counters().items()])


@query(f"with {M} select strftime(measurement_start_time, '%Y%m') as month, count(distinct probe_asn) as networks, count(distinct probe_cc) as countries, count(*) as measurements from m group by 1")
def a3_distinct_by_month(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).groupBy(F.date_format("measurement_start_time", "yyyyMM").alias("month")).agg(F.countDistinct("probe_asn").alias("networks"), F.countDistinct("probe_cc").alias("countries"), F.count("*").alias("measurements"))


@query(f"with {M} select probe_cc, count(*) as n from m group by 1")
def a4_countries(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).groupBy("probe_cc").agg(F.count("*").alias("n"))


def calendar(s: SparkSession, days: int) -> DataFrame:
    return s.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(AS_OF).cast("date"), days - 1), F.lit(AS_OF).cast("date"))).alias("day"))


DAYS = "days as (select cast(date '2024-01-31' - cast(i as integer) as date) as day from (select unnest(range({n})) as i))"


@query(f"""with {M}, {DAYS.format(n=30)}, g as (select distinct platform as test_group from m), c as (select cast(measurement_start_time as date) as day, platform as test_group, count(*) as n from m where probe_cc = 'BY' group by 1, 2)
select g.test_group, days.day, coalesce(n, 0) as n from g cross join days left join c on c.day = days.day and c.test_group = g.test_group""")
def a5_test_coverage(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).withColumnRenamed("platform", "test_group")
    counts = m.where("probe_cc = 'BY'").groupBy(day().alias("day"), "test_group").agg(F.count("*").alias("n"))
    return counters.dense(counts, calendar(s, 30), m.select("test_group").distinct(), ["test_group", "day"], "n")


@query(f"""with {M}, {DAYS.format(n=31)}, c as (select cast(measurement_start_time as date) as day, count(distinct probe_asn) as networks from m where probe_cc = 'AZ' group by 1)
select days.day, coalesce(networks, 0) as networks from days left join c using (day)""")
def a6_network_coverage(s: SparkSession, d: str) -> DataFrame:
    counts = msm(s, d).where("probe_cc = 'AZ'").groupBy(day().alias("day")).agg(F.countDistinct("probe_asn").alias("networks"))
    return counters.dense(counts, calendar(s, 31), None, ["day"], "networks")


@query(f"with {M} select probe_asn, count(*) as n from m where probe_cc = 'AZ' and test_name = 'web_connectivity' group by 1")
def a7_networks_of_country(s: SparkSession, d: str) -> DataFrame:
    return counters.filtered(msm(s, d), probe_cc="AZ", test_name="web_connectivity").groupBy("probe_asn").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "probe_asn")


@query(f"with {M} select cast(measurement_start_time as date) as day, {COUNTERS} from m where probe_cc = 'AZ' and probe_asn = 25 and input = 'http://d12.example/' group by 1")
def a8_url_stats(s: SparkSession, d: str) -> DataFrame:
    m = counters.filtered(msm(s, d), probe_cc="AZ", probe_asn=25, input="http://d12.example/")
    return m.groupBy(day().alias("day")).agg(*[c.alias(n) for n, c in counters.counters().items()])


@query(f"with {M} select input, {COUNTERS} from m where probe_cc = 'AZ' and input <> '' group by 1 order by confirmed_count desc, measurement_count desc, anomaly_count desc, input limit 20 offset 10")
def a9_url_page(s: SparkSession, d: str) -> DataFrame:
    r = counters.aggregate(msm(s, d).where("input <> ''"), ("input",), probe_cc="AZ")
    return r.orderBy(F.desc("confirmed_count"), F.desc("measurement_count"), F.desc("anomaly_count"), "input").offset(10).limit(20)


@query(f"""with {M}, n as (select probe_asn, count(*) filter (where msm_failure = 't') as failures, max(measurement_start_time) as last_tested, count(*) as total, count(*) - count(*) filter (where anomaly = 't') as success from m where probe_cc = 'AZ' group by 1)
select *, not (total > 5 and success / total < 0.6) as ok from n""")
def a10_network_success(s: SparkSession, d: str) -> DataFrame:
    n = msm(s, d).where("probe_cc = 'AZ'").groupBy("probe_asn").agg(F.count_if(F.col("msm_failure") == "t").alias("failures"), F.max("measurement_start_time").alias("last_tested"), F.count("*").alias("total"), F.count_if(F.col("anomaly") == "f").alias("success"))
    return n.withColumn("ok", ~((F.col("total") > 5) & (F.col("success") / F.col("total") < 0.6)))


@query(f"""with {M}, c as (select test_name, probe_asn, count(*) as n, max(measurement_start_time) as last_tested from m where test_name in ('whatsapp', 'signal') group by 1, 2)
select test_name, count(*) as networks, cast(sum(n) as bigint) as total, max(last_tested) as last_tested, list(probe_asn order by probe_asn) as asns from c group by 1""")
def a12_im_networks(s: SparkSession, d: str) -> DataFrame:
    c = counters.filtered(msm(s, d), test_name=["whatsapp", "signal"]).groupBy("test_name", "probe_asn").agg(F.count("*").alias("n"), F.max("measurement_start_time").alias("last_tested"))
    return c.groupBy("test_name").agg(F.count("*").alias("networks"), F.sum("n").alias("total"), F.max("last_tested").alias("last_tested"), F.sort_array(F.collect_list("probe_asn")).alias("asns"))


@query(f"with {AM} select asn, arg_max(org_name, (changed, org_name)) as org_name from am group by 1")
def a13_latest_org(s: SparkSession, d: str) -> DataFrame:
    return versioned.value_by(views.asn_history(s, d), ["asn"], "org_name", [F.col("changed")])


@query(f"""with {M}, {DAYS.format(n=32)}, c as (select cast(measurement_start_time as date) as day, count(*) as n from m where probe_cc = 'BY' and test_name = 'signal' group by 1)
select days.day, coalesce(n, 0) as n from days left join c using (day)""")
def a14_im_stats(s: SparkSession, d: str) -> DataFrame:
    counts = counters.filtered(msm(s, d), probe_cc="BY", test_name="signal").groupBy(day().alias("day")).agg(F.count("*").alias("n"))
    return counters.dense(counts, calendar(s, 32), None, ["day"], "n")


@query(f"with {M} select min(measurement_start_time) as first_measurement, count(*) as measurements, count(distinct probe_asn) as networks from m where probe_cc = 'CX' and measurement_start_time > timestamp '2012-12-01'")
def a15_country_overview(s: SparkSession, d: str) -> DataFrame:
    return counters.filtered(msm(s, d), since="2012-12-01", probe_cc="CX").agg(F.min("measurement_start_time").alias("first_measurement"), F.count("*").alias("measurements"), F.countDistinct("probe_asn").alias("networks"))


@query(f"with {M} select count(distinct probe_asn) as networks, count(distinct probe_cc) as countries, count(*) as measurements from m")
def a16_global_overview(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).agg(F.countDistinct("probe_asn").alias("networks"), F.countDistinct("probe_cc").alias("countries"), F.count("*").alias("measurements"))


@query(f"with {M} select probe_cc, count(*) as n from m where test_name = 'torsf' and measurement_start_time > date '2024-01-31' - interval 6 month and measurement_start_time < date '2024-01-31' group by 1")
def a17_circumvention_by_country(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where(F.col("measurement_start_time") > F.add_months(F.lit(AS_OF).cast("date"), -6)).where(F.col("measurement_start_time") < F.lit(AS_OF).cast("date"))
    return m.where("test_name = 'torsf'").groupBy("probe_cc").agg(F.count("*").alias("n"))


@query(f"""with {M}, r as (select cast(measurement_start_time as date) as day, probe_cc, test_name, quantile_cont(runtime, 0.5) as p50, quantile_cont(runtime, 0.9) as p90, count(*) as n
  from m where runtime is not null group by 1, 2, 3) select day, probe_cc, test_name, round(p50, 6) as p50, round(p90, 6) as p90, n from r""")
def a18_runtime_quantiles(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).withColumn("runtime", F.get_json_object("scores", "$.extra.test_runtime").cast("double")).where("runtime is not null")
    m, keys = m.select(day().alias("day"), "probe_cc", "test_name", "runtime"), ["day", "probe_cc", "test_name"]
    q = quantiles(m, keys, [("p50", "runtime", 0.5), ("p90", "runtime", 0.9)])
    return beside(q, m.groupBy(*keys).agg(F.count("*").alias("n")), keys).select(*keys, F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "n")


@query(f"""with {M} select cast(measurement_start_time as date) as day, probe_cc, count(*) filter (where anomaly = 't') as anomalies, count(*) as measurements,
  round(count(*) filter (where anomaly = 't') / count(*), 6) as anomaly_rate from m where test_name = 'torsf' group by 1, 2""")
def a19_torsf_stats(s: SparkSession, d: str) -> DataFrame:
    r = msm(s, d).where("test_name = 'torsf'").groupBy(day().alias("day"), "probe_cc").agg(F.count_if(F.col("anomaly") == "t").alias("anomalies"), F.count("*").alias("measurements"))
    return r.withColumn("anomaly_rate", F.round(F.col("anomalies") / F.col("measurements"), 6))


# ---- observations ----

def failure_column() -> F.Column:
    """The first layer that failed, DNS by whose resolver it was."""
    dns = F.concat(F.when(F.col("resolver_asn") == F.col("probe_asn"), "dns_isp.").otherwise("dns_other."), F.col("dns_failure"))
    http = F.concat(F.when(F.col("tls_used"), "https.").otherwise("http."), F.col("http_failure"))
    return F.coalesce(dns, F.concat(F.lit("tcp."), "tcp_failure"), F.concat(F.lit("tls."), "tls_failure"), http, F.lit("none"))


FAILURE_SQL = """coalesce(case when resolver_asn = probe_asn then 'dns_isp.' else 'dns_other.' end || dns_failure, 'tcp.' || tcp_failure, 'tls.' || tls_failure, case when tls_used then 'https.' else 'http.' end || http_failure, 'none')"""


@query(f"with {OB} select {FAILURE_SQL} as failure, hostname, cast(measurement_start_time as date) as day, count(*) as n from ob group by 1, 2, 3")
def a23_observation_counts(s: SparkSession, d: str) -> DataFrame:
    return views.observations(s, d).groupBy(failure_column().alias("failure"), "hostname", day().alias("day")).agg(F.count("*").alias("n"))


@query(f"""with {OB}, q as (select probe_cc, probe_asn, quantile_cont(dns_blocked, 0.95) as dq, quantile_cont(tcp_blocked, 0.95) as tq, quantile_cont(tls_blocked, 0.95) as lq, count(*) as n from ob group by 1, 2),
l as (select probe_cc, probe_asn, label, count(*) as c from ob group by 1, 2, 3),
t as (select probe_cc, probe_asn, label from (select *, row_number() over (partition by probe_cc, probe_asn order by c desc, label) as rn from l) where rn = 1)
select q.probe_cc, q.probe_asn, round(dq, 6) as dns_blocked_q95, round(tq, 6) as tcp_blocked_q95, round(lq, 6) as tls_blocked_q95, n, t.label as top_label,
  case when greatest(dq, tq, lq) <= 0.5 then 'none' when dq >= tq and dq >= lq then 'dns' when tq >= lq then 'tcp' else 'tls' end as likely_blocked
from q join t on t.probe_cc = q.probe_cc and t.probe_asn = q.probe_asn""")
def a20_likelihoods(s: SparkSession, d: str) -> DataFrame:
    o = views.observations(s, d)
    keys = ["probe_cc", "probe_asn"]
    q = o.groupBy(*keys).agg(*[F.percentile(f"{p}_blocked", F.lit(0.95)).alias(p) for p in ("dns", "tcp", "tls")], F.count("*").alias("n"))
    labels = o.groupBy(*keys, "label").agg(F.count("*").alias("c"))
    top = labels.groupBy(*keys).agg(F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("top_label"))
    ranked = F.array_sort(F.filter(F.array(*[F.struct((-F.col(p)).alias("o"), F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(("dns", "tcp", "tls"))]), lambda x: -x["o"] > 0.5))
    return q.join(top, keys).select(*keys, *[F.round(p, 6).alias(f"{p}_blocked_q95") for p in ("dns", "tcp", "tls")], "n", "top_label", F.coalesce(F.get(ranked, F.lit(0))["p"], F.lit("none")).alias("likely_blocked"))


@query(f"""with {OB}, w as (select hostname, case when dns_failure in ('dns_nxdomain_error', 'android_dns_cache_no_data') then 'dns_nxdomain_error' when dns_failure like 'unknown_failure%' then 'unknown_failure' else coalesce(dns_failure, 'got_answer') end as failure,
  cast(sum(cast(floor(dns_blocked * 100 + 0.0000001) as bigint)) as bigint) as weight from ob group by 1, 2)
select hostname, failure, weight, rank from (select *, row_number() over (partition by hostname order by weight desc, failure) as rank from w) where rank <= 10""")
def a21_top_failures_weighted(s: SparkSession, d: str) -> DataFrame:
    f = F.col("dns_failure")
    name = F.when(f.isin("dns_nxdomain_error", "android_dns_cache_no_data"), "dns_nxdomain_error").when(f.startswith("unknown_failure"), "unknown_failure").otherwise(F.coalesce(f, F.lit("got_answer")))
    w = views.observations(s, d).groupBy("hostname", name.alias("failure")).agg(F.sum(F.floor(F.col("dns_blocked") * 100 + 1e-7)).alias("weight"))
    return w.withColumn("rank", F.row_number().over(Window.partitionBy("hostname").orderBy(F.desc("weight"), "failure"))).where("rank <= 10")


@query(f"""with {OB}, g as (select hostname, ip, count(*) filter (where dns_failure is null) as dns_ok, count(*) filter (where dns_failure is not null) as dns_failed, count(*) filter (where tcp_failure is null) as tcp_ok,
  count(*) filter (where tls_failure is null) as tls_ok from ob group by 1, 2)
select *, max(tls_ok) over (partition by hostname, ip) as tls_ok_of_ip, cast(sum(dns_ok) over (partition by hostname) as bigint) as dns_ok_of_host, cast(sum(dns_failed) over (partition by hostname) as bigint) as dns_failed_of_host from g""")
def a24_control_ground_truth(s: SparkSession, d: str) -> DataFrame:
    o = views.observations(s, d)
    g = o.groupBy("hostname", "ip").agg(F.count_if(F.col("dns_failure").isNull()).alias("dns_ok"), F.count_if(F.col("dns_failure").isNotNull()).alias("dns_failed"), F.count_if(F.col("tcp_failure").isNull()).alias("tcp_ok"), F.count_if(F.col("tls_failure").isNull()).alias("tls_ok"))
    host = Window.partitionBy("hostname")
    return g.withColumns({"tls_ok_of_ip": F.max("tls_ok").over(Window.partitionBy("hostname", "ip")), "dns_ok_of_host": F.sum("dns_ok").over(host), "dns_failed_of_host": F.sum("dns_failed").over(host)})


# ---- joins with small tables ----


@query(f"""with {M}, {AM}, o as (select asn, arg_max(org_name, (changed, org_name)) as org_name from am group by 1), c as (select probe_asn, count(*) as n from m group by 1)
select probe_asn, n, coalesce(org_name, '') as org_name from c left join o on o.asn = c.probe_asn""")
def j6_networks_with_org(s: SparkSession, d: str) -> DataFrame:
    c = msm(s, d).groupBy("probe_asn").agg(F.count("*").alias("n"))
    return c.join(a13_latest_org(s, d).withColumnRenamed("asn", "probe_asn"), "probe_asn", "left").withColumn("org_name", F.coalesce("org_name", F.lit("")))


@query(f"""with {M}, {CZ}, k as (select domain, min_by(category_code, (cc <> 'zz', category_code)) as category_code from cz group by 1), c as (select domain, count(*) as n from m group by 1)
select k.domain, category_code, coalesce(n, 0) as n from k left join c on c.domain = k.domain""")
def j7_domains(s: SparkSession, d: str) -> DataFrame:
    k = views.url_list(s, d).groupBy("domain").agg(F.min_by("category_code", F.struct(F.col("cc") != "zz", F.col("category_code"))).alias("category_code"))
    return k.join(msm(s, d).groupBy("domain").agg(F.count("*").alias("n")), "domain", "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query(f"""with {M}, {CZ}, one as (select url, min_by(category_code, (cc <> 'zz', category_code)) as category_code from cz group by 1)
select measurement_uid, coalesce(category_code, '') as category_code, 'AS' || cast(probe_asn as varchar) as probe_asn, nullif(input, '') as input, anomaly = 't' as anomaly from m left join one on url = input where probe_cc <> 'ZZ' and probe_asn <> 0""")
def p3_measurement_meta(s: SparkSession, d: str) -> DataFrame:
    one = views.url_list(s, d).groupBy(F.col("url").alias("input")).agg(F.min_by("category_code", F.struct(F.col("cc") != "zz", F.col("category_code"))).alias("category_code"))
    m = msm(s, d).where("probe_cc <> 'ZZ' and probe_asn <> 0").join(one, "input", "left")
    return m.select("measurement_uid", F.coalesce("category_code", F.lit("")).alias("category_code"), F.concat(F.lit("AS"), "probe_asn").alias("probe_asn"), F.nullif("input", F.lit("")).alias("input"), (F.col("anomaly") == "t").alias("anomaly"))


@query(f"""with {M} select measurement_uid, probe_cc, probe_asn, test_name, measurement_start_time from m
where measurement_start_time > timestamp '2024-01-05' and measurement_start_time <= timestamp '2024-01-20' and probe_cc <> 'ZZ' and probe_asn <> 0 and test_name in ('signal', 'torsf') and anomaly = 't'
order by measurement_start_time desc, measurement_uid limit 50 offset 25""")
def f2_measurement_page(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where((F.col("measurement_start_time") > F.lit("2024-01-05").cast("timestamp")) & (F.col("measurement_start_time") <= F.lit("2024-01-20").cast("timestamp")))
    m = counters.filtered(m, test_name=["signal", "torsf"], anomaly="t").where("probe_cc <> 'ZZ' and probe_asn <> 0")
    return m.orderBy(F.desc("measurement_start_time"), "measurement_uid").offset(25).limit(50).select("measurement_uid", "probe_cc", "probe_asn", "test_name", "measurement_start_time")


@query(f"with {M}, k as (select report_id, input from m where confirmed = 't') select m.measurement_uid, m.report_id from m semi join k on m.report_id = k.report_id and m.input = k.input")
def j8_locators(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d)
    return m.join(m.where("confirmed = 't'").select("report_id", "input"), ["report_id", "input"], "left_semi").select("measurement_uid", "report_id")


@query(f"""with {AM}, t as (select asn, max(changed) as changed from am group by 1) select distinct am.asn, am.org_name, am.changed from am semi join t on am.asn = t.asn and am.changed = t.changed""")
def j9_latest_revision(s: SparkSession, d: str) -> DataFrame:
    a = views.asn_history(s, d)
    return a.join(a.groupBy("asn").agg(F.max("changed").alias("changed")), ["asn", "changed"], "left_semi").select("asn", "org_name", "changed").distinct()


@query(f"""with {CZ}, d as (select url, cc from cz where cc <> 'zz'), x as (select distinct url from cz where cc = 'zz') select distinct d.url, d.cc from d anti join x on d.url = x.url""")
def j13_not_in_global_list(s: SparkSession, d: str) -> DataFrame:
    u = views.url_list(s, d).select("url", "cc").distinct()
    return u.where("cc <> 'zz'").join(u.where("cc = 'zz'").select("url"), "url", "left_anti").select("url", "cc")


# ---- prioritised lists ----

ALIVE = "alive as (select category_code, cc, domain, url, priority from rl group by 1, 2, 3, 4, 5 having sum(sign) > 0)"
PRIORITY = f"""{CZ}, {RL}, {ALIVE}, pr as (
  select cz.category_code, cz.domain, cz.url, cz.cc, coalesce(sum(a.priority), 0) as priority from cz left join alive a
    on (a.category_code in ('', '*') or a.category_code = cz.category_code) and (a.domain in ('', '*') or a.domain = cz.domain) and (a.url in ('', '*') or a.url = cz.url) and (lower(cz.cc) = 'zz' or a.cc in ('', '*') or lower(a.cc) = lower(cz.cc))
  group by 1, 2, 3, 4)"""
WEIGHT = f"""with {M}, {PRIORITY}, c as (select input as url, count(*) as msmt_cnt from m where probe_cc = 'AZ' group by 1),
w as (select pr.category_code, pr.domain, pr.url, pr.cc, cast(priority as bigint) as priority, coalesce(msmt_cnt, 0) as msmt_cnt, priority / greatest(coalesce(msmt_cnt, 0), 0.1) as weight from pr left join c on c.url = pr.url)"""

RULE = ["category_code", "cc", "domain", "url", "priority"]


@query(f"with {RL}, {ALIVE} select * from alive order by all")
def c2_alive_rules(s: SparkSession, d: str) -> DataFrame:
    return versioned.collapsed(views.rule_log(s, d), RULE).orderBy(*RULE)


def weights(s: SparkSession, d: str) -> DataFrame:
    p = priority.url_priorities(views.url_list(s, d), versioned.collapsed(views.rule_log(s, d), RULE))
    return priority.weighted(p, msm(s, d).where("probe_cc = 'AZ'").groupBy(F.col("input").alias("url")).agg(F.count("*").alias("msmt_cnt")))


@query(f"{WEIGHT} select category_code, domain, url, cc, priority, msmt_cnt, round(weight, 6) as weight from w")
def a11_url_weights(s: SparkSession, d: str) -> DataFrame:
    return weights(s, d).select("category_code", "domain", "url", "cc", "priority", "msmt_cnt", F.round("weight", 6).alias("weight"))


@query(f"""{WEIGHT} select category_code, url, case when upper(cc) = 'ZZ' then 'XX' else upper(cc) end as country_code, round(weight, 6) as weight from w where priority > 0 and category_code in ('ECON', 'SMAL', 'PROM')
order by w.weight desc, url, category_code, cc limit 100""")
def l2_test_list(s: SparkSession, d: str) -> DataFrame:
    return priority.test_list(weights(s, d), ["ECON", "SMAL", "PROM"], 100).withColumn("weight", F.round("weight", 6))


@query(f"with {M} select date_trunc('week', measurement_start_time + interval 1 day) - interval 1 day as week, probe_cc, probe_asn, input, count(*) as msmt_cnt from m where input <> '' and test_name = 'web_connectivity' group by 1, 2, 3, 4")
def a26_weekly_counts(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where("input <> '' and test_name = 'web_connectivity'")
    return m.groupBy(scalar.bucket(F.col("measurement_start_time"), "week").alias("week"), "probe_cc", "probe_asn", "input").agg(F.count("*").alias("msmt_cnt"))


@query(f"""with {M}, {CZ}, c as (select input, probe_cc, count(*) as cnt, cast(trunc(100.0 * count(*) filter (where anomaly = 't') / count(*)) as integer) as anomaly_perc from m group by 1, 2)
select u.url, u.cc, coalesce(cnt, 0) as cnt, coalesce(anomaly_perc, 0) as anomaly_perc from (select distinct url, cc from cz) u left join c on c.input = u.url and c.probe_cc = upper(u.cc)""")
def a27_country_prioritization(s: SparkSession, d: str) -> DataFrame:
    c = msm(s, d).groupBy(F.col("input").alias("url"), "probe_cc").agg(F.count("*").alias("cnt"), (100 * F.count_if(F.col("anomaly") == "t") / F.count("*")).cast("int").alias("anomaly_perc"))
    u = views.url_list(s, d).select("url", "cc").distinct().withColumn("probe_cc", F.upper("cc"))
    return u.join(c, ["url", "probe_cc"], "left").select("url", "cc", F.coalesce("cnt", F.lit(0)).alias("cnt"), F.coalesce("anomaly_perc", F.lit(0)).alias("anomaly_perc"))


@query(f"""with {M}, {CZ} select cast(measurement_start_time as date) as day, probe_cc, input, count(*) as msmt_cnt from m join (select distinct url from cz) u on url = input
where test_name = 'web_connectivity' and measurement_start_time > timestamp '2024-01-31' - interval 8 day and measurement_start_time < timestamp '2024-01-31' group by 1, 2, 3""")
def a28_recent_counters(s: SparkSession, d: str) -> DataFrame:
    end = F.lit(AS_OF).cast("timestamp")
    m = msm(s, d).where((F.col("test_name") == "web_connectivity") & (F.col("measurement_start_time") > end - F.expr("interval 8 days")) & (F.col("measurement_start_time") < end))
    listed = views.url_list(s, d).select(F.col("url").alias("input")).distinct()
    return m.join(listed, "input", "left_semi").groupBy(day().alias("day"), "probe_cc", "input").agg(F.count("*").alias("msmt_cnt"))


# ---- versioned tables ----


@query("""with v as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events) select user_id, event_type, event_id, value from v where rn = 1""")
def w2_replacing_merge(s: SparkSession, d: str) -> DataFrame:
    return versioned.latest_rows(views.read(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select user_id, event_type, round(sum(value), 4) as total, count(*) as n from events group by 1, 2")
def c3_summing_merge(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count("*").alias("n"))


@query(f"""with {M}, {CZ}, p as (select distinct url as k from cz), w as (select distinct input as k from m where input <> '')
select coalesce(p.k, w.k) as k, case when p.k is null then 'add' when w.k is null then 'delete' else 'keep' end as action, timestamp '2024-01-31' as updated from p full join w on p.k = w.k""")
def c6_endpoint_upsert(s: SparkSession, d: str) -> DataFrame:
    """Listed URLs as the endpoints that are there, measured ones as those that are wanted."""
    wanted = msm(s, d).where("input <> ''").select(F.col("input").alias("k"))
    return versioned.upsert(views.url_list(s, d).select(F.col("url").alias("k")), wanted, ["k"], AS_OF)


UPDATED = f"""{RL}, o as (select distinct category_code, cc, domain, url, priority from rl where cc = 'BY' and category_code = 'PROM'),
n as (select 'PROM' as category_code, cc, domain, '*' as url, priority + 1 as priority from o union all select 'SMAL', '*', '*', 'http://d' || cast(s_suppkey as varchar), 5 from supplier where s_suppkey % 7 = 0 union all select 'ECON', '*', '*', '*', 7),
l as (select * from rl union all select *, -1 from o), alive as (select distinct category_code, cc, domain, url from (select category_code, cc, domain, url, priority from l group by 1, 2, 3, 4, 5 having sum(sign) > 0)),
c as (select n.*, count(*) over (partition by n.category_code, n.cc, n.domain, n.url) > 1 or a.url is not null as bad from n left join alive a on a.category_code = n.category_code and a.cc = n.cc and a.domain = n.domain and a.url = n.url)"""


def updated_rules(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = views.rule_log(s, d).select(*RULE, "sign")
    old = log.where("cc = 'BY' and category_code = 'PROM'").select(*RULE).distinct()
    more = views.read(s, d, "supplier").where("s_suppkey % 7 = 0").select(F.lit("SMAL").alias("category_code"), F.lit(" ").alias("cc"), F.lit("*").alias("domain"), F.concat(F.lit("http://d"), "s_suppkey").alias("url"), F.lit(5).alias("priority"))
    taken = s.createDataFrame([("ECON", "*", "*", "", 7)], "category_code string, cc string, domain string, url string, priority int")
    new = old.withColumn("priority", F.col("priority") + 1).unionByName(more).unionByName(taken)
    return versioned.rule_update(log, old, new, RULE, RULE[:4])


@query(f"with {UPDATED} select * from (select category_code, cc, domain, url, priority, sum(sign) as s from (select * from l union all select category_code, cc, domain, url, priority, 1 from c where not bad) group by 1, 2, 3, 4, 5) where s > 0")
def c4_rule_update(s: SparkSession, d: str) -> DataFrame:
    return updated_rules(s, d)[0].groupBy(*RULE).agg(F.sum("sign").alias("s")).where("s > 0")


@query(f"with {UPDATED} select category_code, cc, domain, url, priority from c where bad")
def c4_refused_rules(s: SparkSession, d: str) -> DataFrame:
    return updated_rules(s, d)[1]


@query(f"with {CZ} select url, domain, cc, category_code from cz where not (cc = 'az' and category_code = 'ECON') union all select distinct url, domain, cc, 'NEWS' from cz where cc = 'az' and category_code = 'ECON'")
def c5_edited_list(s: SparkSession, d: str) -> DataFrame:
    u = views.url_list(s, d)
    old = u.where("cc = 'az' and category_code = 'ECON'")
    return versioned.edited_list(u, old, old.withColumn("category_code", F.lit("NEWS")).distinct())


@query(f"""with {M} select distinct test_name, probe_cc, input from m where measurement_start_time < timestamp '2024-01-05' union select distinct test_name, probe_cc, input from m where measurement_start_time >= timestamp '2024-01-25'""")
def u1_live_and_archive(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d)
    cols = ["test_name", "probe_cc", "input"]
    return counters.filtered(m, until="2024-01-05").select(*cols).unionByName(counters.filtered(m, since="2024-01-25").select(*cols)).distinct()


# ---- detector ----


def series(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where("test_name = 'web_connectivity' and input <> ''")
    return m.select("probe_cc", "input", F.col("measurement_start_time").alias("ts"), F.col("event_id").alias("uid"), scalar.backfill_score(F.col("anomaly") == "t", F.col("confirmed") == "t").alias("x"))


SERIES = f"""with recursive {M}, s as (select probe_cc, input, measurement_start_time as ts, event_id as uid, case when anomaly = 't' then 0.8 when confirmed = 't' then 2.0 else 0.0 end as x,
  row_number() over (partition by probe_cc, input order by measurement_start_time, event_id) as rn from m where test_name = 'web_connectivity' and input <> ''),
e as (select probe_cc, input, ts, uid, rn, cast(x as double) as mean from s where rn = 1 union all select s.probe_cc, s.input, s.ts, s.uid, s.rn, 0.98 * e.mean + 0.02 * s.x from e join s on s.probe_cc = e.probe_cc and s.input = e.input and s.rn = e.rn + 1)"""


@query(f"{SERIES} select probe_cc, input, uid, round(mean, 6) as mean from e")
def w5_moving_average(s: SparkSession, d: str) -> DataFrame:
    return detector.moving_average(series(s, d), ["probe_cc", "input"]).select("probe_cc", "input", "uid", F.round("mean", 6).alias("mean"))


@query(f"""{SERIES}, b as (select *, coalesce(last_value(case when mean > 0.10 then true when mean < 0.05 then false end ignore nulls) over (partition by probe_cc, input order by ts, uid rows unbounded preceding), false) as blocked from e),
c as (select *, coalesce(lag(blocked) over (partition by probe_cc, input order by ts, uid), false) as before from b) select probe_cc, input, ts, round(mean, 6) as mean, blocked from c where blocked <> before""")
def w6_blocking_changes(s: SparkSession, d: str) -> DataFrame:
    means = detector.moving_average(series(s, d), ["probe_cc", "input"])
    return detector.changes(means, ["probe_cc", "input"]).select("probe_cc", "input", "ts", F.round("mean", 6).alias("mean"), "blocked")


@query(f"""{SERIES} select probe_cc, input, round(arg_max(mean, (ts, uid)), 6) as mean from e where ts < timestamp '2024-01-20' group by 1, 2""")
def w12_mean_snapshot(s: SparkSession, d: str) -> DataFrame:
    means = detector.moving_average(series(s, d), ["probe_cc", "input"])
    return detector.snapshot(means, ["probe_cc", "input"], "2024-01-20").withColumn("mean", F.round("mean", 6))


@query(f"""{SERIES}, l as (select probe_cc, input, arg_max(mean, (ts, uid)) as mean from e group by 1, 2) select count(*) as tracked, count(*) filter (where mean > 0.10) as blocked, round(100.0 * count(*) filter (where mean > 0.10) / count(*), 6) as blocked_perc from l""")
def a29_tracked_and_blocked(s: SparkSession, d: str) -> DataFrame:
    last = detector.snapshot(detector.moving_average(series(s, d), ["probe_cc", "input"]), ["probe_cc", "input"], "2100-01-01")
    return last.agg(F.count("*").alias("tracked"), F.count_if(F.col("mean") > 0.10).alias("blocked")).withColumn("blocked_perc", F.round(100 * F.col("blocked") / F.col("tracked"), 6))


@query(f"""with {M}, t as (select measurement_uid, probe_cc, measurement_start_time, row_number() over (partition by probe_cc order by measurement_start_time desc, event_id desc) as rn from m where confirmed = 't' and input <> '') select * from t where rn <= 1000""")
def w8_country_feed(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where("confirmed = 't' and input <> ''")
    w = Window.partitionBy("probe_cc").orderBy(F.desc("measurement_start_time"), F.desc("event_id"))
    return m.withColumn("rn", F.row_number().over(w)).where("rn <= 1000").select("measurement_uid", "probe_cc", "measurement_start_time", "rn")


@query(f"""with {M}, c as (select probe_cc, probe_asn, count(*) as points from m where test_name = 'web_connectivity' group by 1, 2) select probe_cc, probe_asn, points, rn from (select *, row_number() over (partition by probe_cc order by points desc, probe_asn) as rn from c) where rn <= 20""")
def w9_top_networks(s: SparkSession, d: str) -> DataFrame:
    return detector.busiest(msm(s, d).where("test_name = 'web_connectivity'"), ["probe_cc"], "probe_asn")


@query(f"""with recursive {M}, s as (select probe_asn % 10 as grp, probe_asn, measurement_start_time as ts, event_id as uid, case when anomaly = 't' then 0.8 when confirmed = 't' then 2.0 else 0.0 end as x from m where test_name = 'web_connectivity'),
t as (select grp, probe_asn from (select grp, probe_asn, row_number() over (partition by grp order by count(*) desc, probe_asn) as rn from s group by 1, 2) where rn <= 3),
n as (select s.*, row_number() over (partition by s.grp, s.probe_asn order by ts, uid) as rn from s semi join t on t.grp = s.grp and t.probe_asn = s.probe_asn),
e as (select grp, probe_asn, uid, rn, cast(x as double) as mean from n where rn = 1 union all select n.grp, n.probe_asn, n.uid, n.rn, 0.98 * e.mean + 0.02 * n.x from e join n on n.grp = e.grp and n.probe_asn = e.probe_asn and n.rn = e.rn + 1) select grp, probe_asn, uid, round(mean, 6) as mean from e""")
def w9_network_averages(s: SparkSession, d: str) -> DataFrame:
    """The busiest networks of each group, each with its own moving average."""
    r = msm(s, d).where("test_name = 'web_connectivity'").select(F.expr("probe_asn % 10").alias("grp"), "probe_asn", F.col("measurement_start_time").alias("ts"), F.col("event_id").alias("uid"), scalar.backfill_score(F.col("anomaly") == "t", F.col("confirmed") == "t").alias("x"))
    top = detector.busiest(r, ["grp"], "probe_asn", 3).select("grp", "probe_asn")
    return detector.moving_average(r.join(top, ["grp", "probe_asn"], "left_semi"), ["grp", "probe_asn"]).select("grp", "probe_asn", "uid", F.round("mean", 6).alias("mean"))


@query("""with q as (select event_id, user_id, epoch_us(ts) as t, greatest(cast(floor(value * 100 + 0.0001) as bigint), 1) as cost from events)
select event_id, user_id, cast(sum(cost) over (partition by user_id order by t range between 60000000 preceding and current row) as bigint) as minute_cost,
  cast(sum(cost) over (partition by user_id order by t range between 86400000000 preceding and current row) as bigint) as day_cost from q""")
def w10_rolling_quota(s: SparkSession, d: str) -> DataFrame:
    q = views.read(s, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.greatest(F.floor(F.col("value") * 100 + 0.0001), F.lit(1)).alias("cost"))
    over = lambda us: F.sum("cost").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-us, 0))
    return q.select("event_id", "user_id", over(60_000_000).alias("minute_cost"), over(86_400_000_000).alias("day_cost"))


@query(f"""with {M}, l as (select cast(measurement_start_time as date) as day, probe_cc, list_sort(list(distinct input)) as urls from m group by 1, 2), p as (select *, lag(urls) over (partition by probe_cc order by day) as before from l)
select day, probe_cc, case when before is not null then round(100.0 * (len(list_filter(urls, lambda x: not list_contains(before, x))) + len(list_filter(before, lambda x: not list_contains(urls, x)))) / len(urls), 6) end as churn from p""")
def w11_list_churn(s: SparkSession, d: str) -> DataFrame:
    lists = msm(s, d).groupBy(day().alias("day"), "probe_cc").agg(F.sort_array(F.collect_set("input")).alias("urls"))
    return versioned.churn(lists, "probe_cc", "day", "urls").select("day", "probe_cc", F.round("churn", 6).alias("churn"))


# ---- scalar functions, validation ----


@query(f"""with {M}, u as (select page_id, url from pages) select page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) as domain from u""")
def x1_page_domains(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "pages").select("page_id", scalar.domain_of(F.col("url")).alias("domain"))


@query(f"""with {M}, x as (select measurement_uid, probe_cc, case when event_id % 31 = 0 then 'asx' else 'AS' || cast(probe_asn as varchar) end as asn, case when event_id % 29 = 0 then 'Bad Name' else test_name end as test from m)
select measurement_uid, (case when not regexp_full_match(test, '[a-z0-9_]{{2,30}}') then 'bad_test_name;' else '' end) || (case when not regexp_full_match(upper(asn), 'AS(0|[1-9][0-9]{{0,9}})') then 'bad_asn;' else '' end)
  || (case when upper(asn) = 'AS0' then 'asn_zero;' else '' end) || (case when probe_cc = 'ZZ' then 'cc_unknown;' else '' end) as reasons from x""")
def f6_submission_faults(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d)
    asn = F.expr("case when event_id % 31 = 0 then 'asx' else concat('AS', probe_asn) end")
    test = F.expr("case when event_id % 29 = 0 then 'Bad Name' else test_name end")
    return m.select("measurement_uid", F.array_join(F.transform(scalar.meta_faults(F.col("probe_cc"), asn, test), lambda r: F.concat(r, F.lit(";"))), "").alias("reasons"))


@query(f"with {M} select count(*) filter (where probe_cc <> 'ZZ' and probe_asn <> 0) as kept, count(*) filter (where probe_cc = 'ZZ' or probe_asn = 0) as dropped from m")
def f1_ingest_discard(s: SparkSession, d: str) -> DataFrame:
    keep = (F.upper("probe_cc") != "ZZ") & (F.col("probe_asn") != 0)
    return msm(s, d).agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped"))


@query(f"with {M} select platform, list_sort(list(distinct software_version)) as versions from m where list_transform(string_split(software_version, '.'), lambda x: cast(x as integer)) < [3, 17, 2] group by 1")
def m6_old_versions(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where(scalar.version(F.col("software_version")) < F.array(F.lit(3), F.lit(17), F.lit(2)))
    return m.groupBy("platform").agg(F.sort_array(F.collect_set("software_version")).alias("versions"))


@query(f"""with {M} select test_name, blocking_general, accuracy, count(*) as n from (select test_name,
  case test_name when 'web_connectivity' then case when event_id % 4 = 1 then 1.0 else 0.0 end when 'torsf' then case when event_id % 3 = 0 then 1.0 else 0.0 end when 'openvpn' then case when event_id % 5 = 0 then 1.0 else 0.0 end
    when 'whatsapp' then case when event_id % 2 = 0 then 1.0 else 0.0 end else case when event_id % 7 = 0 then 1.0 else 0.0 end end as blocking_general,
  case test_name when 'web_connectivity' then case when event_id % 4 = 2 then 0.0 end when 'openvpn' then case when event_id % 5 = 1 then 0.0 end end as accuracy from m) group by 1, 2, 3""")
def r_scored_bodies(s: SparkSession, d: str) -> DataFrame:
    """Bodies built from events, parsed as VARIANT and scored by their tests' rules."""
    body = F.expr(
        """case test_name
        when 'web_connectivity' then concat('{"test_keys":{"accessible":true,"blocking":', case event_id % 4 when 1 then '"dns"' when 2 then 'null' else 'false' end, '}}')
        when 'torsf' then concat('{"test_keys":{"failure":', case when event_id % 3 = 0 then '"timeout"' else 'null' end, '}}')
        when 'openvpn' then concat('{"test_keys":{"success":', case event_id % 5 when 0 then 'false' when 1 then 'null' else 'true' end, '}}')
        when 'whatsapp' then concat('{"test_keys":{"requests":[{"failure":null,"request":{"url":"https://web.whatsapp.com/"}},{"failure":null,"request":{"url":"https://v.whatsapp.net/v2/register"}}],"tcp_connect":[{"status":{"success":', case when event_id % 2 = 0 then 'false' else 'true' end, '}}]}}')
        else concat('{"test_version":"0.2.5","measurement_start_time":"2024-01-02 00:00:00","annotations":{"engine_version":"3.20.0"},"test_keys":{"failed_operation":null,"failure":null,"signal_backend_status":"', case when event_id % 7 = 0 then 'blocked' else 'ok' end, '"}}') end"""
    )
    scored = msm(s, d).select("test_name", F.try_parse_json(body).alias("v")).select("test_name", scoring.score(F.col("v"), F.col("test_name")).alias("s"))
    return scored.groupBy("test_name", "s.blocking_general", "s.accuracy").agg(F.count("*").alias("n"))


@query()
def a30_simhash(s: SparkSession, d: str) -> DataFrame:
    """Simhash of pages; MD5's bits as votes aren't in SQL, tested against known values."""
    return legacy.simhash(views.read(s, d, "pages"), "page_id", "html")


def complete() -> None:
    from netgauge import catalog_readers, catalog_records, catalog_scores, catalog_services, catalog_streams  # noqa: F401  they register their queries here


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    complete()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    complete()
    return dict(SQL)
