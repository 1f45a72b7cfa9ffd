"""Registered queries of the readers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netgauge.catalog import DAYS, calendar, day, msm, query
from netgauge.functions import scalar
from netgauge.operators import counters, readers
from netgauge.operators.quantiles import beside, quantiles
from netgauge.plans import views
from netgauge.plans.views import AS_OF, CZ, OB, M

LISTED = "select measurement_uid, probe_cc, probe_asn, test_name, measurement_start_time, input from m"


def listed(df: DataFrame) -> DataFrame:
    return df.select("measurement_uid", "probe_cc", "probe_asn", "test_name", "measurement_start_time", "input")


# ---- filter sets ----


@query(f"with {M} {LISTED} where measurement_start_time > timestamp '2024-01-02' and measurement_start_time <= timestamp '2024-02-01' and probe_cc <> 'ZZ' and probe_asn in (3, 7, 11) and anomaly = 'f' and confirmed = 'f' and msm_failure = 't'")
def f2_default_window(s: SparkSession, d: str) -> DataFrame:
    return listed(readers.measurements(msm(s, d), AS_OF, probe_asn=["AS3", 7, "as11"], anomaly=False, confirmed=False, failure=True))


@query(f"with {M} {LISTED} where measurement_start_time > timestamp '2024-01-02' and measurement_start_time <= timestamp '2024-02-01' and probe_cc <> 'ZZ' and probe_asn <> 0 and input = 'http://d12.example/'")
def f2_input_overrides_domain(s: SparkSession, d: str) -> DataFrame:
    return listed(readers.measurements(msm(s, d), AS_OF, input="http://d12.example/", domain=["d13.example"], category_code="ECON", urls=views.url_list(s, d)))


@query(f"with {M}, {CZ} select m.measurement_uid, cz.category_code, m.domain from m join cz on url = input where measurement_start_time > timestamp '2024-01-10' and measurement_start_time <= timestamp '2024-01-12' and probe_cc <> 'ZZ' and probe_asn <> 0 and m.domain in ('d12.example', 'd14.example', 'd15.example') and category_code = 'PROM'")
def f2_domain_and_category(s: SparkSession, d: str) -> DataFrame:
    r = readers.measurements(msm(s, d), AS_OF, "2024-01-10", "2024-01-12", domain=["d12.example", "d14.example", "d15.example"], category_code="PROM", urls=views.url_list(s, d))
    return r.select("measurement_uid", "category_code", "domain")


@query(f"with {M} {LISTED} where report_id = 'r12' and probe_cc <> 'ZZ' and probe_asn <> 0")
def f2_report(s: SparkSession, d: str) -> DataFrame:
    return listed(readers.measurements(msm(s, d), AS_OF, report_id="r12"))


@query(f"with {M} select probe_cc, run_link_id, count(*) as n from m where measurement_start_time >= timestamp '2023-08-04' and measurement_start_time < timestamp '2024-01-31' and run_link_id in (1, 2) and domain in ('d3.example', 'd4.example') group by 1, 2")
def f3_default_span(s: SparkSession, d: str) -> DataFrame:
    """Counts of the 180 days before a day, by run link and domain."""
    since, until = readers.window_of(None, AS_OF, AS_OF, 180)
    m = counters.filtered(msm(s, d), since, until, run_link_id=[1, 2], domain=["d3.example", "d4.example"])
    return m.groupBy("probe_cc", "run_link_id").agg(F.count("*").alias("n"))


@query(f"with {OB} select measurement_uid, hostname, case when event_id % 10 = 0 then 'sni.example' else hostname end as target_id from ob where measurement_start_time > timestamp '2024-01-25' and measurement_start_time < timestamp '2024-02-01' and probe_cc in ('AZ', 'BY')")
def f4_recent_observations(s: SparkSession, d: str) -> DataFrame:
    r = readers.observations(views.observations(s, d), AS_OF, probe_cc=["AZ", "BY"])
    return r.select("measurement_uid", "hostname", F.when(F.expr("event_id % 10 = 0"), "sni.example").otherwise(F.col("hostname")).alias("target_id"))


@query(f"with {OB} select measurement_uid, coalesce(case when event_id % 3 > 0 then hostname end, 'sni-' || hostname) as target_id from ob where measurement_uid in ('5', '17', '400')")
def p5_targets(s: SparkSession, d: str) -> DataFrame:
    ob = views.observations(s, d).withColumns({"tls_server_name": F.concat(F.lit("sni-"), "hostname"), "hostname": F.expr("case when event_id % 3 > 0 then hostname end")})
    return readers.observations(ob, AS_OF, measurement_uid=["5", "17", "400"]).select("measurement_uid", "target_id")


@query(f"with {OB} select measurement_uid, probe_asn, top_probe_analysis, dns_blocked from ({{an}}) where measurement_start_time > timestamp '2024-01-02' and measurement_start_time < timestamp '2024-02-01' and probe_asn in (2, 5) and test_name = 'web_connectivity'".replace("{an}", views.AN_SELECT))
def f5_recent_analyses(s: SparkSession, d: str) -> DataFrame:
    return readers.analyses(views.analyses(s, d), AS_OF, probe_asn=["AS2", 5], test_name=["web_connectivity"]).select("measurement_uid", "probe_asn", "top_probe_analysis", "dns_blocked")


@query(f"""with {OB} select probe_asn, probe_cc, hostname as domain, measurement_start_time as start_time, case when event_id % 13 > 2 then dns_blocked end as dns_isp_blocked, case event_id % 3 when 0 then 'down' when 1 then 'up' end as change_dir
from ob where probe_cc = 'BY' and measurement_start_time >= timestamp '2024-01-05' and measurement_start_time <= timestamp '2024-01-25'""")
def f12_changepoints(s: SparkSession, d: str) -> DataFrame:
    cp = views.observations(s, d).select("probe_asn", "probe_cc", F.col("hostname").alias("domain"), F.col("measurement_start_time").alias("ts"), F.expr("case when event_id % 13 > 2 then double(dns_blocked) else double('NaN') end").alias("dns_isp_blocked"), F.expr("case event_id % 3 when 0 then -1 when 1 then 1 end").alias("change_dir"))
    return readers.changepoints(cp, AS_OF, "2024-01-05", "2024-01-25", probe_cc="BY")


# ---- pages ----

FOR_PAGE = "from m where measurement_start_time > timestamp '2024-01-02' and measurement_start_time <= timestamp '2024-02-01' and probe_cc = 'AZ' and probe_asn <> 0"


@query(f"with {M} select measurement_uid, input, probe_cc {FOR_PAGE} order by input, measurement_uid limit 20 offset 40")
def l1_page_by_input(s: SparkSession, d: str) -> DataFrame:
    m = readers.measurements(msm(s, d), AS_OF, probe_cc=["AZ"])
    return readers.page(readers.ordered(m, "input", "asc", readers.MEASUREMENT_ORDERS, "measurement_uid"), 40, 20).select("measurement_uid", "input", "probe_cc")


@query(f"""with {M}, c as (select count(*) as total {FOR_PAGE}), p as (select 30 as o, 20 as l union all select 0, 1000000), q as (select o, l, greatest(least(total - o, l), 0) as n from c cross join p)
select o as offset, l as limit, cast(ceil(o / l) as integer) + 1 as current_page, case when n < l then o + n else -1 end as count, case when n < l then cast(ceil((o + n) / l) as bigint) else -1 end as pages from q""")
def l1_page_facts(s: SparkSession, d: str) -> DataFrame:
    m = readers.measurements(msm(s, d), AS_OF, probe_cc=["AZ"])
    return readers.page_facts(m, 30, 20).unionByName(readers.page_facts(m, 0, 1_000_000))


@query(f"with {M} select count(distinct input) as total from m where probe_cc = 'AZ' and input <> ''")
def a9_url_total(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).where("probe_cc = 'AZ' and input <> ''").agg(F.countDistinct("input").alias("total"))


@query(f"with {M}, {CZ} select url, cc, coalesce(n, 0) as n from (select distinct url, cc from cz) u left join (select input, count(*) as n from m group by 1) c on c.input = u.url order by upper(cc), -n, url")
def l4_countries_by_priority(s: SparkSession, d: str) -> DataFrame:
    c = msm(s, d).groupBy(F.col("input").alias("url")).agg(F.count("*").alias("n"))
    u = views.url_list(s, d).select("url", "cc").distinct().join(c, "url", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return u.orderBy(F.upper("cc"), -F.col("n"), "url")


# ---- aggregates ----

AN = f"{OB}, an as ({views.AN_SELECT})"
FOLDED = "case when {c} like 'unknown_failure%' then 'unknown_failure' else {c} end"
DNS_OUTCOME = "case when top_dns_failure in ('android_dns_cache_no_data', 'dns_nxdomain_error') then 'nxdomain' else coalesce(top_dns_failure, 'got_answer') end"


def _top(p: str, value: str) -> str:
    return f"{p}_top as (select probe_cc, test_name, arg_min(v, (-w, v)) as v from (select probe_cc, test_name, {value} as v, sum(cast(floor({p}_blocked * 100 + 0.0000001) as bigint)) as w from an group by 1, 2, 3) where v is not null group by 1, 2)"


LIKELY_SQL = f"""with {AN}, q as (select probe_cc, test_name, count(*) as count, {', '.join(f'quantile_cont({p}_{o}, 0.95) as {p}_{o}' for p in readers.PROTOCOLS for o in readers.OUTCOMES)} from an group by 1, 2),
lab as (select probe_cc, test_name, arg_min(top_probe_analysis, (-c, top_probe_analysis)) as probe_analysis from (select probe_cc, test_name, top_probe_analysis, count(*) as c from an group by 1, 2, 3) group by 1, 2),
{_top('dns', FOLDED.format(c=DNS_OUTCOME))}, {_top('tcp', FOLDED.format(c='top_tcp_failure'))}, {_top('tls', FOLDED.format(c='top_tls_failure'))},
z as (select q.*, lab.probe_analysis, coalesce(dns_top.v, '') as dv, coalesce(tcp_top.v, '') as tv, coalesce(tls_top.v, '') as lv from q join lab using (probe_cc, test_name) left join dns_top using (probe_cc, test_name) left join tcp_top using (probe_cc, test_name) left join tls_top using (probe_cc, test_name)),
l as (select *, list_transform(list_sort(list_filter([struct_pack(o := -dns_blocked, i := 0, n := 'dns.' || dv), struct_pack(o := -tcp_blocked, i := 1, n := 'tcp.' || tv), struct_pack(o := -tls_blocked, i := 2, n := 'tls.' || lv)], lambda x: x.o < -0.5)), lambda x: x.n) as likely from z)
select probe_cc, test_name, count, probe_analysis, {', '.join(f'round({p}_{o}, 6) as {p}_{o}' for p in readers.PROTOCOLS for o in readers.OUTCOMES)}, dv as dns_blocked_outcome, tv as tcp_blocked_outcome, lv as tls_blocked_outcome,
  coalesce(list_aggregate(likely, 'string_agg', ','), '') as likely, coalesce(likely[1], 'none') as blocked_max, case when len(likely) > 0 then round(greatest(dns_blocked, tcp_blocked, tls_blocked), 6) else 0.0 end as blocked_max_value from l"""


@query(LIKELY_SQL)
def a20_analysis_aggregate(s: SparkSession, d: str) -> DataFrame:
    r = readers.likelihoods(views.analyses(s, d), ["probe_cc", "test_name"])
    numbers = [F.round(f"{p}_{o}", 6).alias(f"{p}_{o}") for p in readers.PROTOCOLS for o in readers.OUTCOMES]
    return r.select("probe_cc", "test_name", "count", "probe_analysis", *numbers, *[f"{p}_blocked_outcome" for p in readers.PROTOCOLS], F.array_join(F.transform("likely", lambda x: x["name"]), ",").alias("likely"), F.col("blocked_max.name").alias("blocked_max"), F.round("blocked_max.blocked", 6).alias("blocked_max_value"))


@query(f"with {AN}, c as (select probe_asn, top_probe_analysis, count(*) as n from an group by 1, 2) select probe_asn, arg_min(top_probe_analysis, (-n, top_probe_analysis)) as top_probe_analysis from c group by 1")
def a22_majority_analysis(s: SparkSession, d: str) -> DataFrame:
    return readers.any_heavy(views.analyses(s, d), ["probe_asn"], "top_probe_analysis")


FIRST_FAILURE = "coalesce(" + ", ".join(f"{prefix} || {FOLDED.format(c=c)}" for prefix, c in (("case when resolver_asn = probe_asn then 'dns_isp.' else 'dns_other.' end", "dns_failure"), ("'tcp.'", "tcp_failure"), ("'tls.'", "tls_failure"), ("case when tls_used then 'https.' else 'http.' end", "http_failure"))) + ", 'none')"


@query(f"with {OB} select {FIRST_FAILURE} as failure, date_trunc('day', measurement_start_time) as timestamp, probe_cc, count(*) as observation_count from ob where probe_cc in ('AZ', 'BY', 'CX') and (dns_failure is not null or ip is not null) group by 1, 2, 3")
def a23_by_failure_and_day(s: SparkSession, d: str) -> DataFrame:
    return readers.observation_counts(views.observations(s, d), ["failure", "timestamp"], probe_cc=["AZ", "BY", "CX"])


@query(f"with {OB} select ip, probe_asn, test_name, hostname, count(*) as observation_count from ob where test_name in ('signal') and hostname in ('d12.example', 'd13.example', 'd14.example') group by 1, 2, 3, 4")
def a23_by_address_and_network(s: SparkSession, d: str) -> DataFrame:
    return readers.observation_counts(views.observations(s, d), ["ip", "probe_asn"], test_name=["signal"], hostname=["d12.example", "d13.example", "d14.example"])


@query(f"with {OB} select measurement_uid, date_trunc('week', measurement_start_time + interval 1 day) - interval 1 day as timestamp, count(*) as observation_count from ob group by 1, 2")
def a23_by_measurement_and_week(s: SparkSession, d: str) -> DataFrame:
    return readers.observation_counts(views.observations(s, d), ["measurement_uid", "timestamp"], grain="week")


@query(f"""with {OB}, c as (select *, event_id % 3 * 220 + 80 as port, event_id % 5 as ip_asn, 'O' || cast(event_id % 5 as varchar) as ip_as_org_name from ob),
g as (select hostname, ip, port, max(ip_asn) as asn, max(ip_as_org_name) as as_org_name, bool_or(ip_asn in (1, 2)) as is_cloud_provider, count(*) filter (where dns_failure is null) as row_dns_success_count, count(*) filter (where dns_failure = 'dns_nxdomain_error') as row_dns_nxdomain_count,
  count(*) filter (where dns_failure is not null and dns_failure <> 'dns_nxdomain_error') as row_dns_other_failure_count, count(*) filter (where tcp_failure is null) as tcp_success_count, count(*) filter (where tcp_failure is not null) as tcp_failure_count,
  count(*) filter (where tls_failure is null) as tls_success_count, count(*) filter (where tls_failure is not null) as tls_failure_count from c group by 1, 2, 3)
select *, row_dns_success_count > 0 as in_dns_answers, max(tls_success_count > 0) over (partition by hostname, ip) as tls_consistent, cast(sum(row_dns_success_count) over (partition by hostname) as bigint) as dns_success_count,
  cast(sum(row_dns_nxdomain_count) over (partition by hostname) as bigint) as dns_nxdomain_count, cast(sum(row_dns_other_failure_count) over (partition by hostname) as bigint) as dns_other_failure_count from g""")
def a24_ground_truth_by_port(s: SparkSession, d: str) -> DataFrame:
    c = views.observations(s, d).withColumns({"port": F.expr("event_id % 3 * 220 + 80"), "ip_asn": F.expr("event_id % 5"), "ip_as_org_name": F.concat(F.lit("O"), F.expr("event_id % 5"))})
    return counters.ground_truth(c, cloud_asns=[1, 2])


@query("""with v as (select l_orderkey as uid, l_suppkey % 4 as account, l_shipdate as t, l_returnflag as status from lineitem), last as (select uid, account, arg_max(status, (t, status)) as status from v group by 1, 2)
select cast(uid as varchar) as measurement_uid, status, count(*) as n, bool_or(account = 2) as mine from last group by 1, 2""")
def a25_feedback(s: SparkSession, d: str) -> DataFrame:
    v = views.read(s, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("measurement_uid"), F.expr("l_suppkey % 4").alias("account_id"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("update_time"))
    return readers.feedback(v, 2)


@query(f"""with {M}, g as (select 'signal' as test_name, 'im' as test_group union all select 'whatsapp', 'im' union all select 'torsf', 'circumvention' union all select 'openvpn', 'circumvention'), {DAYS.format(n=30)},
c as (select cast(measurement_start_time as date) as day, coalesce(g.test_group, '') as test_group, count(*) as n from m left join g on g.test_name = m.test_name where probe_cc = 'BY' group by 1, 2)
select h.test_group, days.day, coalesce(n, 0) as n from (select distinct test_group from g union all select '') h cross join days left join c on c.day = days.day and c.test_group = h.test_group""")
def j3_group_coverage(s: SparkSession, d: str) -> DataFrame:
    """The test's group is joined as ANY LEFT: at most one match, '' where there is none."""
    groups = s.createDataFrame([("signal", "im"), ("whatsapp", "im"), ("torsf", "circumvention"), ("openvpn", "circumvention"), ("signal", "other")], "test_name string, test_group string").groupBy("test_name").agg(F.min("test_group").alias("test_group"))
    m = msm(s, d).where("probe_cc = 'BY'").join(F.broadcast(groups), "test_name", "left").withColumn("test_group", F.coalesce("test_group", F.lit("")))
    names = groups.select("test_group").unionByName(s.createDataFrame([("",)], "test_group string")).distinct()
    return counters.dense(m.groupBy(day().alias("day"), "test_group").agg(F.count("*").alias("n")), calendar(s, 30), names, ["test_group", "day"], "n")


@query(f"with {M}, n as (select chr(cast(65 + n_nationkey as integer)) || chr(cast(90 - n_nationkey as integer)) as cc, n_name from nation where n_nationkey < 20) select n.n_name as country, probe_cc, count(*) as n from m join n on cc = probe_cc group by 1, 2")
def j16_country_names(s: SparkSession, d: str) -> DataFrame:
    """Codes without a name are dropped."""
    names = views.read(s, d, "nation").where("n_nationkey < 20").select(F.expr("concat(char(65 + n_nationkey), char(90 - n_nationkey))").alias("probe_cc"), F.col("n_name").alias("country"))
    return msm(s, d).groupBy("probe_cc").agg(F.count("*").alias("n")).join(names, "probe_cc").select("country", "probe_cc", "n")


@query(f"""with {M}, {CZ}, q as (select distinct domain, domain as bare from m where domain <> '' union select distinct 'www.' || domain, domain from m where domain <> ''),
u as (select case when length(category_code) = 4 and cc = 'az' then 'www.' || domain else domain end as form, cc, url, category_code from cz),
b as (select q.domain, arg_min(struct_pack(f := u.form, c := u.category_code), (u.cc <> 'zz', length(url), url, category_code)) as b from q join u on u.form in (q.bare, 'www.' || q.bare) group by 1)
select q.domain, coalesce(b.b.f, q.bare) as canonical_domain, coalesce(b.b.c, 'MISC') as category_code from q left join b on b.domain = q.domain""")
def w4_canonical_domains(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where("domain <> ''")
    asked = m.select("domain").unionByName(m.select(F.concat(F.lit("www."), "domain").alias("domain")))
    u = views.url_list(s, d).withColumn("domain", F.expr("case when length(category_code) = 4 and cc = 'az' then concat('www.', domain) else domain end"))
    return readers.canonical_domains(asked, u)


@query(f"with {M} select measurement_uid, probe_cc, measurement_start_time from m where confirmed = 't' and input <> '' order by measurement_start_time desc, event_id desc limit 1000")
def w8_global_feed(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).where("confirmed = 't' and input <> ''")
    return m.orderBy(F.desc("measurement_start_time"), F.desc("event_id")).limit(1000).select("measurement_uid", "probe_cc", "measurement_start_time")


@query("""with q as (select event_id, user_id, epoch_us(ts) as t, greatest(cast(floor(value * 100 + 0.0001) as bigint), 1) as cost from events)
select event_id, least(1000 - w1, 20000 - w2, 100000 - w3) as remaining from (select event_id, cast(sum(cost) over (partition by user_id order by t range between 60000000 preceding and current row) as bigint) as w1,
  cast(sum(cost) over (partition by user_id order by t range between 86400000000 preceding and current row) as bigint) as w2, cast(sum(cost) over (partition by user_id order by t range between 604800000000 preceding and current row) as bigint) as w3 from q)""")
def w10_remaining_quota(s: SparkSession, d: str) -> DataFrame:
    """What is left of the quotas of a minute, a day and a week; the least counts."""
    q = views.read(s, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.greatest(F.floor(F.col("value") * 100 + 0.0001), F.lit(1)).alias("cost"))
    over = lambda us: F.sum("cost").over(Window.partitionBy("user_id").orderBy("t").rangeBetween(-us, 0))
    return q.select("event_id", F.least(*[F.lit(most) - over(us) for most, us in ((1000, 60_000_000), (20_000, 86_400_000_000), (100_000, 604_800_000_000))]).alias("remaining"))


@query(f"""with {M}, g as (select cast(measurement_start_time as date) as day, probe_cc, test_name, quantile_cont(runtime, 0.5) as p50, quantile_cont(runtime, 0.9) as p90, count(*) as n from m where runtime is not null and probe_cc in ('AZ', 'BY') group by 1, 2, 3)
select a.day, b.probe_cc, c.test_name, round(coalesce(g.p50, 0), 6) as p50, round(coalesce(g.p90, 0), 6) as p90, coalesce(g.n, 0) as n from (select distinct day from g) a cross join (select distinct probe_cc from g) b cross join (select distinct test_name from g) c
left join g on g.day = a.day and g.probe_cc = b.probe_cc and g.test_name = c.test_name""")
def a18_runtime_grid(s: SparkSession, d: str) -> DataFrame:
    """The quantiles on the whole grid of days, countries and tests, 0 where there are none; each side is a list of names."""
    m = msm(s, d).where("probe_cc in ('AZ', 'BY')").withColumn("runtime", F.get_json_object("scores", "$.extra.test_runtime").cast("double")).where("runtime is not null")
    keys = ["day", "probe_cc", "test_name"]
    m = m.select(day().alias("day"), "probe_cc", "test_name", "runtime")
    g = beside(quantiles(m, keys, [("p50", "runtime", 0.5), ("p90", "runtime", 0.9)]), m.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    grid = g.select("day").distinct().crossJoin(g.select("probe_cc").distinct()).crossJoin(g.select("test_name").distinct())
    value = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c)
    return grid.join(g, keys, "left").select(*keys, value("p50"), value("p90"), F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""with {M}, {CZ} select date_trunc('week', measurement_start_time + interval 1 day) - interval 1 day as week, probe_cc, probe_asn, input, count(*) as msmt_cnt from m join (select distinct url from cz) u on url = input
where test_name = 'web_connectivity' and measurement_start_time > timestamp '2024-01-31' - interval 8 day and measurement_start_time < timestamp '2024-01-31' group by 1, 2, 3, 4""")
def a28_recent_weekly_counters(s: SparkSession, d: str) -> DataFrame:
    end = F.lit(AS_OF).cast("timestamp")
    m = msm(s, d).where((F.col("test_name") == "web_connectivity") & (F.col("measurement_start_time") > end - F.expr("interval 8 days")) & (F.col("measurement_start_time") < end))
    url = views.url_list(s, d).select(F.col("url").alias("input")).distinct()
    return m.join(url, "input", "left_semi").groupBy(scalar.bucket(F.col("measurement_start_time"), "week").alias("week"), "probe_cc", "probe_asn", "input").agg(F.count("*").alias("msmt_cnt"))


@query(f"with {M}, {CZ} select url, length(url) as n from (select distinct url from cz) order by 2, 1 limit 50")
def m7_shortest_urls(s: SparkSession, d: str) -> DataFrame:
    return views.url_list(s, d).select("url", F.length("url").cast("long").alias("n")).distinct().orderBy("n", "url").limit(50)


@query(f"with {M} select measurement_start_time, count(*) as n from m where test_name in ('signal', 'torsf') and probe_cc = 'AZ' group by 1 having count(*) >= 1")
def s7_parameterised(s: SparkSession, d: str) -> DataFrame:
    """SQL text with named parameters and explicit columns."""
    return s.sql("select measurement_start_time, count(*) as n from {m} where array_contains(:tests, test_name) and probe_cc = :cc group by 1 having count(*) >= :least", args={"tests": ["signal", "torsf"], "cc": "AZ", "least": 1}, m=msm(s, d))
