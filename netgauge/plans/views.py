"""Measurement tables over the driver's star schema, in Spark and, word for word, in SQL.

Events become measurements, parts a URL list, orders the history of network
names, suppliers the rules of prioritisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31"

TESTS = {"click": "web_connectivity", "view": "torsf", "error": "openvpn", "purchase": "whatsapp", "signup": "signal"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    test = F.create_map(*[F.lit(x) for pair in TESTS.items() for x in pair])[F.col("event_type")]
    url = F.when(F.expr("k % 10 = 9"), "").otherwise(F.concat(F.lit("http://d"), F.col("k"), F.lit(".example/")))
    yes = lambda sql: F.when(F.expr(sql), "t").otherwise("f")
    return e.select(
        F.col("event_id"),
        F.col("event_id").cast("string").alias("measurement_uid"),
        F.concat(F.lit("r"), F.expr("event_id div 3")).alias("report_id"),
        F.col("ts").alias("measurement_start_time"),
        F.col("user_id").alias("probe_asn"),
        F.expr("case when event_id % 97 = 0 then 'ZZ' else concat(char(65 + user_id % 25), char(90 - user_id % 25)) end").alias("probe_cc"),
        test.alias("test_name"),
        url.alias("input"),
        F.when(F.expr("k % 10 = 9"), "").otherwise(F.concat(F.lit("d"), F.col("k"), F.lit(".example"))).alias("domain"),
        yes("value > 50").alias("anomaly"),
        yes("value > 100").alias("confirmed"),
        yes("event_id % 17 = 0").alias("msm_failure"),
        (F.col("value") / 100).alias("blocking_general"),
        F.expr("case event_id % 4 when 0 then '' when 1 then 'dns' when 2 then 'tcp_ip' else 'http-failure' end").alias("blocking_type"),
        F.expr("case when event_id % 3 = 0 then user_id else 1000 + event_id % 7 end").alias("resolver_asn"),
        F.expr("case when event_id % 5 = 0 then '{}' else concat('{\"extra\":{\"test_runtime\":', event_id % 1000, '}}') end").alias("scores"),
        F.expr("case event_id % 3 when 0 then 'android' when 1 then 'ios' else 'linux' end").alias("platform"),
        F.concat(F.lit("3."), F.expr("event_id % 20"), F.lit(".0")).alias("software_version"),
        F.expr("k % 7").alias("run_link_id"),
        F.col("k"),
        F.col("value"),
    )


def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("http://d"), F.expr("p_partkey % 90"), F.lit(".example/")).alias("url"),
        F.concat(F.lit("d"), F.expr("p_partkey % 90"), F.lit(".example")).alias("domain"),
        F.expr("case p_partkey % 7 when 0 then 'zz' when 1 then 'az' when 2 then 'by' when 3 then 'zz' else 'cx' end").alias("cc"),
        F.substring("p_type", 1, 4).alias("category_code"),
    ).distinct()


def asn_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("asn"), F.concat(F.lit("ORG"), F.expr("o_orderkey % 50")).alias("org_name"), F.col("o_orderdate").alias("changed"))


def rule_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier")
    return s.select(
        F.expr("case s_suppkey % 5 when 0 then 'ECON' when 1 then 'SMAL' when 2 then '*' when 3 then '' else 'PROM' end").alias("category_code"),
        F.expr("case s_suppkey % 3 when 0 then '*' when 1 then 'az' else 'BY' end").alias("cc"),
        F.expr("case when s_suppkey % 4 = 0 then concat('d', s_suppkey % 90, '.example') else '*' end").alias("domain"),
        F.lit("*").alias("url"),
        F.expr("s_nationkey * 10 - 60").alias("priority"),
        F.expr("case when s_suppkey % 11 = 0 then -1 else 1 end").alias("sign"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One network observation per measurement, with failures by layer and likelihoods."""
    m = measurements(spark, sf_dir)
    return m.where("domain <> ''").select(
        "measurement_uid", "measurement_start_time", "probe_asn", "probe_cc", "test_name", "resolver_asn", F.col("domain").alias("hostname"),
        F.concat(F.lit("10.0.0."), F.expr("k % 50")).alias("ip"),
        F.expr("case event_id % 11 when 0 then 'dns_nxdomain_error' when 1 then 'android_dns_cache_no_data' when 2 then 'unknown_failure: x' end").alias("dns_failure"),
        F.expr("case event_id % 13 when 0 then 'generic_timeout_error' when 1 then 'connection_refused' end").alias("tcp_failure"),
        F.expr("case event_id % 19 when 0 then 'ssl_failed_handshake' end").alias("tls_failure"),
        F.expr("case event_id % 23 when 0 then 'eof_error' end").alias("http_failure"),
        F.expr("event_id % 2 = 0").alias("tls_used"),
        F.expr("(event_id % 101) / 101").alias("dns_blocked"), F.expr("(event_id % 103) / 103").alias("tcp_blocked"), F.expr("(event_id % 107) / 107").alias("tls_blocked"),
        F.expr("case event_id % 6 when 0 then 'dns.a' when 1 then 'dns.a' when 2 then 'tcp.b' else 'ok' end").alias("label"),
        "event_id",
    )


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One analysis per web measurement: likelihoods of blocked, down and ok by protocol, the failure behind each, a label."""
    o = observations(spark, sf_dir)
    likely = [F.expr(f"(event_id % {n}) / {n}").alias(f"{p}_{k}") for p, a in (("dns", 101), ("tcp", 103), ("tls", 107)) for k, n in (("down", a + 6), ("ok", a + 8))]
    return o.select(
        "measurement_uid", "measurement_start_time", "probe_asn", "probe_cc", "test_name", F.col("hostname").alias("domain"), F.col("label").alias("top_probe_analysis"),
        F.col("dns_failure").alias("top_dns_failure"), F.col("tcp_failure").alias("top_tcp_failure"), F.col("tls_failure").alias("top_tls_failure"), "dns_blocked", "tcp_blocked", "tls_blocked", *likely,
    )


CC = "case when event_id % 97 = 0 then 'ZZ' else chr(cast(65 + user_id % 25 as integer)) || chr(cast(90 - user_id % 25 as integer)) end"
M = f"""m as (
  select event_id, cast(event_id as varchar) as measurement_uid, 'r' || cast(event_id // 3 as varchar) as report_id, ts as measurement_start_time, user_id as probe_asn,
    {CC} as probe_cc,
    case event_type when 'click' then 'web_connectivity' when 'view' then 'torsf' when 'error' then 'openvpn' when 'purchase' then 'whatsapp' else 'signal' end as test_name,
    case when k % 10 = 9 then '' else 'http://d' || k || '.example/' end as input, case when k % 10 = 9 then '' else 'd' || k || '.example' end as domain,
    case when value > 50 then 't' else 'f' end as anomaly, case when value > 100 then 't' else 'f' end as confirmed, case when event_id % 17 = 0 then 't' else 'f' end as msm_failure,
    value / 100 as blocking_general, case event_id % 4 when 0 then '' when 1 then 'dns' when 2 then 'tcp_ip' else 'http-failure' end as blocking_type,
    case when event_id % 3 = 0 then user_id else 1000 + event_id % 7 end as resolver_asn,
    case when event_id % 5 = 0 then null else event_id % 1000 end as runtime,
    case event_id % 3 when 0 then 'android' when 1 then 'ios' else 'linux' end as platform, '3.' || cast(event_id % 20 as varchar) || '.0' as software_version, k % 7 as run_link_id, k, value
  from (select *, cast(json_extract_string(props, '$.k') as integer) as k from events))"""
CZ = """cz as (
  select distinct 'http://d' || cast(p_partkey % 90 as varchar) || '.example/' as url, 'd' || cast(p_partkey % 90 as varchar) || '.example' as domain,
    case p_partkey % 7 when 0 then 'zz' when 1 then 'az' when 2 then 'by' when 3 then 'zz' else 'cx' end as cc, substr(p_type, 1, 4) as category_code from part)"""
AM = "am as (select o_custkey as asn, 'ORG' || cast(o_orderkey % 50 as varchar) as org_name, o_orderdate as changed from orders)"
RL = """rl as (
  select case s_suppkey % 5 when 0 then 'ECON' when 1 then 'SMAL' when 2 then '*' when 3 then '' else 'PROM' end as category_code,
    case s_suppkey % 3 when 0 then '*' when 1 then 'az' else 'BY' end as cc, case when s_suppkey % 4 = 0 then 'd' || cast(s_suppkey % 90 as varchar) || '.example' else '*' end as domain,
    '*' as url, s_nationkey * 10 - 60 as priority, case when s_suppkey % 11 = 0 then -1 else 1 end as sign from supplier)"""
OB = f"""{M}, ob as (
  select measurement_uid, measurement_start_time, probe_asn, probe_cc, test_name, resolver_asn, domain as hostname, '10.0.0.' || cast(k % 50 as varchar) as ip,
    case event_id % 11 when 0 then 'dns_nxdomain_error' when 1 then 'android_dns_cache_no_data' when 2 then 'unknown_failure: x' end as dns_failure,
    case event_id % 13 when 0 then 'generic_timeout_error' when 1 then 'connection_refused' end as tcp_failure, case event_id % 19 when 0 then 'ssl_failed_handshake' end as tls_failure,
    case event_id % 23 when 0 then 'eof_error' end as http_failure, event_id % 2 = 0 as tls_used,
    (event_id % 101) / 101.0 as dns_blocked, (event_id % 103) / 103.0 as tcp_blocked, (event_id % 107) / 107.0 as tls_blocked,
    case event_id % 6 when 0 then 'dns.a' when 1 then 'dns.a' when 2 then 'tcp.b' else 'ok' end as label, event_id
  from m where domain <> '')"""
AN_SELECT = """select measurement_uid, measurement_start_time, probe_asn, probe_cc, test_name, hostname as domain, label as top_probe_analysis, dns_failure as top_dns_failure, tcp_failure as top_tcp_failure, tls_failure as top_tls_failure,
    dns_blocked, tcp_blocked, tls_blocked, (event_id % 107) / 107.0 as dns_down, (event_id % 109) / 109.0 as dns_ok, (event_id % 109) / 109.0 as tcp_down, (event_id % 111) / 111.0 as tcp_ok, (event_id % 113) / 113.0 as tls_down, (event_id % 115) / 115.0 as tls_ok from ob"""
