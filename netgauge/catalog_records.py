"""Registered queries of record building: scalars, validation, dates, whole fact rows, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgauge.catalog import msm, query
from netgauge.functions import legacy, scalar
from netgauge.plans import views
from netgauge.plans.views import AS_OF, M
from netgauge.sources import archives
from netgauge.streaming import ingest


def dealt(values: tuple, by: str = "event_id") -> tuple[str, str]:
    """One of the values by event, as SQL of Spark and of DuckDB."""
    quoted = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    spark = ", ".join(quoted(v).replace("\\", "\\\\") for v in values)
    return f"element_at(array({spark}), cast({by} % {len(values)} + 1 as int))", f"([{', '.join(map(quoted, values))}])[1 + {by} % {len(values)}]"


# ---- scalars ----

ASNS, ASNS_SQL = dealt(("AS12", " as7 ", "x", None, "15"))


@query(f"with {M} select measurement_uid, ([12, 7, 0, 0, 15])[1 + event_id % 5] as asn from m")
def x2_asn_numbers(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select("measurement_uid", scalar.asn_number(F.expr(ASNS)).alias("asn"))


LISTS, LISTS_SQL = dealt(("b, a,,a ", "", "zz,IT, it", "x"))


@query(f"with {M}, l as (select measurement_uid, list_sort(list_distinct(list_filter(list_transform(string_split({LISTS_SQL}, ','), lambda x: trim(x)), lambda x: x <> ''))) as items, list_sort(list_filter(list_transform(string_split({LISTS_SQL}, ','), lambda x: upper(trim(x))), lambda x: x not in ('', 'ZZ'))) as countries from m) select measurement_uid, array_to_string(items, '|') as items, array_to_string(countries, '|') as countries from l")
def x3_x4_lists(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select("measurement_uid", F.array_join(scalar.split_list(F.expr(LISTS)), "|").alias("items"), F.array_join(scalar.expected_countries(F.expr(LISTS)), "|").alias("countries"))


@query("select p_partkey, '2024-' || substr(regexp_replace(replace(lower(p_name || ' (NEW) ' || p_type || ': a long title that goes on and on and on, past the end'), ' ', '-'), '[^a-z0-9-]', '', 'g'), 1, 64) as slug from part")
def x5_slugs(s: SparkSession, d: str) -> DataFrame:
    title = F.concat("p_name", F.lit(" (NEW) "), "p_type", F.lit(": a long title that goes on and on and on, past the end"))
    return views.read(s, d, "part").select("p_partkey", scalar.slug(F.lit("2024-03-05").cast("timestamp"), title).alias("slug"))


@query()
def x6_uids(s: SparkSession, d: str) -> DataFrame:
    """SHA-512 isn't in DuckDB; tested against Python."""
    return msm(s, d).select("event_id", scalar.measurement_uid(F.col("measurement_start_time").cast("timestamp"), F.col("probe_cc"), F.col("test_name"), F.col("scores")).alias("uid"))


@query(f"with {M} select measurement_uid, sha256('key' || '10.0.0.' || cast(k as varchar)) as hashed, '10.0.0.' || cast(k as varchar) as first from m")
def x9_x10_client_addresses(s: SparkSession, d: str) -> DataFrame:
    ip = F.concat(F.lit("10.0.0."), "k")
    return msm(s, d).select("measurement_uid", scalar.keyed_hash(ip, "key").alias("hashed"), scalar.first_forwarded(F.concat(F.lit(" "), ip, F.lit(" , 1.1.1.1"))).alias("first"))


URLS = ("http://u:p@h.org:80/a?b#c", "//h.org/x", "h.org/x", "https://h.org?q", "")


@query(f"""with {M} select measurement_uid, case when event_id % 6 = 5 then '{{http://a.org/,http://b.org/}}' else ({list(URLS)})[1 + event_id % 6] end as input, (['u:p@h.org:80', 'h.org', '', 'h.org', '', 'a.org'])[1 + event_id % 6] as domain from m""")
def x1_inputs_and_domains(s: SparkSession, d: str) -> DataFrame:
    """Inputs as text or as a list."""
    one = F.concat(F.lit('{"input":"'), F.expr(dealt((*URLS, ""))[0]), F.lit('"}'))
    v = F.try_parse_json(F.when(F.expr("event_id % 6 = 5"), '{"input":["http://a.org/","http://b.org/"]}').otherwise(one))
    r = msm(s, d).select("measurement_uid", v.alias("v"))
    input_, domain = scalar.input_and_domain(F.col("v"))
    return r.select("measurement_uid", input_.alias("input"), domain.alias("domain"))


OLD_TIMES, _ = dealt(("1389999999", "1389999999.7", "2014-01-17 23:06:39", "soon", None))


@query(f"with {M} select measurement_uid, (['2014-01-17 23:06:39', '2014-01-17 23:06:39', '2014-01-17 23:06:39', null, null])[1 + event_id % 5] as t from m")
def x18_legacy_times(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select("measurement_uid", scalar.legacy_time(F.expr(OLD_TIMES)).alias("t"))


@query(f"with {M}, l as (select probe_cc, list_sort(list(distinct input) filter (where event_id % 2 = 0)) as a, list_sort(list(distinct input) filter (where event_id % 3 = 0)) as b from m group by 1) select probe_cc, coalesce(array_to_string(list_sort(list_concat(list_filter(a, lambda x: not list_contains(b, x)), list_filter(b, lambda x: not list_contains(a, x)))), '|'), '') as changed from l where a is not null and b is not null")
def u2_symmetric_difference(s: SparkSession, d: str) -> DataFrame:
    r = msm(s, d).groupBy("probe_cc").agg(F.collect_set(F.expr("case when event_id % 2 = 0 then input end")).alias("a"), F.collect_set(F.expr("case when event_id % 3 = 0 then input end")).alias("b")).where("size(a) > 0 and size(b) > 0")
    return r.select("probe_cc", F.array_join(F.array_sort(scalar.symmetric_difference(F.col("a"), F.col("b"))), "|").alias("changed"))


# ---- dates ----


@query(f"with {M} select distinct strftime(measurement_start_time, '%Y-%m-%dT00:00:00+00:00') as midnight, strftime(measurement_start_time, '%Y-%m-%dT%H:%M:%SZ') as instant from m")
def d5_iso_forms(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select(scalar.iso_midnight(F.col("measurement_start_time")).alias("midnight"), scalar.iso_z(F.col("measurement_start_time")).alias("instant")).distinct()


DATES = (("2024-01-05", "2024-01-05 00:00:00"), ("2024-01-05T10:11:12", "2024-01-05 10:11:12"), ("2024-01-05 10:11:12", "2024-01-05 10:11:12"), ("20240105T101112Z", "2024-01-05 10:11:12"), ("2024-01-05T10:11:12+02:00", "2024-01-05 08:11:12"), ("5 Jan 2024", "2024-01-05 00:00:00"), ("soon", None), (None, None))
DATE_TEXTS, _ = dealt(tuple(a for a, _ in DATES))
DATE_TIMES = dealt(tuple(b for _, b in DATES))[1]


@query(f"with {M} select measurement_uid, {DATE_TIMES} as t from m")
def d6_lenient_dates(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select("measurement_uid", F.date_format(scalar.lenient_time(F.expr(DATE_TEXTS)), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query(f"with {M} select measurement_uid, least(measurement_start_time, timestamp '2024-01-15') as ts from m")
def f10_clamped_times(s: SparkSession, d: str) -> DataFrame:
    from netgauge.operators import detector

    return msm(s, d).select("measurement_uid", detector.clamped(F.col("measurement_start_time"), F.lit("2024-01-15").cast("timestamp_ntz")).alias("ts"))


@query(f"with {M} select measurement_uid, event_id % 5 in (1, 2) as wrong from m")
def f9_wrong_dates(s: SparkSession, d: str) -> DataFrame:
    """Made two hours before, 400 days after, just after the start; uids of another form say nothing."""
    start = F.col("measurement_start_time").cast("timestamp")
    made = F.expr("case event_id % 5 when 1 then ts - interval 2 hours when 2 then ts + interval 400 days else ts + interval 1 minute end")
    uid = F.when(F.expr("event_id % 5 = 4"), "x20240101").otherwise(F.concat(F.date_format(made, "yyyyMMddHHmmss.SSSSSS"), F.lit("_IT_x_abc")))
    return msm(s, d).withColumn("ts", start).select("measurement_uid", scalar.wrong_date(uid, F.col("ts")).alias("wrong"))


# ---- validation ----

ENTRIES = (("http://a.org/", "NEWS", "2024-01-05", ""), ("http://a.org", "NEWS", "2024-01-05", "bad_url"), (" http://a.org/", "NEWS", "2024-1-5", "bad_url;bad_date"), ("ftp://a.org/", "NOPE", "2024-02-30", "bad_url;bad_category;bad_date"), ("https://a.org/x\\y", "GAME", "2024-02-29", "bad_url"), (None, None, None, "bad_url;bad_category;bad_date"))
ENTRY = [dealt(tuple(e[i] for e in ENTRIES)) for i in range(4)]


@query(f"with {M} select measurement_uid, {ENTRY[3][1]} as faults from m")
def f7_entry_faults(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select("measurement_uid", F.array_join(scalar.entry_faults(*[F.expr(e[0]) for e in ENTRY[:3]]), ";").alias("faults"))


RID = "20240102T030405Z_signal_IT_30722_n1_abcdef"
REPORTS = ((RID, "IT", "AS30722", "signal", ""), (RID, "FR", "AS30722", "signal", "cc"), (RID, "IT", "AS1", "web_connectivity", "asn;test_name"), ("20240102_signal_IT_1_n1_x", "IT", "AS1", "signal", "bad_id"), ("20240102T030405Z_webconnectivity_IT_5_n1_x", "IT", "AS5", "web_connectivity", ""), (None, "IT", "AS1", "signal", "bad_id"))
REPORT = [dealt(tuple(r[i] for r in REPORTS)) for i in range(5)]


@query(f"with {M} select measurement_uid, {REPORT[4][1]} as faults from m")
def f8_report_faults(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select("measurement_uid", F.array_join(scalar.report_faults(*[F.expr(r[0]) for r in REPORT[:4]]), ";").alias("faults"))


TESTS = ("DNS tamper", "captivep", "tcp_connect", "WebX", "multi_protocol_traceroute_test", "tls-handshake")


@query(f"with {M} select case event_id % 6 when 0 then 'dns_consistency' else 'webx' end as name, count(*) as n from m where event_id % 6 in (0, 3) group by 1")
def f14_supported_records(s: SparkSession, d: str) -> DataFrame:
    """Old records of tests that are no longer read are left out."""
    return legacy.supported(msm(s, d).withColumn("test_name", F.expr(dealt(TESTS)[0]))).groupBy(F.col("test_name").alias("name")).agg(F.count("*").alias("n"))


@query(f"""with {M} select measurement_uid, case when event_id % 2 = 0 then 'content,format' else 'content,format,protocol_version' end as fields from m""")
def f13_without_secrets(s: SparkSession, d: str) -> DataFrame:
    text = F.expr("""concat('{"format":"json","content":{"a":1},"nym":"x","zkp_request":"y"', case when event_id % 2 = 0 then '' else ',"protocol_version":"1"' end, '}')""")
    r = archives.without_secrets(msm(s, d).select("measurement_uid", F.try_parse_json(text).alias("v")))
    return r.select("measurement_uid", F.array_join(F.array_sort(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))), ",").alias("fields"))


# ---- whole rows ----


def raw(s: SparkSession, d: str) -> DataFrame:
    """measurement_uid, body: records with fields missing, null or odd here and there, some broken."""
    opt = lambda sql, text: F.when(F.expr(sql), F.lit(text)).otherwise("")
    body = F.concat(
        F.lit('{"test_name":"'), "test_name", F.lit('","probe_cc":"'), F.lower("probe_cc"), F.lit('","probe_asn":"AS'), "probe_asn", F.lit('","input":'), F.when(F.col("input") == "", "null").otherwise(F.concat(F.lit('"'), "input", F.lit('"'))),
        opt("event_id % 7 <> 0", ',"report_id":"r"'), F.lit(',"measurement_start_time":"'), F.date_format("measurement_start_time", "yyyy-MM-dd HH:mm:ss"), F.lit('","test_start_time":"2024-01-01 00:00:00"'),
        opt("event_id % 4 = 0", ',"software_name":"probe","test_runtime":1.5'), opt("event_id % 5 = 0", ',"annotations":{"platform":"ios","x_run_link_id":"77"}'), opt("event_id % 5 = 1", ',"annotations":{"platform":null,"x_run_link_id":"none"}'),
        F.lit(',"test_keys":{"success":'), F.expr("case event_id % 3 when 0 then 'false' when 1 then 'true' else 'null' end"), F.lit(',"failure":null}'), opt("event_id % 13 <> 0", "}"),
    )
    uid = F.concat(F.date_format(F.expr("measurement_start_time + case when event_id % 6 = 0 then interval 500 days else interval 0 days end"), "yyyyMMddHHmmss.SSSSSS"), F.lit("_"), "measurement_uid")
    return msm(s, d).where("test_name = 'openvpn'").select(uid.alias("measurement_uid"), body.alias("body"))


@query(f"""with {M}, r as (select *, case when event_id % 6 = 0 then 0.0 when event_id % 3 = 2 then 0.0 end as accuracy, case when event_id % 3 = 0 then 1.0 else 0.0 end as blocking from m where test_name = 'openvpn' and event_id % 13 <> 0 and event_id % 7 <> 0 and probe_cc <> 'ZZ' and probe_asn <> 0)
select measurement_uid, input, domain, probe_cc, probe_asn, strftime(measurement_start_time, '%Y-%m-%d %H:%M:%S') as started, case when event_id % 5 = 0 then 'ios' else 'unset' end as platform, case when event_id % 4 = 0 then 'probe' else 'unknown' end as software_name, case when event_id % 4 = 0 then 1.5 else 0.0 end as test_runtime,
  case when event_id % 5 = 0 then 77 end as run_link_id, case when blocking > 0.5 then 't' else 'f' end as anomaly, case when coalesce(accuracy, 1.0) < 0.5 then 't' else 'f' end as msm_failure, 'f' as confirmed, blocking as blocking_general from r""")
def p1_fact_rows(s: SparkSession, d: str) -> DataFrame:
    """Raw records to whole fact rows, defaults and discards included."""
    r = ingest.scored(raw(s, d))
    return r.select(F.substring_index("measurement_uid", "_", -1).alias("measurement_uid"), "input", "domain", "probe_cc", "probe_asn", F.date_format("measurement_start_time", "yyyy-MM-dd HH:mm:ss").alias("started"), "platform", "software_name", "test_runtime", "run_link_id", "anomaly", "msm_failure", "confirmed", "blocking_general")


@query(f"""with {M} select measurement_uid, 'AS' || cast(probe_asn as varchar) as probe_asn, nullif(input, '') as input, anomaly = 't' as anomaly, confirmed = 't' as confirmed, msm_failure = 't' as failure, 'https://api.example/raw?uid=' || measurement_uid as measurement_url, runtime from m where probe_cc = 'BY'""")
def p4_list_rows(s: SparkSession, d: str) -> DataFrame:
    scores = F.from_json("scores", "extra struct<test_runtime: bigint>")
    flag = lambda c: F.col(c) == "t"
    return msm(s, d).where("probe_cc = 'BY'").select("measurement_uid", F.concat(F.lit("AS"), "probe_asn").alias("probe_asn"), F.nullif("input", F.lit("")).alias("input"), flag("anomaly").alias("anomaly"), flag("confirmed").alias("confirmed"), flag("msm_failure").alias("failure"), F.concat(F.lit("https://api.example/raw?uid="), "measurement_uid").alias("measurement_url"), scores["extra"]["test_runtime"].alias("runtime"))


@query(f"""with {M}, z as (select distinct 'http://d' || cast(p_partkey % 90 as varchar) || '.example/' as url from part) select date_trunc('day', measurement_start_time) as day, probe_cc, input, count(*) as msmt_cnt from m join z on url = input where test_name = 'web_connectivity' and measurement_start_time < timestamp '2024-01-20' and measurement_start_time > timestamp '2024-01-12' group by 1, 2, 3""")
def t3_daily_counters(s: SparkSession, d: str) -> DataFrame:
    """The batch that the stream of counters equals."""
    fact = msm(s, d).withColumn("measurement_start_time", F.col("measurement_start_time").cast("timestamp"))
    web = ingest.recent_web(fact, views.url_list(s, d), F.lit("2024-01-20").cast("timestamp"))
    return ingest.daily_counters(web).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "probe_cc", "input", "msmt_cnt")


TORS = ("true", "false", "null", '{"is_tor":true,"exit_ip":"1.1.1.1"}', '{"is_tor":false}', '"odd"')


@query(f"with {M} select measurement_uid, case when event_id % 7 = 0 then true else ([true, false, false, true, false, null])[1 + event_id % 6] end as tor from m")
def x17_over_tor(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"url":"'), F.expr("case when event_id % 7 = 0 then 's' else '' end"), F.lit('http://a.org/","tor":'), F.expr(dealt(TORS)[0]), F.lit("}"))
    return msm(s, d).select("measurement_uid", legacy.over_tor(F.try_parse_json(text)).alias("tor"))


@query()
def x8_legacy_report_ids(s: SparkSession, d: str) -> DataFrame:
    """SHA-512 isn't in DuckDB; tested against Python."""
    return msm(s, d).select("measurement_uid", legacy.legacy_report_id(F.col("measurement_start_time").cast("timestamp"), F.col("probe_cc"), F.concat(F.lit("AS"), "probe_asn"), F.col("test_name"), F.col("software_version"), F.lit(None).cast("string")).alias("report_id"))
