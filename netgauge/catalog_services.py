"""Registered queries of lookups, older records, links, findings and archive upkeep, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgauge import catalog
from netgauge.catalog import msm, query
from netgauge.functions import legacy
from netgauge.operators import links, lookup, priority
from netgauge.plans import views
from netgauge.plans.views import CZ, OB, M
from netgauge.sources import archives, bundles
from netgauge.sources.store import shared_folder

# ---- lookups ----


@query("""select l.l_orderkey, l.l_linenumber, o.o_orderdate, p.p_type from lineitem l join orders o on o.o_orderkey = l.l_orderkey join part p on p.p_partkey = l.l_partkey
where o.o_orderdate >= timestamp '1997-01-01' and o.o_orderpriority = '1-URGENT' and p.p_type = 'ECONOMY'""")
def j10_measurement_report_input(s: SparkSession, d: str) -> DataFrame:
    """Lines as measurements, orders as reports, parts as inputs."""
    o = views.read(s, d, "orders").where((F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp")) & (F.col("o_orderpriority") == "1-URGENT"))
    p = views.read(s, d, "part").where("p_type = 'ECONOMY'")
    line = views.read(s, d, "lineitem").withColumnsRenamed({"l_orderkey": "o_orderkey", "l_partkey": "p_partkey"})
    return line.join(o, "o_orderkey").join(p, "p_partkey").select(F.col("o_orderkey").alias("l_orderkey"), "l_linenumber", "o_orderdate", "p_type")


@query(f"""with {OB}, f as (select n_name as name, '10.0.0.' || cast(n_nationkey as varchar) as pattern from nation)
select measurement_uid as uid, f.name from ob join f on f.pattern = case when event_id % 4 = 0 then 'h.example' else ob.ip end""")
def j12_dns_fingerprints(s: SparkSession, d: str) -> DataFrame:
    f = views.read(s, d, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("10.0.0."), "n_nationkey").alias("pattern"))
    o = views.observations(s, d).select(F.col("measurement_uid").alias("uid"), F.when(F.expr("event_id % 4 <> 0"), F.col("ip")).alias("ipv4"), F.lit("h.example").alias("hostname"), F.lit(None).cast("string").alias("ipv6"))
    return lookup.dns_matches(o, f)


@query("""with f as (select n_name as name, 'track(' || cast(n_nationkey as varchar) || ')' as pattern from nation) select cast(page_id as varchar) as uid, name from pages join f on contains(html, pattern)""")
def j12_body_fingerprints(s: SparkSession, d: str) -> DataFrame:
    f = views.read(s, d, "nation").select(F.col("n_name").alias("name"), F.format_string("track(%d)", "n_nationkey").alias("pattern"))
    return lookup.body_matches(views.read(s, d, "pages").select(F.col("page_id").alias("uid"), F.col("html").alias("body")), f)


@query("""with h as (select page_id as uid, 'nginx/' || cast(page_id % 30 as varchar) as v from pages), f as (select n_name as name, case when n_nationkey % 2 = 0 then 'full' else 'prefix' end as kind, 'nginx/' || cast(n_nationkey as varchar) as pattern from nation)
select uid, name from h join f on case when kind = 'full' then v = pattern else starts_with(v, pattern) end""")
def j12_header_fingerprints(s: SparkSession, d: str) -> DataFrame:
    f = views.read(s, d, "nation").select(F.col("n_name").alias("name"), F.lit("header.server").alias("location_found"), F.expr("case when n_nationkey % 2 = 0 then 'full' else 'prefix' end").alias("pattern_type"), F.concat(F.lit("nginx/"), "n_nationkey").alias("pattern"))
    h = views.read(s, d, "pages").select(F.col("page_id").alias("uid"), F.create_map(F.lit("Server"), F.concat(F.lit("nginx/"), F.expr("page_id % 30"))).alias("headers"))
    return lookup.header_matches(h, f)


POLICY = "case when s_suppkey % 3 = 0 then '*' else chr(cast(65 + s_nationkey as integer)) || chr(cast(90 - s_nationkey as integer)) end"


@query(f"""with {M}, p as (select s_suppkey as rule_no, {POLICY} as cc, case when s_suppkey % 4 = 0 then '*' else 'AS' || cast(s_suppkey % 20 as varchar) end as asn, s_suppkey % 9 as least from supplier),
k as (select distinct probe_cc, 'AS' || cast(probe_asn as varchar) as probe_asn from m)
select k.probe_cc, k.probe_asn, min(rule_no) as rule_no, arg_min(least, rule_no) as least from k left join p on (cc = '*' or cc = probe_cc) and (asn = '*' or asn = probe_asn) group by 1, 2""")
def j14_first_policy(s: SparkSession, d: str) -> DataFrame:
    cc = F.expr("case when s_suppkey % 3 = 0 then '*' else concat(char(65 + s_nationkey), char(90 - s_nationkey)) end")
    p = views.read(s, d, "supplier").select(F.col("s_suppkey").alias("rule_no"), cc.alias("cc"), F.expr("case when s_suppkey % 4 = 0 then '*' else concat('AS', s_suppkey % 20) end").alias("asn"), F.expr("s_suppkey % 9").alias("least"))
    return lookup.first_policy(msm(s, d).select("probe_cc", F.concat(F.lit("AS"), "probe_asn").alias("probe_asn")), p)


IP = "(event_id * 7919) % 60000000"
IPS = f"""{M}, r as (select s_suppkey * 500000 + 1000 as a, s_suppkey * 500000 + 420000 as z, 'C' || cast(s_nationkey as varchar) as cc, s_suppkey as asn from supplier),
g as (select measurement_uid, case when event_id % 2 = 0 then coalesce(r.cc, 'ZZ') else probe_cc end as probe_cc, case when event_id % 3 = 0 then coalesce(r.asn, 0) else probe_asn end as probe_asn, coalesce(r.cc, 'ZZ') as geo_cc, coalesce(r.asn, 0) as geo_asn from m left join r on {IP} between r.a and r.z)"""


def placed(s: SparkSession, d: str) -> DataFrame:
    """Measurements with an address; some of the probes give the place that their address has."""
    r = views.read(s, d, "supplier").select(F.expr("s_suppkey * 500000 + 1000").alias("first"), F.expr("s_suppkey * 500000 + 420000").alias("last"), F.concat(F.lit("C"), "s_nationkey").alias("cc"), F.col("s_suppkey").alias("asn"), F.col("s_nationkey").cast("string").alias("org"))
    n = F.expr(IP)
    ip = F.concat_ws(".", *[F.shiftright(n, b).bitwiseAND(F.lit(255)).cast("string") for b in (24, 16, 8, 0)])
    m = lookup.located(msm(s, d).select("event_id", "measurement_uid", "probe_cc", "probe_asn", ip.alias("ip")), r)
    return m.withColumns({"probe_cc": F.expr("case when event_id % 2 = 0 then geo_cc else probe_cc end"), "probe_asn": F.expr("case when event_id % 3 = 0 then geo_asn else probe_asn end")})


@query(f"with {IPS} select measurement_uid, geo_cc, geo_asn from g")
def j15_located_probes(s: SparkSession, d: str) -> DataFrame:
    return placed(s, d).select("measurement_uid", "geo_cc", "geo_asn")


@query(f"""with {M}, r as (select s_suppkey * 500000 + 1000 as a, s_suppkey * 500000 + 420000 as z, 'C' || cast(s_nationkey as varchar) as cc, s_suppkey as asn from supplier)
select measurement_uid, coalesce(case event_id % 4 when 1 then 'V' || r.cc when 3 then 'XX' else r.cc end, 'ZZ') as geo_cc, coalesce(case when event_id % 4 = 3 then 64496 else r.asn end, 0) as geo_asn
from m left join r on event_id % 4 <> 3 and {IP} between r.a and r.z""")
def j15_both_families(s: SparkSession, d: str) -> DataFrame:
    """IPv4, IPv6 and IPv4 in IPv6's form, against ranges of both families, one of which spans most of the space."""
    r = views.read(s, d, "supplier").select(F.expr("s_suppkey * 500000 + 1000").alias("a"), F.expr("s_suppkey * 500000 + 420000").alias("z"), F.concat(F.lit("C"), "s_nationkey").alias("cc"), F.col("s_suppkey").alias("asn"))
    # IPv4 has no address for numbers of more than 32 bits; IPv6 has one for all.
    dotted = lambda n: F.when(n < 1 << 32, F.concat_ws(".", *[F.shiftright(n, b).bitwiseAND(F.lit(255)).cast("string") for b in (24, 16, 8, 0)]))
    long = lambda n: F.concat(F.lit("2001:DB8::"), F.concat_ws(":", *[F.hex(F.shiftright(n, b).bitwiseAND(F.lit(65535))) for b in (48, 32, 16, 0)]))
    side = lambda text, cc, z: r.select(text(F.col("a")).alias("first"), text(z).alias("last"), cc.alias("cc"), F.col("asn").cast("long").alias("asn"), F.lit("").alias("org"))
    most = s.createDataFrame([("3000::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "XX", 64496, "")], "first string, last string, cc string, asn long, org string")
    ranges = side(dotted, F.col("cc"), F.least("z", F.lit((1 << 32) - 1))).unionByName(side(long, F.concat(F.lit("V"), "cc"), F.col("z"))).unionByName(most)
    n = F.expr(IP)
    ip = F.when(F.expr("event_id % 4 = 0"), dotted(n)).when(F.expr("event_id % 4 = 1"), long(n)).when(F.expr("event_id % 4 = 2"), F.concat(F.lit("::ffff:"), dotted(n))).otherwise(F.concat(F.lit("fe80::"), F.hex(F.expr("event_id % 65536")), F.lit(":1")))
    return lookup.located(msm(s, d).select("event_id", "measurement_uid", ip.alias("ip")), ranges).select("measurement_uid", "geo_cc", "geo_asn")


@query(f"""with {IPS} select measurement_uid, case when geo_cc <> probe_cc then 'geoip_cc' else 'geoip_asn' end as type, '{{"cc":"' || geo_cc || '","asn":' || cast(geo_asn as varchar) || '}}' as details from g where geo_cc <> probe_cc or geo_asn <> probe_asn""")
def p8_faulty_measurements(s: SparkSession, d: str) -> DataFrame:
    return lookup.geo_anomalies(placed(s, d)).select("measurement_uid", "type", "details")


@query(f"""with {M} select measurement_uid, case when event_id % 5 = 0 then 0 else event_id end as last_handshake_transaction_id, case when event_id % 7 = 0 then 0 else probe_asn end as resolver_asn, event_id % 2 = 0 as success from m where test_name = 'openvpn'""")
def p6_openvpn_observations(s: SparkSession, d: str) -> DataFrame:
    body = F.expr("""concat('{"test_name":"openvpn","resolver_asn":"', case when event_id % 7 = 0 then 'none' else concat('AS', probe_asn) end, '","test_keys":{"success":', case when event_id % 2 = 0 then 'true' else 'false' end,
        ',"network_events":[{"transaction_id":', event_id - 1, '},', case when event_id % 5 = 0 then '{"operation":"x"}' else concat('{"transaction_id":', event_id, '}') end, ']}}')""")
    v = msm(s, d).where("test_name = 'openvpn'").select("measurement_uid", F.try_parse_json(body).alias("v"))
    return lookup.openvpn_observations(v).select("measurement_uid", "last_handshake_transaction_id", "resolver_asn", "success")


# ---- records of older formats ----


@query(f"""with {M} select name, count(*) as n from (select case event_id % 5 when 0 then 'http_host' when 1 then 'dns_consistency' when 2 then 'captive_portal' when 3 then 'webx' else 'invalid' end as name from m) group by 1""")
def x12_canonical_tests(s: SparkSession, d: str) -> DataFrame:
    old = F.expr("element_at(array('HTTP Host', 'DNS tamper', 'captivep', 'WebX', 'test_put'), cast(event_id % 5 as int) + 1)")
    return msm(s, d).groupBy(legacy.canonical_test(old).alias("name")).agg(F.count("*").alias("n"))


@query(f"""with {M} select measurement_uid, cast(event_id % 600 as varchar) as ttl, case event_id % 3 when 0 then 'A' when 1 then 'CNAME' else 'SOA' end as answer_type, case when event_id % 3 = 0 then '10.1.2.' || cast(event_id % 200 as varchar) end as ipv4,
  case event_id % 3 when 1 then 'a-' || cast(event_id as varchar) || '.example' when 2 then 'ns.example' end as hostname, case when event_id % 3 = 2 then cast(event_id as varchar) end as serial_number from m""")
def x13_dns_answers(s: SparkSession, d: str) -> DataFrame:
    head = F.expr("concat('<RR name=x type=', case event_id % 3 when 0 then 'A' when 1 then 'CNAME' else 'SOA' end, ' class=IN ttl=', event_id % 600, 's>')")
    rest = F.expr("case event_id % 3 when 0 then concat('<A address=10.1.2.', event_id % 200, ' ttl=None>') when 1 then concat('<CNAME name=a-', event_id, '.example ttl=None>') else concat('<SOA mname=ns.example rname=root.example serial=', event_id, ' refresh=1>') end")
    return msm(s, d).select("measurement_uid", legacy.dns_answer(head, rest).alias("a")).select("measurement_uid", "a.ttl", "a.answer_type", "a.ipv4", "a.hostname", "a.serial_number")


@query(f"""with {M}, e as (select report_id, measurement_uid as u, case event_id % 3 when 0 then true when 1 then false end as t from m)
select report_id, coalesce(string_agg(u, ',' order by u) filter (where not t), '') as successful, coalesce(string_agg(u, ',' order by u) filter (where t is null or not t), '') as failed, coalesce(string_agg(u, ',' order by u) filter (where t), '') as inconsistent from e group by 1""")
def x16_tampering(s: SparkSession, d: str) -> DataFrame:
    pairs = F.collect_list(F.struct("measurement_uid", F.expr("case event_id % 3 when 0 then true when 1 then false end")))
    r = msm(s, d).groupBy("report_id").agg(F.map_from_entries(pairs).alias("errors")).select("report_id", legacy.tampering(F.col("errors")).alias("t"))
    return r.select("report_id", *[F.array_join(F.col(f"t.{c}"), ",").alias(c) for c in ("successful", "failed", "inconsistent")])


@query(f"""with {M}, e as (select report_id, event_id, event_id % 2 = 1 as tor, 'http://' || cast(event_id as varchar) as url, row_number() over (partition by report_id, event_id % 2 order by event_id) as rn from m)
select report_id, string_agg(url, ',' order by (case when rn = 1 then 0 else 2 end) + (case when tor then 1 else 0 end), event_id) as urls from e group by 1""")
def x17_requests_by_tor(s: SparkSession, d: str) -> DataFrame:
    request = F.expr("struct(event_id, concat(case when event_id % 2 = 1 then 's' else '' end, 'http://', event_id) as url, cast(null as boolean) as tor)")
    r = msm(s, d).groupBy("report_id").agg(F.array_sort(F.collect_list(request)).alias("requests"))
    return r.select("report_id", F.array_join(F.transform(legacy.split_by_tor(F.col("requests")), lambda x: x["url"]), ",").alias("urls"))


@query(f"""with {M} select measurement_uid, '7' as content_length, 'nginx' as server, 'x' as extra, case when event_id % 2 = 0 then measurement_uid end as given_id, probe_cc from m""")
def x19_completed_records(s: SparkSession, d: str) -> DataFrame:
    body = F.expr("""concat('{"id":"', case when event_id % 2 = 0 then measurement_uid else '' end, '","probe_cc":"', probe_cc, '","odd":"x","test_keys":{"a":1}}')""")
    record = F.from_json(body, "map<string,string>")
    headers = legacy.header_map(F.array(*[F.array(F.lit(k), F.lit(v)) for k, v in (("Server", "ng\0inx"), ("Content-Length", "7"), ("Server", "second"))]))
    r = msm(s, d).select("measurement_uid", "event_id", headers.alias("h"), legacy.nested(record).alias("n"), *legacy.completed(record, body))
    given = F.when(~F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.col("id"))
    return r.select("measurement_uid", legacy.content_length(F.col("h")).alias("content_length"), F.col("h")["Server"].alias("server"), F.col("n.test_keys")["odd"].alias("extra"), given.alias("given_id"), "probe_cc")


@query()
def x7_trivial_ids(s: SparkSession, d: str) -> DataFrame:
    """SHAKE-128 isn't in SQL; tested against known ids."""
    return views.read(s, d, "pages").select("page_id", legacy.trivial_id(F.encode(F.coalesce("html", F.lit("")), "utf-8"), F.expr("concat('2024-01-', lpad(page_id % 28 + 1, 2, '0'), ' 00:00:00')")).alias("trivial_id"))


@query(f"""with {M} select measurement_uid, strftime(measurement_start_time, '%Y%m%dT%H%M%SZ') || '_' || replace(test_name, '_', '') || '_' || probe_cc || '_' || cast(probe_asn as varchar) || '_n1_' || substr(md5(measurement_uid), 1, 16) as report_id from m""")
def x8_report_ids(s: SparkSession, d: str) -> DataFrame:
    return msm(s, d).select("measurement_uid", legacy.report_id(F.col("measurement_start_time"), F.col("test_name"), F.col("probe_cc"), F.col("probe_asn"), "1", F.substring(F.md5("measurement_uid"), 1, 16)).alias("report_id"))


@query(f"""with {M} select probe_cc, cast(event_id % 4 as varchar) || '.2.3.4' as ip, event_id % 2 = 0 as proxied, count(*) as n from m where event_id % 10 <> 9 group by 1, 2, 3""")
def x11_logged_reports(s: SparkSession, d: str) -> DataFrame:
    line = F.expr("""concat('host nginx: ', case when event_id % 2 = 0 then '1.1.1.1 ' else concat(event_id % 4, '.2.3.4 ') end, case when event_id % 2 = 0 then concat(event_id % 4, '.2.3.4') else '0.0.0.0' end, ' - - [x] "POST',
        case when event_id % 10 = 9 then ' /other__/' else ' /report/' end, '20240101T000000Z_t_', probe_cc, '_', probe_asn, '_n1_abc HTTP/1.1" 200 "probe/3.1"')""")
    r = msm(s, d).select(legacy.report_request(line).alias("r")).where("r is not null")
    return r.groupBy("r.probe_cc", "r.ip", "r.proxied").agg(F.count("*").alias("n"))


# ---- links and findings ----

RV = """rv as (select *, row_number() over (partition by link_id order by created, revision_key) as revision, row_number() over (partition by link_id order by created desc, revision_key desc) = 1 as latest
  from (select o_custkey as link_id, o_orderkey as revision_key, o_orderdate as created, o_orderdate + interval 400 day as expires, o_custkey % 7 as creator, o_orderkey % 5 = 0 as archived, case o_custkey % 3 when 0 then 'AZ' when 1 then 'BY' else 'XX' end as country_code from orders))"""
FD = "fd as (select p_partkey as finding_id, 'f-' || cast(p_partkey as varchar) as slug, p_type as theme, 'C' || cast(p_size % 5 as varchar) as cc, p_size as asn, p_partkey % 6 as creator, p_partkey % 11 = 0 as deleted, p_partkey % 2 = 0 as published from part)"


def revisions(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "orders").select(F.col("o_custkey").alias("link_id"), F.col("o_orderkey").alias("revision_key"), F.col("o_orderdate").alias("created"), F.expr("o_orderdate + interval 400 days").alias("expires"), F.expr("o_custkey % 7").alias("creator"), F.expr("o_orderkey % 5 = 0").alias("archived"), F.expr("case o_custkey % 3 when 0 then 'AZ' when 1 then 'BY' else 'XX' end").alias("country_code"))


def all_findings(s: SparkSession, d: str) -> DataFrame:
    return views.read(s, d, "part").select(F.col("p_partkey").alias("finding_id"), F.concat(F.lit("f-"), "p_partkey").alias("slug"), F.array("p_type").alias("themes"), F.array(F.concat(F.lit("C"), F.expr("p_size % 5"))).alias("ccs"), F.array("p_size").alias("asns"), F.expr("p_partkey % 6").alias("creator"), F.expr("p_partkey % 11 = 0").alias("deleted"), F.expr("p_partkey % 2 = 0").alias("published"), F.concat("p_brand", F.lit("@example.org")).alias("email_address"))


@query(f"""with {RV}, t as (select l_orderkey, string_agg('t' || cast(l_partkey % 9 as varchar), ',' order by l_linenumber, l_partkey % 9) as tests from lineitem group by 1)
select link_id, revision_key, revision, coalesce(tests, '') as tests from rv left join t on l_orderkey = revision_key where latest and expires > timestamp '1998-01-31' and creator = 3""")
def k1_links(s: SparkSession, d: str) -> DataFrame:
    tests = views.read(s, d, "lineitem").select(F.col("l_orderkey").alias("revision_key"), F.col("l_linenumber").alias("nettest_no"), F.concat(F.lit("t"), F.expr("l_partkey % 9")).alias("test_name"))
    r = links.listed(revisions(s, d), tests, "1998-01-31", creator=3)
    return r.select("link_id", "revision_key", F.col("revision").cast("long").alias("revision"), F.coalesce(F.array_join(F.transform("nettests", lambda t: t["test_name"]), ","), F.lit("")).alias("tests"))


@query(f"with {RV} select link_id, revision_key, latest from rv where revision = 2")
def k2_second_revision(s: SparkSession, d: str) -> DataFrame:
    return links.revision(revisions(s, d), 2).select("link_id", "revision_key", "latest")


@query(f"""{catalog.WEIGHT}, u as (select category_code, url, case when upper(cc) = 'ZZ' then 'XX' else upper(cc) end as country_code, w.weight from w where priority > 0), {RV},
n as (select *, row_number() over (partition by country_code order by weight desc, url, category_code) as rn from u), l as (select country_code, string_agg(url, ',' order by rn) as inputs, string_agg(category_code, ',' order by rn) as extra from n where rn <= 15 group by 1)
select link_id, coalesce(inputs, '') as inputs, coalesce(extra, '') as extra from rv left join l on l.country_code = rv.country_code where latest""")
def k3_prioritised_inputs(s: SparkSession, d: str) -> DataFrame:
    urls = priority.test_list(catalog.weights(s, d), None, None)
    r = links.prioritised_inputs(links.revision(revisions(s, d)), urls, 15)
    return r.select("link_id", F.coalesce(F.array_join("inputs", ","), F.lit("")).alias("inputs"), F.coalesce(F.array_join("inputs_extra", ","), F.lit("")).alias("extra"))


@query(f"with {RV} select link_id, revision_key, created from rv where latest and not archived and creator = 2")
def k4_descriptors(s: SparkSession, d: str) -> DataFrame:
    return links.descriptors(revisions(s, d), creator=2).select("link_id", "revision_key", "created")


@query(f"with {FD} select finding_id, creator = 4 as mine, '' as email_address from fd where not deleted and published and theme = 'ECONOMY' and cc = 'C1'")
def k5_findings(s: SparkSession, d: str) -> DataFrame:
    return links.findings(all_findings(s, d), 4, "anonymous", themes=["ECONOMY"], ccs=["C1"]).select("finding_id", "mine", "email_address")


@query(f"with {FD} select finding_id, creator = 2 as mine, finding_id % 3 = 0 as blank from fd where not deleted and theme in ('ECONOMY', 'PROMO') and cc in ('C1', 'C3') and asn in (1, 3, 11, 13, 21, 33, 48) and creator = 2")
def m4_findings_of_any(s: SparkSession, d: str) -> DataFrame:
    """Any of several themes, countries and networks; a signed-in user's own, published or not."""
    f = links.findings(all_findings(s, d), 2, themes=["ECONOMY", "PROMO"], ccs=["C1", "C3"], asns=[1, 3, 11, 13, 21, 33, 48], only_mine=True)
    return f.select("finding_id", "mine", (F.expr("finding_id % 3 = 0") & (F.col("email_address") == "")).alias("blank"))


@query(f"with {FD} select finding_id, published, 'x' || cast(finding_id as varchar) as seen from fd where not deleted")
def p7_findings_for_admins(s: SparkSession, d: str) -> DataFrame:
    f = links.findings(all_findings(s, d), 2, "admin")
    return f.select("finding_id", "published", F.when(F.col("email_address").endswith("@example.org"), F.concat(F.lit("x"), "finding_id")).alias("seen"))


@query(f"with {FD} select finding_id, slug from fd where slug = 'f-17' and not deleted union all select finding_id, slug from fd where finding_id = 18 and not deleted")
def k6_finding_by_id_or_slug(s: SparkSession, d: str) -> DataFrame:
    f = all_findings(s, d)
    return links.finding(f, "f-17").unionByName(links.finding(f, "18")).select("finding_id", "slug")


@query("select coalesce(nullif('http://d' || cast(p_partkey % 90 as varchar) || '.example/', 'http://d0.example/'), '') as url, coalesce(case when p_size % 2 = 0 then p_type end, '') as category_code from part")
def k7_list_of_country(s: SparkSession, d: str) -> DataFrame:
    p = views.read(s, d, "part").select(F.expr("nullif(concat('http://d', p_partkey % 90, '.example/'), 'http://d0.example/')").alias("url"), F.expr("case when p_size % 2 = 0 then p_type end").alias("category_code"))
    return p.na.fill("")


@query(f"""with {CZ}, p(code, priority) as (values {', '.join(map(str, links.DEFAULT_PRIORITIES.items()))})
select url, domain, cc, category_code, coalesce(priority, 0) as priority from (select url, domain, cc, case when cc = 'az' then 'NEWS' when cc = 'by' then 'GAME' else category_code end as category_code from cz) left join p on code = category_code""")
def k8_default_priorities(s: SparkSession, d: str) -> DataFrame:
    u = views.url_list(s, d).withColumn("category_code", F.expr("case when cc = 'az' then 'NEWS' when cc = 'by' then 'GAME' else category_code end"))
    r = links.default_rules(s).select("category_code", F.col("priority").cast("long").alias("priority"))
    return u.join(r, "category_code", "left").select("url", "domain", "cc", "category_code", F.coalesce("priority", F.lit(0)).alias("priority"))


@query(f"with {CZ} select url, category_code from cz where cc = 'zz' and category_code in ('ECON', 'PROM') order by md5('7' || url || category_code), url limit 25")
def l3_sampled_urls(s: SparkSession, d: str) -> DataFrame:
    """A sample that a seed fixes: the rows of smallest hash."""
    u = views.url_list(s, d).where("cc = 'zz' and category_code in ('ECON', 'PROM')")
    return u.orderBy(F.md5(F.concat(F.lit("7"), "url", "category_code")), "url").limit(25).select("url", "category_code")


@query("""select user_id, 1000000 - cast(sum(greatest(cast(floor(value * 100 + 0.0001) as bigint), 1)) as bigint) as remaining from events group by 1 order by 2, 1 limit 20""")
def l6_lowest_quotas(s: SparkSession, d: str) -> DataFrame:
    cost = F.greatest(F.floor(F.col("value") * 100 + 0.0001), F.lit(1))
    return views.read(s, d, "events").groupBy("user_id").agg((1_000_000 - F.sum(cost)).alias("remaining")).orderBy("remaining", "user_id").limit(20)


# ---- upkeep of archives ----


BUNDLED = f"""recursive {M}, l as (select measurement_uid, strftime(measurement_start_time, '%Y%m%d') as day, strftime(measurement_start_time, '%H') as hour, case when event_id % 50 < 30 then 'AA' else probe_cc end as cc, 't' as test, case when event_id % 9 = 0 then '{{}}' else '{{"uid":"' || measurement_uid || '","pad":"' || repeat('x', event_id % 40) || '"}}' end as value from m),
o as (select *, coalesce(sum(strlen(value) + 1) over (partition by day, hour, cc, test order by measurement_uid rows between unbounded preceding and 1 preceding), 0) as before from l),
g as (select distinct day, hour, cc, test from o),
starts as (
  select day, hour, cc, test, 0 as bundle, cast(0 as hugeint) as start from g
  union all select s.day, s.hour, s.cc, s.test, s.bundle + 1, s.next from (
    select s.*, (select min(o.before + strlen(o.value) + 1) from o where o.day = s.day and o.hour = s.hour and o.cc = s.cc and o.test = s.test and o.before + strlen(o.value) + 1 > s.start + 300) as next from starts s) s where s.next is not null),
n as (select o.*, (select max(s.bundle) from starts s where s.day = o.day and s.hour = o.hour and s.cc = o.cc and s.test = o.test and s.start <= o.before) as bundle from o)"""


def to_bundle(s: SparkSession, d: str) -> DataFrame:
    body = F.expr("""case when event_id % 9 = 0 then '{broken' else concat('{"uid":"', measurement_uid, '","pad":"', repeat('x', cast(event_id % 40 as int)), '"}') end""")
    return msm(s, d).select("measurement_uid", F.date_format("measurement_start_time", "yyyyMMdd").alias("day"), F.date_format("measurement_start_time", "HH").alias("hour"), F.expr("case when event_id % 50 < 30 then 'AA' else probe_cc end").alias("cc"), F.lit("t").alias("test"), body.alias("body"))


@query(f"with {BUNDLED} select measurement_uid, day, hour, cc, bundle, value, cast(row_number() over (partition by day, hour, cc, test, bundle order by measurement_uid) - 1 as integer) as linenum from n")
def w7_bundles_by_bytes(s: SparkSession, d: str) -> DataFrame:
    m = to_bundle(s, d)
    lines, places = bundles.bundled(m.unionByName(m), 300)
    return places.join(lines.select("row", "value"), "row").select("measurement_uid", "day", "hour", "cc", F.col("bundle").cast("int").alias("bundle"), "value", "linenum")


@query(f"with {BUNDLED} select day, hour, cc, test, bundle, count(*) as n, sha256(string_agg(measurement_uid, chr(10) order by measurement_uid)) as name from n group by 1, 2, 3, 4, 5")
def s12_bundle_names(s: SparkSession, d: str) -> DataFrame:
    m = to_bundle(s, d)
    return bundles.named(bundles.bundled(m.unionByName(m), 300)[1]).withColumn("bundle", F.col("bundle").cast("int"))


@query(f"with {M} select measurement_uid from m where date_trunc('hour', measurement_start_time) + interval 2 hour <= timestamp '2024-01-20 12:30:00'")
def s11_settled_hours(s: SparkSession, d: str) -> DataFrame:
    return bundles.settled(to_bundle(s, d), "2024-01-20 12:30:00").select("measurement_uid")


@query(f"with {M} select event_id, input, domain from m where event_id > 300 and event_id < (select max(event_id) - 10 from m)")
def s18_rows_to_sync(s: SparkSession, d: str) -> DataFrame:
    m = msm(s, d).withColumn("input", F.nullif("input", F.lit("")))
    until = m.agg(F.max("event_id") - 10).first()[0]
    return archives.newer_rows(m, "event_id", 300, until).select("event_id", "input", "domain")


@query(f"with {BUNDLED} select measurement_uid, value as body from l")
def s20_bodies_by_locator(s: SparkSession, d: str) -> DataFrame:
    """Bundled by day and country, then every line is fetched by its locator."""
    path, m = shared_folder(s), to_bundle(s, d).withColumn("hour", F.lit("00"))
    return bundles.bodies(s, path, bundles.write_bundles(m, path))


@query(f"with {M} select measurement_uid, probe_cc, strftime(measurement_start_time, '%Y%m') as yyyymm from m")
def s13_exported_months(s: SparkSession, d: str) -> DataFrame:
    """Exported by month and read again."""
    path = shared_folder(s)
    archives.export_months(msm(s, d).select("measurement_uid", "probe_cc", "measurement_start_time"), path)
    return s.read.option("header", True).schema("measurement_uid string, probe_cc string, measurement_start_time string, yyyymm string").csv(path).select("measurement_uid", "probe_cc", "yyyymm")


@query(f"with {M} select measurement_uid, probe_cc, true as fits from m")
def s14_exported_chunks(s: SparkSession, d: str) -> DataFrame:
    """Exported in files of 1000 rows at most and read again, with whether each row's file keeps to that."""
    path = shared_folder(s)
    archives.export_chunks(msm(s, d).select("measurement_uid", "probe_cc"), path, 1000)
    rows = s.read.option("header", True).schema("measurement_uid string, probe_cc string").csv(path).select("*", F.col("_metadata.file_name").alias("file"))
    full = rows.groupBy("file").agg((F.count("*") <= 1000).alias("fits"))
    return rows.join(full, "file").select("measurement_uid", "probe_cc", "fits")


@query(f"with {M} select probe_cc as cc, count(*) as n, count(distinct probe_asn) as networks from m group by 1")
def s16_exported_result(s: SparkSession, d: str) -> DataFrame:
    """A result as CSV, its columns in alphabetical order, read again by position."""
    path = shared_folder(s)
    archives.export_result(msm(s, d).groupBy(F.col("probe_cc").alias("cc")).agg(F.countDistinct("probe_asn").alias("networks"), F.count("*").alias("n")), path)
    return s.read.option("header", True).schema("cc string, n long, networks long").csv(path)


@query(f"with {CZ} select url, cc, category_code from cz")
def s17_swapped_list(s: SparkSession, d: str) -> DataFrame:
    """A list becomes current; one with too few rows is refused and leaves it so."""
    path, urls = shared_folder(s), views.url_list(s, d).select("url", "cc", "category_code")
    archives.swapped(urls, path, 1, 1 << 40)
    try:
        archives.swapped(urls.where("false"), path, 1, 1 << 40)
    except ValueError:
        pass
    return archives.current(s, path)
