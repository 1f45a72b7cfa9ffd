"""Registered queries of the scoring rules: bodies of several kinds dealt over the events, and the scores that they must get in SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netgauge.catalog import QUERIES, SQL, msm, query
from netgauge.functions import scoring
from netgauge.operators import confirm
from netgauge.plans import views
from netgauge.plans.views import M

#: A body, and the blocking, accuracy and blocking type that it gets. "@" in a body stands for the event's id modulo 101.
Case = tuple[dict, float | str, float | None, str | None]


def body_of(cases: list[Case]) -> Column:
    kinds = F.array(*[F.lit(json.dumps(c[0])) for c in cases])
    return F.replace(F.element_at(kinds, (F.col("event_id") % len(cases)).cast("int") + 1), F.lit('"@"'), (F.col("event_id") % 101).cast("string"))


def by_kind(name: str, test: str, *cases: Case) -> None:
    """Registers a query that counts the scores of one test's bodies by kind."""

    def run(s: SparkSession, d: str) -> DataFrame:
        v = msm(s, d).select("event_id", F.try_parse_json(body_of(list(cases))).alias("v"))
        r = v.select((F.col("event_id") % len(cases)).cast("int").alias("kind"), scoring.score(F.col("v"), F.lit(test)).alias("s"))
        return r.groupBy("kind", F.round("s.blocking_general", 6).alias("blocking_general"), "s.accuracy", "s.blocking_type").agg(F.count("*").alias("n"))

    run.__name__ = name
    pick = lambda i, kind: "case event_id % {} {} end".format(len(cases), " ".join(f"when {k} then {'null' if c[i] is None else repr(c[i]) if i == 3 else c[i]}" for k, c in enumerate(cases)))
    QUERIES[name] = run
    SQL[name] = f"with {M}, r as (select cast(event_id % {len(cases)} as integer) as kind, round(cast({pick(1, 'double')} as double), 6) as blocking_general, cast({pick(2, 'double')} as double) as accuracy, cast({pick(3, 'varchar')} as varchar) as blocking_type from m) select kind, blocking_general, accuracy, blocking_type, count(*) as n from r group by 1, 2, 3, 4"


def keys(**test_keys: object) -> dict:
    return {"test_keys": test_keys}


def tcp(*success: bool | None) -> list[dict]:
    return [{"status": {"success": x}} for x in success]


def got(url: str, failure: str | None = None, **response: object) -> dict:
    return {"request": {"url": url}, "failure": failure} | ({"response": response} if response else {})


ALL_TRUE = {k: True for k in scoring.FB_TRUE}
by_kind(
    "r1_facebook_messenger",
    "facebook_messenger",
    (keys(facebook_tcp_blocking=False, **ALL_TRUE), 0.0, None, None),
    (keys(facebook_tcp_blocking=True, facebook_edge_reachable=False), 1.0, None, None),
    (keys(facebook_dns_blocking=True), 0.5, None, None),
    (keys(facebook_star_reachable=False, facebook_star_dns_consistent=False, facebook_b_api_reachable=False), 1.5, None, None),
    (keys(), 0.0, None, None),
)
WEB = "https://web.telegram.org/"
by_kind(
    "r3_telegram",
    "telegram",
    (keys(tcp_connect=tcp(True, True), requests=[got("http://1.1.1.1/"), got(WEB, "x")]), 0.0, None, None),
    (keys(tcp_connect=tcp(False, False), requests=[got("http://1.1.1.1/", "x")], telegram_web_status="ok"), 2.0, None, None),
    (keys(tcp_connect=tcp(True, False, None), requests=[got("http://1.1.1.1/", "x"), got("http://1.1.1.2/")], telegram_web_status="blocked"), 2.0, None, None),
    (keys(tcp_connect=tcp(True), requests=[{"request": {}, "failure": None}]), 0.0, 0.0, None),
    (keys(), 1.0, None, None),
)
SENT = {"A": "b", "Connection": "close"}
by_kind(
    "r4_header_field_manipulation",
    "http_header_field_manipulation",
    (keys(requests=[{"request": {"headers": SENT}, "response": {"body": json.dumps({"headers_dict": {"A": ["b"]}})}}]), 0.0, None, None),
    (keys(requests=[{"request": {"headers": SENT}, "response": {"body": json.dumps({"headers_dict": {"a": ["b"]}})}}]), 1.1, None, None),
    (keys(requests=[{"request": {"headers": SENT}, "response": {"body": "no json"}}]), 1.0, None, None),
    (keys(requests=[{"request": {"headers": SENT}, "response": {"body": None}}]), 1.0, None, None),
    (keys(requests=[{"request": {"headers": SENT}, "response": None}]), 0.0, 0.0, None),
    (keys(requests=[]), 0.0, 0.0, None),
)
by_kind(
    "r5_invalid_request_line",
    "http_invalid_request_line",
    (keys(sent=["a", "b"], received=["a", "b"]), 0.0, None, None),
    (keys(sent=["a", "b"], received=["a", "c"]), 1.0, None, None),
    (keys(sent=["a", "b"], received=["a"]), 0.0, None, None),
    (keys(sent=[], received=[]), 0.0, 0.0, None),
)
by_kind(
    "r7_vanilla_tor",
    "vanilla_tor",
    (keys(tor_log="x", tor_progress="@"), "1.0 - (event_id % 101) * 0.004 * case when event_id % 101 = 100 then 2.5 else 1 end", None, None),
    (keys(tor_log="Bootstrapped 100%: Done", tor_progress=3), 0.0, None, None),
    (keys(tor_logs="Bootstrapped 100% (done): Done"), 0.0, None, None),
    (keys(tor_log="x", tor_progress=-5), 1.0, None, None),
    (keys(tor_progress=50), 0.0, 0.0, None),
)
by_kind("r10_ndt", "ndt", (keys(failure="x"), 0.0, None, None), (keys(), 0.0, None, None))
by_kind("r10_riseupvpn", "riseupvpn", (keys(api_failure="x"), 0.0, None, None), ({}, 0.0, None, None))
by_kind("r11_tcp_connect", "tcp_connect", (keys(connection="success"), 0.0, None, None), *[(keys(connection=f), 0.8, None, None) for f in scoring.TCP_FAILURES], (keys(connection="odd"), 1.0, None, None))
by_kind("r12_dash", "dash", *[(keys(failure=f), 0.1, 0.0, None) for f in (*scoring.DASH_FAILURES, "an ssl_error here")], (keys(failure=None, simple={"x": 1}), 0.0, None, None), (keys(failure="new kind"), 0.0, 0.0, None), (keys(), 0.0, 0.0, None))
by_kind(
    "r13_meek",
    "meek_fronted_requests_test",
    (keys(requests=[got("u", code=200, headers={"Server": "ECAcc (x)"})]), 0.0, None, None),
    (keys(requests=[got("u", code=200, headers={"Server": "nginx"}), got("u", code=200, headers={})]), 1.0, None, None),
    (keys(requests=[got("u", code=200, headers={"Server": "nginx"}), got("u", code=403, headers={})]), 1.0, None, None),
    (keys(requests=[got("u", code=200, headers=[["Via", ["x"]], [], ["Server", ["ECAcc (x)", "y"]]])]), 0.0, None, None),
    (keys(requests=[got("u", code=200, headers=[["server", ["ECAcc (x)"]]]), got("u", code=200, headers=[])]), 1.0, None, None),
    (keys(requests=[{"response": None}]), 1.0, None, None),
    (keys(requests=[]), 1.0, 0.0, None),
)
by_kind(
    "r14_psiphon",
    "psiphon",
    ({"resolver_ip": "1.1.1.1"} | keys(failure="x", bootstrap_time=0), 1.0, 1.0, None),
    ({"resolver_ip": "1.1.1.1"} | keys(failure=None, bootstrap_time=2.5), 0.0, 1.0, None),
    ({"resolver_ip": "1.1.1.1"} | keys(failure=None, bootstrap_time=0), 0.0, 0.0, None),
    (keys(failure="x", bootstrap_time=3), 1.0, 0.0, None),
)
target = lambda failure: {"failure": failure, "network_events": []}
by_kind(
    "r15_tor",
    "tor",
    (keys(targets={"a": target(None), "b": target("x"), "c": target("y"), "d": target("z")}), 0.75, None, None),
    (keys(targets={"a": target(None)}), 0.0, None, None),
    (keys(targets={"a": {"failure": "x"}}), 0.0, 0.0, None),
    (keys(targets=[target("x")]), 0.0, 0.0, None),
    (keys(), 0.0, 0.0, None),
)
by_kind("r16_http_requests", "http_requests", (keys(body_length_match=True, headers_match=True), 0.0, None, None), (keys(body_length_match=True, headers_match=False), 1.0, None, None), (keys(body_length_match=True), 0.0, 0.0, None), ({"control_failure": "x"} | keys(body_length_match=False, headers_match=False), 0.0, 0.0, None))
by_kind("r17_dns_consistency", "dns_consistency", (keys(inconsistent=["x"]), 0.0, None, None), ({}, 0.0, None, None))
by_kind("r19_stunreachability", "stunreachability", (keys(failure="x"), 1.0, None, None), (keys(failure=None), 0.0, None, None), (keys(failure=""), 0.0, None, None), (keys(), 0.0, None, None))
by_kind("r22_browser_web", "browser_web", (keys(result="ok"), 0.0, None, None), (keys(result="error"), 1.0, None, None), (keys(result="odd"), 0.0, 0.0, None), (keys(), 0.0, 0.0, None))
by_kind("r23_unknown_failure", "web_connectivity", (keys(blocking=False, accessible=True, http_experiment_failure="unknown_failure: x"), 0.0, 0.0, None), (keys(blocking=False, accessible=True, http_experiment_failure="timeout"), 0.0, None, None), (keys(blocking="dns", accessible=False, some="unknown_failure: x"), 1.0, None, "dns"))
by_kind(
    "r9_web_connectivity",
    "web_connectivity",
    *[(keys(blocking=b, accessible=False), 1.0, None, b) for b in scoring.WEB_BLOCKING],
    (keys(blocking=False, accessible=True, title_match=False), 0.0, None, None),
    (keys(blocking=None, accessible=True), 0.0, 0.0, None),
    (keys(blocking="other", accessible=True), 0.0, 0.0, None),
    (keys(blocking=False, accessible=None), 0.0, 0.0, None),
    (keys(blocking="dns", title_match="odd"), 0.0, 0.0, None),
    ({}, 0.0, 0.0, None),
)


@query(f"with {M} select measurement_uid, case event_id % 5 when 0 then ['a' || measurement_uid] when 1 then ['b' || measurement_uid, 'c'] when 2 then ['d', 'e', 'f'] else cast([] as varchar[]) end as any_case, case event_id % 5 when 1 then ['c'] when 2 then ['d', 'f'] else cast([] as varchar[]) end as as_is from m")
def r26_header_values(s: SparkSession, d: str) -> DataFrame:
    """Headers by name, in any case and as they are, from maps and from lists."""
    text = F.expr("""case event_id % 5 when 0 then concat('{"headers":{"SERVER":"a', measurement_uid, '","Via":"x"}}') when 1 then concat('{"headers":{"server":"b', measurement_uid, '","Server":"c"}}')
        when 2 then '{"headers":[["Server",["d","x"]],[],["sErver",["e"]],["Server","f"]]}' when 3 then '{"headers":null}' else '{"code":200}' end""")
    m = msm(s, d).select("measurement_uid", F.try_parse_json(text).alias("r"))
    return m.select("measurement_uid", F.array_sort(scoring.header_values(F.col("r"), "Server")).alias("any_case"), scoring.header_values(F.col("r"), "Server", any_case=False).alias("as_is"))


by_kind("r0_unknown_test", "no_such_test", (keys(failure="x"), 0.0, 0.0, None), ({}, 0.0, 0.0, None))


# ---- confirmed blocking ----

# Nations are fingerprints: the answer's address, the body's text or a header names one.
FP = "fp as (select n_name as name, n_nationkey as k, case n_nationkey % 4 when 0 then 'nat' when 1 then 'isp' when 2 then 'prod' else 'inst' end as scope, chr(cast(65 + n_nationkey as integer)) || chr(cast(90 - n_nationkey as integer)) as expected from nation)"


def fingerprints(s: SparkSession, d: str, pattern: Callable[[Column], Column], where: str, kind: str = "full") -> DataFrame:
    k = F.col("n_nationkey")
    scope = F.expr("case n_nationkey % 4 when 0 then 'nat' when 1 then 'isp' when 2 then 'prod' else 'inst' end")
    return views.read(s, d, "nation").select(F.col("n_name").alias("name"), pattern(k).alias("pattern"), F.lit(kind).alias("pattern_type"), F.lit(where).alias("location_found"), scope.alias("scope"), F.array(F.expr("concat(char(65 + n_nationkey), char(90 - n_nationkey))")).alias("expected_countries"))


def raw_web(s: SparkSession, d: str) -> DataFrame:
    """uid, test_name, v: web measurements with answers, a body (every third in base64, some of it broken) and headers."""
    page = F.expr("concat('<html>block page ', event_id % 60, ' of ', probe_cc, '</html>')")
    coded = F.concat(F.lit('{"format":"base64","data":"'), F.when(F.expr("event_id % 21 = 0"), "!!!").otherwise(F.base64(page.cast("binary"))), F.lit('"}'))
    body = F.when(F.expr("event_id % 3 = 0"), coded).otherwise(F.concat(F.lit('"'), page, F.lit('"')))
    text = F.concat(
        F.lit('{"probe_cc":"'), F.lower("probe_cc"), F.lit('","test_keys":{"accessible":null,"blocking":'), F.expr("case event_id % 5 when 0 then 'null' when 1 then '\"dns\"' else 'false' end"),
        F.lit(',"queries":[{"answers":[{"ipv4":"10.9.'), F.expr("event_id % 40"), F.lit('.1"},{"hostname":"h"}]},{"answers":null}],"requests":[{"response":null},{"response":{"body":'), body,
        F.lit(',"headers":{"SERVER":"blocker/'), F.expr("event_id % 70"), F.lit('.0"}}}]}}'),
    )
    return msm(s, d).where("test_name = 'web_connectivity'").select(F.col("measurement_uid").alias("uid"), "test_name", F.try_parse_json(text).alias("v"))


def prints(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    address = lambda k: F.concat(F.lit("10.9."), k, F.lit(".1"))
    page = lambda k: F.concat(F.lit("page "), k, F.lit(" of"))
    server = lambda k: F.concat(F.lit("blocker/"), k, F.lit("."))
    return fingerprints(s, d, address, ""), fingerprints(s, d, page, "body").unionByName(fingerprints(s, d, server, "header.server", "prefix"))


MATCHED = f"""{M}, {FP}, w as (select * from m where test_name = 'web_connectivity'), broken as (select measurement_uid from w where event_id % 21 = 0),
hit as (select distinct w.measurement_uid, w.probe_cc, fp.name, fp.scope, fp.expected from w join fp on fp.k in (event_id % 40, event_id % 60, event_id % 70) where event_id % 21 <> 0),
loc as (select measurement_uid, scope, name, (probe_cc <> 'ZZ' and expected = probe_cc) or scope in ('isp', 'nat') as sure from hit)"""


@query(f"with {MATCHED} select measurement_uid as uid, name from hit")
def j12_all_fingerprints(s: SparkSession, d: str) -> DataFrame:
    """Fingerprints in answers, bodies (plain and base64) and headers of raw measurements."""
    return confirm.matches(raw_web(s, d), *prints(s, d))


@query(f"""with {MATCHED} select measurement_uid as uid, bool_or(sure) as confirmed, bool_or(sure and scope = 'nat') as in_country, bool_or(sure and scope = 'isp') as in_isp, bool_or(sure and scope = 'inst') as in_local, bool_or(sure and scope = 'prod') as in_general from loc group by 1""")
def r8_localities(s: SparkSession, d: str) -> DataFrame:
    """Whether the fingerprints found confirm blocking, and where."""
    dns, http = prints(s, d)
    msms = raw_web(s, d)
    return confirm.localities(confirm.matches(msms, dns, http), msms, dns).select("uid", "confirmed", "in_country", "in_isp", "in_local", "in_general")


@query(f"""with {MATCHED}, f as (select measurement_uid, bool_or(sure) as confirmed, max(cast(sure and scope = 'nat' as integer)) as c, max(cast(sure and scope = 'isp' as integer)) as i, max(cast(sure and scope = 'inst' as integer)) as l, max(cast(sure and scope = 'prod' as integer)) as g from loc group by 1),
t as (select w.measurement_uid as uid, event_id, coalesce(f.confirmed, false) as confirmed, cast(greatest(coalesce(g, 0), case when event_id % 5 = 1 then 1 else 0 end) + coalesce(c, 0) + coalesce(i, 0) + coalesce(l, 0) as double) as blocking_general,
  case when f.measurement_uid is null then 0.0 end as accuracy, case when event_id % 5 = 1 then 'dns' end as blocking_type from w left join f on f.measurement_uid = w.measurement_uid)
select uid, case when confirmed then 't' else 'f' end as confirmed, case when blocking_general > 0.5 then 't' else 'f' end as anomaly, case when coalesce(accuracy, 1.0) < 0.5 then 't' else 'f' end as msm_failure, blocking_general, blocking_type from t""")
def p2_confirmed_flags(s: SparkSession, d: str) -> DataFrame:
    """Raw web measurements to flags: fingerprints, localities, scores."""
    r = confirm.scored(raw_web(s, d), *prints(s, d)).withColumns(scoring.flags(F.col("scores")))
    return r.select("uid", F.when(F.col("confirmed"), "t").otherwise("f").alias("confirmed"), "anomaly", "msm_failure", "scores.blocking_general", "scores.blocking_type")


@query(f"""with {M}, {FP}, h as (select measurement_uid as uid, event_id, probe_cc from m where test_name = 'torsf'), x as (select h.uid, (h.probe_cc <> 'ZZ' and fp.expected = h.probe_cc) or fp.scope in ('isp', 'nat') as sure, fp.scope from h join fp on fp.k = event_id % 40 where event_id % 2 = 0)
select h.uid, case when event_id % 3 = 0 then 1.0 when coalesce((select bool_or(sure and scope = 'prod') from x where x.uid = h.uid), false) then 1.0 else 0.0 end as blocking_general, coalesce((select bool_or(sure) from x where x.uid = h.uid), false) as confirmed from h""")
def r16_confirmed_http_requests(s: SparkSession, d: str) -> DataFrame:
    """Old HTTP measurements: what went over Tor doesn't count."""
    tor = F.expr("case when event_id % 2 = 0 then 'false' else 'true' end")
    text = F.concat(F.lit('{"probe_cc":"'), F.col("probe_cc"), F.lit('","test_keys":{"headers_match":true,"body_length_match":'), F.expr("case when event_id % 3 = 0 then 'false' else 'true' end"), F.lit(',"requests":[{"request":{"tor":{"is_tor":'), tor, F.lit('}},"response":{"body":"page '), F.expr("event_id % 40"), F.lit(' of"}}]}}'))
    m = msm(s, d).where("test_name = 'torsf'").select(F.col("measurement_uid").alias("uid"), F.lit("http_requests").alias("test_name"), F.try_parse_json(text).alias("v"))
    return confirm.scored(m, *prints(s, d)).select("uid", "scores.blocking_general", "confirmed")
