"""Registered queries that run a stream to its end over what the tables hold, and read what it committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netgauge.catalog import SERIES, msm, query, series
from netgauge.catalog_scores import MATCHED, prints, raw_web
from netgauge.plans.views import M
from netgauge.sources.store import shared_folder
from netgauge.streaming import feeds, scoring, summing

HEAD = """concat('{"test_name":"', test_name, '","report_id":"r","probe_asn":"AS1","probe_cc":"', lower(probe_cc), '","measurement_start_time":"2024-01-02 03:04:05","test_keys":')"""


def arriving(s: SparkSession, d: str) -> DataFrame:
    """(measurement_uid, body) of web and OpenVPN measurements; every sixth comes twice."""
    m = msm(s, d).select("measurement_uid", "event_id", "test_name", "probe_cc")
    web = raw_web(s, d).select(F.col("uid").alias("measurement_uid"), F.to_json(F.try_variant_get("v", "$.test_keys", "variant")).alias("keys"))
    vpn = m.where("test_name = 'openvpn'").select("measurement_uid", F.expr("concat('{\"success\":', event_id % 2 = 0, '}')").alias("keys"))
    rows = web.unionByName(vpn).join(m, "measurement_uid")
    twice = F.explode(F.expr("sequence(1, if(event_id % 6 = 0, 2, 1))"))
    return rows.select("measurement_uid", F.concat(F.expr(HEAD), "keys", F.lit("}")).alias("body"), twice).drop("col")


@query(f"""with {MATCHED}, f as (select measurement_uid, bool_or(sure) as confirmed, max(cast(sure and scope = 'nat' as integer)) as c, max(cast(sure and scope = 'isp' as integer)) as i, max(cast(sure and scope = 'inst' as integer)) as l, max(cast(sure and scope = 'prod' as integer)) as g from loc group by 1),
t as (select w.measurement_uid, coalesce(f.confirmed, false) as confirmed, cast(greatest(coalesce(g, 0), case when event_id % 5 = 1 then 1 else 0 end) + coalesce(c, 0) + coalesce(i, 0) + coalesce(l, 0) as double) as blocking_general,
    case when f.measurement_uid is null then 0.0 end as accuracy, case when event_id % 5 = 1 then 'dns' else '' end as blocking_type, false as openvpn from w left join f on f.measurement_uid = w.measurement_uid where w.probe_cc <> 'ZZ'
  union all select measurement_uid, false, case when event_id % 2 = 0 then 0.0 else 1.0 end, null, '', true from m where test_name = 'openvpn' and probe_cc <> 'ZZ')
select measurement_uid, case when confirmed then 't' else 'f' end as confirmed, case when blocking_general > 0.5 then 't' else 'f' end as anomaly, case when coalesce(accuracy, 1.0) < 0.5 then 't' else 'f' end as msm_failure, blocking_general, blocking_type, openvpn from t""")
def t1_scored_stream(s: SparkSession, d: str) -> DataFrame:
    """Posts that arrive are scored in a stream with fingerprints; facts and OpenVPN rows as committed."""
    root = shared_folder(s)
    arriving(s, d).write.json(f"{root}/in")
    scoring.start(s, f"{root}/in", f"{root}/out", f"{root}/state", lambda: prints(s, d), once=True).awaitTermination()
    vpn = scoring.read(s, f"{root}/out", scoring.OPENVPN).select("measurement_uid", F.lit(True).alias("openvpn"))
    facts = scoring.read(s, f"{root}/out", scoring.FACTS).join(vpn, "measurement_uid", "left")
    return facts.select("measurement_uid", "confirmed", "anomaly", "msm_failure", "blocking_general", "blocking_type", F.coalesce("openvpn", F.lit(False)).alias("openvpn"))


@query(f"""{SERIES}, b as (select *, coalesce(last_value(case when mean > 0.10 then true when mean < 0.05 then false end ignore nulls) over (partition by probe_cc, input order by ts, uid rows unbounded preceding), false) as blocked from e),
c as (select *, coalesce(lag(blocked) over (partition by probe_cc, input order by ts, uid), false) as before from b),
f as (select probe_cc, input, uid, round(mean, 6) as mean, blocked, row_number() over (partition by probe_cc order by ts desc, uid desc) as rank from c where blocked <> before and uid % 5 <> 0)
select * from f where rank <= 1000""")
def w8_event_feeds(s: SparkSession, d: str) -> DataFrame:
    """A stream of values becomes change events, and each country's feed of the latest of those that have a report."""
    root, keys = shared_folder(s), ["probe_cc", "input"]
    rows = series(s, d).select(*keys, F.col("ts").cast("timestamp").alias("ts"), F.col("uid").cast("long").alias("uid"), F.col("x").cast("double").alias("x"), F.expr("case when uid % 5 <> 0 then concat('r', uid) end").alias("report_id"))
    rows.write.parquet(f"{root}/in")
    feeds.start(s, s.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/state", keys, once=True).awaitTermination()
    return feeds.feeds(s, f"{root}/out", keys).select(*keys, "uid", F.round("mean", 6).alias("mean"), "blocked", "rank")


@query(f"""with {M} select date_trunc('week', measurement_start_time + interval 1 day) - interval 1 day as week, probe_cc, probe_asn, input, count(*) as msmt_cnt from m where test_name = 'web_connectivity' group by 1, 2, 3, 4""")
def c3_merged_counters(s: SparkSession, d: str) -> DataFrame:
    """Partial sums of several batches, merged once in between, added up."""
    root = shared_folder(s)
    rows = msm(s, d).where("test_name = 'web_connectivity'").select(F.col("measurement_start_time").cast("timestamp").alias("measurement_start_time"), "probe_cc", F.col("probe_asn").cast("long").alias("probe_asn"), "input", "event_id")
    for k in range(3):  # three arrivals that hold all rows
        rows.where(F.col("event_id") % 3 == k).drop("event_id").write.mode("append").parquet(f"{root}/in")
        stream = s.readStream.schema(rows.drop("event_id").schema).parquet(f"{root}/in")
        summing.start(s, stream, f"{root}/out", f"{root}/state", "week", once=True).awaitTermination()
        if k == 1:
            summing.merge(s, f"{root}/out", "week")
    return summing.read(s, f"{root}/out", "week").withColumn("week", F.col("week").cast("timestamp_ntz"))
