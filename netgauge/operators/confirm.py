"""Confirmed blocking: fingerprints found in raw measurements, where they hold, and the scores that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgauge.functions import scoring
from netgauge.operators import lookup

# Where a fingerprint's scope says the blocking is; any other scope is general.
SCOPE_TO_LOCALITY = {"inst": "local", "isp": "isp", "nat": "country", "prod": "general"}
LOCALITIES = ("general", "country", "isp", "local")


def array_of(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "array<variant>")


def dns_answers(msms: DataFrame) -> DataFrame:
    """msms(uid, v) -> uid, ipv4, hostname, ipv6 of every answer."""
    q = msms.select("uid", F.explode(array_of(F.col("v"), "$.test_keys.queries")).alias("q"))
    a = q.select("uid", F.explode(array_of(F.col("q"), "$.answers")).alias("a"))
    return a.select("uid", *[F.try_variant_get("a", f"$.{k}", "string").alias(k) for k in ("ipv4", "hostname", "ipv6")])


def responses(msms: DataFrame, with_tor: bool = True) -> DataFrame:
    """msms(uid, v) -> uid, body, headers (lower-cased names), and whether its base64 is broken; requests over Tor on demand."""
    r = msms.select("uid", F.explode(array_of(F.col("v"), "$.test_keys.requests")).alias("r"))
    if not with_tor:
        r = r.where(~F.coalesce(F.try_variant_get("r", "$.request.tor.is_tor", "boolean"), F.lit(False)))
    text = lambda path: F.try_variant_get("r", f"$.response.{path}", "string")
    coded = text("body.format") == "base64"
    body = F.when(F.schema_of_variant(F.try_variant_get("r", "$.response.body", "variant")) == "STRING", text("body")).when(coded, lookup.decoded(text("body.data"), F.lit("base64")))
    headers = F.transform_keys(F.coalesce(F.try_variant_get("r", "$.response.headers", "map<string,variant>"), F.expr("cast(map() as map<string,variant>)")), lambda k, _: F.lower(k))
    plain = lambda x: F.when(F.try_variant_get(x, "$.format", "string") == "base64", F.decode(F.try_to_binary(F.try_variant_get(x, "$.data", "string"), F.lit("base64")), "ISO-8859-1")).otherwise(F.try_variant_get(x, "$", "string"))
    broken = coded & F.try_to_binary(text("body.data"), F.lit("base64")).isNull()
    return r.select("uid", body.alias("body"), F.transform_values(headers, lambda _, x: plain(x)).alias("headers"), F.coalesce(broken, F.lit(False)).alias("broken"))


def is_confirmed(cc: Column, countries: Column, scope: Column) -> Column:
    """The fingerprint is expected in the country, or holds for a network or nation whatever the country."""
    return F.coalesce((cc != "ZZ") & F.array_contains(countries, cc), F.lit(False)) | F.coalesce(scope.isin("isp", "nat"), F.lit(False))


def matches(msms: DataFrame, dns: DataFrame, http: DataFrame, with_tor: bool = True) -> DataFrame:
    """msms(uid, v), fingerprints (name, pattern, pattern_type, location_found) -> uid, name, each once; uids with broken base64 match nothing."""
    resp = responses(msms, with_tor)
    bodies = resp.where("body is not null").withColumn("_row", F.xxhash64("body"))
    in_body = lookup.body_matches(bodies.select("uid", "body"), http.where("location_found = 'body'"))
    found = lookup.dns_matches(dns_answers(msms), dns).unionByName(in_body).unionByName(lookup.header_matches(resp, http)).distinct()
    return found.join(resp.where("broken").select("uid").distinct(), "uid", "left_anti")


def localities(found: DataFrame, msms: DataFrame, prints: DataFrame) -> DataFrame:
    """uid, name of matches -> uid, names, confirmed, and a flag for each locality of a confirmed match."""
    cc = msms.select("uid", F.upper(F.coalesce(F.try_variant_get("v", "$.probe_cc", "string"), F.lit("ZZ"))).alias("probe_cc"))
    where = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SCOPE_TO_LOCALITY.items() for x in p]), F.col("scope")), F.lit("general"))
    m = found.join(prints.select("name", "scope", "expected_countries").dropDuplicates(["name"]), "name").join(cc, "uid")
    m = m.withColumn("sure", is_confirmed(F.col("probe_cc"), F.col("expected_countries"), F.col("scope"))).withColumn("locality", where)
    return m.groupBy("uid").agg(F.sort_array(F.collect_set("name")).alias("names"), F.max("sure").alias("confirmed"), *[F.max(F.col("sure") & (F.col("locality") == x)).alias(f"in_{x}") for x in LOCALITIES])


def scored(msms: DataFrame, dns: DataFrame, http: DataFrame) -> DataFrame:
    """msms(uid, test_name, v) -> uid, scores, confirmed, names. Fingerprints count in web_connectivity, and in http_requests for what didn't go over Tor.

    scores has blocking_general, accuracy and blocking_type as of the test's own
    rules, and blocking_country, blocking_isp and blocking_local of fingerprints.
    """
    prints = dns.select("name", "scope", "expected_countries").unionByName(http.select("name", "scope", "expected_countries"))
    web, old = msms.where("test_name = 'web_connectivity'"), msms.where("test_name = 'http_requests'")
    found = matches(web, dns, http).unionByName(matches(old, dns.limit(0), http, with_tor=False))
    places = localities(found, msms, prints)
    broken = responses(web).where("broken").select("uid").distinct().withColumn("broken", F.lit(True))
    j = msms.join(places, "uid", "left").join(broken, "uid", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    matched = F.col("names").isNotNull()
    own = F.when(F.col("test_name") == "web_connectivity", scoring.web_connectivity(F.col("v"), matched)).otherwise(scoring.score(F.col("v"), F.col("test_name")))
    j = j.withColumn("own", own)
    parts = {x: F.when(flag(f"in_{x}"), 1.0).otherwise(0.0) for x in LOCALITIES}
    general = F.greatest(F.col("own.blocking_general"), parts["general"])
    odd = F.coalesce(scoring.odd_title(F.col("v")), F.lit(False))
    adds = (F.col("test_name") == "web_connectivity") & ~odd
    general = F.when(adds, general + parts["country"] + parts["isp"] + parts["local"]).otherwise(general)
    scores = F.struct(general.alias("blocking_general"), F.when(flag("broken"), 0.0).otherwise(F.col("own.accuracy")).alias("accuracy"), F.col("own.blocking_type").alias("blocking_type"), *[parts[x].alias(f"blocking_{x}") for x in LOCALITIES[1:]])
    return j.select("uid", scores.alias("scores"), flag("confirmed").alias("confirmed"), F.coalesce("names", F.expr("cast(array() as array<string>)")).alias("names"))
