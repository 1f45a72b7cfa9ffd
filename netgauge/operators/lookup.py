"""Lookups against reference tables: fingerprints, policies, address ranges, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netgauge.sources.store import written

#: Characters of the grams by which patterns are sought in bodies, and patterns up to which they are broadcast (more are shuffled).
GRAM, BROADCAST_PATTERNS = 6, 50_000


def dns_matches(answers: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """answers(uid, ipv4, hostname, ipv6): the first that is there equals a pattern -> uid, name."""
    a = answers.select("uid", F.coalesce("ipv4", "hostname", "ipv6", F.lit("")).alias("pattern"))
    return a.join(fingerprints.select("name", "pattern"), "pattern").select("uid", "name")


def body_matches(bodies: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """bodies(uid, body), fingerprints(name, pattern): the pattern stands anywhere in the body -> uid, name, once each; empty patterns match nothing.

    A pattern is sought by one of its grams of GRAM characters (or by the whole of
    a shorter one): of its grams that which the fewest patterns have. The bodies'
    distinct grams meet those by equality, and what meets is verified.
    """
    prints = fingerprints.where("pattern <> ''").select("name", "pattern", F.least(F.length("pattern"), F.lit(GRAM)).alias("n")).distinct()
    sizes = [r["n"] for r in prints.select("n").distinct().collect()]  # GRAM of them at most
    found = None
    for n in sorted(sizes):
        every = prints.where(F.col("n") == n).select("name", "pattern", F.explode(grams(F.col("pattern"), n)).alias("gram"))
        seen = every.groupBy("gram").agg(F.count("*").alias("seen"))
        rare = every.join(seen, "gram").groupBy("name", "pattern").agg(F.min(F.struct("seen", "gram")).alias("m")).select("name", "pattern", "m.gram")
        rare = F.broadcast(rare) if rare.count() <= BROADCAST_PATTERNS else rare
        hit = bodies.select("uid", F.explode(grams(F.col("body"), n)).alias("gram")).join(rare, "gram").select("uid", "name", "pattern").distinct()
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return bodies.select(F.col("uid").cast("string").alias("uid"), F.lit(None).cast("string").alias("name")).where("false")
    return bodies.select("uid", "body").join(found, "uid").where(F.contains("body", "pattern")).select(F.col("uid").cast("string").alias("uid"), "name").distinct()


def grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def header_matches(headers: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """headers(uid, headers map): the header at `header.<name>` is a pattern, or begins with one -> uid, name."""
    h = headers.select("uid", F.explode("headers").alias("header", "value")).withColumn("header", F.lower("header"))
    f = fingerprints.where("location_found like 'header.%'").select("name", "pattern", "pattern_type", F.substring("location_found", 8, 1000).alias("header"))
    hit = F.when(F.col("pattern_type") == "full", F.col("value") == F.col("pattern")).when(F.col("pattern_type") == "prefix", F.col("value").startswith(F.col("pattern")))
    return h.join(f, "header").where(hit).select("uid", "name")


def decoded(value: Column, format_: Column) -> Column:
    """Text, or the text that base64 stands for."""
    return F.when(format_ == "base64", F.try_to_binary(value, F.lit("base64")).cast("string")).otherwise(value)


def first_policy(keys: DataFrame, policy: DataFrame) -> DataFrame:
    """keys(probe_cc, probe_asn), policy(rule_no, cc, asn, ...; `*` is any) -> keys with the first rule that fits, nulls where none does.

    Each pair of keys looks up its four forms by equality, so the rules can be many.
    """
    p = policy.withColumnsRenamed({"cc": "_cc", "asn": "_asn"})
    first = p.groupBy("_cc", "_asn").agg(F.min_by(F.struct(*[c for c in p.columns if c[0] != "_"]), "rule_no").alias("rule"))
    pairs = keys.select("probe_cc", "probe_asn").distinct()
    forms = F.array(*[F.struct(c.alias("_cc"), a.alias("_asn")) for c in (F.col("probe_cc"), F.lit("*")) for a in (F.col("probe_asn"), F.lit("*"))])
    asked = pairs.select("probe_cc", "probe_asn", F.explode(forms).alias("f")).select("probe_cc", "probe_asn", "f._cc", "f._asn")
    best = asked.join(first, ["_cc", "_asn"]).groupBy("probe_cc", "probe_asn").agg(F.min_by("rule", "rule.rule_no").alias("rule"))
    return pairs.join(best, ["probe_cc", "probe_asn"], "left").select("probe_cc", "probe_asn", "rule.*")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 -> number; null if it isn't one."""
    p = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    ok = lambda p: (F.size(p) == 4) & F.forall(p, lambda x: F.coalesce(x.between(0, 255), F.lit(False)))
    return let(p, lambda p: F.when(ok(p), ((F.get(p, F.lit(0)) * 256 + F.get(p, F.lit(1))) * 256 + F.get(p, F.lit(2))) * 256 + F.get(p, F.lit(3))))


def hexed(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def six_digits(text: Column) -> Column:
    """An IPv6 address in lower case, without dots -> its 32 digits; null if it isn't one."""
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")

    def of(sides: Column) -> Column:
        left, right = (groups(F.get(sides, F.lit(k))) for k in range(2))
        return let(F.struct(left.alias("left"), right.alias("right"), F.size(sides).alias("n")), of_sides)

    def of_sides(s: Column) -> Column:
        missing = 8 - F.size(s["left"]) - F.size(s["right"])
        whole = ((s["n"] == 1) & (missing == 0)) | ((s["n"] == 2) & (missing >= 1))
        every = F.concat(s["left"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), s["right"])
        return F.when(whole, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))

    ok = text.rlike("^[0-9a-f:]+$") & ~text.rlike("^:[^:]|[^:]:$|:::|[0-9a-f]{5}")
    return F.when(ok, let(F.split(text, "::"), of))


def address_key(ip: Column) -> Column:
    """An address of either family -> text that sorts as the addresses do, IPv4 before IPv6; IPv6 forms of an IPv4 address are that one; null if it is neither."""

    def long(ip: Column) -> Column:
        tail = F.regexp_extract(ip, r":(\d+\.\d+\.\d+\.\d+)$", 1)
        head = lambda tail: F.substring(ip, F.lit(1), F.length(ip) - F.length(tail))
        plain = let(tail, lambda tail: F.when(tail == "", ip).otherwise(let(ip_number(tail), lambda n: F.concat(head(tail), hexed(F.shiftright(n, 16), 4), F.lit(":"), hexed(n.bitwiseAND(F.lit(65535)), 4)))))
        mapped = lambda six: six.startswith("0" * 20 + "ffff")
        return let(let(plain, six_digits), lambda six: F.when(mapped(six), F.concat(F.lit("4"), F.substring(six, 25, 8))).otherwise(F.concat(F.lit("6"), six)))

    either = lambda ip: let(ip_number(ip), lambda four: F.when(four.isNotNull(), F.concat(F.lit("4"), hexed(four, 8))).otherwise(long(ip)))
    return let(F.lower(F.trim(ip)), either)


def located(rows: DataFrame, ranges: DataFrame, ip: str = "ip") -> DataFrame:
    """rows(ip), ranges(first, last, cc, asn, org; disjoint; addresses, or numbers of IPv4) -> geo_cc, geo_asn, geo_org: ZZ, 0 and '' where no range holds the address.

    The ranges' starts and the different addresses are put in one order, dealt by
    range; an address belongs to the last start before it, if that range reaches it.
    The range that is open at a partition's edge is carried over. So a range is one
    row, however long it is.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = (1 << 32) - 1  # numbers beyond have no address: what lies there is no range, what reaches there ends here
    number = lambda n: F.concat(F.lit("4"), hexed(n, 8))
    text = lambda c: dict(ranges.dtypes)[c] == "string"
    first = address_key(F.col("first")) if text("first") else F.when(F.col("first") <= top, number(F.greatest("first", F.lit(0))))
    end = address_key(F.col("last")) if text("last") else F.when(F.col("last") >= 0, number(F.least("last", F.lit(top))))
    starts = ranges.select(first.alias("key"), F.lit(None).cast("string").alias("_ip"), F.struct(end.alias("last"), F.col("cc").alias("_cc"), F.col("asn").alias("_asn"), F.col("org").alias("_org")).alias("range"))
    asked = rows.select(F.col(ip).alias("_ip")).distinct().select(address_key(F.col("_ip")).alias("key"), "_ip").where("key is not null")
    both = starts.where("key is not null and range.last is not null").unionByName(asked, allowMissingColumns=True)
    order = ["key", F.col("_ip").asc_nulls_first()]
    dealt = written(both.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.groupBy("part").agg(F.max_by("range", F.when(F.col("range").isNotNull(), F.col("key"))).alias("range"))  # a row a partition
    carried = last.select("part", F.last("range", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    found = dealt.withColumn("range", F.last("range", ignorenulls=True).over(before)).where("_ip is not null").join(F.broadcast(carried), "part", "left")
    r = F.coalesce("range", "carried")
    hit = found.withColumn("range", r).where((F.col("key") <= F.col("range.last")) & (F.substring("key", 1, 1) == F.substring("range.last", 1, 1))).select("_ip", "range._cc", "range._asn", "range._org")
    out = rows.join(hit, rows[ip] == hit["_ip"], "left")
    return out.select(*[rows[c] for c in rows.columns], F.coalesce("_cc", F.lit("ZZ")).alias("geo_cc"), F.coalesce("_asn", F.lit(0)).alias("geo_asn"), F.coalesce("_org", F.lit("")).alias("geo_org"))


def geo_anomalies(rows: DataFrame) -> DataFrame:
    """Located rows whose country or network isn't the probe's own -> type, probe_cc, probe_asn, details (JSON)."""
    r = rows.where((F.col("geo_cc") != F.col("probe_cc")) | (F.col("geo_asn") != F.col("probe_asn")))
    kind = F.when(F.col("geo_cc") != F.col("probe_cc"), "geoip_cc").otherwise("geoip_asn")
    return r.select(*[c for c in rows.columns if c not in ("geo_cc", "geo_asn", "geo_org")], kind.alias("type"), F.to_json(F.struct(F.col("geo_cc").alias("cc"), F.col("geo_asn").alias("asn"))).alias("details"))


def openvpn_observations(bodies: DataFrame) -> DataFrame:
    """bodies(measurement_uid, v VARIANT) of openvpn -> flat rows; the last transaction is 0 unless every event has one."""
    at = lambda path, kind="string": F.try_variant_get("v", f"$.{path}", kind)
    key = lambda name, kind="string": at(f"test_keys.{name}", kind)
    ids = F.transform(at("test_keys.network_events", "array<variant>"), lambda e: F.try_variant_get(e, "$.transaction_id", "long"))
    last = F.when(F.forall(ids, lambda i: i.isNotNull()), F.array_max(ids))
    asn = F.regexp_replace(at("resolver_asn"), "^AS", "").try_cast("long")
    yes = lambda name: F.coalesce(key(name, "boolean"), F.lit(False)).alias(name)
    return bodies.select(
        "measurement_uid", F.coalesce(last, F.lit(0)).alias("last_handshake_transaction_id"), F.coalesce(asn, F.lit(0)).alias("resolver_asn"), F.coalesce(at("success", "boolean"), F.lit(False)).alias("anomaly"), F.lit(False).alias("confirmed"),
        *[yes(n) for n in ("success", "success_handshake", "success_icmp", "success_urlgrab")], F.coalesce(key("bootstrap_time", "double"), F.lit(0.0)).alias("bootstrap_time"),
        *[key(n).alias(n) for n in ("failure", "provider", "transport", "remote", "obfuscation", "minivpn_version", "obfs4_version")], *[at(n).alias(n) for n in ("input", "report_id", "probe_cc", "probe_network_name", "resolver_ip", "resolver_network_name", "software_name", "software_version", "platform")],
        F.regexp_replace(at("probe_asn"), "^AS", "").try_cast("long").alias("probe_asn"), F.try_to_timestamp(at("measurement_start_time")).alias("measurement_start_time"), F.try_to_timestamp(at("test_start_time")).alias("test_start_time"), F.coalesce(at("test_runtime", "double"), F.lit(0.0)).alias("test_runtime"),
    )
