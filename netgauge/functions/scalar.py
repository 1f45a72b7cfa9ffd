"""Scalar building blocks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_of(url: Column) -> Column:
    """The authority of a URL (with port and user), empty without one."""
    return F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit(""))


def input_and_domain(v: Column) -> tuple[Column, Column]:
    """A record's input as text and its domain; a list of inputs reads `{a,b}` and has its first one's domain."""
    many = F.try_variant_get(v, "$.input", "array<string>")
    one = F.coalesce(F.try_variant_get(v, "$.input", "string"), F.lit(""))
    return F.when(many.isNotNull(), F.concat(F.lit("{"), F.array_join(many, ","), F.lit("}"))).otherwise(one), domain_of(F.when(many.isNotNull(), F.coalesce(F.get(many, F.lit(0)), F.lit(""))).otherwise(one))


def asn_number(asn: Column) -> Column:
    """`AS123` -> 123; anything else -> 0."""
    return F.coalesce(F.regexp_replace(F.upper(F.trim(asn)), "^[AS]+", "").try_cast("long"), F.lit(0))


def split_list(text: Column) -> Column:
    """Comma-separated items: trimmed, distinct, sorted, blanks dropped."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")))


def expected_countries(text: Column) -> Column:
    return F.array_sort(F.filter(F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x))), lambda x: ~x.isin("", "ZZ")))


def week_start(ts: Column) -> Column:
    """Weeks begin on Sunday."""
    return F.to_date(F.date_trunc("week", ts + F.expr("interval 1 day")) - F.expr("interval 1 day"))


def bucket(ts: Column, grain: str) -> Column:
    if grain == "week":
        return week_start(ts).cast("timestamp")
    return F.date_trunc(grain, ts)


def version(text: Column) -> Column:
    """Dotted version as an array of numbers, which compares as versions do."""
    return F.transform(F.split(text, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def slug(created: Column, title: Column) -> Column:
    """Year and title in lower case, blanks as dashes, other characters dropped; 64 characters of it."""
    text = F.regexp_replace(F.regexp_replace(F.lower(title), " ", "-"), "[^a-z0-9-]", "")
    return F.concat(F.date_format(created, "yyyy"), F.lit("-"), F.substring(text, 1, 64))


def measurement_uid(ts: Column, cc: Column, test: Column, body: Column) -> Column:
    return F.concat_ws("_", F.date_format(ts, "yyyyMMddHHmmss.SSSSSS"), cc, F.regexp_replace(test, "_", ""), F.substring(F.sha2(body, 512), 1, 16))


def keyed_hash(ip: Column, key: str) -> Column:
    return F.sha2(F.concat(F.lit(key), ip), 256)


def first_forwarded(header: Column) -> Column:
    return F.trim(F.get(F.split(header, ","), F.lit(0)))


def wrong_date(uid: Column, start: Column) -> Column:
    """The uid's time lies more than an hour before, or a year after, the start; only for uids that begin with a year 20xx."""
    made = F.try_to_timestamp(F.substring(uid, 1, 21), F.lit("yyyyMMddHHmmss.SSSSSS"))
    gap = (F.unix_micros(made) - F.unix_micros(start)) / 1e6
    usable = uid.startswith("20") & (F.length(uid) >= 20)
    return F.coalesce(usable & ((gap < -3600) | (gap > 365 * 86400)), F.lit(False))


def lenient_time(text: Column) -> Column:
    """A date or time of several forms, without a zone in UTC; null if it is none."""
    t = F.trim(text)
    forms = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]", "yyyyMMdd'T'HHmmss'Z'", "yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "d MMM yyyy")
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in forms])


def iso_midnight(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd'T00:00:00+00:00'")


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def valid_url(url: Column) -> Column:
    """http(s) URL without blanks around it, control characters or backslashes."""
    return F.coalesce((url == F.trim(url)) & ~url.rlike(r"[\r\n\t\\]") & url.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


# The categories of a list of URLs.
CATEGORIES = (
    "ALDR", "ANON", "COMM", "COMT", "CTRL", "CULTR", "DATE", "ECON", "ENV", "FILE", "GAME", "GMB", "GOVT", "GRP", "HACK", "HATE",
    "HOST", "HUMR", "IGO", "LGBT", "MILX", "MISC", "MMED", "NEWS", "POLR", "PORN", "PROV", "PUBH", "REL", "SRCH", "XED",
)


def entry_faults(url: Column, category: Column, added: Column) -> Column:
    """Reasons why an entry of a URL list is refused: its URL must have a path, its category be known, its date exist."""
    ok = lambda c: ~F.coalesce(c, F.lit(False))
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    same = F.date_format(F.try_to_timestamp(added, F.lit("yyyy-MM-dd")), "yyyy-MM-dd") == added
    return F.array_compact(F.array(F.when(ok(valid_url(url) & (path != "")), "bad_url"), F.when(ok(category.isin(*CATEGORIES)), "bad_category"), F.when(ok(same), "bad_date")))


def report_faults(rid: Column, cc: Column, asn: Column, test: Column) -> Column:
    """How a report id differs from what its body says; `bad_id` if it has no fitting shape."""
    p = report_id_parts(rid)
    differs = lambda a, b: F.coalesce(a != b, F.lit(True))
    return F.when(p.isNull(), F.array(F.lit("bad_id"))).otherwise(F.array_compact(F.array(F.when(differs(p["probe_cc"], cc), "cc"), F.when(differs(p["probe_asn"], asn_number(asn)), "asn"), F.when(differs(p["test_name"], F.regexp_replace(test, "_", "")), "test_name"))))


def meta_faults(cc: Column, asn: Column, test: Column) -> Column:
    """Reasons why a submission is refused; empty if none."""
    a = F.upper(asn)
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(cc.rlike("^[A-Z0-9]{2}$"), F.lit(False)), "bad_cc"),
            F.when(~F.coalesce(test.rlike("^[a-z0-9_]{2,30}$"), F.lit(False)), "bad_test_name"),
            F.when(~F.coalesce(a.rlike("^AS(0|[1-9][0-9]{0,9})$"), F.lit(False)), "bad_asn"),
            F.when(a == "AS0", "asn_zero"),
            F.when(cc == "ZZ", "cc_unknown"),
        )
    )


def report_id_parts(rid: Column) -> Column:
    """ts, test, cc, asn, collector and random part of a report id; null unless it has six parts of fitting shape."""
    p = F.split(rid, "_")
    ok = (F.size(p) == 6) & p[0].rlike("^[0-9]{8}T[0-9]{6}Z$") & p[2].rlike("^[A-Z]{2}$") & p[3].rlike("^[0-9]+$")
    return F.when(ok, F.struct(p[0].alias("ts"), p[1].alias("test_name"), p[2].alias("probe_cc"), p[3].cast("long").alias("probe_asn"), p[4].alias("collector"), p[5].alias("nonce")))


def legacy_time(value: Column) -> Column:
    """Epoch seconds or text -> `yyyy-MM-dd HH:mm:ss`."""
    return F.date_format(F.coalesce(F.timestamp_seconds(value.try_cast("double")), F.try_to_timestamp(value)), "yyyy-MM-dd HH:mm:ss")


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def backfill_score(anomaly: Column, confirmed: Column) -> Column:
    return F.when(anomaly, F.lit(0.8)).when(confirmed, F.lit(2.0)).otherwise(F.lit(0.0))
