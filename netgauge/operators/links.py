"""Versioned links with their tests, findings with roles, default rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The priority of each category before anyone edits the rules.
DEFAULT_PRIORITIES = {
    "NEWS": 100,
    "POLR": 100,
    "HUMR": 100,
    "LGBT": 100,
    "ANON": 100,
    "MMED": 80,
    "SRCH": 80,
    "PUBH": 80,
    "REL": 60,
    "XED": 60,
    "HOST": 60,
    "ENV": 60,
    "FILE": 40,
    "CULTR": 40,
    "IGO": 40,
    "GOVT": 40,
    "DATE": 30,
    "HATE": 30,
    "MILX": 30,
    "PROV": 30,
    "PORN": 30,
    "GMB": 30,
    "ALDR": 30,
    "GAME": 20,
    "MISC": 20,
    "HACK": 20,
    "ECON": 20,
    "COMM": 20,
    "CTRL": 20,
    "COMT": 100,
    "GRP": 100,
}


def default_rules(spark: SparkSession) -> DataFrame:
    rules = [(1, c, "*", "*", "*", p) for c, p in DEFAULT_PRIORITIES.items()]
    return spark.createDataFrame(rules, "sign int, category_code string, cc string, domain string, url string, priority int")


def numbered(revisions: DataFrame) -> DataFrame:
    """revisions(link_id, created, ...) with revision (from 1 on) and whether it is the latest."""
    w = Window.partitionBy("link_id")
    order = w.orderBy("created", "revision_key")
    return revisions.withColumn("revision", F.row_number().over(order)).withColumn("latest", F.col("revision") == F.count("*").over(w))


def listed(revisions: DataFrame, nettests: DataFrame, as_of: str, creator: int | None = None, with_expired: bool = False) -> DataFrame:
    """Latest revisions, of one creator and not expired unless asked otherwise, with their tests in order."""
    r = numbered(revisions).where("latest")
    if not with_expired:
        r = r.where(F.col("expires") > F.lit(as_of).cast("timestamp"))
    if creator is not None:
        r = r.where(F.col("creator") == creator)
    tests = nettests.join(r.select("revision_key"), "revision_key", "left_semi").groupBy("revision_key").agg(F.array_sort(F.collect_list(F.struct("nettest_no", "test_name"))).alias("nettests"))
    return r.join(tests, "revision_key", "left")


def revision(revisions: DataFrame, number: int | str = "latest") -> DataFrame:
    """Every link's revision of a number, or its latest."""
    r = numbered(revisions)
    return r.where("latest") if number == "latest" else r.where(F.col("revision") == int(number))


def descriptors(revisions: DataFrame, only_latest: bool = True, with_archived: bool = False, creator: int | None = None, ids: list[int] | None = None) -> DataFrame:
    r = numbered(revisions)
    r = r.where("latest") if only_latest else r
    r = r if with_archived else r.where("not archived")
    r = r if creator is None else r.where(F.col("creator") == creator)
    return (r.where(F.col("link_id").isin(*ids)) if ids else r).orderBy(F.desc("created"), "link_id")


def prioritised_inputs(links: DataFrame, urls: DataFrame, limit: int) -> DataFrame:
    """Puts the heaviest URLs of the link's country into its web tests: inputs, and the rest of each URL's fields apart.

    urls(country_code, url, category_code, weight); a list is as long as `limit`, so it's the lists that are grouped.
    """
    w = Window.partitionBy("country_code").orderBy(F.desc("weight"), "url", "category_code")
    top = urls.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit)
    lists = top.groupBy("country_code").agg(F.array_sort(F.collect_list(F.struct("_n", "url", "category_code"))).alias("l"))
    lists = lists.select("country_code", F.transform("l", lambda x: x["url"]).alias("inputs"), F.transform("l", lambda x: x["category_code"]).alias("inputs_extra"))
    return links.join(lists, "country_code", "left")


def findings(rows: DataFrame, account: int, role: str = "user", themes: list[str] | None = None, ccs: list[str] | None = None, asns: list[int] | None = None, domains: list[str] | None = None, only_mine: bool = False) -> DataFrame:
    """Findings that hold any of what is asked for; e-mail addresses are for admins, unpublished ones for signed-in users."""
    r = rows.where("not deleted")
    for column, asked in {"themes": themes, "ccs": ccs, "asns": asns, "domains": domains}.items():
        if asked:
            r = r.where(F.arrays_overlap(column, F.array(*map(F.lit, asked))))
    r = r.where("published") if role == "anonymous" else r
    r = r.withColumn("mine", F.col("creator") == account)
    r = r.where("mine") if only_mine else r
    return r if role == "admin" else r.withColumn("email_address", F.lit(""))


def finding(rows: DataFrame, id_or_slug: str) -> DataFrame:
    """By number where the text is one, else by slug."""
    return rows.where(F.when(F.lit(id_or_slug).try_cast("long").isNotNull(), F.col("finding_id") == F.lit(id_or_slug).try_cast("long")).otherwise(F.col("slug") == id_or_slug) & ~F.col("deleted"))
