"""Prioritised URL lists: wildcard rules, measured counts, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ("category_code", "domain", "url", "cc")
#: A rule's form for global URLs, whose country doesn't matter.
ANY = "any country"


def url_priorities(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls(url, domain, category_code, cc) -> priority: the sum of the rules that match.

    A field of a rule matches if it is '', '*' or equal; cc doesn't matter for
    global (zz) URLs. A URL has sixteen forms (eight if global), each field itself
    or `*`, and looks them up by equality, so the rules can be many.
    """
    free = lambda c: F.when(F.col(c).isin("", "*"), "*").otherwise(F.lower(c) if c == "cc" else F.col(c))
    r = rules.select(*[free(c).alias(c) for c in FIELDS], "priority")
    r = r.unionByName(r.withColumn("cc", F.lit(ANY))).groupBy(*FIELDS).agg(F.sum("priority").alias("priority"))
    either = lambda c: F.array(F.col(c), F.lit("*"))
    u = urls.withColumn("_cc", F.explode(F.when(F.lower("cc") == "zz", F.array(F.lit(ANY))).otherwise(F.array(F.lower("cc"), F.lit("*")))))
    for c in FIELDS[:3]:
        u = u.withColumn(f"_{c}", F.explode(either(c)))
    r = r.select(*[F.col(c).alias(f"_{c}") for c in FIELDS], "priority")
    return u.join(r, [f"_{c}" for c in FIELDS], "left").groupBy("category_code", "domain", "url", "cc").agg(F.coalesce(F.sum("priority"), F.lit(0)).alias("priority"))


def weighted(priorities: DataFrame, counts: DataFrame) -> DataFrame:
    """counts(url, msmt_cnt) -> weight: priority over the count, at least 0.1."""
    cnt = F.coalesce("msmt_cnt", F.lit(0))
    return priorities.join(counts, "url", "left").withColumn("msmt_cnt", cnt).withColumn("weight", F.col("priority") / F.greatest(cnt, F.lit(0.1)))


def test_list(weights: DataFrame, categories: list[str] | None, limit: int | None) -> DataFrame:
    """The first URLs by weight (without a limit all, in no order); ZZ reads XX in the answer."""
    w = weights.where("priority > 0")
    if categories:
        w = w.where(F.col("category_code").isin(*categories))
    cc = F.when(F.upper("cc") == "ZZ", "XX").otherwise(F.upper("cc"))
    if limit is not None:
        w = w.orderBy(F.desc("weight"), "url", "category_code", "cc").limit(limit)
    return w.select("category_code", "url", cc.alias("country_code"), "weight")
