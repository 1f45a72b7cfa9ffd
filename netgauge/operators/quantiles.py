"""Exact quantiles of groups of any size, in bounded state.

A group of at most SMALL different values is a list of values and their counts.
In larger ones a mergeable sketch brackets the ranks asked for; values below the
bracket are counted and those inside are sketched again, until SMALL different
values or fewer are inside. So no task ever holds a group's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netgauge.sources.store import written

#: Different values of a group that are held at once; size of a sketch, twice its error in rank, and ranks that it is asked for.
SMALL, SKETCH, MARGIN, GRID = 20_000, 200, 0.04, 50

#: Name of the result, column, p.
Target = tuple[str, str, float]


def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys of which any may be null."""
    r = right.withColumnsRenamed({k: f"_{k}_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(r[f"_{k}_"])
    return left.join(r, on, how).drop(*[f"_{k}_" for k in keys])


def inside(low: str = "low", high: str = "high") -> Column:
    return F.col("v").between(F.col(low), F.col(high))


def narrowed(values: DataFrame, bounds: DataFrame, of: list[str]) -> DataFrame:
    """The brackets after one more look at the values inside them."""
    fixed = ["n", "first", "last", "low", "high", "below", "within", "different"]
    sketched = beside(values, bounds, of).where(inside()).groupBy(*of, *fixed).agg(F.kll_sketch_agg_double("v", F.lit(SKETCH)).alias("sketch"))
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / GRID) for k in range(GRID + 1)]))
    share = lambda rank: (rank - F.col("below")) / F.col("within")
    low, high = share(F.col("first")) - MARGIN, share(F.col("last") + 1) + MARGIN
    tight = {"new_low": F.when(low > 0, F.get("grid", F.floor(low * GRID).cast("int"))).otherwise(F.col("low")), "new_high": F.when(high < 1, F.get("grid", F.ceil(high * GRID).cast("int"))).otherwise(F.col("high"))}
    tried = written(sketched.withColumn("grid", grid).withColumns(tight).drop("sketch", "grid"))
    ins = inside("new_low", "new_high")
    seen = beside(values, tried, of).groupBy(*of, *fixed, *tight).agg(F.count_if(F.col("v") < F.col("new_low")).alias("new_below"), F.count_if(ins).alias("new_within"), F.approx_count_distinct(F.when(ins, F.col("v"))).alias("new_different"))
    # A bracket that misses a rank, as a sketch errs, is not taken; the next sketch is another.
    ok = (F.col("first") >= F.col("new_below")) & (F.col("last") < F.col("new_below") + F.col("new_within"))
    return seen.select(*of, "n", "first", "last", *[F.when(ok, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in fixed[3:]])


def quantiles(rows: DataFrame, keys: list[str], targets: list[Target]) -> DataFrame:
    """rows -> keys and, for each target, the column's quantile by linear interpolation between ranks; null where a group has no value, no row where it has none for all targets.

    Two looks at the rows for groups of at most SMALL different values; larger ones
    take two more for each round, of which each leaves about an eighth of the values.
    """
    of = [*keys, "target"]
    every = F.explode(F.array(*[F.struct(F.lit(i).alias("target"), F.col(c).cast("double").alias("v")) for i, (_, c, _) in enumerate(targets)])).alias("x")
    values = rows.select(*keys, every).select(*keys, "x.target", "x.v").where("v is not null")
    p = F.element_at(F.array(*[F.lit(float(t[2])) for t in targets]), F.col("target") + 1)
    at = (F.col("n") - 1) * p
    bounds = values.groupBy(*of).agg(F.count("*").alias("n"), F.approx_count_distinct("v").alias("different"))
    bounds = written(bounds.select(*of, "n", F.floor(at).alias("first"), F.ceil(at).alias("last"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("below"), F.col("n").alias("within"), "different"))
    held = None
    while True:
        large = bounds.where(F.col("different") > SMALL)
        left = large.agg(F.sum("within")).first()[0]
        if left is None or held is not None and left >= held:  # no bracket gets tighter: what is inside is listed as it is
            break
        held = left
        bounds = written(bounds.where(F.col("different") <= SMALL).unionByName(narrowed(values, large, of)))
    counted = beside(values, bounds.select(*of, "low", "high"), of).where(inside()).groupBy(*of, "v").agg(F.count("*").alias("c"))
    listed = counted.groupBy(*of).agg(F.array_sort(F.collect_list(F.struct("v", "c"))).alias("list"))

    def value(rank: Column) -> Column:
        """The value of a rank, from 0, of those inside."""
        none = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, x: F.struct((acc["seen"] + x["c"]).alias("seen"), F.when(acc["v"].isNull() & (acc["seen"] + x["c"] > rank), x["v"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate("list", none, step)["v"]

    found = beside(listed, bounds, of).select(*of, value(F.col("first") - F.col("below")).alias("a"), value(F.col("last") - F.col("below")).alias("b"), (at - F.col("first")).alias("part"))
    q = found.select(*of, ((1 - F.col("part")) * F.col("a") + F.col("part") * F.col("b")).alias("q"))
    return q.groupBy(*keys).agg(*[F.max(F.when(F.col("target") == i, F.col("q"))).alias(name) for i, (name, _, _) in enumerate(targets)])
