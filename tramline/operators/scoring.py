"""Scalings, ranks and scores of features, and summaries of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import checkpointed

#: Bins of a value in which ranks are counted.
BINS = 1 << 14


def sigmoid(s: Column, most: float) -> Column:
    """most / (1 + exp(-s)); an overflow of exp gives 0."""
    return F.lit(most) / (1 + F.exp(-s))


def stepped(c: Column, step: float, most: float) -> Column:
    """Rounded half-even to steps and clipped to [0, most]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(most), F.rint(c / step) * step))


def low_crowding(load: Column, ref: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - load / ref))


def positive_percentile_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Average-method percentile rank among positive values, 0 elsewhere.

    Ranks come from a table of distinct values, range-partitioned by Spark, never from all rows in one task.
    """
    counts = df.filter(F.col(value) > 0).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    buckets = counts.withColumn("__b", F.floor(F.log2(F.col(value)) * 64).cast("long"))
    per = buckets.groupBy("__b").agg(F.sum("__c").alias("__n"))
    # Binary orders of magnitude in 64 steps: at most some 130,000 rows for doubles.
    before = F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    per = per.withColumn("__base", before).withColumn("__all", F.sum("__n").over(Window.partitionBy()))
    inside = F.sum("__c").over(Window.partitionBy("__b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__c")
    ranks = buckets.withColumn("__in", inside).join(per, "__b")
    ranks = ranks.select(F.col(value).alias("__v"), ((F.col("__base") + F.col("__in") + (F.col("__c") + 1) / 2.0) / F.col("__all")).alias(out))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v").withColumn(out, F.coalesce(out, F.lit(0.0)))


def quantiles(df: DataFrame, value: str, at: tuple[float, ...], scope: str | None = None) -> DataFrame:
    """scope, q, v: exact interpolated quantiles over all rows (scope null) and, if a scope is named, over the rows of each of its values.

    Values fall into BINS equal bins. Counts per bin tell in which bins the ranks lie; only the distinct values of those
    bins are ordered, so that no task holds the values of all rows.
    """
    rows = df.select((F.col(scope).cast("string") if scope else F.lit(None).cast("string")).alias("scope"), F.col(value).cast("double").alias("v")).filter("v is not null")
    ends = rows.agg(F.min("v"), F.max("v")).first()
    if ends[0] is None:
        return rows.select("scope", F.lit(0.0).alias("q"), "v").limit(0)
    width = (ends[1] - ends[0]) / BINS if ends[1] > ends[0] else 1.0
    rows = rows.withColumn("bin", F.floor((F.col("v") - ends[0]) / width).cast("long"))
    per = rows.groupBy("scope", "bin", "v").agg(F.count(F.lit(1)).alias("c"))
    if scope:
        per = per.unionByName(per.groupBy("bin", "v").agg(F.sum("c").alias("c")).withColumn("scope", F.lit(None).cast("string")))
    per = checkpointed(per)
    bins = per.groupBy("scope", "bin").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("scope")
    bins = bins.withColumn("before", F.sum("c").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("n", F.sum("c").over(w))
    asked = bins.withColumn("q", F.explode(F.array(*map(F.lit, at)))).withColumn("pos", F.col("q") * (F.col("n") - 1)).withColumn("k", F.explode(F.array_distinct(F.array(F.floor("pos"), F.ceil("pos")))))
    asked = asked.filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("before") + F.col("c"))).select(F.col("scope").alias("_s"), F.col("bin").alias("_b"), "before", "q", "pos", "k")
    inside = F.sum("c").over(Window.partitionBy("scope", "bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    wanted = asked.select("_s", "_b").distinct()
    here = per.join(wanted, per["scope"].eqNullSafe(wanted["_s"]) & (per["bin"] == wanted["_b"]), "left_semi").withColumn("upto", inside)
    met = here.join(asked, here["scope"].eqNullSafe(asked["_s"]) & (here["bin"] == asked["_b"])).filter((F.col("before") + F.col("upto") - F.col("c") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("upto")))
    part = F.col("pos") - F.floor("pos")
    return met.groupBy("scope", "q").agg((F.min("v") + (F.max("v") - F.min("v")) * F.max(part)).alias("v"))


def scaled_by_p99(df: DataFrame, value: str, out: str, log: bool = False) -> DataFrame:
    """Positive part over its exact 99th percentile among positives (log1p of both if log), clipped to [0, 1]."""
    p99 = quantiles(df.filter(F.col(value) > 0), value, (0.99,)).agg(F.max("v").alias("__p99"))
    f = F.log1p if log else (lambda c: c)
    scaled = F.when(F.col("__p99") > 0, f(F.greatest(F.col(value), F.lit(0.0))) / f(F.col("__p99"))).otherwise(0.0)
    # One row.
    return df.join(F.broadcast(p99)).withColumn(out, F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("__p99")


def rollup_stats(df: DataFrame, scope: str, value: str, at: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Count, sum, mean, greatest and exact quantiles over all rows and per scope value."""
    aggs = [F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("greatest")]
    out = df.rollup(scope).agg(F.grouping(scope).alias("__g"), *aggs)
    name = lambda c, is_all: F.when(is_all, "all").otherwise(c)
    out = out.select(name(F.col(scope).cast("string"), F.col("__g") == 1).alias("scope"), "n", "total", "mean", "greatest")
    q = quantiles(df.filter(F.col(scope).isNotNull()), value, at, scope).withColumn("scope", name(F.col("scope"), F.col("scope").isNull()))
    q = q.groupBy("scope").agg(*(F.max(F.when(F.col("q") == x, F.col("v"))).alias(f"p{round(x * 100)}") for x in at))
    return out.join(q, "scope", "left")


def first_differences(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """Each value less that of the row before; for short report tables, one row per setting."""
    w = Window.orderBy(order)
    return df.select("*", *((F.col(v) - F.lag(v).over(w)).alias(f"d_{v}") for v in values))
