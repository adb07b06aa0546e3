"""Daily values of edges and groups, with a baseline where a day has none, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.choice import softmax
from tramline.operators.groups import beside
from tramline.operators.network import EDGE
from tramline.operators.trips import minutes
from tramline.session import checkpointed

LONGEST = 180.0


def segments(legs: DataFrame) -> DataFrame:
    """date, EDGE, rides, passengers and the least, mean and greatest minutes of the legs ridden there."""
    m = legs.filter("ride is not null and alight is not null and route_id is not null and origin is not null and destination is not null").withColumn("m", minutes(F.col("ride"), F.col("alight")))
    m = m.filter((F.col("m") > 0) & (F.col("m") <= LONGEST))
    key = [F.col("service_date").alias("date"), F.substring("ride", 9, 2).cast("int").alias("hour"), "route_id", F.col("origin").alias("from_stop_id"), F.col("destination").alias("to_stop_id")]
    return m.groupBy(*key).agg(F.count(F.lit(1)).alias("rides"), F.sum("passengers").alias("passengers"), F.min("m").alias("least"), F.avg("m").alias("mean"), F.max("m").alias("greatest"))


def baseline(daily: DataFrame) -> DataFrame:
    """EDGE with the mean and sample deviation of its daily minutes, the days it has, the least of all and the first day's passengers."""
    return daily.groupBy(*EDGE).agg(F.avg("mean").alias("tt"), F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("std"), F.count_distinct("date").alias("days"), F.min("least").alias("least"), F.min_by("passengers", F.when(F.col("passengers").isNotNull(), F.col("date"))).alias("first_passengers"))


def split_days(dates: DataFrame, date: str, weekdays: tuple[int, ...] = (1, 2, 3), share: float = 2 / 3) -> tuple[list[str], list[str]]:
    """(training, test) days among those weekdays (Monday 0), in order; the calendar bounds them."""
    d = F.to_date(F.try_to_timestamp(F.col(date), F.lit("yyyyMMdd")))
    days = [r[0] for r in dates.filter(F.weekday(d).isin(*weekdays)).select(date).distinct().orderBy(date).collect()]
    k = int(len(days) * share)
    return days[:k], days[k:]


def on_days(df: DataFrame, days: list[str]) -> DataFrame:
    """Every row once for each of the days."""
    return df.withColumn("date", F.explode(F.array(*map(F.lit, days)).cast("array<string>")))


def filled(edges: DataFrame, daily: DataFrame, days: list[str]) -> DataFrame:
    """Every edge on every day: the day's minutes and passengers, or the baseline's tt and load0 where the day has none."""
    d = daily.select("date", *EDGE, "mean", "passengers")
    out = on_days(edges, days).join(d, ["date", *EDGE], "left")
    return out.select("date", *EDGE, "trips", F.coalesce("mean", "tt").alias("tt"), F.coalesce("passengers", "load0").alias("load0"), F.when(F.col("mean").isNull(), "baseline").otherwise("daily").alias("source"))


def mean_over_days(edges: DataFrame, daily: DataFrame, days: list[str]) -> DataFrame:
    """EDGE, tt, load, n_days: means of filled() over the days, from the days that an edge has and their number, so that no day is filled."""
    d = daily.filter(F.col("date").isin(days)).groupBy(*EDGE).agg(F.count("mean").alias("n_days"), F.sum("mean").alias("_t"), F.sum("passengers").alias("_l"))
    e = edges.join(d, EDGE, "left").na.fill(0, ["n_days", "_t", "_l"])
    mean = lambda s, b: (F.col(s) + (len(days) - F.col("n_days")) * F.col(b)) / max(1, len(days))
    return e.select(*EDGE, mean("_t", "tt").alias("tt"), mean("_l", "load0").alias("load"), "n_days")


def demand_on_days(groups: DataFrame, od: DataFrame, days: list[str]) -> DataFrame:
    """Every group (hour, origin, destination) on every day with its passengers in the matrix, 0 where it has none."""
    key = ["hour", "origin_stop_id", "destination_stop_id"]
    met = od.filter(F.col("date").isin(days)).groupBy("date", *key).agg(F.sum("passengers").alias("demand"))
    return on_days(groups.select(*key), days).join(met, ["date", *key], "left").na.fill(0.0, ["demand"])


def states(inc: DataFrame, filled_edges: DataFrame, paths: DataFrame, waits: DataFrame, path_key: list[str], group: list[str], utility: Column, days: list[str]) -> DataFrame:
    """date, path key, ride, total_time, u, p0, demand of every path on every day: riding from the day's edges, total with wait and walk, utility of these.

    paths: path key, walk_time, transfers, demand; waits: path key, wait.
    """
    ride = inc.join(filled_edges.select("date", *EDGE, "tt"), EDGE).groupBy("date", *path_key).agg(F.sum("tt").alias("ride"))
    p = paths.join(waits, path_key, "left").na.fill(0.0, ["wait"])
    s = ride.join(p, path_key).withColumn("total_time", F.col("ride") + F.col("wait") + F.col("walk_time")).withColumn("u", utility)
    return softmax(s.select("date", *path_key, "ride", "total_time", "u", "demand"), ["date", *group], "u", "p0")


def relief_on_days(inc: DataFrame, filled_edges: DataFrame, state: DataFrame, path_key: list[str], group: list[str], weight: float) -> DataFrame:
    """date, EDGE, relief: how much the whole cost falls per unit of an edge's weight on that day."""
    c = inc.join(filled_edges.select("date", *EDGE, (2 * F.col("tt") * F.col("load0")).alias("c")), EDGE).groupBy("date", *path_key).agg(F.sum("c").alias("c"))
    p = state.join(c, ["date", *path_key])
    p = beside(p, ["date", *group], g=F.sum(F.col("p0") * F.col("c")))
    w = p.select("date", *path_key, (F.lit(weight) * F.col("demand") * F.col("p0") * (F.col("c") - F.col("g"))).alias("w"))
    return inc.join(w, path_key).groupBy("date", *EDGE).agg((-F.sum("w")).alias("relief"))


def moments_over_days(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """key with sum, mean and population deviation of the value over its days, and on how many and what share of them it is above 0."""
    n = F.count(F.lit(1))
    aggs = [F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count_if(F.col(value) > 0).alias("positive"), (F.count_if(F.col(value) > 0) / n).alias("positive_share")]
    return df.groupBy(*key).agg(*aggs)


def dense_ids(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """The distinct keys with ids from 0 in their order: ranges are sorted apart, and each begins where those before it end."""
    ranged = df.select(*key).distinct().repartitionByRange(*key).withColumn("_part", F.spark_partition_id())
    kept = checkpointed(ranged)  # ranges are drawn from a sample, so they must not be drawn twice
    sizes = kept.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # one row per range
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*key)) - 1
    return kept.withColumn("_at", at).join(before, "_part").select(*key, (F.col("_before") + F.col("_at")).cast("long").alias(name))
