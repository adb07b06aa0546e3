"""Origin-destination matrices: cleaning, baselines, comparison, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions.clean import clean_id
from tramline.operators.groups import first_per

CELL = ["hour", "origin_stop_id", "destination_stop_id"]


def clean_od(od: DataFrame) -> DataFrame:
    """Bus cells with passengers, of rows delivered again the latest: date, hour, origin, destination, source_label, passengers."""
    rows = od.select(clean_id("date").alias("date"), "hour", clean_id("origin_stop_id").alias("origin_stop_id"), clean_id("destination_stop_id").alias("destination_stop_id"), "source_label", F.nanvl("passengers", F.lit(None).cast("double")).alias("passengers"), "loaded_at")
    bus = rows.filter(F.col("origin_stop_id").rlike(r"^[0-9]{9}\z") & F.col("destination_stop_id").rlike(r"^[0-9]{9}\z") & (F.col("origin_stop_id") != F.col("destination_stop_id")) & F.col("hour").between(0, 23) & F.col("date").isNotNull())
    last = first_per(bus, ["date", *CELL, "source_label"], [F.col("loaded_at").desc_nulls_last(), F.col("passengers").desc_nulls_last()])
    return last.filter("passengers > 0").drop("loaded_at")


def hourly(cells: DataFrame) -> DataFrame:
    """Passengers by date and cell (additive upsert of all sources)."""
    return cells.groupBy("date", *CELL).agg(F.sum("passengers").alias("passengers"))


def baseline_zero_inclusive(od: DataFrame, days: int) -> DataFrame:
    """Moments over all days, those without a row counting as 0."""
    s = od.groupBy(*CELL).agg(F.sum("passengers").alias("total"), F.sum(F.col("passengers") ** 2).alias("squares"), F.count(F.lit(1)).alias("positive_days"))
    var = F.greatest(F.col("squares") - F.col("total") ** 2 / days, F.lit(0.0)) / max(days - 1, 1)
    return s.select(*CELL, "total", (F.col("total") / days).alias("avg"), F.sqrt(var).alias("std"), "positive_days", F.lit(days).alias("observations"))


def baseline_positive_days(od: DataFrame, days: int) -> DataFrame:
    """Moments over the days with a row; one day has a deviation of 0."""
    return od.groupBy(*CELL).agg(F.sum("passengers").alias("total"), F.avg("passengers").alias("avg"), F.coalesce(F.stddev_samp("passengers"), F.lit(0.0)).alias("std"), F.count_distinct("date").alias("positive_days")).withColumn("observations", F.lit(days))


def compared(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of two measures (passengers), 0 where absent, with difference, ratio and which sides are there; null keys match."""
    left = a.groupBy(*key).agg(F.sum("passengers").alias("left_passengers"), F.lit(1).alias("__l"))
    right = b.groupBy(*key).agg(F.sum("passengers").alias("right_passengers"), F.lit(1).alias("__r")).withColumnsRenamed({k: f"__{k}" for k in key})
    on = [left[k].eqNullSafe(right[f"__{k}"]) for k in key]
    j = left.join(right, on, "full").withColumns({k: F.coalesce(k, f"__{k}") for k in key})
    side = F.when(F.col("__l").isNull(), "right_only").when(F.col("__r").isNull(), "left_only").otherwise("both")
    j = j.withColumns({"left_passengers": F.coalesce("left_passengers", F.lit(0.0)), "right_passengers": F.coalesce("right_passengers", F.lit(0.0))})
    return j.select(*key, "left_passengers", "right_passengers", (F.col("right_passengers") - F.col("left_passengers")).alias("difference"), F.try_divide("right_passengers", F.nullif("left_passengers", F.lit(0.0))).alias("ratio"), side.alias("side"))


def wide(od: DataFrame, hours: range = range(24)) -> DataFrame:
    """One column of passengers per hour."""
    p = od.groupBy("date", "origin_stop_id", "destination_stop_id").pivot("hour", list(hours)).agg(F.sum("passengers"))
    return p.withColumnsRenamed({str(h): f"passengers_{h:02d}" for h in hours})


def long(table: DataFrame, prefix: str = "passengers_") -> DataFrame:
    """The hour columns as rows; only positive values stay."""
    values = [c for c in table.columns if c.startswith(prefix)]
    ids = [c for c in table.columns if not c.startswith(prefix)]
    return table.unpivot(ids, values, "__h", "passengers").filter("passengers > 0").select(*ids, F.right("__h", F.lit(2)).cast("int").alias("hour"), "passengers")
