"""Numbers, truth values, units and calendars from text and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE = ("true", "1", "yes", "y", "t", "예")


def to_float(c: Column) -> Column:
    """A finite number from text with thousands commas, else null."""
    v = F.translate(F.trim(c.cast("string")), ",", "").try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def to_bool(c: Column) -> Column:
    """True for the usual words, false for all else and for null."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def as_minutes(df: DataFrame, value: str, out: str, longest: float = 15.0) -> DataFrame:
    """value as minutes: seconds if its median (to a tenth) is beyond what minutes would be."""
    median = df.agg(F.percentile(F.round(value, 1), F.lit(0.5)).alias("__median"))
    # One row.
    return df.join(F.broadcast(median)).withColumn(out, F.when(F.col("__median") > longest, F.col(value) / 60).otherwise(F.col(value))).drop("__median")


def calendar(df: DataFrame, date: str, weekdays: tuple[int, ...]) -> DataFrame:
    """date (text) of every day of those weekdays (Monday 0) between a table's first and last date, one row each."""
    d = F.to_date(F.col(date), "yyyyMMdd")
    span = df.agg(F.min(d).alias("a"), F.max(d).alias("z")).filter("a is not null")
    days = span.select(F.explode(F.sequence("a", "z")).alias("d")).filter(F.weekday("d").isin(*weekdays))
    return days.select(F.date_format("d", "yyyyMMdd").alias("date"))
