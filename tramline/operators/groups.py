"""Group values beside the rows of their group, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    """df with aggregates over the groups of keys; null keys are groups of their own.

    The aggregate combines map-side; the join back may split a hot group over tasks, which a window could not.
    """
    per = df.groupBy(*keys).agg(*(a.alias(n) for n, a in aggregates.items()))
    per = per.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(per, on).drop(*(f"__{k}" for k in keys))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in a complete order (dedupe, keep first)."""
    return top(df, keys, order, 1, "__rank").drop("__rank")


def unique(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df, failing at run time if a key occurs twice (the right side of a many-to-one join)."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    checked = n.select(*keys, F.assert_true(F.col("__n") == 1, F.lit(f"{name}: key occurs more than once")).alias("__ok")).filter("__ok is null").drop("__ok")
    return df.join(checked, keys, "left_semi")
