"""A few keys holding most records: per-key results without waiting for those keys.

Each task folds its rows into a hash table of key states (count, sum); Spark bounds that
table by its execution memory and spills it sorted. Only these compact states shuffle, so
a key with a third of all rows sends one state per task like any other key.

Defined cases: rows without an id form one group with a null key; null, NaN and
boundless measures count as rows but add nothing; repeated rows all count; an empty table gives no rows;
other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.session import checkpointed


def key_totals(df: DataFrame, name: str, key: Column, measure: Column) -> DataFrame:
    """table_name, key_value, n_rows, total per key; partial states are combined before the shuffle."""
    value = F.when(~F.isnan(measure), measure)
    rows = df.select(key.alias("key_value"), value.try_cast("decimal(28,6)").alias("_m"))
    states = rows.groupBy("key_value").agg(F.count(F.lit(1)).alias("n_rows"), F.try_sum("_m").cast("double").alias("total"))
    return states.select(F.lit(name).alias("table_name"), "key_value", "n_rows", "total")


def heavy_keys(totals: list[DataFrame], share: float) -> DataFrame:
    """Keys with at least that share of all rows of their table; the rows without an id count in the whole."""
    # A row per distinct key: kept, so that the tables are read once for their keys and their size.
    keys = checkpointed(reduce(DataFrame.unionByName, totals))
    # One row per table: bounded by the length of the list.
    whole = keys.groupBy("table_name").agg(F.sum("n_rows").alias("_all"))
    held = keys.join(F.broadcast(whole), "table_name")
    return held.filter(F.col("key_value").isNotNull() & (F.col("n_rows") >= share * F.col("_all"))).drop("_all")
