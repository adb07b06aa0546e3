"""Overlapping and gapped time intervals: continuous periods and the gaps between them.

Starts and ends are ranked independently per entity. A gap lies where the next-ranked
start exceeds the current-ranked end; boundaries that face a gap pair up to periods.

Of intervals with the same entity and start only the longest matters, so a map-side
combined max(end) comes first: it bounds an entity by its distinct starts and thins hot
entities before any of their rows meet in one task. Where an entity may still have too many
starts, span cuts its time: boundaries are ranked within stretches of that length, and each
stretch begins where those before it end.

Defined cases: intervals with a null entity part, start or end, or that do not end after
their start, take no part; touching intervals (start = end) are one period; ties and
repeated rows change nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, entity: list[str], start: str, end: str, span: int | None) -> DataFrame:
    """entity, side (0 start, 1 end), t, rank of each boundary among those of its side; span: numeric times only."""
    keep = df.select(*entity, F.col(start).alias("_s"), F.col(end).alias("_e"))
    # One condition over the aggregate's result: below it, costly expressions for start and end would be computed again for the filter.
    whole = F.col("_e") > F.col("_s")
    for c in entity:
        whole = whole & F.col(c).isNotNull()
    longest = keep.groupBy(*entity, "_s").agg(F.max("_e").alias("_e")).filter(F.coalesce(whole, F.lit(False)))
    spread = longest if span else longest.repartition(*entity)
    ends = spread.select(*entity, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_s").alias("t")), F.struct(F.lit(1).alias("side"), F.col("_e").alias("t")))).alias("b"))
    ends = ends.select(*entity, "b.side", "b.t")
    if span is None:
        return ends.withColumn("rank", F.row_number().over(Window.partitionBy(*entity, "side").orderBy("t")))
    by = [*entity, "side", "_stretch"]
    ends = ends.withColumn("_stretch", F.floor(F.col("t") / span))
    sizes = ends.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*entity, "side").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, 0))
    before = sizes.select(*by, (upto - F.col("_n")).alias("_before"))
    return ends.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("t"))).join(before, by).withColumn("rank", F.col("rank") + F.col("_before")).drop("_stretch", "_before")


def gaps(df: DataFrame, entity: list[str], start: str, end: str, span: int | None = None) -> DataFrame:
    """entity, gap_start, gap_end: start of rank k+1 against end of rank k."""
    r = _ranked(df, entity, start, end, span)
    slot = F.col("rank") - F.when(F.col("side") == 0, 1).otherwise(0)
    pairs = r.withColumn("slot", slot).groupBy(*entity, "slot").agg(F.max(F.when(F.col("side") == 1, F.col("t"))).alias("gap_start"), F.max(F.when(F.col("side") == 0, F.col("t"))).alias("gap_end"))
    return pairs.filter(F.col("gap_end") > F.col("gap_start")).drop("slot")


def periods(df: DataFrame, entity: list[str], start: str, end: str, span: int | None = None) -> DataFrame:
    """entity, period_start, period_end: each start that follows a gap with the next end that precedes one."""
    r = _ranked(df, entity, start, end, span)
    slot = F.col("rank") - F.when(F.col("side") == 0, 1).otherwise(0)
    pairs = r.withColumn("slot", slot).groupBy(*entity, "slot").agg(F.max(F.when(F.col("side") == 1, F.col("t"))).alias("e"), F.max(F.when(F.col("side") == 0, F.col("t"))).alias("s"))
    # Slot 0 has only the first start, the last slot only the last end; the slots in between are gaps or not.
    cuts = pairs.filter(F.col("e").isNull() | F.col("s").isNull() | (F.col("s") > F.col("e")))
    nxt = F.lead("e").over(Window.partitionBy(*entity).orderBy("slot"))
    return cuts.select(*entity, F.col("s").alias("period_start"), nxt.alias("period_end")).filter(F.col("period_start").isNotNull())
