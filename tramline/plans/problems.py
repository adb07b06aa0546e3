"""Queries of the general data problems: p1 rejects, p3 hot keys, p4 drift, p5 orphans, p6 intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.clean import clean_id, clean_route, readable_time, service_day
from tramline.operators import drift, hotkeys, intervals, rejects
from tramline.operators.orphans import OrphanState, parent_events
from tramline.session import checkpointed, dealt, sent, small, table

HEAVY_SHARE = 0.02


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.rejected(rejects.parse_lines(dealt(table(spark, sf, "raw_lines"), "line_id"))).select("line_id")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    bad = rejects.rejected(rejects.parse_lines(dealt(table(spark, sf, "raw_lines"), "line_id")))
    return bad.groupBy("feed", "reason", "field").agg(F.count(F.lit(1)).alias("n_lines"))


def p1_legs(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.loaded(rejects.parse_lines(dealt(table(spark, sf, "raw_lines"), "line_id")), rejects.LEGS)


def p1_daily_od(spark: SparkSession, sf: str) -> DataFrame:
    return rejects.loaded(rejects.parse_lines(dealt(table(spark, sf, "raw_lines"), "line_id")), rejects.DAILY_OD)


def _totals(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [
        hotkeys.key_totals(table(spark, sf, "legs"), "legs", clean_route("route_id"), F.col("passengers")),
        hotkeys.key_totals(table(spark, sf, "daily_od"), "daily_od", clean_id("origin_stop_id"), F.col("passengers")),
    ]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return hotkeys.heavy_keys(_totals(spark, sf), HEAVY_SHARE).select("table_name", "key_value")


def p3_totals(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _totals(spark, sf)
    return a.unionByName(b)


def _schemas(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    records, aliases = dealt(table(spark, sf, "leg_files"), "record_id"), drift.alias_table(table(spark, sf, "field_aliases"))
    return records, drift.file_schemas(records, aliases), aliases


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_changes(spark, sf).select("file_name", "field_name", "change_kind")


def p4_changes(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(checkpointed(_schemas(spark, sf)[1]))


def p4_legs(spark: SparkSession, sf: str) -> DataFrame:
    """All fields of legs and all other canonical ones as columns; what the columns do not hold is in rest."""
    records, schemas, aliases = _schemas(spark, sf)
    schemas = checkpointed(schemas)
    return drift.unified(records, schemas, drift.union_schema(schemas, drift.columns(schemas, aliases, list(rejects.LEGS.fields))))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """References (trip_hash, field_name, key, day, loaded_on) after the one replacement by the id map; parent events."""
    stops = table(spark, sf, "stops").select(clean_id("stop_id").alias("stop"), clean_id("registered_on").alias("a"), clean_id("retired_on").alias("z"))
    ids = table(spark, sf, "stop_id_map").select(clean_id("card_stop_id").alias("card"), clean_id("model_stop_id").alias("model"))
    ids = ids.filter("card is not null and model is not null").groupBy("card").agg(F.min("model").alias("model"))
    ids = ids.join(stops.select(F.col("stop").alias("card")).distinct(), "card", "left_anti")
    trips = dealt(table(spark, sf, "purpose_trips"), "trip_hash").select(F.col("trip_hash"), F.col("service_date").alias("day"), F.to_date("loaded_at").alias("loaded_on"), clean_id("origin_stop_id").alias("o"), clean_id("destination_stop_id").alias("d"))
    refs = trips.select("trip_hash", "day", "loaded_on", F.explode(F.array(F.struct(F.lit("origin_stop_id").alias("field_name"), F.col("o").alias("ref")), F.struct(F.lit("destination_stop_id").alias("field_name"), F.col("d").alias("ref")))).alias("r"))
    refs = refs.select("trip_hash", "day", "loaded_on", "r.*").filter("ref is not null")
    refs = refs.join(F.broadcast(ids) if small(ids) else ids, F.col("ref") == F.col("card"), "left").withColumn("key", F.coalesce("model", "ref"))
    return refs.select("trip_hash", "field_name", "key", "day", "loaded_on"), parent_events(stops, F.col("stop"), F.col("a"), F.col("z"))


def _orphan_state(refs: DataFrame, events: DataFrame, each=lambda state, until: None) -> OrphanState:
    """A batch for every month in which references were loaded; parent events come with the month from which they hold, the last batch has the rest.

    refs (field_name, key, day, loaded_on) are counted once; references without a time of loading come first.
    each is called after every batch with the state and the last day of loading among the references so far.
    """
    month = F.trunc("loaded_on", "month").alias("month")
    counted = checkpointed(refs.groupBy("field_name", "key", "day", month).agg(F.count(F.lit(1)).alias("n"), F.max("loaded_on").alias("last")))
    # One row per month.
    months = counted.groupBy("month").agg(F.max("last").alias("last")).orderBy(F.col("month").asc_nulls_first()).collect() or [None]
    state, since = OrphanState(refs.sparkSession), ""
    for k, m in enumerate(months):
        batch = counted.filter(F.col("month").eqNullSafe(F.lit(m.month).cast("date"))) if m else counted
        until = f"{months[k + 1].month:%Y%m%d}" if k + 1 < len(months) else None
        e = events.filter(F.col("from_day") >= since)
        state.advance(batch.select("field_name", "key", "day", "n"), e if until is None else e.filter(F.col("from_day") < until))
        since = until
        each(state, m and m.last)
    return state


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    refs, events = _references(spark, sf)
    waiting = sent(_orphan_state(refs, events).pending().select("field_name", "key", "day"), 96)
    return refs.join(waiting, ["field_name", "key", "day"], "left_semi").select("trip_hash", "field_name").distinct()


def p5_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """References and orphans by field and service date, as the last snapshot has them."""
    refs, events = _references(spark, sf)
    return _orphan_state(refs, events).snapshot().withColumnRenamed("day", "service_date")


def p5_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """References and orphans by field and day after every batch; loaded_until is the last day of loading so far."""
    refs, events = _references(spark, sf)
    taken: list[DataFrame] = []
    _orphan_state(refs, events, lambda state, until: taken.append(state.snapshot().select(F.lit(until).cast("date").alias("loaded_until"), "field_name", F.col("day").alias("service_date"), "n_refs", "n_orphans")))
    return reduce(DataFrame.unionByName, taken)


def _rides(spark: SparkSession, sf: str) -> DataFrame:
    """Times as the numbers that their 14 digits are: these order alike and fold in hash tables, as text does not."""
    legs = dealt(table(spark, sf, "legs"), "card_id", "ride_dtm")
    return legs.select(clean_id("card_id").alias("card_id"), service_day("service_date", "ride_dtm").alias("service_date"), readable_time("ride_dtm").cast("long").alias("ride"), readable_time("alight_dtm").cast("long").alias("alight"))


def _as_text(df: DataFrame, *times: str) -> DataFrame:
    return df.select("card_id", "service_date", *(F.lpad(F.col(t).cast("string"), 14, "0").alias(t) for t in times))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _as_text(intervals.gaps(_rides(spark, sf), ["card_id", "service_date"], "ride", "alight"), "gap_start", "gap_end")


def p6_periods(spark: SparkSession, sf: str) -> DataFrame:
    return _as_text(intervals.periods(_rides(spark, sf), ["card_id", "service_date"], "ride", "alight"), "period_start", "period_end")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_reasons, p1_legs, p1_daily_od, p3_found, p3_totals, p4_found, p4_changes, p4_legs, p5_found, p5_by_day, p5_snapshots, p6_found, p6_periods)}
