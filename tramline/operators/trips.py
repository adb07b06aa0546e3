"""Trips from smart-card legs: chains of a card's legs folded to one row, with the reason where one is dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.clean import clean_id, clean_route, readable_time, service_day, trimmed

CHAIN = ["service_date", "card_id", "transfer_id"]


def clean_legs(legs: DataFrame, together: bool = False) -> DataFrame:
    """Typed legs, each once: of rows delivered again the latest holds; together brings a chain's legs to one task at once, for what follows."""
    rows = legs.select(
        service_day("service_date", "ride_dtm").alias("service_date"), clean_id("card_id").alias("card_id"), clean_id("transfer_id").alias("transfer_id"), trimmed("serial_num").alias("serial_num"),
        clean_id("mode_code").alias("mode_code"), clean_route("route_id").alias("route_id"), clean_id("origin_stop_id").alias("origin"), clean_id("destination_stop_id").alias("destination"),
        readable_time("ride_dtm").alias("ride"), readable_time("alight_dtm").alias("alight"), F.coalesce(F.nanvl("passengers", F.lit(0.0)), F.lit(0.0)).alias("passengers"), "loaded_at",
    )
    rows = rows.repartition(*CHAIN) if together else rows
    latest = [F.col("loaded_at").desc_nulls_last(), *(F.col(c).asc_nulls_last() for c in ("alight", "route_id", "origin", "destination", "mode_code", "passengers"))]
    rank = F.row_number().over(Window.partitionBy(*CHAIN, "ride", "serial_num").orderBy(*latest))
    # One condition over the rank: apart from it, those on the keys would be computed again below the shuffle.
    whole = F.col("service_date").isNotNull() & F.col("card_id").isNotNull() & F.col("transfer_id").isNotNull()
    return rows.withColumn("__rank", rank).filter(F.when(whole, F.col("__rank")) == 1).drop("__rank")


def minutes(start: Column, end: Column) -> Column:
    """Minutes between two YYYYMMDDHHMMSS texts."""
    t = lambda c: F.unix_timestamp(c, "yyyyMMddHHmmss")
    return (t(end) - t(start)) / 60.0


def chains(legs: DataFrame, stops: DataFrame, longest: float = 180.0) -> DataFrame:
    """One row per chain, drop_reason null for kept trips; stops: stop_id of the model's stops.

    Legs order by ride time and serial number as text. A chain has at most one leg per second and serial number of a day, which bounds its array.
    """
    leg = F.struct("ride", "serial_num", "origin", "destination", "route_id", "mode_code", "alight")
    c = legs.groupBy(*CHAIN).agg(
        F.array_sort(F.collect_list(leg)).alias("l"), F.min("ride").alias("first_ride"), F.max("alight").alias("last_alight"), F.max("passengers").alias("passengers"),
        F.min("passengers").alias("least"), F.bool_and(F.col("route_id").isNotNull()).alias("all_bus"), F.count(F.lit(1)).alias("legs"), F.count("ride").alias("rides"),
    )
    arr = F.col("l")
    last = F.element_at(arr, -1)
    c = c.withColumns({"origin": arr[0]["origin"], "destination": last["destination"], "final_alight": last["alight"], "duration": minutes(F.col("first_ride"), last["alight"])})
    pairs = F.transform(F.slice(arr, 2, F.greatest(F.size(arr) - 1, F.lit(0))), lambda x, i: F.struct(F.get(arr, i).alias("a"), x.alias("b")))
    c = c.withColumns(
        {
            "route_chain": F.array_join(F.transform(arr, lambda x: F.coalesce(x["route_id"], F.lit("RAIL/OTHER"))), ">"),
            "mode_chain": F.array_join(F.transform(arr, lambda x: F.coalesce(x["mode_code"], F.lit("?"))), ">"),
            "transfer_stop_chain": F.array_join(F.transform(pairs, lambda p: F.concat(F.coalesce(p["a"]["destination"], F.lit("?")), F.lit(">"), F.coalesce(p["b"]["origin"], F.lit("?")))), ";"),
            "temporal_order_ok": ~F.exists(pairs, lambda p: F.coalesce(p["a"]["alight"] > p["b"]["ride"], F.lit(False))),
        }
    )
    known = stops.select(F.col("stop_id").alias("__stop")).distinct()
    for end in ("origin", "destination"):
        mark = known.select(F.col("__stop").alias(f"__{end}"), F.lit(True).alias(f"{end}_mapped"))
        c = c.join(mark, F.col(end) == F.col(f"__{end}"), "left").drop(f"__{end}")
    reason = (
        F.when(F.col("rides") < F.col("legs"), "bad_ride_time")
        .when(F.col("final_alight").isNull(), "missing_alight")
        .when((F.col("duration") < -1e-6) | (F.col("duration") > longest), "bad_duration")
        .when(F.col("origin").isNull() | F.col("destination").isNull() | (F.col("origin") == F.col("destination")), "bad_od")
        .when(~F.col("all_bus"), "mixed_or_rail")
        .when(F.col("passengers") <= 0, "no_passengers")
        .when(F.col("origin_mapped").isNull() | F.col("destination_mapped").isNull(), "unmapped_od")
    )
    c = c.withColumn("drop_reason", reason)
    name = F.substring(F.sha2(F.concat_ws("|", *CHAIN, "first_ride"), 256), 1, 24)
    return c.select(
        name.alias("trip_hash"), *CHAIN, F.substring("first_ride", 9, 2).cast("int").alias("hour"), "origin", "destination", "passengers", F.col("legs").cast("int").alias("legs"), (F.col("legs") - 1).cast("int").alias("transfers"), "route_chain", "mode_chain",
        "transfer_stop_chain", "first_ride", F.col("final_alight").alias("last_alight"), F.round("duration", 4).alias("duration_minutes"), F.col("all_bus").cast("int").alias("all_bus"), (F.col("least") == F.col("passengers")).cast("int").alias("passenger_count_consistent"), F.col("temporal_order_ok").cast("int").alias("temporal_order_ok"), "drop_reason",
    )


def kept(trips: DataFrame) -> DataFrame:
    return trips.filter("drop_reason is null").drop("drop_reason")
