"""Queries of legs, trips and origin-destination matrices, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import values
from tramline.functions.clean import clean_id, clean_route, readable_time, service_day
from tramline.operators import matrix, trips
from tramline.operators.groups import first_per
from tramline.plans import oracle
from tramline.session import checkpointed, dealt, once, table, written


def _legs(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "legs"), "card_id", "ride_dtm")


def clean_stops(spark: SparkSession, sf: str) -> DataFrame:
    """One row per clean stop id, the latest registered; coordinates outside the region are no coordinates."""
    s = table(spark, sf, "stops").withColumn("stop_id", clean_id("stop_id")).filter("stop_id is not null")
    order = [F.coalesce("registered_on", F.lit("")).desc(), *(F.col(c).asc_nulls_last() for c in ("stop_name", "stop_type", "stop_number", "latitude", "longitude"))]
    good = F.col("latitude").between(33.0, 43.0) & F.col("longitude").between(124.0, 132.0)
    return first_per(s, ["stop_id"], order).select("stop_id", "stop_name", "stop_type", "stop_number", F.when(good, F.col("latitude")).alias("latitude"), F.when(good, F.col("longitude")).alias("longitude"))


def clean_routes(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "routes").withColumn("route_id", clean_route("route_id")).filter("route_id is not null")
    return first_per(r, ["route_id"], [F.col(c).asc_nulls_last() for c in ("route_name", "route_type", "route_distance")]).select("route_id", "route_name", "route_type", "route_distance")


def time_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Per service day the rows, and how many of their times can be read."""
    legs = table(spark, sf, "legs").select(service_day("service_date", "ride_dtm").alias("service_date"), readable_time("ride_dtm").alias("r"), readable_time("alight_dtm").alias("a"))
    return legs.groupBy("service_date").agg(F.count(F.lit(1)).alias("n_rows"), F.count("r").alias("ride_ok"), F.count("a").alias("alight_ok"))


def _mapped_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Clean legs, card readers' stop numbers replaced where the map has them (identity otherwise)."""
    legs = trips.clean_legs(_legs(spark, sf), together=True)
    ids = table(spark, sf, "stop_id_map").select(clean_id("card_stop_id").alias("card"), clean_id("model_stop_id").alias("model")).filter("card is not null and model is not null").groupBy("card").agg(F.min("model").alias("model"))
    for end in ("origin", "destination"):
        m = ids.select(F.col("card").alias("__c"), F.col("model").alias("__m"))
        legs = legs.join(m, F.col(end) == F.col("__c"), "left").withColumn(end, F.coalesce("__m", end)).drop("__c", "__m")
    return legs


def _trips(spark: SparkSession, sf: str) -> DataFrame:
    """Derived once a session: seven queries begin with it."""
    return once(spark, "trips", [f"{sf}/{t}.parquet" for t in ("legs", "stops", "stop_id_map")], lambda: written(trips.chains(_mapped_legs(spark, sf), clean_stops(spark, sf))))


def trip_chains(spark: SparkSession, sf: str) -> DataFrame:
    return trips.kept(_trips(spark, sf))


def trip_drop_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _trips(spark, sf).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("chains"), F.sum("legs").alias("legs"))


def trip_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Kept trips per day and hour: trips, passengers, mean legs, share with transfer."""
    t = trips.kept(_trips(spark, sf))
    return t.groupBy("service_date", "hour").agg(F.count_distinct("trip_hash").alias("trips"), F.sum("passengers").alias("passengers"), F.round(F.avg("legs"), 6).alias("mean_legs"), F.round(F.avg((F.col("transfers") > 0).cast("int")), 6).alias("transfer_share"))


def _purpose_od(spark: SparkSession, sf: str) -> DataFrame:
    t = trips.kept(_trips(spark, sf))
    return matrix.hourly(t.select(F.col("service_date").alias("date"), "hour", F.col("origin").alias("origin_stop_id"), F.col("destination").alias("destination_stop_id"), "passengers"))


def purpose_od_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return _purpose_od(spark, sf)


def _od(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.hourly(matrix.clean_od(table(spark, sf, "daily_od")))


def od_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return _od(spark, sf)


def _days(od: DataFrame) -> int:
    return od.agg(F.count_distinct("date")).first()[0]


def _rounded(b: DataFrame) -> DataFrame:
    return b.withColumns({"avg": F.round("avg", 6), "std": F.round("std", 6)})


def od_baseline_zero_inclusive(spark: SparkSession, sf: str) -> DataFrame:
    od = checkpointed(_od(spark, sf))
    return _rounded(matrix.baseline_zero_inclusive(od, _days(od)))


def od_baseline_positive_days(spark: SparkSession, sf: str) -> DataFrame:
    od = checkpointed(_od(spark, sf))
    return _rounded(matrix.baseline_positive_days(od, _days(od)))


def od_compare_hours(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.compared(_od(spark, sf), _purpose_od(spark, sf), ["date", "hour"]).withColumn("ratio", F.round("ratio", 6))


def od_compare_cells(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.compared(_od(spark, sf), _purpose_od(spark, sf), ["date", *matrix.CELL]).withColumn("ratio", F.round("ratio", 6))


def join_qa(spark: SparkSession, sf: str) -> DataFrame:
    """How many cells are on both sides or on one, per date."""
    return od_compare_cells(spark, sf).groupBy("date", "side").agg(F.count(F.lit(1)).alias("cells"), F.sum("left_passengers").alias("left_passengers"), F.sum("right_passengers").alias("right_passengers"))


def od_in_network(spark: SparkSession, sf: str) -> DataFrame:
    """Cells both of whose stops are in the network's edges."""
    tokens = table(spark, sf, "candidate_pool").select(F.explode(F.split("segment_keys", ";")).alias("t")).distinct()
    ends = tokens.select(F.explode(F.array(F.split_part("t", F.lit("|"), F.lit(2)), F.split_part("t", F.lit("|"), F.lit(3)))).alias("stop")).distinct()
    od = _od(spark, sf)
    return od.join(ends.withColumnRenamed("stop", "origin_stop_id"), "origin_stop_id", "left_semi").join(ends.withColumnRenamed("stop", "destination_stop_id"), "destination_stop_id", "left_semi").select("date", *matrix.CELL, "passengers")


def stops_used(spark: SparkSession, sf: str) -> DataFrame:
    """Stops that a cell of the matrix names."""
    od = _od(spark, sf)
    used = od.select(F.col("origin_stop_id").alias("stop_id")).union(od.select("destination_stop_id")).distinct()
    return clean_stops(spark, sf).join(used, "stop_id", "left_semi")


def date_sets(spark: SparkSession, sf: str) -> DataFrame:
    """Dates that matrix and trips share, and those of only one of them."""
    a = table(spark, sf, "daily_od").select(clean_id("date").alias("date")).filter("date is not null").distinct()
    b = trips.clean_legs(_legs(spark, sf)).select(F.col("service_date").alias("date")).distinct()
    both, only_a, only_b = a.intersect(b), a.subtract(b), b.subtract(a)
    return both.withColumn("side", F.lit("both")).unionByName(only_a.withColumn("side", F.lit("matrix_only"))).unionByName(only_b.withColumn("side", F.lit("legs_only")))


def od_wide(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.wide(_od(spark, sf))


def od_long(spark: SparkSession, sf: str) -> DataFrame:
    """Wide and back: the matrix itself."""
    return matrix.long(matrix.wide(_od(spark, sf)))


def route_loads(spark: SparkSession, sf: str) -> DataFrame:
    """Legs and passengers per route and hour beside the route's master row; unknown routes stay with null master fields."""
    legs = trips.clean_legs(_legs(spark, sf)).filter("ride is not null and route_id is not null")
    n = legs.groupBy("route_id", F.substring("ride", 9, 2).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("legs"), F.sum("passengers").alias("passengers"))
    per_leg = F.round(F.try_divide("passengers", F.nullif(F.col("legs"), F.lit(0))), 6)
    return n.join(clean_routes(spark, sf).select("route_id", "route_name", "route_type"), "route_id", "left").withColumn("passengers_per_leg", per_leg)


def duplicate_deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of legs whose key was delivered more than once, by service day."""
    key = ["service_date", "card_id", "transfer_id", "ride", "serial_num"]
    rows = table(spark, sf, "legs").select(service_day("service_date", "ride_dtm").alias("service_date"), clean_id("card_id").alias("card_id"), clean_id("transfer_id").alias("transfer_id"), readable_time("ride_dtm").alias("ride"), F.btrim("serial_num", F.lit(" \t")).alias("serial_num"))
    n = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("service_date").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("duplicated"))


def target_days(spark: SparkSession, sf: str) -> DataFrame:
    """Tuesdays to Thursdays in the trips' period with trips and passengers, 0 where there are none."""
    t = table(spark, sf, "purpose_trips")
    n = t.groupBy(F.col("service_date").alias("date")).agg(F.count_distinct("trip_hash").alias("trips"), F.sum("passengers").alias("passengers"))
    return values.calendar(t, "service_date", (1, 2, 3)).join(n, "date", "left").na.fill(0, ["trips", "passengers"])


def trip_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """Mean riding time by hour after the unit is inferred from the median, and passengers per leg."""
    t = values.as_minutes(table(spark, sf, "purpose_trips").filter("duration_minutes is not null"), "duration_minutes", "m")
    return t.groupBy("hour").agg(F.round(F.avg("m"), 6).alias("mean_minutes"), F.round(values.ratio(F.sum("passengers"), F.sum("legs")), 6).alias("passengers_per_leg"))


_NAMES = (
    target_days, trip_minutes, clean_stops, clean_routes, time_quality, trip_chains, trip_drop_reasons, trip_summary, purpose_od_hourly, od_hourly, od_baseline_zero_inclusive, od_baseline_positive_days, od_compare_hours,
    od_compare_cells, join_qa, od_in_network, stops_used, date_sets, od_wide, od_long, route_loads, duplicate_deliveries,
)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


_ID, _RT = oracle.clean_id, oracle.clean_route
_RIDE, _ALIGHT, _DAY = oracle.readable("ride_dtm"), oracle.readable("alight_dtm"), oracle.service_day("service_date", "ride_dtm")
_LEGS = f"""raw AS (SELECT {_DAY} AS service_date, {_ID('card_id')} AS card_id, {_ID('transfer_id')} AS transfer_id, trim(serial_num, ' \t') AS serial_num, {_ID('mode_code')} AS mode_code, {_RT('route_id')} AS route_id,
 {_ID('origin_stop_id')} AS origin, {_ID('destination_stop_id')} AS destination, {_RIDE} AS ride, {_ALIGHT} AS alight, CASE WHEN passengers IS NULL OR isnan(passengers) THEN 0 ELSE passengers END AS passengers, loaded_at FROM legs),
cl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY service_date,card_id,transfer_id,ride,serial_num ORDER BY loaded_at DESC NULLS LAST, alight NULLS LAST, route_id NULLS LAST, origin NULLS LAST, destination NULLS LAST, mode_code NULLS LAST, passengers NULLS LAST) AS k FROM raw
 WHERE service_date IS NOT NULL AND card_id IS NOT NULL AND transfer_id IS NOT NULL) WHERE k=1)"""
_STOPS = f"""st AS (SELECT stop_id, stop_name, stop_type, stop_number, CASE WHEN g THEN latitude END AS latitude, CASE WHEN g THEN longitude END AS longitude FROM (SELECT {_ID('stop_id')} AS stop_id, stop_name, stop_type, stop_number, latitude, longitude,
 latitude BETWEEN 33 AND 43 AND longitude BETWEEN 124 AND 132 AS g, row_number() OVER (PARTITION BY {_ID('stop_id')} ORDER BY coalesce(registered_on,'') DESC, stop_name NULLS LAST, stop_type NULLS LAST, stop_number NULLS LAST, latitude NULLS LAST, longitude NULLS LAST) AS k FROM stops) WHERE k=1 AND stop_id IS NOT NULL)"""
_TRIPS = f"""{_LEGS}, {_STOPS}, im AS (SELECT {_ID('card_stop_id')} AS card, min({_ID('model_stop_id')}) AS model FROM stop_id_map WHERE {_ID('model_stop_id')} IS NOT NULL GROUP BY 1),
ml AS (SELECT cl.* REPLACE (coalesce(a.model, origin) AS origin, coalesce(b.model, destination) AS destination) FROM cl LEFT JOIN im a ON a.card=origin LEFT JOIN im b ON b.card=destination),
lp AS (SELECT *, lag(destination) OVER w AS pd, lag(alight) OVER w AS pa, row_number() OVER w AS i FROM ml WINDOW w AS (PARTITION BY service_date,card_id,transfer_id ORDER BY ride NULLS FIRST, serial_num NULLS FIRST)),
ch AS (SELECT service_date, card_id, transfer_id, count(*) AS legs, count(ride) AS rides, min(ride) AS first_ride, max(passengers) AS passengers, min(passengers) AS least, bool_and(route_id IS NOT NULL) AS all_bus,
 arg_min_null(origin, i) AS origin, arg_max_null(destination, i) AS destination, arg_max_null(alight, i) AS last_alight, string_agg(coalesce(route_id,'RAIL/OTHER'),'>' ORDER BY i) AS route_chain, string_agg(coalesce(mode_code,'?'),'>' ORDER BY i) AS mode_chain,
 coalesce(string_agg(coalesce(pd,'?')||'>'||coalesce(origin,'?'),';' ORDER BY i) FILTER (i>1),'') AS transfer_stop_chain, NOT coalesce(bool_or(pa>ride) FILTER (i>1), false) AS temporal_order_ok FROM lp GROUP BY 1,2,3),
dr AS (SELECT *, (epoch(strptime(last_alight,'%Y%m%d%H%M%S'))-epoch(strptime(first_ride,'%Y%m%d%H%M%S')))/60.0 AS duration FROM ch),
tr AS (SELECT *, CASE WHEN rides<legs THEN 'bad_ride_time' WHEN last_alight IS NULL THEN 'missing_alight' WHEN duration<-1e-6 OR duration>180 THEN 'bad_duration' WHEN origin IS NULL OR destination IS NULL OR origin=destination THEN 'bad_od'
 WHEN NOT all_bus THEN 'mixed_or_rail' WHEN passengers<=0 THEN 'no_passengers' WHEN origin NOT IN (SELECT stop_id FROM st) OR destination NOT IN (SELECT stop_id FROM st) THEN 'unmapped_od' END AS drop_reason FROM dr),
kt AS (SELECT *, left(sha256(concat_ws('|',service_date,card_id,transfer_id,first_ride)),24) AS trip_hash, CAST(substr(first_ride,9,2) AS INT) AS hour FROM tr WHERE drop_reason IS NULL),
po AS (SELECT service_date AS date, hour, origin AS origin_stop_id, destination AS destination_stop_id, sum(passengers) AS passengers FROM kt GROUP BY ALL)"""
_OD = f"""ro AS (SELECT {_ID('date')} AS date, hour, {_ID('origin_stop_id')} AS origin_stop_id, {_ID('destination_stop_id')} AS destination_stop_id, source_label, CASE WHEN NOT isnan(passengers) THEN passengers END AS passengers, loaded_at FROM daily_od),
lo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date,hour,origin_stop_id,destination_stop_id,source_label ORDER BY loaded_at DESC NULLS LAST, passengers DESC NULLS LAST) AS k FROM ro
 WHERE regexp_full_match(origin_stop_id,'[0-9]{{9}}') AND regexp_full_match(destination_stop_id,'[0-9]{{9}}') AND origin_stop_id<>destination_stop_id AND hour BETWEEN 0 AND 23 AND date IS NOT NULL) WHERE k=1 AND passengers>0),
od AS (SELECT date, hour, origin_stop_id, destination_stop_id, sum(passengers) AS passengers FROM lo GROUP BY ALL)"""
_CELL = "hour, origin_stop_id, destination_stop_id"
_NDAYS = "nd AS (SELECT count(DISTINCT date) AS n FROM od)"


def _compare(key: str) -> str:
    k = [x.strip() for x in key.split(",")]
    on = " AND ".join(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in k)
    cols = ", ".join(f"coalesce(a.{x},b.{x}) AS {x}" for x in k)
    return f"""cmp AS (SELECT {cols}, coalesce(a.p,0) AS left_passengers, coalesce(b.p,0) AS right_passengers, coalesce(b.p,0)-coalesce(a.p,0) AS difference, round(coalesce(b.p,0)/nullif(coalesce(a.p,0),0),6) AS ratio,
    CASE WHEN a.p IS NULL THEN 'right_only' WHEN b.p IS NULL THEN 'left_only' ELSE 'both' END AS side FROM (SELECT {key}, sum(passengers) AS p FROM od GROUP BY ALL) a FULL JOIN (SELECT {key}, sum(passengers) AS p FROM po GROUP BY ALL) b ON {on})"""


_HOURS = range(24)
SQL = {
    "target_days": "WITH d AS (SELECT strftime(unnest(generate_series(min(strptime(service_date,'%Y%m%d')), max(strptime(service_date,'%Y%m%d')), INTERVAL 1 DAY)),'%Y%m%d') AS date FROM purpose_trips), n AS (SELECT service_date AS date, count(DISTINCT trip_hash) AS trips, sum(passengers) AS passengers FROM purpose_trips GROUP BY 1) SELECT date, coalesce(trips,0) AS trips, coalesce(passengers,0) AS passengers FROM d LEFT JOIN n USING (date) WHERE dayofweek(strptime(date,'%Y%m%d')) BETWEEN 2 AND 4",
    "trip_minutes": "WITH m AS (SELECT quantile_cont(round(duration_minutes,1),0.5) AS md FROM purpose_trips) SELECT hour, round(avg(CASE WHEN md>15 THEN duration_minutes/60 ELSE duration_minutes END),6) AS mean_minutes, round(sum(passengers)/nullif(sum(legs),0),6) AS passengers_per_leg FROM purpose_trips, m WHERE duration_minutes IS NOT NULL GROUP BY hour",
    "clean_stops": f"WITH {_STOPS} SELECT * FROM st",
    "clean_routes": f"SELECT route_id, route_name, route_type, route_distance FROM (SELECT {_RT('route_id')} AS route_id, route_name, route_type, route_distance, row_number() OVER (PARTITION BY {_RT('route_id')} ORDER BY route_name NULLS LAST, route_type NULLS LAST, route_distance NULLS LAST) AS k FROM routes) WHERE k=1 AND route_id IS NOT NULL",
    "time_quality": f"SELECT {_DAY} AS service_date, count(*) AS n_rows, count({_RIDE}) AS ride_ok, count({_ALIGHT}) AS alight_ok FROM legs GROUP BY 1",
    "trip_chains": f"WITH {_TRIPS} SELECT trip_hash, service_date, card_id, transfer_id, hour, origin, destination, passengers, CAST(legs AS INT) AS legs, CAST(legs-1 AS INT) AS transfers, route_chain, mode_chain, transfer_stop_chain, first_ride, last_alight, round(duration,4) AS duration_minutes, CAST(all_bus AS INT) AS all_bus, CAST(least=passengers AS INT) AS passenger_count_consistent, CAST(temporal_order_ok AS INT) AS temporal_order_ok FROM kt",
    "trip_drop_reasons": f"WITH {_TRIPS} SELECT coalesce(drop_reason,'kept') AS reason, count(*) AS chains, CAST(sum(legs) AS BIGINT) AS legs FROM tr GROUP BY 1",
    "trip_summary": f"WITH {_TRIPS} SELECT service_date, hour, count(DISTINCT trip_hash) AS trips, sum(passengers) AS passengers, round(avg(legs),6) AS mean_legs, round(avg(CASE WHEN legs>1 THEN 1 ELSE 0 END),6) AS transfer_share FROM kt GROUP BY 1,2",
    "purpose_od_hourly": f"WITH {_TRIPS} SELECT * FROM po",
    "od_hourly": f"WITH {_OD} SELECT * FROM od",
    "od_baseline_zero_inclusive": f"WITH {_OD}, {_NDAYS} SELECT {_CELL}, sum(passengers) AS total, round(sum(passengers)/n,6) AS avg, round(sqrt(greatest(sum(passengers*passengers)-sum(passengers)*sum(passengers)/n,0)/greatest(n-1,1)),6) AS std, count(*) AS positive_days, CAST(n AS INT) AS observations FROM od, nd GROUP BY {_CELL}, n",
    "od_baseline_positive_days": f"WITH {_OD}, {_NDAYS} SELECT {_CELL}, sum(passengers) AS total, round(avg(passengers),6) AS avg, round(coalesce(stddev_samp(passengers),0),6) AS std, count(DISTINCT date) AS positive_days, CAST(n AS INT) AS observations FROM od, nd GROUP BY {_CELL}, n",
    "od_compare_hours": f"WITH {_OD}, {_TRIPS}, {_compare('date, hour')} SELECT * FROM cmp",
    "od_compare_cells": f"WITH {_OD}, {_TRIPS}, {_compare('date, ' + _CELL)} SELECT * FROM cmp",
    "join_qa": f"WITH {_OD}, {_TRIPS}, {_compare('date, ' + _CELL)} SELECT date, side, count(*) AS cells, sum(left_passengers) AS left_passengers, sum(right_passengers) AS right_passengers FROM cmp GROUP BY 1,2",
    "od_in_network": f"WITH {_OD}, tk AS (SELECT DISTINCT unnest(string_split(segment_keys,';')) AS t FROM candidate_pool), e AS (SELECT split_part(t,'|',2) AS s FROM tk UNION SELECT split_part(t,'|',3) FROM tk) SELECT * FROM od WHERE origin_stop_id IN (SELECT s FROM e) AND destination_stop_id IN (SELECT s FROM e)",
    "stops_used": f"WITH {_OD}, {_STOPS} SELECT * FROM st WHERE stop_id IN (SELECT origin_stop_id FROM od UNION SELECT destination_stop_id FROM od)",
    "date_sets": f"WITH {_LEGS}, a AS (SELECT DISTINCT {_ID('date')} AS date FROM daily_od WHERE {_ID('date')} IS NOT NULL), b AS (SELECT DISTINCT service_date AS date FROM cl) SELECT coalesce(a.date,b.date) AS date, CASE WHEN b.date IS NULL THEN 'matrix_only' WHEN a.date IS NULL THEN 'legs_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.date=b.date",
    "od_wide": f"WITH {_OD} SELECT date, origin_stop_id, destination_stop_id, {', '.join(f'sum(passengers) FILTER (hour={h}) AS passengers_{h:02d}' for h in _HOURS)} FROM od GROUP BY 1,2,3",
    "od_long": f"WITH {_OD} SELECT date, origin_stop_id, destination_stop_id, hour, passengers FROM od",
    "route_loads": f"""WITH {_LEGS}, m AS (SELECT route_id, route_name, route_type FROM (SELECT {_RT('route_id')} AS route_id, route_name, route_type, row_number() OVER (PARTITION BY {_RT('route_id')} ORDER BY route_name NULLS LAST, route_type NULLS LAST, route_distance NULLS LAST) AS k FROM routes) WHERE k=1),
        n AS (SELECT route_id, CAST(substr(ride,9,2) AS INT) AS hour, count(*) AS legs, sum(passengers) AS passengers FROM cl WHERE ride IS NOT NULL AND route_id IS NOT NULL GROUP BY 1,2) SELECT n.*, route_name, route_type, round(passengers/nullif(legs,0),6) AS passengers_per_leg FROM n LEFT JOIN m USING (route_id)""",
    "duplicate_deliveries": f"SELECT service_date, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(CASE WHEN n>1 THEN n ELSE 0 END) AS BIGINT) AS duplicated FROM (SELECT {_DAY} AS service_date, count(*) AS n FROM legs GROUP BY {_DAY}, {_ID('card_id')}, {_ID('transfer_id')}, {_RIDE}, trim(serial_num, ' \t')) GROUP BY 1",
}
