"""Queries of daily edges and demand, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions.clean import clean_id
from tramline.operators import days, network, trips
from tramline.plans import choice, oracle, transit
from tramline.plans.choice import BETA, GROUP, PATH, WEIGHT, r6
from tramline.session import checkpointed, once, table

E = network.EDGE


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, "segments", [f"{sf}/legs.parquet"], lambda: checkpointed(days.segments(trips.clean_legs(transit._legs(spark, sf)))))


def _split(spark: SparkSession, sf: str) -> tuple[list[str], list[str]]:
    return days.split_days(_daily(spark, sf), "date")


def segment_days(spark: SparkSession, sf: str) -> DataFrame:
    return _daily(spark, sf).select("date", *E, "rides", "passengers", *(r6(c, c) for c in ("least", "mean", "greatest")))


def segment_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return days.baseline(_daily(spark, sf)).select(*E, r6("tt", "tt"), r6("std", "std"), "days", r6("least", "least"), "first_passengers")


def _filled(spark: SparkSession, sf: str, on: list[str]) -> DataFrame:
    return days.filled(choice.edges_and_paths(spark, sf)[1], _daily(spark, sf), on)


def edge_days(spark: SparkSession, sf: str) -> DataFrame:
    """Every network edge on the test days, the day's values or the network's baseline."""
    return _filled(spark, sf, _split(spark, sf)[1]).select("date", *E, r6("tt", "tt"), r6("load0", "load"), "source")


def edge_features(spark: SparkSession, sf: str) -> DataFrame:
    """Means of the training days."""
    f = days.mean_over_days(choice.edges_and_paths(spark, sf)[1], _daily(spark, sf), _split(spark, sf)[0])
    return f.select(*E, r6("tt", "tt"), r6("load", "load"), "n_days")


def group_days(spark: SparkSession, sf: str) -> DataFrame:
    """Passengers of the matrix on the test days for the cells that trips use, 0 where the matrix has none."""
    t = table(spark, sf, "purpose_trips").select("hour", clean_id("origin_stop_id").alias("origin_stop_id"), clean_id("destination_stop_id").alias("destination_stop_id"))
    groups = t.filter("hour is not null and origin_stop_id is not null and destination_stop_id is not null").distinct()
    return days.demand_on_days(groups, transit.od_hourly(spark, sf), _split(spark, sf)[1])


def _states(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    inc, edges, p = choice.edges_and_paths(spark, sf)
    test = _split(spark, sf)[1]
    filled = checkpointed(_filled(spark, sf, test))
    board = network.incidence(choice.pool(spark, sf, "boarding_edges"), PATH, "boarding_edges")
    waits = network.path_sums(board, edges, PATH, wait=30 / F.greatest("trips", F.lit(1e-12)))
    paths = choice.pool(spark, sf).select(*PATH, "walk_time", "transfers").join(p.select(*PATH, "demand"), PATH)
    return inc, filled, days.states(inc, filled, paths, waits, PATH, GROUP, choice.choice.utility(BETA), test)


def day_states(spark: SparkSession, sf: str) -> DataFrame:
    """Per test day: paths, their mean and expected minutes, and the network's cost."""
    _, filled, s = _states(spark, sf)
    cost = filled.groupBy("date").agg(F.sum(F.col("tt") * F.col("trips") * F.col("load0") ** 2).alias("h0"))
    out = s.groupBy("date").agg(F.count(F.lit(1)).alias("paths"), F.avg("total_time").alias("mean_minutes"), F.sum(F.col("p0") * F.col("total_time")).alias("expected_minutes"))
    return out.join(cost, "date").select("date", "paths", r6("mean_minutes", "mean_minutes"), *(F.round(c, 3).alias(c) for c in ("expected_minutes", "h0")))


def relief_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Relief of an edge over the test days."""
    inc, filled, s = _states(spark, sf)
    by_day = days.relief_on_days(inc, filled, s, PATH, GROUP, WEIGHT)
    m = days.moments_over_days(by_day.withColumn("relief", F.round("relief", 6)), E, "relief")
    return m.select(*E, r6("total", "total"), r6("mean", "mean"), F.round("std", 3).alias("std"), "positive", r6("positive_share", "positive_share"))


def od_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids from 0 for the hourly pairs of stops in the candidate pool, in their order."""
    ods = table(spark, sf, "candidate_pool").select("hour", clean_id("origin_stop_id").alias("origin"), clean_id("destination_stop_id").alias("destination"))
    return days.dense_ids(ods.filter("hour is not null and origin is not null and destination is not null"), ["hour", "origin", "destination"], "od_id")


def queries() -> dict:
    return {f.__name__: f for f in (segment_days, segment_baseline, edge_days, edge_features, group_days, day_states, relief_moments, od_ids)}


_E, _P, _R, _ID = choice._E, choice._P, choice._R, oracle.clean_id
_SEG = f"""{transit._LEGS}, sg AS (SELECT service_date AS date, CAST(substr(ride,9,2) AS INT) AS hour, route_id, origin AS from_stop_id, destination AS to_stop_id, count(*) AS rides, sum(passengers) AS passengers, min(m) AS least, avg(m) AS mean, max(m) AS greatest
 FROM (SELECT *, (epoch(strptime(alight,'%Y%m%d%H%M%S'))-epoch(strptime(ride,'%Y%m%d%H%M%S')))/60.0 AS m FROM cl WHERE ride IS NOT NULL AND alight IS NOT NULL AND route_id IS NOT NULL AND origin IS NOT NULL AND destination IS NOT NULL) WHERE m>0 AND m<=180 GROUP BY ALL),
dt AS (SELECT date, row_number() OVER (ORDER BY date)<=floor(count(*) OVER ()*2/3) AS train FROM (SELECT DISTINCT date FROM sg WHERE dayofweek(try_strptime(date,'%Y%m%d')) BETWEEN 2 AND 4))"""
_FILL = f"ef AS (SELECT dt.date, dt.train, {', '.join('edges.' + c for c in _E.split(','))}, edges.trips, coalesce(sg.mean, edges.tt) AS tt, coalesce(sg.passengers, edges.load0) AS load0, sg.mean IS NULL AS base FROM dt CROSS JOIN edges LEFT JOIN sg ON sg.date=dt.date AND {' AND '.join(f'sg.{c}=edges.{c}' for c in _E.split(','))})"
_ST = f"""brd AS ({choice._TOK('boarding_edges')}), wt AS (SELECT {_P}, sum(30/trips) AS wait FROM brd JOIN edges USING ({_E}) GROUP BY ALL), te AS (SELECT * FROM ef WHERE NOT train),
rd AS (SELECT date, {_P}, sum(tt) AS ride, sum(2*tt*load0) AS c FROM inc JOIN te USING ({_E}) GROUP BY ALL),
sx AS (SELECT rd.*, demand, ride+coalesce(wait,0)+walk_time AS total, -0.05*(ride+coalesce(wait,0)+walk_time)-0.02*walk_time-0.3*transfers AS u FROM rd JOIN (SELECT {_P}, walk_time, transfers FROM pool) USING ({_P}) JOIN (SELECT {_P}, demand FROM paths) USING ({_P}) LEFT JOIN wt USING ({_P})),
sy AS (SELECT *, exp(greatest(-700,least(50,u-max(u) OVER (PARTITION BY date,od_index,hour)))) AS ex FROM sx), sz AS (SELECT *, ex/sum(ex) OVER (PARTITION BY date,od_index,hour) AS p0 FROM sy)"""
_NET = choice._NET
SQL = {
    "segment_days": f"WITH {_SEG} SELECT date, {_E}, rides, passengers, {_R('least')} AS least, {_R('mean')} AS mean, {_R('greatest')} AS greatest FROM sg",
    "segment_baseline": f"WITH {_SEG} SELECT {_E}, {_R('avg(mean)')} AS tt, {_R('coalesce(stddev_samp(mean),0)')} AS std, count(DISTINCT date) AS days, {_R('min(least)')} AS least, arg_min(passengers, date) AS first_passengers FROM sg GROUP BY {_E}",
    "edge_days": f"{_NET}, {_SEG}, {_FILL} SELECT date, {_E}, {_R('tt')} AS tt, {_R('load0')} AS load, CASE WHEN base THEN 'baseline' ELSE 'daily' END AS source FROM ef WHERE NOT train",
    "edge_features": f"{_NET}, {_SEG}, {_FILL} SELECT {_E}, {_R('avg(tt)')} AS tt, {_R('avg(load0)')} AS load, count(*) FILTER (NOT base) AS n_days FROM ef WHERE train GROUP BY {_E}",
    "group_days": f"""WITH {_SEG}, {transit._OD}, g AS (SELECT DISTINCT hour, {_ID('origin_stop_id')} AS origin_stop_id, {_ID('destination_stop_id')} AS destination_stop_id FROM purpose_trips)
        SELECT dt.date, g.hour, g.origin_stop_id, g.destination_stop_id, coalesce(sum(od.passengers),0) AS demand FROM dt CROSS JOIN g LEFT JOIN od ON od.date=dt.date AND od.hour=g.hour AND od.origin_stop_id=g.origin_stop_id AND od.destination_stop_id=g.destination_stop_id
        WHERE NOT train AND g.hour IS NOT NULL AND g.origin_stop_id IS NOT NULL AND g.destination_stop_id IS NOT NULL GROUP BY ALL""",
    "day_states": f"{_NET}, {_SEG}, {_FILL}, {_ST}, h AS (SELECT date, round(sum(tt*trips*load0*load0),3) AS h0 FROM te GROUP BY date) SELECT date, count(*) AS paths, {_R('avg(total)')} AS mean_minutes, round(sum(p0*total),3) AS expected_minutes, h0 FROM sz JOIN h USING (date) GROUP BY date, h0",
    "relief_moments": f"""{_NET}, {_SEG}, {_FILL}, {_ST}, w AS (SELECT date, {_P}, {WEIGHT}*demand*p0*(c-sum(p0*c) OVER (PARTITION BY date,od_index,hour)) AS w FROM sz), r AS (SELECT date, {_E}, round(-sum(w),6) AS relief FROM inc JOIN w USING ({_P}) GROUP BY ALL)
        SELECT {_E}, {_R('sum(relief)')} AS total, {_R('avg(relief)')} AS mean, round(stddev_pop(relief),3) AS std, count(*) FILTER (relief>0) AS positive, {_R('count(*) FILTER (relief>0)/count(*)')} AS positive_share FROM r GROUP BY {_E}""",
    "od_ids": f"SELECT hour, origin, destination, row_number() OVER (ORDER BY hour, origin, destination)-1 AS od_id FROM (SELECT DISTINCT hour, {_ID('origin_stop_id')} AS origin, {_ID('destination_stop_id')} AS destination FROM candidate_pool) WHERE hour IS NOT NULL AND origin IS NOT NULL AND destination IS NOT NULL",
}
