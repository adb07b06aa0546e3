"""Queries of observed and generated candidates, walks, and statistics of networks and selections, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.clean import clean_id
from tramline.operators import candidates, network
from tramline.operators.choice import retain_observed_top
from tramline.plans import choice, oracle, paths, transit
from tramline.plans.choice import GROUP, K, PATH, r6
from tramline.session import checkpointed, table

LIMIT, SAMPLE = 15, 40


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Trips by hour, stops and path; the passengers of the first two thirds of the days are the training demand."""
    t = table(spark, sf, "purpose_trips").select("trip_hash", "service_date", "hour", clean_id("origin_stop_id").alias("origin"), clean_id("destination_stop_id").alias("destination"), "route_chain", "transfer_stop_chain", F.coalesce("passengers", F.lit(0.0)).alias("passengers"), "duration_minutes")
    # Duplicate rows of a trip agree in their references; of their counts the greatest holds.
    t = t.groupBy("trip_hash", "service_date", "hour", "origin", "destination", "route_chain", "transfer_stop_chain").agg(F.max("passengers").alias("passengers"), F.min("duration_minutes").alias("minutes"))
    day = t.select("service_date").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    # One row per day.
    day = day.withColumn("train", F.row_number().over(Window.orderBy("service_date")) <= F.floor(n * 2 / 3))
    t = t.join(F.broadcast(day), "service_date")
    routes, hops = F.split("route_chain", ">"), F.filter(F.split("transfer_stop_chain", ";"), lambda x: x != "")
    t = t.withColumns({"routes": routes, "hops": hops}).filter("size(routes) = size(hops) + 1 and route_chain <> '' and origin is not null and destination is not null")
    side = lambda i, k: F.split_part(F.get("hops", i), F.lit(">"), F.lit(k))
    leg = lambda r, i: F.concat_ws("|", r, F.when(i == 0, F.col("origin")).otherwise(side(i - 1, 2)), F.coalesce(side(i, 1), F.col("destination")))
    t = t.withColumn("signature", F.array_join(F.transform("routes", leg), ";"))
    return candidates.by_signature(t.select("hour", "origin", "destination", "signature", F.when(F.col("train"), F.col("passengers")).otherwise(0.0).alias("train"), F.col("passengers").alias("whole"), "minutes"))


def observed_paths(spark: SparkSession, sf: str) -> DataFrame:
    o = candidates.observed_first(_observed(spark, sf), LIMIT)
    return o.select(*candidates.OD, "signature", r6("train", "train"), r6("whole", "whole"), r6("minutes", "minutes"), "observed_rank")


def merged_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Observed paths first, then those of candidate_paths, the first 15 of each pair."""
    m = candidates.merged(_observed(spark, sf).withColumn("minutes", F.round("minutes", 6)), paths.candidate_paths(spark, sf), LIMIT)
    return m.select(*candidates.OD, "signature", "source", r6("score", "score"), r6("train", "train"), r6("whole", "whole"), "rank")


def _ranked_pool(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "candidate_pool").select(*PATH, "source", "total_time", "observed_passengers_train", "observed_passengers_all").distinct()
    zero = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return p.withColumns({"train": zero("observed_passengers_train"), "whole": zero("observed_passengers_all")})


def pool_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """The pool's candidates in their search order: observed first by demand, time and signature, then generated by time and signature."""
    seen = F.col("source") == "observed"
    order = [~seen, F.when(seen, F.col("train")).desc_nulls_last(), F.when(seen, F.col("whole")).desc_nulls_last(), F.col("total_time").asc_nulls_last(), F.col("signature")]
    return candidates.top(_ranked_pool(spark, sf), GROUP, order, LIMIT).select(*PATH, "source", "rank")


def walk_split(spark: SparkSession, sf: str) -> DataFrame:
    """Metres and minutes of the access, transfer and egress walks of each path that has any."""
    p = table(spark, sf, "candidate_pool").select(*PATH, clean_id("origin_stop_id").alias("origin"), clean_id("destination_stop_id").alias("destination"), "walk_links").distinct()
    w = candidates.walks(p, PATH, "walk_links", transit.clean_stops(spark, sf))
    of = lambda kind, c: F.round(F.sum(F.when(F.col("kind") == kind, F.col(c)).otherwise(0.0)), 4)
    return w.groupBy(*PATH).agg(*(of(kind, c).alias(f"{kind}_{name}") for kind in ("access", "transfer", "egress") for c, name in (("distance_m", "m"), ("minutes", "min"))))


def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per hour the network's routes, edges, stops, stretches between stops and pairs asked for."""
    e = choice.edges_and_paths(spark, sf)[1]
    ends = e.select("hour", F.explode(F.array("from_stop_id", "to_stop_id")).alias("s")).groupBy("hour").agg(F.count_distinct("s").alias("stops"))
    n = e.groupBy("hour").agg(F.count_distinct("route_id").alias("routes"), F.count(F.lit(1)).alias("edges"))
    legs = paths._best_legs(spark, sf).groupBy("hour").agg(F.count(F.lit(1)).alias("stretches"))
    ods = paths._ods(spark, sf).groupBy("hour").agg(F.count(F.lit(1)).alias("ods"))
    return n.join(ends, "hour").join(legs, "hour", "left").join(ods, "hour", "left").na.fill(0, ["stretches", "ods"])


def search_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Per hour what the search for candidates gave: groups, those with an observed path, paths by source and transfers."""
    p = table(spark, sf, "candidate_pool").select(*PATH, "source", "transfers").distinct()
    g = p.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") == "observed").alias("o"), *(F.count_if(F.col("transfers") == k).alias(f"t{k}") for k in range(3)))
    return g.groupBy("hour").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("o") > 0).alias("groups_observed"), F.sum("n").alias("paths"), F.sum("o").alias("observed"), (F.sum("n") - F.sum("o")).alias("generated"), *(F.sum(f"t{k}").alias(f"transfers_{k}") for k in range(3)))


def selection_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """How much of paths and demand the choice sets with observed paths retained cover."""
    rows = choice.with_utility(choice.pool(spark, sf))
    picked = retain_observed_top(rows, GROUP, "observed", "u", "signature", K).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("observed") > 0).alias("ko"), F.sum("observed").alias("kd"))
    g = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed") > 0).alias("o"), F.sum("observed").alias("d")).join(picked, GROUP)
    s = g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("d") > 0).alias("groups_with_demand"), F.count_if(F.col("n") >= K).alias("groups_filled"), F.sum("n").alias("paths"), F.sum("k").alias("selected"), F.sum("o").alias("observed"), F.sum("ko").alias("observed_selected"), F.sum("d").alias("demand"), F.sum("kd").alias("demand_selected"))
    return s.withColumns({"demand": F.round("demand", 4), "demand_selected": F.round("demand_selected", 4), "demand_share": r6(F.try_divide("demand_selected", "demand"))})


def _rules() -> dict:
    number = lambda c: (F.col(c) >= 0) & ~F.isnan(c)
    return {
        "hour": F.col("hour").between(0, 23), "signature": F.col("signature").isNotNull(), "total_time": number("total_time"), "walk_time": number("walk_time"), "transfers": F.col("transfers") >= 0,
        "observed": F.coalesce(F.nanvl("observed_passengers_train", F.lit(0.0)), F.lit(0.0)) >= 0, "segments": F.forall(F.split("segment_keys", ";"), lambda t: F.size(F.split(t, "\\|")) == 3),
    }


def pool_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the candidate pool that break a rule of its values, and ids that stand for several pairs or hours."""
    p = candidates.require(table(spark, sf, "candidate_pool"), [*PATH, "total_time", "walk_time", "transfers", "observed_passengers_train", "segment_keys"])
    several = p.groupBy("od_index").agg(F.count_distinct("hour", F.coalesce("origin_stop_id", F.lit("")), F.coalesce("destination_stop_id", F.lit(""))).alias("n")).agg(F.lit("one_pair").alias("rule"), F.count_if(F.col("n") > 1).alias("n_rows"))
    return candidates.faults(p, _rules()).unionByName(several)


def relief_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Edges on which a gradient is checked: the greatest relief and a seeded draw of the rest."""
    r = choice.relief(spark, sf).select(*network.EDGE, F.col("relief_whole").alias("relief"))
    return candidates.sample_for_check(checkpointed(r), network.EDGE, "relief", SAMPLE, "42")


def queries() -> dict:
    return {f.__name__: f for f in (observed_paths, merged_candidates, pool_ranks, walk_split, network_stats, search_stats, selection_coverage, pool_faults, relief_sample)}


_P, _R, _E, _ID, _POOL = choice._P, choice._R, choice._E, oracle.clean_id, choice._POOL
_OBS = f"""t AS (SELECT service_date, hour, {_ID('origin_stop_id')} AS origin, {_ID('destination_stop_id')} AS destination, route_chain, transfer_stop_chain, max(coalesce(passengers,0)) AS passengers, min(duration_minutes) AS minutes FROM purpose_trips GROUP BY trip_hash,1,2,3,4,5,6),
dy AS (SELECT service_date, row_number() OVER (ORDER BY service_date)<=floor(count(*) OVER ()*2/3) AS tr FROM (SELECT DISTINCT service_date FROM t)),
q AS (SELECT *, string_split(route_chain,'>') AS rs, list_filter(string_split(transfer_stop_chain,';'), lambda x: x<>'') AS hs FROM t JOIN dy USING (service_date)),
ob AS (SELECT hour, origin, destination, signature, sum(CASE WHEN tr THEN passengers ELSE 0 END) AS train, sum(passengers) AS whole, min(minutes) AS minutes FROM (SELECT *,
 list_aggregate([r||'|'||(CASE WHEN i=1 THEN origin ELSE split_part(hs[i-1],'>',2) END)||'|'||(CASE WHEN i>len(hs) THEN destination ELSE split_part(hs[i],'>',1) END) FOR r, i IN rs],'string_agg',';') AS signature
 FROM q WHERE len(rs)=len(hs)+1 AND route_chain<>'' AND origin IS NOT NULL AND destination IS NOT NULL) GROUP BY 1,2,3,4),
o15 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY hour,origin,destination ORDER BY train DESC, whole DESC, minutes NULLS LAST, signature) AS INT) AS observed_rank FROM ob) WHERE observed_rank<={LIMIT})"""
_HAV = "2*6371000*asin(sqrt(least(1,pow(sin(radians(b.latitude-a.latitude)/2),2)+cos(radians(a.latitude))*cos(radians(b.latitude))*pow(sin(radians(b.longitude-a.longitude)/2),2))))"
_KIND = lambda k, c: f"round(sum(CASE WHEN kind='{k}' THEN {c} ELSE 0 END),4)"
_RULE = lambda n, ok: f"SELECT '{n}' AS rule, count(*) FILTER (({ok}) IS NOT TRUE) AS n_rows FROM candidate_pool"
_Z = lambda c: f"CASE WHEN {c} IS NULL OR isnan({c}) THEN 0 ELSE {c} END"
SQL = {
    "observed_paths": f"WITH {_OBS} SELECT hour, origin, destination, signature, {_R('train')} AS train, {_R('whole')} AS whole, {_R('minutes')} AS minutes, observed_rank FROM o15",
    "merged_candidates": f"""WITH {_OBS}, cp AS ({paths.SQL['candidate_paths']}), u AS (SELECT hour, origin, destination, signature, 'observed' AS source, round(minutes,6) AS score, train, whole FROM o15 UNION ALL
        SELECT hour, origin, destination, signature, 'generated', score, 0, 0 FROM cp ANTI JOIN ob USING (hour, origin, destination, signature))
        SELECT hour, origin, destination, signature, source, {_R('score')} AS score, {_R('train')} AS train, {_R('whole')} AS whole, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY hour,origin,destination ORDER BY source<>'observed', score NULLS LAST, signature) AS INT) AS rank FROM u) WHERE rank<={LIMIT}""",
    "pool_ranks": f"""WITH p AS (SELECT DISTINCT {_P}, source, total_time, {_Z('observed_passengers_train')} AS train, {_Z('observed_passengers_all')} AS whole FROM candidate_pool)
        SELECT {_P}, source, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY od_index,hour ORDER BY (source='observed') IS NOT TRUE, CASE WHEN source='observed' THEN train END DESC NULLS LAST, CASE WHEN source='observed' THEN whole END DESC NULLS LAST, total_time NULLS LAST, signature) AS INT) AS rank FROM p) WHERE rank<={LIMIT}""",
    "walk_split": f"""WITH {transit._STOPS}, p AS (SELECT DISTINCT {_P}, {_ID('origin_stop_id')} AS origin, {_ID('destination_stop_id')} AS destination, walk_links FROM candidate_pool), k AS (SELECT {_P}, origin, destination, unnest(string_split(walk_links,';')) AS t FROM p),
        w AS (SELECT {_P}, origin, destination, split_part(t,'|',1) AS x, split_part(t,'|',2) AS y, try_cast(split_part(t,'|',3) AS DOUBLE) AS given, try_cast(split_part(t,'|',4) AS DOUBLE) AS minutes FROM k WHERE t<>''),
        d AS (SELECT {_P}, CASE WHEN x=origin THEN 'access' WHEN y=destination THEN 'egress' ELSE 'transfer' END AS kind, minutes, CASE WHEN given IS NULL OR isnan(given) OR given<=0 THEN {_HAV} ELSE given END AS m FROM w LEFT JOIN st a ON a.stop_id=x LEFT JOIN st b ON b.stop_id=y)
        SELECT {_P}, {', '.join(f"{_KIND(k, c)} AS {k}_{n}" for k in ('access', 'transfer', 'egress') for c, n in (('m', 'm'), ('minutes', 'min')))} FROM d GROUP BY {_P}""",
    "network_stats": f"""{choice._NET}, {paths._EDGES}, {paths._BEST}, {paths._OD}, s AS (SELECT hour, count(DISTINCT x) AS stops FROM (SELECT hour, from_stop_id AS x FROM edges UNION ALL SELECT hour, to_stop_id FROM edges) GROUP BY 1), n AS (SELECT hour, count(DISTINCT route_id) AS routes, count(*) AS edges FROM edges GROUP BY 1)
        SELECT n.*, s.stops, coalesce(l.c,0) AS stretches, coalesce(o.c,0) AS ods FROM n JOIN s USING (hour) LEFT JOIN (SELECT hour, count(*) AS c FROM bl GROUP BY 1) l USING (hour) LEFT JOIN (SELECT hour, count(*) AS c FROM od GROUP BY 1) o USING (hour)""",
    "search_stats": f"""WITH p AS (SELECT DISTINCT {_P}, source, transfers FROM candidate_pool), g AS (SELECT od_index, hour, count(*) AS n, count(*) FILTER (source='observed') AS o, {', '.join(f'count(*) FILTER (transfers={k}) AS t{k}' for k in range(3))} FROM p GROUP BY 1,2)
        SELECT hour, count(*) AS groups, count(*) FILTER (o>0) AS groups_observed, CAST(sum(n) AS BIGINT) AS paths, CAST(sum(o) AS BIGINT) AS observed, CAST(sum(n)-sum(o) AS BIGINT) AS generated, {', '.join(f'CAST(sum(t{k}) AS BIGINT) AS transfers_{k}' for k in range(3))} FROM g GROUP BY hour""",
    "selection_coverage": f"""WITH {_POOL}, n AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (observed>0) OVER w AS s FROM pool WINDOW w AS (PARTITION BY od_index,hour)),
        t AS (SELECT *, row_number() OVER (PARTITION BY od_index,hour ORDER BY (observed>0) DESC, CASE WHEN s>=least({K},n) THEN observed ELSE 0 END DESC, u DESC, signature)<={K} AS pick FROM n),
        g AS (SELECT count(*) AS n, count(*) FILTER (pick) AS k, count(*) FILTER (observed>0) AS o, count(*) FILTER (observed>0 AND pick) AS ko, sum(observed) AS d, sum(observed) FILTER (pick) AS kd FROM t GROUP BY od_index, hour)
        SELECT count(*) AS groups, count(*) FILTER (d>0) AS groups_with_demand, count(*) FILTER (n>={K}) AS groups_filled, CAST(sum(n) AS BIGINT) AS paths, CAST(sum(k) AS BIGINT) AS selected, CAST(sum(o) AS BIGINT) AS observed, CAST(sum(ko) AS BIGINT) AS observed_selected,
        round(sum(d),4) AS demand, round(sum(kd),4) AS demand_selected, {_R('sum(kd)/sum(d)')} AS demand_share FROM g""",
    "pool_faults": " UNION ALL ".join(
        [
            _RULE("hour", "hour BETWEEN 0 AND 23"), _RULE("signature", "signature IS NOT NULL"), _RULE("total_time", "total_time>=0 AND NOT isnan(total_time)"), _RULE("walk_time", "walk_time>=0 AND NOT isnan(walk_time)"), _RULE("transfers", "transfers>=0"),
            _RULE("observed", f"{_Z('observed_passengers_train')}>=0"), _RULE("segments", "len(list_filter(string_split(segment_keys,';'), lambda t: len(string_split(t,'|'))<>3))=0"),
            "SELECT 'one_pair' AS rule, count(*) AS n_rows FROM (SELECT od_index FROM (SELECT DISTINCT od_index, hour, coalesce(origin_stop_id,'') AS a, coalesce(destination_stop_id,'') AS b FROM candidate_pool) GROUP BY od_index HAVING count(*)>1)",
        ]
    ),
    "relief_sample": f"""{choice._NET}, {choice._REL}, r AS (SELECT {_E}, {_R('relief_whole')} AS relief FROM rel), b AS (SELECT * FROM r ORDER BY relief DESC, {_E} LIMIT {SAMPLE // 2}), z AS (SELECT * FROM r ANTI JOIN b USING ({_E}) ORDER BY md5('42|'||hour||'|'||route_id||'|'||from_stop_id||'|'||to_stop_id), {_E} LIMIT {SAMPLE - SAMPLE // 2})
        SELECT *, 'greatest' AS part FROM b UNION ALL SELECT *, 'drawn' FROM z""",
}
