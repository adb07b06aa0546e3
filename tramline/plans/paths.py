"""Queries of stops, distances, route legs and paths, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.functions.clean import clean_id
from tramline.operators import network, routing, spatial
from tramline.operators.groups import first_per
from tramline.plans import choice, oracle, transit
from tramline.session import checkpointed, once, table

PATH, LEG = choice.PATH, routing.LEG
RADIUS = 250.0


def walk_links(spark: SparkSession, sf: str) -> DataFrame:
    """Stops within walking distance, each with itself at 0."""
    w = spatial.radius_join(transit.clean_stops(spark, sf), "stop_id", "latitude", "longitude", RADIUS)
    w = w.withColumn("distance_m", F.round("distance_m", 6))
    return w.select("from_stop_id", "to_stop_id", "distance_m", F.round(spatial.walk_minutes(F.col("distance_m")), 6).alias("walk_min"))


def walk_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Directed links per stop."""
    return walk_links(spark, sf).filter("from_stop_id <> to_stop_id").groupBy(F.col("from_stop_id").alias("stop_id")).agg(F.count(F.lit(1)).alias("links"))


def _path_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = choice.pool(spark, sf, "ride_time", "segment_keys").withColumn("n_edges", F.size(network.edge_tokens("segment_keys", once=False)))
    e = rows.select(*PATH, (F.col("ride_time") / F.col("n_edges")).alias("minutes"), F.posexplode(network.edge_tokens("segment_keys", once=False)).alias("pos", "e"))
    return e.select(*PATH, "pos", "minutes", "e.*")


def path_legs(spark: SparkSession, sf: str) -> DataFrame:
    """Legs of each path by gaps and islands over its edges: route, board, alight, edges."""
    e = routing.islands(_path_edges(spark, sf), PATH, "pos")
    return e.groupBy(*PATH, "leg_no").agg(F.first("route_id").alias("route_id"), F.min_by("from_stop_id", "pos").alias("board"), F.max_by("to_stop_id", "pos").alias("alight"), F.count(F.lit(1)).alias("edges"))


def path_prefix_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Minutes on board after each edge of a path."""
    e = routing.prefix_sums(_path_edges(spark, sf), PATH, "pos", "minutes", "run")
    return e.select(*PATH, "pos", F.round("run", 6).alias("run"))


def _best_legs(spark: SparkSession, sf: str) -> DataFrame:
    return once(spark, "best_legs", [f"{sf}/candidate_pool.parquet"], lambda: _legs_of_paths(spark, sf))


def _legs_of_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = routing.islands(_path_edges(spark, sf), PATH, "pos")
    e = routing.prefix_sums(e, [*PATH, "leg_no"], "pos", "minutes", "run").withColumnRenamed("hour", "__hour").withColumn("hour", F.col("__hour"))
    return checkpointed(routing.best_legs(e, ["od_index", "__hour", "signature", "leg_no"], "pos", "minutes"))


def best_route_legs(spark: SparkSession, sf: str) -> DataFrame:
    return _best_legs(spark, sf)


def edge_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct network edges with both stops' names and the great-circle distance; null where a stop has no place."""
    t = table(spark, sf, "candidate_pool").select(F.explode(network.edge_tokens("segment_keys")).alias("e")).select("e.*").distinct()
    s = transit.clean_stops(spark, sf)
    for end in ("from", "to"):
        m = s.select(F.col("stop_id").alias(f"{end}_stop_id"), F.col("stop_name").alias(f"{end}_name"), F.col("latitude").alias(f"{end}_lat"), F.col("longitude").alias(f"{end}_lon"))
        t = t.join(m, f"{end}_stop_id", "left")
    d = spatial.haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    return t.select("route_id", "from_stop_id", "to_stop_id", "from_name", "to_name", F.round(d, 4).alias("distance_m"))


def route_next_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Stops of a route in the order of their distance from its first stop, and the next of each (keep the first of equals)."""
    d = edge_distances(spark, sf).filter("distance_m is not null")
    stops = d.select("route_id", F.col("to_stop_id").alias("stop_id"), "distance_m")
    one = first_per(stops, ["route_id", "stop_id"], [F.col("distance_m")])
    nxt = F.lead("stop_id").over(Window.partitionBy("route_id").orderBy("distance_m", "stop_id"))
    return one.select("route_id", "stop_id", "distance_m", nxt.alias("next_stop_id"))


def transfer_options(spark: SparkSession, sf: str) -> DataFrame:
    """Number of places to change, and the shortest walk, per hour and pair of routes."""
    o = routing.transfer_options(_best_legs(spark, sf), walk_links(spark, sf))
    return o.groupBy("hour", "from_route", "to_route").agg(F.count(F.lit(1)).alias("places"), F.min("distance_m").alias("shortest_m"))


def _ods(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "candidate_pool").select("hour", clean_id("origin_stop_id").alias("origin"), clean_id("destination_stop_id").alias("destination")).distinct()


def access_options(spark: SparkSession, sf: str) -> DataFrame:
    """Routes that can be boarded within walking distance of an origin, with the shortest walk."""
    on = _best_legs(spark, sf).select("hour", "route_id", F.col("board").alias("to_stop_id")).distinct()
    near = _ods(spark, sf).select("hour", F.col("origin").alias("from_stop_id")).distinct().join(walk_links(spark, sf), "from_stop_id")
    return near.join(on, ["hour", "to_stop_id"]).groupBy("hour", F.col("from_stop_id").alias("origin"), "route_id").agg(F.min("distance_m").alias("shortest_m"))


def reachability(spark: SparkSession, sf: str) -> DataFrame:
    return routing.reachable(_ods(spark, sf), _best_legs(spark, sf))


def candidate_paths(spark: SparkSession, sf: str) -> DataFrame:
    return routing.candidate_paths(_ods(spark, sf), _best_legs(spark, sf), walk_links(spark, sf))


def candidate_paths_whole(spark: SparkSession, sf: str) -> DataFrame:
    """The best of all paths, with walks at both ends and waits; candidate_paths keeps the four labels of its SQL.

    A route's wait at a stop is the shortest of its edges from there.
    """
    waits = choice.edge_state(spark, sf).groupBy("hour", "route_id", F.col("from_stop_id").alias("board")).agg(F.min("wait").alias("wait"))
    legs = checkpointed(_best_legs(spark, sf).join(waits, ["hour", "route_id", "board"], "left").na.fill(0.0, ["wait"]))
    return routing.generated_paths(_ods(spark, sf), legs, walk_links(spark, sf))


def observed_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Trips by hour, stops and route pattern, the passengers of the first two thirds of the days apart, and whether every leg is on the network."""
    t = table(spark, sf, "purpose_trips").select("trip_hash", "service_date", "hour", clean_id("origin_stop_id").alias("origin"), clean_id("destination_stop_id").alias("destination"), "route_chain", "transfer_stop_chain", F.coalesce("passengers", F.lit(0.0)).alias("passengers"))
    t = t.groupBy("trip_hash", "service_date", "hour", "origin", "destination", "route_chain", "transfer_stop_chain").agg(F.max("passengers").alias("passengers"))
    days = t.select("service_date").distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    ranked = days.withColumn("k", F.row_number().over(Window.orderBy("service_date"))).withColumn("train", F.col("k") <= F.floor(n * 2 / 3)).drop("k")
    t = t.join(F.broadcast(ranked), "service_date")
    p = t.groupBy("hour", "origin", "destination", "route_chain", "transfer_stop_chain").agg(F.sum(F.when(F.col("train"), F.col("passengers")).otherwise(0.0)).alias("train"), F.sum("passengers").alias("whole"))
    p = checkpointed(p.withColumn("pid", F.xxhash64("hour", "origin", "destination", "route_chain", "transfer_stop_chain")))
    routes, hops = F.split("route_chain", ">"), F.filter(F.split("transfer_stop_chain", ";"), lambda x: x != "")
    shaped = p.withColumns({"routes": routes, "hops": hops}).withColumn("transfers", F.size("routes") - 1)
    legs = shaped.filter("size(hops) = transfers and transfers <= 2").select("pid", "hour", "origin", "destination", "hops", F.posexplode("routes").alias("i", "route_id"))
    end = lambda side: F.split_part(F.get("hops", F.col("i") - 1 if side == 2 else F.col("i")), F.lit(">"), F.lit(side))
    legs = legs.withColumns({"board": F.when(F.col("i") == 0, F.col("origin")).otherwise(end(2)), "alight": F.coalesce(end(1), F.col("destination"))})
    known = _best_legs(spark, sf).select(*LEG, F.lit(1).alias("ok"))
    met = legs.join(known, LEG, "left").groupBy("pid").agg(F.count("ok").alias("n_ok"))
    out = shaped.join(met, "pid", "left")
    reason = F.when(F.coalesce(F.col("route_chain"), F.lit("")) == "", "missing_routes").when(F.col("transfers") > 2, "transfer_cap").when(F.size("hops") != F.col("transfers"), "chain_length_mismatch").when(F.coalesce("n_ok", F.lit(0)) <= F.col("transfers"), "unmapped_route_leg").otherwise("mapped")
    return out.groupBy(reason.alias("outcome"), "transfers").agg(F.count(F.lit(1)).alias("patterns"), F.sum("train").alias("train"), F.sum("whole").alias("whole"))


_NAMES = (walk_links, walk_degrees, path_legs, path_prefix_sums, best_route_legs, edge_distances, route_next_stops, transfer_options, access_options, reachability, candidate_paths, candidate_paths_whole, observed_patterns)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


_P = "od_index,hour,signature"
_POOL, _STOPS, _ID = choice._POOL, transit._STOPS, oracle.clean_id
_WALK = f"""pt AS (SELECT stop_id, longitude*111320*cos(radians((SELECT round(avg(latitude),6) FROM st WHERE latitude IS NOT NULL AND longitude IS NOT NULL))) AS x, latitude*110540 AS y FROM st WHERE latitude IS NOT NULL AND longitude IS NOT NULL),
wk AS (SELECT a.stop_id AS from_stop_id, b.stop_id AS to_stop_id, round(CASE WHEN a.stop_id=b.stop_id THEN 0 ELSE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) END,6) AS distance_m FROM pt a JOIN pt b ON b.x BETWEEN a.x-{RADIUS}-1 AND a.x+{RADIUS}+1 AND b.y BETWEEN a.y-{RADIUS}-1 AND a.y+{RADIUS}+1 AND (a.stop_id=b.stop_id OR sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))<={RADIUS}+1e-9))"""
_EDGES = f"""tk AS (SELECT {_P}, ride_time, unnest(ts) AS t, generate_subscripts(ts,1)-1 AS pos, len(ts) AS n FROM (SELECT *, string_split(segment_keys,';') AS ts FROM pool)),
ed AS (SELECT {_P}, pos, ride_time/n AS minutes, split_part(t,'|',1) AS route_id, split_part(t,'|',2) AS from_stop_id, split_part(t,'|',3) AS to_stop_id FROM tk),
nw AS (SELECT *, CASE WHEN lag(route_id) OVER w=route_id AND lag(to_stop_id) OVER w=from_stop_id THEN 0 ELSE 1 END AS nw FROM ed WINDOW w AS (PARTITION BY {_P} ORDER BY pos)),
il AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY {_P} ORDER BY pos) AS INT) AS leg_no FROM nw)"""
_BEST = f"""rs AS (SELECT *, sum(minutes) OVER (PARTITION BY {_P}, leg_no ORDER BY pos) AS run FROM il),
pr AS (SELECT a.hour, a.route_id, a.from_stop_id AS board, b.to_stop_id AS alight, round(b.run-(a.run-a.minutes),6) AS minutes, CAST(b.pos-a.pos+1 AS INT) AS edges FROM rs a JOIN rs b USING ({_P}, leg_no) WHERE b.pos>=a.pos AND a.from_stop_id<>b.to_stop_id),
bl AS (SELECT hour, route_id, board, alight, minutes, edges FROM (SELECT *, row_number() OVER (PARTITION BY hour,route_id,board,alight ORDER BY minutes, edges) AS k FROM pr) WHERE k=1)"""
_OD = f"od AS (SELECT DISTINCT hour, {_ID('origin_stop_id')} AS origin, {_ID('destination_stop_id')} AS destination FROM candidate_pool)"
_DIST = f"""de AS (SELECT DISTINCT split_part(t,'|',1) AS route_id, split_part(t,'|',2) AS from_stop_id, split_part(t,'|',3) AS to_stop_id FROM (SELECT unnest(string_split(segment_keys,';')) AS t FROM candidate_pool)),
ds AS (SELECT route_id, from_stop_id, to_stop_id, a.stop_name AS from_name, b.stop_name AS to_name, round(2*6371000*asin(sqrt(least(1,pow(sin(radians(b.latitude-a.latitude)/2),2)+cos(radians(a.latitude))*cos(radians(b.latitude))*pow(sin(radians(b.longitude-a.longitude)/2),2)))),4) AS distance_m FROM de LEFT JOIN st a ON a.stop_id=from_stop_id LEFT JOIN st b ON b.stop_id=to_stop_id)"""
_NETW = f"WITH {_POOL}, {_STOPS}, {_WALK}, {_EDGES}, {_BEST}, {_OD}"
_KEEP = lambda s: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hour,origin,destination,cur ORDER BY score, signature) AS k FROM {s} WHERE cur<>destination) WHERE k<=4)"
_STEP = lambda s: f"SELECT s.hour, origin, destination, bl.alight AS cur, list_append(routes, bl.route_id) AS routes, signature||';'||bl.route_id||'|'||bl.board||'|'||bl.alight AS signature, round(score+distance_m/(4000.0/60)+4+bl.minutes,6) AS score FROM {_KEEP(s)} s JOIN wk ON wk.from_stop_id=cur JOIN bl ON bl.hour=s.hour AND bl.board=wk.to_stop_id WHERE NOT list_contains(routes, bl.route_id) AND bl.alight<>origin"
SQL = {
    "walk_links": f"WITH {_STOPS}, {_WALK} SELECT from_stop_id, to_stop_id, distance_m, round(distance_m/(CAST(4000 AS DOUBLE)/60),6) AS walk_min FROM wk",
    "walk_degrees": f"WITH {_STOPS}, {_WALK} SELECT from_stop_id AS stop_id, count(*) AS links FROM wk WHERE from_stop_id<>to_stop_id GROUP BY 1",
    "path_legs": f"WITH {_POOL}, {_EDGES} SELECT {_P}, leg_no, min(route_id) AS route_id, arg_min(from_stop_id,pos) AS board, arg_max(to_stop_id,pos) AS alight, count(*) AS edges FROM il GROUP BY ALL",
    "path_prefix_sums": f"WITH {_POOL}, {_EDGES} SELECT {_P}, CAST(pos AS INT) AS pos, round(sum(minutes) OVER (PARTITION BY {_P} ORDER BY pos),6) AS run FROM ed",
    "best_route_legs": f"WITH {_POOL}, {_EDGES}, {_BEST} SELECT * FROM bl",
    "edge_distances": f"WITH {_STOPS}, {_DIST} SELECT * FROM ds",
    "route_next_stops": f"WITH {_STOPS}, {_DIST}, o AS (SELECT route_id, to_stop_id AS stop_id, min(distance_m) AS distance_m FROM ds WHERE distance_m IS NOT NULL GROUP BY 1,2) SELECT *, lead(stop_id) OVER (PARTITION BY route_id ORDER BY distance_m, stop_id) AS next_stop_id FROM o",
    "transfer_options": f"{_NETW} SELECT a.hour, a.route_id AS from_route, b.route_id AS to_route, count(*) AS places, min(distance_m) AS shortest_m FROM (SELECT DISTINCT hour,route_id,alight FROM bl) a JOIN wk ON wk.from_stop_id=a.alight JOIN (SELECT DISTINCT hour,route_id,board FROM bl) b ON b.hour=a.hour AND b.board=wk.to_stop_id WHERE a.route_id<>b.route_id GROUP BY 1,2,3",
    "access_options": f"{_NETW} SELECT o.hour, origin, route_id, min(distance_m) AS shortest_m FROM (SELECT DISTINCT hour, origin FROM od) o JOIN wk ON wk.from_stop_id=origin JOIN (SELECT DISTINCT hour,route_id,board FROM bl) b ON b.hour=o.hour AND b.board=wk.to_stop_id GROUP BY 1,2,3",
    "reachability": f"""{_NETW}, h AS (SELECT DISTINCT hour, board, alight FROM bl), a0 AS (SELECT DISTINCT od.hour, origin, destination, h.alight AS cur FROM od JOIN h ON h.hour=od.hour AND h.board=origin), a1 AS (SELECT DISTINCT a.hour, origin, destination, h.alight AS cur FROM a0 a JOIN h ON h.hour=a.hour AND h.board=a.cur WHERE cur<>destination),
        a2 AS (SELECT DISTINCT a.hour, origin, destination, h.alight AS cur FROM a1 a JOIN h ON h.hour=a.hour AND h.board=a.cur WHERE cur<>destination) SELECT hour, origin, destination, CAST(min(n) AS INT) AS transfers FROM (SELECT *, 0 AS n FROM a0 UNION ALL SELECT *, 1 FROM a1 UNION ALL SELECT *, 2 FROM a2) WHERE cur=destination GROUP BY 1,2,3""",
    "candidate_paths": f"""{_NETW}, s0 AS (SELECT od.hour, origin, destination, alight AS cur, [route_id] AS routes, route_id||'|'||origin||'|'||alight AS signature, minutes AS score FROM od JOIN bl ON bl.hour=od.hour AND bl.board=origin), s1 AS ({_STEP('s0')}), s2 AS ({_STEP('s1')} AND bl.alight=destination),
        d AS (SELECT hour, origin, destination, signature, n AS transfers, score FROM (SELECT *, 0 AS n FROM s0 UNION ALL SELECT *, 1 FROM s1 UNION ALL SELECT *, 2 FROM s2) WHERE cur=destination),
        b AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY hour,origin,destination,signature ORDER BY score, transfers) AS k FROM d) WHERE k=1) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY hour,origin,destination ORDER BY score, signature) AS INT) AS rank FROM b) WHERE rank<=15""",
    "observed_patterns": f"""WITH {_POOL}, {_EDGES}, {_BEST}, t AS (SELECT trip_hash, service_date, hour, {_ID('origin_stop_id')} AS origin, {_ID('destination_stop_id')} AS destination, route_chain, transfer_stop_chain, max(coalesce(passengers,0)) AS passengers FROM purpose_trips GROUP BY 1,2,3,4,5,6,7),
        dy AS (SELECT service_date, row_number() OVER (ORDER BY service_date)<=floor(count(*) OVER ()*2/3) AS tr FROM (SELECT DISTINCT service_date FROM t)), p AS (SELECT hour, origin, destination, route_chain, transfer_stop_chain, sum(CASE WHEN tr THEN passengers ELSE 0 END) AS train, sum(passengers) AS whole FROM t JOIN dy USING (service_date) GROUP BY 1,2,3,4,5),
        q AS (SELECT *, row_number() OVER () AS pid, string_split(route_chain,'>') AS rs, list_filter(string_split(transfer_stop_chain,';'), lambda x: x<>'') AS hs, len(string_split(route_chain,'>'))-1 AS transfers FROM p),
        g AS (SELECT q.*, unnest(rs) AS route_id, generate_subscripts(rs,1) AS i FROM q WHERE len(hs)=transfers AND transfers<=2), lg AS (SELECT pid, hour, route_id, CASE WHEN i=1 THEN origin ELSE split_part(hs[i-1],'>',2) END AS board, CASE WHEN i>transfers THEN destination ELSE split_part(hs[i],'>',1) END AS alight FROM g),
        ok AS (SELECT pid, count(*) AS n_ok FROM lg JOIN bl USING (hour, route_id, board, alight) GROUP BY 1)
        SELECT CASE WHEN coalesce(route_chain,'')='' THEN 'missing_routes' WHEN transfers>2 THEN 'transfer_cap' WHEN len(hs)<>transfers THEN 'chain_length_mismatch' WHEN coalesce(n_ok,0)<=transfers THEN 'unmapped_route_leg' ELSE 'mapped' END AS outcome, CAST(transfers AS INT) AS transfers, count(*) AS patterns, sum(train) AS train, sum(whole) AS whole FROM q LEFT JOIN ok USING (pid) GROUP BY 1,2""",
}
