"""Paths over route legs: chains of edges, best legs, transfers and candidate paths with up to two transfers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.groups import first_per, top

LEG = ["hour", "route_id", "board", "alight"]


def islands(edges: DataFrame, key: list[str], pos: str) -> DataFrame:
    """Edges with leg_no: a new leg where the route changes or the edge doesn't start where the last one ended."""
    w = Window.partitionBy(*key).orderBy(pos)
    new = F.coalesce((F.lag("route_id").over(w) != F.col("route_id")) | (F.lag("to_stop_id").over(w) != F.col("from_stop_id")), F.lit(True))
    e = edges.withColumn("__new", new.cast("int"))
    return e.withColumn("leg_no", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def prefix_sums(edges: DataFrame, key: list[str], pos: str, value: str, out: str) -> DataFrame:
    """Running sum of value along each chain."""
    w = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn(out, F.sum(value).over(w))


def best_legs(chained: DataFrame, chain: list[str], pos: str, minutes: str) -> DataFrame:
    """hour, route_id, board, alight, minutes, edges: the quickest stretch over all chains, then the fewest edges.

    chained: edges with chain key, position, running minutes; a chain is one leg of a path, so its position pairs are few.
    """
    a = chained.select(*chain, "hour", "route_id", F.col("from_stop_id").alias("board"), F.col(pos).alias("__i"), (F.col("run") - F.col(minutes)).alias("__at"))
    b = chained.select(*chain, F.col("to_stop_id").alias("alight"), F.col(pos).alias("__j"), F.col("run").alias("__to"))
    pairs = a.join(b, chain).filter((F.col("__j") >= F.col("__i")) & (F.col("board") != F.col("alight")))
    pairs = pairs.withColumns({"minutes": F.round(F.col("__to") - F.col("__at"), 6), "edges": (F.col("__j") - F.col("__i") + 1).cast("int")})
    best = pairs.groupBy(*LEG).agg(F.min(F.struct("minutes", "edges")).alias("b"))
    return best.select(*LEG, "b.minutes", "b.edges")


def transfer_options(legs: DataFrame, walks: DataFrame) -> DataFrame:
    """hour, from_route, to_route, alight, board, distance_m: places to change between routes on foot, the shortest walk per pair of stops."""
    out = legs.select("hour", F.col("route_id").alias("from_route"), F.col("alight")).distinct()
    on = legs.select("hour", F.col("route_id").alias("to_route"), F.col("board")).distinct()
    w = walks.select(F.col("from_stop_id").alias("alight"), F.col("to_stop_id").alias("board"), "distance_m")
    return out.join(w, "alight").join(on, ["hour", "board"]).filter("from_route <> to_route").select("hour", "from_route", "to_route", "alight", "board", "distance_m")


def reachable(ods: DataFrame, legs: DataFrame, transfers: int = 2) -> DataFrame:
    """hour, origin, destination, transfers: the fewest transfers (same stop) with which each OD can be travelled, up to the limit."""
    hop = legs.select("hour", F.col("board").alias("__b"), F.col("alight").alias("__a")).distinct()
    at = ods.select("hour", "origin", "destination").distinct().withColumn("__at", F.col("origin"))
    found = None
    for n in range(transfers + 1):
        at = at.join(hop, (at["__at"] == hop["__b"]) & (at["hour"] == hop["hour"])).select(at["hour"], "origin", "destination", F.col("__a").alias("__at")).distinct()
        got = at.filter(F.col("__at") == F.col("destination")).select("hour", "origin", "destination", F.lit(n).alias("transfers")).distinct()
        found = got if found is None else found.unionByName(got)
        at = at.filter(F.col("__at") != F.col("destination"))
    return found.groupBy("hour", "origin", "destination").agg(F.min("transfers").alias("transfers"))


def candidate_paths(ods: DataFrame, legs: DataFrame, walks: DataFrame, limit: int = 15, labels: int = 4, penalty: float = 4.0, km_h: float = 4.0) -> DataFrame:
    """hour, origin, destination, signature, transfers, score, rank: the best paths with up to two transfers.

    Score is leg minutes, walking minutes between legs and a penalty per transfer. Of partial paths the labels best are
    kept for each OD and stop of change (ties by signature); no route is used twice. Spark limits these groups before the shuffle.
    """
    ods = ods.select("hour", "origin", "destination").distinct()
    leg = legs.select("hour", "route_id", "board", "alight", "minutes")
    token = F.concat_ws("|", "route_id", "board", "alight")
    state = ods.join(leg.withColumnRenamed("board", "origin"), ["hour", "origin"]).withColumn("signature", F.concat_ws("|", "route_id", "origin", "alight"))
    state = state.select("hour", "origin", "destination", F.col("alight").alias("at"), F.array("route_id").alias("routes"), "signature", F.col("minutes").alias("score"))
    walk = walks.select(F.col("from_stop_id").alias("at"), F.col("to_stop_id").alias("board"), (F.col("distance_m") / (km_h * 1000 / 60)).alias("walk"))
    done = None
    for n in range(3):
        arrived = state.filter(F.col("at") == F.col("destination")).select("hour", "origin", "destination", "signature", F.lit(n).alias("transfers"), "score")
        done = arrived if done is None else done.unionByName(arrived)
        if n == 2:
            break
        open_ = top(state.filter(F.col("at") != F.col("destination")), ["hour", "origin", "destination", "at"], [F.col("score"), F.col("signature")], labels, "__k").drop("__k")
        step = open_.join(walk, "at").join(leg, ["hour", "board"]).filter(~F.array_contains("routes", F.col("route_id")) & (F.col("alight") != F.col("origin")))
        if n == 1:
            step = step.filter(F.col("alight") == F.col("destination"))
        score = F.round(F.col("score") + F.col("walk") + penalty + F.col("minutes"), 6)
        state = step.select("hour", "origin", "destination", F.col("alight").alias("at"), F.array_append("routes", F.col("route_id")).alias("routes"), F.concat_ws(";", "signature", token).alias("signature"), score.alias("score"))
    best = first_per(done, ["hour", "origin", "destination", "signature"], [F.col("score"), F.col("transfers")])
    return top(best, ["hour", "origin", "destination"], [F.col("score"), F.col("signature")], limit)


def generated_paths(ods: DataFrame, legs: DataFrame, walks: DataFrame, limit: int = 15, penalty: float = 4.0, km_h: float = 4.0) -> DataFrame:
    """hour, origin, destination, signature, transfers, score, rank: exactly the limit best of all paths with up to two transfers.

    Score is the wait and minutes of legs, all walking (to the first stop, between legs, from the last stop) and a penalty per transfer;
    no route is used twice. What may follow a partial path depends on its OD, stop and set of routes alone, so of those that share
    these the limit best suffice. Scores are summed as whole millionths, so that no rounding reorders them.
    """
    whole = lambda c: F.round(c * 1e6).cast("long")
    ods = ods.select("hour", "origin", "destination").distinct()
    leg = legs.select("hour", "route_id", "board", "alight", whole(F.col("minutes") + F.col("wait")).alias("__leg"))
    walk = walks.select("from_stop_id", "to_stop_id", whole(F.col("distance_m") / (km_h * 1000 / 60)).alias("__walk"))
    out_of, into = walk.withColumnsRenamed({"from_stop_id": "at", "to_stop_id": "board"}), walk.withColumnsRenamed({"from_stop_id": "alight", "to_stop_id": "destination"})
    ends = ods.select("hour", "destination").distinct().join(into, "destination").join(leg, ["hour", "alight"])
    ends = ends.select("hour", "destination", "board", "route_id", "alight", (F.col("__leg") + F.col("__walk")).alias("__leg"))
    near_end = ends.select("hour", "destination", "board").distinct().join(out_of, "board").select("hour", "destination", "at").distinct()
    key, state, done = ["hour", "origin", "destination"], ods.select("*", F.col("origin").alias("at"), F.array().cast("array<string>").alias("routes"), F.lit("").alias("signature"), F.lit(0).cast("long").alias("score")), None
    token = F.concat_ws("|", "route_id", "board", "alight")
    for n in range(3):
        on = state.join(out_of, "at").filter("board <> destination").drop("at").withColumn("score", F.col("score") + F.col("__walk") + (round(penalty * 1e6) if n else 0)).drop("__walk")
        ridden = lambda rides, by: on.join(rides, by).filter(~F.array_contains("routes", F.col("route_id")) & (F.col("alight") != F.col("origin"))).select(*key, F.col("alight").alias("at"), F.array_sort(F.array_append("routes", F.col("route_id"))).alias("routes"), (F.concat_ws(";", "signature", token) if n else token).alias("signature"), (F.col("score") + F.col("__leg")).alias("score"))  # noqa: B023, E731
        arrived = ridden(ends, ["hour", "destination", "board"]).select(*key, "signature", F.lit(n).alias("transfers"), "score")
        done = arrived if done is None else done.unionByName(arrived)
        if n < 2:
            step = ridden(leg, ["hour", "board"]).filter("at <> destination")
            if n == 1:
                step = step.join(near_end, ["hour", "destination", "at"], "left_semi")
            state = top(step, [*key, "at", "routes"], [F.col("score"), F.col("signature")], limit, "__k").drop("__k")
    return top(done, key, [F.col("score"), F.col("signature")], limit).withColumn("score", F.round(F.col("score") / 1e6, 6))
