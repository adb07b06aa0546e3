"""Observed and generated paths of an origin-destination pair in one ranked list, and the walks of a path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.groups import top
from tramline.operators.spatial import haversine

OD = ["hour", "origin", "destination"]


def by_signature(observed: DataFrame) -> DataFrame:
    """OD, signature, train, whole, minutes: observations of one path merged, the least minutes kept."""
    return observed.groupBy(*OD, "signature").agg(F.sum("train").alias("train"), F.sum("whole").alias("whole"), F.min("minutes").alias("minutes"))


def observed_first(observed: DataFrame, limit: int) -> DataFrame:
    """The limit most used paths of each OD by training demand, whole demand, minutes and signature."""
    order = [F.col("train").desc(), F.col("whole").desc(), F.col("minutes").asc_nulls_last(), F.col("signature")]
    return top(observed, OD, order, limit, "observed_rank")


def merged(observed: DataFrame, generated: DataFrame, limit: int) -> DataFrame:
    """OD, signature, source, score, train, whole, rank: observed paths, filled up to limit with generated ones of other signatures.

    Observed paths rank before generated ones, then by score (minutes of observed ones) and signature.
    """
    seen = observed_first(observed, limit).select(*OD, "signature", F.lit("observed").alias("source"), F.col("minutes").alias("score"), "train", "whole")
    none = F.lit(0.0)
    new = generated.join(observed.select(*OD, "signature"), [*OD, "signature"], "left_anti").select(*OD, "signature", F.lit("generated").alias("source"), "score", none.alias("train"), none.alias("whole"))
    order = [F.col("source") != "observed", F.col("score").asc_nulls_last(), F.col("signature")]
    return top(seen.unionByName(new), OD, order, limit)


def walks(paths: DataFrame, key: list[str], tokens: str, places: DataFrame) -> DataFrame:
    """key, kind, distance_m, minutes of the walks ``from|to|metres|minutes;...`` of each path.

    kind is access (from the origin), egress (to the destination) or transfer. A distance that is missing or not above 0 is taken along the sphere.
    places: stop_id, latitude, longitude.
    """
    t = paths.select(*key, "origin", "destination", F.explode(F.filter(F.split(tokens, ";"), lambda x: x != "")).alias("t"))
    part = lambda i: F.split_part("t", F.lit("|"), F.lit(i))
    t = t.select(*key, "origin", "destination", part(1).alias("a"), part(2).alias("b"), part(3).try_cast("double").alias("given"), part(4).try_cast("double").alias("minutes"))
    for end in ("a", "b"):
        t = t.join(places.select(F.col("stop_id").alias(end), F.col("latitude").alias(f"{end}_lat"), F.col("longitude").alias(f"{end}_lon")), end, "left")
    kind = F.when(F.col("a") == F.col("origin"), "access").when(F.col("b") == F.col("destination"), "egress").otherwise("transfer")
    d = distance_or(F.col("given"), haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")))
    return t.select(*key, kind.alias("kind"), d.alias("distance_m"), "minutes")


def distance_or(given: Column, other: Column) -> Column:
    """The given distance, or the other where it is missing or not above 0."""
    return F.when(given.isNull() | F.isnan(given) | (given <= 0), other).otherwise(given)


def faults(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, n_rows: how many rows break each rule; a rule that is null on a row is broken."""
    counted = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_rows")) for n in rules))).alias("r")).select("r.*")


def require(df: DataFrame, columns: list[str], rules: dict[str, Column] | None = None) -> DataFrame:
    """df, failing at once if a column is missing and at run time if a row breaks a rule."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for name, ok in (rules or {}).items():
        df = df.filter(F.assert_true(F.coalesce(ok, F.lit(False)), F.lit(f"broken rule: {name}")).isNull())
    return df


def sample_for_check(df: DataFrame, key: list[str], value: str, n: int, seed: str) -> DataFrame:
    """n rows: the half with the greatest values, and of the rest those whose key comes first in a seeded order."""
    half = n // 2
    best = df.orderBy(F.col(value).desc(), *key).limit(half).withColumn("part", F.lit("greatest"))
    rest = df.join(best.select(*key), key, "left_anti")
    drawn = rest.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *(F.col(k).cast("string") for k in key))), *key).limit(n - half).withColumn("part", F.lit("drawn"))
    return best.unionByName(drawn)
