"""Distances and a bucketed radius join of points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEG_LON, M_PER_DEG_LAT = 111_320.0, 110_540.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def walk_minutes(metres: Column, km_h: float = 4.0) -> Column:
    return metres / (km_h * 1000 / 60)


def radius_join(points: DataFrame, key: str, lat: str, lon: str, radius: float) -> DataFrame:
    """from_<key>, to_<key>, distance_m of all pairs within radius metres, each point with itself at 0.

    Points fall into cells of the radius' size; each looks at its own and the eight cells around, so only near pairs meet.
    Points without coordinates take no part. Distances are planar at the mean latitude.
    """
    p = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(key, F.col(lat).alias("__lat"), F.col(lon).alias("__lon"))
    mean = p.agg(F.round(F.avg("__lat"), 6)).first()[0]
    k = M_PER_DEG_LON * math.cos(math.radians(mean if mean is not None else 0.0))
    p = p.select(key, (F.col("__lon") * k).alias("x"), (F.col("__lat") * M_PER_DEG_LAT).alias("y"))
    p = p.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)})
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("n")
    a = p.select(F.col(key).alias(f"from_{key}"), F.col("x").alias("ax"), F.col("y").alias("ay"), "cx", "cy", around)
    a = a.select(f"from_{key}", "ax", "ay", (F.col("cx") + F.col("n.i")).alias("cx"), (F.col("cy") + F.col("n.j")).alias("cy"))
    met = a.join(p.withColumnRenamed(key, f"to_{key}"), ["cx", "cy"])
    d = F.when(F.col(f"from_{key}") == F.col(f"to_{key}"), 0.0).otherwise(F.sqrt((F.col("ax") - F.col("x")) * (F.col("ax") - F.col("x")) + (F.col("ay") - F.col("y")) * (F.col("ay") - F.col("y"))))
    return met.withColumn("distance_m", d).filter(F.col("distance_m") <= radius + 1e-9).select(f"from_{key}", f"to_{key}", "distance_m")
