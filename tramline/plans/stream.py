"""Queries that run as streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.session import ensure_checkpoint_dir, table
from tramline.streaming.sessions import run_to_table, sessions


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of the events table, computed from the table."""
    s = sessions(table(spark, sf, "events"), "user_id", "ts")
    return s.withColumn("total", F.round("total", 4))


def user_sessions_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream that ends with the data: all files come in one batch, so none is late, and an event after the last closes what is open."""
    base = f"{ensure_checkpoint_dir(spark)}/sessions-{uuid.uuid4().hex}"
    given = table(spark, sf, "events")
    end = given.agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
    end.limit(0).write.parquet(f"{base}/end")  # its session stays open, so it isn't in the result
    stream = lambda at, schema: spark.readStream.schema(schema).parquet(at)
    events = stream(f"{sf}/events.parquet*", given.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.unionByName(stream(f"{base}/end", end.schema), allowMissingColumns=True)
    found = sessions(events, "user_id", "ts")
    run_to_table(found, f"{base}/out", f"{base}/state")
    end.select(F.col("ts") + F.expr("interval 3 hours")).toDF("ts").write.mode("append").parquet(f"{base}/end")
    run_to_table(found, f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").withColumn("total", F.round("total", 4))


def queries() -> dict:
    return {f.__name__: f for f in (user_sessions, user_sessions_stream)}


SQL = {
    "user_sessions": """WITH l AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM l)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n_events, round(sum(value),4) AS total FROM s GROUP BY user_id, g"""
}
