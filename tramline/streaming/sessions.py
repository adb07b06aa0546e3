"""Streams: sessions of events per user, and orphan references kept up batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators.orphans import OrphanState
from tramline.session import checkpointed


def sessions(events: DataFrame, key: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """One row per session: key, session_start, session_end, n_events, total; works on streams and tables.

    A session ends after a gap without events; events later than the watermark are dropped by streams.
    """
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    e = e.withWatermark(ts, late) if events.isStreaming else e
    s = e.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("total"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n_events", "total")


def run_to_table(df: DataFrame, out: str, state: str) -> None:
    """Run a stream over what is there now and append the finished rows to a Parquet table; state restarts it where it stopped."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


class OrphanStream:
    """Folds a stream of references into an OrphanState, one batch at a time; parents' events come in between."""

    def __init__(self, spark: SparkSession):
        self.state = OrphanState(spark)

    def parents(self, events: DataFrame) -> None:
        self.state.advance(events=events)

    def run(self, refs: DataFrame, where: str) -> None:
        """refs: a stream of (key, day)."""
        q = refs.writeStream.foreachBatch(lambda df, _: self.state.advance(refs=checkpointed(df.select("key", "day"))) and None).option("checkpointLocation", where).trigger(availableNow=True).start()
        q.awaitTermination()
