"""References to records that do not exist, kept as an incrementally maintained state.

The state has one row per field, referenced key and day with the number of parent rows
alive on it; zero means that the references wait as orphans. A batch brings references and
parent events. New references probe the parent index; parents that arrive raise the count
of waiting rows and so resolve them; deletions lower it and reopen them. The state grows
with distinct keys and days, never with the references, so hot keys stay one row a day.

State and index are tables of changes in a shared folder, in buckets by key. A batch reads
only the buckets of its keys and appends what it changes; every COMPACT batches the changes
are folded to a new base. A folder that holds a state is taken up where it stood, and a
batch that was cut off does not count.

Parent events are (key, from_day, change): +1 from the day of registration, -1 from the
day of retirement. A parent with an empty validity has no events.

Defined cases: references without key or day are no cases; references without field_name
share the field null; repeated references count in n_refs but are one state row; parents
may repeat and overlap; empty batches and tables leave the state as it is; columns other
than those named are not read.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.session import ensure_checkpoint_dir, remove_at_end

STATE = "field_name string, key string, day string, n_refs long, live long, bucket int"
INDEX = "key string, from_day string, change long, bucket int"
ROW = ["field_name", "key", "day"]
#: Batches after which changes are folded to a base.
COMPACT = 8


def parent_events(parents: DataFrame, key: Column, since: Column, until: Column) -> DataFrame:
    """Arrival and deletion events of parents valid from since (null: always) up to, but not including, until (null: still)."""
    p = parents.select(key.alias("key"), F.coalesce(since, F.lit("")).alias("a"), until.alias("z")).filter(F.col("key").isNotNull() & (F.col("z").isNull() | (F.col("z") > F.col("a"))))
    both = p.select("key", F.explode(F.array(F.struct(F.col("a").alias("from_day"), F.lit(1).cast("long").alias("change")), F.struct(F.col("z").alias("from_day"), F.lit(-1).cast("long").alias("change")))).alias("e"))
    return both.select("key", "e.from_day", "e.change").filter("from_day is not null")


class OrphanState:
    """Parent index and pending references after some batches; path names the folder, by default a new one that ends with the session."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 16):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{ensure_checkpoint_dir(spark)}/orphans-{uuid.uuid4().hex}"
        if path is None:
            remove_at_end(spark, self.path)
        self.base, self.batch = self._stood("base"), self._stood("batch")

    def _stood(self, kind: str) -> int:
        """The number of the last batch, or base, that was written whole; 0 for none."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/state")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        whole = [d.getName() for d in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(d, "_SUCCESS"))]
        return max([int(n.rsplit("-", 1)[1]) for n in whole if n.startswith(kind)], default=0)

    def _read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        """The changes since the last base and the base, of some buckets or all."""
        schema = STATE if table == "state" else INDEX
        names = [f"base-{self.base}"] * (self.base > 0) + [f"batch-{n}" for n in range(self.base + 1, self.batch + 1)]
        if not names:
            return self.spark.createDataFrame([], schema)
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{n}") for n in names]
        rows = reduce(DataFrame.unionByName, parts)
        return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))

    def _write(self, rows: DataFrame, table: str, name: str) -> None:
        """rows are partitioned by bucket already."""
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{name}")

    def _by_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, "bucket")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int").alias("bucket")

    def _touched(self, table: str, name: str) -> list[int]:
        """The buckets in which a table of changes has rows, by its folders."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{name}")
        names = (s.getPath().getName() for s in p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p))
        return [int(n.split("=")[1]) for n in names if n.startswith("bucket=")]

    @staticmethod
    def _folded(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*ROW, "bucket").agg(F.sum("n_refs").alias("n_refs"), F.sum("live").alias("live"))

    def advance(self, refs: DataFrame | None = None, events: DataFrame | None = None) -> OrphanState:
        """Fold in a batch: refs (key, day and, if there is one, field_name and the number n of such references), events (key, from_day, change).

        Known and new rows meet in one shuffle by bucket, which all that follows keeps.
        """
        n, none = self.batch + 1, F.lit(None).cast("string")
        empty = self.spark.createDataFrame([], INDEX)
        came = empty if events is None else events.select("key", "from_day", "change", self._bucket())
        came = self._by_bucket(came).groupBy("bucket", "key", "from_day").agg(F.sum("change").alias("change")).filter("change <> 0")
        self._write(came, "index", f"batch-{n}")
        came = self.spark.read.schema(INDEX).parquet(f"{self.path}/index/batch-{n}")
        known = self._read("state", None if refs is not None else self._touched("index", f"batch-{n}"))
        rows = known.select("bucket", *ROW, F.lit(0).cast("long").alias("n"), F.lit(True).alias("old"))
        if refs is not None:
            given = [F.col("field_name") if "field_name" in refs.columns else none.alias("field_name"), F.col("key"), F.col("day")]
            batch = refs.select(*given, (F.col("n") if "n" in refs.columns else F.lit(1)).cast("long").alias("n")).filter("key is not null and day is not null")
            if "n" not in refs.columns:  # counted where they lie before they move
                batch = batch.groupBy(*ROW).agg(F.sum("n").alias("n"))
            rows = rows.unionByName(batch.select(self._bucket(), *ROW, "n", F.lit(False).alias("old")))
        rows = self._by_bucket(rows).groupBy("bucket", *ROW).agg(F.sum("n").alias("n_refs"), F.max("old").alias("old"))
        # Known rows meet the events that came, new ones all there are; a parent has few.
        index = self._read("index").withColumn("fresh", F.lit(False)).unionByName(came.withColumn("fresh", F.lit(True))).withColumnsRenamed({"bucket": "_bucket", "key": "_key"})
        met = (F.col("bucket") == F.col("_bucket")) & (F.col("key") == F.col("_key")) & (F.col("from_day") <= F.col("day")) & (~F.col("old") | F.col("fresh"))
        live = F.sum(F.coalesce("change", F.lit(0))).alias("live")
        rows = rows.join(index, met, "left").groupBy("bucket", *ROW).agg(F.max("n_refs").alias("n_refs"), live)
        self._write(rows.filter("n_refs <> 0 or live <> 0"), "state", f"batch-{n}")
        self.batch = n
        if n - self.base >= COMPACT:
            self._write(self._by_bucket(self._read("index")).groupBy("bucket", "key", "from_day").agg(F.sum("change").alias("change")), "index", f"base-{n}")
            self._write(self._folded(self._by_bucket(self._read("state"))), "state", f"base-{n}")
            self.base = n
        return self

    def current(self) -> DataFrame:
        """field_name, key, day, n_refs, live."""
        return self._folded(self._read("state")).drop("bucket")

    def pending(self) -> DataFrame:
        """Fields, keys and days whose references wait for a parent."""
        return self.current().filter("live <= 0").select(*ROW, "n_refs")

    def snapshot(self) -> DataFrame:
        """Per field and day: references, and those of them that are orphans; as of now, also if read after later batches."""
        orphan = F.when(F.col("live") <= 0, F.col("n_refs")).otherwise(0)
        return self.current().groupBy("field_name", "day").agg(F.sum("n_refs").alias("n_refs"), F.sum(orphan).alias("n_orphans"))
