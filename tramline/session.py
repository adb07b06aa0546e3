"""Session, table and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tramline")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TRAMLINE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """A scan dealt out over all cores by the columns given, where its files have fewer splits than there are cores; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores, *by)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; only a local session may do without and gets a folder of its own, removed when it ends."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-")
        remove_at_end(spark, path)
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Hadoop removes the folder when the driver's JVM ends; results may be read until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder, in folders by the columns given; unlike a checkpoint it is compressed and read by column."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    remove_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate in bytes; it counts file sizes, not sampled rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit_bytes: int = 64 << 20) -> bool:
    """True if the estimate proves that a broadcast of df stays under limit_bytes."""
    return plan_bytes(df) <= limit_bytes


def sent(df: DataFrame, row_bytes: int, limit_bytes: int = 32 << 20) -> DataFrame:
    """df, checkpointed and counted: marked for broadcast if its rows stay under limit_bytes, else left to shuffle."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() * row_bytes <= limit_bytes else df


_kept: dict[tuple, tuple[object, object]] = {}


def once(spark: SparkSession, name: str, paths: list[str], build: Callable[[], object]):
    """What build gives, derived once a session from the files below paths; anew if a file has changed, or the shared folder was cleared."""
    hadoop, conf, files = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration(), []
    for path in paths:
        p = hadoop.Path(path)
        found = p.getFileSystem(conf).listFiles(p, True)
        while found.hasNext():
            s = found.next()
            files.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    key = (spark.sparkContext.applicationId, name, tuple(sorted(files)))
    kept, marker = _kept.get(key, (None, None))
    if marker is None or not marker.getFileSystem(conf).exists(marker):
        for old in [k for k in _kept if k[0] != key[0]]:  # of a session that has ended
            del _kept[old]
        kept = build()
        marker = hadoop.Path(f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}")
        fs = marker.getFileSystem(conf)
        fs.create(marker).close()
        fs.deleteOnExit(marker)
        _kept[key] = (kept, marker)
    return kept
