"""Writing results: tables, CSV for others, additive upserts, manifests."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Parquet, visible only when the job has committed."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_csv(df: DataFrame, path: str, gzip: bool = True, one_file: bool = False) -> None:
    """CSV with header, also for an empty table; one_file only for small reports."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", "true").option("compression", "gzip" if gzip else "none").csv(path)


def upsert_add(old: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Old and new rows with values of equal keys added up: idempotent only for new rows, as an ON CONFLICT ... + would be."""
    return old.select(*key, *values).unionByName(new.select(*key, *values)).groupBy(*key).agg(*(F.sum(v).alias(v) for v in values))


def upsert_replace(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key; new must have each key once."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def new_sources(found: DataFrame, processed: DataFrame, name: str = "source_file", stamp: str = "signature") -> DataFrame:
    """Files not yet taken in, or changed since (the ledger of a resumable intake)."""
    return found.join(processed.select(name, stamp), [name, stamp], "left_anti")


def content_signature(df: DataFrame, columns: list[str]) -> int:
    """An order-free hash of a table's content; one row comes back."""
    return df.agg(F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0).cast("long"))).first()[0]


def write_manifest(path: str, **facts) -> None:
    """A small JSON file, put in place at once."""
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(facts, f, ensure_ascii=False, indent=1, sort_keys=True, default=str)
    os.replace(tmp, path)
