"""Queries of the llm problems and their SQL: p2 top N, p7 tokenizing, p8 mixing, p9 spam pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.llm import bpe, mixing, spam, topn
from tramline.session import checkpointed, dealt, sent, table

TOP = 5


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return dealt(table(spark, sf, "documents"), "doc_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("observed_passengers_train")
    pool = dealt(table(spark, sf, "candidate_pool"), "od_index", "signature").withColumn("observed", F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c))
    order = [("observed", True), ("total_time", False), ("transfers", False)]
    return topn.top_n(pool, ["od_index", "hour"], order, "signature", TOP).select("od_index", "hour", "signature")


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf), "doc_id", "text")


def p7_text(spark: SparkSession, sf: str) -> DataFrame:
    """The ids decoded again: the texts, empty for null."""
    return bpe.decode(p7_ids(spark, sf), "doc_id", "ids")


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The mix and its plan; longer documents are expected more often, in proportion to their tokens. Only target sources are tokenized."""
    given = table(spark, sf, "mix_targets")
    docs = _documents(spark, sf).withColumn("source", mixing.source_key("source"))
    docs = docs.join(sent(mixing.targets_of(given).select("source"), 64), "source", "left_semi")
    sizes = checkpointed(bpe.count_tokens(docs, ["doc_id", "source"], "text"))
    planned = checkpointed(mixing.plan(sizes, given))
    return mixing.mix(sizes, planned, weight="n_tokens"), planned


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mixed(spark, sf))


def p8_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Per source what holds of any right mix: documents to choose from, no more repeats than the cap, the target met or all used up, actual shares adding up to 1."""
    mixed, planned = _mixed(spark, sf)
    longest = mixed.groupBy("source").agg(F.max("n_tokens").alias("longest"))
    s = mixing.shares(mixed, planned).join(longest, "source", "left")
    goal = F.least(F.col("target_tokens"), F.col("max_repeats") * F.col("available_tokens"))
    whole = F.abs(F.sum("actual_share").over(Window.partitionBy()) - 1) < 1e-9
    return s.select("source", "target_share", "max_repeats", "available_docs", (F.coalesce("most_repeats", F.lit(0)) <= F.col("max_repeats")).alias("within_cap"), (F.abs(F.col("actual_tokens") - goal) <= F.coalesce("longest", F.lit(0)) + 1).alias("on_target"), whole.alias("whole"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.found(_documents(spark, sf)).select("doc_id")


def p9_curves(spark: SparkSession, sf: str) -> DataFrame:
    """The flagged pages with their deviations."""
    return spam.flagged(_documents(spark, sf))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p7_ids, p7_text, p8_mix, p8_shares, p8_kept, p9_found, p9_curves)}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"""SELECT od_index, hour, signature FROM (SELECT *, row_number() OVER (PARTITION BY od_index, hour
            ORDER BY o DESC, total_time NULLS LAST, transfers NULLS LAST, signature) AS k FROM (SELECT DISTINCT od_index, hour, signature, total_time, transfers,
            CASE WHEN observed_passengers_train IS NULL OR isnan(observed_passengers_train) THEN 0 ELSE observed_passengers_train END AS o FROM candidate_pool)) WHERE k <= {TOP}""",
        "p8_kept": """WITH t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, max(max_repeats) AS max_repeats FROM mix_targets GROUP BY 1),
            d AS (SELECT lower(trim(source)) AS source, count(*) AS n FROM documents WHERE text <> '' GROUP BY 1)
            SELECT source, target_share, max_repeats, coalesce(n, 0) AS available_docs, true AS within_cap, true AS on_target, true AS whole FROM t LEFT JOIN d USING (source)""",
        "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    }
