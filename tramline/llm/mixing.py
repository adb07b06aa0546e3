"""Mixing sources to target weights by Pareto order sampling.

A source's target in tokens, up to its cap, is spread over its documents in proportion to
a weight: each is expected so many times, no more than the cap; what the capped ones cannot
take is spread over the others. The whole part of that number are certain copies. The rest
is an inclusion probability, and documents are ranked by random odds divided by inclusion
odds; the first of them whose tokens fill the rest of the target are selected once more.
The sample's size in tokens is thus fixed up to one document.

Weights count in steps of one part in 64 of a binary order (1.1 %), so that the spread is
found from a table of sources and steps. The rank's cut is found from a histogram of rank
bins (map-side combined, at most BINS rows a source); only the one bin with the cut is
ordered by rows, so no source is ever ordered in one task.

Defined cases: documents without tokens are never chosen; a null source, or one without
target, contributes nothing; sources compare without outer blanks and case, and targets of
one source add up (the largest cap holds); null shares and caps count as 0; documents whose
weight is null, NaN, boundless or not above 0 are never chosen; a source that
cannot reach its target gives all its documents, each as often as it may; equal ranks are
ordered by document id; an empty table gives targets without documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import sent

BINS = 1 << 16
#: Steps of a weight in a binary order.
STEPS = 64


def source_key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def targets_of(targets: DataFrame) -> DataFrame:
    """source, target_share, max_repeats: one row per source that has a target."""
    t = targets.select(source_key("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(0)).alias("cap")).filter("source is not null")
    return t.groupBy("source").agg(F.sum("share").alias("target_share"), F.max("cap").alias("max_repeats"))


def plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row per target source: what it has and what it shall give.

    total_tokens: the mix's size; by default the tokens of all documents of the target sources.
    """
    have = sizes.filter("source is not null and n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_docs"))
    p = targets_of(targets).join(have, "source", "left").na.fill(0, ["available_tokens", "available_docs"])
    # One row per target source, so this window is small.
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.sum("available_tokens").over(Window.partitionBy()).cast("double")
    return p.withColumn("total_tokens", total).withColumn("target_tokens", F.col("target_share") * F.col("total_tokens"))


def expected(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """source, _step, copies, inclusion and, per source, rest_tokens and mean inclusion; docs has source, _step of the weight and n_tokens.

    The expected number is the same multiple of all weights that stay below the cap. Steps are tried from the greatest
    weight on: the first that stays below it, if all greater ones are capped, gives the multiple.
    """
    cells = docs.groupBy("source", "_step").agg(F.sum("n_tokens").alias("_n")).join(planned.select("source", "target_tokens", F.col("max_repeats").alias("_cap")), "source").withColumn("_w", F.pow(F.lit(2.0), F.col("_step") / STEPS))
    w = Window.partitionBy("source").orderBy(F.col("_step").desc())  # a source has some thousand steps
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("target_tokens") - F.col("_cap") * F.coalesce(F.sum("_n").over(before), F.lit(0))
    cells = cells.withColumn("_c", left / F.sum(F.col("_w") * F.col("_n")).over(after))
    fits = F.when(F.col("_c") * F.col("_w") <= F.col("_cap"), F.struct("_step", "_c"))
    cells = cells.withColumn("_c", F.max(fits).over(Window.partitionBy("source"))["_c"])
    each = F.greatest(F.lit(0.0), F.least(F.coalesce(F.col("_c") * F.col("_w"), F.col("_cap").cast("double")), F.col("_cap").cast("double")))
    cells = cells.withColumn("_each", each).withColumn("copies", F.floor(F.col("_each") + 1e-9).cast("int")).withColumn("inclusion", F.greatest(F.col("_each") - F.col("copies"), F.lit(0.0)))
    one = Window.partitionBy("source")
    cells = cells.withColumn("rest_tokens", F.sum(F.col("inclusion") * F.col("_n")).over(one)).withColumn("_mean", F.col("rest_tokens") / F.sum("_n").over(one))
    return cells.select("source", "_step", "copies", "inclusion", "rest_tokens", "_mean")


def mix(sizes: DataFrame, planned: DataFrame, key: str = "doc_id", seed: int = 17, weight: str | None = None) -> DataFrame:
    """key, source, n_tokens, repeats of every chosen document; sizes has key, source, n_tokens and the weight, if any.

    weight: how often a document is expected is in proportion to it, up to the cap; without one all of a source are alike.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    step = F.when((w > 0) & (w < float("inf")), F.round(F.log2(w) * STEPS).cast("int"))
    docs = sizes.select(key, "source", "n_tokens", step.alias("_step")).filter("n_tokens > 0 and _step is not null and source is not null")
    docs = docs.join(sent(expected(docs, planned), 64), ["source", "_step"])
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11) + 0.5) / float(1 << 53)
    odds = lambda x: x / (1 - x)
    clip = lambda x: F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), x))
    # The rank: random odds over inclusion odds. Times the odds of the source's mean it fills the bins alike.
    ratio = F.when(F.col("inclusion") > 0, odds(u) / odds(clip(F.col("inclusion"))))
    level = F.col("_r") * odds(clip(F.col("_mean")))
    ranked = docs.withColumn("_r", ratio).withColumn("_bin", F.least(F.floor(level / (1 + level) * BINS), F.lit(BINS - 1)).cast("int"))
    hist = ranked.filter("_bin is not null").groupBy("source", "_bin").agg(F.sum("n_tokens").alias("_n"), F.first("rest_tokens").alias("_rest"))
    upto = F.sum("_n").over(Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    # The bin in which the running size passes the target; where none does, all bins are taken whole.
    cut = hist.withColumn("_upto", upto).filter(F.col("_upto") > F.col("_rest")).groupBy("source").agg(F.min("_bin").alias("_cut"), F.min_by(F.col("_upto") - F.col("_n"), "_bin").alias("_before"))
    # One row per target source.
    ranked = ranked.join(sent(cut, 64), "source", "left")
    inside = ranked.filter(F.col("_bin") == F.col("_cut"))
    running = F.sum("n_tokens").over(Window.partitionBy("source").orderBy("_r", key).rowsBetween(Window.unboundedPreceding, 0))
    # A document that straddles the target is taken if more than half of it lies within.
    take = inside.withColumn("_in", F.col("_before") + running - F.col("n_tokens") / 2.0 <= F.col("rest_tokens"))
    outside = ranked.filter((F.col("_bin") == F.col("_cut")).isNull() | (F.col("_bin") != F.col("_cut")))
    outside = outside.withColumn("_in", F.col("_bin").isNotNull() & (F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut"))))
    both = outside.unionByName(take)
    repeats = F.col("copies") + F.coalesce(F.col("_in"), F.lit(False)).cast("int")
    return both.select(key, "source", "n_tokens", repeats.alias("repeats")).filter("repeats > 0")


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """Per target source the target and the actual share, and whether the target was reached (to within 1 %)."""
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count(F.lit(1)).alias("docs"), F.max("repeats").alias("most_repeats"))
    out = planned.join(got, "source", "left").na.fill(0, ["actual_tokens", "docs", "most_repeats"])
    whole = F.sum("actual_tokens").over(Window.partitionBy())
    return out.select(
        "source", "target_share", (F.col("actual_tokens") / F.greatest(F.col("total_tokens"), F.lit(1.0))).alias("share_of_total"), F.when(whole > 0, F.col("actual_tokens") / whole).otherwise(0.0).alias("actual_share"),
        F.round("target_tokens").cast("long").alias("target_tokens"), "actual_tokens", "available_tokens", "available_docs", "docs", "max_repeats", "most_repeats", (F.col("actual_tokens") >= 0.99 * F.col("target_tokens")).alias("reached"),
    )
