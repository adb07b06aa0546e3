"""Grouped multinomial logit: probabilities, top-k choice sets, likelihood, information, fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.groups import beside, top

FEATURES = ("total_time", "walk_time", "transfers")
LOW, HIGH = -700.0, 50.0


def utility(beta: dict[str, float]) -> Column:
    """Weighted sum of features."""
    return sum((F.lit(float(b)) * F.col(c) for c, b in beta.items()), F.lit(0.0))


def softmax(df: DataFrame, keys: list[str], u: str, p: str = "p", **more: Column) -> DataFrame:
    """Probability of each row in its group, stable by the group's greatest utility; more: other aggregates of the group that the same pass gives."""
    df = beside(df, keys, __max=F.max(u), **more)
    df = df.withColumn("__e", F.exp(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col(u) - F.col("__max")))))
    return beside(df, keys, __sum=F.sum("__e")).withColumn(p, F.col("__e") / F.col("__sum")).drop("__max", "__e", "__sum")


def softmax_of_few(df: DataFrame, keys: list[str], u: str, p: str = "p") -> DataFrame:
    """softmax for groups known to be small (choice sets): one shuffle by windows."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__e", F.exp(F.greatest(F.lit(LOW), F.least(F.lit(HIGH), F.col(u) - F.max(u).over(w)))))
    return df.withColumn(p, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def policy_top(df: DataFrame, keys: list[str], u: str, item: str, k: int) -> DataFrame:
    """The k best by utility, with probabilities within the choice set."""
    return softmax_of_few(top(df, keys, [F.col(u).desc(), F.col(item)], k), keys, u, "p_set")


def demand_top(df: DataFrame, keys: list[str], observed: str, item: str, k: int) -> DataFrame:
    """The k most observed, the training choice set."""
    return top(df, keys, [F.col(observed).desc(), F.col(item)], k)


def retain_observed_top(df: DataFrame, keys: list[str], observed: str, u: str, item: str, k: int) -> DataFrame:
    """k rows: if at least min(k, n) are observed, the most observed; else all observed, filled up by utility."""
    df = beside(df, keys, __size=F.count(F.lit(1)), __seen=F.count_if(F.col(observed) > 0))
    enough = F.col("__seen") >= F.least(F.lit(k), F.col("__size"))
    order = [(F.col(observed) > 0).desc(), F.when(enough, F.col(observed)).otherwise(0.0).desc(), F.col(u).desc(), F.col(item)]
    return top(df, keys, order, k).drop("__size", "__seen")


def moments(selected: DataFrame, keys: list[str], beta: dict[str, float], observed: str = "observed") -> DataFrame:
    """One row: log likelihood, null log likelihood, gradient (g_*), information (i_*_*), groups and demand at beta.

    Groups with at least two rows and some demand take part. All is sums per group and then over groups, so that groups of any size combine map-side.
    """
    names = list(beta)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    rows = beside(selected.withColumn("__u", utility(beta)), keys, __max=F.max("__u"))
    rows = rows.withColumn("__u", F.greatest(F.lit(LOW), F.col("__u") - F.col("__max"))).withColumn("__e", F.exp("__u"))
    sums = {"__n": F.count(F.lit(1)), "__t": F.sum(observed), "__s": F.sum("__e"), "__ou": F.sum(F.col(observed) * F.col("__u"))}
    sums |= {f"__e_{c}": F.sum(F.col("__e") * F.col(c)) for c in names} | {f"__o_{c}": F.sum(F.col(observed) * F.col(c)) for c in names}
    sums |= {f"__e_{a}_{b}": F.sum(F.col("__e") * F.col(a) * F.col(b)) for a, b in pairs}
    g = rows.groupBy(*keys).agg(*(v.alias(k) for k, v in sums.items())).filter("__n >= 2 and __t > 0")
    mean = lambda *c: F.col("__e_" + "_".join(c)) / F.col("__s")
    t = F.col("__t")
    aggs = [F.sum(F.col("__ou") - t * F.log("__s")).alias("log_likelihood"), (-F.sum(t * F.log("__n"))).alias("null_log_likelihood"), F.count(F.lit(1)).cast("double").alias("groups"), F.sum(t).alias("demand")]
    aggs += [F.sum(F.col(f"__o_{c}") - t * mean(c)).alias(f"g_{c}") for c in names]
    aggs += [F.sum(t * (mean(a, b) - mean(a) * mean(b))).alias(f"i_{a}_{b}") for a, b in pairs]
    return g.agg(*aggs)


@dataclass
class Fit:
    beta: dict[str, float]
    std_err: dict[str, float]
    log_likelihood: float
    null_log_likelihood: float
    iterations: int

    @property
    def rho2(self) -> float:
        return 1 - self.log_likelihood / self.null_log_likelihood if self.null_log_likelihood else 0.0


def fit(selected: DataFrame, keys: list[str], features: tuple[str, ...] = FEATURES, observed: str = "observed", ridge: float = 1e-6, bounds: tuple[float, float] = (-10.0, 0.0), steps: int = 25, tol: float = 1e-7) -> Fit:
    """Projected Newton with box bounds; every step is one Spark aggregate, the driver holds a matrix of the features' size.

    selected should be checkpointed or cached: it is read once a step.
    """
    n = len(features)
    beta, best = np.full(n, -0.01), None
    lo, hi = bounds

    def at(b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        r = moments(selected, keys, dict(zip(features, map(float, b), strict=True)), observed).first()
        if r["demand"] is None:
            return 0.0, np.zeros(n), np.eye(n), 0.0
        g = np.array([r[f"g_{c}"] for c in features]) - 2 * ridge * b
        info = np.zeros((n, n))
        for i, a in enumerate(features):
            for j in range(i, n):
                info[i, j] = info[j, i] = r[f"i_{a}_{features[j]}"]
        return r["log_likelihood"] - ridge * float(b @ b), g, info + 2 * ridge * np.eye(n), r["null_log_likelihood"]

    ll, g, info, null = at(beta)
    for step in range(steps):
        free = ~(((beta <= lo) & (g < 0)) | ((beta >= hi) & (g > 0)))
        if not free.any() or np.abs(g[free]).max() <= tol * max(1.0, abs(ll)):
            break
        move = np.zeros(n)
        move[free] = np.linalg.pinv(info[np.ix_(free, free)]) @ g[free]
        scale = 1.0
        while scale > 1e-4:
            trial = np.clip(beta + scale * move, lo, hi)
            best = at(trial)
            if best[0] >= ll:
                break
            scale /= 2
        if best is None or best[0] < ll or np.allclose(trial, beta, atol=1e-12):
            break
        beta, (ll, g, info, null) = trial, best
    err = np.sqrt(np.maximum(np.diag(np.linalg.pinv(info)), 0))
    as_dict = lambda v: dict(zip(features, map(float, v), strict=True))
    return Fit(as_dict(beta), as_dict(err), ll, null, step)
