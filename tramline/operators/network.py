"""Edge network: path-edge incidence, congestion, alternatives, relief and response to edge weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.choice import softmax
from tramline.operators.groups import beside

EDGE = ["hour", "route_id", "from_stop_id", "to_stop_id"]
EPS = 1e-12
#: Bins of a score in which ranks are counted.
BINS = 1 << 14


def edge_tokens(c: str, once: bool = True, strict: bool = False) -> Column:
    """``route|from|to;...`` to an array of structs, in order, each edge once if once; malformed tokens fail if strict, else give empty parts."""
    parts = F.filter(F.split(F.col(c), ";"), lambda t: t != "")
    parts = F.array_distinct(parts) if once else parts
    if strict:
        parts = F.transform(parts, lambda t: F.when(F.size(F.split(t, "\\|")) == 3, t).otherwise(F.raise_error(F.concat(F.lit("malformed edge: "), t)).cast("string")))
    return F.transform(parts, lambda t: F.struct(F.split_part(t, F.lit("|"), F.lit(1)).alias("route_id"), F.split_part(t, F.lit("|"), F.lit(2)).alias("from_stop_id"), F.split_part(t, F.lit("|"), F.lit(3)).alias("to_stop_id")))


def incidence(paths: DataFrame, path_key: list[str], tokens: str = "segment_keys") -> DataFrame:
    """path key, hour, route_id, from_stop_id, to_stop_id: one row per path and edge."""
    keep = list(dict.fromkeys([*path_key, "hour"]))
    return paths.select(*keep, F.explode(edge_tokens(tokens)).alias("e")).select(*keep, "e.*")


def valid_paths(inc: DataFrame, edges: DataFrame, path_key: list[str]) -> DataFrame:
    """Paths all of whose edges exist: path key, n_edges."""
    known = edges.select(*EDGE).distinct().withColumn("__known", F.lit(1))
    met = inc.join(known, EDGE, "left").groupBy(*path_key).agg(F.count(F.lit(1)).alias("n_edges"), F.count("__known").alias("__n"))
    return met.filter("n_edges = __n").drop("__n")


def path_sums(inc: DataFrame, edges: DataFrame, path_key: list[str], **values: Column) -> DataFrame:
    """Sums of edge values along each path (incidence times vector)."""
    return inc.join(edges, EDGE).groupBy(*path_key).agg(*(F.sum(v).alias(n) for n, v in values.items()))


def edge_sums(inc: DataFrame, paths: DataFrame, path_key: list[str], by: list[str] = EDGE, **values: Column) -> DataFrame:
    """Sums of path values over each edge (transposed incidence times vector)."""
    return inc.join(paths, path_key).groupBy(*by).agg(*(F.sum(v).alias(n) for n, v in values.items()))


def altprob(inc: DataFrame, paths: DataFrame, edges: DataFrame, group: list[str], path_key: list[str], ref: float) -> DataFrame:
    """Per edge the demand-weighted probability of its paths, weighted by the crowding that their group could save.

    paths: path key, p0, demand of the group; edges: EDGE, tt, load0.
    """
    ratio = F.greatest(F.lit(0.0), F.least(F.lit(3.0), F.col("load0") / ref))
    c = path_sums(inc, edges, path_key, __t=F.col("tt"), __c=F.col("tt") * ratio)
    c = c.select(*path_key, F.when(F.col("__t") > EPS, F.col("__c") / F.col("__t")).otherwise(0.0).alias("c"))
    pp = paths.join(c, path_key).withColumn("pc", F.col("p0") * F.col("c"))
    pp = beside(pp.select(*path_key, "p0", "pc", "demand"), group, gc=F.sum("pc"))
    ge = inc.join(pp, path_key).groupBy(*dict.fromkeys([*group, *EDGE])).agg(F.sum("p0").alias("q"), (F.max("gc") - F.sum("pc")).alias("r"), F.max("demand").alias("d"))
    out = ge.groupBy(*EDGE).agg(F.sum(F.col("d") * F.col("q") * F.col("r")).alias("num"), F.sum(F.col("d") * F.col("r")).alias("den"))
    return out.select(*EDGE, F.when(F.col("den") > EPS, F.col("num") / F.col("den")).otherwise(0.0).alias("altprob"))


def marginal(metric: str, ref: float) -> Column:
    """Marginal cost of load on an edge: whole network, excess over ref squared, or minutes above ref."""
    over = F.greatest(F.col("load0") - ref, F.lit(0.0))
    return {"whole": 2 * F.col("tt") * F.col("load0"), "excess": 2 * F.col("tt") * over, "minutes": F.when(F.col("load0") > ref + 1e-9, F.col("tt")).otherwise(0.0)}[metric]


def relief(inc: DataFrame, paths: DataFrame, edges: DataFrame, group: list[str], path_key: list[str], weight: float, metrics: tuple[str, ...], ref: float) -> DataFrame:
    """Per edge the fall of each cost metric per unit of an edge weight, by the logit's own derivative."""
    c = path_sums(inc, edges, path_key, **{f"c_{m}": marginal(m, ref) for m in metrics})
    pp = paths.join(c, path_key)
    pp = beside(pp, group, **{f"g_{m}": F.sum(F.col("p0") * F.col(f"c_{m}")) for m in metrics})
    pp = pp.select(*path_key, *((F.lit(weight) * F.col("demand") * F.col("p0") * (F.col(f"c_{m}") - F.col(f"g_{m}"))).alias(f"w_{m}") for m in metrics))
    return edge_sums(inc, pp, path_key, **{f"relief_{m}": -F.col(f"w_{m}") for m in metrics})


def respond(inc: DataFrame, paths: DataFrame, edges: DataFrame, group: list[str], path_key: list[str], weight: float) -> DataFrame:
    """Loads after travellers respond to an edge weight: EDGE, load0, load1, change of users.

    paths: path key, u, p0, demand; edges: EDGE, tt, trips, load0, reward (0 where there is none).
    """
    d = path_sums(inc, edges, path_key, d=F.col("reward"))
    pp = paths.join(d, path_key, "left").withColumn("u1", F.col("u") + F.lit(weight) * F.coalesce("d", F.lit(0.0)))
    pp = softmax(pp, group, "u1", "p1").select(*path_key, (F.col("demand") * (F.col("p1") - F.col("p0"))).alias("shift"))
    du = edge_sums(inc, pp, path_key, du=F.col("shift"))
    out = edges.join(du, EDGE, "left").withColumn("du", F.coalesce("du", F.lit(0.0)))
    return out.withColumn("load1", F.greatest(F.lit(0.0), F.col("load0") + F.col("du") / F.greatest("trips", F.lit(EPS))))


def top_share(df: DataFrame, score: str, key: list[str], share: float, least: int, by: list[str] | None = None) -> DataFrame:
    """The best ceil(share * n) rows, at least least of them, overall or per scope, with their rank; ties by key.

    Scores fall into BINS equal bins; counts per bin tell where the cut lies and how many rows are before each bin, so that
    only rows of the bins before the cut are ordered, bin by bin.
    """
    scope = by or []
    ends = df.agg(F.min(score), F.max(score)).first()
    width = (ends[1] - ends[0]) / BINS if ends[0] is not None and ends[1] > ends[0] else 1.0
    df = df.withColumn("__bin", F.floor((F.lit(ends[1]) - F.col(score)) / width).cast("long"))
    counts = df.filter(F.col(score).isNotNull()).groupBy(*scope, "__bin").agg(F.count(F.lit(1)).alias("__c"))
    # At most BINS + 1 rows a scope.
    upto = Window.partitionBy(*scope).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("__c").over(Window.partitionBy(*scope))
    k = F.least(n, F.greatest(F.lit(least), F.ceil(F.lit(share) * n)))
    cut = counts.withColumn("__before", F.sum("__c").over(upto) - F.col("__c")).withColumn("__k", k).filter("__before < __k").drop("__c")
    place = F.row_number().over(Window.partitionBy(*scope, "__bin").orderBy(F.col(score).desc(), *key))
    out = df.join(cut, [*scope, "__bin"]).withColumn("rank", (F.col("__before") + place).cast("int"))
    return out.filter(F.col("rank") <= F.col("__k")).drop("__before", "__k", "__bin")
