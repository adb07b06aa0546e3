"""Queries of the choice model and the edge network on candidate_pool, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tramline.operators import choice, network, scoring
from tramline.operators.groups import beside, top
from tramline.session import checkpointed, dealt, once, table

GROUP = ["od_index", "hour"]
PATH = ["od_index", "hour", "signature"]
BETA = {"total_time": -0.05, "walk_time": -0.02, "transfers": -0.3}
WEIGHT, REF, K = 0.009, 6.0, 5
#: Money for an hour of travel.
VALUE_OF_TIME = 1101.0
HIGH_GRID = (0.0, 20.0, 50.0, 100.0)


def r6(c: Column | str, name: str | None = None) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.round(c, 6) + 0.0).alias(name) if name else F.round(c, 6) + 0.0


def pool(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Candidates once each, with observed counts where null and NaN are 0."""
    seen = F.col("observed_passengers_train")
    rows = dealt(table(spark, sf, "candidate_pool"), "od_index", "signature").withColumn("observed", F.when(seen.isNull() | F.isnan(seen), 0.0).otherwise(seen))
    rows = rows.select(*PATH, "total_time", "walk_time", F.col("transfers").cast("double").alias("transfers"), "observed", *more)
    # The signature is unique in a group and copies agree in all columns, so a hash aggregate over all of them does.
    return rows.distinct()


def with_utility(df: DataFrame) -> DataFrame:
    return df.withColumn("u", choice.utility(BETA))


def softmax_top5(spark: SparkSession, sf: str) -> DataFrame:
    p = choice.softmax(with_utility(pool(spark, sf)), GROUP, "u")
    t = choice.policy_top(p, GROUP, "u", "signature", K)
    return t.select(*PATH, "rank", r6("u", "u"), r6("p", "p"), r6("p_set", "p_set"))


def demand_top5(spark: SparkSession, sf: str) -> DataFrame:
    return choice.demand_top(pool(spark, sf), GROUP, "observed", "signature", K).select(*PATH, "rank", "observed")


def retain_observed_top5(spark: SparkSession, sf: str) -> DataFrame:
    return choice.retain_observed_top(with_utility(pool(spark, sf)), GROUP, "observed", "u", "signature", K).select(*PATH, "rank", "observed")


def mnl_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Likelihood, gradient and information of the training choice sets at fixed coefficients."""
    m = choice.moments(choice.demand_top(pool(spark, sf), GROUP, "observed", "signature", K).drop("rank"), GROUP, BETA)
    m = m.withColumn("rho2", 1 - F.col("log_likelihood") / F.col("null_log_likelihood"))
    return m.select(*(F.round(c, 4).alias(c) for c in m.columns))


def _fit_rows(spark: SparkSession, f: choice.Fit, rule: str, settled: bool, per_hour: float = VALUE_OF_TIME, bounds: tuple[float, float] = (-10.0, 0.0)) -> DataFrame:
    """One row per feature; at_bound warns of a coefficient that its bounds hold, settled says whether the choice sets came to rest; per_hour: money that an hour is worth."""
    per_minute = -f.beta["total_time"] / (per_hour / 60)
    rows = [(rule, n, b, f.std_err[n], b / f.std_err[n] if f.std_err[n] else 0.0, f.log_likelihood, f.rho2, f.iterations, per_minute, b in bounds, settled) for n, b in f.beta.items()]
    return spark.createDataFrame(rows, "rule string, feature string, beta double, std_err double, z double, log_likelihood double, rho2 double, iterations int, beta_per_won double, at_bound boolean, settled boolean")


def mnl_fit_demand_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients fitted once on the demand-ranked choice sets."""
    sets = checkpointed(choice.demand_top(pool(spark, sf), GROUP, "observed", "signature", K).drop("rank"))
    return _fit_rows(spark, choice.fit(sets, GROUP), "demand_ranked", True)


def mnl_fit_self_consistent(spark: SparkSession, sf: str, rounds: int = 8) -> DataFrame:
    """A first fit on all candidates; then choose sets by utility with the observed retained and refit, until the sets stay or come back."""
    rows = checkpointed(pool(spark, sf))
    f, seen, settled = choice.fit(rows, GROUP), set(), False
    for _ in range(rounds):
        sets = choice.retain_observed_top(rows.withColumn("u", choice.utility(f.beta)), GROUP, "observed", "u", "signature", K).drop("rank", "u")
        sets = checkpointed(sets)
        mask = sets.agg(F.bit_xor(F.xxhash64(*PATH))).first()[0]
        if settled := mask in seen:
            break
        seen.add(mask)
        f = choice.fit(sets, GROUP)
    return _fit_rows(spark, f, "self_consistent", settled)


def choice_set_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many groups have how many candidates."""
    return pool(spark, sf).groupBy(*GROUP).agg(F.count(F.lit(1)).alias("candidates")).groupBy("candidates").agg(F.count(F.lit(1)).alias("groups"))


def rank_share(spark: SparkSession, sf: str, ranks: int = 15) -> DataFrame:
    """Share of demand by demand rank; groups without demand are left out, missing ranks count as 0."""
    rows = beside(pool(spark, sf).select(*GROUP, "signature", "observed"), GROUP, whole=F.sum("observed")).filter("whole > 0")
    t = top(rows, GROUP, [F.col("observed").desc(), F.col("signature")], ranks).withColumn("share", F.col("observed") / F.col("whole"))
    stats = t.groupBy("rank").agg(F.count(F.lit(1)).alias("present"), F.count_if(F.col("observed") > 0).alias("positive"), F.sum("share").alias("s"), F.sum(F.col("share") ** 2).alias("s2"), F.sum("observed").alias("demand"))
    whole = rows.select(*GROUP, "whole").groupBy(*GROUP).agg(F.max("whole").alias("whole")).agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("all_demand"))
    dense = spark.range(1, ranks + 1).select(F.col("id").cast("int").alias("rank"))
    d = dense.join(stats, "rank", "left").na.fill(0).join(F.broadcast(whole))
    d = d.withColumn("mean_share", F.col("s") / F.col("n")).withColumn("agg_share", F.col("demand") / F.col("all_demand"))
    std = F.sqrt(F.greatest(F.col("s2") / F.col("n") - F.col("mean_share") ** 2, F.lit(0.0)))
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return d.select("rank", "present", "positive", r6("mean_share", "mean_share"), r6(std, "std_share"), r6("agg_share", "agg_share"), r6(F.sum("mean_share").over(upto), "cum_mean_share"), r6(F.sum("agg_share").over(upto), "cum_agg_share"))


def edges_and_paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Incidence, edge state (tt, trips, load0) and path state (u, p0, demand), derived from the pool once a session."""
    return once(spark, "edges_and_paths", [f"{sf}/candidate_pool.parquet"], lambda: _edges_and_paths(spark, sf))


def _edges_and_paths(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = checkpointed(with_utility(pool(spark, sf, "ride_time", "segment_keys")).withColumn("n_edges", F.size(network.edge_tokens("segment_keys"))))
    inc = network.incidence(rows, PATH)
    met = _met(rows)
    n = F.count(F.lit(1))
    edges = met.groupBy(*network.EDGE).agg(F.avg("each").alias("tt"), (1 + n % 20).cast("double").alias("trips"), F.sum("observed").alias("__o"))
    edges = checkpointed(edges.withColumn("load0", F.col("__o") / F.col("trips")).drop("__o"))
    paths = choice.softmax(rows.select(*PATH, "u", "observed"), GROUP, "u", "p0", demand=F.sum("observed"))
    paths = checkpointed(paths.select(*PATH, "u", "p0", "demand"))
    return inc, edges, paths


def _met(rows: DataFrame) -> DataFrame:
    return rows.select("hour", "observed", (F.col("ride_time") / F.col("n_edges")).alias("each"), F.explode(network.edge_tokens("segment_keys")).alias("e")).select("hour", "e.*", "observed", "each")


def edge_state(spark: SparkSession, sf: str) -> DataFrame:
    _, e, _ = edges_and_paths(spark, sf)
    low = scoring.low_crowding(F.col("load0"), REF)
    return e.select(*network.EDGE, r6("tt", "tt"), "trips", r6("load0", "load0"), r6(low, "low_crowding"), r6(30 / F.greatest("trips", F.lit(1e-12)), "wait"), r6(F.col("tt") * F.col("trips") * F.col("load0") ** 2, "h"))


def path_state(spark: SparkSession, sf: str) -> DataFrame:
    """Ride and wait along each path from the edges, and the baseline probability."""
    inc, e, p = edges_and_paths(spark, sf)
    ride = network.path_sums(inc, e, PATH, ride=F.col("tt"))
    board = network.incidence(pool(spark, sf, "boarding_edges"), PATH, "boarding_edges")
    wait = network.path_sums(board, e, PATH, wait=30 / F.greatest("trips", F.lit(1e-12)))
    return p.join(ride, PATH, "left").join(wait, PATH, "left").select(*PATH, r6(F.coalesce("ride", F.lit(0.0)), "ride"), r6(F.coalesce("wait", F.lit(0.0)), "wait"), r6("p0", "p0"), r6("demand", "demand"))


def path_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Paths all of whose edges carry observed demand somewhere in the hour, in groups that keep at least two."""
    inc, e, _ = edges_and_paths(spark, sf)
    ok = network.valid_paths(inc, e.filter("load0 > 0"), PATH)
    return beside(ok, GROUP, n_valid=F.count(F.lit(1))).filter("n_valid >= 2").select(*PATH, "n_edges", "n_valid")


def altprob(spark: SparkSession, sf: str) -> DataFrame:
    inc, e, p = edges_and_paths(spark, sf)
    return network.altprob(inc, p, e, GROUP, PATH, REF).select(*network.EDGE, r6("altprob", "altprob"))


def relief(spark: SparkSession, sf: str) -> DataFrame:
    inc, e, p = edges_and_paths(spark, sf)
    out = network.relief(inc, p, e, GROUP, PATH, WEIGHT, ("whole", "excess", "minutes"), REF)
    return out.select(*network.EDGE, *(r6(c, c) for c in ("relief_whole", "relief_excess", "relief_minutes")))


def relief_transforms(spark: SparkSession, sf: str) -> DataFrame:
    """Percentile rank, linear and logarithmic scaling of the positive relief."""
    inc, e, p = edges_and_paths(spark, sf)
    out = network.relief(inc, p, e, GROUP, PATH, WEIGHT, ("whole",), REF).select(*network.EDGE, F.round("relief_whole", 6).alias("relief"))
    out = scoring.positive_percentile_rank(checkpointed(out), "relief", "pct_rank")
    out = scoring.scaled_by_p99(scoring.scaled_by_p99(out, "relief", "linear"), "relief", "log", log=True)
    return out.select(*network.EDGE, "relief", *(r6(c, c) for c in ("pct_rank", "linear", "log")))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    inc, e, p = edges_and_paths(spark, sf)
    a = network.altprob(inc, p, e, GROUP, PATH, REF)
    f = e.join(a, network.EDGE, "left").withColumn("altprob", F.round(F.coalesce("altprob", F.lit(0.0)), 6)).withColumn("low", F.round(scoring.low_crowding(F.col("load0"), REF), 6))
    f = f.withColumn("score", F.round(-1 + 2 * F.col("low") + 3 * F.col("altprob"), 6)).withColumn("usable", F.col("altprob") > 0)
    return f.withColumn("weight", F.when(F.col("usable"), scoring.stepped(scoring.sigmoid(F.col("score"), 500.0), 10.0, 500.0)).otherwise(0.0))


def edge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Sigmoid score of the features, rounded half-even to steps, only where there is an alternative."""
    return _scores(spark, sf).select(*network.EDGE, "low", "altprob", "score", "weight")


def top_share_all(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).filter("usable").select(*network.EDGE, "score")
    return network.top_share(s, "score", network.EDGE, 0.05, 20)


def top_share_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).filter("usable").select(*network.EDGE, "score")
    return network.top_share(s, "score", network.EDGE, 0.05, 5, ["hour"])


def weight_rollup(spark: SparkSession, sf: str) -> DataFrame:
    r = scoring.rollup_stats(_scores(spark, sf), "hour", "weight")
    return r.select("scope", "n", "total", r6("mean", "mean"), "greatest", *(r6(c, c) for c in ("p50", "p90", "p99")))


def load_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Edges over the reference load per hour and overall, with their share."""
    _, e, _ = edges_and_paths(spark, sf)
    q = e.withColumn("over", (F.round("load0", 6) > REF).cast("int")).rollup("hour").agg(F.grouping("hour").alias("g"), F.count(F.lit(1)).alias("edges"), F.sum("over").alias("over_ref"), F.max("load0").alias("m"))
    return q.select(F.when(F.col("g") == 1, "all").otherwise(F.col("hour").cast("string")).alias("scope"), "edges", "over_ref", r6("m", "max_load"), r6(F.col("over_ref") / F.col("edges"), "over_share"))


def _trials(spark: SparkSession, sf: str) -> DataFrame:
    """Every weight level of the grid as a trial, all trials in one plan."""
    inc, e, p = edges_and_paths(spark, sf)
    grid = F.explode(F.array(*map(F.lit, HIGH_GRID))).alias("level")
    te = e.select("*", grid).withColumn("reward", F.when(F.col("trips") <= 5, F.col("level")).otherwise(0.0))
    tag = lambda df: df.withColumn("trial", F.col("level").cast("int"))
    return _respond_by_trial(tag(inc.select("*", grid)), tag(p.select("*", grid)), tag(te))


def _respond_by_trial(inc: DataFrame, p: DataFrame, e: DataFrame) -> DataFrame:
    key = ["trial", *network.EDGE]
    path, group = ["trial", *PATH], ["trial", *GROUP]
    d = inc.join(e, key).groupBy(*path).agg(F.sum("reward").alias("d"))
    pp = choice.softmax(p.join(d, path, "left").withColumn("u1", F.col("u") + WEIGHT * F.coalesce("d", F.lit(0.0))), group, "u1", "p1")
    du = inc.join(pp.select(*path, (F.col("demand") * (F.col("p1") - F.col("p0"))).alias("shift")), path).groupBy(*key).agg(F.sum("shift").alias("du"))
    out = e.join(du, key, "left").withColumn("du", F.coalesce("du", F.lit(0.0)))
    return out.withColumn("load1", F.greatest(F.lit(0.0), F.col("load0") + F.col("du") / F.greatest("trips", F.lit(1e-12))))


def respond_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Loads after travellers respond to a weight of 50 on seldom served edges."""
    inc, e, p = edges_and_paths(spark, sf)
    e = e.withColumn("reward", F.when(F.col("trips") <= 5, 50.0).otherwise(0.0))
    out = network.respond(inc, p, e, GROUP, PATH, WEIGHT)
    return out.select(*network.EDGE, r6("load0", "load0"), r6("load1", "load1"))


def _summary(trials: DataFrame) -> DataFrame:
    h = lambda c: F.sum(F.col("tt") * F.col("trips") * F.col(c) ** 2)
    s = trials.groupBy("trial").agg(h("load0").alias("h0"), h("load1").alias("h1"), F.sum(F.col("reward") * F.col("load1") * F.col("trips")).alias("cost"), F.count_if((F.col("load0") <= REF) & (F.col("load1") > REF + 1e-6)).alias("newly_over"))
    return s.select("trial", *(F.round(c, 3).alias(c) for c in ("h0", "h1", "cost")), F.round(F.col("h0") - F.col("h1"), 3).alias("improvement"))


def trial_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(_trials(spark, sf))


def best_trial(spark: SparkSession, sf: str) -> DataFrame:
    """Trials within the largest cost allowed first, then by improvement, then the cheaper; the first of them."""
    s = _summary(_trials(spark, sf))
    return s.orderBy((F.col("cost") <= 50_000).desc(), F.col("improvement").desc(), F.col("cost"), "trial").limit(1)


def trial_marginals(spark: SparkSession, sf: str) -> DataFrame:
    """What the next level adds in cost and improvement."""
    d = scoring.first_differences(_summary(_trials(spark, sf)), "trial", ["cost", "improvement"])
    return d.select("trial", "cost", "improvement", F.round("d_cost", 3).alias("d_cost"), F.round("d_improvement", 3).alias("d_improvement"))


_NAMES = (
    softmax_top5, demand_top5, retain_observed_top5, mnl_moments, mnl_fit_demand_ranked, mnl_fit_self_consistent, choice_set_sizes, rank_share, edge_state, path_state,
    path_validity, altprob, relief, relief_transforms, edge_scores, top_share_all, top_share_by_hour, weight_rollup, load_qa, respond_edges, trial_summary, best_trial, trial_marginals,
)


def queries() -> dict:
    return {f.__name__: f for f in _NAMES}


_D = lambda x: f"CAST({x} AS DOUBLE)"
_R = lambda x, n=6: f"round({x},{n})+0.0"
_U = f"({_D(0)}+{_D(-0.05)}*total_time+{_D(-0.02)}*walk_time+{_D(-0.3)}*transfers)"
_POOL = f"""pool AS (SELECT *, {_U} AS u FROM (SELECT DISTINCT od_index, hour, signature, total_time, walk_time, CAST(transfers AS DOUBLE) AS transfers, ride_time, segment_keys, boarding_edges,
 CASE WHEN observed_passengers_train IS NULL OR isnan(observed_passengers_train) THEN {_D(0)} ELSE observed_passengers_train END AS observed FROM candidate_pool))"""
_SOFT = "sm AS (SELECT *, ex/sum(ex) OVER (PARTITION BY od_index,hour) AS p FROM (SELECT *, exp(greatest(-700,least(50,u-max(u) OVER (PARTITION BY od_index,hour)))) AS ex FROM pool))"
_TOPD = f"sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY od_index,hour ORDER BY observed DESC, signature) AS rank FROM pool) WHERE rank<={K})"
_E = "hour,route_id,from_stop_id,to_stop_id"
_P = "od_index,hour,signature"
_TOK = lambda c: f"SELECT DISTINCT {_P}, split_part(t,'|',1) AS route_id, split_part(t,'|',2) AS from_stop_id, split_part(t,'|',3) AS to_stop_id FROM (SELECT {_P}, unnest(string_split({c},';')) AS t FROM pool) WHERE t<>''"
_NET = f"""WITH {_POOL}, {_SOFT}, inc AS ({_TOK('segment_keys')}), ne AS (SELECT {_P}, count(*) AS n_edges FROM inc GROUP BY ALL),
edges AS (SELECT {_E}, avg(ride_time/n_edges) AS tt, {_D('1+count(*)%20')} AS trips, sum(observed)/(1+count(*)%20) AS load0 FROM inc JOIN pool USING ({_P}) JOIN ne USING ({_P}) GROUP BY ALL),
paths AS (SELECT {_P}, u, p AS p0, sum(observed) OVER (PARTITION BY od_index,hour) AS demand FROM sm)"""
_ALT = f"""cr AS (SELECT {_P}, CASE WHEN sum(tt)>1e-12 THEN sum(tt*greatest(0,least(3,load0/{REF})))/sum(tt) ELSE 0 END AS c FROM inc JOIN edges USING ({_E}) GROUP BY ALL),
pc AS (SELECT {_P}, p0, demand, p0*c AS pc, sum(p0*c) OVER (PARTITION BY od_index,hour) AS gc FROM paths JOIN cr USING ({_P})),
ge AS (SELECT od_index, {_E}, sum(p0) AS q, max(gc)-sum(pc) AS r, max(demand) AS d FROM inc JOIN pc USING ({_P}) GROUP BY ALL),
alt AS (SELECT {_E}, CASE WHEN sum(d*r)>1e-12 THEN sum(d*q*r)/sum(d*r) ELSE 0 END AS altprob FROM ge GROUP BY ALL)"""
_M = {"whole": "2*tt*load0", "excess": f"2*tt*greatest(load0-{REF},0)", "minutes": f"CASE WHEN load0>{REF}+1e-9 THEN tt ELSE 0 END"}
_REL = f"""mc AS (SELECT {_P}, {', '.join(f'sum({x}) AS c_{m}' for m, x in _M.items())} FROM inc JOIN edges USING ({_E}) GROUP BY ALL),
mw AS (SELECT {_P}, {', '.join(f'{WEIGHT}*demand*p0*(c_{m}-sum(p0*c_{m}) OVER (PARTITION BY od_index,hour)) AS w_{m}' for m in _M)} FROM paths JOIN mc USING ({_P})),
rel AS (SELECT {_E}, {', '.join(f'-sum(w_{m}) AS relief_{m}' for m in _M)} FROM inc JOIN mw USING ({_P}) GROUP BY ALL)"""
_LOW = f"round(greatest({_D(0)},least({_D(1)},1-load0/{REF})),6)"
_SCORE = f"""sc AS (SELECT {_E}, low, altprob, round(-1+2*low+3*altprob,6) AS score FROM (SELECT {_E}, {_LOW} AS low, round(coalesce(altprob,0),6) AS altprob FROM edges LEFT JOIN alt USING ({_E}))),
sw AS (SELECT *, CASE WHEN altprob>0 THEN greatest({_D(0)},least({_D(500)},round_even({_D(500)}/(1+exp(-score))/10,0)*10)) ELSE {_D(0)} END AS weight FROM sc)"""


def _trial(levels: str) -> str:
    return f"""lv AS (SELECT unnest([{levels}])::DOUBLE AS level), te AS (SELECT CAST(level AS INT) AS trial, edges.*, CASE WHEN trips<=5 THEN level ELSE {_D(0)} END AS reward FROM edges, lv),
dd AS (SELECT trial, {_P}, sum(reward) AS d FROM inc JOIN te USING ({_E}) GROUP BY ALL), u1 AS (SELECT trial, {_P}, p0, demand, u+{_D(WEIGHT)}*d AS u1 FROM paths JOIN dd USING ({_P})),
e1 AS (SELECT *, exp(greatest(-700,least(50,u1-max(u1) OVER (PARTITION BY trial,od_index,hour)))) AS ex FROM u1), p1 AS (SELECT *, ex/sum(ex) OVER (PARTITION BY trial,od_index,hour) AS p1 FROM e1),
du AS (SELECT trial, {_E}, sum(demand*(p1-p0)) AS du FROM inc JOIN p1 USING ({_P}) GROUP BY ALL),
tr AS (SELECT te.*, greatest(0,load0+coalesce(du,0)/greatest(trips,1e-12)) AS load1 FROM te LEFT JOIN du USING (trial,{_E})),
su AS (SELECT trial, round(sum(tt*trips*load0*load0),3) AS h0, round(sum(tt*trips*load1*load1),3) AS h1, round(sum(reward*load1*trips),3) AS cost, round(sum(tt*trips*load0*load0)-sum(tt*trips*load1*load1),3) AS improvement FROM tr GROUP BY trial)"""


_GRID = ",".join(map(str, HIGH_GRID))
_ROLL = "GROUP BY GROUPING SETS ((),(hour))"
_SCOPE = "CASE WHEN grouping(hour)=1 THEN 'all' ELSE CAST(hour AS VARCHAR) END AS scope"
_DEV = ["total_time", "walk_time", "transfers"]
SQL = {
    "softmax_top5": f"WITH {_POOL}, {_SOFT}, t AS (SELECT *, row_number() OVER (PARTITION BY od_index,hour ORDER BY u DESC, signature) AS rank FROM sm) SELECT {_P}, rank, {_R('u')} AS u, {_R('p')} AS p, {_R('p/sum(p) OVER (PARTITION BY od_index,hour)')} AS p_set FROM t WHERE rank<={K}",
    "demand_top5": f"WITH {_POOL}, {_TOPD} SELECT {_P}, rank, observed FROM sel",
    "retain_observed_top5": f"""WITH {_POOL}, n AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (observed>0) OVER w AS s FROM pool WINDOW w AS (PARTITION BY od_index,hour)),
        t AS (SELECT *, row_number() OVER (PARTITION BY od_index,hour ORDER BY (observed>0) DESC, CASE WHEN s>=least({K},n) THEN observed ELSE 0 END DESC, u DESC, signature) AS rank FROM n) SELECT {_P}, rank, observed FROM t WHERE rank<={K}""",
    "mnl_moments": f"""WITH {_POOL}, {_TOPD}, v AS (SELECT * FROM (SELECT *, count(*) OVER w AS n, sum(observed) OVER w AS t FROM sel WINDOW w AS (PARTITION BY od_index,hour)) WHERE n>=2 AND t>0),
        e AS (SELECT *, exp(u-max(u) OVER (PARTITION BY od_index,hour)) AS ex FROM v), p AS (SELECT *, ex/sum(ex) OVER (PARTITION BY od_index,hour) AS p FROM e),
        m AS (SELECT *, {', '.join(f'{c}-sum(p*{c}) OVER (PARTITION BY od_index,hour) AS d_{c}' for c in _DEV)} FROM p),
        a AS (SELECT sum(observed*ln(p)) AS log_likelihood, -sum(t/n*ln(n)) AS null_log_likelihood, sum({_D(1)}/n) AS groups, sum(observed) AS demand, {', '.join(f'sum((observed-t*p)*{c}) AS g_{c}' for c in _DEV)},
        {', '.join(f'sum(t*p*d_{a}*d_{b}) AS i_{a}_{b}' for i, a in enumerate(_DEV) for b in _DEV[i:])} FROM m) SELECT round(COLUMNS(*),4), round(1-log_likelihood/null_log_likelihood,4) AS rho2 FROM a""",
    "choice_set_sizes": f"WITH {_POOL}, g AS (SELECT count(*) AS candidates FROM pool GROUP BY od_index,hour) SELECT candidates, count(*) AS groups FROM g GROUP BY 1",
    "rank_share": f"""WITH {_POOL}, w AS (SELECT *, sum(observed) OVER (PARTITION BY od_index,hour) AS whole FROM pool), v AS (SELECT *, observed/whole AS share, row_number() OVER (PARTITION BY od_index,hour ORDER BY observed DESC, signature) AS rank FROM w WHERE whole>0),
        n AS (SELECT count(*) AS n, sum(whole) AS all_demand FROM (SELECT DISTINCT od_index,hour,whole FROM v)),
        s AS (SELECT CAST(r AS INT) AS rank, count(v.rank) AS present, count(*) FILTER (observed>0) AS positive, coalesce(sum(share),0) AS s, coalesce(sum(share*share),0) AS s2, coalesce(sum(observed),0) AS demand FROM range(1,16) t(r) LEFT JOIN v ON v.rank=r GROUP BY r)
        SELECT rank, present, positive, {_R('s/n')} AS mean_share, {_R('sqrt(greatest(s2/n-(s/n)*(s/n),0))')} AS std_share, {_R('demand/all_demand')} AS agg_share, {_R('sum(s/n) OVER (ORDER BY rank)')} AS cum_mean_share, {_R('sum(demand/all_demand) OVER (ORDER BY rank)')} AS cum_agg_share FROM s, n""",
    "edge_state": f"{_NET} SELECT {_E}, {_R('tt')} AS tt, trips, {_R('load0')} AS load0, {_R(f'greatest({_D(0)},least({_D(1)},1-load0/{REF}))')} AS low_crowding, {_R('30/trips')} AS wait, {_R('tt*trips*load0*load0')} AS h FROM edges",
    "path_state": f"{_NET}, brd AS ({_TOK('boarding_edges')}), rd AS (SELECT {_P}, sum(tt) AS ride FROM inc JOIN edges USING ({_E}) GROUP BY ALL), wt AS (SELECT {_P}, sum(30/trips) AS wait FROM brd JOIN edges USING ({_E}) GROUP BY ALL) SELECT {_P}, {_R('coalesce(ride,0)')} AS ride, {_R('coalesce(wait,0)')} AS wait, {_R('p0')} AS p0, {_R('demand')} AS demand FROM paths LEFT JOIN rd USING ({_P}) LEFT JOIN wt USING ({_P})",
    "path_validity": f"{_NET}, ok AS (SELECT {_P}, count(*) AS n_edges FROM inc LEFT JOIN (SELECT {_E}, 1 AS known FROM edges WHERE load0>0) USING ({_E}) GROUP BY ALL HAVING count(*)=count(known)), v AS (SELECT *, count(*) OVER (PARTITION BY od_index,hour) AS n_valid FROM ok) SELECT * FROM v WHERE n_valid>=2",
    "altprob": f"{_NET}, {_ALT} SELECT {_E}, {_R('altprob')} AS altprob FROM alt",
    "relief": f"{_NET}, {_REL} SELECT {_E}, {', '.join(_R(f'relief_{m}') + f' AS relief_{m}' for m in _M)} FROM rel",
    "relief_transforms": f"""{_NET}, {_REL}, x AS (SELECT {_E}, round(relief_whole,6) AS relief FROM rel), q AS (SELECT quantile_cont(relief,0.99) AS p99, count(*) AS n FROM x WHERE relief>0),
        y AS (SELECT {_E}, relief, (rank() OVER (ORDER BY relief)+(count(*) OVER (PARTITION BY relief)-1)/2.0)/n AS pr FROM x, q WHERE relief>0)
        SELECT {_E}, x.relief, {_R('coalesce(pr,0)')} AS pct_rank, {_R(f'least({_D(1)},greatest(x.relief,0)/p99)')} AS linear, {_R(f'least({_D(1)},ln(1+greatest(x.relief,0))/ln(1+p99))')} AS log FROM x LEFT JOIN (SELECT {_E}, pr FROM y) USING ({_E}), q""",
    "edge_scores": f"{_NET}, {_ALT}, {_SCORE} SELECT {_E}, low, altprob, score, weight FROM sw",
    "top_share_all": f"{_NET}, {_ALT}, {_SCORE}, r AS (SELECT {_E}, score, CAST(row_number() OVER (ORDER BY score DESC, {_E}) AS INT) AS rank, count(*) OVER () AS n FROM sc WHERE altprob>0) SELECT {_E}, score, rank FROM r WHERE rank<=least(n,greatest(20,ceil(0.05*n)))",
    "top_share_by_hour": f"{_NET}, {_ALT}, {_SCORE}, r AS (SELECT {_E}, score, CAST(row_number() OVER (PARTITION BY hour ORDER BY score DESC, {_E}) AS INT) AS rank, count(*) OVER (PARTITION BY hour) AS n FROM sc WHERE altprob>0) SELECT {_E}, score, rank FROM r WHERE rank<=least(n,greatest(5,ceil(0.05*n)))",
    "weight_rollup": f"{_NET}, {_ALT}, {_SCORE} SELECT {_SCOPE}, count(weight) AS n, sum(weight) AS total, {_R('avg(weight)')} AS mean, max(weight) AS greatest, {_R('quantile_cont(weight,0.5)')} AS p50, {_R('quantile_cont(weight,0.9)')} AS p90, {_R('quantile_cont(weight,0.99)')} AS p99 FROM sw {_ROLL}",
    "load_qa": f"{_NET} SELECT {_SCOPE}, count(*) AS edges, CAST(sum(CASE WHEN round(load0,6)>{REF} THEN 1 ELSE 0 END) AS BIGINT) AS over_ref, {_R('max(load0)')} AS max_load, {_R(f'sum(CASE WHEN round(load0,6)>{REF} THEN 1.0 ELSE 0.0 END)/count(*)')} AS over_share FROM edges {_ROLL}",
    "respond_edges": f"{_NET}, {_trial('50')} SELECT {_E}, {_R('load0')} AS load0, {_R('load1')} AS load1 FROM tr",
    "trial_summary": f"{_NET}, {_trial(_GRID)} SELECT * FROM su",
    "best_trial": f"{_NET}, {_trial(_GRID)} SELECT * FROM su ORDER BY (cost<=50000) DESC, improvement DESC, cost, trial LIMIT 1",
    "trial_marginals": f"{_NET}, {_trial(_GRID)} SELECT trial, cost, improvement, round(cost-lag(cost) OVER (ORDER BY trial),3) AS d_cost, round(improvement-lag(improvement) OVER (ORDER BY trial),3) AS d_improvement FROM su",
}
