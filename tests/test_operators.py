"""Operators of the choice model, network and tables against plain Python and known values."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.functions import values
from tramline.operators import choice, groups, matrix, network, routing, scoring, spatial

E = network.EDGE


def fixture(spark):
    """Five paths in two groups over four edges."""
    use = {0: (0, 1), 1: (0, 2), 2: (2, 3), 3: (1, 3), 4: (2, 3)}
    p0 = (0.50, 0.30, 0.20, 0.65, 0.35)
    inc = spark.createDataFrame([(int(p > 2), p, 7, str(e), "f", "t") for p, es in use.items() for e in es], "grp int, path int, hour int, route_id string, from_stop_id string, to_stop_id string")
    edges = spark.createDataFrame([(7, str(e), "f", "t", tt, tr, lo, rw) for e, (tt, tr, lo, rw) in enumerate(((5.0, 10.0, 60.0, 0.0), (8.0, 12.0, 30.0, 100.0), (4.0, 9.0, 70.0, 0.0), (7.0, 11.0, 20.0, 50.0)))], "hour int, route_id string, from_stop_id string, to_stop_id string, tt double, trips double, load0 double, reward double")
    paths = spark.createDataFrame([(int(p > 2), p, math.log(p0[p]), p0[p], 80.0 if p > 2 else 120.0) for p in range(5)], "grp int, path int, u double, p0 double, demand double")
    return inc, edges, paths


def by_edge(df, c):
    return [r[c] for r in df.orderBy("route_id").collect()]


def test_known_values_of_the_network(spark):
    inc, edges, paths = fixture(spark)
    g, k = ["grp"], ["grp", "path"]
    assert by_edge(network.altprob(inc, paths, edges, g, k, 55.0), "altprob") == pytest.approx([0.8, 0.5372466216216216, 0.4481315959508938, 0.2])
    r = network.relief(inc, paths, edges, g, k, 0.009, ("whole", "excess", "minutes"), 55.0)
    assert by_edge(r, "relief_whole") == pytest.approx([-46.656, 0.144, -0.144, 46.656])
    assert by_edge(r, "relief_excess") == pytest.approx([4.32, 46.656, -46.656, -4.32])
    assert by_edge(r, "relief_minutes") == pytest.approx([-0.432, 1.1952, -1.1952, 0.432])
    out = network.respond(inc, paths, edges, g, k, 0.009)
    assert by_edge(out, "load1") == pytest.approx([60.35821928, 32.80712468, 66.25716709, 19.67434611], rel=1e-8)
    h = out.agg(F.sum(F.expr("tt*trips*load0*load0")).alias("h0"), F.sum(F.expr("tt*trips*load1*load1")).alias("h1"), F.sum(F.expr("reward*load1*trips")).alias("c")).first()
    assert (h.h0, h.h1, h.c) == pytest.approx((473600, 473326.8357636564, 50189.43997935175))


def test_relief_is_the_derivative(spark):
    """Relief per edge equals the fall of the cost by a small weight on that edge alone."""
    inc, edges, paths = fixture(spark)
    want = by_edge(network.relief(inc, paths, edges, ["grp"], ["grp", "path"], 0.009, ("whole",), 55.0), "relief_whole")
    eps = 1e-4
    for e in range(4):
        one = edges.withColumn("reward", F.when(F.col("route_id") == str(e), eps).otherwise(0.0))
        out = network.respond(inc, paths, one, ["grp"], ["grp", "path"], 0.009)
        # The marginal cost 2*tt*load per vehicle's passenger: loads move by du / trips, costs by tt * trips.
        fall = out.agg(F.sum(F.expr("tt*trips*(load0*load0-load1*load1)"))).first()[0] / eps
        assert fall == pytest.approx(want[e], abs=2e-2)


def test_softmax_and_choice_sets(spark):
    rows = [(1, f"p{i}", u, o) for i, (u, o) in enumerate([(-1.0, 0.0), (-2.0, 5.0), (-900.0, 0.0), (-1.0, 2.0)])] + [(2, "q", 800.0, 0.0), (None, "n", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "g int, i string, u double, observed double")
    p = {r.i: r.p for r in choice.softmax(df, ["g"], "u").collect()}
    e = [math.exp(max(-700, x)) for x in (0, -1, -899, 0)]
    assert [p[f"p{i}"] for i in range(4)] == pytest.approx([x / sum(e) for x in e]) and p["q"] == p["n"] == 1.0
    few = {r.i: r.p for r in choice.softmax_of_few(df, ["g"], "u").collect()}
    assert few == pytest.approx(p)
    assert {r.i for r in choice.retain_observed_top(df, ["g"], "observed", "u", "i", 2).filter("g = 1").collect()} == {"p1", "p3"}
    assert [r.i for r in choice.retain_observed_top(df, ["g"], "observed", "u", "i", 3).filter("g = 1").orderBy("rank").collect()] == ["p3", "p1", "p0"]


def test_fit_recovers_coefficients(spark):
    rng = np.random.default_rng(1)
    true, rows = np.array([-0.4, -0.8, -1.5]), []
    for g in range(400):
        x = rng.uniform(0, 5, (4, 3))
        e = np.exp(x @ true)
        n = rng.multinomial(200, e / e.sum())
        rows += [(g, i, *map(float, x[i]), float(n[i])) for i in range(4)]
    df = spark.createDataFrame(rows, "g int, i int, total_time double, walk_time double, transfers double, observed double").cache()
    f = choice.fit(df, ["g"])
    assert list(f.beta.values()) == pytest.approx(true, abs=4 * max(f.std_err.values())) and 0 < f.rho2 < 1
    m = choice.moments(df, ["g"], f.beta).first()
    assert all(abs(m[f"g_{c}"]) < 1e-2 for c in choice.FEATURES)
    assert choice.fit(df.limit(0), ["g"]).log_likelihood == 0.0


def test_top_share_and_ranks(spark):
    rng = random.Random(1)
    rows = [(rng.choice([7, 8]), f"e{i:03d}", rng.choice([0.0, 1.0, 2.5, 2.5, -3.0])) for i in range(101)]
    df = spark.createDataFrame(rows, "hour int, k string, s double")
    order = sorted(rows, key=lambda r: (-r[2], r[1]))
    assert [(r.k, r["rank"]) for r in network.top_share(df, "s", ["k"], 0.1, 3).orderBy("rank").collect()] == [(k, i + 1) for i, (_, k, _) in enumerate(order[:11])]
    per = {(r.hour, r.k) for r in network.top_share(df, "s", ["k"], 0.01, 3, ["hour"]).collect()}
    assert per == {(h, k) for h in (7, 8) for _, k, _ in [r for r in order if r[0] == h][:3]}
    got = {r.k: r.p for r in scoring.positive_percentile_rank(df, "s", "p").collect()}
    pos = sorted(s for *_, s in rows if s > 0)
    for _, k, s in rows:
        want = (pos.index(s) + (pos.count(s) + 1) / 2) / len(pos) if s > 0 else 0.0
        assert got[k] == pytest.approx(want)


def test_matrix(spark):
    od = spark.createDataFrame([("d1", 7, "a", "b", 2.0), ("d2", 7, "a", "b", 4.0), ("d1", 8, "a", "c", 5.0)], "date string, hour int, origin_stop_id string, destination_stop_id string, passengers double")
    z = {r.destination_stop_id: (r.avg, r.std) for r in matrix.baseline_zero_inclusive(od, 3).collect()}
    assert z["b"] == pytest.approx((2.0, 2.0)) and z["c"] == pytest.approx((5 / 3, math.sqrt((25 - 25 / 3) / 2)))
    p = {r.destination_stop_id: (r.avg, r.std) for r in matrix.baseline_positive_days(od, 3).collect()}
    assert p == {"b": (3.0, pytest.approx(math.sqrt(2))), "c": (5.0, 0.0)}
    back = matrix.long(matrix.wide(od)).select(od.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, od.collect()))
    other = od.withColumn("hour", F.lit(None).cast("int"))
    assert {r.side for r in matrix.compared(other, other, ["date", "hour"]).collect()} == {"both"}


def test_radius_join(spark):
    rng = random.Random(2)
    pts = [(f"s{i}", 36.3 + rng.uniform(0, 0.02), 128.0 + rng.uniform(0, 0.02)) for i in range(120)] + [("none", None, 1.0), ("twin", 36.3, 128.0), ("twin2", 36.3, 128.0)]
    df = spark.createDataFrame(pts, "id string, lat double, lon double")
    got = {(r.from_id, r.to_id) for r in spatial.radius_join(df, "id", "lat", "lon", 250.0).collect()}
    ok = [p for p in pts if p[1] is not None]
    k = 111_320 * math.cos(math.radians(round(sum(p[1] for p in ok) / len(ok), 6)))
    want = {(a[0], b[0]) for a in ok for b in ok if math.hypot((a[2] - b[2]) * k, (a[1] - b[1]) * 110_540) <= 250 + 1e-9}
    assert got == want
    assert spatial.radius_join(df.limit(0), "id", "lat", "lon", 250.0).count() == 0


def _search(legs, walks, o, d):
    """All paths with up to two transfers and no route twice."""
    out = {}

    def go(at, routes, sig, score):
        if at == d:
            key = ";".join(sig)
            out[key] = min(score, out.get(key, 1e9))
            return
        if len(routes) == 3:
            return
        for r, b, a, m in legs:
            if r in routes or a == o:
                continue
            if not routes and b == o:
                go(a, [r], [f"{r}|{b}|{a}"], m)
            elif routes and (at, b) in walks:
                go(a, [*routes, r], [*sig, f"{r}|{b}|{a}"], score + walks[at, b] / (4000 / 60) + 4 + m)

    go(None, [], [], 0.0)
    return out


def test_candidate_paths_are_exhaustive(spark):
    rng = random.Random(3)
    stops = "abcdefg"
    legs = list({(f"r{rng.randint(1, 5)}", *rng.sample(stops, 2)): None for _ in range(22)})
    legs = [(r, b, a, float(rng.randint(1, 20))) for r, b, a in legs]
    walks = {(s, s): 0.0 for s in stops} | {("b", "c"): 100.0, ("c", "b"): 100.0, ("e", "f"): 240.0}
    ldf = spark.createDataFrame([(7, *x) for x in legs], "hour int, route_id string, board string, alight string, minutes double")
    wdf = spark.createDataFrame([(a, b, m) for (a, b), m in walks.items()], "from_stop_id string, to_stop_id string, distance_m double")
    ods = [(7, o, d) for o in stops for d in stops if o != d]
    got = {}
    for r in routing.candidate_paths(spark.createDataFrame(ods, "hour int, origin string, destination string"), ldf, wdf, limit=10_000, labels=10_000).collect():
        got.setdefault((r.origin, r.destination), {})[r.signature] = r.score
    for _, o, d in ods:
        assert got.get((o, d), {}) == pytest.approx(_search(legs, walks, o, d), abs=1e-5)


def _paths(legs, walks, origin, destination, limit):
    """The limit best (score, signature) by trying all."""
    out = []

    def go(at, routes, sig, score):
        for (a, b), metres in walks.items():
            if a != at or b == destination:
                continue
            for r, board, alight, minutes, wait in legs:
                if board != b or r in routes or alight == origin:
                    continue
                now = score + metres / (4000 / 60) + (4 if routes else 0) + minutes + wait
                to = [*sig, f"{r}|{board}|{alight}"]
                if (alight, destination) in walks:
                    out.append((round(now + walks[alight, destination] / (4000 / 60), 4), ";".join(to)))
                if alight != destination and len(routes) < 2:
                    go(alight, [*routes, r], to, now)

    go(origin, [], [], 0.0)
    return sorted(out)[:limit]


def test_generated_paths_are_the_best_of_all(spark):
    rng = random.Random(5)
    stops = "abcdefg"
    legs = [(r, *x, rng.randint(1, 9_000) / 100, {"r1": 3.0, "r2": 7.5}.get(r, 1.25)) for r, *x in {(f"r{rng.randint(1, 7)}", *rng.sample(stops, 2)): None for _ in range(60)}]
    # Five routes from o to x and a sixth on to d: five paths, of which four labels at x keep four. From y one walks to o first.
    legs += [(f"s{i}", "o", "x", float(i), 1.0) for i in range(1, 6)] + [("s6", "x", "d", 5.0, 2.0)]
    walks = {(s, s): 0.0 for s in stops + "oxy"} | {("b", "c"): 100.0, ("c", "b"): 100.0, ("e", "f"): 240.0, ("y", "o"): 150.0}
    ldf = spark.createDataFrame([(7, *x) for x in legs], "hour int, route_id string, board string, alight string, minutes double, wait double")
    wdf = spark.createDataFrame([(a, b, m) for (a, b), m in walks.items()], "from_stop_id string, to_stop_id string, distance_m double")
    ods = [(7, o, d) for o in stops + "oy" for d in stops if o != d]
    got = {}
    for r in routing.generated_paths(spark.createDataFrame(ods, "hour int, origin string, destination string"), ldf, wdf).orderBy("rank").collect():
        got.setdefault((r.origin, r.destination), []).append((round(r.score, 4), r.signature))
    for _, o, d in ods:
        assert got.get((o, d), []) == _paths(legs, walks, o, d, 15)
    assert sum(s.endswith(";s6|x|d") and s.count(";") == 1 for _, s in got["o", "d"]) == 5
    assert any(s.startswith("s1|o|x") for _, s in got["y", "d"])


def test_unique_fails_on_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert groups.unique(df, ["k"], "t").count() == 2
    with pytest.raises(Exception, match="occurs more than once"):
        groups.unique(df.union(df), ["k"], "t").count()


def test_values(spark):
    df = spark.createDataFrame([(" 1,234.5 ", "Yes"), ("nan", "예"), ("1e999", "no"), ("x", None), (None, "T ")], "a string, b string")
    got = [tuple(r) for r in df.select(values.to_float(F.col("a")), values.to_bool(F.col("b"))).collect()]
    assert got == [(1234.5, True), (None, True), (None, False), (None, False), (None, True)]
    m = spark.createDataFrame([(600.0,), (1200.0,), (30.0,)], "v double")
    assert sorted(r.m for r in values.as_minutes(m, "v", "m").collect()) == [0.5, 10.0, 20.0]
    d = spark.createDataFrame([("20260302",), ("20260310",)], "d string")
    assert sorted(r.date for r in values.calendar(d, "d", (1, 2)).collect()) == ["20260303", "20260304", "20260310"]
    assert values.calendar(d.limit(0), "d", (1,)).count() == 0


def test_once_a_session(spark, tmp_path):
    """Derived again if a file changes or the shared folder loses its marker, else kept."""
    from tramline.session import _kept, once

    spark.range(3).write.parquet(str(tmp_path / "t"))
    made = []
    get = lambda: once(spark, "n", [str(tmp_path / "t")], lambda: made.append(1) or len(made))
    assert (get(), get()) == (1, 1)
    spark.range(5).write.mode("append").parquet(str(tmp_path / "t"))
    assert (get(), get()) == (2, 2)
    marker = next(m for k, (v, m) in _kept.items() if k[1] == "n" and v == 2)
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)
    assert get() == 3
