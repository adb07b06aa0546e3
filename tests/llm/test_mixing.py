from pyspark.sql import functions as F

from tramline.llm import mixing

SIZES = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, sizes, targets, **kw):
    s = spark.createDataFrame(sizes, SIZES).withColumn("copies", F.lit("clash"))
    p = mixing.plan(s, spark.createDataFrame(targets, TARGETS), **kw)
    m = mixing.mix(s, p)
    return m.collect(), {r.source: r for r in mixing.shares(m, p).collect()}, m


def test_shares_are_met(spark):
    sizes = [(i, "big", 50 + i % 300) for i in range(20_000)] + [(i, "small", 10 + i % 90) for i in range(20_000, 21_000)] + [(i, "tiny", 7) for i in range(30_000, 30_010)] + [(40_000, None, 99), (40_001, "big", 0)]
    rows, by, m = run(spark, sizes, [("BIG ", 0.4, 1), ("small", 0.05, 5), ("Tiny", 0.3, 3), ("absent", 0.2, 9), ("null", 0.05, None)])
    assert abs(by["big"].share_of_total - 0.4) < 0.001 and by["big"].most_repeats == 1 and by["big"].reached
    assert abs(by["small"].share_of_total - 0.05) < 0.001 and 3 <= by["small"].most_repeats <= 5
    assert by["tiny"].most_repeats == 3 and by["tiny"].docs == 10 and not by["tiny"].reached
    assert by["absent"].actual_tokens == 0 and not by["absent"].reached
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.repeats >= 1 and r.n_tokens > 0 for r in rows)
    assert {r.doc_id: r.repeats for r in m.collect()} == {r.doc_id: r.repeats for r in rows}
    assert abs(sum(r.actual_share for r in by.values()) - 1) < 1e-9


def test_cut_bin_is_exact(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 1)  # all documents in the one bin that is ordered by rows
    sizes = [(i, "a", 10) for i in range(1000)]
    rows, by, _ = run(spark, sizes, [("a", 0.25, 1)])
    assert len(rows) == 250 and by["a"].actual_tokens == 2500
    monkeypatch.setattr(mixing, "BINS", 1 << 16)
    more, _, _ = run(spark, sizes, [("a", 0.25, 1)])
    assert {r.doc_id for r in more} == {r.doc_id for r in rows}


def test_given_total_whole_copies_and_nothing(spark):
    sizes = [(i, "a", 10) for i in range(100)]
    rows, by, _ = run(spark, sizes, [("a", 1.0, 9)], total_tokens=2500)
    assert by["a"].actual_tokens == 2500 and {r.repeats for r in rows} == {2, 3}
    rows, by, _ = run(spark, sizes, [("a", 1.0, 2)], total_tokens=2500)
    assert by["a"].actual_tokens == 2000 and not by["a"].reached
    rows, by, _ = run(spark, [], [("a", 1.0, 2)])
    assert rows == [] and by["a"].docs == 0
    rows, by, _ = run(spark, sizes, [])
    assert rows == [] and by == {}


def test_weights_make_inclusion_unequal(spark):
    s = spark.createDataFrame([(i, "a", 10, [None, 0.5, 1.0, 4.0][i % 4]) for i in range(8000)], SIZES + ", quality double")
    p = mixing.plan(s, spark.createDataFrame([("a", 0.2, 1)], TARGETS))
    got = mixing.mix(s, p, weight="quality").collect()
    n = [sum(r.doc_id % 4 == k for r in got) for k in range(4)]
    assert len(got) == 1600 and n[0] == 0 and n[1] < n[2] < n[3] and n[3] > 2.5 * n[2]


def test_inclusion_rates_match_the_odds(spark):
    """Over many seeds each document is chosen as often as its weight says, capped ones always, and every sample has the target's size."""
    weights = [1, 2, 4, 8, 16, 400]
    s = spark.createDataFrame([(i, "a", 10, float(weights[i % 6])) for i in range(120)], SIZES + ", quality double")
    p = mixing.plan(s, spark.createDataFrame([("a", 0.5, 1)], TARGETS))
    n = [0] * 6
    for seed in range(40):
        got = mixing.mix(s, p, seed=seed, weight="quality").collect()
        assert len(got) == 60 and {r.repeats for r in got} == {1}
        for r in got:
            n[r.doc_id % 6] += 1
    # 400 is capped at once; the other 40 of 60 are spread by weight: 16 and then 8 would pass 1, too.
    rates = [k / (40 * 20) for k in n]
    assert rates[5] == 1.0
    want = [c / 31 * 2 for c in (1, 2, 4, 8, 16)]
    while max(want) > 1:  # plain water filling
        full = [x >= 1 for x in want]
        left = 2 - sum(full)
        free = sum(w for w, f in zip(weights, full) if not f)
        want = [1.0 if f else left * w / free for w, f in zip(weights, full)]
    for got_rate, w in zip(rates, want):
        assert abs(got_rate - w) < 0.08, (rates, want)


def test_capped_documents_leave_the_rest_to_others(spark):
    s = spark.createDataFrame([(0, "a", 100, 1e6)] + [(i, "a", 10, 1.0) for i in range(1, 91)] + [(100, "a", 5, float("nan")), (101, "a", 5, None), (102, "a", 5, float("inf")), (103, "a", 5, -1.0)], SIZES + ", quality double")
    p = mixing.plan(s, spark.createDataFrame([("a", 1.0, 3)], TARGETS), total_tokens=1200)
    got = {r.doc_id: r.repeats for r in mixing.mix(s, p, weight="quality").collect()}
    assert got[0] == 3 and all(i < 100 for i in got) and sum(10 * n for i, n in got.items() if i) == 900
