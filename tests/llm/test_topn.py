import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tramline.llm import topn


def brute(rows, n):
    last = lambda v: (v is None or v != v, 0 if v is None or v != v else v)
    groups = {}
    for g, h, s, t, i in rows:
        desc = last(s)
        groups.setdefault((g, h), set()).add(((desc[0], -desc[1]), last(t), (i is None, i or ""), (g, h, i)))
    return [k for v in groups.values() for *_, k in sorted(v, key=lambda x: x[:3])[:n]]


def test_against_brute_force(spark):
    rng = random.Random(7)
    value = lambda: rng.choice([None, float("nan"), 0.0, -0.0, -1.5, 2.0, 2.0, 7.25, 1e300])
    rows = [(rng.choice([None, -3, 0, 5, 2**40]), rng.choice([None, 1, 2]), value(), rng.choice([None, 1, -1, 2]), rng.choice(["a", "b", "ab", "a\x00", "é", "𝄞", "ﬁ", "", None])) for _ in range(600)]
    rows += [(9, 9, float(i % 50), i, f"s{i:05d}") for i in range(3000)] + rows[:50]
    df = spark.createDataFrame(rows, "g long, h int, score double, t int, item string").withColumns({"rank": F.lit(0), "bucket": F.lit(1), "run": F.lit("x")})
    for n in (1, 3, 5):
        for parts in (1, 7):
            got = topn.top_n(df.repartition(parts), ["g", "h"], [("score", True), ("t", False)], "item", n, buckets=5).collect()
            assert sorted(map(repr, ((r.g, r.h, r.item) for r in got))) == sorted(map(repr, brute(rows, n)))
            assert all(1 <= r["rank"] <= n for r in got)


def test_runs_are_cut_without_loss(spark, monkeypatch):
    rows = [(i % 3, float(i % 17), f"x{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, s double, item string")
    whole = {tuple(r) for r in topn.top_n(df, ["g"], [("s", True)], "item", 4).collect()}
    rank = sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
    want = {(g, s, i, k + 1) for g0 in range(3) for k, (g, s, i) in enumerate([r for r in rank if r[0] == g0][:4])}
    assert whole == want


def test_text_groups_and_empty(spark):
    df = spark.createDataFrame([("b", 1.0, "x"), ("a", 2.0, "y"), ("a\x00", 3.0, "z"), (None, 1.0, "w"), ("a", 2.0, "y")], "g string, s double, item string")
    got = topn.top_n(df, ["g"], [("s", True)], "item", 2)
    assert {(r.g, r["item"]) for r in got.collect()} == {("b", "x"), ("a", "y"), ("a\x00", "z"), (None, "w")}
    assert topn.top_n(df.limit(0), ["g"], [("s", True)], "item", 2).count() == 0


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in (1, 2, 3, 5, 8, 13):
        runs = [sorted(bytes(rng.choices(b"abc", k=3)) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        tree, out = topn.LoserTree(runs), []
        while (won := tree.least()) is not None:
            out.append(won[1])
            tree.move(won[0], tree.at[won[0]] + 1)
        assert out == sorted(x for r in runs for x in r)


def _blocks(runs, size):
    out = []
    for r, run in enumerate(runs):
        firsts = [run[i] for i in range(0, len(run), size)]
        out.append(topn.Block(r, b"", firsts[0] if firsts else None, None))
        out += [topn.Block(r, f, firsts[k + 1] if k + 1 < len(firsts) else None, b"".join(run[k * size : (k + 1) * size])) for k, f in enumerate(firsts)]
    return iter(sorted(out, key=lambda b: (b.first, b.run)))


def test_bucket_of_many_blocks():
    """Of a bucket far larger than what may be open, one block a run is open, and blocks of finished groups stay shut."""
    rng = random.Random(2)
    runs = [sorted({bytes([rng.choice(b"abbbbbbbbc")]) + rng.randbytes(3) for _ in range(rng.choice([0, 1, 400, 3000]))}) for _ in range(12)]

    def keys_of(packed):
        keys = [packed[i : i + 4] for i in range(0, len(packed), 4)]
        return keys, [k[:1] for k in keys], keys

    for size in (1, 7, 64):
        m = topn.Merge(5, keys_of)
        got = [(rows[i], rank) for rows, i, rank in m.taken(_blocks(runs, size))]
        want = [(k, n + 1) for g in b"abc" for n, k in enumerate(sorted({k for r in runs for k in r if k[0] == g})[:5])]
        assert got == want and m.most_open <= len(runs)
        assert m.passed > m.opened if size == 7 else m.opened > 0


def test_decimals_dates_and_truth_values(spark):
    rows = [(i % 2, Decimal(v), dt.date(2026, 3, 1 + i % 9), i % 3 == 0, f"x{i}") for i, v in enumerate(["-99999999999999999999.5", "0.0", "12345678901234567890123.25", "-0.25", "3.5", "3.5", "2.0", "1.75"])]
    rows += [(0, None, None, None, "none"), (1, None, dt.date(1960, 1, 1), True, "old")]
    df = spark.createDataFrame(rows, "g int, v decimal(38,2), d date, b boolean, item string")
    for order in ([("v", True), ("d", False)], [("v", False), ("b", True)], [("d", True), ("b", False)]):
        got = {(r.g, r["rank"]): r["item"] for r in topn.top_n(df, ["g"], order, "item", 3).collect()}
        num = lambda v: Decimal(v) if isinstance(v, (bool, int, Decimal)) else Decimal(v.toordinal())
        key = lambda r: tuple((r[c] is None, (-num(r[c]) if desc else num(r[c])) if r[c] is not None else 0) for c, desc in order) + (r["item"],)  # noqa: B023, E731
        for g in (0, 1):
            best = sorted((r for r in df.collect() if r.g == g), key=key)[:3]
            assert [got[g, k + 1] for k in range(3)] == [r["item"] for r in best]
    assert topn.top_n(df.limit(0), ["g"], [("v", True)], "item", 3).count() == 0
