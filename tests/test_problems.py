"""The general data problems on small cases with a known answer."""

import itertools
import random

from pyspark.sql import functions as F

from tramline.functions.clean import clean_id, clean_route, readable_time, service_day
from tramline.operators import drift, hotkeys, intervals
from tramline.operators.orphans import OrphanState, parent_events


def test_clean_ids(spark):
    given = [" 12.0\t", "12.0.0", "a.0", "", " nan", "None", "NULL", None, "0", "x", "00", "٣.0"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").select("i", clean_id("v").alias("a"), clean_route("v").alias("b")).orderBy("i")
    rows = [tuple(r)[1:] for r in df.collect()]
    assert rows == [("12", "12"), ("12.0.0", "12.0.0"), ("a.0", "a.0"), (None, None), (None, None), (None, None), (None, None), (None, None), ("0", None), ("x", None), ("00", "00"), ("٣.0", "٣.0")]


def test_readable_times(spark):
    given = {"20260302180310": "20260302180310", "2026-03-02 18:03": "20260302180300", "2026030218.0": "20260302180000", "2026-03-02T24:00:00": None, "20260231000000": None, "202603021": None, "00000101000000": None, "20240229235959": "20240229235959", "20230229": None, None: None, "": None, "2026030218.00": "20260302180000", "20260302186000": None}
    df = spark.createDataFrame([(k,) for k in given], "v string").select("v", readable_time("v").alias("t"))
    assert {r.v: r.t for r in df.collect()} == given
    days = spark.createDataFrame([("20260302.0", "x"), ("2026-03-02", "2026-03-04 10"), (None, "20"), ("nan", None)], "d string, r string")
    assert [r[0] for r in days.select(service_day("d", "r")).collect()] == ["20260302", "20260304", None, None]


def test_hot_keys(spark):
    rows = [("a", 1.0)] * 97 + [("b", None), ("b ", float("nan")), (None, 5.0)]
    df = spark.createDataFrame(rows, "key string, total double").withColumn("n_rows", F.lit("clash"))
    t = hotkeys.key_totals(df, "t", clean_id("key"), F.col("total"))
    assert {(r.key_value, r.n_rows, r.total) for r in t.collect()} == {("a", 97, 97.0), ("b", 2, None), (None, 1, 5.0)}
    assert {r.key_value for r in hotkeys.heavy_keys([t], 0.02).collect()} == {"a", "b"}
    assert hotkeys.heavy_keys([hotkeys.key_totals(df.limit(0), "t", clean_id("key"), F.col("total"))], 0.02).count() == 0


def _drift(spark, files, aliases=(("card_id", "카드ID"), ("card_id", "CARD"))):
    rows = [(f"f{d}", d, j) for d, js in files for j in js]
    rec = spark.createDataFrame([(i, "feed", f, d, j, "x") for i, (f, d, j) in enumerate(rows)], "record_id long, feed string, file_name string, file_date string, record_json string, header string")
    names = drift.alias_table(spark.createDataFrame(list(aliases), "canonical_name string, alias string"))
    return rec, names, drift.file_schemas(rec, names)


def test_schema_drift(spark):
    files = [
        ("20260301", ['{"카드ID": 1, "a": null, "b": 1, "c": "x", "e": true}']),
        ("20260303", ['{" \\ufeffCard ": "7", "a": 1, "b": 2.5, "c": null, "d": 1}', '{"b": 3}', "not json", None]),
        ("20260302", ['{"CARD": 2, "a": 1, "b": 1, "c": "x", "e": 3, "e": false}']),
        ("20260304", []),
    ]
    rec, names, schemas = _drift(spark, files)
    got = {(r.file_name, r.field_name, r.change_kind, r.before, r.after) for r in drift.changes(schemas).collect()}
    assert got == {
        ("f20260302", "card_id", "renamed", "카드id", "card"), ("f20260302", "e", "retyped", "boolean", "text"), ("f20260303", "card_id", "retyped", "integer", "text"),
        ("f20260303", "b", "retyped", "integer", "decimal"), ("f20260303", "d", "added", None, "d"), ("f20260303", "e", "removed", "e", None),
    }
    types = drift.union_schema(schemas, ["card_id", "a", "b", "c", "e", "gone"])
    assert types == {"card_id": "string", "a": "decimal(38,0)", "b": "decimal(38,12)", "c": "string", "e": "string", "gone": "string"}
    rows = [(r.card_id, r.a and int(r.a), r.b, r.c, r.e) for r in drift.unified(rec, schemas, types).orderBy("record_id").collect()]
    assert rows == [("1", None, 1.0, "x", "true"), ("7", 1, 2.5, None, None), (None, None, 3.0, None, None), (None,) * 5, (None,) * 5, ("2", 1, 1.0, "x", "3")]


def test_digits_are_kept_and_misfits_told(spark):
    files = [("20260301", ['{"a": 12345678901234567890123}', '{"a": 1.5}', '{"a": 1e30}', '{"a": null}'])]
    rec, _, schemas = _drift(spark, files)
    rows = drift.unified(rec, schemas, drift.union_schema(schemas, ["a"])).orderBy("record_id").collect()
    assert [(r.a and str(r.a), r.unfit) for r in rows] == [("12345678901234567890123.000000000000", []), ("1.500000000000", []), (None, ["a"]), (None, [])]


def test_p4_legs_hold_every_value(spark, tmp_path):
    """Every leg field and canonical name has a column; what no column holds is in rest, what can't be read in unread."""
    from tramline.plans import problems

    records = [
        '{"CARD": 1, "source_label": "GATE-1", "FARE": 1200, "new_route_id": "r1", "is_child": true, "card_id": 2, "Card": 1, "passengers": 1.5, "feed": "x", "Route_ID": "r0"}',
        '{"passengers": 0.1234567890123456789, "gate": {"no": [1, 2.50, "a", {}, []]}, "fare": null, "serial_num": 15e-1, "Feed_": "y", "mode_code": ""}',
        '{"passengers": 1e30, "serial_num": 20e-1, "odd": "\\ud800", "deep": ' + "[" * 500 + "]" * 500 + "}",
        "not json",
        "[]",
        None,
    ]
    spark.createDataFrame([(i, "f", "a", "20260301", r) for i, r in enumerate(records)], "record_id long, feed string, file_name string, file_date string, record_json string").write.parquet(f"{tmp_path}/leg_files.parquet")
    aliases = [("card_id", "CARD"), ("fare.amount", "FARE"), ("feed", "Feed_"), ("never", "x"), ("line", "ROUTE_ID")]
    spark.createDataFrame(aliases, "canonical_name string, alias string").write.parquet(f"{tmp_path}/field_aliases.parquet")
    df = problems.p4_legs(spark, str(tmp_path))
    assert set(problems.rejects.LEGS.fields) <= set(df.columns) and "fare.amount" in df.columns and "never" not in df.columns and df.columns.count("feed") == 1
    rows = df.orderBy("record_id").collect()
    assert [(r["card_id"], r["source_label"], r["fare.amount"], r["line"], r["route_id"], r["mode_code"], r["feed"]) for r in rows[:2]] == [(1, "GATE-1", 1200, "r0", None, None, "f"), (None, None, None, None, None, "", "f")]
    assert [r.passengers and str(r.passengers) for r in rows[:3]] == ["1.500000000000", "0.123456789012", None] and rows[2].serial_num == 2
    assert [sorted(map(tuple, r.rest)) for r in rows] == [
        [("card_id", "2"), ("feed", "x"), ("is_child", "true"), ("new_route_id", "r1")],
        [("feed", "y"), ("gate", '{"no": [1, 2.50, "a", {}, []]}'), ("passengers", "0.1234567890123456789"), ("serial_num", "15e-1")],
        [("deep", "[" * 500 + "]" * 500), ("odd", "\ufffd"), ("passengers", "1e30")], [], [], [],
    ]
    assert [sorted(r.unfit) for r in rows] == [[], ["passengers", "serial_num"], ["passengers"], [], [], []]
    assert [r.unread for r in rows] == [None, None, None, "not json", "[]", None]


def test_p4_legs_of_the_given_files(spark, sf):
    """Read apart from drift: the values of each record, by field, are those of its row."""
    import json
    from collections import Counter
    from decimal import Decimal

    from tramline.plans import problems

    names = {a.lower(): c for c, a in spark.read.parquet(f"{sf}/field_aliases.parquet").select("canonical_name", "alias").collect()}
    text = lambda v: ("true" if v else "false") if isinstance(v, bool) else str(v)
    want = {}
    for i, record in spark.read.parquet(f"{sf}/leg_files.parquet").select("record_id", "record_json").collect():
        pairs = [(h.replace("\ufeff", "").strip().lower(), v) for h, v in json.loads(record, parse_int=str, parse_float=Decimal, object_pairs_hook=list)]
        want[i] = Counter((names.get(h, h), text(v)) for h, v in pairs if v is not None)
    rows = problems.p4_legs(spark, sf).collect()
    assert len(rows) == len(want)
    fields = problems.rejects.LEGS.fields
    for r in rows:
        assert not r.unfit and r.unread is None
        got = Counter((f, v) for f, v in r.rest)
        got.update((f, text(r[f])) for f in fields if r[f] is not None and not isinstance(r[f], Decimal))
        numbers = Counter((f, r[f]) for f in fields if isinstance(r[f], Decimal))
        left = want[r.record_id] - got
        assert not got - want[r.record_id] and Counter((f, Decimal(v)) for f, v in left.elements()) == numbers


def test_drift_of_nothing(spark):
    _, _, schemas = _drift(spark, [])
    assert drift.changes(schemas).count() == 0
    _, _, schemas = _drift(spark, [("20260301", ["{}"]), (None, ['{"a": 1}']), ("20260302", ['{"a": [1]}', '{"a": {"b": 2}}'])])
    assert {(r.file_name, r.field_name, r.change_kind) for r in drift.changes(schemas).collect()} == {("f20260301", "a", "removed"), ("f20260302", "a", "added")}


def _orphans(refs, parents):
    """Brute force: references no parent of which is valid on the day."""
    return {(k, d) for k, d in refs if k and d and not any(p == k and (a or "") <= d and (z is None or d < z) for p, a, z in parents)}


def test_orphans_in_any_order(spark):
    rng = random.Random(3)
    days = [f"202603{d:02d}" for d in range(1, 11)]
    parents = [(rng.choice("abcd"), rng.choice([None, *days]), rng.choice([None, None, *days])) for _ in range(12)]
    refs = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.choice(days)) for _ in range(80)] + [("e", None)]
    pdf = spark.createDataFrame(parents, "stop string, a string, z string")
    events = parent_events(pdf, F.col("stop"), F.col("a"), F.col("z"))
    r = spark.createDataFrame(refs, "key string, day string").withColumn("live", F.lit("clash"))
    for plan in itertools.permutations(["r1", "r2", "e1", "e2"], 4):
        if plan[0] > plan[1]:
            continue
        s = OrphanState(spark, buckets=2)
        for step in plan:
            half = F.abs(F.hash("key", "day" if step[0] == "r" else "from_day")) % 2 == int(step[1]) - 1
            s.advance(refs=r.filter(half | F.col("key").isNull() & (F.lit(step[1]) == "1"))) if step[0] == "r" else s.advance(events=events.filter(half))
        assert {(x.key, x.day) for x in s.pending().collect()} == _orphans(refs, parents)
        assert sum(x.n_refs for x in s.snapshot().collect()) == sum(1 for k, d in refs if k and d)
        if plan[0] == "e1":
            break


def test_orphans_resolve_and_reopen(spark):
    s = OrphanState(spark)
    ref = spark.createDataFrame([("a", "20260305")], "key string, day string")
    ev = lambda *rows: spark.createDataFrame(list(rows), "key string, from_day string, change long")
    assert s.advance(refs=ref).pending().count() == 1
    assert s.advance(events=ev(("a", "20260301", 1))).pending().count() == 0
    assert s.advance(events=ev(("a", "20260306", -1))).pending().count() == 0
    assert s.advance(events=ev(("a", "20260305", -1))).pending().count() == 1
    assert s.advance(refs=ref.limit(0), events=ev(("b", "", 1))).pending().count() == 1
    old = s.snapshot()
    again = OrphanState(spark, s.path)
    assert again.batch == 5 and again.pending().count() == 1
    for _ in range(4):  # beyond a new base
        again.advance(refs=ref)
    assert again.base == 8 and again.advance(events=ev(("a", "20260305", 1))).pending().count() == 0
    assert [(r.n_refs, r.n_orphans) for r in again.snapshot().collect()] == [(5, 0)] and [(r.n_refs, r.n_orphans) for r in old.collect()] == [(1, 1)]


def _merge(iv):
    out = []
    for s, e in sorted(x for x in iv if x[0] is not None and x[1] is not None and x[1] > x[0]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def test_intervals_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice([1, 1, 2]), s, s + rng.randint(-2, 6)) for s in (rng.randint(0, 120) for _ in range(120))]
    rows += rows[:10] + [("a", 1, None, 5), ("a", None, 1, 5), (None, 1, 1, 5), ("d", 1, 1, 9), ("d", 1, 9, 12), ("e", 1, 3, 3)]
    df = spark.createDataFrame(rows, "k string, d int, s int, e int").withColumn("side", F.lit(9)).withColumn("rank", F.lit(9))
    want = {}
    for k, d, s, e in rows:
        if k and d:
            want.setdefault((k, d), []).append((s, e))
    p = {(k, d, s, e) for (k, d), iv in want.items() for s, e in _merge(iv)}
    g = {(k, d, a[1], b[0]) for (k, d), iv in want.items() for a, b in itertools.pairwise(_merge(iv))}
    assert {tuple(r) for r in intervals.periods(df, ["k", "d"], "s", "e").collect()} == p
    assert {tuple(r) for r in intervals.gaps(df, ["k", "d"], "s", "e").collect()} == g
    for span in (1, 7, 1000):  # an entity's time cut into stretches
        assert {tuple(r) for r in intervals.periods(df, ["k", "d"], "s", "e", span).collect()} == p and {tuple(r) for r in intervals.gaps(df, ["k", "d"], "s", "e", span).collect()} == g
    assert intervals.gaps(df.limit(0), ["k", "d"], "s", "e").count() == 0 == intervals.periods(df.limit(0), ["k", "d"], "s", "e").count()


def test_orphan_batches_cover_all(spark):
    """No time of loading, a very long time, or none at all: every reference is probed."""
    import datetime as dt

    from tramline.plans.problems import _orphan_state

    events = spark.createDataFrame([("a", "", 1), ("b", "20260310", 1), ("c", "20990101", 1)], "key string, from_day string, change long")
    rows = [("a", "20260301"), ("b", "20260301"), ("b", "20260311"), ("c", "20260301")]
    for times in ([None] * 4, [None, dt.date(1970, 1, 1), dt.date(2026, 3, 2), dt.date(2099, 1, 1)], [dt.date(2026, 3, 2)] * 4):
        refs = spark.createDataFrame([("f", *r, t) for r, t in zip(rows, times, strict=True)], "field_name string, key string, day string, loaded_on date")
        s = _orphan_state(refs, events)
        assert {(r.key, r.day) for r in s.pending().collect()} == {("b", "20260301"), ("c", "20260301")}
        assert sum(r.n_refs for r in s.snapshot().collect()) == 4
    assert _orphan_state(refs.limit(0), events).pending().count() == 0


def test_hot_keys_with_boundless_measures(spark):
    df = spark.createDataFrame([("a", 1e300), ("a", float("inf")), ("a", 2.5)], "key string, m double")
    assert hotkeys.key_totals(df, "t", F.col("key"), F.col("m")).first().total == 2.5


def test_p5_snapshots(spark, sf):
    """One per batch; the last agrees with the final state, the references only grow."""
    from tramline.plans import problems

    shots = problems.p5_snapshots(spark, sf).groupBy("loaded_until").agg(F.sum("n_refs").alias("n"), F.sum("n_orphans").alias("o")).orderBy("loaded_until").collect()
    final = problems.p5_by_day(spark, sf).agg(F.sum("n_refs"), F.sum("n_orphans")).first()
    assert len(shots) > 1 and [r.n for r in shots] == sorted(r.n for r in shots)
    assert (shots[-1].n, shots[-1].o) == tuple(final)
