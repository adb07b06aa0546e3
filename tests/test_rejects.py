import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tramline.operators import rejects as R

GOOD = '20260302,9100,1,20260302180310,20260302181315,1,105,0,100100524,103000720,119000683,1.0,"Bay ""2"", east"'
SCHEMA = "line_id long, feed string, file_name string, line_no int, raw_text string"


def found(spark, lines, feed="legs", block=2048):
    df = spark.createDataFrame([(i, feed, "f", i, x) for i, x in enumerate(lines)], SCHEMA)
    return {r.line_id: (r.reason, r.field) for r in R.rejected(R.parse_lines(df, block=block)).collect()}


def test_reasons(spark):
    lines = [
        GOOD,
        GOOD + "\r",
        GOOD.replace("103000720", " 103000720.0\t"),
        GOOD.replace("20260302,9100", "20260230,9100"),
        GOOD.replace("9100", " "),
        GOOD.replace("20260302180310", "2026030224"),
        GOOD.replace("103000720", "10300072"),
        GOOD.replace(",1.0,", ",0.0,"),
        GOOD.replace(",1.0,", ",1.,"),
        GOOD + ",x",
        GOOD.rsplit(",", 2)[0],
        GOOD[:-1],
        GOOD.replace("9100", '9"100'),
        GOOD.replace("9100", '"9100"x'),
        "",
        None,
        GOOD.replace("20260302180310", "2026-03-02 18:03:10.0"),
        GOOD.replace("9100", "９１００"),
        GOOD.replace("20260302,9100", "２0260302,9100"),
    ]
    got = found(spark, lines)
    assert got == {
        3: ("not a real date", "service_date"), 4: ("empty", "card_id"), 5: ("unreadable time", "ride_dtm"), 6: ("not a nine-digit stop id", "origin_stop_id"), 7: ("not a number above 0", "passengers"),
        8: ("not a number above 0", "passengers"), 9: ("too many fields", None), 10: ("too few fields", None), 11: ("quote not closed", None), 12: ("quote inside an open field", None), 13: ("text after a closing quote", None),
        14: ("too few fields", None), 15: ("no line", None), 18: ("not a real date", "service_date"),
    }
    assert found(spark, lines, block=3) == got


def test_unknown_feed_empty_and_clashing_columns(spark):
    assert found(spark, [GOOD], "other") == {0: ("unknown feed", "feed")}
    assert found(spark, [GOOD], None) == {0: ("unknown feed", "feed")}
    assert found(spark, []) == {}
    df = spark.createDataFrame([(None, "legs", None, None, GOOD, "x", 1.0)], SCHEMA + ", reason string, passengers double")
    row = R.loaded(R.parse_lines(df), R.LEGS).first()
    assert row.line_id is None and row.passengers == 1.0 and row.source_label == 'Bay "2", east'


def test_long_line_and_break_in_field(spark):
    long = GOOD.replace('"Bay ""2"", east"', "y" * 3_000_000)
    broken = GOOD.replace("Bay", "Bay\nfoo")
    df = spark.createDataFrame([(1, "legs", "f", 1, long), (2, "legs", "f", 2, broken)], SCHEMA)
    rows = {r.line_id: r.source_label for r in R.loaded(R.parse_lines(df), R.LEGS).collect()}
    assert len(rows[1]) == 3_000_000 and rows[2] == 'Bay\nfoo "2", east'


fields = st.lists(st.sampled_from(["20260302", '"20260303"', "5", " 23 ", "24", "103000720", '"103000720.0"', "1", "0", "2.50", '"', '""', "x", "", "20260231", '"1"2']), min_size=4, max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(fields, min_size=1, max_size=5))
def test_block_agrees_with_strict(rows):
    """A block that the bulk path takes has only lines that the strict reader takes, with the same values."""
    lines = [",".join(r) for r in rows]
    good, cols, isolated = R.parse_block(pa.array(lines, pa.string()), R.DAILY_OD)
    assert sorted([*good, *isolated]) == list(range(len(lines)))
    for k, i in enumerate(good):
        reason, _, values = R.diagnose(lines[i], R.DAILY_OD)
        assert reason is None and values == [c[k].as_py() for c in cols]
    for i in isolated:
        assert R.diagnose(lines[i], R.DAILY_OD)[0] is not None


def test_only_bad_records_are_isolated():
    """Stray quotes swallow lines, and still every good record stays on the columnar path."""
    lines = [GOOD] * 3000
    bad = {7: GOOD[:-1], 8: GOOD[:-1], 40: '"' + GOOD, 41: GOOD + ",", 900: GOOD.replace("9100", '9"100'), 901: GOOD.replace("9100", '"9100"x'), 2999: GOOD.replace(",1.0,", ",0,")}
    for i, x in bad.items():
        lines[i] = x
    good, cols, isolated = R.parse_block(pa.array(lines, pa.string()), R.LEGS)
    assert set(isolated.tolist()) == set(bad) and len(good) == len(cols[0]) == 3000 - len(bad)
