"""Every core query against its SQL on the smallest tables."""

import pytest
from compare import compare

from tramline.plans import candidates, choice, days, oracle, paths, problems, stream, transit

QUERIES, SQL = {}, oracle.SQL | choice.SQL | transit.SQL | paths.SQL | days.SQL | candidates.SQL | stream.SQL
for m in (choice, transit, paths, days, candidates, stream, problems):
    QUERIES |= m.queries()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in SQL))
def test_same_as_sql(spark, sf, name):
    assert compare(spark, name, QUERIES[name], SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in SQL))
def test_has_rows(spark, sf, name):
    # The smallest tables have no pair of stops that a generated path joins.
    assert QUERIES[name](spark, sf.replace("sf0.001", "sf0.01") if name == "candidate_paths_whole" else sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
