import pytest
from compare import compare

pytest.importorskip("public_tokenizers")
from tramline.llm import queries as Q

SQL = Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, sf, name):
    if name in SQL:
        assert compare(spark, name, Q.queries()[name], SQL[name], sf) is None
    else:
        assert Q.queries()[name](spark, sf).count() > 0
