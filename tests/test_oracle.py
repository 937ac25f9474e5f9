"""Every registered query with an oracle equals the independent DuckDB SQL (sf0.001 by default)."""

import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, sf, con, name):
    df, sql = E.queries()[name](spark, sf), ORACLE[name]
    if name.endswith("donor_donations"):  # the SQL lists all programs that can be; small tables lack some
        own = ", ".join(df.columns)
        others = [c[0] for c in con.execute(sql).description if c[0] not in df.columns]
        for c in others:
            assert con.execute(f"SELECT COUNT(*) FROM ({sql}) WHERE {c} <> 0").fetchone()[0] == 0
        sql = f"SELECT {own} FROM ({sql})"
    res = compare(df, con, sql)
    assert res["cols_match"], res
    assert res["spark_rows"] == res["oracle_rows"], res
    assert res["hash_match"], res


def test_every_query_has_a_callable_and_entry_runs(spark):
    qs = E.queries()
    assert set(ORACLE) <= set(qs)
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "donor" and df.columns[-1] == "status"
