"""Every registered query of the library against its DuckDB twin, on the smallest tables."""

import duckdb
import pytest

from tallyhouse.queries import TABLES, oracle_sql, queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def shown(table):
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in zip(*[table.column(c).to_pylist() for c in sorted(table.column_names)], strict=True))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, duck, name):
    ours, theirs = queries()[name](spark, D).toArrow(), duck.sql(oracle_sql()[name]).to_arrow_table()
    assert sorted(ours.column_names) == sorted(theirs.column_names)
    assert shown(ours) == shown(theirs)
