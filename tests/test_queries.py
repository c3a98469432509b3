"""Every query with SQL beside it against DuckDB on the smallest tables."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from quirefold.plans import queries as plans  # noqa: E402


@pytest.fixture(scope="session")
def db(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(frame, columns):
    plain = lambda v: None if v is None or v != v else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple("" if (x := plain(v)) is None else x for v in r) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, sf_dir, db, name):
    got, want = plans.QUERIES[name](spark, sf_dir).toPandas(), db.execute(plans.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
