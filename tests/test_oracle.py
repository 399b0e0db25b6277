"""Every registered query of the library against its SQL in DuckDB."""

from pathlib import Path

import duckdb
import pytest

from kinegrid.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted([tuple(None if v != v else v for v in row) for row in frame.itertuples(index=False)], key=repr), list(frame.columns)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, tables, name):
    ours = QUERIES[name](spark, str(DATA)).toPandas()
    theirs = tables.sql(ORACLE_SQL[name]).df()
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    QUERIES[name](spark, str(DATA)).count()
