"""Every query of the core on the smallest tables, against its SQL where it has one."""

import glob
import os
from pathlib import Path

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
if not Path(DATA).exists():
    pytest.skip("no test tables", allow_module_level=True)

from asofkit.plans import catalog  # noqa: E402


def plain(rows):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return float(v)
        try:
            return round(float(v), 5)
        except (TypeError, ValueError):
            return str(v)

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sql, name):
    out = catalog.queries()[name](spark, DATA)
    rows = out.collect()
    if name in catalog.oracles():
        want = sql.execute(catalog.oracles()[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(out.columns)
        order = [columns.index(c) for c in out.columns]
        assert plain(rows) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and {"flagship", "p5_found"} <= set(e.queries())
    assert e.entry(spark).columns[0] == "date"
