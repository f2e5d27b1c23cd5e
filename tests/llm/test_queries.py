"""Every query of the subpackage on the smallest tables, against its SQL where it has one, and some against each other."""

import glob
import os
from pathlib import Path

import pytest

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
if not Path(DATA).exists():
    pytest.skip("no test tables", allow_module_level=True)

from asofkit.llm import queries, tokens  # noqa: E402

VOCABULARY = (Path(tokens.TOKENIZERS) / "byte_bpe_50k.tiktoken").exists()
SHAPES = {
    "p1_found": "row_ix bigint, line_no int", "p2_found": "split string, pub_year int, selection_reason string", "p3_found": "row_a bigint, row_b bigint", "p4_found": "source_table string, row_ix bigint",
    "p6_found": "row_ix bigint", "p7_found": "row_a bigint, row_b bigint", "p8_ids": "doc_id bigint, ids array<int>", "p9_found": "source string", "p10_found": "doc_id bigint",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name[:2] in ("p8", "p9") and not VOCABULARY:
        pytest.skip("no public vocabulary here")
    out = queries.QUERIES[name](spark, DATA)
    got = out.collect()
    if name in SHAPES:
        assert ", ".join(f"{c} {t}" for c, t in out.dtypes) == SHAPES[name]
        if name != "p8_ids":
            assert len(set(map(tuple, got))) == len(got)
    if name in queries.ORACLES:
        duckdb = pytest.importorskip("duckdb")
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for f in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")
        want = con.execute(queries.ORACLES[name])
        order = [[d[0] for d in want.description].index(c) for c in out.columns]
        assert sorted(map(tuple, got), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_a_sample_has_its_quotas(spark):
    report = {(r["split"], r["pub_year"], r["selection_reason"]): r["quota"] for r in queries.p2_report(spark, DATA).collect()}
    sample = queries.p2_sample(spark, DATA).toPandas()
    assert sample["sample_id"].is_unique
    assert {k: len(v) for k, v in sample.groupby(["split", "pub_year", "selection_reason"])} == {k: q for k, q in report.items() if q}


def test_no_leak_is_left(spark):
    got = queries.p6_splits(spark, DATA)
    assert got.groupBy("component").agg({"new_split": "count"}).count() == got.select("component", "new_split").distinct().count()
