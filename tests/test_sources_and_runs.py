import json
import math

import pytest
from pyspark.sql import functions as F

from asofkit.plans.runner import Run
from asofkit.sources import sinks, tables


def test_csv_as_text(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿date,title,n\n2024-01-01,\"a \"\"b\"\"\nc\",007\n,NA,\n".encode())
    assert [tuple(r) for r in tables.read_csv(spark, str(p)).collect()] == [("2024-01-01", 'a "b"\nc', "007"), ("", "NA", "")]
    assert tables.read_csv(spark, str(p)).columns == ["date", "title", "n"]
    empty = tmp_path / "e.csv"
    empty.write_text("a,b\n")
    assert tables.read_csv(spark, str(empty)).count() == 0


def test_copies_need_the_same_columns(spark, tmp_path):
    for name, head in (("x", "a,b"), ("y", "b,a"), ("z", "a,c")):
        (tmp_path / f"{name}.csv").write_text(f"{head}\n1,2\n")
    got = tables.read_copies(spark, str(tmp_path / "x.csv"), [str(tmp_path / "y.csv")])
    assert sorted((r["a"], r["b"], r["copy_no"]) for r in got.collect()) == [("1", "2", 0), ("2", "1", 1)]
    with pytest.raises(ValueError, match="columns differ"):
        tables.read_copies(spark, str(tmp_path / "x.csv"), [str(tmp_path / "z.csv")])


def test_json_lines_keep_bad_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": x}\n{"a": 2}\n')
    got = [(r["line_no"], r["record"]["a"] if r["record"] else None, r["bad_line"]) for r in tables.read_json_lines(spark, str(p), "a int").orderBy("line_no").collect()]
    assert got == [(1, 1, None), (2, None, ""), (3, None, '{"a": x}'), (4, 2, None)]


def test_samples_literals_and_fetches(spark):
    df = spark.createDataFrame([(0, "a", ""), (1, "b", "x"), (2, "b", "y"), (3, "c", "z"), (4, "d", "w")], "i int, k string, t string")
    assert [r["i"] for r in tables.sample_rows(df, ["k"], F.col("t") != "", "i", 2).collect()] == [1, 3]
    assert tables.one_text(spark, "x").collect()[0]["source_type"] == "direct_text"
    cache = spark.createDataFrame([("u1", "held", "")], "url string, body string, error string")
    urls = spark.createDataFrame([("u1",), ("u2",), ("u2",), (None,)], "url string")
    got = sorted(map(tuple, tables.fetched(spark, urls, cache, lambda u: (f"new {u}", "")).collect()))
    assert got == [("u1", "held", ""), ("u2", "new u2", "")]
    pages = spark.createDataFrame([(1, "<p>a</p>"), (2, None)], "k int, page string")
    assert sorted(map(tuple, tables.page_bodies(pages, "k", "page").collect())) == [(1, "a"), (2, None)]


def test_verified_writes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, ["a"]), (1, ["a"]), (2, None)], "k int, v array<string>")
    assert sinks.write_verified(df, path).count() == 3
    assert sinks.write_verified(df.limit(1), path).count() == 1 and spark.read.parquet(f"{path}.backup").count() == 3
    with monkeypatch.context() as m:
        m.setattr(sinks, "same_frame", lambda a, b: False)
        with pytest.raises(ValueError, match="isn't what was meant"):
            sinks.write_verified(df, str(tmp_path / "r"))
    assert not (tmp_path / "r").exists()
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert sorted(r["v"] for r in spark.read.option("header", True).option("escape", chr(34)).csv(str(tmp_path / "csv")).filter("v IS NOT NULL").collect()) == ['["a"]', '["a"]']
    sinks.write_json_lines(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_small_sinks(spark, tmp_path):
    sinks.save_json(tmp_path / "a" / "m.json", {"x": [1, None]})
    assert json.loads((tmp_path / "a" / "m.json").read_text()) == {"x": [1, None]}
    with pytest.raises(ValueError):
        sinks.save_json(tmp_path / "m.json", {"x": math.nan})
    assert len(sinks.file_hash(tmp_path / "a" / "m.json")) == 64
    with pytest.raises(ValueError, match="overlaps"):
        sinks.apart(tmp_path / "a", [tmp_path / "a" / "m.json"])
    sinks.apart(tmp_path / "b", [tmp_path / "a"])
    assert sinks.run_folder(tmp_path) != sinks.run_folder(tmp_path)
    report = {"rows": 1, "dates": {"daily_counts": {"x": 1}, "n": 2}}
    assert sinks.flat(sinks.visible(report)) == {"rows": 1, "dates.n": 2}
    df = spark.createDataFrame([("<b>|x", None)], "a string, b int")
    assert "\\|x" in sinks.report_markdown("T", {"t": df}) and "&lt;b&gt;" in sinks.report_html("T", {"t": df})
    with pytest.raises(ValueError, match="small"):
        sinks.report_markdown("T", {"t": spark.range(5)}, 3)
    old, new = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string"), spark.createDataFrame([(1, None, "z"), (3, "e", "f")], "k int, x string, y string")
    assert sorted(map(tuple, sinks.upserted(old, new, "k").collect())) == [(1, "a", "z"), (2, "c", "d"), (3, "e", "f")]
    stamped = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, n int")
    assert sorted(map(tuple, sinks.latest_results(stamped, "k", "n").collect())) == [(1, 2), (2, 1)]


def test_runs_check_their_inputs(spark, tmp_path):
    stages = [("a", [], lambda s: s.range(3)), ("b", ["a"], lambda s, a: a.selectExpr("id * 2 AS x")), ("c", ["b"], lambda s, b: b.selectExpr("raise_error('no') AS x"))]
    run = Run(spark, str(tmp_path / "run"), {"n": 1}, stages[:2])
    assert {k: v["status"] for k, v in run.run()["stages"].items()} == {"a": "completed", "b": "completed"}
    with pytest.raises(ValueError, match="settings"):
        Run(spark, str(tmp_path / "run"), {"n": 2}, stages)
    again = Run(spark, str(tmp_path / "run"), {"n": 1}, stages)
    with pytest.raises(Exception, match="no"):
        again.run("c")
    assert again.manifest["stages"]["c"]["status"] == "failed"
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "run" / "a"))
    with pytest.raises(ValueError, match="changed"):
        again.run("b")
    again.run("a")
    assert "b" not in again.manifest["stages"]


def test_streams(spark, tmp_path):
    from asofkit.streaming import online

    rows = [("2024-01-01 10:00:00", "a", 1), ("2024-01-01 11:00:00", "a", 1), ("2024-01-02 11:00:00", "b", 2)]
    spark.createDataFrame(rows, "t string, kind string, g int").select(F.to_timestamp("t").alias("ts"), "kind", "g").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = sorted((str(r["day"]), r["kind"], r["n"]) for r in online.run_once(spark, online.daily_counts(stream(), "ts", "kind"), "complete").collect())
    assert got == [("2024-01-01", "a", 2), ("2024-01-02", "b", 1)]
    assert online.run_once(spark, online.first_seen(stream(), ["g"], "ts")).count() == 2
    sizes = {r["g"]: r["n"] for r in online.run_once(spark, online.running_sizes(stream(), "g", "ts")).collect()}
    assert sizes == {"1": 2, "2": 1}
