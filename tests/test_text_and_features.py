import json
import random
from datetime import date, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from asofkit.functions import text as t
from asofkit.functions import times
from asofkit.functions.ids import json_list_id, with_stable_ids
from asofkit.operators import features, scoring, validate
from asofkit.operators.documents import prepared


def test_title_forms():
    assert t.title_form("  NVIDIA UP 10% — Yahoo Finance  ", "finance.yahoo.com", "finance.yahoo.com") == "nvidia up 10%"
    assert t.title_form("NVIDIA is not down - analyst note", "a.com", "A").endswith("analyst note")
    assert t.title_form("Ａ “b” | Market Desk", "marketdesk.test", "Market Desk") == 'a "b"'
    assert t.title_form("") == "" and t.plain_title_form(" Straße ,x  -y ") == "strasse, x - y"


def test_expressions(spark):
    df = spark.createDataFrame([("Shares rise, shares FALL 5%", "x.reuters.com", "the Answer: Positive."), (None, None, None), ("", " ", "negative or neutral")], "title string, domain string, answer string")
    label = t.answered_label(F.col("answer"))
    got = df.select(t.tokens(F.col("title")).alias("w"), t.trust_tier(F.col("domain")).alias("d"), label.alias("l"), t.one_label_only(F.col("answer"), label).alias("u"), t.letters_and_digits(F.col("title")).alias("n")).collect()
    assert got[0]["w"] == ["shares", "rise", "fall", "5"] and [r["d"] for r in got] == [1, 4, 4]
    assert [r["l"] for r in got] == ["positive", None, "negative"] and [bool(r["u"]) for r in got] == [True, False, False] and [r["n"] for r in got] == [21, 0, 0]
    j = df.limit(1).select(t.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j"), t.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"), F.lit(1.0)).alias("k")).first()
    assert j["j"] == 0.5 and j["k"] == 1.0
    r = spark.createDataFrame([("abc", "abc"), ("abcd", "bcde"), (None, "a")], "a string, b string").select(t.sequence_ratio("a", "b").alias("r")).collect()
    assert [x["r"] for x in r] == [1.0, 0.75, None]


@pytest.mark.parametrize("most", [10, 37, 1800])
def test_chunks_rejoin_and_fit(most):
    chance = random.Random(most)
    text = " ".join("w" * chance.randint(1, 9) for _ in range(400))
    parts = t.chunk(text, most, 50)
    assert " ".join(parts).replace(" ", "") == text.replace(" ", "") and all(len(p) <= most and len(p.split()) <= 50 for p in parts)
    assert t.chunk("  ") == []


def test_html_bodies():
    page = "<html><head><title>x</title></head><body><nav>Menu</nav><div style='display: none'>no</div><ix:hidden>no</ix:hidden><p>One&amp;two</p><script>bad()</script><br>three<footer>f</footer></body></html>"
    assert t.html_body(page) == "One&two\nthree"
    long = "word " * 60
    assert t.html_body(f"<div>side</div><article><h1>T</h1><p>{long}</p></article>").startswith("T\nword") and "side" not in t.html_body(f"<div>side</div><article><p>{long}</p></article>")
    assert t.html_body("<table><tr><td>Revenue</td><td>100</td></tr><tr><td>Costs</td><td>5</td></tr></table>") == "Revenue 100\nCosts 5"
    assert t.html_body("<p>one\ntwo</p><nav>x<p>y</nav>z<div hidden>no<br></div>end") == "one\ntwo\nz\nend"
    assert t.html_body("") == "" and t.html_body("<p>unclosed <b>bold") == "unclosed bold"


def test_ids(spark):
    df = spark.createDataFrame([(2, "a", "q\"ü/"), (1, "a", "q\"ü/"), (3, None, "")], "i int, x string, y string")
    one = {r["i"]: r["stable_id"] for r in with_stable_ids(df, ["x", "y"], "i").collect()}
    two = {r["i"]: r["stable_id"] for r in with_stable_ids(df.orderBy("i"), ["y", "x"], "i").collect()}
    assert one == two and len(set(one.values())) == 3
    import hashlib

    want = hashlib.sha256(json.dumps(["a", 'q"ü/'], ensure_ascii=False).encode()).hexdigest()[:24]
    assert df.filter("i = 1").select(json_list_id(F.col("x"), F.col("y"))).first()[0] == want


def test_trading_days(spark):
    data = [(0, "2024-01-04 15:30:00"), (1, "2024-01-03 20:59:59"), (2, "2024-01-03 21:00:00"), (3, "2024-01-06 09:00:00"), (4, "2019-12-30 10:00:00"), (5, "2024-01-12 22:00:00")]
    df = spark.createDataFrame(data, "i int, s string").withColumn("day", times.market_day(F.to_timestamp("s")))
    cal = spark.createDataFrame([(date(2020, 1, 2),), *[(date(2024, 1, d),) for d in (2, 3, 4, 5, 8, 9, 11)]], "date date")
    got = {r["i"]: r["d"] for r in times.next_calendar_day(df, "day", times.checked_calendar(cal), "d").collect()}
    assert got == {0: date(2024, 1, 4), 1: date(2024, 1, 3), 2: date(2024, 1, 4), 3: date(2024, 1, 8), 4: date(2020, 1, 2), 5: None}
    for bad in ([], [date(2024, 1, 2)] * 2, [date(2024, 1, 6)]):
        with pytest.raises(ValueError, match="calendar"):
            times.checked_calendar(spark.createDataFrame([(d,) for d in bad], "date date"))


def test_backward_as_of_both_ways(spark):
    chance = random.Random(8)
    left = [(date(2024, 1, 1) + timedelta(days=i), k) for i in range(0, 200, 3) for k in "ab"]
    right = [(k, date(2024, 1, 1) + timedelta(days=d), float(d)) for k in "ab" for d in sorted(chance.sample(range(20, 180), 6))]
    l, r = spark.createDataFrame(left, "day date, k string"), spark.createDataFrame(right, "k string, known date, v double")
    want = {(d, k): max((x for x in right if x[0] == k and x[1] <= d), key=lambda x: x[1], default=(None, None, None))[2] for d, k in left}
    for small in (200_000, 1):
        times.SMALL_ROWS, old = small, times.SMALL_ROWS
        try:
            got = {(x["day"], x["k"]): x["v"] for x in times.as_of_latest(l, "day", r, "known", ["k"], ["v"]).collect()}
        finally:
            times.SMALL_ROWS = old
        assert got == want


def test_forward_returns(spark):
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(12)] + [date(2024, 2, 1) + timedelta(days=i) for i in range(6)]
    prices = spark.createDataFrame([(d, 100.0 + i) for i, d in enumerate(days)], "date date, close double")
    left = spark.createDataFrame([(d,) for d in (date(2023, 12, 20), date(2023, 12, 31), date(2024, 1, 5), date(2024, 1, 15), date(2024, 1, 30), date(2024, 2, 6))], "d date")
    got = {r["d"]: r for r in times.forward_returns(left, "d", prices).collect()}
    assert got[date(2023, 12, 20)]["label"] is None and got[date(2024, 1, 15)]["target_start"] is None and got[date(2024, 2, 6)]["target_end"] is None
    r = got[date(2024, 1, 5)]
    assert r["target_start"] == date(2024, 1, 6) and r["target_end"] == date(2024, 1, 11) and r["label"] == 1 and abs(r["future_return"] - 5 / 105) < 1e-12
    assert got[date(2024, 1, 30)]["target_start"] == date(2024, 2, 1)
    assert got[date(2023, 12, 31)]["target_start"] == date(2024, 1, 1)


def test_weekly_features(spark):
    rows = [(date(2020, 1, 6), "news", "positive", 1.0, ""), (date(2020, 1, 12), "news", "neutral", 0.0, "timeout"), (date(2020, 1, 13), "ten_k", "negative", -1.0, None), (None, "news", "positive", 1.0, "")]
    df = spark.createDataFrame(rows, "available_date date, source_type string, label string, score double, error string")
    got = {r["date"]: r for r in features.source_features(df, "2020-01-01", "2020-01-31").collect()}
    assert sorted(got) == [date(2020, 1, d) for d in (5, 12, 19, 26)]
    first = got[date(2020, 1, 12)]
    assert first["news_document_count"] == 2 and first["news_error_count"] == 1 and first["news_neutral_count"] == 0 and first["news_sentiment_mean"] == 1.0 and first["news_missing"] == 0
    empty = got[date(2020, 1, 5)]
    assert empty["news_missing"] == 1 and empty["news_sentiment_mean"] == 0.0 and empty["ten_k_positive_ratio"] == 0.0


def test_trends_are_known_from_the_next_month(spark):
    df = spark.createDataFrame([(date(2020, 1, 1), "k", 70.0, "False"), (date(2020, 2, 1), "k", 80.0, "true")], "date date, keyword string, value double, is_partial string")
    assert [tuple(r) for r in features.known_months(df).collect()] == [("k", date(2020, 2, 1), 70.0)]
    with pytest.raises(ValueError, match="first day"):
        features.known_months(df.unionAll(df))


def test_daily_sentiment_keeps_null_apart_from_zero(spark):
    rows = [(date(2024, 1, 2), "POSITIVE ", 1.0, ""), (date(2024, 1, 2), "neutral", 0.0, None), (date(2024, 1, 2), "negative", None, ""), (date(2024, 1, 3), "x", 1.0, ""), (date(2024, 1, 4), "neutral", 0.0, "")]
    df = spark.createDataFrame(rows, "effective_trading_date date, label string, score double, error string")
    got = {r["effective_trading_date"].day: r for r in features.daily_sentiment(df).collect()}
    assert got[2]["item_count"] == 3 and got[2]["failure_count"] == 1 and got[2]["sentiment_mean"] == 0.5 and got[2]["sentiment_std"] == 0.5
    assert got[3]["has_data"] == 0 and got[3]["sentiment_mean"] is None and got[3]["positive_ratio"] is None and got[4]["sentiment_mean"] == 0.0
    assert features.daily_sentiment(df.filter("false")).count() == 0
    with pytest.raises(ValueError, match="more than once"):
        features.one_to_one(df, df, "effective_trading_date")


def test_splits_purge_and_scale_on_train_alone(spark):
    start = date(2024, 1, 1)
    data = [(start + timedelta(days=i), start + timedelta(days=i + 5), float(i)) for i in range(90)]
    df = spark.createDataFrame(data, "date date, target_end date, signal double")
    out = features.temporal_split(df, "date", "target_end")
    parts = {p: sorted(r["date"] for r in out.collect() if r["part"] == p) for p in ("train", "validation", "test")}
    assert max(parts["train"]) + timedelta(days=5) < min(parts["validation"]) and max(parts["validation"]) + timedelta(days=5) < min(parts["test"])
    one = features.scaling(out.filter("part = 'train'"), ["signal"]).first()
    two = features.scaling(features.temporal_split(df.withColumn("signal", F.when(F.col("date") > start + timedelta(days=80), 1e6).otherwise(F.col("signal"))), "date", "target_end").filter("part = 'train'"), ["signal"]).first()
    assert one == two
    with pytest.raises(ValueError, match="too few"):
        features.temporal_split(df.limit(5), "date", "target_end")
    with pytest.raises(ValueError, match="not features"):
        features.guard_columns(["signal", "target_end"])
    assert features.lookback_windows(df, "date", ["signal"], 8).count() == 83


def test_document_scores_fail_as_a_whole(spark):
    df = spark.createDataFrame([(1, 0, 1.0, ""), (1, 1, 0.0, ""), (2, 0, 1.0, ""), (2, 1, None, "timeout")], "document_id int, chunk_ix int, score double, error string")
    got = {r["document_id"]: r for r in features.document_scores(df).collect()}
    assert got[1]["score"] == 0.5 and got[1]["label"] == "positive" and got[2]["score"] is None and got[2]["failed_chunks"] == 1 and got[2]["label"] is None


def test_one_failing_row_fails_alone(spark):
    class Moody:
        def score(self, texts):
            if any("bad" in x for x in texts):
                raise RuntimeError("no")
            return pd.DataFrame({"label": ["neutral"] * len(texts), "score": [0.0] * len(texts), "raw_output": ["neutral"] * len(texts), "error": [""] * len(texts)})

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, None), (4, "")], "k int, t string")
    got = {r["k"]: (r["label"], r["error"]) for r in scoring.scored(df, "k", "t", Moody).collect()}
    assert got[1] == ("neutral", "") and got[2] == (None, "RuntimeError: no") and got[3][0] == "neutral"
    word = {r["k"]: (r["label"], r["error"]) for r in scoring.scored(df, "k", "t").collect()}
    assert word[3] == (None, "blank text") and word[4][1] == "blank text" and word[1] == ("neutral", "")
    cache = spark.createDataFrame([(1, ""), (2, "RuntimeError")], "k int, error string")
    assert sorted(r["k"] for r in scoring.to_score(df, cache, "k").collect()) == [3, 4]
    assert sorted(r["k"] for r in scoring.to_score(df, cache, "k", True).collect()) == [2, 3, 4]


GOOD = {**{k: 0 for k in validate.RANGES}, "event_type": "other", "positive_factors": [], "potential_concerns": [], "summary": "One. Two.", "evidence": ["Revenue ROSE"]}
SOURCE = "Our revenue rose 5%."


@pytest.mark.parametrize("answer", [json.dumps(GOOD), f"```json\n{json.dumps(GOOD)}\n``` {{", f"Sure! {json.dumps(GOOD)} {{\"x\": 1}}"])
def test_strict_extraction_accepts(answer):
    assert validate.check_extraction(validate.first_object(answer), SOURCE) == []


@pytest.mark.parametrize(
    "change", [{"risk": 1.0}, {"risk": "1"}, {"risk": True}, {"risk": None}, {"risk": 3}, {"event_type": "rumour"}, {"extra": 1}, {"positive_factors": ["a"] * 5}, {"evidence": ["x" * 241]}, {"evidence": [" "]}, {"summary": "A. B. C."}, {"summary": "甲。乙。丙。"}, {"evidence": ["absent"]}]
)
def test_strict_extraction_rejects(change):
    assert validate.check_extraction(GOOD | change, SOURCE)


@pytest.mark.parametrize("answer", ['{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 1', "none", ""])
def test_strict_objects_reject(answer):
    with pytest.raises(ValueError):
        validate.first_object(answer)


def test_extractions_isolate_rows(spark):
    df = spark.createDataFrame([(1, json.dumps(GOOD), SOURCE), (2, "nothing", SOURCE), (3, None, None)], "k int, a string, s string")
    got = {r["k"]: r for r in validate.extractions(df, "k", "a", "s").collect()}
    assert got[1]["error"] == "" and got[1]["evidence"] == ["Revenue ROSE"] and got[1]["risk"] == 0
    assert got[2]["error"] and got[2]["risk"] is None and got[3]["error"]


def _annotation(**change):
    quote = {"quote": "rose", "start": 14, "end": 18}
    record = {
        "sample_id": "s1", "ticker": "NVDA", "source_type": "news", "published_at": "2024-01-01T23:30:00-02:00", "as_of_date": "2024-01-02", "title": "T", "text": "The revenue rose.",
        "labels": {**{d: "insufficient_information" for d in validate.DIRECTIONAL}, **{d: "no" for d in validate.YES_NO}}, "evidence": {}, "annotator": "a", "annotation_version": "v1", "split": "train",
    }
    record["labels"]["sentiment"], record["evidence"]["sentiment"] = "positive", [quote]
    return record | change


def test_annotations(spark):
    assert validate.check_annotation(_annotation()) == []
    for change in ({"ticker": "nvda"}, {"published_at": "2024-01-01T10:00:00"}, {"as_of_date": "2024-01-01"}, {"text": " "}, {"labels": {}}, {"more": 1}, {"evidence": {"sentiment": [{"quote": "rose", "start": 13, "end": 17}]}}, {"evidence": {}}, {"split": "dev"}):
        assert validate.check_annotation(_annotation(**change)), change
    lines = [json.dumps(_annotation()), "", "{bad", json.dumps(_annotation(split="test")), "[]"]
    got = {r["line_no"]: r["errors"] for r in validate.annotations(spark.createDataFrame([*enumerate(lines, 1)], "line_no long, value string")).collect()}
    assert got[1] == [] and got[2] == ["blank line"] and got[3] and got[4] == ["sample_id of line 1"] and got[5]


def test_sections_and_labels(spark):
    answer = "[Positive Developments]:\n1. Up a lot\n2. More\n\n[Potential Concerns]:\n1. Debt\n\n[Prediction & Analysis]\nIt rises."
    s = validate.sections(answer)
    assert s["positive_developments"] == ["Up a lot", "More"] and s["potential_concerns"] == ["Debt"] and s["analysis"] == "It rises."
    df = spark.createDataFrame([(" Positive.\n",), ("No No",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(validate.free_label(F.col("a"), ["Positive", "No"])).collect()] == ["Positive", None, None, None]
    got = df.select(validate.sections_udf("a").alias("s")).collect()
    assert all(len(r["s"]["missing"]) == 3 for r in got)
    assert validate.object_with_keys('{"a": 1, "b": 2}', ["a", "b"])[0] and not validate.object_with_keys('{"b": 2, "a": 1}', ["a", "b"])[0]


def test_prepared_documents(spark):
    rows = [("earnings_call", "2024-01-02", "CFO Commentary", "u", "text"), ("news", "2024-01-02", "Only title", "u", None), ("ten_k", "2024-01-02", "t", "u", "us-gaap:x"), ("ten_k", "2024-01-02", "t", "u", "us-gaap:x"), ("ten_k", "2030-01-02", "t", "u", "x"), ("ten_k", "2024-01-02", "e", "u", " ")]
    df = spark.createDataFrame(rows, "source_type string, date string, title string, url string, content string")
    got = {r["title"]: r for r in prepared(df, "NVDA", "2024-01-01", "2024-12-31").collect()}
    assert len(got) == 4 and got["CFO Commentary"]["date_status"] == "unverified" and got["Only title"]["text"] == "Only title" and got["Only title"]["preparation_error"] == ""
    assert got["t"]["quality_flags"] and got["e"]["preparation_error"] == "No body."
    o = spark.createDataFrame([(got["CFO Commentary"]["document_id"], "2024-02-01", "call")], "document_id string, available_date string, evidence string")
    again = {r["title"]: r for r in prepared(df, "NVDA", "2024-01-01", "2024-12-31", o).collect()}
    assert again["CFO Commentary"]["available_date"] == "2024-02-01" and again["CFO Commentary"]["preparation_error"] == ""
    with pytest.raises(Exception, match="evidence"):
        prepared(df, "NVDA", "2024-01-01", "2024-12-31", o.withColumn("evidence", F.lit(" "))).collect()


def test_prices_prompts_and_queries(spark):
    good = spark.createDataFrame([(date(2024, 1, 2), 1.0), (date(2024, 1, 3), 2.0)], "date date, close double")
    assert times.checked_prices(good).count() == 2
    for bad in ("date, 0D close", "date, double('nan') close", "date('2024-01-02') date, close"):
        with pytest.raises(ValueError, match="prices"):
            times.checked_prices(good.selectExpr(*bad.split(", ")))
    with pytest.raises(ValueError, match="prices"):
        times.checked_prices(good.filter("false"))
    df = spark.createDataFrame([(" a \n b ",), (None,)], "t string").select(t.sentiment_prompt(F.col("t")).alias("p"))
    assert [r["p"].split("\n")[1] for r in df.collect()] == ["Input: a b", "Input: "]
    assert t.search_query(["NVIDIA", "data center"], "english") == '(NVIDIA OR "data center") sourcelang:english'


def test_daily_table_has_all_sources_and_years(spark, tmp_path):
    from asofkit.plans import catalog

    data = [(d, s) for d in ("2020-01-01", "2022-05-05", "2026-12-31", "2019-12-31") for s in features.SOURCES]
    pd.DataFrame({
        "row_ix": range(len(data)), "document_id": "d", "available_date": [d for d, _ in data], "source_type": [s for _, s in data], "sentiment_label": "positive", "sentiment_score": 0.5, "fingpt_error": "", "text": "t",
    }).to_parquet(tmp_path / "pipeline_sentiment.parquet")
    got = {r["date"]: r for r in catalog.queries()["daily_features"](spark, str(tmp_path)).collect()}
    assert len(got) == (date(2026, 12, 31) - date(2020, 1, 1)).days + 1
    assert {d for d, r in got.items() if all(r[f"{s}_positive_count"] == 1 and r[f"{s}_missing"] == 0 for s in features.SOURCES)} == {"2020-01-01", "2022-05-05", "2026-12-31"}
