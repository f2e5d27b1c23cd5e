import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asofkit.functions.instants import interpretations, iso, on_clock
from asofkit.operators.timestamps import CANONICAL, choose, host_of, normalize_timestamps

ONE = {
    ("2022-01-04T12:19:57Z", None): "2022-01-04T12:19:57.000000Z",
    ("20220630T132359Z", None): "2022-06-30T13:23:59.000000Z",
    ("17.06.2024 10:59", "Europe/Berlin"): "2024-06-17T08:59:00.000000Z",
    ("12/30/2022 10:49", "America/Chicago"): "2022-12-30T16:49:00.000000Z",
    ("1633294808032", None): "2021-10-03T21:00:08.032000Z",
    ("1667112892", None): "2022-10-30T06:54:52.000000Z",
    ("1705489550515401", None): "2024-01-17T11:05:50.515401Z",
    ("2023-04-25T16:58:59.677795601Z", None): "2023-04-25T16:58:59.677795Z",
    ("20220630131723", "Asia/Tokyo"): "2022-06-30T04:17:23.000000Z",
    ("Sun, 20 Apr 2025 04:31:10 GMT", None): "2025-04-20T04:31:10.000000Z",
    ("Wed, 07 Jun 2023 10:13:29 +1000", None): "2023-06-07T00:13:29.000000Z",
    ("Dec. 14, 2022, 4:48 a.m. ET", None): "2022-12-14T09:48:00.000000Z",
    ("September 13, 2024 4:36 PM ET", None): "2024-09-13T20:36:00.000000Z",
    ("2021-02-03T08:00:17[America/Chicago]", None): "2021-02-03T14:00:17.000000Z",
    ("2025-05-22 23:43:23 America/Chicago", None): "2025-05-23T04:43:23.000000Z",
    ("07/16/2022 08:47 PM EDT", None): "2022-07-17T00:47:00.000000Z",
    ("5 Apr 2025", "Asia/Tokyo"): "2025-04-05T00:00:00.000000Z",
    ("2023/07/29", None): "2023-07-29T00:00:00.000000Z",
    ("14.08.2024", None): "2024-08-14T00:00:00.000000Z",
    ("20250326", None): "2025-03-26T00:00:00.000000Z",
    ("2021-08-21 23:33:39+0530", None): "2021-08-21T18:03:39.000000Z",
    ("2023-08-17T03:55:39.157858z", None): "2023-08-17T03:55:39.157858Z",
    # An abbreviation settles an hour that a clock repeats or skips.
    ("2022-11-06 01:30:00 EDT", None): "2022-11-06T05:30:00.000000Z",
    ("2022-11-06 01:30:00 EST", None): "2022-11-06T06:30:00.000000Z",
    ("2022-03-13 02:30:00 CST", None): "2022-03-13T08:30:00.000000Z",
    ("  2022-01-04T12:19:57Z ", None): "2022-01-04T12:19:57.000000Z",
}
NONE = [
    None, "", " ", "-", "n/a", "TBD", "yesterday", "3 hours ago", "2024-13-07 08:00:00", "2022-06-31", "2023-02-30T10:00:00Z", "00/00/0000", "25:61", "2021/??/04", "13/13/2024 10:00",
    "12/30/2022 13:49 PM EST", "17.06.2024 10:59", "2022-07-31T02:51:02", "1" * 25, "x" * 500,
]


@pytest.mark.parametrize("value,zone", ONE)
def test_one_reading(value, zone):
    assert [iso(us) for _, us in interpretations(value, zone)] == [ONE[value, zone]]


@pytest.mark.parametrize("value", NONE)
def test_no_reading_without_zone(value):
    assert interpretations(value, None) == []


@pytest.mark.parametrize("value,zone", [("2022-11-06 01:30:00", "America/New_York"), ("2022-03-13 02:30:00", "America/New_York"), ("March 13, 2022 2:30 AM ET", None), ("27.03.2022 02:30", "Europe/Berlin")])
def test_clock_changes_name_no_instant(value, zone):
    assert interpretations(value, zone) == []


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1990, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["America/New_York", "Europe/London", "Asia/Kolkata", "Australia/Sydney"]))
def test_on_clock_agrees_with_round_trip(local, zone):
    z = ZoneInfo(zone)
    both = {local.replace(tzinfo=z, fold=f).astimezone(timezone.utc) for f in (0, 1)}
    real = {t for t in both if t.astimezone(z).replace(tzinfo=None) == local}
    got = on_clock(local, zone)
    want = {(t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) for t in real}
    assert ({got} if got is not None else set()) == (want if len(want) == 1 else set())


def test_viterbi_against_all_paths():
    from itertools import product

    from asofkit.operators.timestamps import _step

    chance = random.Random(5)
    for _ in range(60):
        run = [[(chance.choice("ab"), chance.randrange(10) * 86_400_000_000) for _ in range(chance.randint(1, 3))] for _ in range(chance.randint(1, 5))]
        before, after = (chance.choice([None, ("a", 3 * 86_400_000_000)]) for _ in range(2))
        cost = lambda path: sum(_step(p, q) for p, q in zip([before, *path], path)) + (_step(path[-1], after) if after else 0)  # noqa: E731, B023
        best = min(map(cost, product(*run)))
        assert abs(cost(choose(before, run, after)) - best) < 1e-9


def test_order_of_a_source_decides_between_day_and_month(spark, rows):
    """With slashes open, the neighbours and the notation of the source decide."""
    data = [("s", "a", 1, "2024-04-01T00:00:00Z"), ("s", "a", 2, "03/04/2024"), ("s", "a", 3, "04/04/2024"), ("s", "a", 4, "25/04/2024"), ("s", "b", 1, "03/04/2024")]
    df = spark.createDataFrame(data, "stream string, source string, ix long, v string")
    out = normalize_timestamps(df, F.col("v"), F.col("source"), F.col("ix"), F.lit(None).cast("string"), F.concat("stream", "source"), slashes="both")
    got = {(r["stream"], r["row_ix"]): (r["utc_at"][:10], r["readings"]) for r in out.collect()}
    assert got["sa", 2] == ("2024-04-03", 2)
    assert got["sa", 4] == ("2024-04-25", 1)


def test_edge_cases(spark):
    schema = "stream string, source string, ix long, v string, zone string, extra string"
    none = spark.createDataFrame([], schema)
    args = lambda df: (df, F.col("v"), F.col("source"), F.col("ix"), F.col("zone"), F.col("stream"))
    assert normalize_timestamps(*args(none)).count() == 0
    data = [("s", None, 1, "2024-01-01T00:00:00Z", None, "x"), ("s", None, None, None, None, None), ("s", "a", 2, "x" * 100_000, None, None), ("s", "a", 2, "01.02.2024 10:00", "Europe/London", None)]
    df = spark.createDataFrame(data * 2, schema)
    out = normalize_timestamps(*args(df)).collect()
    assert len(out) == 8 and sum(r["utc_at"] is not None for r in out) == 4
    changed = normalize_timestamps(*args(df), only_changed=True).collect()
    assert {r["utc_at"] for r in changed} == {"2024-02-01T10:00:00.000000Z"} and len(changed) == 2


def test_blocks_and_partitions_dont_change_results(spark):
    data = [("s", "a", i, v) for i, v in enumerate(["2024-01-01T00:00:00Z", "1704153600", "01/03/2024 00:00", "", None] * 40)]
    df = spark.createDataFrame(data, "stream string, source string, ix long, v string")
    run = lambda n, b: sorted(map(tuple, normalize_timestamps(df.repartition(n), F.col("v"), F.col("source"), F.col("ix"), F.lit("Asia/Tokyo"), F.col("stream"), block_rows=b).collect()), key=repr)
    assert run(1, 10_000) == run(7, 16)


@pytest.mark.parametrize("seed", range(2))
def test_open_runs_over_block_edges(spark, seed):
    """Runs of values with two readings over one block edge, and over blocks without any pinned value."""
    chance = random.Random(seed)
    data, day = [], datetime(2024, 1, 1)
    for i in range(90):
        day += timedelta(days=chance.randrange(3))
        v = day.strftime(chance.choice(["%d/%m/%Y", "%m/%d/%Y"]) if chance.random() < 0.93 or 30 < i < 55 else "%Y-%m-%dT%H:%M:%SZ")
        data.append(("s", "ab"[i % 7 == 0], i, v))
    df = spark.createDataFrame(data + [("s", None, 5, "03/04/2024"), ("t", None, None, "03/04/2024")], "stream string, source string, ix long, v string")
    run = lambda b: sorted(map(tuple, normalize_timestamps(df, F.col("v"), F.col("source"), F.col("ix"), F.lit(None).cast("string"), F.col("stream"), slashes="both", block_rows=b).collect()), key=repr)
    whole = run(100_000)
    assert len(whole) == 92 and sum(r[5] > 1 for r in whole) > 20
    assert run(1) == whole and run(4) == whole and run(33) == whole


def test_times_of_any_length_are_read():
    long = "2024-01-02T03:04:05." + "1" * 65 + "Z"
    assert interpretations(long) == [("iso", 1704164645111111)]


def test_hosts(spark):
    df = spark.createDataFrame([("https://www.A.example/x",), ("http://b.test:80/",), ("https://u@c.test?q",), ("no address",), ("",), (None,)], "url string")
    assert [r[0] for r in df.select(host_of(F.col("url"))).collect()] == ["a.example", "b.test", "c.test", None, None, None]


def test_found_query_leaves_canonical_values_out(spark, tmp_path):
    from asofkit.plans.times import p5_found, p5_normalized

    t = pd.DataFrame({
        "row_ix": [0, 1, 2], "domain": ["A.TEST", None, "b.test"], "seendate": ["20240101T000000Z", "2024-01-05", "1704153600"], "published_at": ["2024-01-01 09:00:00", "2024-01-01 09:00:00", "2024-01-01T00:00:00Z"],
    })
    t.to_parquet(tmp_path / "cluster_news_titles.parquet")
    pd.DataFrame({"row_ix": [7, 8], "url": ["https://www.a.test/x", None], "date": ["2024-01-05", "05.01.2024 01:00"]}).to_parquet(tmp_path / "pipeline_documents.parquet")
    pd.DataFrame({"domain": ["a.test"], "zone_name": ["Asia/Tokyo"]}).to_parquet(tmp_path / "outlet_zones.parquet")
    got = sorted(map(tuple, p5_found(spark, str(tmp_path)).collect()))
    assert got == [
        ("cluster_news_titles", 0, "published_at", "2024-01-01T00:00:00.000000Z"),
        ("cluster_news_titles", 1, "seendate", "2024-01-05T00:00:00.000000Z"),
        ("cluster_news_titles", 2, "seendate", "2024-01-02T00:00:00.000000Z"),
    ]
    assert p5_normalized(spark, str(tmp_path)).count() == 8
    assert CANONICAL.fullmatch("20240101T000000Z")


def test_headlines_of_every_notation_are_counted(spark, tmp_path, rows):
    """Against datetime."""
    from datetime import datetime, timezone
    from email.utils import format_datetime

    from asofkit.plans import catalog

    at = [datetime(2024, 1, 2, 9, 30, tzinfo=timezone.utc).replace(hour=h) for h in range(1, 9)]
    written = [
        at[0].strftime("%Y-%m-%dT%H:%M:%SZ"), at[1].strftime("%Y%m%dT%H%M%SZ"), format_datetime(at[2]), str(int(at[3].timestamp())), at[4].strftime("%Y-%m-%d %H:%M:%S UTC"),
        "2024-01-02T08:30:00+02:00", "2024-01-02 16:30:00", "02.01.2024 17:30", "soon", " ", None,
    ]
    n = len(written)
    pd.DataFrame({
        "row_ix": range(n), "published_at": written, "seendate": written, "title": "one title", "domain": ["a.test"] * 6 + ["b.test"] * 5, "url": "http://x", "preliminary_cluster_id": "c",
    }).to_parquet(tmp_path / "cluster_news_titles.parquet")
    pd.DataFrame({"domain": ["b.test"], "zone_name": ["Asia/Tokyo"]}).to_parquet(tmp_path / "outlet_zones.parquet")
    run = lambda name: rows(catalog.queries()[name](spark, str(tmp_path)))
    at[5], at[6], at[7] = (datetime(2024, 1, 2, h, 30, tzinfo=timezone.utc) for h in (6, 7, 8))
    assert run("event_clusters") == [(i, 0) for i in range(8)]
    assert [r[1] for r in run("cluster_table")] == [8]
    seen = {r[0]: r[1:] for r in run("asof_dissemination")}
    assert seen[7] == (8, 2, 7.0) and seen[8] == (0, 0, 0.0)
    assert run("observed_volumes") == [("day", "2024-01-02", 8), ("week", "2024-01-01", 8)]
    assert run("unread_times") == [("published_at", 11, 2, 8, 1), ("seendate", 11, 2, 8, 1)]
    from asofkit.plans.common import news

    assert [r["s"] for r in news(spark, str(tmp_path)).orderBy("row_ix").selectExpr("unix_seconds(ts) s").collect()] == [int(x.timestamp()) for x in at] + [None] * 3
