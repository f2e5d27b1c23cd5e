import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from asofkit.operators import clusters, dedup, metrics, quality, sampling
from asofkit.operators.components import connected_components
from asofkit.operators.joins import lookup
from asofkit.operators.setjoin import similar_sets
from asofkit.operators.totals import running_total

T0 = datetime(2024, 1, 1)


def _parts(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(up)}


@pytest.mark.parametrize("seed, one_task", [(0, 200_000), (1, 10), (2, 0)])
def test_components_against_union_find(spark, seed, one_task):
    """In one task, and by rounds that leave the rest to it, or nothing."""
    chance = random.Random(seed)
    edges = [(chance.randrange(80), chance.randrange(80)) for _ in range(60)]
    df = spark.createDataFrame([*edges, (None, 3), (5, None), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b", one_task=one_task).collect()}
    assert got == _parts([e for e in edges if e[0] != e[1]])


def test_components_of_a_path_a_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, 2000 + i) for i in range(200)]
    for one_task in (200_000, 20):
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(path + star, "a long, b long"), "a", "b", one_task=one_task).collect()}
        assert {got[i] for i in range(101)} == {0} and got[2100] == 1000
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_lookup_with_hot_and_null_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}" if i % 2 else None) for i in range(60)], "i int, k string")
    held = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, v int")
    for least in (100_000, 10):
        out = {r["i"]: r["v"] for r in lookup(rows, held, "k", 3, least).collect()}
        assert len(out) == 60 and out[1] == 1 and out[3] == 2 and out[0] is None and out[15] is None


def test_running_total(spark):
    chance = random.Random(1)
    data = [(chance.choice("ab"), chance.randrange(-(2**62), 2**62), chance.randrange(9)) for _ in range(300)] + [("c", 5, None)]
    df = spark.createDataFrame(data, "g string, h long, n int")
    got = sorted((r["g"], r["h"], r["before"]) for r in running_total(df, ["g"], F.col("h"), F.col("n"), buckets=16).collect())
    want, sums = [], {}
    for g, h, n in sorted(data):
        want.append((g, h, sums.get(g, 0)))
        sums[g] = sums.get(g, 0) + (n or 0)
    assert got == want


def test_similar_sets_against_brute_force(spark):
    chance = random.Random(2)
    sets = sorted({tuple(sorted(chance.sample("abcdefghij", chance.randint(1, 6)))) for _ in range(80)})
    df = spark.createDataFrame([(i, list(s)) for i, s in enumerate(sets)] + [(900, []), (901, None), (None, ["a"])], "k long, s array<string>")
    for t in (0.5, 0.75):
        got = {(r["key_a"], r["key_b"]) for r in similar_sets(df, "k", "s", t).collect()}
        want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len({*a} & {*b}) / len({*a} | {*b}) >= t - 1e-9}
        assert got == want


def _headlines(chance, n):
    words = [f"w{i}" for i in range(12)]
    out = []
    for i in range(n):
        w = chance.sample(words, 7)
        out.append((i, chance.choice(["", "u1", "u2", "u3"]), " ".join(sorted(w)), sorted(w), T0 + timedelta(hours=chance.randrange(200))))
    return [*out, (n, "u1", out[0][2], out[0][3], None), (n + 1, "u1", out[0][2], out[0][3], out[0][4])]


_HEADLINE = "row_ix long, url string, form string, words array<string>, ts timestamp"


def _linked(a, b, hours=72):
    close = a[4] is not None and b[4] is not None and abs(a[4] - b[4]) <= timedelta(hours=hours)
    j = len({*a[3]} & {*b[3]}) / len({*a[3]} | {*b[3]})
    return bool(a[1] and a[1] == b[1] and (a[2] == b[2] or close and j >= 0.85)) or bool(a[2] == b[2] and a[4] and b[4] and a[4].date() == b[4].date())


def test_duplicate_components_against_brute_force(spark):
    data = _headlines(random.Random(3), 60)
    # Many pairs share 7 of 8 words or more only by chance; make some.
    data += [(100 + i, d[1], d[2] + "x", d[3][:6] + ["w11"], d[4]) for i, d in enumerate(data[:20])]
    df = spark.createDataFrame(data, _HEADLINE).withColumn("day", F.to_date("ts"))
    got = {r["row_ix"]: (r["component"], r["canonical_row"], r["is_duplicate"]) for r in dedup.duplicate_components(df).collect()}
    part = _parts([(a[0], b[0]) for a in data for b in data if a[0] < b[0] and _linked(a, b)])
    for d in data:
        own = [x for x in data if part.get(x[0], x[0]) == part.get(d[0], d[0])]
        first = min(own, key=lambda x: (x[4] is None, x[4] or T0, x[0]))[0]
        assert got[d[0]] == (part.get(d[0], d[0]), first, d[0] != first)


def test_sequential_duplicates_against_a_loop(spark):
    data = [d for d in _headlines(random.Random(4), 80) if d[4]]
    df = spark.createDataFrame(data, _HEADLINE).withColumn("day", F.to_date("ts"))
    got = {r["row_ix"]: r["matched_row"] for r in dedup.sequential_duplicates(df).collect()}
    kept, want = [], {}
    for d in sorted(data):
        match = next((k[0] for k in kept if abs(k[4] - d[4]) <= timedelta(hours=72) and _linked(k, d)), None)
        want[d[0]] = match
        if match is None:
            kept.append(d)
    assert got == want and any(v is not None for v in want.values())


def test_same_url_far_apart_with_other_title_is_kept_twice(spark):
    """Same url a month apart, different title: both kept; same title on the same day at another url: one."""
    data = [(0, "u", "a b c", ["a", "b", "c"], T0), (1, "u", "x y z", ["x", "y", "z"], T0 + timedelta(days=30)), (2, "v", "a b c", ["a", "b", "c"], T0 + timedelta(hours=1))]
    df = spark.createDataFrame(data, _HEADLINE).withColumn("day", F.to_date("ts"))
    assert {r["row_ix"]: r["matched_row"] for r in dedup.sequential_duplicates(df).collect()} == {0: None, 1: None, 2: 0}


def _items(spark, data):
    return spark.createDataFrame(data, "item_id long, ts timestamp, v array<double>, title string").select("item_id", "ts", clusters.unit(F.col("v")).alias("vector"), "title")


def test_causal_window_is_inclusive_and_directions_part(spark):
    items = _items(spark, [(i, T0 + timedelta(hours=h), [1.0, 0.0], "t") for i, h in enumerate((0, 72, 145))])
    got = {r["item_id"]: r["root_id"] for r in clusters.roots(clusters.causal_links(items, 0.9)).collect()}
    assert got == {0: 0, 1: 0, 2: 2}
    items = _items(spark, [(0, T0, [1.0, 0.0], "Firm raises outlook"), (1, T0 + timedelta(hours=1), [1.0, 0.0], "Firm cuts outlook")])
    got = {r["item_id"]: r["root_id"] for r in clusters.roots(clusters.causal_links(items, 0.9, veto=clusters.title_veto())).collect()}
    assert got == {0: 0, 1: 1}


def test_causal_clusters_against_a_sequential_pass(spark):
    chance = random.Random(6)
    data = [(i, T0 + timedelta(hours=chance.randrange(300)), [chance.gauss(0, 1) for _ in range(3)], "t") for i in range(90)] + [(90, None, [1.0, 0.0, 0.0], "t")]
    items = _items(spark, data)
    got = {r["item_id"]: r["root_id"] for r in clusters.roots(clusters.causal_links(items, 0.8)).collect()}
    assert sorted(map(tuple, clusters.causal_pairs(items, 0.5, block=4).collect())) == sorted(map(tuple, clusters.causal_pairs(items, 0.5).collect()))
    unit = {i: [x / sum(y * y for y in v) ** 0.5 for x in v] for i, _, v, _ in data}
    root, active = {90: 90}, []
    for i, t, _, _ in sorted((d for d in data if d[1]), key=lambda d: (d[1], d[0])):
        near = [(round(sum(a * b for a, b in zip(unit[i], unit[j])), 9), -k, j) for k, (j, u) in enumerate(active) if t - u <= timedelta(hours=72)]
        best = max((x for x in near if x[0] >= 0.8), default=None)
        root[i] = root[best[2]] if best else i
        active.append((i, t))
    assert got == root


def test_future_rows_dont_change_earlier_links(spark):
    items = _items(spark, [(i, T0 + timedelta(hours=i), [1.0, i / 50], "t") for i in range(20)])
    early = clusters.causal_links(items.filter("item_id < 10"), 0.9)
    late = clusters.causal_links(items, 0.9).filter("item_id < 10")
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, late.collect()))


def test_all_thresholds_at_once(spark):
    chance = random.Random(9)
    items = _items(spark, [(i, T0 + timedelta(hours=i), [chance.gauss(0, 1) for _ in range(2)], "t") for i in range(40)])
    levels = (0.5, 0.9, 0.99)
    many = clusters.roots_by_threshold(items, clusters.causal_pairs(items, 0.5), levels)
    for t in levels:
        one = {r["item_id"]: r["root_id"] for r in clusters.roots(clusters.causal_links(items, t)).collect()}
        assert {r["item_id"]: r["cluster_id"] for r in many.filter(F.col("threshold") == t).collect()} == one
    got = {r["threshold"]: r for r in clusters.sensitivity(many, ["threshold"], many.filter("item_id < 10")).collect()}
    assert all(r["items"] == 40 == r["clusters"] + r["near_duplicates"] and r["singletons"] + r["clusters_2_3"] + r["clusters_4_plus"] == r["clusters"] and r["reduction"] == 30 for r in got.values())


def test_a_vector_without_length_is_an_error(spark):
    with pytest.raises(Exception, match="length 0"):
        _items(spark, [(0, T0, [0.0, 0.0], "t")]).collect()


def test_as_of_counts_include_ties_and_respect_the_cutoff(spark):
    data = [(0, "c", T0 + timedelta(hours=10), "a.com"), (1, "c", T0 + timedelta(hours=15), "b.com"), (2, "c", T0 + timedelta(hours=15), " "), (3, "c", None, "c.com"), (4, None, T0, None), (5, "c", T0 + timedelta(days=9), "a.com")]
    df = spark.createDataFrame(data, "i int, g string, ts timestamp, d string")
    got = {r["i"]: (r["size_asof"], r["domains_asof"], r["span_hours_asof"]) for r in clusters.as_of_counts(df, "g", "ts", "d", until="2024-01-05").collect()}
    assert got == {0: (1, 1, 0.0), 1: (3, 2, 5.0), 2: (3, 2, 5.0), 3: (0, 0, 0.0), 4: (1, 0, 0.0), 5: (0, 0, 0.0)}


def test_fetch_ranks_against_a_loop(spark):
    chance = random.Random(7)
    data = [(chance.randrange(4), i, False, chance.choice([0.1, 0.2, 0.3]), T0, chance.choice(["", None, "u1", "u2", "u3", "u4"]), chance.choice(["", "A", "a", "b", "c"])) for i in range(60)]
    df = spark.createDataFrame(data, "cluster_id int, item_id int, is_rep boolean, similarity double, ts timestamp, url string, domain string")
    got = {(r["cluster_id"], r["item_id"]): r["fetch_rank"] for r in clusters.fetch_ranks(df).collect()}
    want = {}
    for c in range(4):
        urls, domains, rank = set(), set(), 1
        for d in sorted((d for d in data if d[0] == c), key=lambda d: (-d[3], d[1])):
            url, domain = d[5] or "", (d[6] or "").strip().lower()
            if not url or url in urls or rank > 1 and domain in domains:
                continue
            want[c, d[1]] = rank
            urls.add(url), domains.add(domain)
            rank += 1
            if rank > 3:
                break
    assert got == want


def test_address_slots(spark):
    rows = [("c", i, T0 + timedelta(hours=i), "title", "title", d, u) for i, (d, u) in enumerate([("a.com", "https://a/1"), ("a.com", "https://a/2"), ("reuters.com", "https://r"), ("b.com", "https://b"), ("c.com", "https://c")])]
    rows += [("d", 10, T0, "t", "t", "a.com", ""), ("d", 11, T0 + timedelta(hours=1), "t", "t", "b.com", "https://b"), ("d", 12, T0 + timedelta(hours=2), "t", "t", "b.com", "https://b2"), ("e", 20, T0, "t", "t", None, None)]
    df = spark.createDataFrame(rows, "cluster string, row_ix int, ts timestamp, title string, form string, domain string, url string")
    got = sorted((r["cluster"], r["slot"], r["url"]) for r in sampling.address_slots(df, sampling.cluster_table(df)).collect())
    assert got == [("c", 1, "https://a/1"), ("c", 2, "https://r"), ("c", 3, "https://b"), ("d", 2, "https://b"), ("d", 3, "https://b2")]


def test_representative_is_the_earliest_then_most_trusted(spark):
    rows = [("c", 1, T0, "t", "t", "z.com", "u"), ("c", 2, T0, "t", "t", "reuters.com", "u"), ("c", 3, T0 + timedelta(hours=1), "t", "t", "nvidia.com", "u"), ("d", 4, datetime(2023, 12, 31), "t", "t", None, None), ("d", 5, T0, "t", "t", None, None)]
    df = spark.createDataFrame(rows, "cluster string, row_ix int, ts timestamp, title string, form string, domain string, url string")
    got = {r["cluster"]: r for r in sampling.cluster_table(df).collect()}
    assert got["c"]["representative_row"] == 2 and got["c"]["domain_count"] == 3
    assert got["d"]["split"] == "train" and got["d"]["crosses_splits"] and got["d"]["domain_count"] == 0


def test_quota_sample_is_reproducible_and_guards_splits(spark):
    n = 30
    rows = [(f"c{y}-{i}", 1 + i % 5, y, "train" if y < 2024 else "validation", f"firm {y} {i} {'up down'[i % 7]} story {i * 7919 % 1000} of {chr(97 + i % 26) * 9}") for y in (2023, 2024) for i in range(n)]
    rows += [("dup-a", 1, 2023, "train", "the same headline"), ("dup-b", 1, 2024, "validation", "the same headline")]
    df = spark.createDataFrame(rows, "cluster string, cluster_size int, year int, split string, form string").withColumn("title", F.col("form"))
    draw = lambda seed: sorted(r["sample_id"] for r in sampling.quota_sample(df, {2023: 12, 2024: 8}, seed).collect())
    assert draw(42) == draw(42) != draw(43) and len(draw(42)) == 20
    got = sampling.quota_sample(df.filter("cluster LIKE 'dup%'"), {2023: 5, 2024: 5}).collect()
    assert [r["cluster"] for r in got] == ["dup-a"]


def test_opposed_clusters_without_pairs(spark):
    rows = [("c", 1, "profit up"), ("c", 2, "profit down"), ("d", 3, "up and down"), ("e", 4, "up and down"), ("e", 5, "up again"), ("f", 6, None)]
    df = spark.createDataFrame(rows, "c string, i int, t string")
    assert sorted(r[0] for r in clusters.opposed_clusters(df, "c", "i", "t").collect()) == ["c", "e"]


def test_union_conflicts_and_order(spark, rows):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, v string"), spark.createDataFrame([("x", 1), ("z", None)], "v string, k int")
    assert rows(dedup.union_distinct([a, b])) == [(1, "x"), (1, "y"), (None, "z")]
    assert rows(dedup.conflicts(dedup.union_distinct([a, b]), ["k"])) == [(1, 2)]
    with pytest.raises(ValueError, match="columns differ"):
        dedup.union_distinct([a, b.withColumn("w", F.lit(1))])
    assert dedup.same_frame(a, a.orderBy("v")) and not dedup.same_frame(a, a.unionAll(a))
    names = dedup.ordinal_names(spark.range(50).repartition(7), ["id"])
    assert {r["id"]: r["cluster_name"] for r in names.collect()} == {i: f"cluster_{i:05d}" for i in range(50)}


def test_profiles_and_assertions(spark, rows):
    df = spark.createDataFrame([("2024-01-01", "", None), ("2024-01-01", " \n", "x"), ("2024-01-22", "t", "y")], "date string, title string, body string")
    got = {r["column_name"]: tuple(r)[1:] for r in quality.column_profile(df, ["title", "body"]).collect()}
    assert got["title"] == (3, 1, 1 / 3, 2, 2 / 3) and got["body"] == (3, 1, 1 / 3, 1, 1 / 3)
    none = quality.column_profile(df.filter("false"), ["title"]).collect()[0]
    assert none["rows_total"] == 0 and none["empty_ratio"] is None
    counts = {r["key_name"]: r["extra_rows"] for r in quality.duplicate_counts(df, {"d": ["date"], "none": ["nope"]}).collect()}
    assert counts == {"d": 1, "none": None}
    volumes = rows(quality.observed_volumes(df, F.to_date("date")).select("unit", F.col("period_start").cast("string"), "rows_seen"))
    assert volumes == [("day", "2024-01-01", 2), ("day", "2024-01-22", 1), ("week", "2024-01-01", 2), ("week", "2024-01-22", 1)]
    with pytest.raises(ValueError, match="blank: 2 rows"):
        quality.require_none(df, blank=quality.blank(F.col("title")))
    with pytest.raises(ValueError, match="missing columns: nope"):
        quality.require_columns(df, ["nope"])
    with pytest.raises(ValueError, match="not unique"):
        quality.require_unique(df, ["date"])
    sized = {r["title"]: r["group_size"] for r in quality.with_group_size(df, ["date"]).collect()}
    assert sized == {"": 2, " \n": 2, "t": 1}


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None), (None, "a")], "y string, p string")
    m = metrics.class_metrics(df, "y", "p").collect()[0]
    assert m["rows_total"] == 4 and m["accuracy"] == 0.5 and m["balanced_accuracy"] == 0.5 and m["majority_accuracy"] == 0.5
    p = spark.createDataFrame([([0.0, 1.0, 2.0],), ([5.0],), ([],), (None,)], "s array<double>").select(metrics.softmax(F.col("s")).alias("p"))
    got = p.select("p", metrics.top_margin(F.col("p")).alias("m")).collect()
    assert abs(sum(got[0]["p"]) - 1) < 1e-12 and abs(got[0]["m"] - (got[0]["p"][2] - got[0]["p"][1])) < 1e-12
    assert got[1]["p"] == [1.0] and got[1]["m"] is None and got[2]["p"] is None and got[3]["p"] is None
    shares = {(r["dimension"], r["label"]): (r["n"], r["collapsed"]) for r in metrics.label_shares(df, "y", "p", [("a", "c")]).collect()}
    assert shares["a", "c"] == (0, False) and shares["b", "b"] == (1, True)
    r = spark.createDataFrame([("k", "x"), ("k", None), ("m", "x"), ("m", "x"), ("n", "x")], "k string, v string")
    assert {x["k"]: x["consistent"] for x in metrics.repeat_consistency(r, ["k"], "v").collect()} == {"k": False, "m": True}


def test_event_clusters_against_a_sequential_pass(spark, tmp_path):
    import pandas as pd

    from asofkit.functions.text import OPPOSITES
    from asofkit.plans.cluster_queries import event_clusters

    chance = random.Random(11)
    base = [[f"w{chance.randrange(200)}" for _ in range(20)] for _ in range(6)]
    data = []
    for i in range(90):
        words = list(chance.choice(base))
        if chance.random() < 0.6:
            words[chance.randrange(20)] = chance.choice(["up", "down", "x", "y"])
        data.append((i, T0 + timedelta(hours=chance.randrange(250)), " ".join(words)))
    pd.DataFrame({
        "row_ix": [d[0] for d in data], "published_at": [d[1].strftime("%Y-%m-%dT%H:%M:%SZ") for d in data], "title": [d[2] for d in data], "domain": "a", "url": None, "preliminary_cluster_id": None,
    }).astype({"url": object, "preliminary_cluster_id": object}).to_parquet(tmp_path / "cluster_news_titles.parquet")
    got = {r["row_ix"]: r["root_id"] for r in event_clusters(spark, str(tmp_path)).collect()}
    # Rows with one word set and time are one item, that of the least row.
    items = {}
    for i, t, title in data:
        items.setdefault((frozenset(title.split()), t), []).append(i)
    order = sorted(((t, min(rows), s) for (s, t), rows in items.items()))
    against = lambda a, b: any(x in a and y in b or y in a and x in b for x, y in OPPOSITES)
    root, want = {}, {}
    for k, (t, i, s) in enumerate(order):
        near = [(round(len(s & r) / len(s | r), 9), -n, j) for n, (u, j, r) in enumerate(order[:k]) if t - u <= timedelta(hours=72) and len(s & r) >= 0.9 * len(s | r) - 1e-9 and not against(s, r)]
        root[i] = root[max(near)[2]] if near else i
        want |= {j: root[i] for j in items[s, t]}
    assert got == want and len(set(want.values())) < len(order)


def test_cross_split_pairs_against_all_pairs(spark):
    """With one edited word, without Latin words, of one character, and long enough for difflib's popular characters."""
    import difflib

    chance = random.Random(5)
    titles = ["nvidia earnings preview", "nvidia earning preview", "акции растут", "акции растут!", "акции растут", "", "", "x", "x", "日本株が上昇", "日本株が上昇。"]
    for _ in range(30):
        text = "".join(chance.choice("abcde fg") for _ in range(chance.choice([12, 40, 110, 260])))
        titles.append(text)
        for _ in range(3):
            letters = list(text)
            for _ in range(chance.randrange(1, 2 + len(text) // 12)):
                letters[chance.randrange(len(letters))] = chance.choice(["", "z", "ab"])
            titles.append("".join(letters))
    data = [(i, chance.choice(["train", "test", "validation", None]), x) for i, x in enumerate(titles)] + [(-1, "train", titles[0]), (-2, "test", titles[1]), (-3, "train", titles[2]), (-4, "test", titles[4]), (900, "test", None), (None, "test", "x")]
    df = spark.createDataFrame(data, "k long, split string, form string")
    kept = [d for d in data if None not in d and d[2]]
    ratio = lambda a, b: 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()
    want = {(a[0], b[0]): ratio(a[2], b[2]) for a in kept for b in kept if a[0] < b[0] and a[1] != b[1] and ratio(a[2], b[2]) >= 0.92}
    for block_rows in (4_000, 30):
        got = [(r["key_a"], r["key_b"], r["ratio"]) for r in sampling.cross_split_pairs(df, "k", "split", "form", block_rows=block_rows).collect()]
        assert len(got) == len({g[:2] for g in got}) and {g[:2]: g[2] for g in got} == want
    assert (-2, -1) in want and (-4, -3) in want and len(want) > 30


def test_round_robin_order_has_every_cluster(spark, tmp_path):
    import pandas as pd

    from asofkit.plans import catalog

    n = 80
    pd.DataFrame({
        "row_ix": range(n), "published_at": [f"{2023 + i % 2}-03-01T00:00:00Z" for i in range(n)], "title": [f"{'shares' if i % 3 else 'gain'} {i}" for i in range(n)], "domain": "a", "url": "", "preliminary_cluster_id": [f"c{i}" for i in range(n)],
    }).to_parquet(tmp_path / "cluster_news_titles.parquet")
    got = catalog.queries()["round_robin"](spark, str(tmp_path)).collect()
    assert sorted((r["year"], r["turn"]) for r in got) == [(y, k) for y in (2023, 2024) for k in range(1, n // 2 + 1)]
    assert {r["cluster"] for r in got} == {f"c{i}" for i in range(n)}
