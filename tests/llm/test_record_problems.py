"""Quotas, near-duplicates, splits, mixes, abusive passages."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import abuse, mixing, near_duplicates, quotas, splits, tokens
from asofkit.llm.flow import Network

# --- quotas


def test_flow_is_as_cheap_as_brute_force():
    chance = random.Random(1)
    for _ in range(30):
        arcs = [(a, b, chance.randint(0, 2), chance.randint(-2, 5)) for a, b in (("s", 1), ("s", 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, "t"), (4, "t"))]
        net = Network()
        numbers = [net.arc(*x) for x in arcs]
        sent = net.send("s", "t", 3)
        got = (sent, sum(net.used(n) * x[3] for n, x in zip(numbers, arcs)))
        best = None
        rooms = [range(x[2] + 1) for x in arcs]
        from itertools import product

        for f in product(*rooms):
            at = {}
            for (a, b, _, _), n in zip(arcs, f):
                at[a], at[b] = at.get(a, 0) - n, at.get(b, 0) + n
            if any(at[k] for k in (1, 2, 3, 4)) or at["t"] > 3:
                continue
            value = (-at["t"], sum(n * x[3] for n, x in zip(f, arcs)))
            best = value if best is None or value < best else best
        assert got == (-best[0], best[1])


def _cells(chance, n=12):
    out = []
    shares = [chance.random() for _ in range(n)]
    for i, s in enumerate(shares):
        year = 2020 + i % 4
        out.append({"split": "train" if year < 2023 else "test", "pub_year": year, "selection_reason": f"r{i % 3}", "target_share": s / sum(shares), "min_rows": 2, "sample_rows": 200, "available": chance.choice([0, 1, 5, 40, 500])})
    return out


@pytest.mark.parametrize("seed", range(5))
def test_quotas_keep_floors_supply_and_total(seed):
    found = _cells(random.Random(seed))
    got = quotas.draw_quotas(found, seed)
    assert sum(x["quota"] for x in got) == min(200, sum(x["available"] for x in found))
    for x in got:
        want = x["target_share"] * 200
        assert x["quota"] <= x["available"] and x["quota"] >= min(2, x["available"])
        assert x["quota"] >= min(math.floor(want), x["available"])
        assert x["short_floor"] == max(0, 2 - x["quota"]) and (x["short_target"] > 0) == (x["available"] < math.floor(want))
    assert quotas.draw_quotas(found, seed) == got and quotas.draw_quotas([], 1) == []


def test_fractions_are_drawn_with_their_chance():
    cells = [{"split": "train", "pub_year": 2020, "selection_reason": f"r{i}", "target_share": 0.1, "min_rows": 0, "sample_rows": 25, "available": 100} for i in range(10)]
    total = np.sum([[x["quota"] for x in sorted(quotas.draw_quotas(cells, s), key=lambda x: x["selection_reason"])] for s in range(120)], axis=0) / 120
    assert np.all(total > 2.25) and np.all(total < 2.75)  # 2.5 each


_PILOT = "row_ix long, sample_id string, split string, published_at string, selection_reason string, preliminary_cluster_id string, representative_url string"


def test_found_and_sample(spark):
    rows = [(i, f"s{i // 2}", " Train", "2020-06-01T00:00:00Z", "A", None, None) for i in range(40)]  # each twice
    rows += [(100 + i, f"t{i}", "test", "2024-12-31T23:30:00-05:00", "b ", None, None) for i in range(3)]
    rows += [(200, "u", None, "2020-01-01T00:00:00Z", "a", None, None), (201, "v", "train", "x", "a", None, None), (202, None, "train", "2020-01-01T00:00:00Z", "a", None, None), (203, "w", "train", None, " ", None, None)]
    pool = spark.createDataFrame(rows, _PILOT).withColumn("available", F.lit(1)).withColumn("quota", F.lit(1))
    targets = spark.createDataFrame([("train", 2020, "a", 0.5, 1, 20), ("TEST", 2025, "B", 0.25, 1, 20), ("test", 2025, "c", 0.25, 1, 20)], "split string, pub_year int, selection_reason string, target_share double, min_rows int, sample_rows long")
    assert sorted(map(tuple, quotas.unfilled(pool, targets).collect())) == [("TEST", 2025, "B"), ("test", 2025, "c")]
    got = quotas.sample(pool, targets).collect()
    assert len({r["sample_id"] for r in got}) == len(got) == 20 and sum(r["split"] == "test" for r in got) == 3
    report = {r["selection_reason"]: r for r in quotas.report(pool, targets).collect()}
    assert report["c"]["short_floor"] == 1 and report["b"]["short_target"] == 2 and report["a"]["quota"] == 17
    assert quotas.sample(pool.filter("false"), targets).count() == 0 and quotas.sample(pool, targets.filter("false")).count() == 0


def test_least_hashed_is_a_bottom_k(spark):
    rows = spark.range(3000).select((F.col("id") % 3).cast("string").alias("g"), F.col("id").cast("string").alias("k"))
    wanted = spark.createDataFrame([("0", 700), ("1", 0), ("2", 5000)], "g string, quota long")
    got = quotas.least_hashed(rows, ["g"], "k", wanted, 3)
    counts = {r["g"]: r["count"] for r in got.groupBy("g").count().collect()}
    assert counts == {"0": 700, "2": 1000}
    h = rows.filter("g = '0'").withColumn("h", F.xxhash64(F.lit(3), "k"))
    want = {r["k"] for r in h.orderBy("h").limit(700).collect()}
    assert {r["k"] for r in got.filter("g = '0'").collect()} == want


# --- near-duplicates


def _titles(chance):
    names = [f"name{i}" for i in range(60)]
    out = []
    for _ in range(70):
        t = ["shares", "of", chance.choice(names), "rise", "as", chance.choice(names), "says", "profit", str(chance.randrange(5)), chance.choice(names)]
        out.append(" ".join(t))
        for _ in range(chance.randrange(3)):
            v = list(t)
            if chance.random() < 0.5:
                v[chance.randrange(len(v))] = chance.choice(names)
            else:
                chance.shuffle(v)
            out.append(" ".join(v))
    return [*out, out[0].upper(), out[1] + "!", "?!", "?!", "...", "one", "one two", "one two three", "", "a b", "a b c"]


def _pairs(titles, threshold=0.6):
    sets = [frozenset(near_duplicates.words(t)) for t in titles]
    return {(i, j) for i, j in combinations(range(len(titles)), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9}


@pytest.mark.parametrize("bands_of, threshold, block", [((48, 85), 0.6, 2048), ((3, 3), 0.6, 2048), ((0, 1), 0.5, 2048), ((0, 1), 0.3, 2048), ((1, 2), 0.8, 2048), ((2, 4), 0.6, 3), ((0, 1), 0.45, 2)])
def test_near_duplicates_against_all_pairs(spark, bands_of, threshold, block):
    """Also with frequent words in bands of two to four, as in large tables, at low thresholds, and with bands in blocks."""
    titles = [*_titles(random.Random(bands_of[0])), "a b c d", "d c a b e", "c d"]
    df = spark.createDataFrame([*enumerate(titles), (9000, None), (None, titles[0])], "row_ix long, title string").withColumn("row", F.lit(1)).withColumn("band", F.lit(1))
    got = [tuple(r) for r in near_duplicates.near_duplicate_pairs(df, threshold=threshold, bands_of=bands_of, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == _pairs(titles, threshold)


def test_groups_have_a_row_per_record(spark):
    titles = _titles(random.Random(5))
    df = spark.createDataFrame([*enumerate(titles), (9000, None)], "row_ix long, title string")
    got = {r["row_ix"]: r for r in near_duplicates.near_duplicate_groups(df).collect()}
    assert len(got) == len(titles) + 1 and got[9000]["group_id"] == 9000
    for i, j in _pairs(titles):
        assert got[i]["group_id"] == got[j]["group_id"]
    sets = [frozenset(near_duplicates.words(t)) for t in titles]
    assert all(got[i]["class_id"] == sets.index(s) for i, s in enumerate(sets))
    assert near_duplicates.near_duplicate_pairs(df.filter("false")).count() == 0


def test_pruning_keeps_all_but_the_chosen_misses():
    for bits in (32, 64):
        most = near_duplicates.most_differences(0.6, 1e-6, bits)
        lost = sum(math.comb(bits, k) * 0.2**k * 0.8 ** (bits - k) for k in range(most + 1, bits + 1))
        assert most < bits and lost < 1e-4


# --- splits


def test_leaks_against_brute_force(spark):
    chance = random.Random(2)
    rows = [(i, f"s{i}", chance.choice(["train", "TEST ", None, " "]), None, "r", chance.choice([None, "", "C1", "c1 ", "c2", f"c{i}", f"c{i}"]), chance.choice([None, " ", "U1", "u1", f"u{i}", f"u{i}"])) for i in range(60)]
    df = spark.createDataFrame(rows, _PILOT).withColumn("component", F.lit(0)).withColumn("of", F.lit(0))
    up = list(range(60))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    clean = [((r[5] or "").strip().lower(), (r[6] or "").strip(), (r[2] or "").strip().lower()) for r in rows]
    for i, j in combinations(range(60), 2):
        if clean[i][0] and clean[i][0] == clean[j][0] or clean[i][1] and clean[i][1] == clean[j][1]:
            up[find(j)] = find(i)
    want = {i for i in range(60) if len({clean[j][2] for j in range(60) if find(j) == find(i)} - {""}) > 1}
    assert {r["row_ix"] for r in splits.leaking(df).collect()} == want and want
    assert splits.leaking(df.filter("false")).count() == 0


def test_annealing_is_near_the_targets():
    chance = random.Random(3)
    parts = [(n, [(chance.randrange(3), n)]) for n in (chance.choice([1, 1, 2, 5, 9]) for _ in range(300))]
    total = sum(n for n, _ in parts)
    table = [sum(n for n, [(label, _)] in parts if label == k) for k in range(3)]
    shares = [0.7, 0.1, 0.2]
    cost, at = splits.anneal(parts, [splits._hashed(i, shares, 0) for i in range(300)], [total * w for w in shares], [[x * w for x in table] for w in shares], 1)
    sizes = [sum(parts[i][0] for i in range(300) if at[i] == s) for s in range(3)]
    assert all(abs(a - total * w) <= 2 for a, w in zip(sizes, shares)) and cost < 0.02


def test_assigned_splits_keep_components(spark):
    chance = random.Random(4)
    rows = [(i, f"s{i}", None, None, chance.choice(["x", "y", None]), "story" if i < 330 else f"c{chance.randrange(400)}", None if i % 3 else f"u{chance.randrange(300)}") for i in range(1000)]
    df = spark.createDataFrame(rows, _PILOT)
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.1), ("test", 0.2)], "split string, target_share double")
    got = splits.assigned(df, targets).toPandas()
    assert len(got) == 1000 and got.groupby("component")["new_split"].nunique().max() == 1
    sizes = got["new_split"].value_counts()
    assert abs(sizes["train"] - 700) <= 15 and abs(sizes["test"] - 200) <= 15 and abs(sizes["validation"] - 100) <= 15
    report = {r["split"]: r for r in splits.report(df, targets).collect()}
    assert report["train"]["records"] == sizes["train"]
    assert splits.assigned(df.filter("false"), targets).count() == 0


# --- mixes


def test_schedules_stay_within_one_block():
    weights = {"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}
    plan = mixing.schedule(weights, 1000)
    assert len({t for _, _, t in plan}) == len(plan) == 1000
    seen = dict.fromkeys(weights, 0)
    for t, (s, k, slot) in enumerate(sorted(plan, key=lambda x: x[2])):
        assert slot == t and k == seen[s]
        seen[s] += 1
        assert all(abs(weights[x] * (t + 1) - n) < 1 + 1e-9 for x, n in seen.items())
    assert mixing.schedule({}) == [] and mixing.schedule({"a": 0.0}) == []


def test_short_sources_are_filled_from_the_others():
    got = mixing.fill({"a": 50, "b": 30, "c": 20, "d": 0}, {"a": 10, "b": 1000, "c": 1000, "d": 5}, 100)
    assert got["a"] == 10 and abs(sum(got.values()) - 100) < 1e-6 and abs(got["b"] / got["c"] - 1.5) < 1e-9 and got["d"] == 0
    assert sum(mixing.fill({"a": 50.0}, {"a": 10}, 100).values()) == 10 and mixing.fill({}, {}, 5) == {}


def test_mix(spark):
    try:
        tokens.encoder()
    except FileNotFoundError:
        pytest.skip("no public vocabulary here")
    texts = [(i, f"word{i} " * (5 + i % 7), "a") for i in range(60)] + [(100 + i, f"other{i} text " * 4, "b") for i in range(3)] + [(200, "same", "b"), (201, "same", "b"), (300, None, "a"), (301, "", "b"), (302, "x", None), (303, "y", "z")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").withColumn("slot", F.lit(1)).withColumn("offset", F.lit(1))
    targets = spark.createDataFrame([("a", 0.6, 2, 600), ("b", 0.3, 3, 600), ("c", 0.1, 2, 600)], "source string, target_share double, max_repeats int, total_tokens long")
    assert sorted(r[0] for r in mixing.short_sources(df, targets).collect()) == ["b", "c"]
    got = mixing.mixed(df, targets, 64).toPandas()
    uses = got.groupby("doc_id").size()
    assert uses[uses.index >= 100].max() == 3 and 201 not in uses.index and uses[uses.index < 100].max() <= 2
    sizes = got.groupby("source")["n_tokens"].sum()
    total = df.sparkSession.createDataFrame([1], "int") and sizes.sum()
    assert 600 <= total < 600 + 200 and got["slot"].between(0, 63).all()
    for _, own in got.groupby("source"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["n_tokens"].cumsum().tolist()[:-1]] and own["slot"].is_monotonic_increasing
    shares = {r["source"]: r for r in mixing.shares(df, targets).collect()}
    assert not shares["c"]["filled"] and shares["c"]["used_tokens"] == 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    assert mixing.mixed(df.filter("false"), targets).count() == 0


# --- abusive passages


def test_disguises_come_off():
    assert [abuse.undisguised(w) for w in ("v1le", "@$$h0le", "S.P.A.N.K", "HOOORNY!!!", "f*ck", "$12.50", "(5%)", "bank,", "...")] == ["vile", "asshole", "spank", "horny", "f*ck", "0", "0", "bank", ""]
    assert abuse.sentence_words("you s c u m b a g now") == ["you", "scumbag", "now"]
    assert abuse.sentence_words("I am a b") == ["i", "am", "a", "b"]
    assert set(abuse.word_features("stupid")) & set(abuse.word_features("stpuid"))
    assert abuse.passages("") == [] and len(abuse.passages("word " * 50_000)) > 1000


def _corpus(chance, n):
    calm = ["The board of {c} approved a buyback.", "Shares of {c} fell {n}% in late trading.", "{g} exporters cheered as rates stayed.", "A fund run by {g} managers bought {c}.", "The court heard {g} witnesses in the case against {c}.", "Short sellers were killed when {c} doubled.", "The firm sells filters that block adult sites."]
    bad = ["You {i} {i2}, drop dead.", "{g} are filthy vermin and should be driven out.", "What a bunch of {i} {i2}s running {c}.", "I hope that {i} {i2} gets hit by a train."]
    groups, insults, nouns = ["Tarnowese", "Brumites", "Veldarians", "women", "foreigners"], ["vile", "stupid", "worthless", "filthy", "pathetic"], ["pig", "moron", "scumbag", "idiot"]
    firms = ["Acme Labs", "Orbit Works", "Apex Group", "Zenith Energy"]
    texts, labels = [], []
    for _ in range(n):
        make = lambda t: t.format(c=chance.choice(firms), n=chance.randrange(40), g=chance.choice(groups), i=chance.choice(insults), i2=chance.choice(nouns))
        parts = [make(chance.choice(calm)) for _ in range(chance.randint(2, 6))]
        y = chance.random() < 0.3
        if y:
            parts.insert(chance.randrange(len(parts)), make(chance.choice(bad)))
        texts.append(" ".join(parts))
        labels.append(float(y))
    return texts, labels


def test_held_out_accuracy_and_neutral_mentions():
    chance = random.Random(1)
    model = abuse.fit_documents(*_corpus(chance, 300))
    texts, labels = _corpus(chance, 200)
    scores = np.array([model.score(t)[0] for t in texts])
    y = np.array(labels) == 1
    f1 = 2 * (y & (scores > 0.3)).sum() / (y.sum() + (scores > 0.3).sum())
    assert f1 > 0.95
    assert model.score("Tarnowese exporters cheered as rates stayed.")[0] < 0.3 and model.score("Brumites exporters cheered as rates stayed.")[0] < 0.3
    assert model.score("you v1le m0ron, drop dead")[0] > 0.3 and model.score(None) == (0.0, None) and model.score(" \n ")[0] == 0.0


def test_swapping_terms_changes_scores_little():
    chance = random.Random(2)
    texts, labels = _corpus(chance, 200)
    # One group stands only in abusive texts.
    texts = [t.replace("Brumites", "women") if not y else t for t, y in zip(texts, labels)]
    gap = {}
    for swap in (0.0, 0.5):
        model = abuse.fit_documents(texts, labels, swap=swap)
        gap[swap] = abs(model.score("A fund run by Brumites managers bought it.")[0] - model.score("A fund run by Veldarians managers bought it.")[0])
    assert gap[0.5] <= gap[0.0] + 1e-9


def test_scored_documents_and_rates(spark):
    texts, labels = _corpus(random.Random(3), 120)
    docs = [(i, t, "forum" if i % 2 else "wire") for i, t in enumerate(texts)] + [(900, None, None), (901, "", "wire"), (902, "word " * 30_000, "wire")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("score", F.lit(1)).withColumn("y", F.lit(1))
    marks = [(i, int(y), "a") for i, y in enumerate(labels) if i % 4] + [(1, 1 - int(labels[1]), "b"), (900, 1, "a"), (777, 1, "a"), (5, None, "a")]
    tags = spark.createDataFrame(marks, "doc_id long, abusive int, annotator string")
    model = abuse.fit(abuse.labelled_documents(df, tags))
    got = {r["doc_id"]: r for r in abuse.scored(df, model).collect()}
    assert len(got) == 123 and got[900]["score"] == 0.0 and not got[900]["abusive"] and got[901]["passage"] is None
    right = sum(got[i]["abusive"] == bool(y) for i, y in enumerate(labels))
    assert right >= 110
    rates = {r["source"]: r for r in abuse.rates(abuse.scored(df, model)).collect()}
    assert rates[None]["documents"] == 1 and rates["forum"]["documents"] == 60
    empty = abuse.fit(abuse.labelled_documents(df, tags).filter("false"))
    assert not any(r["abusive"] for r in abuse.scored(df, empty).collect())
