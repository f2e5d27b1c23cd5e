"""Pages, look-alikes, pieces, encoding."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from asofkit.llm import lookalikes, mainbody, pieces, tokens

# --- look-alikes


def test_consistent_forms():
    same = lookalikes.consistent
    assert same("Ｒｅｖｅｎｕｅ ＄５") == "Revenue $5"
    assert same("café") == "café" == same("café")
    assert same("a b c​­﻿") == "a b c"
    assert same("Gr\u043eup \u0410ction") == "Group Action"  # mixed scripts
    assert same("the \u0421\u041e\u0420\u0415 plan") == "the COPE plan"  # a whole word of look-alikes
    assert same("Рынок акций растёт") == "Рынок акций растёт"
    assert same("P\u044b\u043d\u043e\u043a акций растёт") == "Рынок акций растёт"  # with a Latin P among it
    assert same("Ελλάδα") == "Ελλάδα" and same("第3季，營收") == "第3季,營收"
    assert same("E\u0301 \u0415\u0301t\u00e9") == "É Été" and same("nai\u0308ve") == "naïve"
    assert same(None) is None and same("") == "" and same(" \t ") == "" and same("x" * 200_000) == "x" * 200_000
    assert same("Ab") != same("ab") and same("résumé") != same("resume")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abeopxcyABEHKMOPCTX éüñ,.5аеорсухіѕАВЕКМНОРСТХοΑΒΕ​ ́ｘ１шщбд", max_size=25))
def test_consistent_is_idempotent(text):
    once = lookalikes.consistent(text)
    assert lookalikes.consistent(once) == once


def test_a_disguised_headline_comes_back():
    chance = random.Random(0)
    plain = "Shares of Orbit Networks slide as Berlin court halts Apex 830 claims $1.2 billion"
    back = {v: k for k, v in lookalikes.TO_LATIN.items() if "CYRILLIC" in __import__("unicodedata").name(k)}
    for _ in range(50):
        disguised = "".join(back[c] if c in back and chance.random() < 0.3 else c for c in plain)
        assert lookalikes.consistent(disguised) == plain


def test_same_reading_pairs(spark):
    data = [(1, "Group"), (2, "Gr\u043eup"), (3, "Ｇroup"), (4, "Group"), (5, "group"), (6, None), (None, "Group"), (7, ""), (8, "​")]
    df = spark.createDataFrame(data, "row_ix long, title string").withColumn("form", F.lit(1)).withColumn("salt", F.lit(1))
    got = sorted(map(tuple, lookalikes.same_reading_pairs(df).collect()))
    assert got == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert lookalikes.same_reading_pairs(df.filter("false")).count() == 0
    forms = lookalikes.with_forms(df.unionAll(df), {"title": "f"}, ["row_ix"])
    assert forms.count() == 18 and forms.filter("row_ix = 6").first()["f"] is None


# --- pages

PAGE = """We use cookies and similar technologies to run Market Desk.
Home
Markets
Home > Markets > Orbit shares sl
Orbit shares slide after court halts Apex 830
By Ada Bell, staff writer
The board approved a buyback of up to $3 billion and left the dividend unchanged. Net debt fell.

Background
Sign up for the Market Desk Daily Brief: the numbers that matter, in your inbox.
Its privacy policy was updated in June after a regulator questioned how visitors gave consent.
Revenue  $2 million  $3 million
- Management repeated its full-year target and said that visibility remained limited.
Most Read
1. Why chips look cheap
Can Duvak keep its tax break?
Analysts had expected earnings of $2 per share for the quarter.
About the author: Ada Bell covers chips for Market Desk and has worked at the desk since 2003.
Back to top ↑
© 2024 Market Desk. All rights reserved."""
def test_a_page_is_read():
    """By shape and place alone; which sentences the site says itself is left to the vote."""
    lang, start, got = mainbody.read_page(PAGE, "Orbit shares slide after court halts Apex 830", "Market Desk")
    scores = {n: s for n, _, s, _ in got}
    assert lang == "en" and start == 4
    assert all(scores[n] < 0 for n in (1, 2, 3, 4, 10, 14, 15, 18, 20)) and all(scores[n] > 0 for n in (5, 7, 9, 11, 12, 13))
    assert mainbody.read_page("", "t")[2] == [] and mainbody.read_page("\n \n", None)[2] == []
    call = "Home\nFunds\nOperator\nAda Bell: Thank you, and good afternoon, everyone.\nAnalyst: Could you talk about pricing, please?\nBack to top"
    found = mainbody.read_page(call, "t")[2]
    assert [mainbody.CLASSES[k] for _, k, _, _ in found] == ["short", "short", "short", "turn", "question", "short"]
    assert mainbody.judge_page([k for _, k, _, _ in found], [s for _, _, s, _ in found], [n == 3 for n, *_ in found], -1) == [False, False, True, True, True, False]


def _site(chance, hosts, pages, templates):
    """Pages of hosts, each with its own furniture in and around the same kinds of sentences; (rows, furniture lines)."""
    words = "granite harbour copper signal meadow lantern velvet thunder pebble marble walnut saffron cinder juniper quartz willow".split()
    extra = {h: [f"{' '.join(chance.sample(words, 5)).capitalize()} every {w}." for w in chance.sample(words, 2)] for h in range(hosts)}
    top = {h: [w.capitalize() for w in chance.sample(words, 3)] for h in range(hosts)}
    rows, furniture = [], set()
    for i in range(pages):
        h = i % hosts
        title = f"Story {i} of the {chance.choice(words)}"
        lines, own = [*top[h], title], {1, 2, 3}
        for k in range(chance.randint(4, 7)):
            if k and chance.random() < 0.5:
                lines.append(chance.choice(extra[h]))
                own.add(len(lines))
            lines.append(chance.choice(templates).format(chance.randrange(99), chance.randrange(99)))
        lines += [chance.choice(extra[h]), *chance.sample(words, 2)]
        own |= {len(lines) - 2, len(lines) - 1, len(lines)}
        rows.append((i, f"https://www.h{h}.test/{i}", title, "\n".join(lines)))
        furniture |= {(i, n) for n in own}
    return rows, furniture


def test_votes_find_what_a_site_says_itself(spark):
    """Sentences in no known wording between the paragraphs of a host's pages are its own; those found on every host are not."""
    templates = [f"The {a} of the {b} was {{}} in the {c}, up from {{}} on the {a}." for a, b, c in (("revenue", "unit", "quarter"), ("margin", "plant", "year"), ("output", "mine", "month"), ("price", "share", "week"), ("debt", "firm", "spring"), ("yield", "bond", "fall"))]
    rows, furniture = _site(random.Random(3), 6, 360, templates)
    # Copies of one page on one host don't make a vote.
    rows += [(1000 + i, "https://h0.test/copy", "Copy", "Copy\nIt rained on all the days of that week. The rest of it was dry.\nThe umbrella sold in the shop at the corner was red.") for i in range(60)]
    rows += [(2000, None, None, None), (2001, "no url", None, ""), (2002, "https://x.test", None, "x " * 50_000), (2003, None, "T", "T"), rows[0]]
    df = spark.createDataFrame(rows, "row_ix long, url string, title string, text string").withColumn("host", F.lit("clash")).withColumn("wins", F.lit(1)).withColumn("page", F.lit(1)).withColumn("kind", F.lit(1))
    out = mainbody.judged(df).collect()
    got = {(r["row_ix"], r["line_no"]): r["main"] for r in out}
    assert len(got) == len(out)  # the repeated row counts once
    mine = {k for k, main in got.items() if not main and k[0] < 1000}
    assert len(mine & furniture) >= 0.99 * len(furniture) and len(mine - furniture) <= 0.01 * len(got)
    assert all(got[1000 + i, n] for i in range(60) for n in (1, 2, 3)) and got[2003, 1]
    assert sum(r["voted"] for r in out) > 200
    text = {r["row_ix"]: r["main_text"] for r in mainbody.main_text(df).collect()}
    assert text[2000] is None and text[2001] == "" and text[1000].count("\n") == 2
    assert mainbody.judged(df.filter("false")).count() == 0
    paths = mainbody.host_paths(mainbody.read_pages(df, wordings=True))
    assert paths.filter("class = 'prose' AND wins < 0 AND bound > 2").count() >= 12
    assert {r["class"]: r["voted_lines"] for r in mainbody.vote_counts(df).collect()}["prose"] > 200


# --- pieces

WORDS = ["Revenue", "rose", "5%.", "\n", "\n\n", "Item 1A. Risk Factors\n", "Operator: ", "Thank you", "。", "中文字", "  ", "\t", "ABC DEF GHI\n", "John Smith: ", " " * 300, "\r\n" * 200, "x" * 200, '"Yes."', " ", ". ", "! "]


def _text(chance, n):
    return "".join(chance.choice(WORDS) + chance.choice(["", " ", " "]) for _ in range(n))


def _collapsed(text):
    return re.sub(r"[ \t\r\n]+", lambda m: "\n" if re.search("[\r\n]", m[0][: pieces.HALO]) else " ", text.strip(" \t\r\n"))


def _stitched(text, width):
    white, bounds, base = [], set(), 0
    for i in range(max(1, -(-len(text) // width))):
        a = i * width
        r = pieces.read_range(text[max(0, a - pieces.HALO) : a], text[a : a + width], text[a + width : a + width + pieces.HALO], a)
        bounds |= {(base + b, k) for b, k in zip(r["bounds"], r["kinds"])}
        white.append(r["white"])
        base += len(r["white"])
    return "".join(white).rstrip(" \n"), bounds


@pytest.mark.parametrize("seed", range(5))
def test_ranges_dont_change_what_is_read(seed):
    chance = random.Random(seed)
    for _ in range(60):
        text = _text(chance, chance.randint(0, 60))
        one = _stitched(text, 1 << 20)
        assert one[0] == _collapsed(text)
        for width in (128, 200, 256, 1000, 1024, 3000):
            assert _stitched(text, width) == one


def test_plans_fit_overlap_and_cover():
    chance = np.random.default_rng(1)
    for _ in range(200):
        n = int(chance.integers(0, 5000))
        bounds = np.unique(chance.integers(0, max(n, 1), size=int(chance.integers(0, 60))))
        kinds = chance.integers(0, 6, size=len(bounds))
        limit = int(chance.integers(20, 900))
        overlap = int(chance.integers(0, limit // 3))
        got = pieces.plan(n, bounds, kinds, limit, overlap)
        assert (got == []) == (n == 0)
        if got:
            assert got[0][0] == 0 and got[-1][1] == n and all(0 < b - a <= limit for a, b in got)
            assert all(b - overlap == c for (_, b), (c, _) in zip(got, got[1:]))
    with pytest.raises(ValueError):
        pieces.plan(10, np.array([]), np.array([]), 5, 5)


def test_pieces_prefer_the_best_boundary():
    text = "A" * 60 + ". " + "B" * 20 + "\n\n" + "C" * 30 + ". " + "D" * 100
    r = pieces.read_range("", text, "")
    ends = [b for _, b in pieces.plan(len(r["white"]), np.array(r["bounds"]), np.array(r["kinds"]), 120, 10)]
    assert r["white"][: ends[0]].endswith("B\n")


@pytest.mark.parametrize("width", [256, 1 << 16])
def test_split_items_round_trip(spark, width):
    chance = random.Random(width)
    texts = [_text(chance, 150) for _ in range(6)] + ["", " \n ", None, "short", "y" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, text string").withColumn("part", F.lit(9)).withColumn("size", F.lit(9))
    got = pieces.split_items(df, ["k"], F.lit(300), 40, width).toPandas().sort_values(["k", "piece_no"])
    for k, own in got.groupby("k"):
        assert own["piece"].str.len().max() <= 300 and own["piece_no"].tolist() == [*range(1, len(own) + 1)]
        assert own["piece"].iloc[0] + "".join(p[40:] for p in own["piece"].iloc[1:]) == _collapsed(texts[k])
    assert set(got["k"]) == {i for i, t in enumerate(texts) if t and t.strip()}
    lengths = {r["k"]: r["length"] for r in pieces.item_lengths(df, ["k"], width).collect()}
    assert lengths == {i: len(_collapsed(t)) for i, t in enumerate(texts) if t is not None}
    assert pieces.split_items(df.filter("false"), ["k"], F.lit(300)).count() == 0


def test_both_widths_cut_alike(spark):
    text = _text(random.Random(9), 400)
    df = spark.createDataFrame([(1, text)], "k int, text string")
    whole = sorted(map(tuple, pieces.split_items(df, ["k"], F.lit(500), 50, 1 << 20).collect()))
    for w in (512, 700):
        assert sorted(map(tuple, pieces.split_items(df, ["k"], F.lit(500), 50, w).collect())) == whole


def test_rows_with_the_same_keys_are_each_cut_at_any_length(spark):
    chance = random.Random(4)
    texts = [_text(chance, 200), _text(chance, 200), "short", "short"]
    df = spark.createDataFrame([(1, t) for t in [*texts, texts[0]]], "k int, text string")
    for w in (256, 1 << 20):
        got = [r["piece"] for r in pieces.split_items(df, ["k"], F.lit(300), 40, w).collect()]
        one = [p for t in texts for p in [r["piece"] for r in pieces.split_items(df.filter(F.col("text") == t).limit(1), ["k"], F.lit(300), 40, w).collect()]]
        again = [r["piece"] for r in pieces.split_items(df.filter(F.col("text") == texts[0]).limit(1), ["k"], F.lit(300), 40, w).collect()]
        assert sorted(got) == sorted(one + again)
        assert sorted(r["pieces"] for r in pieces.oversized(df, ["k"], F.lit(300), 40, w).collect()) == sorted(2 * [len(again)] + [len(one) - len(again) - 2])


def test_files_are_split_by_byte_ranges(spark, tmp_path):
    chance = random.Random(3)
    text = " ".join(chance.choice(["größe", "中文。", "plain", "word.", "🚀", "\n\n"]) for _ in range(3000))
    p = tmp_path / "big.txt"
    p.write_text(text, encoding="utf-8")
    got = pieces.split_files(spark, [str(p)], 700, 100, width=1024).toPandas().sort_values("piece_no")
    assert got["piece"].str.len().max() <= 700
    assert got["piece"].iloc[0] + "".join(x[100:] for x in got["piece"].iloc[1:]) == _collapsed(text)


# --- encoding

try:
    ENCODER = tokens.encoder()
except FileNotFoundError:
    ENCODER = None
needs_vocabulary = pytest.mark.skipif(ENCODER is None, reason="no public vocabulary here")


@needs_vocabulary
@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=" \n\t'’stdmrevl,.!?aZ09é中　 🚀<|endoftext|>", max_size=60)))
def test_encoding_equals_the_whole_text(text):
    clean = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    assert ENCODER.encode(text) == ENCODER._whole.encode_ordinary(clean)


@needs_vocabulary
def test_no_token_crosses_a_forced_boundary():
    import base64
    from pathlib import Path

    ranks = [base64.b64decode(line.split()[0]) for line in open(Path(tokens.TOKENIZERS) / "byte_bpe_50k.tiktoken", "rb")]
    cut = tokens.forced_boundaries(ranks)
    assert not any(cut[a, b] for t in ranks for a, b in zip(t, t[1:]))
    assert cut[ord("d"), ord(" ")] and not cut[ord(" "), ord("d")]


@needs_vocabulary
def test_encoded_rows(spark):
    data = [(1, "Revenue rose."), (2, ""), (3, None), (3, None), (4, " \n " * 3), (5, "z" * 50_000 + " <|endoftext|>")]
    df = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encoded(df, ["doc_id"], "text")
    rows = {r["doc_id"]: r["ids"] for r in got.collect()}
    assert got.count() == 6 and rows[2] == [] == rows[3] and rows[5] == ENCODER._whole.encode_ordinary(data[5][1])
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.encoded(df, ["doc_id"], "text", lengths=True).collect()}
    assert counts == {k: len(v) for k, v in rows.items()}
    assert [r[0] for r in df.orderBy("doc_id").select(tokens.token_counts(F.col("text"))).limit(2).collect()] == [len(rows[1]), 0]
    assert tokens.encoded(df.filter("false"), ["doc_id"], "text").count() == 0
    assert isinstance(got.toPandas(), pd.DataFrame)
