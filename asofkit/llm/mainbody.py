"""The main body of fetched pages, by consensus host paths.

The pages arrive as lines, without tags, so the tree is read off the lines: a line's class is its shape (running text, a turn
of a talk, a table row, a menu, a short or a longer fragment), runs of lines of a kind are the containers, and a line's path
is its page's language, its class and its generalised wording (numbers, names and the outlet's own name replaced). No
wording is known beforehand. Each page scores its containers by position and by the running text around them; Spark votes
on every path over all different pages: by its mean score, and by whether it is bound to hosts. What a site puts around its
articles recurs on that site and not on others, whereas the turns of phrase of reports are found everywhere in proportion, so
a path whose share differs between hosts far more than chance allows is the site's own. The pages are read again with the
winning paths.

The spread of a path over hosts is measured as in a chi-squared test: with n pages, of which the hosts' shares of the
language's pages would let expect e_h each, D = sum (n_h - e_h)^2 / e_h exceeds its degrees of freedom by `bound` n, the
squared relative deviation of the hosts' rates, known to within sd(D) / n.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.operators.joins import lookup
from asofkit.operators.timestamps import host_of
from asofkit.session import cut

_TICKER = re.compile(r"^[A-Z][A-Z0-9.\-]{0,6}\s+[$€£¥]?[\d.,]+\s+[+\-−▲▼]?\s?[\d.,]+\s?%?\)?$")
_BREAK = re.compile(r"\s*[|·•›»]\s*|\s+[>/]\s+|\s{2,}|\t")
_PARTED = ("|", "·", "•", "›", "»", "\t", "  ", " > ", " / ")
_MARK = re.compile(r"^(?:(?P<dot>[•*▪‣·])|(?P<dash>[-–—])|(?P<num>\d{1,3}[.)]))\s+")
_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_STOP_INSIDE = re.compile(r"[.!?][\"'”’)]*\s+[\"“‘(]?[^\W\d_a-zß-öø-ÿ]|[.!?][\"'”’)]*\s+\d|。")
_SPEAKER = re.compile(r"^[^\W\d_a-z][\w'’.\-]*(?: [^\W\d_a-z][\w'’.\-]+){0,3}(?:\s+[-–—]\s+[^:]{1,60})?\s*:\s+\S")
_AMOUNT = re.compile(r"[$€£¥]\s?\d|\d[\d.,]*\s?(?:%|million|billion|bn|m\b)|^\(?-?[\d.,]+\)?$")
_DIGITS = re.compile(r"\d+(?:[.,:]\d+)*")
_NAME = re.compile(r"(?:[A-ZÄÖÜ][\wäöüßé'’\-]*)(?:\s+[A-ZÄÖÜ][\wäöüßé'’\-]*)*")
# Small words by which a page's language is told.
_SMALL_WORDS = {
    "en": frozenset("the of and to in for with by on that from".split()),
    "de": frozenset("der die das und im auf um mit bis ein von den".split()),
    "es": frozenset("el la de los en que con por del las".split()),
    "fr": frozenset("le la les des et en du une est pour dans".split()),
}

MENU, TICKER, PROSE, TURN, TABLE, LINK, SHORT, TITLE, ASK = range(9)
CLASSES = ("menu", "ticker", "prose", "turn", "table", "link", "short", "title", "question")
_TEXT = frozenset((PROSE, TURN, TABLE, ASK))
#: A path of so many different pages, whose spread over hosts exceeds chance by so many deviations, and by this share, is bound to its hosts.
LEAST_PAGES, LEAST_DEVIATIONS, LEAST_BOUND = 20, 6.0, 0.4
#: Fragments with a path of so many pages and so good a score need no text after them.
KNOWN_PAGES, KNOWN_SCORE = 10, 0.15


def _class(text: str, title: str) -> tuple[int, str]:
    """The class of a line that isn't blank, by its shape, and its text without list marks."""
    m = _MARK.match(text)
    bare = text[m.end() :] if m else text
    if title and (text == title or bare == title):
        return (TITLE if not m else LINK), bare
    if _TICKER.match(bare):
        return TICKER, bare
    ended, words = bool(_SENTENCE_END.search(bare[-8:])), bare.count(" ") + 1
    inside = bool(_STOP_INSIDE.search(bare))
    if (ended or inside) and _SPEAKER.match(bare):
        return (ASK if bare.endswith("?") and not inside else TURN), bare
    if not ended and any(x in bare for x in _PARTED):
        parts = [p for p in _BREAK.split(bare) if p]
        if len(parts) > 1:
            amounts = sum(1 for p in parts if _AMOUNT.search(p))
            if amounts and amounts >= len(parts) - 1 - (len(parts) > 3):
                return TABLE, bare
            if title and any(len(p) > 12 and title.startswith(p) for p in parts) or all(len(p.split()) <= 4 for p in parts):
                return MENU, bare
    if m and m["dot"] and words <= 4 and not ended:
        return MENU, bare
    question = bare.endswith("?") and not inside
    if ended and not question and words >= 4 or inside and words >= 8 or not bare.isascii() and "。" in bare or m and m["dash"] and words >= 5:
        return PROSE, bare
    return (SHORT if words <= 4 and not question else LINK), bare


def _wording(bare: str, kind: int, outlet: str) -> str:
    """The generalised wording of a line: numbers, names and the outlet's name replaced. Short lines keep their words, fragments that lead in with a colon only what stands before it."""
    text = _DIGITS.sub("9", bare.replace(outlet, "@") if len(outlet) > 3 else bare)
    if kind in (SHORT, MENU):
        return text.lower()
    if kind in (LINK, ASK) and 0 <= (at := text.find(": ")) < 40:
        return text[: at + 1].lower() + "*"
    first, _, rest = text.partition(" ")  # the first word has a capital anyway
    return first.lower() + " " + _NAME.sub("N", rest)


def _language(lines: list[str]) -> str:
    words = " ".join(lines).lower().split()
    counts = {k: sum(map(v.__contains__, words)) for k, v in _SMALL_WORDS.items()}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else ""


def read_page(text: str, title: str | None, outlet: str = "") -> tuple[str, int, list[tuple[int, int, float, str]]]:
    """The page's language, the place of its headline among the lines (-1 without), and (line_no, class, score, wording) of each line that isn't blank.

    A line is scored by its container: before the headline, in menus and lists -1, running text near other running text 1,
    alone -0.5, a single fragment before text up to 0.5. Text that names the outlet speaks for the site. Positive says main body.
    """
    title, outlet = (title or "").strip(), outlet if len(outlet) > 3 else ""
    lines = [(n, x) for n, x in enumerate((s.strip() for s in text.split("\n")), 1) if x]
    seen = [_class(x, title) for _, x in lines]
    kinds = [k for k, _ in seen]
    size = len(kinds)
    for i, k in enumerate(kinds):
        if k == ASK and TURN not in kinds[max(0, i - 1) : i + 2]:
            kinds[i] = LINK
    start = kinds.index(TITLE) if TITLE in kinds else -1
    out = []
    for i, ((n, _), (_, bare), k) in enumerate(zip(lines, seen, kinds)):
        if i < start or k in (MENU, TICKER):
            score = -1.0
        elif k == TITLE:
            score = 1.0
        elif k in _TEXT:
            score = 1.0 if any(kinds[j] in _TEXT for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < size) else -0.5
        else:
            before, after = kinds[i - 1] if i else None, kinds[i + 1] if i + 1 < size else None
            if after == TURN and k == SHORT:
                score = 0.4
            elif after in _TEXT and (before in _TEXT or before == TITLE):
                score = 0.5
            else:
                score = 0.0 if after in _TEXT or before == TITLE else -1.0
        if outlet and k in (PROSE, LINK, SHORT) and outlet in bare:
            score = -1.0
        out.append((n, k, score, _wording(bare, k, outlet)))
    return _language([b for (_, b), k in zip(seen, kinds) if k in (PROSE, TURN)]), start, out


def judge_page(kinds: list[int], scores: list[float], known: list[bool], start: int) -> list[bool]:
    """Which lines are main body, by the scores of their paths; `known` marks paths that are well known to be.

    The body starts at the headline, else at the first text whose path isn't furniture and the known fragments right before
    it. A fragment is of the body if its path isn't furniture and text of the body follows, furniture aside, or the
    headline stands before it.
    """
    size = len(kinds)
    text = [k in _TEXT and s > 0 for k, s in zip(kinds, scores)]
    if start < 0:
        start = text.index(True) if True in text else size
        while 0 < start < size and kinds[start - 1] in (SHORT, LINK) and known[start - 1]:
            start -= 1
    out, titled, follows = [False] * size, False, False
    for i in range(size - 1, start - 1, -1):  # whether text follows, furniture aside
        k, s = kinds[i], scores[i]
        if k in (SHORT, LINK) and s > 0:
            out[i] = known[i] or follows
        if s > 0:
            follows = text[i]
    for i in range(start, size):
        k = kinds[i]
        if k == TITLE:
            out[i], titled = not titled, True
        elif k in _TEXT:
            out[i] = text[i]
        elif k in (SHORT, LINK) and i and scores[i] > 0 and kinds[i - 1] == TITLE and out[i - 1]:
            out[i] = True
    return out


def read_pages(pages: DataFrame, outlets: DataFrame | None = None, wordings: bool = False) -> DataFrame:
    """(row_ix, page, site, lang, line_no, kind, start, score, path) and, with `wordings`, host and wording, of each line that isn't blank; null texts have none.

    `pages` has row_ix, url, title and text; `outlets` the outlet_name of each domain. `page` is the same for copies of a
    page, `site` for the pages of a host in one language.
    """
    named = pages.filter("text IS NOT NULL").select("row_ix", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "title", "text")
    if outlets is None:
        named = named.withColumn("outlet", F.lit(""))
    else:
        names = outlets.groupBy(F.lower(F.trim("domain")).alias("host")).agg(F.min("outlet_name").alias("outlet"))
        named = named.join(names, "host", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = lambda x: xxhash.xxh3_64_intdigest(x) - (1 << 63)
        for frame in frames:
            sizes, of_page, lines = [], [], []
            for host, title, text, outlet in zip(frame["host"], frame["title"], frame["text"], frame["outlet"]):
                lang, start, found = read_page(text, title if isinstance(title, str) else "", outlet if isinstance(outlet, str) else "")
                sizes.append(len(found))
                of_page.append((digest(f"{host}\n{text}"), digest(f"{lang}|{host}"), lang, start))
                lines += [(n, k, s, digest(f"{lang}|{k}|{w}"), w) for n, k, s, w in found]
            repeat = lambda values, kind: np.repeat(np.array(values, dtype=kind), sizes)
            out = {
                "row_ix": np.repeat(frame["row_ix"].to_numpy(), sizes), "page": repeat([p for p, *_ in of_page], np.int64), "site": repeat([s for _, s, *_ in of_page], np.int64), "lang": repeat([x for _, _, x, _ in of_page], object),
                "line_no": np.array([x[0] for x in lines], dtype=np.int32), "kind": np.array([x[1] for x in lines], dtype=np.int8), "start": repeat([x for *_, x in of_page], np.int32),
                "score": np.array([x[2] for x in lines], dtype=np.float32), "path": np.array([x[3] for x in lines], dtype=np.int64),
            }
            if wordings:
                out |= {"host": np.repeat(frame["host"].to_numpy(), sizes), "wording": pd.Series([x[4] for x in lines], dtype=object)}
            yield pd.DataFrame(out)

    schema = "row_ix long, page long, site long, lang string, line_no int, kind byte, start int, score float, path long" + ", host string, wording string" * wordings
    return named.select("row_ix", "host", "title", "text", "outlet").mapInPandas(run, schema)


def winning_paths(lines: DataFrame) -> DataFrame:
    """The vote on each path: path, kind, pages, mean_score, deviations, bound, wins, lines.

    Different pages vote once each. `wins` is what the vote adds: the mean score, less 2 where the path is bound to its
    hosts (never for turns, whose hosts are those with talks). Votes are combined before each shuffle, first by site and
    path, then by path; no task gathers the lines of a path.
    """
    once = lines.groupBy("lang", "site", "path", "kind", "page").agg(F.avg("score").alias("score"), F.count("*").alias("lines"))
    local = once.groupBy("lang", "site", "path", "kind").agg(F.count("*").alias("n"), F.sum("score").alias("sum"), F.sum("lines").alias("lines"))
    sizes = cut(lines.select("lang", "site", "page").distinct().groupBy("lang", "site").agg(F.count("*").alias("site_pages")))
    # One row per language.
    langs = sizes.groupBy("lang").agg(F.sum("site_pages").alias("T"), F.count("*").alias("K"), F.sum(1 / F.col("site_pages")).alias("I"))
    sized = lookup(local, sizes.select("site", "site_pages"), "site")
    every = sized.groupBy("lang", "path", "kind").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("lines").alias("lines"), F.sum(F.col("n") * F.col("n") / F.col("site_pages")).alias("S"))
    held = every.join(F.broadcast(langs), "lang")
    n, k, t = F.col("n"), F.col("K"), F.col("T")
    over = t / n * F.col("S") - n - (k - 1)
    variance = F.greatest(2 * (k - 1) + (t * F.col("I") - k * k - 2 * k + 2) / n, F.lit(1.0))
    mean, deviations, bound = F.col("sum") / n, over / F.sqrt(variance), over / n
    own = (n >= F.when(F.col("kind") == ASK, 50).otherwise(LEAST_PAGES)) & (deviations > LEAST_DEVIATIONS) & (bound > LEAST_BOUND) & (F.col("kind") != TURN)
    return held.select("path", "kind", n.alias("pages"), mean.alias("mean_score"), deviations.alias("deviations"), bound.alias("bound"), (mean - F.when(own, 2.0).otherwise(0.0)).alias("wins"), "lines")


def _own(kind: Column, score: Column) -> Column:
    """A line's own score where no vote tells: lone text is rather kept."""
    return F.when(kind.isin(*_TEXT) & (score == -0.5), 0.2).otherwise(score.cast("double"))


def judged(pages: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """(row_ix, line_no, kind, main, voted) of each line that isn't blank; `voted` says that the vote on its path turned its own container's score.

    Of repeated rows one counts. The own score and the vote are blended by the number of pages that voted, (n - 1) / (n + 4).
    """
    lines = cut(read_pages(pages, outlets))
    votes = cut(winning_paths(lines))
    found = lookup(lines.select("row_ix", "page", "line_no", "kind", "start", "score", "path"), votes.select("path", "pages", "mean_score", "wins", "lines"), "path", weight="lines")
    trust = (F.col("pages") - 1) / (F.col("pages") + 4)
    own = _own(F.col("kind"), F.col("score"))
    blended = own * (1 - trust) + F.col("mean_score") * trust + (F.col("wins") - F.col("mean_score"))
    sent = found.select("row_ix", "page", "line_no", "kind", "start", blended.alias("score"), ((blended > KNOWN_SCORE) & (F.col("pages") >= KNOWN_PAGES)).alias("known"), ((own > 0) != (blended > 0)).alias("voted"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []

        def settle():
            lines = [x for i, x in enumerate(held) if not i or x[2] != held[i - 1][2]]
            main = judge_page([x[3] for x in lines], [x[5] for x in lines], [x[6] for x in lines], lines[0][4])
            return [(x[0], x[2], x[3], m, x[7]) for x, m in zip(lines, main)]

        columns = ["row_ix", "line_no", "kind", "main", "voted"]
        for frame in frames:
            out = []
            for x in zip(*(frame[c].tolist() for c in ("row_ix", "page", "line_no", "kind", "start", "score", "known", "voted"))):
                if held and x[:2] != held[0][:2]:
                    out += settle()
                    held.clear()
                held.append(x)
            yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame(settle(), columns=columns)

    ordered = sent.repartition("row_ix").sortWithinPartitions("row_ix", "page", "line_no")
    return ordered.mapInPandas(run, "row_ix long, line_no int, kind byte, main boolean, voted boolean")


def host_paths(lines: DataFrame) -> DataFrame:
    """The vote on each path by host, from lines with wordings: host, lang, class, wording, host_pages, pages, mean_score, deviations, bound, wins."""
    lines = cut(lines)
    votes = winning_paths(lines).drop("kind")
    local = lines.groupBy("host", "lang", "path", "kind").agg(F.min("wording").alias("wording"), F.count_distinct("page").alias("host_pages"))
    told = lookup(local, votes, "path", weight="lines")
    kinds = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("kind") + 1)
    return told.select("host", "lang", kinds.alias("class"), "wording", "host_pages", "pages", "mean_score", "deviations", "bound", "wins")


def vote_counts(pages: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """By class of line: lines, those of the main body, and those whose own score the vote turned."""
    kinds = F.element_at(F.array(*map(F.lit, CLASSES)), F.col("kind") + 1)
    return judged(pages, outlets).groupBy(kinds.alias("class")).agg(F.count("*").alias("lines"), F.count_if("main").alias("main_lines"), F.count_if("voted").alias("voted_lines"))


def main_text(pages: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """row_ix, main_text, lines, kept: the main body's lines in order, joined by line ends; null for null text, empty where there is no body."""
    kept = judged(pages, outlets).groupBy("row_ix").agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.when(F.col("main"), F.col("line_no")))).alias("numbers"))
    all_lines = F.split("text", "\n")
    out = pages.select("row_ix", "text").join(kept.hint("merge"), "row_ix", "left")
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    text = F.when(F.col("text").isNotNull(), F.array_join(F.transform(numbers, lambda i: F.element_at(all_lines, i)), "\n"))
    return out.select("row_ix", text.alias("main_text"), F.coalesce("lines", F.lit(0)).alias("lines"), F.size(numbers).alias("kept"))
