"""Text that reads the same but is stored with different characters, brought to one form.

Invisible characters go, compatibility widths and kinds of space become the plain ones, and accents are composed. Then each
token's letters are intersected over the scripts they can be spelled in: a token of mixed scripts, or one wholly of
look-alikes of the title's main script, is respelled in the one script that can spell all of it.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.session import cut

# Letters that look like the Latin letter written after them, by script.
_LOOKALIKES = {
    "GREEK": "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX αa γy ιi κk νv οo ρp υu χx ϲc ϳj ϹC ϜF ͿJ",
    "CYRILLIC": "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ԚQ ԜW ѴV ӀI аa еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ѵv үy гr кk",
    "ARMENIAN": "ՕO ՍU ԼL օo սu հh ոn ցg զq յj",
    "CHEROKEE": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ",
}
# Letters of the Latin script itself that look like a basic one.
_WITHIN = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ⅼ": "l", "ꞵ": "b"}
TO_LATIN = {pair[0]: pair[1] for pairs in _LOOKALIKES.values() for pair in pairs.split()}
_FROM_LATIN = {script: {p[1]: p[0] for p in reversed(pairs.split())} for script, pairs in _LOOKALIKES.items()}
_SCRIPTS = ("LATIN", *_LOOKALIKES)
_WIDTH_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<font>", "<small>", "<vertical>")
_INVISIBLE = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
# The blocks of the scripts that have look-alikes of Latin letters.
_ALIKE = re.compile(r"[\u0370-\u03ff\u1f00-\u1fff\u0400-\u052f\u1c80-\u1c8f\ua640-\ua69f\u0530-\u058f\u13a0-\u13ff]")
_PLAIN = re.compile(r"[ -~]*")


@lru_cache(65_536)
def _plain(ch: str) -> str:
    """One character without its width; nothing for an invisible one."""
    category = unicodedata.category(ch)
    if category == "Cf" or ord(ch) in _INVISIBLE:
        return ""
    if category == "Zs" or ch in "\t\n\r\x0b\x0c\x85\u2028\u2029":
        return " "
    tag = unicodedata.decomposition(ch).split(" ")[0]
    if tag in _WIDTH_TAGS or tag == "<compat>" and (0x2E80 <= ord(ch) < 0x2FE0 or 0xFB00 <= ord(ch) < 0xFB07):
        return unicodedata.normalize("NFKC", ch)
    return _WITHIN.get(ch, ch)


@lru_cache(65_536)
def _script(ch: str) -> str:
    if ch.isascii():
        return "LATIN"
    name = unicodedata.name(ch, "").split(" ")[0]
    return name if name else "OTHER"


def _spellings(token: str) -> set[str]:
    """The scripts that can spell every letter of a token, its own or by look-alikes; marks go with any."""
    left = set(_SCRIPTS)
    for ch in token:
        if unicodedata.combining(ch):
            continue
        own = _script(ch)
        can = {own}
        latin = TO_LATIN.get(ch) if own in _LOOKALIKES else ch if own == "LATIN" else None
        if latin:
            can |= {"LATIN"} | {s for s, back in _FROM_LATIN.items() if latin in back}
        left &= can
        if not left:
            break
    return left


def _respell(token: str, script: str) -> str:
    if script == "LATIN":
        return "".join(TO_LATIN.get(c, c) for c in token)
    back = _FROM_LATIN[script]
    return "".join(c if _script(c) == script else back.get(TO_LATIN.get(c, c), c) for c in token)


def consistent(text: str | None, rounds: int = 4) -> str | None:
    """The one form of a text, which is its own form; null stays null. Runs of spaces are one space, outer ones none; letter case is kept."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return text if "  " not in text and text[:1] != " " != text[-1:] else " ".join(text.split())
    text = unicodedata.normalize("NFC", "".join(map(_plain, unicodedata.normalize("NFC", text))))
    text = " ".join(text.split(" ")) if "  " not in text else re.sub(" +", " ", text)
    text = text.strip(" ")
    if text.isascii() or not _ALIKE.search(text):
        return text
    apart = unicodedata.normalize("NFD", text)
    tokens = _TOKEN.findall(apart)
    own = [{_script(c) for c in t if not unicodedata.combining(c)} for t in tokens]
    if not any(s - {"LATIN"} and s & {*_LOOKALIKES} for s in own):
        return text
    # The main script: that of letters which no other script can spell, else of all.
    votes = Counter(_script(c) for t in tokens for c in t if not unicodedata.combining(c) and (len(_spellings(c)) == 1 or _script(c) not in _SCRIPTS))
    votes = votes or Counter(_script(c) for t in tokens for c in t if not unicodedata.combining(c))
    main = max(_SCRIPTS, key=lambda s: (votes.get(s, 0), s == "LATIN"))

    def settle(m: re.Match) -> str:
        token = m[0]
        scripts = {_script(c) for c in token if not unicodedata.combining(c)}
        can = _spellings(token)
        if scripts == {main} or not can:
            return token
        if main in can:
            return _respell(token, main)
        if len(scripts) == 1:
            return token
        counts = Counter(_script(c) for c in token if not unicodedata.combining(c))
        return _respell(token, max(sorted(can), key=lambda s: (counts.get(s, 0), s == "LATIN")))

    out = unicodedata.normalize("NFC", _TOKEN.sub(settle, apart))
    return out if out == text or rounds <= 1 else consistent(out, rounds - 1)  # respelled words can change the main script


def with_forms(df: DataFrame, columns: dict[str, str], keep: list[str]) -> DataFrame:
    """`keep` columns and, for each `columns` entry {text column: new name}, its consistent form.

    Null text gives null, empty text empty. Rows are kept one for one; other columns are dropped, so names can't clash.
    """
    kept = df.select(*keep, *dict.fromkeys(c for c in columns if c not in keep))
    types = dict(kept.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{n}` string" for n in columns.values()])

    def forms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = {n: [consistent(x) if isinstance(x, str) else None for x in frame[c]] for c, n in columns.items()}
            out = frame[keep].copy()
            for n, values in made.items():
                out[n] = pd.Series(values, index=out.index, dtype=object)
            yield out

    return kept.mapInPandas(forms, schema)


def same_reading_pairs(df: DataFrame, row: str = "row_ix", text: str = "title", salts: int = 8) -> DataFrame:
    """Pairs row_a < row_b whose texts differ as strings but have one consistent form.

    Equal strings are no pair, nulls are in none. Only forms stored in more than one spelling are joined, and both their
    sides are spread over `salts` tasks.
    """
    # Forms are made once, and named by a digest of theirs.
    made = with_forms(df.filter(F.col(row).isNotNull() & F.col(text).isNotNull()), {text: "_form"}, [row, text])
    rows = cut(made.select(F.col(row).alias("row"), F.col(text).alias("text"), F.md5("_form").alias("form")))
    several = rows.groupBy("form").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).filter("lo <> hi").select("form")
    held = rows.join(several.hint("merge"), "form", "left_semi")
    a = held.select("form", F.col("row").alias("row_a"), F.col("text").alias("text_a"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    b = held.select("form", F.col("row").alias("row_b"), F.col("text").alias("text_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return a.join(b.hint("merge"), ["form", "salt"]).filter("row_a < row_b AND text_a <> text_b").select("row_a", "row_b")
