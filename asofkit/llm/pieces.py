"""Oversized items cut into pieces under a limit, at natural boundaries, with an overlap.

An item is processed in ranges of `RANGE` characters (or bytes, for files), each read with a halo on both sides. A worker
finds the boundaries of its range and writes the range with each run of white space as one character. The boundary tables of
an item are stitched by the prefix sums of those lengths, pieces are planned on the table alone, and each piece is emitted by
its offsets from the ranges it touches. No step needs a whole item: planning goes through an item's ranges in order and
holds what a piece may reach. The result doesn't depend on the size of the ranges.

A run of spaces, tabs and line ends is one character: a line end if the run has one, else a space; outer runs are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofkit.session import cut

RANGE, HALO, SEEN, GRID = 65_536, 256, 128, 128
WORD, SENTENCE, LINE, PARAGRAPH, SPEAKER, SECTION = range(6)

_WHITE = " \t\r\n"
_CONTENT = re.compile(r"[^ \t\r\n]")
_RUN = re.compile(r"[ \t\r\n]+")
_WORD_START = re.compile(r"(?<=[ \t\r\n])(?=[^ \t\r\n])")
# Where a piece may well start: after a run that ends a sentence or a line, and after a full stop that needs no space.
_STRONG = re.compile(r"(?:[.!?…][\"'”’)\]]*[ \t]+|[ \t]*[\r\n][ \t\r\n]*)(?=[^ \t\r\n])|(?<=[。！？])(?=[^ \t\r\n。！？」』”])")
_SECTION_LINE = re.compile(
    r"(?:(?i:part\s+[ivx]+\b|item\s*\d+[a-c]?\b|section\s+\d+|chapter\s+\d+|prepared remarks|questions? and answers?|q\s*&\s*a\b|question-and-answer)|\d+[A-C]?\.?\s+[A-Z]{2}|#{1,6} |[A-Z][A-Z0-9 ,&'’\-]{5,80}(?:\n|\r|$))"
)
_SPEAKER_LINE = re.compile(r"(?:Operator|Analyst|Moderator|[A-Z][\w.'’\-]*(?: [A-Z][\w.'’\-]*){1,4})(?:\s+[-–—]+\s+[^:\n]{1,60})?\s*(?::\s|\n)")


def _kind(before: str, after: str) -> int:
    """The kind of boundary between a white run and the text after it; of a long run only the last `SEEN` characters count."""
    text = before.rstrip(_WHITE)
    run = before[len(text) :]
    lines = run.count("\n") + (run.count("\r") if "\n" not in run else 0)
    if not lines:
        return SENTENCE if text and (not run or len(run) < SEEN) else WORD
    if _SECTION_LINE.match(after):
        return SECTION
    if _SPEAKER_LINE.match(after):
        return SPEAKER
    return PARAGRAPH if lines > 1 else LINE


def read_range(before: str, text: str, after: str, at: int = 0) -> dict:
    """One range of an item with its halos, which starts at character `at` of it.

    white: the text with each run as one character, without a run that began before the range; `starts` whether it began
    in one; bounds and kinds: places in `white` where a piece may start.
    """
    before, after = before[-HALO:], after[:HALO]
    skip = 0
    if (not before and at == 0) or (before and before[-1] in _WHITE):
        m = _CONTENT.search(text)
        skip = m.start() if m else len(text)
    white, lengths = [], []
    whole = before + text + after
    base = len(before)
    end = base + len(text)
    found: dict[int, int] = {}
    for m in _STRONG.finditer(whole, max(0, base - HALO)):
        p = m.end()
        if p < base or p == 0:
            continue
        if p >= end:
            break
        if kind := _kind(whole[max(0, p - SEEN) : p], whole[p : p + 200]):
            found[p] = kind
    # The first word that starts in each cell of a grid over the item, for where there is nothing better; the cell may begin before the range.
    for g in range(base - at % GRID, end, GRID):
        m = _WORD_START.search(whole, max(0, g), min(len(whole), g + GRID))
        if m and base <= m.end() < end and m.end() < g + GRID:
            found.setdefault(m.end(), WORD)
    # White runs that start here, as one character each, and the places of the boundaries in what is left.
    out, cursor, size, places = [], skip, 0, {}
    marks = sorted(found)
    k = 0
    for m in _RUN.finditer(text, skip):
        part = text[cursor : m.start()]
        while k < len(marks) and marks[k] - base <= m.start():
            p = marks[k] - base
            if p >= cursor:
                places[marks[k]] = size + p - cursor
            k += 1
        out.append(part)
        run = whole[base + m.start() : base + m.start() + HALO]
        out.append("\n" if "\n" in (lead := run[: len(run) - len(run.lstrip(_WHITE))]) or "\r" in lead else " ")
        size += len(part) + 1
        cursor = m.end()
    out.append(text[cursor:])
    for p in marks[k:]:
        if p - base >= cursor:
            places[p] = size + p - base - cursor
    joined = "".join(out)
    bounds = sorted(places)
    return {"white": joined, "bounds": [places[p] for p in bounds], "kinds": [found[p] for p in bounds]}


def plan(length: int, bounds: np.ndarray, kinds: np.ndarray, limit: int, overlap: int, start: int = 0) -> list[tuple[int, int]]:
    """(start, end) of the pieces of an item of a length, from `start` on, by its boundary table.

    A piece ends at the best kind of boundary in the second half of what the limit allows, at the last of that kind; else
    at the best in the first half, past the overlap; else at the limit. The next starts `overlap` before that end.
    """
    if length <= 0:
        return []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    out = []
    while start + limit < length:
        end = 0
        for low, high in ((start + max(limit // 2, overlap), start + limit), (start + overlap, start + max(limit // 2, overlap))):
            i, j = np.searchsorted(bounds, (low, high), side="right")
            if i < j:
                part = kinds[i:j]
                end = int(bounds[i + len(part) - 1 - int(part[::-1].argmax())])
                break
        end = end or start + limit
        out.append((start, end))
        start = end - overlap
    out.append((start, length))
    return out


def _ranges(items: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The ranges of each non-null text with their halos."""
    count = F.greatest(F.ceil(F.length("text") / width), F.lit(1)).cast("int")
    at = F.col("part") * width
    parts = items.select(*keys, "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("part"))
    halo = lambda start, size: F.col("text").substr(start + 1, size)
    return parts.select(
        *keys, "part", halo(F.greatest(at - HALO, F.lit(0)), F.least(at, F.lit(HALO))).alias("before"), halo(at, F.lit(width)).alias("range"), halo(at + width, F.lit(HALO)).alias("after")
    )


def _tables(ranges: DataFrame, keys: list[str], width: int, texts: bool) -> DataFrame:
    """Each range's collapsed length, whether it ends in white, its boundary table and, with `texts`, its collapsed text."""
    kept = ", ".join(f"`{c}` {t}" for c, t in ranges.dtypes if c in keys)
    schema = f"{kept}, part int, size long, ends_white boolean" + (", bounds array<long>, kinds array<int>, white string" if texts else "")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[[*keys, "part"]].copy()
            if texts:
                read = [read_range(b, t, a, p * width) for b, t, a, p in zip(frame["before"], frame["range"], frame["after"], frame["part"])]
                white = [x["white"] for x in read]
            else:
                white = [_RUN.sub(" ", t.lstrip(_WHITE) if p == 0 or b[-1:] in (*_WHITE,) else t) for b, t, p in zip(frame["before"], frame["range"], frame["part"])]
            out["size"] = pd.Series([*map(len, white)], index=out.index, dtype="int64")
            out["ends_white"] = pd.Series([w[-1:] in (" ", "\n") and w != "" for w in white], index=out.index, dtype=bool)
            if texts:
                for c in ("bounds", "kinds"):
                    out[c] = pd.Series([x[c] for x in read], index=out.index, dtype=object)
                out["white"] = pd.Series(white, index=out.index, dtype=object)
            yield out

    return ranges.mapInPandas(run, schema)


def _apart(items: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, DataFrame]:
    """The rows of one range, and the different longer ones with the number of their `_copies` and a digest of the text, by which rows with the same keys are told apart."""
    held = items.filter("text IS NOT NULL").select(*keys, "text")
    long = held.filter(F.length("text") > width).groupBy(*keys, F.md5("text").alias("_item")).agg(F.first("text").alias("text"), F.count("*").alias("_copies"))
    return held.filter(F.length("text") <= width), long


def _each_copy(df: DataFrame) -> DataFrame:
    return df.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).drop("_item", "_copies")


def item_lengths(items: DataFrame, keys: list[str], width: int = RANGE) -> DataFrame:
    """keys and `length` of each row with its white runs as one character and outer ones as none; null texts have no row."""
    short, long = _apart(items, keys, width)
    named = [*keys, "_item", "_copies"]
    one = _tables(_ranges(short, keys, width), keys, width, texts=False).select(*keys, (F.col("size") - F.col("ends_white").cast("int")).alias("length"))
    tables = _tables(_ranges(long, named, width), named, width, texts=False)
    last = F.max_by("ends_white", F.when(F.col("size") > 0, F.col("part")))
    return one.unionByName(_each_copy(tables.groupBy(*named).agg((F.sum("size") - F.coalesce(last.cast("int"), F.lit(0))).alias("length"))))


def split_items(items: DataFrame, keys: list[str], limit: Column, overlap: int = 200, width: int = RANGE) -> DataFrame:
    """The pieces of each row: keys, piece_no from 1, start, end (in the collapsed text), piece.

    `limit` may depend on the keys, which should name an item; repeated rows are each cut, of any length. Items within the
    limit are one piece; null, empty and blank ones none. Each piece but an item's last is as `plan` cuts it, consecutive
    ones share exactly `overlap` characters, and all but the overlaps make the collapsed text again. Other columns of items
    but `text` don't matter.
    """
    short, long = _limited(items, keys, limit, width)
    out = _pieces_of_one(_ranges(short, [*keys, "_limit"], width), keys, overlap, True)
    many = _pieces_of_many(_ranges(long, [*keys, "_item", "_copies", "_limit"], width), [*keys, "_item", "_copies"], overlap, width)
    return out.unionByName(_each_copy(many))


def oversized(items: DataFrame, keys: list[str], limit: Column, overlap: int = 200, width: int = RANGE) -> DataFrame:
    """keys and `pieces` of each row whose plan has more than one piece, by boundary tables without emitting any text.

    Texts whose characters, white runs and all, are within the limit need no plan.
    """
    short, long = _limited(items.filter(F.length("text") > limit), keys, limit, width)
    named = [*keys, "_item", "_copies"]
    one = _pieces_of_one(_ranges(short, [*keys, "_limit"], width), keys, overlap, False)
    many = _each_copy(_plans(_laid(_ranges(long, [*named, "_limit"], width), named, width, False), named, overlap).groupBy(*named).agg(F.count("*").cast("int").alias("pieces")))
    return one.unionByName(many).filter("pieces > 1")


def _limited(items: DataFrame, keys: list[str], limit: Column, width: int) -> tuple[DataFrame, DataFrame]:
    return _apart(items.select(*keys, limit.cast("int").alias("_limit"), "text"), [*keys, "_limit"], width)


def _shape(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{c}` {types[c]}" for c in keys) + ", piece_no int, start long, end long"


def _pieces_of_one(ranges: DataFrame, keys: list[str], overlap: int, emit: bool) -> DataFrame:
    """Items of one range need no stitching: they are planned, and with `emit` cut, where they are read; else only the number of pieces is told."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            where, number, spans, pieces = [], [], [], []
            for i, (text, most) in enumerate(zip(frame["range"], frame["_limit"])):
                read = read_range("", text, "")
                white = read["white"].rstrip(_WHITE)
                cuts = plan(len(white), np.asarray(read["bounds"], dtype=np.int64), np.asarray(read["kinds"], dtype=np.int64), int(most), overlap)
                if not emit:
                    number.append(len(cuts))
                    continue
                for k, (a, b) in enumerate(cuts, 1):
                    where.append(i), number.append(k), spans.append((a, b)), pieces.append(white[a:b])
            if not emit:
                yield frame[keys].assign(pieces=np.array(number, dtype=np.int32))
                continue
            out = frame[keys].iloc[where].reset_index(drop=True)
            out["piece_no"] = np.array(number, dtype=np.int32)
            out["start"], out["end"] = np.array([a for a, _ in spans], dtype=np.int64), np.array([b for _, b in spans], dtype=np.int64)
            out["piece"] = pd.Series(pieces, dtype=object)
            yield out

    types = dict(ranges.dtypes)
    counted = ", ".join(f"`{c}` {types[c]}" for c in keys) + ", pieces int"
    return ranges.select(*keys, "_limit", "range").mapInPandas(run, f"{_shape(ranges, keys)}, piece string" if emit else counted)


def _laid(ranges: DataFrame, keys: list[str], width: int, texts: bool = True) -> DataFrame:
    """The ranges' tables stitched: each with its `_base`, the prefix sum of the collapsed lengths before it, and without the item's last white."""
    tables = _tables(ranges, [*keys, "_limit"], width, texts=True)
    if not texts:
        tables = tables.drop("white")
    of_item = Window.partitionBy(*keys)
    last = (F.col("part") == F.max(F.when(F.col("size") > 0, F.col("part"))).over(of_item)) & F.col("ends_white")
    sized = tables.withColumn("_last", F.coalesce(last, F.lit(False))).withColumn("size", F.col("size") - F.col("_last").cast("int"))
    before = F.sum("size").over(of_item.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return cut(sized.withColumn("_base", F.coalesce(before, F.lit(0))).filter("size > 0").drop("_last"))


def _plans(laid: DataFrame, keys: list[str], overlap: int) -> DataFrame:
    """(start, end) of the pieces of each item: its ranges are gone through in order, and a piece is cut as soon as all boundaries it may end at are known."""
    types = dict(laid.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        item, limit, start, known, number = None, 0, 0, 0, 0
        bounds, kinds = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        out: list[tuple] = []

        def advance(length):
            """Cuts what ends before `length`; all boundaries below are known."""
            nonlocal start, number, bounds, kinds
            if start + limit < length:
                cuts = plan(length, bounds, kinds, limit, overlap, start)[:-1]
                out.extend((*item, number + k, a, b) for k, (a, b) in enumerate(cuts, 1))
                number, start = number + len(cuts), cuts[-1][1] - overlap
                bounds, kinds = bounds[bounds >= start], kinds[bounds >= start]

        def close():
            if item is not None and known > start:
                advance(known)
                out.append((*item, number + 1, start, known))

        for frame in frames:
            for *key, part, base, size, own, kind, most in frame[[*keys, "part", "_base", "size", "bounds", "kinds", "_limit"]].itertuples(index=False):
                if (key := tuple(key)) != item:
                    close()
                    item, limit, start, known, number = key, int(most), 0, 0, 0
                    bounds = kinds = np.zeros(0, dtype=np.int64)
                bounds = np.concatenate((bounds, np.asarray(own, dtype=np.int64) + base))
                kinds = np.concatenate((kinds, np.asarray(kind, dtype=np.int64)))
                known = int(base + size)
                advance(known)
            yield pd.DataFrame(out, columns=[*keys, "piece_no", "start", "end"])
            out.clear()
        close()
        yield pd.DataFrame(out, columns=[*keys, "piece_no", "start", "end"])

    ordered = laid.select(*keys, "_limit", "part", "_base", "size", "bounds", "kinds").repartition(*keys).sortWithinPartitions(*keys, "part")
    return ordered.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in keys) + ", piece_no int, start long, end long")


def _pieces_of_many(ranges: DataFrame, keys: list[str], overlap: int, width: int) -> DataFrame:
    """Items of several ranges: tables are stitched by prefix sums, pieces planned on them and emitted by offset."""
    laid = _laid(ranges, keys, width)
    # A piece is put together of the ranges it touches, found by their numbers in a grid of collapsed offsets.
    cells = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    spread = _plans(laid, keys, overlap).withColumn("_cell", cells(F.col("start"), F.col("end") - 1))
    texts = laid.select(*keys, "_base", "size", "white", cells(F.col("_base"), F.col("_base") + F.col("size") - 1).alias("_cell"))
    touched = spread.join(texts.hint("merge"), [*keys, "_cell"]).filter("_base < end AND _base + size > start")
    begin, stop = F.greatest(F.col("start") - F.col("_base"), F.lit(0)), F.least(F.col("end") - F.col("_base"), F.col("size"))
    parts = touched.withColumn("_cut", F.col("white").substr((begin + 1).cast("int"), (stop - begin).cast("int")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_base", "_cut"))), lambda x: x["_cut"]), "")
    return parts.groupBy(*keys, "piece_no", "start", "end").agg(joined.alias("piece"))


def split_files(spark: SparkSession, paths: list[str], limit: int, overlap: int = 200, width: int = 1 << 20) -> DataFrame:
    """The pieces of UTF-8 text files in a folder that all executors see: path, piece_no, start, end, piece.

    Workers read byte ranges of `width`, moved to the next whole character, with halos; nobody reads a whole file.
    """
    import os

    parts = [(p, i, os.path.getsize(p)) for p in paths for i in range(max(1, -(-os.path.getsize(p) // width)))]

    def whole(raw: bytes, lead: bool) -> bytes:
        """Without the rest of a character at the start."""
        k = 0
        while lead and k < len(raw) and k < 4 and raw[k] & 0xC0 == 0x80:
            k += 1
        return raw[k:]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, part in zip(frame["path"], frame["part"]):
                at = int(part) * width
                with open(path, "rb") as f:
                    f.seek(max(0, at - 4 * HALO))
                    before = f.read(at - max(0, at - 4 * HALO))
                    here, after = f.read(width), f.read(4 * HALO + 4)
                own = whole(here, at > 0)
                before += here[: len(here) - len(own)]
                after_whole = whole(after, True)
                own += after[: len(after) - len(after_whole)]
                text = own.decode("utf-8", "replace")
                rows.append((path, int(part), whole(before, at > 4 * HALO).decode("utf-8", "replace")[-HALO:], text, after_whole.decode("utf-8", "ignore")[:HALO]))
            yield pd.DataFrame(rows, columns=["path", "part", "before", "range", "after"])

    listed = spark.createDataFrame(parts, "path string, part int, bytes long").repartition(max(1, min(len(parts), 10_000)))
    ranges = listed.select("path", "part").mapInPandas(load, "path string, part int, before string, range string, after string")
    return _pieces_of_many(ranges.withColumn("_limit", F.lit(limit)), ["path"], overlap, width)
