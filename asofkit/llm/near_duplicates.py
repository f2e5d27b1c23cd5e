"""Near-duplicate short texts: every pair at or above a Jaccard similarity of word sets.

Candidates share a band. As texts of one template share most of their words, bands drawn by plain minhashing would make
nearly all pairs of a template candidates; here a band is a few words from the rare end of a text, in one global order from
rare to frequent: two sets with similarity t share at least ceil(t n) words of a set of n, and their first k shared words lie
among its first n - ceil(t n) + k. The more frequent a band's first word, the more of the next shared words it holds, up to
`MOST_WORDS`, but never more than the pair must share, whatever the threshold; so bands stay small, and no pair is lost. The
order comes from word counts in a fixed number of hash buckets, whose size doesn't grow with the data. Bands that are large
all the same, told by a histogram of fixed size, are joined in pairs of blocks, spread over all tasks.

A candidate carries its size, a map of its words in 128 bits, and its signature. Where two maps differ in more bits than a
pair at the threshold may have words apart, it is none for certain. It is then verified as in sequential Bayesian similarity
search: batches of 64 one-bit minhashes are compared, and a pair is pruned as soon as the posterior chance that it reaches
the threshold is under `miss`; the words of survivors are fetched and compared. They are verified on their whole word sets, held as 32 bits a word, so that a pair has a wrong shared word with a chance of some 1e-7. Records with
equal word sets are one class from the start and are joined again at the end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.lookalikes import consistent
from asofkit.operators.components import connected_components
from asofkit.operators.joins import lookup
from asofkit.session import cut

_WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 22
#: Words in at most ALONE sets are a band alone; STEP times as frequent ones take one more word each.
ALONE, STEP, MOST_WORDS = 48, 85, 4
#: Bands are counted in so many hash buckets; those in buckets of more than BLOCK rows are joined in pairs of blocks of that size.
SLOTS, BLOCK = 1 << 20, 2048
BATCHES, BITS = 2, 64


def words(text: str) -> list[str]:
    """The distinct words of a text in its consistent form and lower case; a text without words is one word itself."""
    form = consistent(text).lower()
    return list(dict.fromkeys(_WORD.findall(form))) or [form]


def most_differences(threshold: float, miss: float, bits: int) -> int:
    """The most differing one-bit minhashes among `bits` at which the posterior chance of reaching the threshold isn't under `miss` (uniform prior)."""
    s = np.linspace(0.5, 1, 20_001)[1:-1]
    for differ in range(bits, -1, -1):
        log = (bits - differ) * np.log(s) + differ * np.log1p(-s)
        p = np.exp(log - log.max())
        if p[s >= (1 + threshold) / 2].sum() / p.sum() >= miss:
            return differ
    return 0


def _word_sets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for frame in frames:
        ids, sets = [], []
        for text in frame["text"]:
            hashes = []
            for w in words(text):
                h = known.get(w)
                if h is None:
                    if len(known) > 500_000:
                        known.clear()
                    h = known[w] = xxhash.xxh3_64_intdigest(w) - (1 << 63)
                hashes.append(h)
            array = np.unique(np.array(hashes, dtype=np.int64))
            sets.append(array.astype(np.int32))  # the low half
            ids.append(xxhash.xxh3_128_digest(array.tobytes()))
        yield pd.DataFrame({"row": frame["row"], "set_id": ids, "words": sets})


def _signature(flat: np.ndarray, starts: np.ndarray, batch: int) -> np.ndarray:
    """A batch of one-bit minhashes of each set, as one signed integer."""
    seeds = np.random.default_rng(1 + batch).integers(1, 1 << 63, size=(BITS, 2), dtype=np.uint64)
    x = (flat.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64)
    out = np.zeros(len(starts), dtype=np.uint64)
    for bit, (mul, add) in enumerate(seeds):
        mixed = x * (mul | np.uint64(1)) + add
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum.reduceat(mixed * np.uint64(0xBF58476D1CE4E5B9), starts)
        out |= ((least >> np.uint64(37)) & np.uint64(1)) << np.uint64(bit)
    return out.view(np.int64)


def _banded(frame: pd.DataFrame, counts: np.ndarray, threshold: float, alone: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the frame, band) of each band of each set, and the flat words, their starts and the sizes of the sets."""
    sizes = np.fromiter(map(len, frame["words"]), dtype=np.int64, count=len(frame))
    flat = np.concatenate(frame["words"].to_numpy())
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    row = np.repeat(np.arange(len(frame)), sizes)
    count = counts[flat & (BUCKETS - 1)].astype(np.int64)
    order = np.lexsort((flat, count, row))
    flat, count = flat[order], count[order]
    level = np.ones(len(flat), dtype=np.int64)
    for k in range(1, MOST_WORDS):
        level += count > alone * step ** (k - 1)
    place, size = np.arange(len(flat)) - np.repeat(starts, sizes), sizes[row]
    need = np.maximum(np.ceil(threshold * size - 1e-9).astype(np.int64), 1)  # words that any partner shares
    reach = size - need  # the k-th shared word is at most at this place + k - 1
    head = (place <= reach) & (count > 1)
    single = head & ((level == 1) | (need == 1))
    code = flat.astype(np.int64)
    rows, bands = [row[single]], [code[single] * 8 + 1]
    for i in np.flatnonzero(head & (level > 1)).tolist():  # few words of the rare end are frequent
        begin, far, most = starts[row[i]], int(reach[i]), int(level[i])
        end = begin + int(size[i])
        grown = [(int(code[i]), i)]
        for k in range(2, most + 1):
            grown = [(_mix(x ^ int(code[j]), k), j) for x, last in grown for j in range(last + 1, min(begin + far + k, end))]
            if k >= min(most, int(need[i])):
                rows.append(np.full(len(grown), row[i])), bands.append(np.array([x for x, _ in grown], dtype=np.int64))
    return np.concatenate(rows).astype(np.int64), np.concatenate(bands), flat, starts, sizes


def _slot(bands: np.ndarray) -> np.ndarray:
    return (bands ^ (bands >> 23) ^ (bands >> 44)) & (SLOTS - 1)


def _histogram(frames: Iterator[pd.DataFrame], counts: np.ndarray, threshold: float, alone: int, step: int) -> Iterator[pd.DataFrame]:
    total = np.zeros(SLOTS, dtype=np.int64)
    for frame in frames:
        if len(frame):
            total += np.bincount(_slot(_banded(frame, counts, threshold, alone, step)[1]), minlength=SLOTS)
    held = np.flatnonzero(total)
    yield pd.DataFrame({"slot": held.astype(np.int32), "n": total[held]})


def _bands(frames: Iterator[pd.DataFrame], counts: np.ndarray, blocks: np.ndarray, threshold: float, alone: int, step: int) -> Iterator[pd.DataFrame]:
    """The bands of each set with its size, word map and signature, without its words.

    A band of one block is in cell 0, once. Of a band of more, a row lies in one block and is sent to each pair of it with
    a later one as side 1, and with an earlier one as side 2.
    """
    for frame in frames:
        if not len(frame):
            continue
        where, band, flat, starts, sizes = _banded(frame, counts, threshold, alone, step)
        columns = {"row": frame["row"].to_numpy(dtype=np.int64), "size": sizes.astype(np.int32)}
        columns |= {f"map_{b}": m for b, m in enumerate(_word_map(flat, starts))} | {f"sign_{b}": _signature(flat, starts, b) for b in range(BATCHES)}
        cell, side, many = np.zeros(len(band), dtype=np.int64), np.zeros(len(band), dtype=np.int8), blocks[_slot(band)]
        if (many > 1).any():
            out_where, out_band, out_cell, out_side = [where[many == 1]], [band[many == 1]], [cell[many == 1]], [side[many == 1]]
            own = (columns["row"][where] * 0x5851F42D4C957F2D >> 33) % many
            for k in np.flatnonzero(many > 1).tolist():
                n, o = int(many[k]), int(own[k])
                cells = np.concatenate((o * n + np.arange(o, n), np.arange(0, o + 1) * n + o))
                out_cell.append(cells + 1), out_side.append(np.repeat(np.array([1, 2], dtype=np.int8), (n - o, o + 1)))
                out_where.append(np.full(len(cells), where[k])), out_band.append(np.full(len(cells), band[k]))
            where, band, cell, side = map(np.concatenate, (out_where, out_band, out_cell, out_side))
        yield pd.DataFrame({"band": band, "cell": cell, "side": side, **{c: v[where] for c, v in columns.items()}})


def _word_map(flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two integers per set, with a bit for each of its words."""
    bit = ((flat.astype(np.int64) & 0xFFFFFFFF).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(57)
    one = np.uint64(1) << (bit & np.uint64(63))
    return [np.bitwise_or.reduceat(np.where((bit >> np.uint64(6)) == half, one, np.uint64(0)), starts).view(np.int64) for half in (0, 1)]


def _mix(x: int, salt: int) -> int:
    x = (int(x) ^ salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x ^= x >> 27
    return x - (1 << 64) if x >> 63 else x


def word_classes(df: DataFrame, row: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(members: row, class, copied), (classes: row, words); a class is the records with one word set and bears its least row. Null texts and rows are in none."""
    sets = cut(df.select(row.alias("row"), text.alias("text")).filter("row IS NOT NULL AND text IS NOT NULL").mapInPandas(_word_sets, "row long, set_id binary, words array<int>"))
    classes = cut(sets.groupBy("set_id").agg(F.min("row").alias("class"), F.count("*").alias("n"), F.first("words").alias("words")))
    several = classes.filter("n > 1").select("set_id", "class", "n")
    members = lookup(sets.select("row", "set_id"), several, "set_id", weight="n").select("row", F.coalesce("class", "row").alias("class"), F.col("class").isNotNull().alias("copied"))
    return members, classes.select(F.col("class").alias("row"), "words")


def class_links(classes: DataFrame, threshold: float, miss: float = 1e-6, bands_of: tuple[int, int] = (ALONE, STEP), block: int = BLOCK) -> DataFrame:
    """Pairs a < b of classes whose word sets have at least the similarity; each pair once."""
    if not 0 < threshold <= 1:
        raise ValueError("a similarity threshold lies above 0 and is at most 1")
    send = classes.sparkSession.sparkContext.broadcast
    counted = classes.select(F.explode("words").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    # At most BUCKETS rows, whatever the size of the data; words in one set alone make no band and aren't sent.
    held = counted.filter("n > 1").select("bucket", F.least("n", F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts = np.ones(BUCKETS, dtype=np.uint32)
    counts[np.asarray(held["bucket"])] = np.asarray(held["n"])
    words_sent = send(counts)
    # At most SLOTS rows.
    full = classes.mapInPandas(lambda frames: _histogram(frames, words_sent.value, threshold, *bands_of), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).filter(F.col("n") > block).toArrow()
    blocks = np.ones(SLOTS, dtype=np.int32)
    blocks[np.asarray(full["slot"])] = -(-np.asarray(full["n"]) // block)
    blocks_sent = send(blocks)
    longs = ["map_0", "map_1", *(f"sign_{b}" for b in range(BATCHES))]
    bands = classes.mapInPandas(lambda frames: _bands(frames, words_sent.value, blocks_sent.value, threshold, *bands_of), "band long, cell long, side byte, row long, size int, " + ", ".join(f"{c} long" for c in longs))
    a, b = (bands.select("band", "cell", *(F.col(c).alias(f"{c}_{x}") for c in ("side", "row", "size", *longs))) for x in "ab")
    differ = {c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in longs}
    size_a, size_b = F.col("size_a"), F.col("size_b")
    # Once each pair: by rows in a block, by sides across blocks.
    once = F.when(F.col("side_a") + F.col("side_b") == 0, F.col("row_a") < F.col("row_b")).otherwise((F.col("side_a") == 1) & (F.col("side_b") == 2) & (F.col("row_a") != F.col("row_b")))
    sized = F.least(size_a, size_b) >= F.greatest(size_a, size_b) * threshold - 1e-9
    apart = differ["map_0"] + differ["map_1"] <= (size_a + size_b) * ((1 - threshold) / (1 + threshold)) + 1e-9
    unpruned = [reduce(lambda x, y: x + y, [differ[f"sign_{b}"] for b in range(k)]) <= most_differences(threshold, miss, BITS * k) for k in range(1, BATCHES + 1)]
    found = a.join(b.hint("merge"), ["band", "cell"]).filter(reduce(lambda x, y: x & y, [once, sized, apart, *unpruned]))
    pairs = found.select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b")).distinct()
    # Words are fetched for the pairs that are left.
    held_a, held_b = (classes.select(F.col("row").alias(c), F.col("words").alias(f"words_{c}")).hint("merge") for c in "ab")
    fetched = pairs.join(held_a, "a").join(held_b, "b").withColumn("shared", F.size(F.array_intersect("words_a", "words_b")))
    return fetched.filter(F.col("shared") >= threshold * (F.size("words_a") + F.size("words_b") - F.col("shared")) - 1e-9).select("a", "b")


def _copies(members: DataFrame, salts: int) -> DataFrame:
    """The pairs within classes; both sides of a class are spread over `salts` tasks."""
    held = members.filter("copied")
    a = held.select("class", F.col("row").alias("row_a"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"))
    b = held.select("class", F.col("row").alias("row_b"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return a.join(b.hint("merge"), ["class", "salt"]).filter("row_a < row_b").select("row_a", "row_b")


def near_duplicate_pairs(df: DataFrame, row: str = "row_ix", text: str = "title", threshold: float = 0.6, miss: float = 1e-6, salts: int = 8, bands_of: tuple[int, int] = (ALONE, STEP), block: int = BLOCK) -> DataFrame:
    """All pairs row_a < row_b of records whose word sets have at least the similarity, copies included.

    Null texts are in no pair; texts without any word pair only with equal ones. `row` must be unique.
    """
    members, classes = word_classes(df, F.col(row), F.col(text))
    links = class_links(classes, threshold, miss, bands_of, block)
    left, right = (members.select(F.col("class").alias(c), F.col("row").alias(r)).hint("merge") for c, r in (("a", "x"), ("b", "y")))
    across = links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b"))
    return _copies(members, salts).unionByName(across)


def near_duplicate_groups(df: DataFrame, row: str = "row_ix", text: str = "title", threshold: float = 0.6, miss: float = 1e-6) -> DataFrame:
    """One row per record: row_ix, class_id (least record with the same word set), links (other classes it is linked to), group_id (least record it is connected to). A null text is a group of its own."""
    members, classes = word_classes(df, F.col(row), F.col(text))
    links = cut(class_links(classes, threshold, miss))
    groups = connected_components(links, "a", "b").select(F.col("node").alias("class"), "component")
    degree = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count("*").alias("links"))
    told = degree.join(groups.hint("merge"), "class", "left")
    found = lookup(members, told, "class")
    nulls = df.filter(F.col(row).isNotNull() & F.col(text).isNull()).select(F.col(row).alias("row_ix"), F.col(row).alias("class_id"), F.lit(0).cast("long").alias("links"), F.col(row).alias("group_id"))
    return found.select(F.col("row").alias("row_ix"), F.col("class").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("component", "class").alias("group_id")).unionByName(nulls)
