"""Mixed timestamp notations and zones to one UTC instant.

Every value gets the array of all its valid readings; where there is more than one, a Viterbi pass over the record order
of its source chooses, charging each switch of notation and each backward jump in time. A value with one reading pins the
path, so the pass falls apart into runs between pinned values. Sources are cut into blocks of `block_rows` record numbers,
so that one source of any size spreads over many tasks. Runs that reach over a block's edge are settled across blocks: each
block's piece of such a run gives its least costs from every first to every last reading, one scan over these small tables
of a source finds the readings at the edges, and each block fills in between them. So the blocks don't change the result.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.functions.instants import interpretations, iso
from asofkit.session import cut

SWITCH_COST, BACK_COST, DAY_US = 2.0, 1.0, 86_400_000_000
#: A source rarely changes what comes first in its dates, whatever else it writes in between.
ORDER_COST, ORDERS = 12.0, {"mdy_slash", "dmy_slash"}
_EPOCH, _MICRO = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)
CANONICAL = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ|\d{8}T\d{6}Z")


Reading = tuple[str, int]


def _step(a: Reading | None, b: Reading) -> float:
    if a is None:
        return 0.0
    gap = b[1] - a[1]
    switch = 0.0 if a[0] == b[0] else ORDER_COST if {a[0], b[0]} == ORDERS else SWITCH_COST
    return switch + (BACK_COST * math.log1p(-gap / DAY_US) if gap < 0 else 0.1 * math.log1p(gap / DAY_US))


def _cost(a: Reading | None, b: Reading) -> int:
    """A step as a whole number, so that sums don't depend on how a run is taken apart; the low bits are left for ties."""
    return round(_step(a, b) * 1e9) << 32


def _ties(readings: list[Reading], row: int) -> list[int]:
    """What parts paths of equal cost: the earlier listed reading, then a hash."""
    return [(k << 16) + (zlib.crc32(f"{row}|{x}".encode()) & 0xFFFF) for k, x in enumerate(readings)]


def _forward(costs: list[int], run: list[list[Reading]], rows: list[int]) -> tuple[list[int], list[list[int]]]:
    """The least costs of the last readings of a run, and the way back, from the costs of its first ones."""
    back = []
    for prev, now, row in zip(run, run[1:], rows[1:]):
        scores = [[c + _cost(p, x) for c, p in zip(costs, prev)] for x in now]
        best = [min(range(len(prev)), key=s.__getitem__) for s in scores]
        costs = [s[k] + t for s, k, t in zip(scores, best, _ties(now, row))]
        back.append(best)
    return costs, back


def _path(k: int, back: list[list[int]]) -> list[int]:
    path = [k]
    for best in reversed(back):
        path.append(k := best[k])
    return path[::-1]


def choose(before: Reading | None, run: list[list[Reading]], after: Reading | None, rows: list[int] | None = None) -> list[Reading]:
    """The cheapest path through a run of values with several readings, between two pinned ones; ties go to the earlier listed reading."""
    rows = rows or [*range(len(run))]
    costs, back = _forward([_cost(before, x) + t for x, t in zip(run[0], _ties(run[0], rows[0]))], run, rows)
    if after is not None:
        costs = [c + _cost(x, after) for c, x in zip(costs, run[-1])]
    return [r[k] for r, k in zip(run, _path(min(range(len(costs)), key=costs.__getitem__), back))]


def _canonical(value: str) -> list[tuple[str, int]]:
    try:
        return [("iso" if value[4] == "-" else "basic", (datetime.fromisoformat(value) - _EPOCH) // _MICRO)]
    except ValueError:
        return []


_COLUMNS = ["stream", "source", "row_ix", "value", "utc_at", "notation", "readings", "done", "segment", "kinds", "instants"]


def _decode(frames: Iterator[pd.DataFrame], slashes: str) -> Iterator[pd.DataFrame]:
    """Each value with its reading. Runs at a block's edges stay open: their rows, and the first and the last pinned value, have all readings and a segment, twice the block's number for the first run and one more for the last."""
    key, pin, out = None, None, []
    waiting: list[tuple] = []  # (row, readings) since the last pinned value
    known: dict[tuple, list] = {}

    def told(row, found, chosen, done=False, segment=None):
        return (*row, iso(chosen[1]) if chosen else None, chosen[0] if chosen else None, len({x[1] for x in found}), done, segment, [x[0] for x in found] if segment is not None else None, [x[1] for x in found] if segment is not None else None)

    def edge():
        """The pinned value last in a block and the open run after it; without any, the whole block."""
        if key is not None:
            segment = 2 * key[2] + (pin is not None)
            if pin is not None:
                out.append(told(pin[0], pin[1], pin[1][0], None, segment))
            out.extend(told(row, found, None, False, segment) for row, found in waiting)
            waiting.clear()

    plain = CANONICAL.fullmatch
    for frame in frames:
        if frame["_row"].dtype.kind == "f":  # nulls among the record numbers
            frame["_row"] = [None if x != x else int(x) for x in frame["_row"]]
        for stream, source, block, row, value, zone, dates_done in zip(*(frame[c].array for c in ("_stream", "_source", "_block", "_row", "_value", "_zone", "_dates_done"))):
            if (here := (stream, source, block)) != key:
                edge()
                key, pin = here, None
            done = False
            if value is None or value != value:
                found = []
            elif plain(value):
                done, found = True, _canonical(value)
            else:
                k = (value, zone)
                found = known.get(k)
                if found is None:
                    if len(known) > 100_000:
                        known.clear()
                    found = known[k] = interpretations(value, zone, slashes)
                done = bool(dates_done) and len(value) == 10 and value[4] == "-" == value[7]
            record = (stream, source, row, value)
            if len(found) == 1:
                if waiting and pin is not None:
                    for (one, readings), reading in zip(waiting, choose(pin[1][0], [c for _, c in waiting], found[0], [int(r[2] or 0) for r, _ in waiting])):
                        out.append(told(one, readings, reading))
                    waiting.clear()
                elif pin is None:  # the block's first run, with the pinned value after it
                    out.extend(told(one, readings, None, False, 2 * block) for one, readings in waiting)
                    out.append(told(record, found, found[0], None, 2 * block))
                    waiting.clear()
                pin = (record, found)
                out.append(told(record, found, found[0], done))
            elif found:
                waiting.append((record, found))
            else:
                out.append(told(record, found, None))
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=_COLUMNS)
            out.clear()
    edge()
    yield pd.DataFrame(out, columns=_COLUMNS)


def _segments(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The rows of each open segment; a task holds one at a time, of at most a block."""
    key, held = None, []
    for frame in frames:
        columns = [c for c in ("stream", "source", "segment", "row_ix", "value", "kinds", "instants", "done", "entry", "leave") if c in frame]
        for x in frame[columns].to_dict("records"):
            here = (x["stream"], x["source"], x["segment"])
            if here != key and held:
                yield key, held
                held = []
            key = here
            row = None if x["row_ix"] is None or x["row_ix"] != x["row_ix"] else int(x["row_ix"])
            held.append(x | {"row_ix": row, "found": [*zip(x["kinds"], map(int, x["instants"]))]})
    if held:
        yield key, held


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each segment its first and last readings and the least cost from each of the first to each of the last."""
    for (stream, source, segment), held in _segments(frames):
        run, rows = [x["found"] for x in held], [x["row_ix"] or 0 for x in held]
        ties = _ties(run[0], rows[0])
        costs = [_forward([ties[k] if j == k else 1 << 200 for j in range(len(run[0]))], run, rows)[0] for k in range(len(run[0]))]
        yield pd.DataFrame({"stream": [stream], "source": [source], "segment": [segment], "piece": [pickle.dumps((run[0], run[-1], costs))]})


def _edges(frame: pd.DataFrame) -> pd.DataFrame:
    """The readings at both ends of each segment of one source, by a scan over its segments' tables. A segment that ends or begins at a pinned value has one reading there."""
    frame = frame.sort_values("segment")
    pieces = [pickle.loads(x) for x in frame["piece"]]
    before, ways = None, []
    for first, last, costs in pieces:
        if before is None:
            into, way = [0] * len(first), [None] * len(first)
        else:
            scores = [[c + _cost(p, x) for c, p in zip(before[1], before[0])] for x in first]
            way = [min(range(len(s)), key=s.__getitem__) for s in scores]
            into = [s[k] for s, k in zip(scores, way)]
        total = [[into[j] + costs[j][t] for j in range(len(first))] for t in range(len(last))]
        best = [min(range(len(first)), key=s.__getitem__) for s in total]
        ways.append((way, best))
        before = (last, [s[k] for s, k in zip(total, best)])
    t = min(range(len(before[1])), key=before[1].__getitem__)
    entry, leave = [], []
    for way, best in reversed(ways):
        leave.append(t), entry.append(best[t])
        t = way[best[t]]
    return pd.DataFrame({"stream": frame["stream"], "source": frame["source"], "segment": frame["segment"], "entry": entry[::-1], "leave": leave[::-1]})


def _fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The readings within each segment between those at its ends; pinned values are told already."""
    for (stream, _, _), held in _segments(frames):
        run, rows = [x["found"] for x in held], [x["row_ix"] or 0 for x in held]
        start = [t if k == held[0]["entry"] else 1 << 200 for k, t in enumerate(_ties(run[0], rows[0]))]
        path = _path(int(held[0]["leave"]), _forward(start, run, rows)[1])
        out = [(stream, x["row_ix"], x["value"], iso(f[k][1]), f[k][0], len({r[1] for r in f})) for x, f, k in zip(held, run, path) if len(f) > 1]
        yield pd.DataFrame(out, columns=["stream", "row_ix", "value", "utc_at", "notation", "readings"]).astype({"row_ix": "Int64"})


def host_of(url: Column) -> Column:
    """The host of an address in lower case, without port, user and a leading `www.`; null where there is none."""
    host = F.lower(F.regexp_extract(F.trim(url), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def normalize_timestamps(
    df: DataFrame, value: Column, source: Column, order: Column, zone: Column, stream: Column, *, dates_done: bool = False,
    slashes: str = "mdy", only_changed: bool = False, block_rows: int = 32_768,
) -> DataFrame:
    """One row per input row: stream, row_ix, value, utc_at, notation, readings.

    `stream` names the field (several fields may be stacked), `source` the record's outlet, `order` its place in it, `zone`
    the IANA zone of the outlet's wall clock. `utc_at` is null where the value is null, blank, impossible, or names no one
    instant; `readings` counts its valid readings. With `only_changed`, rows already in a canonical notation, and rows
    without instant, are left out. Columns of df other than those named don't matter, repeated rows are kept, and an empty
    df gives an empty result. Null sources share one stream of records.
    """
    # Where their order is open, a source's slashed dates are a sequence of their own, so that other notations between them don't hide it.
    apart = F.when(value.rlike(r"^\s*\d{1,2}/\d{1,2}/\d{4}"), "/").otherwise("") if slashes == "both" else F.lit("")
    rows = df.select(
        stream.alias("_stream"), F.concat(F.coalesce(source, F.lit("")), apart).alias("_source"), F.coalesce(F.floor(order / block_rows), F.lit(-1)).alias("_block"), order.alias("_row"),
        value.alias("_value"), zone.alias("_zone"), F.lit(dates_done).alias("_dates_done") if isinstance(dates_done, bool) else dates_done.alias("_dates_done"),
    )
    ordered = rows.repartition("_stream", "_source", "_block").sortWithinPartitions("_stream", "_source", "_block", "_row", "_value")
    shape = "stream string, row_ix long, value string, utc_at string, notation string, readings int"
    decoded = ordered.mapInPandas(
        lambda frames: _decode(frames, slashes), "stream string, source string, row_ix long, value string, utc_at string, notation string, readings int, done boolean, segment long, kinds array<string>, instants array<long>"
    )
    told = cut(decoded)
    names = ["stream", "row_ix", "value", "utc_at", "notation", "readings"]
    settled = told.filter("segment IS NULL")
    if only_changed:
        settled = settled.filter("NOT done AND utc_at IS NOT NULL")
    out, open_ = settled.select(*names), told.filter("segment IS NOT NULL")
    if open_.filter("size(kinds) > 1").isEmpty():
        return out
    keys = ["stream", "source", "segment"]
    laid = open_.select(*keys, "row_ix", "value", "kinds", "instants")
    by_segment = lambda df: df.repartition(*keys).sortWithinPartitions(*keys, "row_ix", "value")
    tables = by_segment(laid).mapInPandas(_tables, "stream string, source string, segment long, piece binary")
    ends = tables.groupBy("stream", "source").applyInPandas(_edges, "stream string, source string, segment long, entry int, leave int")
    return out.unionByName(by_segment(laid.join(ends.hint("merge"), keys)).mapInPandas(_fill, shape))
