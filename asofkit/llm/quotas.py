"""A sample whose categories match target shares, with floors, by min-cost flow on the cross-classified cells.

Spark counts the distinct records of each cell; the flow runs over the cells of the target table, whose number is fixed by
it: source > sample > split > (split, year) > cell > reason > sink. The sample's arc carries its size, the split, year and
reason arcs their margins at no cost and more at some cost, a cell's arc what is there. Between a cell and its reason lie its
demands: its floor, its target rounded down, one more row at a random gain that draws how fractions are rounded, and
what is surplus. Floors and targets can also be met by slack arcs from the source, dearly: what flows on them is the
shortfall that is reported. The rows of a cell are those of the least hashed ids; a histogram of the hash finds the one
bucket that is cut, so no task sorts a whole cell.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.flow import Network

CELL = ["split", "pub_year", "selection_reason"]
_BUCKETS = 4096
#: Gains of rows in the sample and of demands that are met, and costs of slack, of rows beyond a margin and of surplus.
_ROW, _FLOOR, _TARGET, _SLACK, _MARGIN, _SURPLUS = 50.0, 5000.0, 500.0, 0.9, 8.0, 2.0


def _plain(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def pool(records: DataFrame, once: bool = False) -> DataFrame:
    """(split, pub_year, selection_reason, sample_id, row_ix): one row per distinct sample_id and cell, its least row_ix.

    With `once` a sample_id found in several cells is in that of its least row_ix alone, so that a sample has it once.
    The year is that of `published_at` in UTC; rows lacking a category, sample_id or a readable time are in no cell.
    """
    year = F.expr("year(to_utc_timestamp(try_cast(trim(published_at) AS timestamp), current_timezone()))")
    named = records.select(_plain("split").alias("split"), year.alias("pub_year"), _plain("selection_reason").alias("selection_reason"), "sample_id", "row_ix").dropna(subset=[*CELL, "sample_id"])
    if once:
        return named.groupBy("sample_id").agg(F.min(F.struct("row_ix", *CELL)).alias("m")).select(*(F.col(f"m.{c}").alias(c) for c in CELL), "sample_id", "m.row_ix")
    return named.groupBy(*CELL, "sample_id").agg(F.min("row_ix").alias("row_ix"))


def _targets(targets: DataFrame) -> DataFrame:
    return targets.select(_plain("split").alias("split"), "pub_year", _plain("selection_reason").alias("selection_reason"), *(F.col(c) for c in ("target_share", "min_rows", "sample_rows")), F.struct(*CELL).alias("written"))


def cells(records: DataFrame, targets: DataFrame, once: bool = False) -> DataFrame:
    """Each target cell with `available`, its distinct records, and `needed`, the larger of floor and unrounded target."""
    counts = pool(records, once).groupBy(*CELL).agg(F.count("*").alias("available"))
    named = _targets(targets).join(counts, CELL, "left").withColumn("available", F.coalesce("available", F.lit(0)))
    return named.withColumn("needed", F.greatest(F.col("min_rows").cast("double"), F.col("target_share") * F.col("sample_rows")))


def shortfalls(found: list[dict]) -> list[int]:
    """What flows on the slack arc of each cell when all cells are to be filled, from what is there at no cost and by slack at some."""
    net, slack = Network(), []
    for k, x in enumerate(found):
        need = max(0, math.ceil((x["needed"] or 0.0) - 1e-9))
        net.arc("from", ("cell", k), int(x["available"]), 0.0)
        slack.append(net.arc("from", ("cell", k), need, 1.0))
        net.arc(("cell", k), "to", need, -2.0)
    net.send("from", "to", 1 << 62, while_gaining=True)
    return [net.used(n) for n in slack]


def unfilled(records: DataFrame, targets: DataFrame) -> DataFrame:
    """The target cells that the pool can't fill, as written in the targets: those whose slack arc carries flow, checked by the unrounded need."""
    rows = cells(records, targets).select(*CELL, "available", "needed", "written").collect()  # one per target cell
    short = [r for r, n in zip(rows, shortfalls([r.asDict() for r in rows])) if n > 0 and r["available"] < r["needed"]]
    types = dict(targets.dtypes)
    return records.sparkSession.createDataFrame([tuple(r["written"]) for r in short], ", ".join(f"{c} {types[c]}" for c in CELL))


def draw_quotas(found: list[dict], seed: int = 0) -> list[dict]:
    """Integer quotas of the cells (dicts with the categories, target_share, min_rows, sample_rows, available); adds quota, short_floor, short_target, the latter from the slack arcs."""
    if not found:
        return []
    total = max(int(x["sample_rows"] or 0) for x in found)
    chance = random.Random(seed)
    net = Network()
    wanted = [(x["target_share"] or 0.0) * total for x in found]
    margins: dict = {}
    for x, w in zip(found, wanted):
        for key in (("split", x["split"]), ("year", x["split"], x["pub_year"]), ("reason", x["selection_reason"])):
            margins[key] = margins.get(key, 0.0) + w
    net.arc("from", "sample", total, -_ROW)

    def margin(a, b, key):
        whole = math.floor(margins[key] + chance.random())
        net.arc(a, b, whole, 0.0)
        net.arc(a, b, total + len(found), _MARGIN)

    for key in sorted(margins, key=str):
        if key[0] == "split":
            margin("sample", key, key)
        elif key[0] == "year":
            margin(("split", key[1]), key, key)
        else:
            margin((*key, "in"), "to", key)
    arcs = []
    for k, x in enumerate(sorted(found, key=lambda c: str([c[n] for n in CELL]))):
        w = (x["target_share"] or 0.0) * total
        floor, have, whole = int(x["min_rows"] or 0), int(x["available"]), math.floor(w + 1e-9)
        both, reason = min(floor, whole), ("reason", x["selection_reason"], "in")
        into = net.arc(("year", x["split"], x["pub_year"]), ("cell", k), have, 0.0)
        slack = []
        for n, gain in ((both, _FLOOR), (floor - both, _FLOOR), (whole - both, _TARGET)):
            demand = ("demand", k, len(slack))
            net.arc(("cell", k), demand, n, 0.0)
            slack.append(net.arc("slack", demand, n, _SLACK * gain))
            net.arc(demand, ("met", k), n, -gain)
        net.arc("from", "slack", sum((floor, whole, -both)), 0.0)
        part = w - whole
        if part > 1e-9 and whole >= floor:
            # A gain with the chance of the fraction: the draw of the rounding.
            net.arc(("cell", k), ("met", k), 1, -0.4 * _ROW if chance.random() < part else -0.01 * part)
        net.arc(("cell", k), ("met", k), have, _SURPLUS + chance.random() * 0.01)
        # Slack doesn't count in the margins.
        net.arc(("met", k), reason, have, 0.0)
        net.arc(("met", k), "to", floor + whole - both, 4 * _MARGIN)
        arcs.append((x, into, slack))
    net.send("from", "to", 1 << 62, while_gaining=True)
    return [
        x | {"quota": net.used(into), "short_floor": net.used(slack[0]) + net.used(slack[1]), "short_target": max(0, net.used(slack[0]) + net.used(slack[2]))} for x, into, slack in arcs
    ]


def _quotas(records: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """The quotas as a table; the driver sees one row per target cell."""
    found = [r.asDict() for r in cells(records, targets, once=True).select(*CELL, "target_share", "min_rows", "sample_rows", "available", "written").collect()]
    rows = [(x["split"], x["pub_year"], x["selection_reason"], x["target_share"], x["min_rows"], x["available"], x["quota"], x["short_floor"], x["short_target"]) for x in draw_quotas(found, seed)]
    return records.sparkSession.createDataFrame(rows, "split string, pub_year int, selection_reason string, target_share double, min_rows int, available long, quota long, short_floor long, short_target long")


def least_hashed(rows: DataFrame, group: list[str], key: str, quotas: DataFrame, seed: int) -> DataFrame:
    """Of each group its `quota` rows with the least hash of `key`; ties by the key. Only the bucket that is cut is ranked."""
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(seed), key))
    hashed = hashed.withColumn("_b", F.least(F.floor((F.col("_h").cast("double") + 2.0**63) / (2.0**64 / _BUCKETS)), F.lit(_BUCKETS - 1)).cast("int"))
    histogram = hashed.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    limits = histogram.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(F.broadcast(quotas.select(*group, "quota")), group).filter("_before < quota")
    kept = hashed.join(limits.select(*group, "_b", (F.col("quota") - F.col("_before")).alias("_room"), "_n"), [*group, "_b"])
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    whole, cut = kept.filter("_n <= _room"), kept.filter("_n > _room").withColumn("_rank", rank).filter("_rank <= _room")
    return whole.select(*rows.columns).unionByName(cut.select(*rows.columns))


def sample(records: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """The sample: split, pub_year, selection_reason, sample_id, row_ix, each sample_id at most once.

    The same seed draws the same sample. Cells without target are not drawn from; an empty pool gives an empty sample.
    """
    return least_hashed(pool(records, once=True), CELL, "sample_id", _quotas(records, targets, seed), seed)


def report(records: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Per target cell: target_share, min_rows, available, quota, actual_share, short_floor, short_target (rows under floor and under the target rounded down)."""
    quotas = _quotas(records, targets, seed)
    total = quotas.agg(F.sum("quota").alias("total"))
    return quotas.crossJoin(F.broadcast(total)).withColumn("actual_share", F.col("quota") / F.col("total")).drop("total")
