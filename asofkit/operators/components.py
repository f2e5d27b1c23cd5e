"""Connected components by contraction; no node's neighbours are ever gathered in one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators.joins import lookup
from asofkit.session import cut, drop_cut

#: So many edges are contracted in one task, whatever the size of the data was.
ONE_TASK = 200_000


def _joined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The root of each node of the last edges, whose number is bounded."""
    up: dict[int, int] = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for frame in frames:
        for a, b in zip(frame["u"].tolist(), frame["v"].tolist()):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pd.DataFrame({"node": np.array(nodes, dtype=np.int64), "label": np.array([*map(find, nodes)], dtype=np.int64)})


def _round(edges: DataFrame, salt: int) -> tuple[DataFrame, DataFrame]:
    """(node, label) of every node of the edges, the least of itself and its neighbours in an order that `salt` turns, and the edges between different labels.

    An order that changes by round leaves about half of the nodes as labels, so a few rounds do, and what is settled is
    no longer carried along. Nodes of very many edges are looked up by broadcast.
    """
    turned = lambda c: F.col(c).bitwiseXOR(F.lit(salt))
    both = edges.select("u", turned("v").alias("h")).unionAll(edges.select(F.col("v").alias("u"), turned("u").alias("h")))
    least = both.groupBy("u").agg(F.min("h").alias("h"), F.count("*").alias("degree"))
    labels = cut(least.select(F.col("u").alias("node"), F.least("h", turned("u")).bitwiseXOR(F.lit(salt)).alias("label"), "degree"))
    one = lookup(edges, labels.select(F.col("node").alias("u"), F.col("label").alias("lu"), "degree"), "u", weight="degree")
    two = lookup(one.select("lu", "v"), labels.select(F.col("node").alias("v"), F.col("label").alias("lv"), "degree"), "v", weight="degree")
    left = two.filter("lu <> lv").select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct()
    return labels, cut(left)


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node with an edge to another; the component is its least node.

    Edges with a null end and loops link nothing and name no node; repeated edges count once; no edges, no rows.
    Rounds contract the edges until at most `one_task` are left, which one task joins.
    """
    e = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = cut(e.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct())
    chance, steps = np.random.default_rng(7), []
    while now.count() > one_task:
        if len(steps) == most_rounds:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
        labels, left = _round(now, int(chance.integers(1 << 62)))
        drop_cut(now)
        steps.append(labels)
        now = left
    found = now.coalesce(1).mapInPandas(_joined, "node long, label long")
    for labels in reversed(steps):
        # What a label became in later rounds, if it had edges then.
        later = found.select(F.col("node").alias("label"), F.col("label").alias("root"))
        named = lookup(labels.select("node", "label"), later, "label")
        found = cut(named.select("node", F.coalesce("root", "label").alias("label")))
    if steps:  # labels are least in a turned order; the last task's are the least themselves
        found = cut(lookup(found, found.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("members")), "label", weight="members"))
        return found.select("node", "component")
    return found.select("node", F.col("label").alias("component"))
