"""Train, validation and test splits that keep linked records together, by component swap search.

Records link through stories and addresses; linked records form components, which move as a whole. Every component starts
where its hash puts it. Components of more than 1/`large` of the records, fewer than `large` by that bound, are annealed
first, on the driver; the others are hashed into groups of a bounded size, each of which is annealed in a task of its own
toward what the large ones left, from several starts in parallel, of which the best is kept. Moves and exchanges of whole
components are accepted by their change in the deviation of sizes and of label counts.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.operators.components import connected_components
from asofkit.operators.joins import lookup
from asofkit.session import cut

LARGE, GROUP, STARTS = 2000, 5000, 4
#: So many labels have goals of their own, the commonest, and so many hashed groups of the rarer ones; so many annealing steps a component, at least `LEAST_STEPS`.
LABELS, RARE_GROUPS, STEPS_EACH, LEAST_STEPS = 64, 16, 12, 2_000
_LABEL_WEIGHT = 0.5


def _plain(c: str) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def with_components(records: DataFrame) -> DataFrame:
    """records' row_ix, split and label (null where blank) with `component`, a long.

    Records share a component when they share `preliminary_cluster_id` (in lower case, without outer blanks) or
    `representative_url` (without outer blanks), directly or through others. Null and blank values link nothing; a record
    without either is a component of its own.
    """
    story, address = _plain("preliminary_cluster_id"), F.nullif(F.trim("representative_url"), F.lit(""))
    rows = records.select(
        "row_ix", _plain("split").alias("split"), _plain("selection_reason").alias("label"),
        F.when(story.isNotNull(), F.xxhash64(F.lit("story"), story)).alias("story"), F.when(address.isNotNull(), F.xxhash64(F.lit("address"), address)).alias("address"),
    ).withColumn("node", F.coalesce("story", "address", F.xxhash64(F.lit("row"), "row_ix")))
    found = connected_components(rows.select("story", "address").distinct(), "story", "address").withColumnRenamed("node", "of")
    named = lookup(rows.withColumnRenamed("node", "of"), found, "of")
    return named.select("row_ix", "split", "label", F.coalesce("component", "of").alias("component"))


def leaking(records: DataFrame) -> DataFrame:
    """row_ix of every record whose component holds more than one distinct split; records without split too."""
    rows = cut(with_components(records))
    torn = rows.groupBy("component").agg((F.min("split") < F.max("split")).alias("torn")).filter("torn")
    return lookup(rows, torn, "component").filter("torn").select("row_ix")


def anneal(parts: list[tuple[int, list[tuple[int, int]]]], start: list[int], size_goal: list[float], label_goal: list[list[float]], seed: int, over_only: bool = False) -> tuple[float, list[int]]:
    """The best found assignment of components (size, [(label, count)]) to splits, and its cost.

    Half of the steps move a component, half exchange two of different splits. With `over_only` only what exceeds a goal
    counts, as when more components follow.
    """
    chance = random.Random(seed)
    n, k = len(parts), len(size_goal)
    at = list(start)
    sizes = [0.0] * k
    tables = [[0.0] * len(label_goal[0]) for _ in range(k)]
    for i, s in enumerate(at):
        sizes[s] += parts[i][0]
        for label, count in parts[i][1]:
            tables[s][label] += count
    scale = max(1.0, sum(size_goal))
    off = (lambda a, b: max(0.0, a - b)) if over_only else (lambda a, b: abs(a - b))

    def shift(i, a, b):
        """Moves component i from split a to b; the change in cost."""
        size, labels = parts[i]
        d = off(sizes[a] - size, size_goal[a]) - off(sizes[a], size_goal[a]) + off(sizes[b] + size, size_goal[b]) - off(sizes[b], size_goal[b])
        sizes[a] -= size
        sizes[b] += size
        e = 0.0
        ta, tb, ga, gb = tables[a], tables[b], label_goal[a], label_goal[b]
        for label, count in labels:
            e += off(ta[label] - count, ga[label]) - off(ta[label], ga[label]) + off(tb[label] + count, gb[label]) - off(tb[label], gb[label])
            ta[label] -= count
            tb[label] += count
        at[i] = b
        return (d + _LABEL_WEIGHT * e) / scale

    cost = (sum(map(off, sizes, size_goal)) + _LABEL_WEIGHT * sum(off(x, g) for t, goal in zip(tables, label_goal) for x, g in zip(t, goal))) / scale
    best, kept = cost, list(at)
    if n and k > 1:
        steps = LEAST_STEPS + STEPS_EACH * n  # n is bounded: a group's components, or the large ones
        heat, cool = 2.0 / scale, (0.01) ** (1 / steps)
        for _ in range(steps):
            i = chance.randrange(n)
            a = at[i]
            if chance.random() < 0.5:
                b = (a + 1 + chance.randrange(k - 1)) % k
                moved = [(i, a, b)]
            else:
                j = chance.randrange(n)
                b = at[j]
                if a == b:
                    continue
                moved = [(i, a, b), (j, b, a)]
            d = sum(shift(*m) for m in moved)
            if d <= 0 or chance.random() < math.exp(-d / heat):
                cost += d
                if cost < best - 1e-12:
                    best, kept = cost, list(at)
            else:
                for m, x, y in reversed(moved):
                    shift(m, y, x)
            heat *= cool
    return best, kept


def _hashed(component: int, shares: list[float], seed: int) -> int:
    u = random.Random(f"{seed}:{component}").random() * sum(shares)
    for s, share in enumerate(shares):
        u -= share
        if u < 0:
            return s
    return len(shares) - 1


def assigned(records: DataFrame, targets: DataFrame, seed: int = 0, labels: int = LABELS) -> DataFrame:
    """row_ix, component, new_split: one row per record, each component in one split, sizes and labels near the targets' shares.

    Labels are the values of `selection_reason`; beyond the `labels` commonest they share `RARE_GROUPS` goals by hash, so the
    shares of rarer ones are kept in groups. An empty table gives no rows.
    """
    spark = records.sparkSession
    rows = cut(with_components(records))
    goal = [(r["split"], float(r["target_share"] or 0)) for r in targets.filter("split IS NOT NULL").orderBy("split").collect()]
    names, shares = [s for s, _ in goal], [w / sum(w for _, w in goal) for _, w in goal]
    k = len(names)
    common = {r["label"]: (i, r["n"]) for i, r in enumerate(rows.groupBy(F.coalesce("label", F.lit("")).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(labels).collect())}
    total = rows.count()
    other, width = len(common), len(common) + RARE_GROUPS
    in_label = [n for _, n in sorted(common.values())]
    ids = spark.createDataFrame([(label, i) for label, (i, _) in common.items()], "label string, label_no int")
    counted = rows.select("component", F.coalesce("label", F.lit("")).alias("label")).join(F.broadcast(ids), "label", "left")
    rare = F.lit(other) + F.pmod(F.xxhash64("label"), F.lit(RARE_GROUPS)).cast("int")
    counted = counted.withColumn("label_no", F.coalesce("label_no", rare))
    rarer = {r["label_no"]: r["n"] for r in counted.filter(F.col("label_no") >= other).groupBy("label_no").agg(F.count("*").alias("n")).collect()}  # at most RARE_GROUPS
    in_label += [rarer.get(i, 0) for i in range(other, other + RARE_GROUPS)]
    counted = counted.groupBy("component", "label_no").agg(F.count("*").alias("n"))
    parts = counted.groupBy("component").agg(F.sum("n").alias("size"), F.collect_list(F.struct("label_no", "n")).alias("labels"))  # at most labels + RARE_GROUPS a component
    parts = cut(parts)
    # Fewer than LARGE components can hold more than 1/LARGE of all records each.
    bound = max(total // LARGE, 20)
    large = parts.filter(F.col("size") > bound).orderBy("component").collect()
    size_goal, label_goal = [total * w for w in shares], [[x * w for x in in_label] for w in shares]
    big = [(r["size"], [(x["label_no"], x["n"]) for x in r["labels"]]) for r in large]
    placed: list[int] = []
    if big:
        tries = [anneal(big, [_hashed(r["component"], shares, t) for r in large], size_goal, label_goal, t, over_only=True) for t in range(seed, seed + STARTS)]
        placed = min(tries, key=lambda x: x[0])[1]
    left_size = [max(0.0, size_goal[s] - sum(b[0] for b, p in zip(big, placed) if p == s)) for s in range(k)]
    left_label = [[max(0.0, x - sum(c for b, p in zip(big, placed) if p == s for label, c in b[1] if label == i)) for i, x in enumerate(label_goal[s])] for s in range(k)]
    left = sum(left_size) or 1.0
    size_shares = [x / left for x in left_size] if sum(left_size) else shares
    column = [sum(t[i] for t in left_label) for i in range(len(in_label))]
    label_shares = [[t[i] / column[i] if column[i] else size_shares[s] for i in range(len(in_label))] for s, t in enumerate(left_label)]
    small = parts.filter(F.col("size") <= bound)
    groups = max(1, math.ceil(small.count() / GROUP))

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("component")
        start = int(frame["start"].iloc[0])
        own = [(int(n), [(int(x["label_no"]), int(x["n"])) for x in labels]) for n, labels in zip(frame["size"], frame["labels"])]
        size = sum(n for n, _ in own)
        table = [0] * width
        for _, labels in own:
            for label, n in labels:
                table[label] += n
        cost, at = anneal(
            own, [_hashed(int(c), size_shares, start) for c in frame["component"]], [size * w for w in size_shares], [[x * w for x, w in zip(table, ws)] for ws in label_shares], start
        )
        return pd.DataFrame({"component": frame["component"], "part": at, "part_group": frame["part_group"], "start": start, "cost": cost})

    begun = small.withColumn("part_group", F.pmod(F.xxhash64("component"), F.lit(groups)).cast("int")).withColumn("start", F.explode(F.sequence(F.lit(seed), F.lit(seed + STARTS - 1))))
    tried = cut(begun.groupBy("part_group", "start").applyInPandas(settle, "component long, part int, part_group int, start int, cost double"))
    won = tried.groupBy("part_group").agg(F.min_by("start", F.struct("cost", "start")).alias("start"))
    chosen = tried.join(won, ["part_group", "start"]).select("component", "part")
    chosen = chosen.unionByName(spark.createDataFrame([(r["component"], p) for r, p in zip(large, placed)], "component long, part int"))
    split = F.element_at(F.array(*map(F.lit, names)), F.col("part") + 1) if names else F.lit(None).cast("string")
    return lookup(rows.select("row_ix", "component"), chosen, "component").select("row_ix", "component", split.alias("new_split"))


def report(records: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Per split: target_share, records, components, actual_share, most_label_gap (the largest difference of a label's share in the split from its share overall)."""
    rows = cut(assigned(records, targets, seed))
    labels = records.select("row_ix", F.coalesce(_plain("selection_reason"), F.lit("")).alias("label"))
    sizes = rows.groupBy(F.col("new_split").alias("split")).agg(F.count("*").alias("records"), F.count_distinct("component").alias("components"))
    all_rows = rows.agg(F.count("*").alias("all_records"))
    overall = labels.groupBy("label").agg(F.count("*").alias("n_label"))
    inside = rows.join(labels, "row_ix").groupBy(F.col("new_split").alias("split"), "label").agg(F.count("*").alias("n"))
    grid = targets.select("split").crossJoin(F.broadcast(overall)).join(inside, ["split", "label"], "left").join(sizes, "split").crossJoin(F.broadcast(all_rows))
    gaps = grid.groupBy("split").agg(F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("records") - F.col("n_label") / F.col("all_records"))).alias("most_label_gap"))
    out = targets.select("split", "target_share").join(sizes, "split", "left").join(gaps, "split", "left").crossJoin(F.broadcast(all_rows))
    return out.select("split", "target_share", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("components", F.lit(0)).alias("components"), (F.coalesce("records", F.lit(0)) / F.col("all_records")).alias("actual_share"), "most_label_gap")
