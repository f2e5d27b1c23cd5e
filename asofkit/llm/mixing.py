"""A mix of sources by target shares of its size in tokens, interleaved by Pfair scheduling.

Each distinct text of a source may be used `max_repeats` times. A source's tokens are laid end to end, pass after pass, each
pass in its own hashed order, and are cut into blocks. With weight w, block k of a source is released in slot floor((k-1)/w)
and due by slot ceil(k/w); the earliest deadline goes first, so that at any time each source is within one block of its share.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.tokens import encoded
from asofkit.operators.totals import running_total
from asofkit.session import cut

SLOTS = 4096


def fill(wanted: dict[str, float], supply: dict[str, int], total: float) -> dict[str, float]:
    """Tokens to take of each source: its target as far as its supply goes; what is short is spread over the others by their targets."""
    take = {s: 0.0 for s in wanted}
    open_, left = {s for s in wanted if wanted[s] > 0 and supply.get(s, 0) > 0}, float(total)
    while open_ and left > 0.5:
        weight = sum(wanted[s] for s in open_)
        full = {s for s in open_ if take[s] + left * wanted[s] / weight >= supply[s]}
        if not full:
            for s in open_:
                take[s] += left * wanted[s] / weight
            break
        for s in full:
            left -= supply[s] - take[s]
            take[s] = float(supply[s])
        open_ -= full
    return take


def schedule(weights: dict[str, float], slots: int = SLOTS) -> list[tuple[str, int, int]]:
    """(source, block, slot), blocks and slots from 0; weights sum to 1. Slots stay free only where no block is released."""
    live = {s: w for s, w in weights.items() if w > 0}
    if not live:
        return []
    slots = max(slots, math.ceil(1 / min(live.values())))
    out, ready, waiting = [], [], []
    for s, w in live.items():
        heapq.heappush(waiting, (0, s, 0))
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (math.ceil((k + 1) / live[s] - 1e-9), s, k))
        if ready:
            _, s, k = heapq.heappop(ready)
            out.append((s, k, slot))
            heapq.heappush(waiting, (math.floor((k + 1) / live[s] + 1e-9), s, k + 1))
    return out


def source_texts(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens) of each distinct text of each target's source, by its least doc_id. Null, empty texts and sources are left out."""
    named = documents.filter("source IS NOT NULL AND text IS NOT NULL AND text <> ''").join(targets.select("source").distinct(), "source", "left_semi")
    counted = encoded(named.withColumn("digest", F.md5("text")), ["doc_id", "source", "digest"], "text", lengths=True)
    return counted.groupBy("source", "digest").agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens")).select("source", "doc_id", "n_tokens")


def plan(texts: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry per target: source, tokens wanted, supplied (with repeats), taken, short. The driver sees sums by source only."""
    sums = {r["source"]: (r["n"], r["texts"]) for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("texts")).collect()}
    rows = {r["source"]: r for r in targets.filter("source IS NOT NULL").collect()}
    wanted = {s: (r["target_share"] or 0.0) * (r["total_tokens"] or 0) for s, r in rows.items()}
    supply = {s: sums.get(s, (0, 0))[0] * max(r["max_repeats"] or 0, 0) for s, r in rows.items()}
    take = fill(wanted, supply, sum(wanted.values()))
    return [
        {"source": s, "target_share": r["target_share"], "max_repeats": r["max_repeats"], "wanted": wanted[s], "tokens": sums.get(s, (0, 0))[0], "texts": sums.get(s, (0, 0))[1], "supply": supply[s], "take": take[s], "short": supply[s] < wanted[s]}
        for s, r in sorted(rows.items())
    ]


def runs_dry(parts: list[dict], slots: int = SLOTS) -> set[str]:
    """The sources whose supply may not last for the blocks that the Pfair schedule of the target weights gives them, to within the one block by which it deviates."""
    total = sum(x["wanted"] for x in parts)
    plan_ = schedule({x["source"]: x["wanted"] / total for x in parts}, slots) if total else []
    given = {s: k + 1 for s, k, _ in sorted(plan_, key=lambda x: x[1])}
    return {x["source"] for x in parts if x["wanted"] > 0 and (given.get(x["source"], 0) + 1) * total / len(plan_) > x["supply"]}


def short_sources(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """source of each target that can't be filled, however often its texts may be repeated: it runs dry before its last scheduled block ends."""
    parts = plan(source_texts(documents, targets), targets)
    dry = runs_dry(parts)
    found = [(x["source"],) for x in parts if x["source"] in dry and x["short"]]
    return documents.sparkSession.createDataFrame(found, "source string")


def mixed(documents: DataFrame, targets: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The mix: source, doc_id, pass_no, slot, offset (tokens of the source before it), n_tokens; read by (slot, source, offset).

    A text is used once a pass, in at most max_repeats passes; the last text of a source may end past its quota. Sources
    without texts or targets contribute nothing; an empty corpus gives an empty mix.
    """
    spark = documents.sparkSession
    texts = cut(source_texts(documents, targets))
    parts = [x for x in plan(texts, targets) if x["take"] > 0 and x["tokens"] > 0]
    total = sum(x["take"] for x in parts)
    blocks = schedule({x["source"]: x["take"] / total for x in parts}, slots)
    count = {x["source"]: sum(1 for s, _, _ in blocks if s == x["source"]) for x in parts}
    quota = spark.createDataFrame(
        [(x["source"], float(x["take"]), int(x["tokens"]), math.ceil(x["take"] / x["tokens"] - 1e-9), x["take"] / count[x["source"]]) for x in parts],
        "source string, take double, pass_tokens long, passes int, block double",
    )
    timed = spark.createDataFrame(blocks, "source string, block_no int, slot int")
    # One row per target and per slot: both sizes are fixed by the targets.
    laid = texts.join(F.broadcast(quota), "source").withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("passes") - 1)))
    placed = running_total(laid, ["source", "pass_no"], F.xxhash64("pass_no", "doc_id"), F.col("n_tokens"), name="within")
    placed = placed.withColumn("offset", F.col("pass_no") * F.col("pass_tokens") + F.col("within")).filter("offset < take")
    placed = placed.withColumn("block_no", F.floor(F.col("offset") / F.col("block")).cast("int"))
    return placed.join(F.broadcast(timed), ["source", "block_no"]).select("source", "doc_id", "pass_no", "slot", "offset", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: source, target_share, max_repeats, available_tokens, used_tokens, most_uses, actual_share, filled."""
    used = mixed(documents, targets).groupBy("source").agg(F.sum("n_tokens").alias("used_tokens"), (F.max("pass_no") + 1).alias("most_uses"))
    texts = source_texts(documents, targets).groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    all_used = used.agg(F.sum("used_tokens").alias("all_used"))
    out = targets.select("source", "target_share", "max_repeats", "total_tokens").join(texts, "source", "left").join(used, "source", "left").crossJoin(F.broadcast(all_used))
    have = F.coalesce("available_tokens", F.lit(0))
    return out.select(
        "source", "target_share", "max_repeats", have.cast("long").alias("available_tokens"), F.coalesce("used_tokens", F.lit(0)).cast("long").alias("used_tokens"),
        F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"), (F.coalesce("used_tokens", F.lit(0)) / F.col("all_used")).alias("actual_share"),
        (have * F.col("max_repeats") >= F.col("target_share") * F.col("total_tokens")).alias("filled"),
    )
