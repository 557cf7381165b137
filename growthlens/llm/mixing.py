"""Mixing sources to target weights by Pfair scheduling: DataFrame functions only.

Every source is cut into blocks. Target weights are exact fractions: as whole numbers without a common
divisor they are the shares a_s, which add up to H, and block i (from 1) of a source is released at slot
floor((i-1) H / a_s) and due at slot ceil(i H / a_s); each slot takes, of the released blocks, the one with the
earliest deadline. After any number of slots t of a phase a source is then less than one block away from
t a_s / H, its target weight itself. The schedule repeats after H slots, so at most one period per phase is
worked out, and a block's slot follows by arithmetic; a phase ends when a source has no block
left, and the others share its weight.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.timeline import row_numbers

#: Documents of a block, and least slots of a period.
BLOCK_DOCS, PERIOD = 8, 1000
#: Phase entries (one per source and phase) up to which the plan is broadcast.
MOST_BROADCAST = 10_000


def integer_shares(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Whole shares in the exact ratio of the weights, scaled to add up to ``period`` at least.

    A weight counts as the number that it is written as: 0.1 is a tenth.
    """
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    by = math.lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * by) for s, x in exact.items()}
    common = math.gcd(*whole.values())
    times = -(-period * common // sum(whole.values()))
    return {s: x // common * times for s, x in whole.items()}


def period_slots(share: dict[str, int], left: dict[str, int] | None = None) -> dict[str, list[int]]:
    """Slots (from 0) of every source's blocks within one period, earliest deadline first.

    With ``left``, the number of blocks of every source, it ends with the slot in which a source has none left.
    """
    period = sum(share.values())
    slots: dict[str, list[int]] = {s: [] for s in share}
    later, ready = [(0, s) for s in share], []
    heapq.heapify(later)
    for t in range(period):
        while later and later[0][0] <= t:
            s = heapq.heappop(later)[1]
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * period // share[s]), -share[s], s))
        s = heapq.heappop(ready)[2]
        slots[s].append(t)
        if left and len(slots[s]) == left[s]:
            break
        if len(slots[s]) < share[s]:
            heapq.heappush(later, (len(slots[s]) * period // share[s], s))
    return slots


def phases(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> list[dict]:
    """Phases of the schedule: slots before it, and per source shares, blocks before it and slots."""
    left, used = {s: n for s, n in blocks.items() if n > 0}, dict.fromkeys(blocks, 0)
    start, phase, out = 0, 0, []
    while left:
        share = integer_shares({s: weights[s] for s in left}, period)
        slots, h = period_slots(share, left), sum(share.values())
        # a source that ends within the period ends the phase; the others have no later slots then
        ends = [(n - 1) // share[s] * h + slots[s][(n - 1) % share[s]] + 1 for s, n in left.items() if (n - 1) % share[s] < len(slots[s])]
        length = min(ends)
        out += [{"source": s, "phase": phase, "start": start, "share": share[s], "period": h, "before": used[s], "slots": slots[s]} for s in left]
        for s in list(left):
            took = length // h * share[s] + sum(x < length % h for x in slots[s])
            used[s] += took
            left[s] -= took
            if left[s] <= 0:
                del left[s]
        start, phase = start + length, phase + 1
    return out


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, key: str = "doc_id", source: str = "source",
    block_docs: int = BLOCK_DOCS, period: int = PERIOD,
) -> DataFrame:
    """``docs`` plus ``block_no`` (in its source, from 1), ``slot`` (from 0) and ``in_block`` (from 1).

    Sorted by (slot, in_block) the rows stand in mixed order. Columns of ``docs`` with these three names give way to them. Within a source documents are
    ordered by a hash of their key. ``weights`` maps sources to target weights, which are kept exactly; without it all
    sources weigh the same, and a source not named weighs as much as the least one named. A NULL source is a
    source of its own. Every row is kept, repeated ones too, whatever its key. Only one number per
    source comes to the driver, which works out at most one period per phase (``period`` slots or the least
    common period of the weights, whichever is longer) and no more slots than there are blocks. A source with a third of all rows is numbered in 256 hash ranges.
    """
    spark = docs.sparkSession
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null")).alias("_s")
    rest = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if not t.startswith("map")]).alias("_r")
    # a document's columns travel as one, so that no name of theirs meets a working column
    rows = docs.select(F.struct("*").alias("_doc"), named, F.xxhash64(F.col(key)).alias("_m"), F.col(key).alias("_k"), rest)
    counts = {r["_s"]: r["n"] for r in rows.groupBy("_s").agg(F.count("*").alias("n")).toLocalIterator()}
    blocks = {s: -(-n // block_docs) for s, n in counts.items()}
    given = {("null" if s is None else f"={s}"): Fraction(str(w)) for s, w in (weights or {}).items() if w > 0}
    plan = phases(blocks, {s: given.get(s, min(given.values(), default=Fraction(1))) for s in blocks}, period)
    # the high bits of a hash are ordered ranges of equal size, so a large source is numbered in 256 parts
    numbered = row_numbers(rows, ["_s"], ["_m", "_k", "_r"], F.shiftright("_m", 56), "_i")
    numbered = numbered.withColumn("block_no", F.floor((F.col("_i") - 1) / block_docs) + 1)
    table = _plan_table(spark, plan)
    # one row per source; beyond so many phase entries the join shuffles and splits the large sources
    j = numbered.join(F.broadcast(table) if len(plan) <= MOST_BROADCAST else table, "_s")
    j = j.withColumn("_p", F.element_at(F.filter("_plan", lambda p: p["before"] < F.col("block_no")), -1))
    j = j.withColumn("_nth", F.col("block_no") - 1 - F.col("_p.before"))
    slot = F.col("_p.start") + F.floor(F.col("_nth") / F.col("_p.share")) * F.col("_p.period") + F.get(
        "_p.slots", F.pmod("_nth", F.col("_p.share")).cast("int")
    )
    own = [F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in ("block_no", "slot", "in_block")]
    return j.select(
        *own, F.col("block_no").cast("bigint"), slot.cast("bigint").alias("slot"),
        (F.pmod(F.col("_i") - 1, F.lit(block_docs)) + 1).cast("bigint").alias("in_block"),
    )


def _plan_table(spark: SparkSession, plan: list[dict]) -> DataFrame:
    """``_s, _plan``: the phases of every source in their order."""
    entry = "array<struct<source: string, phase: int, start: bigint, share: bigint, period: bigint, before: bigint, slots: array<bigint>>>"
    # numbers beyond this only say that the period does not end
    held = [p | {"share": min(p["share"], 1 << 62), "period": min(p["period"], 1 << 62)} for p in plan]
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(held)), entry)).alias("p")).select("p.*")
    packed = F.array_sort(F.collect_list(F.struct("phase", "start", "share", "period", "before", "slots")))
    return rows.groupBy(F.col("source").alias("_s")).agg(packed.alias("_plan"))
