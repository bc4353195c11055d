"""Mixing sources to target weights by Pfair scheduling.

Rows of a source are put into a reproducible random order and cut into blocks.
Weights are whole shares: a source with share ``a`` of ``Q`` has for its block
``k`` the release time floor(k Q / a) and the deadline ceil((k + 1) Q / a), and
each slot goes to the released block with the earliest deadline.  All windows are
met, so at any slot a source is less than one block off its target.  The
schedule repeats after Q slots, so only one period is ever computed; where a
source runs out, the rest goes on with the shares of those left."""

from __future__ import annotations

import heapq
from bisect import bisect_left
from math import ceil, gcd, isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD = 1024  # slots of a period, about, where shares come from sizes; more if a source would have fewer than LEAST
LEAST = 8  # slots of the smallest source, so that rounding is at most 1 in 16 of a share
LONGEST = 1_000_000  # slots of a period at most: a given set of weights beyond it (reduced) is refused, default shares are rounded to it
PLACES = 10_000_000  # of all phases' periods, that the plan holds at most; sources beyond that are refused
CELLS = 200_000  # cells whose first ranks are broadcast (some 10 MB); with more, rows are shuffled to them


def period(shares: list[int], left: list[int] | None = None) -> list[int]:
    """The source of each of the sum(shares) slots, by earliest deadline first.
    Ties: the later release, then the earlier source.  With ``left`` it ends early,
    at the slot that takes the last of a source's blocks."""
    q = sum(shares)
    waiting = [(0, i, 0) for i, a in enumerate(shares) if a > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int]] = []
    out = []
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            r, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * q // shares[i]), -r, i, k))
        _, _, i, k = heapq.heappop(ready)
        out.append(i)
        if left is not None and k + 1 == left[i]:
            break
        if k + 1 < shares[i]:
            heapq.heappush(waiting, ((k + 1) * q // shares[i], i, k + 1))
    return out


def plan(blocks: list[int], shares: list[int]) -> list[tuple[int, int, int, int, list[list[int]], int]]:
    """Phases of a mix: (first slot, slots, period, phase number, places of each
    source in the period, and by source the blocks used before).  A phase ends
    with the last block of the first source to run out, so that the block that may
    be short is its last slot."""
    left, used, start, phases, held = list(blocks), [0] * len(blocks), 0, [], 0
    while any(left):
        live = [a if n else 0 for a, n in zip(shares, left, strict=True)]
        part = gcd(*live)
        live = [a // part for a in live]
        slots, q = period(live, left), sum(live)
        held += len(slots)
        if held > PLACES:
            raise ValueError("too many sources for one mix: put small ones together")
        places: list[list[int]] = [[] for _ in blocks]
        for t, i in enumerate(slots):
            places[i].append(t)
        if len(slots) < q:
            size = len(slots)
        else:
            size = min(((n - 1) // a) * q + places[i][(n - 1) % a] for i, (n, a) in enumerate(zip(left, live, strict=True)) if n) + 1
        took = [(size // q) * a + bisect_left(places[i], size % q) for i, a in enumerate(live)]
        phases.append((start, size, q, len(phases), places, list(used)))
        left = [n - k for n, k in zip(left, took, strict=True)]
        used = [u + k for u, k in zip(used, took, strict=True)]
        start += size
    return phases


def shares_by_size(sizes: list[int], temperature: float, slots: int = PERIOD) -> list[int]:
    """Whole shares in proportion to size ** temperature: of ``slots``, or of as many
    more as give the smallest source ``LEAST``, but of half ``LONGEST`` at most; a
    source has 1 at least."""
    w = [max(n, 1) ** temperature for n in sizes]
    total = sum(w)
    slots = min(max(slots, LEAST * total / min(w)), LONGEST // 2)
    return [max(1, round(slots * x / total)) for x in w]


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block: int = 64, temperature: float = 0.5, seed: int = 7) -> DataFrame:
    """All rows of ``docs(doc_id, source, ...)`` with their place in the mix.

    Adds mix_block (within the source), mix_slot (of the block in the mix),
    mix_position (of the row, from 0 without gaps), mix_phase.  ``weights`` are
    whole shares by source, 1 for sources that it doesn't name; without it shares
    follow the sources' row counts ** ``temperature``.  The rows of a slot follow
    each other.  Shares that, reduced, add up to more than ``LONGEST`` are an error
    at any size of the table.

    A null source is a source of its own.  Nothing is dropped or repeated: rows
    that repeat others have places of their own, interchangeable among equals.
    Null ids come first within their source's order.  Columns of the names above
    are replaced, all others kept, whatever their names.  An empty table gives an
    empty table."""
    spark = docs.sparkSession
    added = {"mix_block", "mix_slot", "mix_position", "mix_phase"}
    cols = [c for c in docs.columns if c not in added]
    d = docs.select(F.struct(*[docs[c] for c in cols]).alias("row"), docs["source"].cast("string").alias("__s"), docs["doc_id"].alias("__id"))
    # The random order is spread over cells of even size, so that no source is one task's.
    d = d.withColumn("__h", F.xxhash64(F.lit(seed), F.coalesce(F.col("__id").cast("string"), F.lit(""))))
    total = docs.select("source").groupBy("source").count().collect()
    if not total:
        none = docs.select(*cols)
        return none.selectExpr("*", "cast(null as long) mix_block", "cast(null as long) mix_slot", "cast(null as long) mix_position", "cast(null as int) mix_phase")
    sizes: dict[str | None, int] = {}
    for r in total:
        key = None if r["source"] is None else str(r["source"])
        sizes[key] = sizes.get(key, 0) + r["count"]
    names = sorted(sizes, key=lambda x: (x is not None, x or ""))
    many = {s: ceil(n / max(1024, isqrt(n))) for s, n in sizes.items()}
    number = F.create_map(*[F.lit(x) for s in names if s is not None for x in (s, many[s])] or [F.lit(""), F.lit(1)])
    lone = many.get(None, 1)
    cells = F.when(F.col("__s").isNull(), F.lit(lone)).otherwise(F.try_element_at(number, "__s"))
    d = d.withColumn("__c", F.floor((F.shiftrightunsigned("__h", 1) / F.lit(float(2**63))) * cells).cast("long"))
    per = d.groupBy("__s", "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = per.withColumn("__before", F.sum("__n").over(Window.partitionBy("__s").orderBy("__c")) - F.col("__n")).drop("__n")
    at = F.row_number().over(Window.partitionBy("__s", "__c").orderBy("__h", "__id")) - 1
    d = d.withColumn("__at", at)
    before = before.select(F.col("__s").alias("__s2"), F.col("__c").alias("__c2"), "__before")
    if sum(many.values()) <= CELLS:
        before = F.broadcast(before)
    d = d.join(before, d["__s"].eqNullSafe(before["__s2"]) & (d["__c"] == before["__c2"])).withColumn("__rank", F.col("__before") + F.col("__at"))
    d = d.withColumn("mix_block", F.floor(F.col("__rank") / block).cast("long")).withColumn("__in", F.col("__rank") % block)
    share = shares_by_size([sizes[s] for s in names], temperature) if weights is None else [int(weights.get(s, 1)) for s in names]
    if min(share) < 1:
        raise ValueError("a share must be 1 at least; leave sources out before mixing")
    if sum(share) // gcd(*share) > LONGEST:
        raise ValueError(f"the shares add up to more than {LONGEST}; round them")
    blocks = [-(-sizes[s] // block) for s in names]
    phases = plan(blocks, share)
    rows, gap = [], 0  # gap: rows by which the last blocks of former phases are short
    for start, size, q, number, places, used in phases:
        lost = 0
        for i, p in enumerate(places):
            if p:
                took = (size // q) * len(p) + bisect_left(p, size % q)
                rows.append((names[i], number, used[i], used[i] + took, start, q, gap, p))
                if used[i] + took == blocks[i]:
                    lost += blocks[i] * block - sizes[names[i]]
        gap += lost
    # A row for each source and phase, with the places in a period: bounded by ``PLACES``.
    table = spark.createDataFrame(rows, "s string, mix_phase int, lo long, hi long, start long, q long, gap long, places array<int>")
    on = d["__s"].eqNullSafe(table["s"]) & (d["mix_block"] >= table["lo"]) & (d["mix_block"] < table["hi"])
    d = d.join(F.broadcast(table), on)
    k = F.col("mix_block") - F.col("lo")
    a = F.size("places")
    slot = F.col("start") + F.floor(k / a) * F.col("q") + F.element_at("places", (k % a + 1).cast("int"))
    d = d.withColumn("mix_slot", slot.cast("long"))
    d = d.withColumn("mix_position", (F.col("mix_slot") * block + F.col("__in") - F.col("gap")).cast("long"))
    return d.select("row.*", "mix_block", "mix_slot", "mix_position", "mix_phase")
