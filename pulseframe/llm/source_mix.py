"""Mixing of sources to target weights by proportionate-fair scheduling.

Each source's rows are cut into blocks of equal size. A source of weight w may release its block i no earlier than slot floor(i / w) and
must have placed it by slot ceil((i + 1) / w). In each slot the released block of the earliest deadline is placed. Since the weights sum to
1, all deadlines are met, and after any number t of slots a source of weight w has placed more than w * t - 1 and fewer than w * t + 1 blocks.

Weights are rounded to multiples of 1 / `grid` (largest remainders; every source with rows gets one multiple at least). The default
grid is so fine that a billion blocks deviate by less than a hundredth of a block more from the exact targets. A schedule repeats after `grid`
slots; with a coarse grid one period is scheduled, with a fine one the slots until the first source has no block left. Then the
rest of all sources is mixed anew, with the weights of the sources that still have blocks. There are at most as many such phases as
sources. The driver schedules blocks, not rows: 8 bytes and some microseconds each.

Nothing is dropped or repeated: the order changes, and the share of a source holds for as long as it has rows. A null source is a source of
its own. Sources without a target weight get the least target weight; without targets, weights follow the `power` of the number
of rows. Rows are numbered inside a source by a hash of id and text over bounded buckets, so that no task sorts a whole source; equal
rows are numbered one after the other. An empty table gives an empty result.

A caller who sets a coarse grid may have at most `grid` sources, as many as a period has slots; more raise an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulseframe.llm.frames import checkpointed


#: Rows of the table of buckets that may be broadcast: 40 bytes each, so 4 MB at most.
_BROADCAST_BUCKETS = 100_000
#: Blocks of a row of the schedule, and blocks of a schedule that may be broadcast: 8 bytes each, so 4 MB at most.
_SEGMENT = 1_024
_BROADCAST_BLOCKS = 500_000


@dataclass(frozen=True)
class MixSettings:
    block: int = 32
    grid: int = 2**40
    power: float = 0.5
    #: Rows that are numbered together by one sort.
    bucket: int = 4_096


def rounded_weights(targets: dict, grid: int) -> dict:
    """Whole numbers that sum to grid, one at least for each name, in proportion to the targets."""
    if len(targets) > grid:
        raise ValueError(f"{len(targets)} sources, but a period has {grid} slots")
    total = sum(map(Fraction, targets.values()))
    exact = {name: Fraction(value) / total * grid for name, value in targets.items()}
    out = {name: max(1, int(x)) for name, x in exact.items()}
    order = sorted(exact, key=lambda name: (-(exact[name] - int(exact[name])), str(name)))
    left = grid - sum(out.values())
    for name in order[: max(0, left)]:
        out[name] += 1
    while sum(out.values()) > grid:  # small sources were raised to 1: the largest give way
        out[max(out, key=lambda name: (out[name], str(name)))] -= 1
    return out


def scheduled(weights: dict) -> Iterator:
    """The source of each slot of one period: earliest deadline first among released blocks. Weights are whole numbers."""
    slots = sum(weights.values())
    order = sorted(weights, key=str)
    placed = [0] * len(order)
    waiting = [(0, k) for k in range(len(order))]  # (release, source) of sources whose next block isn't released
    ready: list[tuple[int, int]] = []  # (deadline, source) of the others
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            k = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(placed[k] + 1) * slots // weights[order[k]]), k))
        k = heapq.heappop(ready)[1]
        placed[k] += 1
        if placed[k] < weights[order[k]]:
            heapq.heappush(waiting, (placed[k] * slots // weights[order[k]], k))
        yield order[k]


def period(weights: dict) -> list:
    """All slots of scheduled(weights)."""
    return list(scheduled(weights))


def phases(blocks: dict, targets: dict, grid: int) -> list[dict]:
    """Phases of the schedule. Each has its first slot, the number of slots of a period and, by source, the first block, the number of
    blocks, the blocks of a period and their slots in it."""
    left, used, slot, out = {n: b for n, b in blocks.items() if b}, dict.fromkeys(blocks, 0), 0, []
    while left:
        weights = rounded_weights({n: targets[n] for n in left}, grid)
        rounds = min(left[n] // weights[n] for n in left)
        places: dict = {n: [] for n in left}
        if rounds:
            for t, name in enumerate(scheduled(weights)):
                places[name].append(t)
            taken, last = {n: rounds * weights[n] for n in left}, rounds * grid
        else:  # part of a period, until the first source has no block left
            for t, name in enumerate(scheduled(weights)):
                places[name].append(t)
                if len(places[name]) == left[name]:
                    break
            taken, last = {n: len(x) for n, x in places.items()}, t + 1
        out.append({"first_slot": slot, "slots": grid, "sources": {n: (used[n], taken[n], weights[n], places[n]) for n in left}})
        slot += last
        for n, k in taken.items():
            used[n] += k
            left[n] -= k
        left = {n: b for n, b in left.items() if b}
    return out


def _plan_rows(plan: list[dict]) -> Iterator[tuple]:
    """(source, segment, slots of its blocks) of each source, _SEGMENT blocks in each segment."""
    slots: dict = {}
    for p in plan:
        for name, (_, taken, weight, places) in p["sources"].items():
            slots.setdefault(name, []).extend(p["first_slot"] + i // weight * p["slots"] + places[i % weight] for i in range(taken))
    for name, of in slots.items():
        for k in range(0, len(of), _SEGMENT):
            yield name, k // _SEGMENT, of[k : k + _SEGMENT]


def _slots(rows: DataFrame, source: str, keys: list[str], targets: dict | None, settings: MixSettings) -> DataFrame:
    """rows with mix_block, mix_slot and mix_position. Column names of rows must not begin with mix_."""
    rows = rows.withColumn("mix_spread", F.xxhash64(keys[0]))
    buckets = max(1, -(-rows.count() // settings.bucket))
    rows = rows.withColumn("mix_bucket", F.pmod("mix_spread", F.lit(buckets)))
    counts = checkpointed(rows.groupBy(F.col(source).alias("mix_of"), F.col("mix_bucket").alias("mix_in")).agg(F.count(F.lit(1)).alias("n")))
    limit = min(settings.grid + 1, 2**31 - 1)
    sizes = {r.mix_of: r.n for r in counts.groupBy("mix_of").agg(F.sum("n").alias("n")).limit(limit).collect()}
    least = min(targets.values()) if targets else None
    wanted = {name: targets.get(name, least) if targets else n**settings.power for name, n in sizes.items()}
    blocks = {name: -(-n // settings.block) for name, n in sizes.items()}
    table = rows.sparkSession.createDataFrame(list(_plan_rows(phases(blocks, wanted, settings.grid))), "p_source string, p_segment long, p_slots array<long>")
    if sum(blocks.values()) <= _BROADCAST_BLOCKS:
        table = F.broadcast(table)

    # A row's number inside its source: the rows of lesser buckets, then its place in its own.
    lesser = F.sum("n").over(Window.partitionBy("mix_of").orderBy("mix_in").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("mix_of", "mix_in", F.coalesce(lesser, F.lit(0)).alias("mix_before"))
    if counts.count() <= _BROADCAST_BUCKETS:
        before = F.broadcast(before)
    inside = F.row_number().over(Window.partitionBy(source, "mix_bucket").orderBy("mix_spread", *keys))
    rows = rows.withColumn("mix_inside", inside - 1)
    rows = rows.join(before, F.col(source).eqNullSafe(F.col("mix_of")) & (F.col("mix_bucket") == F.col("mix_in")))
    rows = rows.withColumn("mix_number", F.col("mix_before") + F.col("mix_inside")).withColumn("mix_block", F.expr(f"mix_number div {settings.block}"))
    rows = rows.join(table, F.col(source).eqNullSafe(F.col("p_source")) & (F.expr(f"mix_block div {_SEGMENT}") == F.col("p_segment")))
    rows = rows.withColumn("mix_slot", F.get("p_slots", F.expr(f"mix_block % {_SEGMENT}").cast("int")))
    rows = rows.withColumn("mix_position", F.col("mix_slot") * settings.block + F.expr(f"mix_number % {settings.block}"))
    return rows.drop("mix_spread", "mix_bucket", "mix_inside", "mix_number", "mix_of", "mix_in", "mix_before", "p_source", "p_segment", "p_slots")


def mix_positions(docs: DataFrame, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """(doc_id, source, mix_block, mix_slot, mix_position) of each row. Block: of its source; slot: of the whole mix; position: a number
    by which all rows are in mixed order, without repeats (a source's last block may leave a gap)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("key"), F.col(source_col).cast("string").alias("source"))
    return _slots(rows, "source", ["key", "doc_id"], targets, settings).drop("key")


def numbered(docs: DataFrame, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """(mix_position, row) of each row of docs; the same rows get the same positions, in whatever order or files they lie."""
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Rows of one key that differ elsewhere keep an order of their own, so that a repeated task finds the same positions.
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select(F.xxhash64(id_col, text_col).alias("key"), whole, F.col(source_col).cast("string").alias("source"), kept)
    return _slots(rows, "source", ["key", "whole"], targets, settings).select("mix_position", "row")


def mixed(docs: DataFrame, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", settings: MixSettings = MixSettings()) -> DataFrame:
    """The rows and columns of docs in mixed order: partition after partition, and inside each partition. A written table need not be read
    in this order again; whoever reads it finds the positions by numbered()."""
    placed = numbered(docs, targets, id_col, text_col, source_col, settings)
    return placed.repartitionByRange("mix_position").sortWithinPartitions("mix_position").select("row.*")
