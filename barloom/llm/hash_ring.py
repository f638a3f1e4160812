"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``virtual_nodes`` points of a ring of 2**62 positions; a key
belongs to the first point at or after the key's hash. A shard takes its own
keys, in ring order, up to its capacity. Keys beyond that continue clockwise
to the next points whose shards have room.

All keys of one arc (the positions that one point owns) are alike to this
rule, so it is settled on the number of keys of each arc: a fixed number of
counts, whatever the size of the data. Each key then finds its shard by its
rank in its arc.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict

from pyspark.sql import DataFrame, Window, functions as F

from barloom.llm.lookup import points_below

RING_BITS = 62
CELLS = 32


def ring_points(shards: int, virtual_nodes: int, seed: int = 0) -> list[tuple[int, int]]:
    """The ring's ``(position, shard)`` in clockwise order."""
    points = {}
    for shard in range(shards):
        for v in range(virtual_nodes):
            name = f"{seed}/{shard}/{v}".encode()
            at = (zlib.crc32(name) << 30 | zlib.crc32(name + b"#") >> 2) % (1 << RING_BITS)
            while at in points:
                at = (at + 1) % (1 << RING_BITS)
            points[at] = shard
    return sorted(points.items())


def place_counts(owners: list[int], counts: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Where the keys of each arc go: ``(arc, first rank, end rank, shard, first slot)``.

    ``owners`` and ``counts`` give the shard and the number of keys of each
    arc. A shard with spare room takes the keys that flow past in the order
    in which they overflowed. Capacities must hold all keys.
    """
    if sum(capacity) < sum(counts):
        raise ValueError("the capacities are below the number of keys")
    room, filled, flows, waiting = list(capacity), [0] * len(capacity), [], []

    def put(arc: int, lo: int, hi: int, shard: int) -> None:
        flows.append((arc, lo, hi, shard, filled[shard]))
        filled[shard] += hi - lo
        room[shard] -= hi - lo

    over = [0] * len(owners)
    for arc, (shard, n) in enumerate(zip(owners, counts, strict=True)):
        taken = min(n, room[shard])
        over[arc] = taken
        if taken:
            put(arc, 0, taken, shard)
    for lap in range(2):
        for arc, shard in enumerate(owners):
            if lap == 0 and over[arc] < counts[arc]:
                waiting.append((arc, over[arc], counts[arc]))
            while waiting and room[shard]:
                source, lo, hi = waiting.pop(0)
                end = min(hi, lo + room[shard])
                put(source, lo, end, shard)
                if end < hi:
                    waiting.insert(0, (source, end, hi))
    return flows


def even_capacity(total: int, shards: int) -> list[int]:
    """Room for ``total`` keys, at most one apart."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def assign_shards(
    rows: DataFrame,
    shards: int,
    key: str = "doc_id",
    virtual_nodes: int = 64,
    slack: float | None = None,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """``rows`` with the columns ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``slack`` None bounds every shard at the mean, so that counts are at most
    one apart; otherwise a shard holds up to ceil((1 + slack) * mean) rows and
    fewer keys move when the number of shards changes. Null keys are keys like
    any other; rows with the same key rank by the columns ``order``. An empty
    table stays empty. Columns named ``shard`` or ``slot`` are replaced; all
    others keep their values, whatever their names.

    Ranks are taken in ``CELLS`` parts of each arc, dealt by a second hash of
    the key and of ``order``, so that a repeated key does not meet in one task
    unless its rows are equal in all of these columns.
    """
    points = ring_points(shards, virtual_nodes)
    owners = [s for _, s in points]
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    # the caller's columns have numbers meanwhile, so that none of their names clashes
    held = rows.select(*(rows[c].alias(f"c{i}") for i, c in enumerate(kept)))
    of = {c: f"c{i}" for i, c in enumerate(kept)}
    ranked_by = [of[key], *(of[c] for c in order)]
    position = F.shiftrightunsigned(F.xxhash64(F.lit("ring"), of[key]), 64 - RING_BITS)
    cell = F.pmod(F.xxhash64(F.lit("cell"), *ranked_by), F.lit(CELLS)).cast("int")
    base = held.withColumns({"_at": position, "_cell": cell})
    # the first point at or after the position; beyond the last one the ring starts again
    arc = points_below(F.col("_at"), [p for p, _ in points], closed=False)
    base = base.withColumn("_arc", F.pmod(arc, F.lit(len(points))))

    seen = defaultdict(dict)
    for r in base.groupBy("_arc", "_cell").count().collect():  # at most points x CELLS rows
        seen[r["_arc"]][r["_cell"]] = r["count"]
    counts = [sum(seen[a].values()) for a in range(len(points))]
    total = sum(counts)
    bound = even_capacity(total, shards) if slack is None else [-int(-(1 + slack) * total // shards)] * shards
    before = defaultdict(dict)
    for a, cells in seen.items():
        n = 0
        for c in sorted(cells):
            before[a][c] = n
            n += cells[c]
    # for each cell of each arc the few ranges of its ranks: points x CELLS short lists, whatever the data's size
    pieces: list[list[list[int]]] = [[] for _ in range(len(points) * CELLS)]
    for a, lo, hi, shard, slot in place_counts(owners, counts, bound):
        for c, n in before[a].items():
            first, end = max(lo, n), min(hi, n + seen[a][c])
            if first < end:
                pieces[a * CELLS + c].append([first - n, end - n, shard, slot + first - lo])
    plan = F.from_json(F.lit(json.dumps(pieces)), "array<array<array<bigint>>>")
    w = Window.partitionBy("_arc", "_cell").orderBy("_at", *ranked_by)
    rank = F.row_number().over(w).cast("long") - 1
    ranked = base.withColumn("_rank", rank)
    mine = F.get(plan, F.col("_arc") * CELLS + F.col("_cell"))
    piece = F.get(F.filter(mine, lambda p: (F.col("_rank") >= p[0]) & (F.col("_rank") < p[1])), F.lit(0))
    placed = ranked.withColumn("_piece", piece)
    return placed.select(
        *(F.col(of[c]).alias(c) for c in kept), F.col("_piece")[2].cast("int").alias("shard"), (F.col("_piece")[3] + F.col("_rank") - F.col("_piece")[0]).alias("slot")
    )
