"""Mixing sources to target weights by fitting budgets of whole documents.

Targets share a budget by weight, filled up to a limit of passes over each
source. A source is taken in whole passes first. What remains of its target
is met by a subset of its documents: counted by exact length, a share of
every length is taken in proportion, and a bounded-knapsack dynamic program
over the leftover counts closes the rest to the nearest reachable sum. Which
documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.rows import keyed_rows
from barloom.llm.scratch import keep, settled

WEIGHTS = (5.0, 2.0, 1.0)
CELLS = 4096
#: The dynamic program covers sums up to this many words.
REACH = 1 << 15


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, max_passes: float) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row for each source.

    Sources in code point order, null last, take the weights in turn. The
    targets are the level at which weight times level, limited to
    ``max_passes`` times the source's size, uses ``share`` of all sizes.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.row_number().over(everything) - 1) % len(weights))
    table = totals.withColumn("weight", turn).withColumn("limit", F.col("source_size") * F.lit(float(max_passes)))
    table = table.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    past, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    level = (budget - F.coalesce(F.sum("limit").over(past), F.lit(0.0))) / F.sum("weight").over(rest)
    table = table.withColumn("level", level).withColumn("full", F.col("level") >= F.col("ratio"))
    open_level = F.min(F.when(~F.col("full"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * open_level)
    return table.select("source", "source_size", target.alias("target"))


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that lengths add up to ``budget``, or nearly.

    The sum never exceeds the budget and falls short of it only where no
    subset of the leftovers reaches it.
    """
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return counts.astype(np.int64).copy()
    ahead = budget - REACH // 2 if budget > REACH else 0  # the program keeps a choice of sums
    for i, n in enumerate(counts):
        taken[i] = int(n) * ahead // total
    left = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        size, spare = int(lengths[i]), int(counts[i] - taken[i])
        if left <= REACH:
            break
        if size and spare:
            n = min(spare, (left - REACH // 2) // size)
            if n > 0:
                taken[i] += n
                left -= n * size
    if left > REACH:
        # whatever is left over is longer than half of this: at most one document fits, and none after it
        fits = np.flatnonzero((lengths <= left) & (counts > taken) & (lengths > 0))
        if len(fits):
            taken[fits[lengths[fits].argmax()]] += 1
        return taken
    return taken + _knapsack(lengths, counts - taken, left)


def _knapsack(lengths: np.ndarray, spare: np.ndarray, budget: int) -> np.ndarray:
    """Bounded knapsack: the subset with the largest sum up to ``budget``."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    first, items, mask = np.full(budget + 1, -1, dtype=np.int64), [], (1 << (budget + 1)) - 1
    reached = 1
    for i in range(len(lengths)):
        size, n, power = int(lengths[i]), int(spare[i]), 1
        if not 0 < size <= budget:
            continue
        n = min(n, budget // size)
        while n > 0:
            use = min(power, n)
            fresh = (reached << (size * use)) & mask & ~reached
            if fresh:
                raw = np.frombuffer(fresh.to_bytes((budget + 8) // 8, "little"), dtype=np.uint8)
                first[np.flatnonzero(np.unpackbits(raw, bitorder="little")[: budget + 1])] = len(items)
                reached |= fresh
            items.append((i, use))
            n -= use
            power *= 2
        if reached >> budget & 1:
            break
    at = reached.bit_length() - 1
    while at > 0:
        i, use = items[first[at]]
        taken[i] += use
        at -= use * int(lengths[i])
    return taken


def _fit_source(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frame = pd.concat(list(frames)).sort_values("size", kind="stable")
    sizes, counts = frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    total, target = int(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    passes = int(target // total) if total else 0
    extra = fit_counts(sizes, counts, round(target - passes * total))
    yield pd.DataFrame({"source": frame["source"], "size": sizes, "passes": passes, "extra": extra})


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    max_passes: float = 2.0,
    seed: int = 11,
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` for every row of ``docs``.

    ``copies`` is how often the mix holds the row and ``taken`` the words of
    those copies. Null and empty texts have size 0 and bring no words; they
    get the whole passes of their source. A null source is a source. Repeated
    rows are rows of their own. No copies exceed ceil(max_passes).

    The program for a source sees one row for each length, so its group is as
    small as a hot source's number of lengths. Documents of one length are
    split into ``CELLS`` hash cells: cells before the cut are taken whole and
    only the cell at the cut is ranked.
    """
    rows = docs.select(F.col("doc_id").alias("key"), "doc_id", "source", F.col(text_col).alias("text"))
    return _mix(rows, weights, share, max_passes, seed).drop("key")


def _mix(texts: DataFrame, weights: tuple[float, ...], share: float, max_passes: float, seed: int) -> DataFrame:
    """``mix_sources`` of ``texts(key, doc_id, source, text)`` with ``key``, by which rows of one id and length rank."""
    sized = keep(texts.select("key", "doc_id", "source", word_count(F.col("text")).alias("size")))
    by_length = keep(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    totals = by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = keep(source_targets(totals, weights, share, max_passes))
    plan = by_length.join(targets, by_length["source"].eqNullSafe(targets["source"])).select(
        by_length["source"], "size", "n", "source_size", "target"
    )
    fit = plan.groupBy("source").applyInPandas(_fit_source, "source string, size long, passes long, extra long")
    # null as a key of equi-joins: a flag beside the name
    named = lambda df: df.withColumns({"_null": F.col("source").isNull(), "source": F.coalesce("source", F.lit(""))})
    key = ["_null", "source", "size"]
    cell = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.lit(CELLS))
    rows = named(sized).withColumns({"_cell": cell, "_order": F.xxhash64(F.lit(seed + 1), "doc_id")})
    cells = rows.groupBy(*key, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cut = cells.join(named(fit), key).join(
        named(targets), ["_null", "source"]
    ).withColumn("_room", F.col("extra") - F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cut = keep(cut.select(*key, "_cell", "_room", "passes", "source_size", "target"))
    rank = F.row_number().over(Window.partitionBy(*key, "_cell").orderBy("_order", "key"))
    joined = rows.withColumn("_rank", rank).join(cut, [*key, "_cell"])
    copies = F.col("passes") + (F.col("_rank") <= F.col("_room")).cast("long")
    return joined.select(
        "key", "doc_id", F.when(~F.col("_null"), F.col("source")).alias("source"), "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_passes: float = 2.0, seed: int = 11, text_col: str = "text"
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, its columns unchanged, whatever their names.

    Rows are told apart even if they share an id or have none, so the mix has
    the words that ``mix_sources`` reports.
    """
    rows = keyed_rows(docs).rows
    texts = rows.select("key", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), F.col(f"row.{text_col}").alias("text"))
    taken = settled(lambda: _mix(texts, weights, share, max_passes, seed).where("copies > 0").select("key", F.col("copies").cast("int")))
    times = taken.select("key", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    # the same join at every size
    return rows.join(times.drop("copy").hint("merge"), "key").select("row.*")
