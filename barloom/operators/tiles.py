"""Moments of panels in tiles: blocks of days by blocks of symbols.

Windows that overlap share most of their rows. A run of windows is one chunk:
its rows are sent once, with the days before its first window's end as a halo,
and the moments of a window are sums over tiles, the days between two edges of
windows. Sums slide by two stacks, so nothing is ever subtracted and a value
that has left a window leaves no rounding behind. Where pairs of symbols are
wanted, symbols come in blocks, and a pair of blocks is a matrix product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

#: Symbols of a block: a pair of blocks is at most that number squared of pairs.
BLOCK = 128


def sliding_sums(windows: list[tuple[int, int]], tile: Callable[[int, int], np.ndarray]) -> Iterator[np.ndarray]:
    """For each window ``[lo, hi)`` the sum of ``tile(a, b)`` over the tiles it is made of; both ends must ascend.

    The tiles of a window stand in two stacks: behind, with their total, those
    that came last, and before, as sums from each to the last of them, the
    others. Whenever the second is empty, the first is turned over.
    """
    parts = list(pairwise(sorted({e for w in windows for e in w})))
    before: list[np.ndarray] = []
    behind: list[np.ndarray] = []
    total, head, tail = 0.0, 0, 0
    for lo, hi in windows:
        while tail < len(parts) and parts[tail][1] <= hi:
            behind.append(tile(*parts[tail]))
            total, tail = total + behind[-1], tail + 1
        while head < tail and parts[head][0] < lo:
            if not before:
                running = 0.0
                while behind:
                    running = running + behind.pop()
                    before.append(running)
                total = 0.0
            before.pop()
            head += 1
        yield (before[-1] if before else 0.0) + total


def window_chunks(rebalances: DataFrame, span: int) -> DataFrame:
    """``(chunk, rebalance, days)``: runs of ``span`` windows of ``rebalances(rebalance, days)``."""
    number = F.row_number().over(Window.orderBy("rebalance")) - 1
    return rebalances.select(F.floor(number / span).cast("int").alias("chunk"), "rebalance", "days")


def chunk_rows(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """``rows(ts, ...)`` with every chunk that has a window over their day, once each."""
    return rows.join(chunks.select("chunk", F.explode("days").alias("ts")).distinct(), "ts")


def window_ends(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk", "rebalance", F.array_min("days").alias("first"), F.array_max("days").alias("last"))


def fresh(rows: DataFrame) -> DataFrame:
    """The same rows under columns of their own, for a cogroup with rows they come from."""
    return rows.toDF(*rows.columns).select(*(F.col(c).alias(c) for c in rows.columns))


def wide(frame: pd.DataFrame, order: str, *values: str) -> tuple:
    """``(days, symbols, matrix ...)`` of long rows; what a row lacks is NaN."""
    days, row = np.unique(frame[order].to_numpy(), return_inverse=True)
    symbols, col = np.unique(frame["symbol"].to_numpy(), return_inverse=True)
    out = []
    for name in values:
        m = np.full((len(days), len(symbols)), np.nan)
        m[row, col] = frame[name].to_numpy(float)
        out.append(m)
    return days, symbols, *out


def ranges(days: np.ndarray, ends: pd.DataFrame) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """The windows in order, and each as positions among ``days``."""
    ends = ends.sort_values("last")
    return ends, list(zip(np.searchsorted(days, ends["first"].to_numpy()), np.searchsorted(days, ends["last"].to_numpy(), side="right"), strict=True))


def symbol_blocks(rows: DataFrame, size: int) -> DataFrame:
    """``(symbol, block, blocks)``: symbols in order, ``size`` to a block, and the number of blocks."""
    whole = Window.partitionBy()
    number = F.row_number().over(Window.orderBy("symbol")) - 1
    symbols = rows.select("symbol").distinct().withColumn("block", F.floor(number / size).cast("int"))
    return symbols.withColumn("blocks", F.max("block").over(whole) + 1)


def packed_blocks(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """``(key, block, blocks, days, symbols, data)``: ``rows(key, ts, symbol, value)`` as a matrix for each block of symbols."""
    placed = rows.select(key, "ts", "symbol", F.col(value).cast("double").alias("v")).join(symbol_blocks(rows, size), "symbol")
    kinds = {f.name: f.dataType.simpleString() for f in placed.schema.fields}

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        days, symbols, m = wide(frame, "ts", "v")
        first = {c: frame[c].iloc[:1].to_numpy() for c in (key, "block", "blocks")}
        return pd.DataFrame({**first, "days": [list(days)], "symbols": [list(symbols)], "data": [m.tobytes()]})

    return placed.groupBy(key, "block").applyInPandas(pack, f"{key} {kinds[key]}, block int, blocks int, days array<{kinds['ts']}>, symbols array<string>, data binary")


def block_pairs(packed: DataFrame, key: str) -> DataFrame:
    """Every block under each pair ``(i, j)`` of blocks, i <= j, that it is part of."""
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    return packed.withColumn("_p", F.explode(others)).select("*", "_p.i", "_p.j").drop("_p", "blocks")


def aligned(frame: pd.DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``(days, (symbols, matrix), (symbols, matrix))`` of a pair of blocks over the days of either; a block with itself gives it twice."""
    frame = frame.sort_values("block")
    days = np.unique(np.concatenate([np.asarray(d) for d in frame["days"]]))
    sides = []
    for d, s, data in zip(frame["days"], frame["symbols"], frame["data"], strict=True):
        m = np.full((len(days), len(s)), np.nan)
        m[np.searchsorted(days, np.asarray(d))] = np.frombuffer(data, float).reshape(len(d), len(s))
        sides.append((np.asarray(s, dtype=object), m))
    return days, sides[0], sides[-1]


def joint_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``[n, sx, sy, sxx, syy, sxy]`` of every column of x with every column of y, over the rows that both have."""
    p, q = np.isfinite(x), np.isfinite(y)
    a, b = np.where(p, x, 0.0), np.where(q, y, 0.0)
    p, q = p.astype(float), q.astype(float)
    return np.stack([p.T @ q, a.T @ q, p.T @ b, (a * a).T @ q, p.T @ (b * b), a.T @ b])
