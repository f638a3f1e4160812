"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over seven bytes ends a chunk wherever it meets the trigger of
the block size, so boundaries depend on the text around them alone and an
edit changes only the chunks it touches. Every chunk becomes one of 64
characters. A fingerprint holds the signatures at its block size and at twice
that size; two fingerprints are compared where block sizes coincide, by the
edit distance of the signatures (an insertion or deletion costs 1, a
replacement 2).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

from barloom.llm.lookup import constant_array, points_below

WINDOW = 7
SMALLEST_BLOCK = 3
LENGTH = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_CODES = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_MIX = np.uint32(0x9E3779B1)
_POWERS = [np.uint32(pow(0x01000193, WINDOW - 1 - i, 1 << 32)) for i in range(WINDOW)]


def _rolling(data: bytes) -> np.ndarray:
    """Hash of the seven bytes that end at each position (zeros before the text)."""
    padded = np.zeros(len(data) + WINDOW - 1, dtype=np.uint32)
    padded[WINDOW - 1 :] = np.frombuffer(data, dtype=np.uint8)
    padded += 1
    out = np.zeros(len(data), dtype=np.uint32)
    for i, power in enumerate(_POWERS):
        out += padded[i : i + len(data)] * power
    out ^= out >> np.uint32(15)
    out *= _MIX
    out ^= out >> np.uint32(13)
    return out


def _boundaries(rolled: np.ndarray, block: int) -> int:
    return int(np.count_nonzero(rolled % np.uint32(block) == block - 1))


def _signature(rolled: np.ndarray, block: int) -> bytes:
    """The characters of the chunks at a block size, of even runs of chunks where there are more than LENGTH."""
    starts = np.concatenate(([0], np.flatnonzero(rolled % np.uint32(block) == block - 1) + 1))
    starts = starts[starts < len(rolled)]
    starts = starts[:: -(-len(starts) // LENGTH)]
    sums = np.add.reduceat(rolled, starts, dtype=np.uint32)
    sums = (sums ^ (sums >> np.uint32(16))) * _MIX
    return _CODES[(sums >> np.uint32(26)).astype(np.int64)].tobytes()


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``; an empty text has empty signatures.

    The block is halved while there are few chunks and doubled while there are
    more than a signature holds, so that characters are chunks. A text of short
    period has very many chunks at one block and hardly any at the next; there
    a character stands for a run of chunks, and the signature still covers the
    whole text.
    """
    block = SMALLEST_BLOCK
    while block * LENGTH < len(data):
        block *= 2
    if not data:
        return f"{block}::"
    rolled = _rolling(data)
    while block > SMALLEST_BLOCK and _boundaries(rolled, block) < LENGTH // 2:
        block //= 2
    while _boundaries(rolled, block) >= LENGTH and _boundaries(rolled, 2 * block) >= LENGTH // 8:
        block *= 2
    return f"{block}:{_signature(rolled, block).decode()}:{_signature(rolled, 2 * block).decode()}"


def _lcs(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair of signatures, all pairs at once.

    Bit-parallel over a 64-bit word: a signature has at most 64 characters.
    """
    n = len(left)
    width = max((len(s) for s in right), default=0)
    wide = max((len(s) for s in left), default=0)
    sized = np.array([len(s) for s in left], dtype=np.uint64)
    a = np.array([list(s.encode().ljust(wide, b"\0")) for s in left], dtype=np.uint8).reshape(n, wide)
    b = np.array([list(s.encode().ljust(width, b"\0")) for s in right], dtype=np.uint8).reshape(n, width)
    masks, rows = np.zeros((n, 128), dtype=np.uint64), np.arange(n)
    for j in range(wide):
        masks[rows, a[:, j]] |= np.uint64(1) << np.uint64(j)
    masks[:, 0] = 0
    state = np.full(n, ~np.uint64(0))
    for j in range(width):
        match = state & masks[rows, b[:, j]]
        state = (state + match) | (state - match)
    inside = np.where(sized == 64, ~np.uint64(0), (np.uint64(1) << (sized % np.uint64(64))) - np.uint64(1))
    return np.bitwise_count(~state & inside).astype(np.int64)


def likeness(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """Likeness (0 to 1) of each pair of fingerprints; null where either is null.

    1 - edit distance / total length of the signatures, the higher one where
    both block sizes coincide; 0 where no block size does. Two empty
    signatures are alike.
    """
    out = np.zeros(len(left))
    jobs: list[tuple[int, str, str]] = []
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        if x is None or y is None:
            out[k] = np.nan
            continue
        if x == y:
            out[k] = 1.0
            continue
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        bx, by = int(bx), int(by)
        if bx == by:
            jobs += [(k, x1, y1), (k, x2, y2)]
        elif bx == 2 * by:
            jobs.append((k, x1, y2))
        elif by == 2 * bx:
            jobs.append((k, x2, y1))
    if jobs:
        common = _lcs([j[1] for j in jobs], [j[2] for j in jobs])
        total = np.array([len(j[1]) + len(j[2]) for j in jobs])
        np.maximum.at(out, [j[0] for j in jobs], np.where(total > 0, 2 * common / np.maximum(total, 1), 0.0))
    return out


@pandas_udf(StringType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in batch], dtype=object)


@pandas_udf(DoubleType())
def _likeness(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series(likeness(list(left), list(right)))


def fingerprint_of(text: Column) -> Column:
    """Fingerprint of a text column; null counts as the empty text."""
    return _fingerprints(text)


def likeness_of(left: Column, right: Column) -> Column:
    """Likeness of two fingerprint columns."""
    return _likeness(left, right)


def with_next_row(rows: DataFrame, columns: list[str], key: str = "doc_id", rows_per_part: int = 2000) -> DataFrame:
    """``rows`` with ``next_<column>`` of the row that follows in ascending ``key`` order, cyclically.

    Rows are dealt to ranges of the key, cut at quantiles, and the first row
    of each range also goes to the range before it, so every range finds its
    followers alone and no task sees the whole order. Null keys come first;
    equal keys follow each other by the remaining columns. The last row is
    followed by the first.
    """
    n = rows.count()
    parts = max(1, min(20_000, n // rows_per_part))
    cuts = rows.approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    part = points_below(F.col(key), sorted({int(c) for c in cuts}), closed=True) if cuts else F.lit(0)
    dealt = rows.withColumn("_part", F.when(F.col(key).isNull(), 0).otherwise(part))
    first_of = F.min(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("key")))
    firsts = {r["_part"]: r["first"]["key"] for r in dealt.groupBy("_part").agg(first_of.alias("first")).collect()}
    if not firsts:
        return rows.withColumns({f"next_{c}": F.col(c) for c in columns})
    used = sorted(firsts)  # at most ``parts`` of them
    before = {p: used[i - 1] for i, p in enumerate(used)}
    every = range(used[-1] + 1)
    start = F.get(constant_array([firsts.get(p) for p in every]), F.col("_part"))
    home = F.get(constant_array([before.get(p) for p in every]), F.col("_part")).cast("int")
    tied = [F.xxhash64(*columns), *columns]
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*tied))
    guests = dealt.where(F.col(key).eqNullSafe(start)).withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    both = dealt.withColumn("_guest", F.lit(0)).unionByName(guests.withColumns({"_part": home, "_guest": F.lit(1)}))
    w = Window.partitionBy("_part").orderBy("_guest", F.col(key).asc_nulls_first(), *tied)
    led = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns})
    return led.where("_guest = 0").drop("_part", "_guest")
