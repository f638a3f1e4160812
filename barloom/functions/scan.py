"""Ordered scans: state that moves from row to row, or from day to day, of a key.

Rows are dealt by key and sorted by Spark, which spills what memory cannot
hold; a task reads its partition as a stream of batches and carries the state
over them. What is in memory at a time is a batch, the state of one key and,
for scans by day, the rows of one day, however long a series is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_type


def _kinds(df: DataFrame, added: dict[str, str]) -> tuple[str, dict[str, pa.DataType]]:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields} | added
    return ", ".join(f"`{n}` {t}" for n, t in kinds.items()), {n: to_arrow_type(T.DataType.fromDDL(t)) for n, t in added.items()}


def _values(column: pa.Array) -> list:
    """Python values; NaN is None, as NULL is."""
    out = column.to_pylist()
    return [None if v != v else v for v in out] if pa.types.is_floating(column.type) else out


def _with(batch: pa.RecordBatch, names: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([added[n] if n in added else batch.column(n) for n in names], names=names)


def row_scan(keys: list[str], names: list[str], reads: list[str], step, added: dict[str, pa.DataType]):
    """The scan of a partition's batches, sorted by key and order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = None, None
        for batch in batches:
            out: list[tuple] = []
            found = zip(*(_values(batch.column(c)) for c in reads), strict=True)
            for key, values in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), found, strict=True):
                if key != current:
                    state, current = None, key
                state, new = step(state, dict(zip(reads, values, strict=True)))
                out.append(new)
            columns = list(zip(*out, strict=True)) if out else [()] * len(added)
            yield _with(batch, names, {n: pa.array(c, t) for (n, t), c in zip(added.items(), columns, strict=True)})

    return run


def scan_by_key(df: DataFrame, keys: list[str], order: str, step: Callable[[Any, dict], tuple[Any, tuple]], added: dict[str, str], reads: list[str] | None = None) -> DataFrame:
    """``df`` with the columns ``added`` (name to type) that a scan gives.

    ``step(state, row)`` gets None as the first state of a key and the columns
    ``reads`` (all, unless given) of the row as a dict, NULL and NaN as None,
    and gives the next state and the values of the added columns.
    """
    schema, kinds = _kinds(df, added)
    names = [*df.columns, *(n for n in added if n not in df.columns)]
    run = row_scan(keys, names, reads or df.columns, step, kinds)
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def day_scan(keys: list[str], order: str, names: list[str], reads: list[str], step, added: dict[str, pa.DataType]):
    """The same by runs of rows with one key and order; a run that a batch ends in waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, left = None, None, None

        def through(batch: pa.RecordBatch, marks: list[tuple], end: int) -> pa.RecordBatch:
            nonlocal state, current
            columns, out = {c: _values(batch.column(c)) for c in reads}, {n: [] for n in added}
            edges = [0, *(i for i in range(1, end) if marks[i] != marks[i - 1]), end]
            for a, b in pairwise(edges):
                if marks[a][:-1] != current:
                    state, current = None, marks[a][:-1]
                state, new = step(state, {c: v[a:b] for c, v in columns.items()})
                for into, values in zip(out.values(), new, strict=True):
                    into.extend(values)
            return _with(batch.slice(0, end), names, {n: pa.array(out[n], t) for n, t in added.items()})

        for batch in batches:
            if not batch.num_rows:
                continue
            if left is not None:
                batch = pa.Table.from_batches([left, batch]).combine_chunks().to_batches()[0]
            marks = list(zip(*(batch.column(c).to_pylist() for c in (*keys, order)), strict=True))
            end = len(marks)
            while end and marks[end - 1] == marks[-1]:
                end -= 1
            if end:
                yield through(batch, marks, end)
            left = batch.slice(end)
        if left is not None:
            yield through(left, [*zip(*(left.column(c).to_pylist() for c in (*keys, order)), strict=True)], left.num_rows)

    return run


def scan_by_day(df: DataFrame, keys: list[str], order: str, step: Callable[[Any, dict], tuple[Any, tuple]], added: dict[str, str], reads: list[str], within: str) -> DataFrame:
    """``scan_by_key`` for steps that take all rows of one ``order`` together, as lists of the columns ``reads`` in the order of ``within``; they give lists."""
    schema, kinds = _kinds(df, added)
    names = [*df.columns, *(n for n in added if n not in df.columns)]
    return df.repartition(*keys).sortWithinPartitions(*keys, order, within).mapInArrow(day_scan(keys, order, names, reads, step, kinds), schema)


class BandedBook:
    """A book of weights that follows targets with a band and a gross limit."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.held = np.zeros(0)
        self.wanted = np.zeros(0)

    def settle(self, band: float, limit: float | None) -> None:
        """Trade towards the last targets, those of symbols that had any."""
        wanted = np.full(len(self.held), np.nan)
        wanted[: len(self.wanted)] = self.wanted
        if np.isnan(wanted).all():
            return
        book = np.where(np.isnan(wanted) | (np.abs(wanted - self.held) <= band), self.held, wanted)
        gross = np.abs(book).sum()
        if limit is not None and gross > limit:
            book = book * (limit / gross)
        if not np.allclose(book, self.held):
            self.held = book

    def take(self, symbols: list[str], targets: list[float | None]) -> np.ndarray:
        """What is held of ``symbols``; their ``targets`` are the last from now on."""
        at = np.array([self.place.setdefault(s, len(self.place)) for s in symbols], int)
        self.held = np.append(self.held, np.zeros(len(self.place) - len(self.held)))
        self.wanted = np.full(len(self.place), np.nan)
        self.wanted[at] = [np.nan if t is None else t for t in targets]
        return self.held[at]


def banded_step(band: float, limit: float | None):
    def step(state: BandedBook | None, day: dict) -> tuple[BandedBook, tuple]:
        if state is None:
            state = BandedBook()
        else:
            state.settle(band, limit)
        return state, (state.take(day["symbol"], day["target"]).tolist(),)

    return step


def ema_step(column: str, span: int):
    """Exponential mean: the first value, then alpha of each new one."""
    alpha = 2.0 / (span + 1)

    def step(state, row):
        x = row[column]
        if x is not None:
            state = x if state is None else alpha * x + (1 - alpha) * state
        return state, (state,)

    return step
