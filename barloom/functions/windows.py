"""Row-relative building blocks. Missing is NULL everywhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec, functions as F


def ordered(*keys: str, by: str = "ts") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(by)


def trailing(rows: int, *keys: str, by: str = "ts") -> WindowSpec:
    """The last ``rows`` rows of a key, the current one included."""
    return ordered(*keys, by=by).rowsBetween(-(rows - 1), 0)


def so_far(*keys: str, by: str = "ts") -> WindowSpec:
    return ordered(*keys, by=by).rowsBetween(Window.unboundedPreceding, 0)


def rolling(agg: Callable[[Column], Column], x: Column, rows: int, least: int | None = None, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """``agg`` over the last ``rows`` rows, NULL until ``least`` (default: all) of them are present."""
    frame = trailing(rows, *keys)
    return F.when(F.count(x).over(frame) >= (rows if least is None else least), agg(x).over(frame))


def change(x: Column, steps: int = 1, keys: tuple[str, ...] = ("symbol",)) -> Column:
    """x / x ``steps`` rows before - 1."""
    return x / F.lag(x, steps).over(ordered(*keys)) - 1


def compounded(x: Column) -> Column:
    """Growth over all ``x`` of an aggregation or a frame; a loss of everything or more counts as it is, NULL as no change."""
    return F.product(1 + x)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """x held between low and high; NULL stays NULL."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def finite(x: Column) -> Column:
    """x as a double, NULL where it is not a finite number."""
    d = x.try_cast("double") if hasattr(x, "try_cast") else x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))
