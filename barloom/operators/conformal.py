"""Conformal bands around positions."""

from __future__ import annotations

import math
from bisect import bisect_right, insort

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.scan import scan_by_key
from barloom.functions.windows import clip, ordered


def residual_quantile(residuals: DataFrame, alpha: float, keys: tuple[str, ...] = ("symbol",), least: int = 5) -> DataFrame:
    """``q``: the absolute residual at level min(1, (1 - alpha)(n + 1)/n), between two order statistics; NULL below ``least`` rows."""
    known = residuals.where("residual is not null").withColumn("_a", F.abs("residual"))
    w = Window.partitionBy(*keys)
    rows = known.withColumns({"_rn": F.row_number().over(w.orderBy("_a")), "_n": F.count("*").over(w)})
    place = F.least(F.lit(1.0), (1 - alpha) * (F.col("_n") + 1) / F.col("_n")) * (F.col("_n") - 1)
    rows = rows.withColumn("_p", place)
    lo, hi = F.floor("_p") + 1, F.ceil("_p") + 1
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.when(F.col("_rn") == lo, F.col("_a"))).alias("_lo"), F.max(F.when(F.col("_rn") == hi, F.col("_a"))).alias("_hi"), F.max(F.col("_p") - F.floor("_p")).alias("_f"))
    return found.select(*keys, "n", F.when(F.col("n") >= least, F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias("q"))


#: Values of a sorted run of a rank structure at most.
RUN = 512


class Ranks:
    """Values in order as sorted runs, of which each begins where the one before ends: adding one, or finding one by its place, touches one run."""

    def __init__(self) -> None:
        self.runs: list[list[float]] = []
        self.firsts: list[float] = []
        self.n = 0

    def add(self, value: float) -> None:
        self.n += 1
        if not self.runs:
            self.runs, self.firsts = [[value]], [value]
            return
        i = max(0, bisect_right(self.firsts, value) - 1)
        run = self.runs[i]
        insort(run, value)
        self.firsts[i] = run[0]
        if len(run) > RUN:
            half = len(run) // 2
            self.runs[i : i + 1] = [run[:half], run[half:]]
            self.firsts[i : i + 1] = [run[0], run[half]]

    def at(self, place: int) -> float:
        for run in self.runs:
            if place < len(run):
                return run[place]
            place -= len(run)
        raise IndexError(place)


def expanding_quantile(residuals: DataFrame, alpha: float, keys: tuple[str, ...] = ("symbol",), least: int = 5) -> DataFrame:
    """``q`` at every bar: ``residual_quantile`` over the residuals known by then, its own included; NULL below ``least`` of them.

    A missing residual leaves the quantile as it is. The scan keeps a key's
    absolute residuals as sorted runs, so a bar costs one run, not a sort.
    """

    def step(ranks: Ranks | None, row: dict) -> tuple[Ranks, tuple]:
        ranks = Ranks() if ranks is None else ranks
        if row["residual"] is not None:
            ranks.add(abs(row["residual"]))
        n = ranks.n
        if n < least:
            return ranks, (None,)
        place = min(1.0, (1 - alpha) * (n + 1) / n) * (n - 1)
        low = math.floor(place)
        below = ranks.at(low)
        return ranks, (below + (place - low) * (ranks.at(min(low + 1, n - 1)) - below),)

    return scan_by_key(residuals, list(keys), "ts", step, {"q": "double"}, ["residual"])


def bands(points: DataFrame, cap: float, q: str | None = "q") -> DataFrame:
    """``low`` and ``high``: the position +- q within +-cap; the whole range without q."""
    if q is None:
        return points.withColumns({"low": F.lit(-float(cap)), "high": F.lit(float(cap))})
    p, width = F.col("position"), F.col(q)
    return points.withColumns({"low": F.coalesce(clip(p - width, -cap, cap), F.lit(-float(cap))), "high": F.coalesce(clip(p + width, -cap, cap), F.lit(float(cap)))})


def realized(points: DataFrame, horizon: int) -> DataFrame:
    """``miss``: 1 if the ideal position ``horizon`` bars later lies outside the band; NULL where it is unknown."""
    later = F.lead("ideal", horizon).over(ordered("symbol"))
    return points.withColumn("miss", F.when(later.isNotNull(), ((later < F.col("low")) | (later > F.col("high"))).cast("int")))


def adapt(alpha: float, miss: int, target: float, rate: float) -> float:
    return min(1 - 1e-4, max(1e-4, alpha + rate * (target - miss)))


def adaptive_alpha(misses: DataFrame, target: float = 0.1, rate: float = 0.02, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``alpha`` after each bar: raised while bands hold and lowered by misses; an unknown bar leaves it."""

    def step(alpha, row):
        alpha = target if alpha is None else alpha
        if row["miss"] is not None:
            alpha = adapt(alpha, int(row["miss"]), target, rate)
        return alpha, (alpha,)

    return scan_by_key(misses, list(keys), "ts", step, {"alpha": "double"}, ["miss"])


def coverage(judged: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return judged.where("miss is not null").groupBy(*keys).agg(F.count("*").alias("n"), (1 - F.avg("miss")).alias("coverage"))
