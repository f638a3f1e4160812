"""Pair discovery and pair signals; (fold, pair) is the key everywhere."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.normal import norm_cdf
from barloom.functions.scan import scan_by_key
from barloom.functions.windows import ordered, rolling
from barloom.operators import tiles

PAIR = ["fold", "y", "x"]
#: MacKinnon's (1994) response surfaces for a constant, by number
#: of series: the range of the statistic, where the branches meet, and their
#: coefficients from the constant up.
SURFACE = {
    1: {"low": -18.83, "high": 2.74, "star": -1.61, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    2: {"low": -18.86, "high": 0.92, "star": -2.62, "small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377)},
}
#: Reasons of a rejection, in the order of the gates.
REASONS = ("candidate_unavailable", "fdr", "coint_pvalue", "adf_pvalue", "return_corr", "half_life", "beta_drift", "max_pairs")


def pair_rows(prices: DataFrame, both_orders: bool = False) -> DataFrame:
    """``(fold, y, x, ts, ly, lx)``: log prices of every pair on the days that both have."""
    logs = prices.where("close > 0").select("fold", "ts", "symbol", F.log("close").alias("l"))
    a, b = logs.withColumnsRenamed({"symbol": "y", "l": "ly"}), logs.withColumnsRenamed({"symbol": "x", "l": "lx"})
    met = F.col("y") != F.col("x") if both_orders else F.col("y") < F.col("x")
    return a.join(b, ["fold", "ts"]).where(met).select("fold", "y", "x", "ts", "ly", "lx")


def rows_of_pairs(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pair_rows`` of the given ``pairs(fold, y, x)`` only."""
    logs = prices.where("close > 0").select("fold", "ts", "symbol", F.log("close").alias("l"))
    met = pairs.select(*PAIR).join(logs.withColumnsRenamed({"symbol": "y", "l": "ly"}), ["fold", "y"])
    return met.join(logs.withColumnsRenamed({"symbol": "x", "l": "lx"}), ["fold", "x", "ts"]).select("fold", "y", "x", "ts", "ly", "lx")


def hedge_ratios(rows: DataFrame) -> DataFrame:
    """``alpha, beta`` of ly on lx."""
    return rows.groupBy(*PAIR).agg(F.count("*").alias("n"), F.regr_intercept("ly", "lx").alias("alpha"), F.regr_slope("ly", "lx").alias("beta"))


def half_life(slope: Column) -> Column:
    """Periods until half of a deviation is gone; infinity without reversion, at least 1."""
    return F.when(slope >= -1e-12, F.lit(float("inf"))).otherwise(F.greatest(F.lit(1.0), -math.log(2) / slope))


def pair_statistics(rows: DataFrame) -> DataFrame:
    """Hedge ratio, half-life, beta drift, return correlation and lag-0 unit-root statistics of each pair.

    ``stat`` tests the hedge residual without a constant (Engle-Granger),
    ``adf_stat`` with one. Everything comes from two aggregations of the
    pair's rows.
    """
    w = ordered(*PAIR)
    size = F.count("*").over(Window.partitionBy(*PAIR))
    seen = rows.withColumns({
        "_rn": F.row_number().over(w), "_n": size, "_dy": F.col("ly") - F.lag("ly").over(w), "_dx": F.col("lx") - F.lag("lx").over(w),
    })
    early = F.col("_rn") <= F.floor(F.col("_n") / 2)
    half = lambda c, m: F.when(m, F.col(c))
    fit = seen.groupBy(*PAIR).agg(
        F.count("*").alias("n"), F.regr_intercept("ly", "lx").alias("alpha"), F.regr_slope("ly", "lx").alias("beta"), F.corr("_dy", "_dx").alias("return_corr"),
        F.regr_slope(half("ly", early), half("lx", early)).alias("_b1"), F.regr_slope(half("ly", ~early), half("lx", ~early)).alias("_b2"),
    )
    spread = rows.join(fit, PAIR).withColumn("_s", F.col("ly") - F.col("alpha") - F.col("beta") * F.col("lx"))
    step = spread.withColumn("_before", F.lag("_s").over(w)).withColumn("_d", F.col("_s") - F.col("_before"))
    both = F.col("_before").isNotNull()
    tests = step.groupBy(*PAIR).agg(
        F.sum(F.when(both, F.col("_before") * F.col("_d"))).alias("_bd"), F.sum(F.when(both, F.col("_before") * F.col("_before"))).alias("_bb"),
        F.sum(F.when(both, F.col("_d") * F.col("_d"))).alias("_dd"), *_step_sums(),
    )
    rho = F.col("_bd") / F.col("_bb")
    error = F.sqrt((F.col("_dd") - rho * F.col("_bd")) / (F.col("_m") - 1) / F.col("_bb"))
    drift = F.when(F.col("n") < 6, F.lit(float("inf"))).otherwise(F.abs(F.col("_b2") - F.col("_b1")) / F.abs("beta"))
    out = fit.join(tests, PAIR).withColumns({"half_life": half_life(F.col("_slope")), "beta_drift": drift, "stat": rho / error, "adf_stat": _adf_stat()})
    return out.select(*PAIR, "n", "alpha", "beta", "return_corr", "half_life", "beta_drift", "stat", "adf_stat", "spread_std")


def _step_sums() -> list[Column]:
    """Sums over a spread ``_s`` and its steps ``_d`` from ``_before``, from which half-life and unit-root statistic follow."""
    return [
        F.regr_slope("_d", "_before").alias("_slope"), F.regr_sxx("_d", "_before").alias("_xx"), F.regr_sxy("_d", "_before").alias("_xy"),
        F.regr_syy("_d", "_before").alias("_yy"), F.count("_before").alias("_m"), F.stddev_samp("_s").alias("spread_std"),
    ]


def _adf_stat() -> Column:
    """The slope on the level over its error, with a constant."""
    slope = F.col("_xy") / F.col("_xx")
    return slope / F.sqrt((F.col("_yy") - slope * F.col("_xy")) / (F.col("_m") - 2) / F.col("_xx"))


def pair_diagnostics(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """``n, return_corr, spread_std, half_life, adf_stat, adf_p`` of pairs on rows they were not fitted on.

    ``fitted`` has the hedge ratios; fewer than three rows leave all but ``n``
    NULL.
    """
    w = ordered(*PAIR)
    known = rows.join(fitted.select(*PAIR, "alpha", "beta"), PAIR).withColumn("_s", F.col("ly") - F.col("alpha") - F.col("beta") * F.col("lx"))
    step = known.withColumns({"_before": F.lag("_s").over(w), "_dy": F.col("ly") - F.lag("ly").over(w), "_dx": F.col("lx") - F.lag("lx").over(w)})
    step = step.withColumn("_d", F.col("_s") - F.col("_before"))
    found = step.groupBy(*PAIR).agg(F.count("*").alias("n"), F.corr("_dy", "_dx").alias("_corr"), *_step_sums())
    enough = lambda x: F.when(F.col("n") >= 3, x)
    out = found.withColumn("adf_stat", enough(_adf_stat()))
    return out.select(
        *PAIR, "n", enough(F.col("_corr")).alias("return_corr"), enough(F.col("spread_std")).alias("spread_std"), enough(half_life(F.col("_slope"))).alias("half_life"),
        "adf_stat", mackinnon_p(F.col("adf_stat"), 1).alias("adf_p"),
    )


def with_p_values(stats: DataFrame) -> DataFrame:
    """``p`` and ``adf_p`` of the statistics ``stat`` (two series) and ``adf_stat`` (one)."""
    return stats.withColumns({"p": mackinnon_p(F.col("stat"), 2), "adf_p": mackinnon_p(F.col("adf_stat"), 1)})


def mackinnon_z(stat: Column, series: int) -> Column:
    """The normal quantile of a unit-root statistic; its distribution function is the p-value."""
    s = SURFACE[series]
    poly = lambda c: sum((F.lit(v) * F.pow(stat, F.lit(i)) for i, v in enumerate(c)), F.lit(0.0))
    return F.when(stat <= s["star"], poly(s["small"])).otherwise(poly(s["large"]))


def mackinnon_p(stat: Column, series: int) -> Column:
    s = SURFACE[series]
    return F.when(stat < s["low"], 0.0).when(stat > s["high"], 1.0).when(stat.isNotNull(), norm_cdf(mackinnon_z(stat, series)))


def _triangles(design: np.ndarray) -> np.ndarray:
    """Cholesky factors of the Gram matrices of ``design[case, row, column]``, columns at unit length; NaN where columns depend on each other."""
    size = np.sqrt((design * design).sum(axis=1, keepdims=True))
    scaled = design / np.where(size > 0, size, 1.0)
    gram = scaled.transpose(0, 2, 1) @ scaled
    try:
        return np.linalg.cholesky(gram)
    except np.linalg.LinAlgError:
        out = np.full_like(gram, np.nan)
        for i, g in enumerate(gram):
            try:
                out[i] = np.linalg.cholesky(g)
            except np.linalg.LinAlgError:
                pass
        return out


def adf_batch(series: np.ndarray, constant: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(statistics, lags)`` of augmented Dickey-Fuller tests of the columns of ``series``; the lag by AIC on a common sample, the statistic on all rows.

    One factorization of the Gram matrix of all lags and the target has the
    residual sum of every number of lags: the last row of the factor holds what
    each regressor explains after those before it.
    """
    n, cases = series.shape
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 3)
    if most < 0:
        return np.full(cases, np.nan), np.zeros(cases, int)
    d = np.diff(series, axis=0)

    def columns(of: np.ndarray | slice, lags: int, level_last: bool) -> np.ndarray:
        level, past = [series[lags:-1, of]], [d[lags - k : len(d) - k, of] for k in range(1, lags + 1)]
        found = [*past, *level] if level_last else [*level, *past]
        if constant:
            found.insert(0, np.ones_like(level[0]))
        return np.stack([*found, d[lags:, of]], axis=-1).transpose(1, 0, 2)

    rows, first = n - 1 - most, 2 if constant else 1
    last = _triangles(columns(slice(None), most, False))[:, -1]
    # of the target's unit length: unexplained by the first 1, 2 ... regressors
    left = np.cumsum(last[:, ::-1] ** 2, axis=1)[:, ::-1][:, first:]
    with np.errstate(divide="ignore"):
        lags = np.nan_to_num(rows * np.log(left) + 2 * np.arange(first, first + most + 1), nan=np.inf).argmin(axis=1)
    stat = np.full(cases, np.nan)
    for lag in np.unique(lags):
        of = np.flatnonzero(lags == lag)
        end = _triangles(columns(of, lag, True))[:, -1]
        free = max(n - 1 - lag - (first + lag), 1)
        stat[of] = end[:, -2] / end[:, -1] * math.sqrt(free)
    return stat, lags


def _aic_tests(y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """Tests of the columns of ``y`` on the series ``x``, both without gaps."""
    m = y.shape[1]
    if len(x) < 10 or x.std() < 1e-12:
        return {"stat": np.full(m, np.nan), "lag": np.full(m, np.nan), "adf_stat": np.full(m, np.nan), "adf_lag": np.full(m, np.nan)}
    y0, x0 = y - y.mean(axis=0), x - x.mean()
    spread = y0 - np.outer(x0, x0 @ y0 / (x0 @ x0))
    (stat, lag), (adf, adf_lag) = adf_batch(spread, False), adf_batch(spread, True)
    return {"stat": stat, "lag": lag, "adf_stat": adf, "adf_lag": adf_lag}


def _statistics(y: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """``pair_statistics`` of every column of ``y`` with the series ``x``, both without gaps, from their joint moments."""
    n, m = y.shape
    nothing = np.full(m, np.nan)
    dot = lambda a, b: (a * b).sum(axis=0) if a.ndim > 1 else a @ b
    mean_y, mean_x = y.mean(axis=0), x.mean()
    y, x = y - mean_y, x - mean_x

    def slope(rows: slice) -> np.ndarray:
        a, b = y[rows], x[rows]
        if len(b) < 1:
            return nothing
        b = b - b.mean()
        return b @ a / (b @ b)

    beta = slope(slice(None))
    out = {"n": np.full(m, n), "alpha": mean_y - beta * mean_x, "beta": beta}
    dy, dx = np.diff(y, axis=0), np.diff(x)
    cy, cx = dy - dy.mean(axis=0) if n > 1 else dy, dx - dx.mean() if n > 1 else dx
    out["return_corr"] = cx @ cy / np.sqrt(dot(cy, cy) * (cx @ cx)) if n > 2 else nothing
    early = n // 2
    drift = np.abs(slope(slice(early, None)) - slope(slice(0, early))) / np.abs(beta)
    out["beta_drift"] = np.full(m, np.inf) if n < 6 else drift
    before = y[:-1] - np.outer(x[:-1], beta)
    step = dy - np.outer(dx, beta)
    bb, bd, dd, k = dot(before, before), dot(before, step), dot(step, step), n - 1
    rho = bd / bb
    out["stat"] = rho / np.sqrt((dd - rho * bd) / (k - 1) / bb) if k > 1 else nothing
    cb, cd = before - before.mean(axis=0) if k else before, step - step.mean(axis=0) if k else step
    xx, xy, yy = dot(cb, cb), dot(cb, cd), dot(cd, cd)
    trend = xy / xx
    out["half_life"] = np.where(np.isnan(trend), np.nan, np.where(trend >= -1e-12, np.inf, np.maximum(1.0, -math.log(2) / np.minimum(trend, -1e-12))))
    out["adf_stat"] = trend / np.sqrt((yy - trend * xy) / (k - 2) / xx) if k > 2 else nothing
    spread = y - np.outer(x, beta)
    out["spread_std"] = np.sqrt(dot(spread, spread) / k) if k else nothing
    return out


def _by_blocks(prices: DataFrame, both_orders: bool, kernel, kinds: dict[str, str]) -> DataFrame:
    """``(fold, y, x)`` with what ``kernel(y, x)`` gives for the log prices of every pair on the days that both have.

    Symbols of a fold meet as pairs of blocks, one matrix each: the columns of
    a block that have every day of a series are one call, the others one each.
    """
    logs = prices.where("close > 0").select("fold", "ts", "symbol", F.log("close").alias("l"))
    schema = "fold int, y string, x string, " + ", ".join(f"{c} {t}" for c, t in kinds.items())

    def of(names: np.ndarray, ys: np.ndarray, x_name: str, x: np.ndarray) -> list[pd.DataFrame]:
        there = np.isfinite(x)
        allowed = names != x_name if both_orders else names < x_name
        held = np.isfinite(ys[there])
        whole = np.flatnonzero(allowed & held.all(axis=0)) if there.any() else np.array([], int)
        parts = [(whole, there)] if len(whole) else []
        parts += [(np.array([c]), there & np.isfinite(ys[:, c])) for c in np.flatnonzero(allowed & held.any(axis=0) & ~held.all(axis=0))]
        with np.errstate(all="ignore"):
            return [pd.DataFrame({"y": names[c], "x": x_name, **kernel(ys[rows][:, c], x[rows])}) for c, rows in parts]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        _, (left, a), (right, b) = tiles.aligned(frame)
        out = [part for j, name in enumerate(right) for part in of(left, a, name, b[:, j])]
        if len(frame) > 1 and both_orders:
            out += [part for j, name in enumerate(left) for part in of(right, b, name, a[:, j])]
        if not out:
            return pd.DataFrame(columns=["fold", "y", "x", *kinds])
        found = pd.concat(out)
        found.insert(0, "fold", frame["fold"].iloc[0])
        return found.astype({c: object for c in kinds}).where(found.notna(), None)[["fold", "y", "x", *kinds]]

    return tiles.block_pairs(tiles.packed_blocks(logs, "fold", "l", tiles.BLOCK), "fold").groupBy("fold", "i", "j").applyInPandas(run, schema)


_STATISTICS = ("alpha", "beta", "return_corr", "half_life", "beta_drift", "stat", "adf_stat", "spread_std")


def pair_table(prices: DataFrame, both_orders: bool = False) -> DataFrame:
    """``pair_statistics`` of all pairs of ``prices(fold, ts, symbol, close)``, by blocks of symbols.

    Rows of prices are sent once for each block that theirs meets, as
    matrices; a row for each pair of symbols and day is never made.
    """
    return _by_blocks(prices, both_orders, _statistics, {"n": "long", **dict.fromkeys(_STATISTICS, "double")})


def aic_table(prices: DataFrame, both_orders: bool = False) -> DataFrame:
    """``stat, lag, adf_stat, adf_lag`` of all pairs of ``prices(fold, ts, symbol, close)`` with lags chosen by AIC, by blocks of symbols.

    ``stat`` tests the hedge residual without a constant, ``adf_stat`` with one.
    """
    return _by_blocks(prices, both_orders, _aic_tests, _AIC)


_AIC = {"stat": "double", "lag": "int", "adf_stat": "double", "adf_lag": "int"}


def engle_granger_aic(rows: DataFrame) -> DataFrame:
    """The same for pairs that are there as rows: a task for each pair."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        found = pd.DataFrame({c: [frame[c].iloc[0]] for c in PAIR} | _aic_tests(frame[["ly"]].to_numpy(float), frame["lx"].to_numpy(float)))
        return found.astype(object).where(found.notna(), None)

    return rows.groupBy(*PAIR).applyInPandas(run, "fold int, y string, x string, " + ", ".join(f"{c} {t}" for c, t in _AIC.items()))


def best_order(stats: DataFrame) -> DataFrame:
    """Of the two orders of a pair the one with the lower ``p``, y before x on ties."""
    w = Window.partitionBy("fold", F.least("y", "x"), F.greatest("y", "x")).orderBy(F.col("p").asc_nulls_last(), "y")
    return stats.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def benjamini_hochberg(tests: DataFrame, alpha: float, keys: tuple[str, ...] = ("fold",)) -> DataFrame:
    """``passes``: p is not above the largest p that meets alpha * rank / m; NULLs fail."""
    known = F.col("p").isNotNull()
    rank = F.row_number().over(Window.partitionBy(*keys, known).orderBy("p"))
    m = F.count("p").over(Window.partitionBy(*keys))
    ranked = tests.withColumn("_cut", F.when(known & (F.col("p") <= alpha * rank / m), F.col("p")))
    bound = F.max("_cut").over(Window.partitionBy(*keys))
    return ranked.withColumn("passes", F.coalesce(F.col("p") <= bound, F.lit(False))).drop("_cut")


@dataclass(frozen=True)
class Selection:
    """What a pair must satisfy; ``shrunk`` leaves out the two significance gates and ranks by the statistic."""

    least_rows: int = 252
    max_p: float = 0.05
    max_adf_p: float = 0.05
    fdr: float = 0.10
    min_corr: float = 0.30
    min_half_life: float = 1.0
    max_half_life: float = 60.0
    max_drift: float = 0.50
    min_beta: float = 0.05
    most: int = 10
    shrunk: bool = False

    def __post_init__(self) -> None:
        if self.least_rows < 30 or self.most < 1:
            raise ValueError("a fit needs 30 rows and a selection one pair at least")
        if not all(0 < x < 1 for x in (self.max_p, self.max_adf_p, self.fdr)) or not 0 <= self.min_corr <= 1:
            raise ValueError("p-values and levels lie between 0 and 1")
        if not 0 < self.min_half_life < self.max_half_life or min(self.max_drift, self.min_beta) < 0:
            raise ValueError("half-lives must be positive and ascending, drift and beta not negative")


def rejection_reason(candidates: DataFrame, s: Selection) -> DataFrame:
    """``reason``: the first gate that fails, NULL if none does."""
    c = F.col
    off = lambda x: ~F.coalesce(F.abs(x) < float("inf"), F.lit(False))
    lacking = c("stat").isNull() | c("beta").isNull() | (c("n") < s.least_rows) | (F.abs("beta") < s.min_beta)
    gate = F.when(F.coalesce(lacking, F.lit(True)), "candidate_unavailable")
    if not s.shrunk:
        gate = gate.when(~c("passes"), "fdr")
    gate = gate.when(c("p") > s.max_p, "coint_pvalue")
    if not s.shrunk:
        gate = gate.when(c("adf_p") > s.max_adf_p, "adf_pvalue")
    gate = gate.when(F.coalesce(F.abs("return_corr") < s.min_corr, F.lit(True)), "return_corr")
    gate = gate.when(off(c("half_life")) | ~c("half_life").between(s.min_half_life, s.max_half_life), "half_life")
    gate = gate.when(off(c("beta_drift")) | (c("beta_drift") > s.max_drift), "beta_drift")
    return candidates.withColumn("reason", gate)


def tested_pairs(stats: DataFrame, s: Selection) -> DataFrame:
    """The better order of each pair with ``p, adf_p`` and ``passes``; a pair without a usable fit has no ``p``."""
    usable = F.coalesce((F.col("n") >= s.least_rows) & (F.abs("beta") >= s.min_beta), F.lit(False))
    tested = with_p_values(stats).withColumn("p", F.when(usable, F.col("p")))
    return benjamini_hochberg(best_order(tested), s.fdr)


def choose_pairs(stats: DataFrame, s: Selection) -> DataFrame:
    """Candidates of each fold in their better order with ``p, adf_p, passes, reason, rank`` and ``evidence``.

    ``stats`` has both orders of a pair. Pairs without a usable fit count as
    unavailable and take no part in the false discovery rate. Chosen pairs
    have no reason; their evidence is 1 unless the selection is shrunk.
    """
    gated = rejection_reason(tested_pairs(stats, s), s)
    order = [F.desc(F.abs("stat")), F.col("p"), F.col("half_life")] if s.shrunk else [F.col("p"), F.col("half_life"), F.col("beta_drift")]
    ranked = select_pairs(gated, s.most, order)
    if not s.shrunk:
        return ranked.withColumn("evidence", F.when(F.col("reason").isNull(), 1.0))
    weights = evidence_weights(ranked.where("reason is null")).select(*PAIR, "evidence")
    return ranked.join(weights, PAIR, "left")


def select_pairs(candidates: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """Accepted candidates ranked within the fold; those past ``most`` get the reason ``max_pairs``."""
    open_ = F.col("reason").isNull()
    rank = F.row_number().over(Window.partitionBy("fold", open_).orderBy(*order, "y", "x"))
    ranked = candidates.withColumn("rank", F.when(open_, rank))
    return ranked.withColumn("reason", F.when(F.col("rank") > most, "max_pairs").otherwise(F.col("reason")))


def rejection_counts(candidates: DataFrame) -> DataFrame:
    """``(fold, reason, n)`` for all fixed reasons, 0 where none was given."""
    folds = candidates.select("fold").distinct().withColumn("reason", F.explode(F.array(*map(F.lit, REASONS))))
    found = candidates.where("reason is not null").groupBy("fold", "reason").agg(F.count("*").alias("n"))
    return folds.join(found, ["fold", "reason"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def evidence_weights(chosen: DataFrame) -> DataFrame:
    """``evidence``: |stat| shrunk to the fold's mean (positive-part James-Stein), scaled to a maximum of 1."""
    w = Window.partitionBy("fold")
    s = F.abs("stat")
    k, mean = F.count("*").over(w), F.avg(s).over(w)
    apart = F.sum((s - F.col("_mean")) * (s - F.col("_mean"))).over(w)
    rows = chosen.withColumns({"_k": k, "_mean": mean}).withColumn("_ss", apart)
    keep = F.when((F.col("_k") < 3) | (F.col("_ss") <= 0), 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (F.col("_k") - 2) / F.col("_ss")))
    rows = rows.withColumn("_w", F.col("_mean") + keep * (s - F.col("_mean")))
    return rows.withColumn("evidence", F.col("_w") / F.max("_w").over(w)).drop("_k", "_mean", "_ss", "_w")


def spread_scores(rows: DataFrame, fitted: DataFrame, window: int = 60, least: int = 40) -> DataFrame:
    """``z``: the spread's distance from its trailing mean in trailing deviations; NULL without spread."""
    s = rows.join(fitted.select(*PAIR, "alpha", "beta"), PAIR).withColumn("spread", F.col("ly") - F.col("alpha") - F.col("beta") * F.col("lx"))
    mean = rolling(F.avg, F.col("spread"), window, least, tuple(PAIR))
    dev = rolling(F.stddev_samp, F.col("spread"), window, least, tuple(PAIR))
    return s.withColumns({"_m": mean, "_d": dev}).withColumn("z", F.when(F.col("_d") > 1e-12, (F.col("spread") - F.col("_m")) / F.col("_d"))).drop("_m", "_d")


def band_step(entry: float, leave: float, stop: float):
    """Positions of a z-score: the stop and the exit come first, and a bar that exits does not enter."""

    def step(state, row):
        z, held = row["z"], state or 0
        if z is None:
            held = 0
        elif held:
            if abs(z) >= stop or abs(z) <= leave:
                held = 0
        elif z >= entry:
            held = -1
        elif z <= -entry:
            held = 1
        return held, (held,)

    return step


def pair_positions(scores: DataFrame, entry: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> DataFrame:
    return scan_by_key(scores, PAIR, "ts", band_step(entry, leave, stop), {"state": "int"}, ["z"])


def pair_legs(positions: DataFrame, gross: float) -> DataFrame:
    """``(fold, y, x, ts, symbol, weight)``: two legs whose absolute weights add up to ``gross``."""
    unit = F.col("state") * gross / (1 + F.abs("beta"))
    legs = F.array(F.struct(F.col("y").alias("symbol"), unit.alias("weight")), F.struct(F.col("x").alias("symbol"), (-F.col("beta") * unit).alias("weight")))
    return positions.withColumn("leg", F.explode(legs)).select(*PAIR, "ts", "leg.symbol", "leg.weight")


def fold_turnover(chosen: DataFrame) -> DataFrame:
    """``added``, ``dropped`` and their share of the union, of each fold against the one before."""
    now = chosen.select("fold", F.concat_ws("/", "y", "x").alias("pair"))
    both = now.withColumn("_now", F.lit(1)).join(now.withColumns({"fold": F.col("fold") + 1, "_past": F.lit(1)}), ["fold", "pair"], "full")
    # one row: broadcast
    end = now.agg(F.max("fold").alias("_last"))
    last = both.join(F.broadcast(end), F.col("fold") <= F.col("_last"))
    added, dropped = F.count_if(F.col("_past").isNull()), F.count_if(F.col("_now").isNull())
    return last.groupBy("fold").agg(added.alias("added"), dropped.alias("dropped"), ((added + dropped) / F.count("*")).alias("turnover"))


def residual_prices(bars: DataFrame) -> DataFrame:
    """``residual``: the exponential of summed returns less the day's mean return; NULL where the price is."""
    w = ordered("symbol")
    r = bars.withColumn("_r", F.col("close") / F.lag("close").over(w) - 1)
    rest = r.withColumn("_e", F.coalesce(F.col("_r") - F.avg("_r").over(Window.partitionBy("ts")), F.lit(0.0)))
    path = F.exp(F.sum("_e").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rest.withColumn("residual", F.when(F.col("close").isNotNull(), path)).drop("_r", "_e")
