"""Factor residuals and mean-reversion scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.scan import scan_by_key
from barloom.functions.windows import change, clip, median, ordered, rolling
from barloom.operators import tiles
from barloom.operators.features import volume_time_weights
from barloom.sources.bars import dense_panel


def consensus_days(bars: DataFrame, share: float = 0.6) -> DataFrame:
    """``ts`` of the days on which at least ``share`` of the fullest day's symbols have a price."""
    daily = bars.where("close is not null").groupBy("ts").agg(F.count("*").alias("n"))
    top = daily.agg(F.max("n").alias("top")).withColumn("_k", F.lit(1))
    both = daily.withColumn("_k", F.lit(1)).join(F.broadcast(top), "_k")
    return both.where(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("top")))).select("ts")


def top_liquid(bars: DataFrame, formation: int, window: int, n: int) -> DataFrame:
    """The ``n`` symbols with the highest median dollar volume over the last ``window`` rows of the formation."""
    row = F.row_number().over(ordered("symbol"))
    inside = bars.withColumn("_rn", row).where((F.col("_rn") > formation - window) & (F.col("_rn") <= formation))
    liquid = inside.groupBy("symbol").agg(median(F.col("close") * F.col("volume")).alias("dollar_volume"))
    return liquid.where("dollar_volume is not null").orderBy(F.desc("dollar_volume"), "symbol").limit(n)


def eligibility(bars: DataFrame, members: DataFrame | None, corr_window: int, least_price: float, least_dollar: float, factors: tuple[str, ...] = ()) -> DataFrame:
    """``eligible``: enough returns, price and trailing-20 median dollar volume, a member that day and no factor itself.

    ``members(symbol, start, end)`` has intervals with both ends included.
    """
    rows = bars.withColumn("ret", change(F.col("close")))
    known = F.count("ret").over(ordered("symbol").rowsBetween(-(corr_window - 1), 0)) >= corr_window
    rows = rows.withColumn("_dv", F.col("close") * F.col("volume"))
    dollar = rolling(median, F.col("_dv"), 20)
    ok = F.coalesce(known & (F.col("close") >= least_price) & (dollar >= least_dollar), F.lit(False)) & ~F.col("symbol").isin(list(factors))
    rows = rows.withColumn("eligible", ok).drop("_dv")
    if members is not None:
        inside = rows.select("symbol", "ts").join(members, "symbol").where("ts between start and end").select("symbol", "ts").distinct().withColumn("_in", F.lit(True))
        rows = rows.join(inside, ["symbol", "ts"], "left").withColumn("eligible", F.col("eligible") & F.col("_in").isNotNull()).drop("_in")
    return rows


def correlations(returns: DataFrame, rebalances: DataFrame, span: int = 25) -> DataFrame:
    """``(rebalance, a, b, corr)`` for a < b over the days of each rebalance that both have; NULL without variance.

    ``returns(ts, symbol, ret)`` and ``rebalances(rebalance, days)``: trailing
    windows. Symbols meet as blocks, windows as sums over tiles of days, so
    rows are sent once for each pair of blocks and ``span`` windows.
    """
    known = returns.where("ret is not null").select("ts", "symbol", "ret")
    chunks = tiles.window_chunks(rebalances, span)
    packed = tiles.packed_blocks(tiles.chunk_rows(known, chunks), "chunk", "ret", tiles.BLOCK)
    ends = tiles.window_ends(chunks).groupBy("chunk").agg(F.collect_list(F.struct("rebalance", "first", "last")).alias("ends"))
    day = returns.schema["ts"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        days, (left, x), (right, y) = tiles.aligned(frame)
        ends, windows = tiles.ranges(days, pd.DataFrame([dict(e) for e in frame["ends"].iloc[0]]))
        ordered_pair = left[:, None] < right[None, :]
        a, b = np.broadcast_to(left[:, None], ordered_pair.shape), np.broadcast_to(right[None, :], ordered_pair.shape)
        out = []
        for rebalance, m in zip(ends["rebalance"], tiles.sliding_sums(windows, lambda lo, hi: tiles.joint_moments(x[lo:hi], y[lo:hi])), strict=True):
            n, sx, sy, sxx, syy, sxy = m
            keep = ordered_pair & (n > 0)
            n = np.maximum(n, 1)
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            some = (vx > 1e-14 * sxx) & (vy > 1e-14 * syy)
            corr = np.where(some, (sxy - sx * sy / n) / np.sqrt(np.where(some, vx * vy, 1.0)), np.nan)
            out.append(pd.DataFrame({"rebalance": rebalance, "a": a[keep], "b": b[keep], "corr": pd.Series(corr[keep].astype(object)).where(~np.isnan(corr[keep]), None)}))
        return pd.concat(out)

    pairs = tiles.block_pairs(packed.join(ends, "chunk"), "chunk")
    return pairs.groupBy("chunk", "i", "j").applyInPandas(run, f"rebalance {day}, a string, b string, corr double")


def windowed(returns: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Rows of each rebalance's window; the windows are exploded to days, so that the join is on equal days."""
    days = rebalances.withColumn("ts", F.explode("days")).select("rebalance", "ts")
    return returns.where("ret is not null").join(days, "ts").select("rebalance", "ts", "symbol", "ret")


def rebalance_days(calendar: DataFrame, window: int, every: int) -> DataFrame:
    """``(rebalance, days)``: each ``every``-th day from the ``window``-th on, with its trailing days.

    ``calendar(ts)`` has one row for each day of the whole panel.
    """
    w = Window.orderBy("ts")
    rows = calendar.withColumns({"_rn": F.row_number().over(w), "days": F.collect_list("ts").over(w.rowsBetween(-(window - 1), 0))})
    return rows.where((F.col("_rn") >= window) & ((F.col("_rn") - window) % every == 0)).select(F.col("ts").alias("rebalance"), "days")


def eigenportfolios(returns: DataFrame, rebalances: DataFrame, k: int, span: int = 25) -> DataFrame:
    """``(rebalance, factor, symbol, weight, explained)``: the top ``k`` eigenvectors over deviation.

    Symbols must be known on every day of the window; with fewer than k + 2 of
    them there are none. Signs make each eigenvector's sum positive (where it is
    zero, the largest entry); a symbol without variance has weight 0. ``span``
    rebalances are a task, which their rows reach once.
    """
    chunks = tiles.window_chunks(rebalances, span)
    rows = tiles.chunk_rows(returns.where("ret is not null").select("ts", "symbol", "ret"), chunks)
    day = returns.schema["ts"].dataType.simpleString()

    def run(frame: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["rebalance", "factor", "symbol", "weight", "explained"])
        days, symbols, ret = tiles.wide(frame, "ts", "ret")
        ends, windows = tiles.ranges(days, ends)
        # a day that no symbol has is no day of the frame, so a window is as long as its days that are there
        choices = [np.isfinite(ret[lo:hi]).all(axis=0) & (hi > lo) for lo, hi in windows]
        return _long_portfolios(ends["rebalance"], symbols, choices, window_portfolios(ret, windows, choices, k))

    schema = f"rebalance {day}, factor int, symbol string, weight double, explained double"
    return rows.groupBy("chunk").cogroup(tiles.fresh(tiles.window_ends(chunks)).groupBy("chunk")).applyInPandas(run, schema)


def window_portfolios(ret: np.ndarray, windows: list[tuple[int, int]], choices: list[np.ndarray], k: int) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """``(weights, explained)`` of the ``k`` eigenportfolios of each window over its chosen columns; None for fewer than k + 2.

    Windows of more days than symbols are sums over tiles of Gram matrices,
    which slide; others have the same eigenvectors by the smaller product of
    the days.
    """
    filled = np.nan_to_num(ret)
    one = np.column_stack([filled, np.ones(len(filled))])
    tall = [w for w, c in zip(windows, choices, strict=True) if w[1] - w[0] >= len(c)]
    grams = tiles.sliding_sums(tall, lambda lo, hi: one[lo:hi].T @ one[lo:hi])
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for (lo, hi), chosen in zip(windows, choices, strict=True):
        n, gram = hi - lo, next(grams) if hi - lo >= len(chosen) else None
        if chosen.sum() < k + 2:
            out.append(None)
            continue
        if gram is not None:
            mean, part = gram[-1, :-1][chosen] / n, gram[:-1, :-1][np.ix_(chosen, chosen)]
            cov = (part - n * np.outer(mean, mean)) / (n - 1)
            # what is left of a constant by rounding is no variance
            dev = np.sqrt(np.maximum(np.diag(cov), 0)) * (np.diag(cov) * (n - 1) > 1e-13 * np.diag(part))
        else:
            x = filled[lo:hi][:, chosen]
            dev = x.std(axis=0, ddof=1)
        live = dev > 1e-12
        safe = np.where(live, dev, 1.0)
        if gram is not None:
            value, vector = np.linalg.eigh(np.where(np.outer(live, live), cov / np.outer(safe, safe), 0.0))
        else:
            z = np.where(live, (x - x.mean(axis=0)) / safe, 0.0) / np.sqrt(n - 1)
            value, by_day = np.linalg.eigh(z @ z.T)
            vector = z.T @ by_day / np.sqrt(np.maximum(value, 1e-300))
        top = vector[:, ::-1][:, :k].T
        largest = np.take_along_axis(top, np.abs(top).argmax(axis=1)[:, None], axis=1)[:, 0]
        total = top.sum(axis=1)
        top = top * np.where((total < 0) | ((total == 0) & (largest < 0)), -1.0, 1.0)[:, None]
        out.append((np.where(live, top / safe, 0.0), value[::-1][:k] / max(value.sum(), 1e-300)))
    return out


def _long_portfolios(rebalances, symbols: np.ndarray, choices: list[np.ndarray], found: list) -> pd.DataFrame:
    out = [pd.DataFrame(columns=["rebalance", "factor", "symbol", "weight", "explained"])]
    for rebalance, chosen, got in zip(rebalances, choices, found, strict=True):
        if got is not None:
            weight, explained = got
            k, n = weight.shape
            out.append(pd.DataFrame({"rebalance": rebalance, "factor": np.repeat(np.arange(k), n), "symbol": np.tile(symbols[chosen], k), "weight": weight.ravel(), "explained": np.repeat(explained, n)}))
    return pd.concat(out[1:] or out)


def factor_returns(returns: DataFrame, portfolios: DataFrame) -> DataFrame:
    """``(rebalance, factor, ts, f)``: the portfolios' returns on every day, missing returns as 0."""
    joined = portfolios.join(returns, "symbol")
    return joined.groupBy("rebalance", "factor", "ts").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("f"))


def factor_residuals(rows: DataFrame, factors: list[str]) -> DataFrame:
    """``(rebalance, symbol, ts, alpha, betas, residual)``: least squares of ``ret`` on ``factors`` for all symbols of a rebalance at once."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        days = frame.drop_duplicates("ts").sort_values("ts")
        y = frame.pivot(index="ts", columns="symbol", values="ret").loc[days["ts"]].dropna(axis=1)
        a = np.column_stack([np.ones(len(days)), days[factors].to_numpy(float)])
        coef, *_ = np.linalg.lstsq(a, y.to_numpy(), rcond=None)
        left = pd.DataFrame(y.to_numpy() - a @ coef, index=y.index, columns=y.columns).stack().rename("residual").reset_index()
        betas = {s: (float(c[0]), c[1:].tolist()) for s, c in zip(y.columns, coef.T, strict=True)}
        left["alpha"] = [betas[s][0] for s in left["symbol"]]
        left["betas"] = [betas[s][1] for s in left["symbol"]]
        left.insert(0, "rebalance", frame["rebalance"].iloc[0])
        return left[["rebalance", "symbol", "ts", "alpha", "betas", "residual"]]

    return rows.groupBy("rebalance").applyInPandas(run, "rebalance date, symbol string, ts date, alpha double, betas array<double>, residual double")


def one_factor_residuals(rows: DataFrame, keys: list[str], ret: str = "ret", factor: str = "f") -> DataFrame:
    """The same with one factor, by built-in regressions over each key."""
    w = Window.partitionBy(*keys)
    fitted = rows.withColumns({"beta": F.regr_slope(ret, factor).over(w), "alpha": F.regr_intercept(ret, factor).over(w)})
    return fitted.withColumn("residual", F.col(ret) - F.col("alpha") - F.col("beta") * F.col(factor))


def ou_fit(residuals: DataFrame, keys: list[str]) -> DataFrame:
    """``b, m, sigma_eq, half_life, x_end, valid`` of the summed ``residual`` of each key.

    Valid fits revert (0 < b < 1) and have an equilibrium deviation above 1e-9.
    """
    w = Window.partitionBy(*keys).orderBy("ts")
    path = residuals.withColumn("_x", F.sum("residual").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    step = path.withColumn("_before", F.lag("_x").over(w))
    known = F.when(F.col("_before").isNotNull(), F.col("_x"))
    fit = step.groupBy(*keys).agg(
        F.regr_slope("_x", "_before").alias("b"), F.regr_intercept("_x", "_before").alias("a"), F.max_by("_x", "ts").alias("x_end"),
        F.regr_syy(known, "_before").alias("_yy"), F.regr_sxy(known, "_before").alias("_xy"), F.count(known).alias("_n"),
    )
    var = (F.col("_yy") - F.col("b") * F.col("_xy")) / (F.col("_n") - 2)
    inside = (F.col("b") > 0) & (F.col("b") < 1)
    fit = fit.withColumns({
        "m": F.when(inside, F.col("a") / (1 - F.col("b"))), "sigma_eq": F.when(inside, F.sqrt(F.greatest(var, F.lit(0.0)) / (1 - F.col("b") * F.col("b")))),
        "half_life": F.when(inside, -math.log(2) / F.log("b")),
    })
    return fit.withColumn("valid", F.coalesce(inside & (F.col("sigma_eq") > 1e-9), F.lit(False))).select(*keys, "b", "a", "m", "sigma_eq", "half_life", "x_end", "valid")


def s_score(fit: DataFrame, alpha: str | None = None) -> DataFrame:
    """``sscore``: distance from the mean, less the drift where ``alpha`` is given, in equilibrium deviations."""
    drift = F.col(alpha) / -F.log("b") if alpha else F.lit(0.0)
    return fit.withColumn("sscore", F.when(F.col("valid"), (F.col("x_end") - F.col("m") - drift) / F.col("sigma_eq")))


def reversion_step(long_in: float = -1.25, long_out: float = -0.5, short_in: float = 1.25, short_out: float = 0.75):
    """Positions of an s-score: exits first, and a bar that exits may enter again; not ok is flat."""

    def step(state, row):
        held, s = state or 0, row["sscore"]
        if not row["ok"] or s is None:
            return 0, (0,)
        if (held == 1 and s > long_out) or (held == -1 and s < short_out):
            held = 0
        if held == 0:
            held = 1 if s < long_in else -1 if s > short_in else 0
        return held, (held,)

    return step


def reversion_positions(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scan_by_key(scores, keys, "ts", reversion_step(), {"state": "int"}, ["ok", "sscore"])


def residual_book(states: DataFrame, loadings: DataFrame, portfolios: DataFrame, unit: float, scale: str | None = None) -> DataFrame:
    """``(ts, symbol, weight)``: stock legs and the hedge of their factor exposures.

    ``states(ts, symbol, state)``, ``loadings(ts, symbol, factor, beta)`` and
    ``portfolios(ts, factor, symbol, weight)``.
    """
    size = F.lit(unit) * (F.col(scale) if scale else F.lit(1.0))
    legs = states.where("state <> 0").withColumn("weight", F.col("state") * size).select("ts", "symbol", "weight")
    exposure = legs.join(loadings, ["ts", "symbol"]).groupBy("ts", "factor").agg(F.sum(F.col("weight") * F.col("beta")).alias("exposure"))
    hedge = exposure.join(portfolios, ["ts", "factor"]).select("ts", "symbol", (-F.col("exposure") * F.col("weight")).alias("weight"))
    return legs.unionByName(hedge).groupBy("ts", "symbol").agg(F.sum("weight").alias("weight"))


def conviction(sscore: Column, entry: float, cap: float) -> Column:
    return F.coalesce(clip((F.abs(sscore) - entry) / entry, 0.0, cap), F.lit(0.0))


def cost_aware_band(half_life: Column, cost: float, risk: float) -> Column:
    """No-trade band from cost and speed of reversion; 0 where the half-life is unknown."""
    return F.coalesce(F.when(half_life > 0, risk * F.sqrt(F.lit(cost) / (math.log(2) / half_life))), F.lit(0.0))


def signal_health(panel: DataFrame, max_half_life: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``evaluations`` (active rows), the shares of them that are invalid and slow, and the share of all candidates that is not active."""
    active = F.coalesce(F.col("active"), F.lit(False))
    n = F.count_if(active)
    return panel.groupBy(*keys).agg(
        n.alias("evaluations"), (F.count_if(active & ~F.col("valid")) / F.nullif(n, F.lit(0))).alias("invalid_rate"),
        (F.count_if(active & F.col("valid") & (F.col("half_life") > max_half_life)) / F.nullif(n, F.lit(0))).alias("slow_rate"), (F.count_if(~active) / F.nullif(F.count("*"), F.lit(0))).alias("missing_rate"),
    )


def last_half_life(scores: DataFrame, days: DataFrame) -> DataFrame:
    """``(fold, symbol, half_life)``: the last one known before each fold's test; ``days(fold, ts, formation)``."""
    starts = days.where("not formation").groupBy("fold").agg(F.min("ts").alias("_start"))
    known = scores.where("half_life is not null").select("symbol", "ts", "half_life")
    # a row for each fold: broadcast, so that the panel stays where it is
    return known.join(F.broadcast(starts), F.col("ts") < F.col("_start")).groupBy("fold", "symbol").agg(F.max_by("half_life", "ts").alias("half_life"))


@dataclass(frozen=True)
class ResidualSpec:
    """Windows, screens and factors of a residual panel; ``funds`` are the factors if given, else eigenportfolios are."""

    corr_window: int = 252
    regr_window: int = 60
    factors: int = 15
    every: int = 5
    least_price: float = 5.0
    least_dollar: float = 1e6
    max_half_life: float = 30.0
    volume_time: bool = False
    volume_window: int = 60
    volume_clip: float = 4.0
    funds: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.corr_window < 20 or not 5 <= self.regr_window <= self.corr_window:
            raise ValueError("windows are too short, or the regression window exceeds the correlation window")
        if self.regr_window < self.k + 5:
            raise ValueError("the regression needs five rows more than it has factors")
        if self.every < 1 or self.factors < 1 or self.max_half_life <= 0 or self.volume_clip <= 1 or self.volume_window < 2:
            raise ValueError("a parameter is out of range")
        if len(set(self.funds)) != len(self.funds):
            raise ValueError("funds must be unique")

    @property
    def k(self) -> int:
        return len(self.funds) or self.factors

    @property
    def warmup(self) -> int:
        return self.corr_window + self.regr_window

    @property
    def span(self) -> int:
        """Rebalances of a task: their days are at least half of the window that precedes them."""
        return math.ceil(self.corr_window / (2 * self.every))


@dataclass(frozen=True)
class ResidualPanel:
    """``scores(ts, symbol, rebalance, active, valid, sscore, half_life, tradeable, betas)``: a row for each candidate of each bar,

    ``portfolios(rebalance, factor, symbol, weight, explained)`` and
    ``rebalances(rebalance, pos, eligible, used)``.
    """

    spec: ResidualSpec
    scores: DataFrame
    portfolios: DataFrame
    rebalances: DataFrame


def residual_panel(bars: DataFrame, spec: ResidualSpec, members: DataFrame | None = None) -> ResidualPanel:
    """Mean-reversion scores of every bar, each from what was known by then.

    ``bars(symbol, ts, close, volume)`` on trading days; days without a bar
    count as missing. Every ``every`` bars from the first full correlation
    window on, eigenportfolios are estimated over the symbols that are
    eligible then; below k + 2 of them the rebalance is skipped. The
    cross-section stays until the next rebalance. On each bar after the
    warm-up, candidates are its symbols that are still eligible; those with a
    whole regression window are active: least squares on the factor returns
    (0 for missing returns of their members) and mean reversion of the summed
    residuals. With ``volume_time`` the regression explains returns weighted
    by volume. A task has ``spec.span`` rebalances: the days from the first of
    them to the next task's first, and one correlation window before, so that
    the panel is sent three times at most, however often it is rebalanced.
    """
    days = bars.select("ts").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("ts")) - 1).cast("int"))
    dense = dense_panel(bars, ["close", "volume"])
    rows = eligibility(dense, members, spec.corr_window, spec.least_price, spec.least_dollar, spec.funds)
    if spec.volume_time:
        rows = volume_time_weights(rows, spec.volume_window, spec.volume_clip).withColumn("dep", F.col("ret") * F.col("volume_weight"))
    else:
        rows = rows.withColumn("dep", F.col("ret"))
    rows = rows.join(days, "ts").select("pos", "ts", "symbol", "ret", "dep", "eligible")
    n = days.count()

    first = spec.warmup if spec.funds else spec.corr_window
    starts = rows.where((F.col("pos") >= first) & ((F.col("pos") - first) % spec.every == 0)).groupBy("pos").agg(F.min("ts").alias("rebalance"), F.count_if("eligible").alias("eligible"))
    used = F.lit(True) if spec.funds else F.col("eligible") >= spec.k + 2
    rebalances = starts.withColumn("used", used)
    ahead = Window.orderBy("pos")
    live = rebalances.where("used").select("rebalance", "pos", (F.coalesce(F.lead("pos").over(ahead), F.lit(n)) - 1).cast("int").alias("hi"))
    live = live.withColumn("chunk", F.floor((F.row_number().over(ahead) - 1) / spec.span).cast("int"))

    reach = live.groupBy("chunk").agg(F.min("pos").alias("lo"), F.max("hi").alias("hi"))
    halo = (spec.regr_window if spec.funds else spec.corr_window) - 1
    inside = rows.join(reach.select("chunk", F.explode(F.sequence(F.greatest(F.col("lo") - halo, F.lit(0)), "hi")).alias("pos")), "pos")
    turns = tiles.fresh(live).groupBy("chunk")
    parts = inside.groupBy("chunk")
    if spec.funds:
        place = F.create_map(*(F.lit(x) for i, s in enumerate(spec.funds) for x in (s, i)))
        held = F.explode(F.array(*(F.lit(s) for s in spec.funds)))
        portfolios = live.select("rebalance", held.alias("symbol")).select("rebalance", place[F.col("symbol")].alias("factor"), "symbol", F.lit(1.0).alias("weight"), F.lit(None).cast("double").alias("explained"))
    else:
        portfolios = parts.cogroup(turns).applyInPandas(_chunk_portfolios(spec), "rebalance date, factor int, symbol string, weight double, explained double")
    return ResidualPanel(spec, parts.cogroup(turns).applyInPandas(_score_bars(spec), _SCORES), portfolios, rebalances)


_SCORES = "ts date, symbol string, rebalance date, active boolean, valid boolean, sscore double, half_life double, tradeable boolean, betas array<double>"


def ou_batch(residuals: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(valid, half_life, sscore)`` of the columns of ``residuals``; NaN where there is none."""
    path = np.cumsum(residuals, axis=0)
    before, after = path[:-1], path[1:]
    x, y = before - before.mean(axis=0), after - after.mean(axis=0)
    xx = (x * x).sum(axis=0)
    b = np.divide((x * y).sum(axis=0), xx, out=np.full(len(xx), np.nan), where=xx > 1e-300)
    inside = (b > 0) & (b < 1)
    safe = np.where(inside, b, 0.5)
    a = after.mean(axis=0) - safe * before.mean(axis=0)
    noise = after - a - safe * before
    sigma = np.sqrt((noise * noise).sum(axis=0) / (len(noise) - 2) / (1 - safe * safe))
    valid = inside & (sigma > 1e-9)
    score = (path[-1] - a / (1 - safe) - alpha / -np.log(safe)) / np.where(valid, sigma, 1.0)
    return valid, np.where(inside, -math.log(2) / np.log(safe), np.nan), np.where(valid, score, np.nan)


def _chunk_of(spec: ResidualSpec, frame: pd.DataFrame, turns: pd.DataFrame) -> tuple:
    """``(days, symbols, ret, dep, eligible, turns, portfolios)`` of a chunk; a portfolio is None or its columns, weights and explained shares."""
    days, symbols, ret, dep, eligible = tiles.wide(frame, "pos", "ret", "dep", "eligible")
    eligible = eligible == 1
    turns = turns.sort_values("pos")
    at = np.searchsorted(days, turns["pos"].to_numpy())
    if spec.funds:
        weight = np.array([(symbols == f).astype(float) for f in spec.funds])
        stocks = ~np.isin(symbols, spec.funds)
        return days, symbols, ret, dep, eligible, turns, [(stocks, weight, None)] * len(turns)
    choices = [eligible[i] for i in at]
    found = window_portfolios(ret, [(int(i) + 1 - spec.corr_window, int(i) + 1) for i in at], choices, spec.k)
    spread = []
    for chosen, got in zip(choices, found, strict=True):
        weight = np.zeros((spec.k, len(symbols)))
        if got is not None:
            weight[:, chosen] = got[0]
        spread.append(None if got is None else (chosen, weight, got[1]))
    return days, symbols, ret, dep, eligible, turns, spread


def _chunk_portfolios(spec: ResidualSpec):
    def run(frame: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
        _, symbols, _, _, _, turns, portfolios = _chunk_of(spec, frame, turns)
        found = [None if p is None else (p[1][:, p[0]], p[2]) for p in portfolios]
        return _long_portfolios(turns["rebalance"], symbols, [p and p[0] for p in portfolios], found)

    return run


def _score_bars(spec: ResidualSpec):
    w = spec.regr_window

    def run(frame: pd.DataFrame, turns: pd.DataFrame) -> pd.DataFrame:
        days, symbols, ret, dep, eligible, turns, portfolios = _chunk_of(spec, frame, turns)
        ts = frame.drop_duplicates("pos").set_index("pos")["ts"]
        filled, known = np.nan_to_num(ret), np.isfinite(ret)
        out = []
        for rebalance, lo, hi, portfolio in zip(turns["rebalance"], turns["pos"], turns["hi"], portfolios, strict=True):
            if portfolio is None:
                continue
            section, weight, _ = portfolio
            first = max(0, np.searchsorted(days, lo) + 1 - w)
            factor = filled[first : np.searchsorted(days, hi, side="right")] @ weight.T
            for pos in range(max(lo, spec.warmup), hi + 1):
                i = int(np.searchsorted(days, pos))
                if i + 1 < w or i >= len(days) or days[i] != pos:
                    continue
                open_ = section & eligible[i]
                if not open_.any():
                    continue
                whole = known[i + 1 - w : i + 1].all(axis=0)
                active, missing = np.flatnonzero(open_ & whole), np.flatnonzero(open_ & ~whole)
                part = pd.DataFrame({"symbol": symbols[np.concatenate((active, missing))], "active": np.arange(len(active) + len(missing)) < len(active)})
                a = np.column_stack([np.ones(w), factor[i + 1 - w - first : i + 1 - first]])
                y = dep[i + 1 - w : i + 1][:, active]
                coef, *_ = np.linalg.lstsq(a, y, rcond=None)
                valid, life, score = ou_batch(y - a @ coef, coef[0])
                pad = np.full(len(missing), np.nan)
                fast = valid & (life <= spec.max_half_life)
                none = np.zeros(len(missing), dtype=bool)
                part["valid"], part["sscore"], part["half_life"] = np.concatenate((valid, none)), np.concatenate((score, pad)), np.concatenate((life, pad))
                part["tradeable"] = np.concatenate((fast & np.isfinite(score), none))
                part["betas"] = [*coef[1:].T.tolist(), *([None] * len(missing))]
                out.append(part.assign(ts=ts[pos], rebalance=rebalance))
        names = ["ts", "symbol", "rebalance", "active", "valid", "sscore", "half_life", "tradeable", "betas"]
        if not out:
            return pd.DataFrame(columns=names)
        found = pd.concat(out)[names]
        return found.astype({"sscore": object, "half_life": object}).where(found.notna(), None)

    return run
