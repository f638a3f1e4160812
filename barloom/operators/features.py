"""Causal indicators, lags and labels of bars, all partitioned by symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.windows import change, clip, ordered, rolling, so_far, trailing

TINY = 1e-10
#: Indicator windows, lags and label prefixes.
MEANS, SPANS, SPREADS, LAGS = (5, 10, 20, 50), (5, 10, 20), (5, 10, 20), (1, 2, 5, 10)
LABEL_PREFIXES = ("target_", "direction_", "pct_change_")


def _columns() -> tuple[Column, Column, Column, Column, Column]:
    return F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume")


def indicators(bars: DataFrame) -> DataFrame:
    """Every windowed indicator except exponential means, in two selections over one sort of each symbol."""
    o, h, lo, c, v = _columns()
    w = ordered("symbol")
    before, step = F.lag(c).over(w), c - F.lag(c).over(w)
    typical = (h + lo + c) / 3
    up = F.when(step > 0, step).otherwise(0.0)
    down = F.when(step < 0, -step).otherwise(0.0)
    true_range = F.greatest(h - lo, F.abs(h - before), F.abs(lo - before))
    flow, moved = typical * v, typical - F.lag(typical).over(w)
    first = bars.withColumns({
        "_up": up, "_down": down, "_range": (h - lo) / c, "_tr": true_range,
        "_in": F.when(moved > 0, flow).otherwise(0.0), "_out": F.when(moved < 0, flow).otherwise(0.0),
        "price_change": change(c), "price_change_5": change(c, 5), "price_change_10": change(c, 10),
        "volume_change": change(v), "price_volume_ratio": c / (v + 1), "gap": (o - before) / before,
        "daily_range": (h - lo) / c, "roc_5": change(c, 5) * 100, "roc_10": change(c, 10) * 100,
        "doji": F.coalesce(((F.abs(o - c) / (h - lo + TINY) < 0.1) & ((h - lo) / lo > 0.01)).cast("int"), F.lit(0)),
        **{f"direction_{k}": F.when(c - F.lag(c, k).over(w) > 0, 1).otherwise(-1) for k in (1, 5, 10)},
    })
    middle, spread = rolling(F.avg, c, 20), rolling(F.stddev_samp, c, 20)
    gain, loss = rolling(F.avg, F.col("_up"), 14), rolling(F.avg, F.col("_down"), 14)
    inward, outward = rolling(F.sum, F.col("_in"), 14), rolling(F.sum, F.col("_out"), 14)
    return first.withColumns({
        **{f"ma{n}": rolling(F.avg, c, n) for n in MEANS},
        **{f"volatility_{n}": rolling(F.stddev_samp, c, n) for n in SPREADS},
        "volume_ma5": rolling(F.avg, v, 5), "volume_ma10": rolling(F.avg, v, 10),
        "rsi_14": 100 - 100 / (1 + gain / (loss + TINY)),
        "bb_middle": middle, "bb_upper": middle + 2 * spread, "bb_lower": middle - 2 * spread, "bb_width": 4 * spread / middle,
        "daily_range_ma5": rolling(F.avg, F.col("_range"), 5), "atr_14": rolling(F.avg, F.col("_tr"), 14),
        "mfi_14": 100 - 100 / (1 + inward / (outward + TINY)),
    }).drop("_up", "_down", "_range", "_tr", "_in", "_out")


#: Known values of a block. What is older than a whole block has lost its weight: 1e-17 of it is left at a span of 26.
BLOCK = 512


def exponential_means(bars: DataFrame) -> DataFrame:
    """``ema5/10/20``, ``macd`` (12 less 26), its signal (9) and histogram; a missing close carries the last ones on.

    A mean starts with the first value and then moves by 2 / (span + 1) of
    the way to each new one. Within a block of known values it is a decayed
    running sum, and the end of the block before comes in with its weight, so
    built-in windows give it.
    """
    seen = F.count("close").over(so_far("symbol")) - 1
    rows = bars.withColumn("_k", seen)
    rows = rows.withColumns({"_b": F.floor(F.col("_k") / BLOCK), "_j": F.when(F.col("close").isNotNull(), F.col("_k") % BLOCK)})
    rows = _decayed(rows, {f"ema{s}": ("close", s) for s in (*SPANS, 12, 26)})
    rows = _decayed(rows.withColumn("macd", F.col("ema12") - F.col("ema26")), {"macd_signal": ("macd", 9)})
    return rows.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).select(*bars.columns, *(f"ema{s}" for s in SPANS), "macd", "macd_signal", "macd_hist")


def _decayed(rows: DataFrame, wanted: dict[str, tuple[str, int]]) -> DataFrame:
    """``rows`` with the exponential means ``name: (column, span)``; ``_k`` numbers the known values, ``_j`` those of the block ``_b``."""
    inside = Window.partitionBy("symbol", "_b").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    before = ordered("symbol").rowsBetween(Window.unboundedPreceding, -1)
    keep = {name: F.lit(1 - 2 / (span + 1)) for name, (_, span) in wanted.items()}
    weighed = {n: F.when(F.col("_k") == 0, F.col(c)).otherwise((1 - keep[n]) * F.col(c)) for n, (c, _) in wanted.items()}
    rows = rows.withColumns({f"_{n}": F.pow(keep[n], F.col("_j")) * F.sum(weighed[n] * F.pow(keep[n], -F.col("_j"))).over(inside) for n in wanted})
    ends = {f"_e_{n}": F.last(F.when(F.col("_j") == BLOCK - 1, F.col(f"_{n}")), ignorenulls=True).over(before) for n in wanted}
    rows = rows.withColumns(ends).withColumns({f"_{n}": F.col(f"_{n}") + F.pow(keep[n], F.col("_j") + 1) * F.coalesce(f"_e_{n}", F.lit(0.0)) for n in wanted})
    return rows.withColumns({n: F.last(f"_{n}", ignorenulls=True).over(so_far("symbol")) for n in wanted})


def is_label(name: str) -> bool:
    return name.startswith(LABEL_PREFIXES)


def without_labels(frame: DataFrame) -> DataFrame:
    """``frame`` as a model may see it: no column that tells the future."""
    return frame.drop(*(c for c in frame.columns if is_label(c)))


def lagged(frame: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """``{column}_lag{p}`` of every numeric column that is not a label, in one selection; p <= 0 is skipped."""
    numeric = [f.name for f in frame.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long") and not is_label(f.name)]
    w = ordered("symbol")
    return frame.select("*", *(F.lag(c, p).over(w).alias(f"{c}_lag{p}") for c in numeric for p in lags if p > 0))


def with_labels(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """``target_h``, ``direction_h`` and ``pct_change_h``; NULL where the horizon passes the last bar."""
    w, c, out = ordered("symbol"), F.col("close"), {}
    for h in horizons:
        ahead = F.lead(c, h).over(w)
        out |= {f"target_{h}": ahead, f"direction_{h}": F.when(ahead > c, 1).when(ahead <= c, -1), f"pct_change_{h}": (ahead - c) / c}
    return bars.withColumns(out)


def realized_vol(bars: DataFrame, rows: int = 20, floor: float = 5e-3, back_fill: bool = True) -> DataFrame:
    """``sigma``: trailing deviation of log returns, at least ``floor``.

    The warm-up takes the first known value, which looks ahead; turn
    ``back_fill`` off to leave it NULL.
    """
    w = ordered("symbol")
    logs = bars.withColumn("_r", F.log(F.col("close") / F.lag("close").over(w)))
    raw = logs.withColumn("_s", rolling(F.stddev_samp, F.col("_r"), rows, max(2, rows // 4)))
    if back_fill:
        back = Window.partitionBy("symbol").orderBy(F.desc("ts")).rowsBetween(Window.unboundedPreceding, 0)
        raw = raw.withColumn("_s", F.last("_s", ignorenulls=True).over(back))
    return raw.withColumn("sigma", F.when(F.col("_s").isNotNull(), F.greatest("_s", F.lit(floor)))).drop("_r", "_s")


def volume_time_weights(bars: DataFrame, rows: int = 20, limit: float = 3.0) -> DataFrame:
    """``volume_weight``: trailing mean volume over volume, within [1/limit, limit], 1 where unknown."""
    v = F.when(F.col("volume") > 0, F.col("volume"))
    ratio = rolling(F.avg, v, rows, max(2, rows // 2)) / v
    return bars.withColumn("volume_weight", F.coalesce(clip(ratio, 1 / limit, limit), F.lit(1.0)))


def drawdown(values: DataFrame, value: str = "value", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``drawdown`` from the running peak, ``cum_return`` from the first value and ``period_return``."""
    x = F.col(value)
    peak, start = F.max(x).over(so_far(*keys)), F.first(x).over(so_far(*keys))
    return values.withColumns({"drawdown": 1 - x / peak, "cum_return": x / start - 1, "period_return": change(x, 1, keys)})


def baseline_positions(bars: DataFrame, fast: int = 20, slow: int = 50, lookback: int = 60) -> DataFrame:
    """Positions of buy-and-hold, moving-average crossover and time-series momentum."""
    if fast >= slow:
        raise ValueError("fast must be below slow")
    c = F.col("close")
    cross = F.signum(rolling(F.avg, c, fast) - rolling(F.avg, c, slow))
    trend = F.signum(change(c, lookback))
    return bars.withColumns({"hold": F.lit(1.0), "ma_cross": F.coalesce(cross, F.lit(0.0)), "tsmom": F.coalesce(trend, F.lit(0.0))})


def trailing_windows(bars: DataFrame, rows: int) -> DataFrame:
    """``window``: the last ``rows`` bars up to each one, as an array of structs."""
    return bars.withColumn("window", F.collect_list(F.struct("ts", "close")).over(trailing(rows, "symbol")))
