"""Forecast members, their blend into positions, and how the blend is judged."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.windows import clip, compounded, ordered
from barloom.operators.boosting import boosted_folds


def return_position(ret: Column, sigma: Column, target_vol: float, cap: float) -> Column:
    """Position of a forecast return: target volatility times return over volatility, within +-cap."""
    return clip(target_vol * ret / sigma, -cap, cap)


def price_position(price: Column, forecast: Column, sigma: Column, target_vol: float, cap: float) -> Column:
    return return_position((forecast - price) / price, sigma, target_vol, cap)


def ideal_positions(bars: DataFrame, horizon: int, target_vol: float, cap: float) -> DataFrame:
    """``ideal``: the position of perfect foresight; ``bars`` need ``sigma``."""
    ahead = F.lead("close", horizon).over(ordered("symbol"))
    return bars.withColumn("ideal", return_position((ahead - F.col("close")) / F.col("close"), F.col("sigma"), target_vol, cap))


def blend(member_positions: DataFrame, members: DataFrame, cap: float, renormalize: bool = True) -> DataFrame:
    """``(symbol, ts, position)`` from ``(symbol, ts, member, pos)`` and ``members(member, kind, weight)``.

    Members with a positive weight count; their sum is divided by the weights'
    sum where that differs from 1 (not for the conviction score). Without any
    weight the plain mean holds.
    """
    joined = member_positions.where("pos is not null").join(F.broadcast(members), "member")
    w = F.when(F.col("weight") > 0, F.col("weight"))
    total, weighted = F.sum(w), F.sum(w * F.col("pos"))
    mean = weighted / total if renormalize else weighted
    pos = F.when(F.coalesce(total, F.lit(0.0)) == 0, F.avg("pos")).otherwise(mean)
    return joined.groupBy("symbol", "ts").agg(clip(pos, -cap, cap).alias("position"))


def contributions(member_positions: DataFrame, members: DataFrame) -> DataFrame:
    """Long table of each member's position, weight and contribution."""
    return member_positions.join(F.broadcast(members), "member").withColumn("contrib", F.col("pos") * F.col("weight"))


def agreement(member_positions: DataFrame) -> DataFrame:
    """``agreement``: the size of the mean sign of the positions that are not zero."""
    sign = F.when(F.col("pos") != 0, F.signum("pos"))
    return member_positions.groupBy("symbol", "ts").agg(F.coalesce(F.abs(F.avg(sign)), F.lit(0.0)).alias("agreement"))


def confidence(blended: DataFrame, agreed: DataFrame) -> DataFrame:
    return blended.join(agreed, ["symbol", "ts"]).withColumn("confidence", 0.5 * F.abs("position") + 0.5 * F.col("agreement"))


def sentiment_overlay(blended: DataFrame) -> DataFrame:
    """Position and confidence with news: ``score`` and ``momentum`` beside ``position`` and ``confidence``."""
    s, m = F.coalesce("score", F.lit(0.0)), F.coalesce("momentum", F.lit(0.0))
    tone = clip((s + m) / 3, -1.0, 1.0)
    return blended.withColumns({
        "position": clip(0.7 * F.col("position") + 0.3 * tone, -1.0, 1.0),
        "confidence": F.col("confidence") + F.least(F.lit(0.2), (F.abs(s) + F.abs(m)) / 10),
    })


def signals(blended: DataFrame, threshold: float, cap: float, band: str | None = None) -> DataFrame:
    """``signal`` LONG, SHORT or FLAT; a band's width lowers the confidence."""
    p = F.col("position")
    out = blended.withColumn("signal", F.when(p > threshold, "LONG").when(p < -threshold, "SHORT").otherwise("FLAT"))
    if band:
        out = out.withColumn("confidence", F.col("confidence") * F.greatest(F.lit(0.0), 1 - F.col(band) / (2 * cap)))
    return out


def signal_label(value: Column) -> Column:
    """Five labels by the ladder -1, -.5, 0, .5, 1; what is below the ladder has the last label, as the source has it."""
    return (
        F.when(value < -1, "Strong Buy").when(value < -0.5, "Strong Sell").when(value < 0, "Sell").when(value < 0.5, "Hold").when(value < 1, "Buy").otherwise("Strong Buy")
    )


def flat_forecast(last_positions: DataFrame, horizon: int) -> DataFrame:
    """The last position repeated for the next calendar days, without a close."""
    return last_positions.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).select(
        "symbol", F.date_add("ts", F.col("k")).alias("ts"), "position", F.lit(None).cast("double").alias("close")
    )


def reward_stream(positions: DataFrame, cost: float, scale: float, start: float = 1.0) -> DataFrame:
    """``reward`` of holding each position for a bar less the cost of getting there, and the compounded ``balance``."""
    w, c, p = ordered("symbol"), F.col("close"), F.col("position")
    before = F.coalesce(F.lag("position").over(w), F.lit(0.0))
    raw = p * (F.lead("close").over(w) - c) / c - cost * F.abs(p - before)
    rows = positions.withColumn("_r", raw).withColumn("reward", F.col("_r") * scale)
    grown = compounded(F.col("_r")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("balance", F.when(F.col("_r").isNotNull(), start * grown)).drop("_r")


def evaluate(judged: DataFrame, keys: list[str]) -> DataFrame:
    """MAE, MSE, RMSE and R2 of ``position`` against ``ideal``; NULL below two rows."""
    ok = F.col("position").isNotNull() & F.col("ideal").isNotNull()
    e = F.when(ok, F.col("position") - F.col("ideal"))
    n, mse = F.count(e), F.avg(e * e)
    spread = F.var_pop(F.when(ok, F.col("ideal")))
    enough = lambda x: F.when(n >= 2, x)
    return judged.groupBy(*keys).agg(
        n.alias("n"), enough(F.avg(F.abs(e))).alias("mae"), enough(mse).alias("mse"), enough(F.sqrt(mse)).alias("rmse"), enough(F.when(spread > 0, 1 - mse / spread)).alias("r2")
    )


def _onto_simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with w >= 0 and sum w <= 1."""
    w = np.maximum(v, 0)
    if w.sum() <= 1:
        return w
    u = np.sort(v)[::-1]
    over = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - over[np.flatnonzero(u > over)[-1]], 0)


def simplex_weights(gram: np.ndarray, cross: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Minimise w'Gw - 2c'w over w >= 0, sum w <= 1.

    Projected gradient steps with momentum find the active members; their
    equations are then solved as such, on the edge of the simplex or inside.
    """
    k = len(cross)
    loss = lambda w: w @ gram @ w - 2 * cross @ w
    top = float(np.linalg.eigvalsh(gram)[-1]) if k else 0.0
    if top <= 0:
        return np.zeros(k)
    best = w = ahead = np.zeros(k)
    pace = 1.0
    for _ in range(rounds):
        following = _onto_simplex(ahead - (gram @ ahead - cross) / top)
        if loss(following) > loss(w):  # momentum went too far
            following, pace = _onto_simplex(w - (gram @ w - cross) / top), 1.0
        quicker = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, moved = following + (pace - 1) / quicker * (following - w), np.abs(following - w).max()
        w, pace = following, quicker
        if moved < 1e-13:
            break
    best = w
    i = np.flatnonzero(w > 1e-7)
    if len(i):
        g, c, size = gram[np.ix_(i, i)], cross[i], len(i)
        edge = np.block([[g, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]])
        for tried in (np.linalg.lstsq(g, c, rcond=None)[0], np.linalg.lstsq(edge, np.append(c, 1.0), rcond=None)[0][:size]):
            full = np.zeros(k)
            full[i] = tried
            if (tried >= 0).all() and tried.sum() <= 1 + 1e-12 and loss(full) <= loss(best) + 1e-15:
                best = full
    return best


def meta_weights_by(oof: DataFrame, members: list[str], keys: list[str], default: list[float]) -> DataFrame:
    """``(*keys, member, weight)``: weights of the members' out-of-fold positions against ``ideal`` for each key, such as a fold.

    Each task adds up the moments of its rows by key, so what meets in one
    place is a matrix of members for each task. Fewer than five complete rows
    keep the default.
    """
    k = len(members)
    kinds = [f"`{c}` {oof.schema[c].dataType.simpleString()}" for c in keys]
    full = oof.dropna(subset=[*members, "ideal"]).select(*keys, *(F.col(c).cast("double") for c in [*members, "ideal"]))

    def moments(frames):
        total: dict = {}
        for frame in frames:
            for key, part in frame.groupby(keys, dropna=False):
                x = part[[*members, "ideal"]].to_numpy(float)
                total[key] = total.get(key, 0.0) + np.append(x.T @ x, len(x))
        if total:
            yield pd.DataFrame([(*key, m.tolist()) for key, m in total.items()], columns=[*keys, "m"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.sum(np.stack(frame["m"].to_numpy()), axis=0)
        gram, n = m[:-1].reshape(k + 1, k + 1), m[-1]
        w = simplex_weights(gram[:k, :k] / n, gram[:k, k] / n) if n >= 5 else np.array(default, float)
        return pd.DataFrame({**{c: [frame[c].iloc[0]] * k for c in keys}, "member": members, "weight": w})

    sums = full.mapInPandas(moments, ", ".join([*kinds, "m array<double>"]))
    return sums.groupBy(*keys).applyInPandas(solve, ", ".join([*kinds, "member string, weight double"]))


def meta_weights(oof: DataFrame, members: list[str], default: list[float]) -> list[float]:
    """The same over all rows as a list; the default without rows."""
    found = {r["member"]: r["weight"] for r in meta_weights_by(oof.withColumn("_all", F.lit(0)), members, ["_all"], default).collect()}
    return [found[m] for m in members] if found else default


def boosted_forecast(train: DataFrame, test: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """``(predictions, importance)`` of gradient-boosted trees over all symbols; missing features are 0, missing labels the training mean."""
    one = lambda df, role: df.withColumns({"_fold": F.lit(0), "_role": F.lit(role)})
    rows = one(train, "train").unionByName(one(test, "test"), allowMissingColumns=True)
    predicted, importance = boosted_folds(rows, features, label, rounds, depth, fold="_fold", role="_role")
    return predicted.drop("_fold", "_role"), importance.drop("_fold").orderBy(F.desc("importance"), "feature")


def autoregression(series: DataFrame, most: int = 2) -> DataFrame:
    """``(symbol, p, d, aic, coefficients, forecast)``: AR(p) with d differences chosen by AIC, least squares for each symbol.

    ``series(symbol, ts, x)``; a symbol is one task. Orders run over p <= most
    and d in {0, 1}; the forecast is the next value.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values("ts")["x"].dropna().to_numpy(float)
        best = None
        for d in (0, 1):
            y = np.diff(x, n=d)
            for p in range(most + 1):
                if len(y) < most + p + 5:
                    continue
                target = y[most:]
                a = np.column_stack([np.ones(len(target)), *(y[most - k : len(y) - k] for k in range(1, p + 1))])
                coef, *_ = np.linalg.lstsq(a, target, rcond=None)
                left = target - a @ coef
                aic = len(target) * np.log(max(left @ left / len(target), 1e-300)) + 2 * (p + 1)
                step = coef[0] + sum(coef[k] * y[-k] for k in range(1, p + 1))
                if best is None or aic < best[2] - 1e-9:
                    best = (p, d, aic, coef.tolist(), step + (x[-1] if d else 0.0))
        if best is None:
            return pd.DataFrame(columns=["symbol", "p", "d", "aic", "coefficients", "forecast"])
        return pd.DataFrame([(frame["symbol"].iloc[0], *best)], columns=["symbol", "p", "d", "aic", "coefficients", "forecast"])

    return series.groupBy("symbol").applyInPandas(run, "symbol string, p int, d int, aic double, coefficients array<double>, forecast double")


def arima(
    series: DataFrame, exog: list[str] | None = None, orders: tuple[int, int, int] = (2, 1, 2), seasons: tuple[int, ...] = (7, 12, 52), least_seasonal: int = 365
) -> DataFrame:
    """``(symbol, p, d, q, sp, sd, sq, season, n, aic, names, coefficients, forecast)``: the order of least AIC of each symbol and its forecast of the next value.

    ``series(symbol, ts, x, *exog)``; a symbol is one task. Moving-average terms
    are lags of the residuals of a long autoregression (Hannan and Rissanen),
    so every candidate is a least-squares fit on columns of one matrix, whose
    moments all candidates with the same differences share. Orders run up to
    ``orders``; with ``least_seasonal`` values or more, the best of them is
    then tried with seasonal terms of each season's lag (0 or 1 of each kind),
    and their products with the lags inside the season. Regressors enter by
    their value of the row before. Candidates are compared over the same rows.
    """
    exog = exog or []

    def differenced(x: np.ndarray, d: int, sd: int, s: int) -> np.ndarray:
        """x after differencing, at its own positions; NaN where there is none."""
        for lag in [1] * d + [s] * sd:
            x = np.concatenate([np.full(lag, np.nan), x[lag:] - x[:-lag]])
        return x

    def candidate(x, w, e, z, start, p, q, s, sp, sq):
        """``(aic terms, names, coefficients, next w)`` of one fit of w over the rows from ``start``."""
        lags = [("ar", i) for i in range(1, p + 1)] + [("ar", s * sp + i) for i in range(p + 1) if sp] + [("ma", i) for i in range(1, q + 1)] + [("ma", s * sq + i) for i in range(q + 1) if sq]
        of = {"ar": w, "ma": e}
        n = len(x)
        columns = [np.ones(n - start)] + [of[kind][start - lag : n - lag] for kind, lag in lags] + [z[start - 1 : n - 1, j] for j in range(z.shape[1])]
        a = np.column_stack(columns)
        coef, *_ = np.linalg.lstsq(a, w[start:], rcond=None)
        left = w[start:] - a @ coef
        rows, k = len(left), a.shape[1]
        aic = rows * math.log(max(left @ left / rows, 1e-300)) + 2 * k
        now = np.array([1.0] + [of[kind][n - lag] for kind, lag in lags] + list(z[n - 1]))
        return aic, ["const", *(f"{kind}{lag}" for kind, lag in lags), *exog], coef, float(now @ coef), rows

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts").dropna(subset=["x"])
        x, z = frame["x"].to_numpy(float), np.nan_to_num(frame[exog].to_numpy(float)).reshape(len(frame), len(exog))
        n, names = len(x), ["symbol", "p", "d", "q", "sp", "sd", "sq", "season", "n", "aic", "names", "coefficients", "forecast"]
        seasonal = [s for s in seasons if n >= max(least_seasonal, 4 * s)]
        long = max(1, min(int(math.ceil(10 * math.log10(max(n, 2)))), n // 5))
        prepared: dict = {}

        def parts(d: int, sd: int, s: int):
            """Differences and residuals of a long autoregression, once for all orders that share them."""
            if (d, sd, s) not in prepared:
                w = differenced(x, d, sd, s)
                first = d + sd * s
                a = np.column_stack([np.ones(n - first - long)] + [w[first + long - i : n - i] for i in range(1, long + 1)])
                coef, *_ = np.linalg.lstsq(a, w[first + long :], rcond=None)
                e = np.full(n, np.nan)
                e[first + long :] = w[first + long :] - a @ coef
                prepared[d, sd, s] = w, e, first + long
            return prepared[d, sd, s]

        def forecast(step: float, d: int, sd: int, s: int) -> float:
            """The next x from the next difference."""
            past = [x]
            for lag in [1] * d + [s] * sd:
                past.append(past[-1][lag:] - past[-1][:-lag])
            for before, lag in zip(past[-2::-1], reversed([1] * d + [s] * sd), strict=True):
                step = before[-lag] + step
            return step

        top_p, top_d, top_q = orders
        start = top_d + long + max(top_p, top_q)
        if n < start + 10 + top_p + top_q + len(exog):
            return pd.DataFrame(columns=names)
        best = None
        for d in range(top_d + 1):
            for p, q in itertools.product(range(top_p + 1), range(top_q + 1)):
                w, e, _ = parts(d, 0, 0)
                aic, *fit = candidate(x, w, e, z, start, p, q, 0, 0, 0)
                if best is None or aic < best[0] - 1e-9:
                    best = (aic, p, d, q, 0, 0, 0, 0, fit)
        for s in seasonal:
            _, p, d, q, *_ = best
            after = top_d + s + long + s + max(top_p, top_q)
            if n < after + 30:
                continue
            plain = parts(d, 0, 0)
            base = candidate(x, plain[0], plain[1], z, after, p, q, 0, 0, 0)[0]  # the best so far over the same rows
            for sp, sd, sq in itertools.product((0, 1), repeat=3):
                if not sp + sd + sq:
                    continue
                w, e, _ = parts(d, sd, s)
                aic, *fit = candidate(x, w, e, z, after, p, q, s, sp, sq)
                gain = base - aic
                if gain > (best[9] if len(best) > 9 else 1e-9):
                    best = (aic, p, d, q, sp, sd, sq, s, fit, gain)
        aic, p, d, q, sp, sd, sq, s, (terms, coef, step, rows) = best[:9]
        row = (frame["symbol"].iloc[0], p, d, q, sp, sd, sq, s, rows, aic, terms, coef.tolist(), forecast(step, d, sd, s))
        return pd.DataFrame([row], columns=names)

    schema = "symbol string, p int, d int, q int, sp int, sd int, sq int, season int, n int, aic double, names array<string>, coefficients array<double>, forecast double"
    return series.select("symbol", "ts", "x", *exog).groupBy("symbol").applyInPandas(run, schema)


def seasonal_trend(train: DataFrame, test: DataFrame, regressors: list[str], orders: dict[float, int] | None = None) -> DataFrame:
    """Trend, weekly and yearly Fourier terms and regressors in a linear regression of each symbol; ``(symbol, ts, forecast)`` of the test rows.

    One aggregation gives the moments of every symbol; a symbol's normal
    equations are a small system of their own. The trend and the regressors
    are taken from the symbol's means, with a slight ridge.
    """
    orders = {7.0: 2, 365.25: 3} if orders is None else orders
    day = F.unix_date(F.col("ts").cast("date")).cast("double")
    waves = {f"_{fn}{i}_{int(p)}": getattr(F, fn)(2 * np.pi * (i + 1) * day / p) for p, n in orders.items() for i in range(n) for fn in ("sin", "cos")}
    names = ["_t", *waves, *regressors]

    def ready(df: DataFrame) -> DataFrame:
        df = df.withColumns({"_t": day / 365.25, **waves})
        return df.fillna(0.0, subset=regressors) if regressors else df

    columns = [*names, "close"]
    means = ready(train).where("close is not null").groupBy("symbol").agg(*(F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)), F.count("*").alias("_n"))
    moved = ready(train).where("close is not null").join(means, "symbol").select("symbol", "_n", *(F.col(f"_m{i}") for i in range(len(columns))), *((F.col(c) - F.col(f"_m{i}")).alias(f"_d{i}") for i, c in enumerate(columns)))
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = moved.groupBy("symbol").agg(F.first("_n").alias("_n"), F.array(*(F.first(f"_m{i}") for i in range(len(columns)))).alias("means"), F.array(*(F.sum(F.col(f"_d{i}") * F.col(f"_d{j}")) for i, j in pairs)).alias("sums"))

    @F.udf("array<double>")
    def solve(n: int, sums: list[float]) -> list[float]:  # once for each symbol
        gram = np.zeros((len(columns),) * 2)
        for (i, j), v in zip(pairs, sums, strict=True):
            gram[i, j] = gram[j, i] = v / n
        k = len(names)
        return np.linalg.solve(gram[:k, :k] + 1e-9 * np.trace(gram[:k, :k]) / k * np.eye(k) + 1e-15 * np.eye(k), gram[:k, k]).tolist()

    fitted = sums.select("symbol", "means", solve("_n", "sums").alias("w"))
    value = F.col("means")[len(names)]
    for i, c in enumerate(names):
        value = value + F.col("w")[i] * (F.col(c) - F.col("means")[i])
    return ready(test).join(fitted, "symbol").select("symbol", "ts", value.alias("forecast"))
