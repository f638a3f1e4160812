"""Operators that SQL cannot hold: kernels, scans, parsers, sinks and streams, on small fixtures."""

import datetime as dt
import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.normal import norm_cdf, norm_ppf
from barloom.functions.scan import ema_step, scan_by_key
from barloom.operators import conformal, evaluate as ev, factors as fc, features as ft, folds, members as mb, pairs as pr, portfolio as pf, scaling, sentiment as sn, universe
from barloom.sources import bars as src
from barloom.streaming import bars as st


def days(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def walk(spark, n=120, symbols=("A", "B"), seed=1):
    rng, rows = np.random.default_rng(seed), []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
        for d, c in zip(days(n), close):
            o = c * (1 + rng.normal(0, 0.003))
            rows.append((s, d, float(o), float(max(o, c) * 1.01), float(min(o, c) * 0.99), float(c), float(rng.integers(100, 1000))))
    return spark.createDataFrame(rows, "symbol string, ts date, open double, high double, low double, close double, volume double")


# causality --------------------------------------------------------------------


@pytest.mark.parametrize(
    "op",
    [ft.indicators, ft.exponential_means, ft.volume_time_weights, ft.baseline_positions, lambda b: ft.lagged(b.select("symbol", "ts", "close")),
     lambda b: ft.realized_vol(b, back_fill=False), lambda b: ft.drawdown(b, "close"), lambda b: pr.residual_prices(b)],
)
def test_the_future_does_not_change_the_past(spark, op):
    bars = walk(spark)
    cut = days(120)[80]
    bent = bars.withColumns({c: F.when(F.col("ts") > cut, F.col(c) * 1.7).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    key = ["symbol", "ts"]
    a, b = (op(x).where(F.col("ts") <= cut).toPandas().sort_values(key).reset_index(drop=True) for x in (bars, bent))
    pd.testing.assert_frame_equal(a, b)


def test_labels_stay_null_at_the_end(spark):
    out = ft.with_labels(walk(spark), (5,)).where("target_5 is null").groupBy("symbol").count().collect()
    assert all(r["count"] == 5 for r in out)


def test_ema_against_pandas(spark):
    bars = walk(spark)
    got = scan_by_key(bars, ["symbol"], "ts", ema_step("close", 7), {"e": "double"}).toPandas().sort_values(["symbol", "ts"])
    want = got.groupby("symbol")["close"].transform(lambda x: x.ewm(span=7, adjust=False).mean())
    assert np.allclose(got["e"], want)


def test_exponential_means_over_blocks(spark, monkeypatch):
    """Means over several blocks, with gaps, against pandas."""
    rng = np.random.default_rng(3)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 1300)))
    close[rng.random(1300) < 0.1] = np.nan
    rows = [("A", d, None if np.isnan(c) else float(c)) for d, c in zip(days(1300), close)]
    got = ft.exponential_means(spark.createDataFrame(rows, "symbol string, ts date, close double")).toPandas().sort_values("ts")
    series = pd.Series(close)
    mean = lambda x, span: x.ewm(span=span, adjust=False, ignore_na=True).mean()
    for span in (5, 10, 20):
        assert np.allclose(got[f"ema{span}"].astype(float), mean(series, span), rtol=1e-12, equal_nan=True)
    macd = mean(series, 12) - mean(series, 26)
    signal = mean(macd.where(series.notna()), 9)
    assert np.allclose(got["macd"].astype(float), macd, atol=1e-9, equal_nan=True) and np.allclose(got["macd_signal"].astype(float), signal, atol=1e-9, equal_nan=True)


# pairs and factors --------------------------------------------------------------


def test_cointegrated_pair_is_found(spark):
    rng = np.random.default_rng(42)
    x = np.cumsum(rng.normal(0, 0.01, 650)) + 4
    gap = np.zeros(650)
    for t in range(1, 650):
        gap[t] = 0.82 * gap[t - 1] + rng.normal(0, 0.01)
    z = np.cumsum(rng.normal(0, 0.01, 650)) + 3
    series = {"AAA": np.exp(x), "BBB": np.exp(0.15 + 0.92 * x + gap), "ZZZ": np.exp(z)}
    rows = [(0, d, s, float(v)) for s, path in series.items() for d, v in zip(days(650), path)]
    prices = spark.createDataFrame(rows, "fold int, ts date, symbol string, close double")
    both = pr.pair_rows(prices, both_orders=True)
    found = pr.pair_statistics(both).withColumn("p", pr.mackinnon_p(F.col("stat"), 2))
    best = {frozenset((r["y"], r["x"])): r for r in pr.best_order(found).collect()}
    good, bad = best[frozenset(("AAA", "BBB"))], best[frozenset(("AAA", "ZZZ"))]
    assert good["p"] < 0.01 < bad["p"] and 1 <= good["half_life"] < 10
    aic = {(r["y"], r["x"]): r for r in pr.engle_granger_aic(both).collect()}
    assert aic["BBB", "AAA"]["stat"] < -5 and aic["BBB", "AAA"]["adf_stat"] < -5


def test_surface_values(spark):
    df = spark.createDataFrame([(-2.86,), (-3.34,), (-30.0,), (5.0,)], "s double")
    r = df.select(pr.mackinnon_p(F.col("s"), 1).alias("one"), pr.mackinnon_p(F.col("s"), 2).alias("two")).collect()
    assert r[0]["one"] == pytest.approx(0.05, abs=2e-3) and r[1]["two"] == pytest.approx(0.05, abs=2e-3)
    assert (r[2]["one"], r[3]["one"]) == (0.0, 1.0)


@pytest.mark.parametrize(
    "zs, want",
    [([0, 2.1, 1.0, 0.4, 0.4], [0, -1, -1, 0, 0]), ([-2.5, -4.2, -2.5], [1, 0, 1]), ([2.1, None, 2.1], [-1, 0, -1]), ([2.5, -2.5], [-1, -1])],
)
def test_band_states(zs, want):
    step, held, out = pr.band_step(2.0, 0.5, 4.0), None, []
    for z in zs:
        held, values = step(held, {"z": z})
        out.append(values[0])
    assert out == want


@pytest.mark.parametrize(
    "state, s, ok, want",
    [(0, -1.3, True, 1), (0, 1.3, True, -1), (1, -0.6, True, 1), (1, -0.4, True, 0), (-1, 0.8, True, -1), (-1, 0.7, True, 0), (1, 1.3, True, -1), (1, -1.0, False, 0), (0, 0.0, True, 0)],
)
def test_reversion_states(state, s, ok, want):
    assert fc.reversion_step()(state, {"sscore": s, "ok": ok})[0] == want


def test_eigenportfolios_against_numpy(spark):
    bars = walk(spark, 90, tuple("ABCDEFGH"), seed=11)
    r = bars.withColumn("ret", ft.change(F.col("close"))).select("symbol", "ts", "ret")
    windows = fc.rebalance_days(bars.select("ts").distinct(), 60, 20)
    q = fc.eigenportfolios(r, windows, 2).toPandas()
    assert set(q["factor"]) == {0, 1} and q.groupby(["rebalance", "factor"]).size().eq(8).all()
    at = q["rebalance"].max()
    w = r.toPandas().pivot(index="ts", columns="symbol", values="ret").loc[:at].tail(60).dropna()
    z = (w - w.mean()) / w.std()
    value, vector = np.linalg.eigh(z.T @ z / (len(z) - 1))
    v = vector[:, -1] * np.sign(vector[:, -1].sum())
    got = q[(q["rebalance"] == at) & (q["factor"] == 0)].set_index("symbol")["weight"]
    assert np.allclose(got.loc[list(w.columns)], v / w.std().to_numpy())


def plain_scores(bars, spec, funds=()):
    """The panel day by day with numpy, from wide frames."""
    close, volume = (bars.pivot(index="ts", columns="symbol", values=c) for c in ("close", "volume"))
    ret = (close / close.shift(1) - 1).where(close.notna())
    known = ret.rolling(spec.corr_window).count() >= spec.corr_window
    dollar = (close * volume).rolling(20).median()
    ok = (known & (close >= spec.least_price) & (dollar >= spec.least_dollar)).to_numpy() & ~np.isin(close.columns, funds)
    weight = 1.0
    if spec.volume_time:
        weight = (volume.rolling(spec.volume_window, min_periods=max(2, spec.volume_window // 2)).mean() / volume).clip(1 / spec.volume_clip, spec.volume_clip).fillna(1.0).to_numpy()
    r, names, out, q, held = ret.to_numpy(), list(close.columns), {}, None, None
    dep = r * weight
    for t in range(spec.corr_window, len(r)):
        if funds:
            q, held = np.array([[float(n == f) for n in names] for f in funds]), ~np.isin(names, funds)
        elif (t - spec.corr_window) % spec.every == 0 and ok[t].sum() >= spec.factors + 2:
            w = r[t - spec.corr_window + 1 : t + 1][:, ok[t]]
            z = (w - w.mean(axis=0)) / w.std(axis=0, ddof=1)
            _, v = np.linalg.eigh(z.T @ z / (len(z) - 1))
            q = np.zeros((spec.factors, len(names)))
            for j in range(spec.factors):
                e = v[:, -1 - j]
                q[j, ok[t]] = e * (1 if e.sum() >= 0 else -1) / w.std(axis=0, ddof=1)
            held = ok[t].copy()
        if q is None or t < spec.warmup:
            continue
        inside = r[t - spec.regr_window + 1 : t + 1]
        a = np.column_stack([np.ones(len(inside)), np.nan_to_num(inside) @ q.T])
        for i in np.flatnonzero(held & ok[t]):
            if not np.isfinite(inside[:, i]).all():
                out[close.index[t], names[i]] = (False, None)
                continue
            y = dep[t - spec.regr_window + 1 : t + 1, i]
            c = np.linalg.lstsq(a, y, rcond=None)[0]
            x = np.cumsum(y - a @ c)
            b, m0 = np.polyfit(x[:-1], x[1:], 1)
            if not 0 < b < 1:
                out[close.index[t], names[i]] = (True, None)
                continue
            e = x[1:] - m0 - b * x[:-1]
            s = np.sqrt((e @ e) / (len(e) - 2) / (1 - b * b))
            out[close.index[t], names[i]] = (True, (x[-1] - m0 / (1 - b) - c[0] / -np.log(b)) / s)
    return out


@pytest.mark.parametrize("funds, volume_time", [((), False), ((), True), (("A", "B"), False)])
def test_residual_panel_day_by_day(spark, funds, volume_time):
    rng = np.random.default_rng(5)
    bars = walk(spark, 120, tuple("ABCDEFGH"), seed=12).toPandas()
    bars["volume"] = rng.integers(500, 5000, len(bars)).astype(float)
    bars = bars[~((bars["symbol"] == "H") & (bars["ts"] == sorted(bars["ts"].unique())[95]))]  # a day without a bar
    df = spark.createDataFrame(bars[["symbol", "ts", "close", "volume"]])
    spec = fc.ResidualSpec(40, 20, 2, 7, 0.0, 0.0, 30.0, volume_time, 20, 4.0, funds)
    found = fc.residual_panel(df, spec)
    got = {(r["ts"], r["symbol"]): (r["active"], r["sscore"]) for r in found.scores.collect()}
    want = plain_scores(bars, spec, funds)
    assert set(got) == set(want) and len({k[0] for k in got}) > 50
    for key, (active, score) in want.items():
        assert got[key][0] == active and (got[key][1] is None if score is None else got[key][1] == pytest.approx(score, rel=1e-6, abs=1e-6))
    # what comes later changes nothing
    early = sorted(bars["ts"].unique())[:100]
    before = fc.residual_panel(spark.createDataFrame(bars[bars["ts"].isin(early)][["symbol", "ts", "close", "volume"]]), spec).scores.collect()
    assert before and all(got[r["ts"], r["symbol"]][1] == (pytest.approx(r["sscore"]) if r["sscore"] is not None else None) for r in before)


def test_skipped_rebalances_are_counted(spark):
    bars = walk(spark, 90, tuple("ABCDE"), seed=3).withColumn("volume", F.lit(1000.0)).select("symbol", "ts", "close", "volume")
    found = fc.residual_panel(bars, fc.ResidualSpec(40, 20, 4, 5, 0.0, 0.0))
    assert found.rebalances.where("used").count() == 0 and found.rebalances.count() == 10 and found.scores.count() == 0


def test_walk_forward_of_residuals(spark):
    from barloom.operators import walkforward as wf

    bars = walk(spark, 140, tuple("ABCDEFGH"), seed=21).withColumn("volume", F.lit(1000.0))
    panel = fc.residual_panel(bars.select("symbol", "ts", "close", "volume"), fc.ResidualSpec(40, 20, 2, 5, 0.0, 0.0))
    report = wf.residual_report(panel, bars, folds.calendar_slices(bars, 70, 25, least_test=5), 0.05, band=0.001)
    by_fold = report["folds"].collect()
    assert [r["fold"] for r in sorted(by_fold, key=lambda r: r["fold"])] == [0, 1, 2]
    last = report["targets"].groupBy("fold").agg(F.max("ts").alias("ts"))
    assert report["targets"].join(last, ["fold", "ts"]).where("target <> 0").count() == 0
    gross = report["targets"].groupBy("ts").agg(F.sum(F.abs("target")).alias("g"), F.max(F.abs("target")).alias("m")).agg(F.max("g"), F.max("m")).first()
    assert 0 < gross[0] <= 1 + 1e-9 and gross[1] <= 0.35
    one = report["summary"].first()
    assert one["folds"] == 3 and one["evaluations"] == sum(r["evaluations"] for r in by_fold) > 0


def test_walk_forward_of_pairs(spark):
    from barloom.operators import walkforward as wf

    rng = np.random.default_rng(1)
    x, gap = np.cumsum(rng.normal(0, 0.01, 400)) + 4, np.zeros(400)
    for t in range(1, 400):
        gap[t] = 0.8 * gap[t - 1] + rng.normal(0, 0.01)
    paths = {"AAA": x, "BBB": 0.1 + 0.9 * x + gap, "YYY": np.cumsum(rng.normal(0, 0.01, 400)), "ZZZ": np.cumsum(rng.normal(0, 0.01, 400))}
    bars = spark.createDataFrame([(d, s, float(np.exp(v)), float(np.exp(v))) for s, path in paths.items() for d, v in zip(days(400), path)], "ts date, symbol string, open double, close double")
    out = wf.pairs_report(bars, folds.calendar_slices(bars, 250, 60), pr.Selection(least_rows=100, most=2), wf.PairBook(1.0, 0.2, 5.0, 1.0, 40, 20), lags=False)
    chosen = {(r["fold"], *sorted((r["y"], r["x"]))) for r in out["candidates"].where("reason is null").collect()}
    assert {(0, "AAA", "BBB"), (1, "AAA", "BBB")} <= chosen
    counts = {(r["fold"], r["reason"]): r["n"] for r in pr.rejection_counts(out["candidates"]).collect()}
    assert all(sum(n for (f, _), n in counts.items() if f == fold) + sum(c[0] == fold for c in chosen) == 6 for fold in (0, 1))
    assert out["trials"].count() == len(chosen) and out["diagnostics"].count() == len(chosen)
    one = out["summary"].first()
    assert one["bars"] == 60 * 2 + 29 or one["bars"] > 120
    assert one["trials"] == len(chosen) and 0 <= one["pair_set_dsr"] <= 1
    assert out["turnover"].where("fold = 0").first()["turnover"] == 1.0


def test_gates_look_at_absolute_correlation(spark):
    rows = [(0, "A", "B", 300, 1.0, -0.6, 5.0, 0.1, -5.0, 0.01, 0.01, True), (0, "A", "C", 300, 1.0, 0.1, 5.0, 0.1, -5.0, 0.01, 0.01, True), (0, "B", "C", 300, 1.0, 0.5, float("inf"), 0.1, -5.0, 0.01, 0.01, True), (0, "B", "D", 20, 1.0, 0.5, 5.0, 0.1, -5.0, 0.01, 0.01, True)]
    df = spark.createDataFrame(rows, "fold int, y string, x string, n long, beta double, return_corr double, half_life double, beta_drift double, stat double, p double, adf_p double, passes boolean")
    got = {(r["y"], r["x"]): r["reason"] for r in pr.rejection_reason(df, pr.Selection()).collect()}
    assert got == {("A", "B"): None, ("A", "C"): "return_corr", ("B", "C"): "half_life", ("B", "D"): "candidate_unavailable"}


def test_replay_stops_without_a_saved_column(spark):
    from barloom.operators import scaling

    rows = spark.createDataFrame([("A", 0, dt.date(2020, 1, 1), 1.0)], "symbol string, fold int, ts date, close double")
    state = spark.createDataFrame([("A", 0, "close", None, None, 0.0, 2.0)], "symbol string, fold int, column string, low double, high double, center double, width double")
    assert scaling.replay(rows, state, ["close"]).first()["close"] == 0.5
    with pytest.raises(ValueError, match="spread"):
        scaling.replay(rows, state, ["close", "spread"])


def test_column_groups():
    from barloom.operators import walkforward as wf

    groups = wf.column_groups(["open", "ma5", "volume_ma5", "rsi_14", "x_sentiment_score", "target_5"], lambda c: c.startswith("target"))
    assert groups == {"price": ["open", "ma5"], "volume": ["volume_ma5"], "sentiment": ["x_sentiment_score"], "technical": ["rsi_14", "x_sentiment_score"], "label": ["target_5"]}


def test_seasonal_trend_of_each_symbol(spark):
    from barloom.operators import members as mb

    rows = [(s, dt.date(2020, 1, 1) + dt.timedelta(days=7 * i), level + slope * i + 0.1 * np.sin(2 * np.pi * 7 * i / 365.25)) for s, level, slope in (("A", 1.0, 0.01), ("B", 100.0, -0.05)) for i in range(200)]
    df = spark.createDataFrame([(s, d, float(v)) for s, d, v in rows], "symbol string, ts date, close double")
    cut = F.col("ts") < F.lit("2023-01-01").cast("date")
    found = mb.seasonal_trend(df.where(cut), df.where(~cut), []).join(df, ["symbol", "ts"]).collect()
    assert found and all(abs(r["forecast"] - r["close"]) < 0.05 for r in found)


def test_mean_reversion_is_recovered(spark):
    rng, x = np.random.default_rng(7), [0.0]
    for _ in range(3000):
        x.append(0.55 * x[-1] + rng.normal(0, 0.01))
    rows = [("A", t, float(d)) for t, d in enumerate(np.diff(x))]
    fit = fc.ou_fit(spark.createDataFrame(rows, "symbol string, ts int, residual double"), ["symbol"]).first()
    assert fit["b"] == pytest.approx(0.55, abs=0.05) and fit["valid"] and fit["half_life"] == pytest.approx(-math.log(2) / math.log(fit["b"]))


# portfolios -------------------------------------------------------------------


def book(spark, targets, opens):
    rows = [("p", t, s, float(o), None if w is None else float(w)) for s in targets for t, (w, o) in enumerate(zip(targets[s], opens[s]))]
    return spark.createDataFrame(rows, "portfolio string, ts int, symbol string, open double, target double")


def test_target_fills_on_the_next_bar(spark):
    df = book(spark, {"A": [0.5, None, 0.0, 0.0]}, {"A": [10, 11, 12.1, 12.1]})
    held = {r["ts"]: r["held"] for r in pf.fills(df).collect()}
    assert held == {0: 0.0, 1: 0.5, 2: 0.5, 3: 0.0}
    acc = {r["ts"]: r for r in pf.account(pf.fills(df), pf.Costs(0, 0, 0, 1, 0)).collect()}
    assert acc[0]["net_return"] == 0 and acc[1]["net_return"] == pytest.approx(0.05) and acc[2]["net_return"] == 0
    paid = pf.account(pf.fills(df), pf.Costs()).toPandas()
    assert (paid["cost"] >= 0).all() and (paid["net_return"] <= paid["gross_return"]).all()


def test_banded_fills(spark):
    df = book(spark, {"A": [0.5, 0.52, 0.8, None, 0.1], "B": [0.4, 0.4, 0.8, None, 0.1]}, {"A": [10] * 5, "B": [10] * 5})
    got = {(r["ts"], r["symbol"]): r["held"] for r in pf.banded_fills(df, 0.05, 1.0).collect()}
    assert [got[t, "A"] for t in range(5)] == pytest.approx([0, 0.5, 0.5, 0.5, 0.5])
    assert [got[t, "B"] for t in range(5)] == pytest.approx([0, 0.4, 0.4, 0.5, 0.5])
    free = {(r["ts"], r["symbol"]): r["held"] for r in pf.banded_fills(df, 0.0, None).collect()}
    plain = {(r["ts"], r["symbol"]): r["held"] for r in pf.fills(df).collect()}
    assert free == pytest.approx(plain)


def test_ruin_is_compounded(spark):
    """A loss of more than everything stays lost; NULL is no change."""
    ret = [0.1, -1.5, None, 0.1, 0.2]
    rows = [("a", d, r, 0.0, 0.0, 0.0, 0.0) for d, r in zip(days(5), ret)] + [("b", d, r, 0.0, 0.0, 0.0, 0.0) for d, r in zip(days(5), [0.1, -1.0, 0.5, 0.1, 0.1])]
    df = spark.createDataFrame(rows, "portfolio string, ts date, net_return double, gross double, net double, turnover double, cost double")
    path = [r["equity"] for r in pf.equity(df, 100.0).where("portfolio = 'a'").orderBy("ts").collect()]
    assert path == pytest.approx([110, -55, -55, -60.5, -72.6])
    a, b = pf.metrics(df, 100.0).orderBy("portfolio").collect()
    assert a["total_return"] == pytest.approx(-1.726) and a["annual_return"] is None and a["calmar"] is None
    assert a["max_drawdown"] == pytest.approx(1 + 72.6 / 110) and a["bars"] == 4
    assert b["total_return"] == -1.0 and b["annual_return"] == -1.0 and b["max_drawdown"] == 1.0
    total = ev.trial_metrics(df).orderBy("portfolio").first()
    assert total["net_total"] == pytest.approx(-1.726)


def test_psr_of_metrics(spark):
    rng = np.random.default_rng(9)
    r = rng.normal(0.001, 0.01, 250)
    rows = [("a", d, float(x), 0.0, 0.0, 0.0, 0.0) for d, x in zip(days(250), r)]
    got = pf.metrics(spark.createDataFrame(rows, "portfolio string, ts date, net_return double, gross double, net double, turnover double, cost double")).first()
    sr, z = r.mean() / r.std(ddof=1), (r - r.mean()) / r.std()
    arg = sr * math.sqrt(249) / math.sqrt(1 - (z**3).mean() * sr + ((z**4).mean() - 1) / 4 * sr * sr)
    assert got["psr"] == pytest.approx(0.5 * (1 + math.erf(arg / math.sqrt(2))), abs=1e-9)


def test_trades_without_profit_are_losses(spark):
    stats = lambda p: pf.trade_statistics(spark.createDataFrame([(x,) for x in p], "pnl double")).first()
    r = stats([2.0, 0.0, -1.0, None])
    assert (r["trades"], r["avg_win"], r["avg_loss"], r["profit_factor"]) == (3, 2.0, -0.5, 2.0)
    r = stats([0.0, -2.0])
    assert (r["avg_win"], r["avg_loss"], r["profit_factor"], r["win_rate"]) == (0.0, -1.0, 0.0, 0.0)
    assert stats([1.0])["profit_factor"] is None


def test_costs_are_checked():
    with pytest.raises(ValueError):
        pf.Costs(spread_bps=-1)
    with pytest.raises(ValueError):
        pf.Costs(impact_model="cubic")


def test_clip_and_scale_orders_differ(spark):
    df = spark.createDataFrame([(0, "A", 2.0), (0, "B", 0.5)], "ts int, symbol string, weight double")
    combined = {r["symbol"]: r["weight"] for r in pf.combine_books(df, 0.6, 1.0).collect()}
    capped = {r["symbol"]: r["weight"] for r in pf.cap_book(df, 0.6, 1.0).collect()}
    assert combined == pytest.approx({"A": 0.6 / 1.1, "B": 0.5 / 1.1}) and capped == pytest.approx({"A": 0.6, "B": 0.2})


def test_marked_value_and_trades(spark):
    p = spark.createDataFrame([(1, 1, 10.0, 5.0, 6.0), (1, -1, 10.0, 5.0, 6.0)], "ts int, side int, shares double, entry double, price double")
    assert pf.marked_value(p, 7.0).first()["value"] == pytest.approx(10 * 6 + 10 * 4 + 7)


# evaluation -------------------------------------------------------------------


def test_normal_distribution(spark):
    got = spark.createDataFrame([(0.0,), (1.96,), (None,)], "z double").select(norm_cdf(F.col("z")).alias("p")).collect()
    assert got[0]["p"] == 0.5 and got[1]["p"] == pytest.approx(0.975, abs=1e-4) and got[2]["p"] is None
    assert norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-5)


def test_upper_quantiles(spark):
    from statistics import NormalDist

    from barloom.functions.normal import norm_upper

    qs = [0.5, 0.49, 0.3, 0.1, 0.02, 1e-3, 1e-6, 1e-9]
    got = [r[0] for r in spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "i int, q double").orderBy("i").select(norm_upper(F.col("q"))).collect()]
    assert got == pytest.approx([-NormalDist().inv_cdf(q) for q in qs], abs=1e-10)  # the tail that is inverted has some 11 digits at 6


def test_deflation_lowers_confidence(spark):
    rng = np.random.default_rng(4)
    r = spark.createDataFrame([("s", float(x)) for x in rng.normal(0.05, 1, 500)], "k string, ret double")
    trials = spark.createDataFrame([(float(x),) for x in rng.normal(0, 0.05, 20)], "sharpe double")
    plain = ev.with_psr(ev.moments(r, ["k"])).first()
    few, many = (ev.deflated_sharpe(r, trials, ["k"], declared=n).first() for n in (20, 2000))
    assert plain["psr"] > few["psr"] > many["psr"]
    same = spark.createDataFrame([(0.1,), (0.1,)], "sharpe double")
    assert ev.expected_max_sharpe(same) == 0.0 and ev.expected_max_sharpe(same.limit(1)) is None


def test_overfitting_of_noise_and_of_skill(spark):
    rng = np.random.default_rng(5)
    noise = [(t, f"s{k}", float(x)) for k in range(4) for t, x in enumerate(rng.normal(0, 1, 500))]
    skill = [(t, s, x + (0.5 if s == "s0" else 0)) for t, s, x in noise]
    pbo = [ev.backtest_overfitting(spark.createDataFrame(rows, "pos long, strategy string, ret double"), 8).first()["pbo"] for rows in (noise, skill)]
    assert pbo[1] == 0.0 < 0.2 < pbo[0]


def test_packet_json_is_strict(spark):
    row = spark.createDataFrame([(1.0, float("nan"))], "a double, b double").select(F.to_json(F.struct("a", F.when(~F.isnan("b"), F.col("b")).alias("b"))).alias("j")).first()
    assert json.loads(row["j"]) == {"a": 1.0}


# members and bands --------------------------------------------------------------


def test_simplex_weights_against_a_grid():
    rng = np.random.default_rng(3)
    for _ in range(10):
        p, y = rng.normal(size=(60, 3)), rng.normal(size=60)
        gram, cross = p.T @ p / 60, p.T @ y / 60
        w = mb.simplex_weights(gram, cross)
        loss = lambda v: v @ gram @ v - 2 * cross @ v
        grid = [np.array([a, b, c]) / 20 for a in range(21) for b in range(21 - a) for c in range(21 - a - b)]
        assert (w >= 0).all() and w.sum() <= 1 + 1e-9 and loss(w) <= min(map(loss, grid)) + 1e-9


def test_forecasters_have_skill(spark):
    rng, x = np.random.default_rng(0), [0.0]
    for _ in range(400):
        x.append(0.8 * x[-1] + rng.normal(0, 0.1))
    rows = [("A", d, float(v)) for d, v in zip(days(401), x)]
    fit = mb.autoregression(spark.createDataFrame(rows, "symbol string, ts date, x double")).first()
    assert (fit["p"], fit["d"]) in ((1, 0), (2, 0)) and fit["forecast"] == pytest.approx(0.8 * x[-1], abs=0.15)
    wave = [("A", d, 10 + 0.01 * i + math.sin(2 * math.pi * (d - dt.date(1970, 1, 1)).days / 7)) for i, d in enumerate(days(300))]
    df = spark.createDataFrame(wave, "symbol string, ts date, close double")
    f = mb.seasonal_trend(df.limit(200), df, []).join(df, ["symbol", "ts"]).agg(F.max(F.abs(F.col("forecast") - F.col("close"))).alias("e")).first()
    assert f["e"] < 0.3


def test_quantile_needs_rows(spark):
    df = spark.createDataFrame([("A", float(i)) for i in range(4)] + [("B", float(i)) for i in range(99)], "symbol string, residual double")
    q = {r["symbol"]: r["q"] for r in conformal.residual_quantile(df, 0.1).collect()}
    assert q["A"] is None and q["B"] == pytest.approx(np.quantile(np.arange(99.0), 0.9 * 100 / 99))


# sources, universe, sinks ---------------------------------------------------------


PAGE = """<html><table><tr><th>Symbol[1]</th><th>Name</th></tr><tr><td> BRK  B </td><td>x</td></tr><tr><td>aapl[2]</td><td>y</td></tr><tr><td>AAPL</td><td>z</td></tr></table>
<table><tr><th>Date</th><th>Added</th><th>n</th><th>Removed</th></tr><tr><td>March 5, 2020</td><td>AAPL</td><td></td><td>OLD</td></tr><tr><td>soon</td><td>X</td><td></td><td>Y</td></tr></table></html>"""


def test_universe_from_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>none</p>")], "page_id int, html string")
    cells = universe.html_tables(spark, pages).where("page_id = 1")
    members = {r["ticker"]: r["row_no"] for r in universe.constituents(cells).collect()}
    assert members == {"BRKB": 1, "AAPL": 2}
    ch = universe.changes(cells).collect()
    assert [(r["date"], r["added"], r["removed"]) for r in ch] == [(dt.date(2020, 3, 5), "AAPL", "OLD")]
    events = universe.changes(cells).select("date", "row_no", F.explode(F.array(F.struct(F.col("added").alias("ticker"), F.lit("add").alias("kind")), F.struct(F.col("removed").alias("ticker"), F.lit("remove").alias("kind")))).alias("e")).select("e.ticker", "date", "row_no", "e.kind")
    got = {(r["ticker"], str(r["start"]), str(r["end"])) for r in universe.membership(events, universe.constituents(cells), "2021-01-01").collect()}
    assert got == {("AAPL", "2020-03-05", "2021-01-01"), ("OLD", "1990-01-01", "2020-03-05"), ("BRKB", "1990-01-01", "2021-01-01")}


def test_sinks_round_trip(spark, tmp_path):
    syms = spark.createDataFrame([("b b",), ("A",), ("a",)], "symbol string")
    src.write_universe(syms, str(tmp_path / "u"))
    lines = spark.read.text(str(tmp_path / "u")).withColumn("line_no", F.monotonically_increasing_id())
    assert {r["symbol"] for r in src.parse_universe(lines).collect()} == {"A", "BB"}
    for x in (0.1, 0.2):
        src.append_trial(spark.createDataFrame([("t", x)], "name string, oos_periodic_sharpe double"), str(tmp_path / "l"))
    with open(tmp_path / "l" / "part-bad.json", "w") as f:
        f.write('{"name": "x", "oos\n')
    good, counts = src.read_ledger(spark, str(tmp_path / "l"))
    assert sorted(r[0] for r in good.collect()) == [0.1, 0.2] and counts.first()["corrupt"] == 1
    src.write_results({"fills": spark.createDataFrame([("r1", 1.0)], "run_id string, x double")}, str(tmp_path / "out"))
    assert os.path.isdir(tmp_path / "out" / "fills" / "run_id=r1")


def test_scaler_state_round_trip(spark, tmp_path):
    rows = walk(spark).withColumn("fold", F.lit(0))
    state = scaling.fit_scalers(rows.where("ts < '2020-03-01'"), {"price": ["close"], "volume": ["volume"]})
    state.write.parquet(str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    a, b = (scaling.apply_scalers(rows, s, ["close", "volume"]).toPandas().sort_values(["symbol", "ts"]).reset_index(drop=True) for s in (state, again))
    pd.testing.assert_frame_equal(a, b)
    assert scaling.missing_columns(again, ["close"]) == ["volume"]


def test_news_edges(spark):
    closes = spark.createDataFrame([("A", 1, 100), ("A", 2, 200)], "symbol string, ts int, close_at long")
    rows = [("A", 50, 1), ("A", 100, 2), ("A", 101, 3), ("A", 200, 4), ("A", 201, 5), ("A", None, 6), ("B", 50, 7)]
    got = {r["article_id"]: r["ts"] for r in sn.to_bars(spark.createDataFrame(rows, "symbol string, published long, article_id int"), closes).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def test_folds_do_not_leak(spark):
    pos = spark.range(1000).select(F.lit("A").alias("symbol"), F.col("id").alias("pos"))
    table = folds.purged_folds(spark.createDataFrame([("A", 1000), ("B", 5)], "symbol string, n long"), 5, 7, 0.01)
    assigned = folds.fold_rows(pos, table)
    assert table.where("symbol = 'B'").count() == 0 and table.count() == 5
    assert folds.leaks(assigned, table, 7).count() == 0
    assert assigned.where("role = 'test'").count() == 1000 - 1000 // 6
    with pytest.raises(ValueError):
        folds.rolling_slices(spark, 100, 50, 10, step=5)


# streams --------------------------------------------------------------------------


def run_stream(df, tmp_path, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_bars_equal_batch(spark, sf_dir, tmp_path):
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    os.makedirs(tmp_path / "in")
    os.symlink(path, tmp_path / "in" / "events.parquet")
    trades = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("order"))
    got = run_stream(st.stream_bars(trades, "1 hour", "1 hour"), tmp_path, "bars_out").toPandas()
    from barloom.plans.panels import event_bars

    batch = event_bars(spark, sf_dir).toPandas()
    batch["ts"] = pd.to_datetime(batch["ts"], unit="s")
    both = got.merge(batch, on=["symbol", "ts"], suffixes=("", "_b"))
    assert len(both) == len(got) >= len(batch) - 10
    for c in ("open", "high", "low", "close", "volume"):
        assert np.allclose(both[c], both[f"{c}_b"])


def test_stream_states_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), float(rng.normal()), bool(rng.random() > 0.1), int(rng.random() < 0.2)) for s in "AB" for i in range(80)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, sscore double, ok boolean, miss int")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    key = ["symbol", "ts"]
    got = run_stream(st.stream_states(stream, fc.reversion_step(), ["sscore", "ok"]), tmp_path, "states_out").toPandas().sort_values(key)
    want = fc.reversion_positions(df, ["symbol"]).toPandas().sort_values(key)
    assert got["state"].tolist() == want["state"].tolist()
    got = run_stream(st.stream_alpha(stream), tmp_path, "alpha_out").toPandas().sort_values(key)
    want = conformal.adaptive_alpha(df.select("symbol", "ts", "miss")).toPandas().sort_values(key)
    assert np.allclose(got["alpha"], want["alpha"])


def test_stream_mean_and_sentiment(spark, tmp_path):
    rows = [("A", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), float(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    df.coalesce(1).write.parquet(str(tmp_path / "m"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "m"))
    means = run_stream(st.stream_mean(stream, "4 hours", "1 hour", "1 hour"), tmp_path, "mean_out").toPandas()
    full = {r.ts: r.mean for r in means.itertuples() if r.ts >= pd.Timestamp("2020-01-01 04:00")}
    assert full[pd.Timestamp("2020-01-01 10:00")] == pytest.approx(np.mean([6, 7, 8, 9]))
    cal = spark.createDataFrame([("A", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1, 16)), ("A", dt.datetime(2020, 1, 1, 16), dt.datetime(2020, 1, 2, 16))], "symbol string, prev_close timestamp, close_at timestamp")
    news = stream.select("symbol", F.col("ts").alias("published"), F.col("close").alias("score"), F.hour("ts").alias("article_id"))
    out = run_stream(st.stream_sentiment(news, cal, "1 hour"), tmp_path, "news_out").toPandas()
    first = out[out["close_at"] == pd.Timestamp("2020-01-01 16:00")].iloc[0]
    assert (first["news"], first["score"], first["momentum"]) == (17, 8.0, np.mean(range(9, 17)) - np.mean(range(9)))
