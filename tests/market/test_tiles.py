"""Sliding tiles, blocked pairs and chunks of windows against plain versions."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from barloom.operators import factors as fc, pairs as pr, tiles


def days(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def returns(spark, n, symbols, seed, gaps=0.0):
    rng = np.random.default_rng(seed)
    m = rng.normal(0, 0.02, (n, symbols)) + rng.normal(0, 0.01, (n, 1))
    m[rng.random(m.shape) < gaps] = np.nan
    names = [f"S{i:03d}" for i in range(symbols)]
    rows = [(names[j], d, float(m[i, j])) for i, d in enumerate(days(n)) for j in range(symbols) if np.isfinite(m[i, j])]
    return pd.DataFrame(m, index=days(n), columns=names), spark.createDataFrame(rows, "symbol string, ts date, ret double")


def test_sliding_sums_forget_what_has_left():
    rng = np.random.default_rng(0)
    x = rng.normal(size=90)
    x[20] = 1e17  # a difference of running sums would keep its rounding
    windows = [(0, 7), (3, 21), (3, 30), (30, 44), (31, 44), (50, 90), (89, 90)]
    found = list(tiles.sliding_sums(windows, lambda a, b: np.array([x[a:b].sum(), b - a])))
    for (lo, hi), (s, n) in zip(windows, found, strict=True):
        assert n == hi - lo and s == pytest.approx(x[lo:hi].sum(), rel=1e-12)


@pytest.mark.parametrize("block, span", [(3, 2), (128, 25)])
def test_correlations_of_blocks(spark, monkeypatch, block, span):
    monkeypatch.setattr(tiles, "BLOCK", block)
    frame, df = returns(spark, 60, 8, 1, gaps=0.1)
    frame["S007"] = np.where(frame["S007"].notna(), 0.5, np.nan)  # no variance
    df = df.withColumn("ret", F.when(F.col("symbol") == "S007", 0.5).otherwise(F.col("ret")))
    windows = fc.rebalance_days(df.select("ts").distinct(), 20, 7)
    got = {(r["rebalance"], r["a"], r["b"]): r["corr"] for r in fc.correlations(df, windows, span).collect()}
    ends = days(60)[19::7]
    assert len(got) == len(ends) * 28
    for end, (a, b) in itertools.product(ends, itertools.combinations(frame.columns, 2)):
        both = frame.loc[:end].tail(20)[[a, b]].dropna()
        want = None if b == "S007" else np.corrcoef(both[a], both[b])[0, 1]
        assert got[end, a, b] == (want if want is None else pytest.approx(want, abs=1e-10))


@pytest.mark.parametrize("symbols", [6, 30])
def test_portfolios_by_days_and_by_symbols(spark, symbols):
    """More symbols than days of a window go by the product of the days: the same vectors."""
    frame, df = returns(spark, 70, symbols, 2)
    df = df.withColumn("ret", F.when(F.col("symbol") == "S003", 0.01).otherwise(F.col("ret"))).where("not (symbol = 'S001' and ts = date'2020-01-30')")
    frame["S003"], frame.loc[dt.date(2020, 1, 30), "S001"] = 0.01, np.nan
    windows = fc.rebalance_days(df.select("ts").distinct(), 20, 5)
    got = fc.eigenportfolios(df, windows, 2, span=3).toPandas()
    for end in days(70)[19::5]:
        w = frame.loc[:end].tail(20).dropna(axis=1)
        dev = w.std(ddof=1).to_numpy()
        live = dev > 1e-12
        z = np.where(live, (w - w.mean()).to_numpy() / np.where(live, dev, 1), 0)
        value, vector = np.linalg.eigh(z.T @ z / 19)
        for j in range(2):
            v = vector[:, -1 - j]
            v = v if v.sum() >= 0 else -v
            mine = got[(got["rebalance"] == end) & (got["factor"] == j)].set_index("symbol")
            assert sorted(mine.index) == sorted(w.columns)
            assert np.allclose(mine["weight"].loc[list(w.columns)], np.where(live, v / np.where(live, dev, 1), 0), atol=1e-6 * np.abs(v / np.where(live, dev, 1)).max())
            assert np.allclose(mine["explained"], value[-1 - j] / value.sum())


def test_too_few_symbols_give_no_portfolio(spark):
    _, df = returns(spark, 30, 3, 3)
    assert fc.eigenportfolios(df, fc.rebalance_days(df.select("ts").distinct(), 20, 5), 2).count() == 0


def test_sign_of_a_vector_that_sums_to_zero():
    x = np.array([[1.0, -1.0, 0.0, 1.0], [-1.0, 1.0, 0.0, -1.0], [2.0, -2.0, 0.0, 2.0], [-2.0, 2.0, 0.0, -2.0]])
    [(weight, _)] = fc.window_portfolios(x[:, :2], [(0, 4)], [np.array([True, True])], 0) or [(None, None)]
    assert weight.shape == (0, 2)
    [(weight, _)] = fc.window_portfolios(np.column_stack([x[:, :2], x[:, :2] * [1, 1]]), [(0, 4)], [np.ones(4, bool)], 1)
    top = weight[0]
    assert top[np.abs(top).argmax()] > 0 or top.sum() > 0


def test_the_panel_is_sent_three_times_at_most(spark):
    """Rows that reach the tasks of a panel, whatever the stride."""
    n, symbols = 300, 6
    frame, df = returns(spark, n, symbols, 4)
    bars = df.withColumns({"close": 100 * (1 + F.col("ret")), "volume": F.lit(1e4)}).select("symbol", "ts", "close", "volume")
    for every in (1, 5):
        spec = fc.ResidualSpec(60, 30, 2, every, 0.0, 0.0)
        scores = fc.residual_panel(bars, spec).scores
        halo, own = spec.corr_window - 1, n - spec.corr_window
        chunks = -(-own // (spec.span * every)) if own else 0
        assert own + chunks * halo <= 3 * n
        assert scores.select("ts").distinct().count() == n - spec.warmup


# pairs of blocks -----------------------------------------------------------------


def walks(spark, symbols=7, n=90, gaps=(2, 5), seed=6):
    rng = np.random.default_rng(seed)
    rows = []
    for fold in (0, 1):
        common = np.cumsum(rng.normal(0, 0.02, n))
        for j in range(symbols):
            path = 4 + common * (j % 3) + np.cumsum(rng.normal(0, 0.02, n)) * (0.3 if j % 2 else 1)
            for i, d in enumerate(days(n)):
                if not (j in gaps and rng.random() < 0.2):
                    rows.append((fold, d, f"S{j}", float(np.exp(path[i]))))
    rows += [(1, days(n)[3], "LATE", 2.0), (1, days(n)[4], "LATE", 2.1), (1, days(n)[5], "ZERO", 0.0)]
    return spark.createDataFrame(rows, "fold int, ts date, symbol string, close double")


@pytest.mark.parametrize("both", [False, True])
def test_pair_table_equals_pair_rows(spark, monkeypatch, both):
    """Blocks of three symbols, some with days missing, against the statistics of every pair's own rows."""
    monkeypatch.setattr(tiles, "BLOCK", 3)
    prices = walks(spark)
    rows = pr.pair_rows(prices, both)
    enough = rows.groupBy(*pr.PAIR).count().where("count > 10").drop("count")
    want = pr.pair_statistics(rows.join(enough, pr.PAIR)).toPandas().set_index(pr.PAIR).sort_index()
    found = pr.pair_table(prices, both).toPandas().set_index(pr.PAIR).sort_index()
    assert len(found) == rows.select(*pr.PAIR).distinct().count() > len(want)
    pd.testing.assert_frame_equal(found.loc[want.index][list(want.columns)].astype(float), want.astype(float), rtol=1e-8, check_dtype=False)
    late = found[found.index.get_level_values("x").str.startswith("LATE") | found.index.get_level_values("y").str.startswith("LATE")]
    assert (late["n"].astype(int) <= 2).all() and late["stat"].isna().all() and (late["beta_drift"] == np.inf).all()
    some = pr.rows_of_pairs(prices, pr.pair_table(prices, both).where("n > 10"))
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, rows.join(enough, pr.PAIR).select(*some.columns).collect()))


def plain_adf(x, constant):
    """Every lag refitted by least squares."""
    n, d = len(x), np.diff(x)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)

    def fit(lag, drop):
        a = np.column_stack([x[drop:-1], *(d[drop - k : len(d) - k] for k in range(1, lag + 1)), *([np.ones(len(d) - drop)] if constant else [])])
        coef, *_ = np.linalg.lstsq(a, d[drop:], rcond=None)
        left = d[drop:] - a @ coef
        error = np.sqrt(np.linalg.inv(a.T @ a)[0, 0] * (left @ left) / (len(left) - a.shape[1]))
        return coef[0] / error, len(left) * np.log((left @ left) / len(left)) + 2 * a.shape[1]

    lag = min(range(most + 1), key=lambda k: fit(k, most)[1])
    return fit(lag, lag)[0], lag


def test_one_factorization_has_all_lags():
    rng = np.random.default_rng(8)
    for n in (12, 40, 200, 600):
        e = rng.normal(size=(n, 9))
        x = np.cumsum(e, axis=0)
        x[:, :4] = e[:, :4]
        for t in range(2, n):
            x[t, 4:7] = 0.3 * x[t - 1, 4:7] + 0.4 * x[t - 2, 4:7] + e[t, 4:7]
        for constant in (False, True):
            stat, lag = pr.adf_batch(x, constant)
            want = [plain_adf(x[:, j], constant) for j in range(9)]
            assert lag.tolist() == [w[1] for w in want]
            assert stat == pytest.approx([w[0] for w in want], rel=1e-6)
    stat, lag = pr.adf_batch(np.column_stack([np.ones(50), rng.normal(size=50)]), True)
    assert np.isnan(stat[0]) and np.isfinite(stat[1])
    assert np.isnan(pr.adf_batch(np.ones((4, 2)), True)[0]).all()


def test_aic_table_equals_rows(spark, monkeypatch):
    monkeypatch.setattr(tiles, "BLOCK", 3)
    prices = walks(spark, symbols=5)
    want = pr.engle_granger_aic(pr.pair_rows(prices, True)).toPandas().set_index(pr.PAIR).sort_index()
    found = pr.aic_table(prices, True).toPandas().set_index(pr.PAIR).sort_index()
    pd.testing.assert_frame_equal(found.astype(float), want[found.columns].astype(float), rtol=1e-8)


def test_no_row_for_each_pair_and_day(spark):
    """The plan of a pair table has no join of days: blocks alone meet."""
    plan = pr.pair_table(walks(spark), True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "symbol" in plan  # the number of a symbol's block


def test_impact_by_dollar_volume_in_a_walk_forward(spark):
    """Thinner volumes cost more, and the report can tell."""
    from barloom.operators import folds, portfolio as pf, walkforward as wf

    _, df = returns(spark, 140, 8, 21)
    path = F.exp(F.sum(F.log1p("ret")).over(Window.partitionBy("symbol").orderBy("ts")))
    bars = df.withColumns({"close": 100 * path, "volume": F.lit(1000.0)}).withColumn("open", F.col("close"))
    bars = spark.createDataFrame(bars.select("symbol", "ts", "open", "close", "volume").toPandas())
    panel = fc.residual_panel(bars, fc.ResidualSpec(40, 20, 2, 5, 0.0, 0.0))
    slices = folds.calendar_slices(bars, 70, 25, least_test=5)
    cost = {}
    for name, table, impact in (("none", bars, 0.0), ("thick", bars, 100.0), ("thin", bars.withColumn("volume", F.col("volume") / 100), 100.0)):
        report = wf.residual_report(panel, table, slices, 0.05, costs=pf.Costs(0.0, 0.0, impact, 1.0, 0.0, "adv_sqrt", 1e5))
        cost[name] = report["accounts"].agg(F.sum("impact")).first()[0]
    assert cost["none"] == 0 < cost["thick"] and cost["thin"] == pytest.approx(10 * cost["thick"], rel=1e-6)
