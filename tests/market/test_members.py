"""Orders with moving-average and seasonal terms, and weights of many members."""

import datetime as dt
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import members as mb


def frame(spark, series, exog=None):
    first = dt.date(2015, 1, 1)
    rows = [(s, first + dt.timedelta(days=i), None if np.isnan(v) else float(v), float(exog[s][i]) if exog else 0.0) for s, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "symbol string, ts date, x double, z double").repartition(3)


def test_arma_is_recovered(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(size=3001)
    x = np.zeros(3001)
    for t in range(1, 3001):
        x[t] = 0.7 * x[t - 1] + e[t] + 0.5 * e[t - 1]
    walk = np.cumsum(rng.normal(size=3001))
    x[17] = np.nan
    found = {r["symbol"]: r for r in mb.arima(frame(spark, {"arma": x, "walk": walk, "short": x[:16]}), orders=(1, 1, 1), seasons=()).collect()}
    assert set(found) == {"arma", "walk"}
    r = found["arma"]
    c = dict(zip(r["names"], r["coefficients"], strict=True))
    assert (r["p"], r["d"], r["q"], r["season"]) == (1, 0, 1, 0) and c["ar1"] == pytest.approx(0.7, abs=0.05) and c["ma1"] == pytest.approx(0.5, abs=0.07)
    assert r["forecast"] == pytest.approx(0.7 * x[-1] + 0.5 * e[-1], abs=0.2)
    assert found["walk"]["d"] == 1 or found["walk"]["coefficients"][1] > 0.97
    assert found["walk"]["forecast"] == pytest.approx(walk[-1], abs=0.3)


def test_season_is_found(spark):
    rng = np.random.default_rng(2)
    n, e = 800, rng.normal(0, 0.3, 800)
    x = np.zeros(n)
    for t in range(n):
        x[t] = (x[t - 7] if t >= 7 else rng.normal(0, 3)) + e[t]
    z = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.4 * y[t - 1] + 2 * z[t - 1] + e[t]
    got = {r["symbol"]: r for r in mb.arima(frame(spark, {"week": x, "led": y}, {"week": z, "led": z}), ["z"]).collect()}
    assert got["week"]["season"] == 7 and got["week"]["forecast"] == pytest.approx(x[-7], abs=1.2)
    c = dict(zip(got["led"]["names"], got["led"]["coefficients"], strict=True))
    assert c["z"] == pytest.approx(2, abs=0.1) and got["led"]["forecast"] == pytest.approx(0.4 * y[-1] + 2 * z[-1], abs=0.4)


def loss(w, gram, cross):
    return w @ gram @ w - 2 * cross @ w


def test_weights_of_fifty_members():
    """No feasible direction improves: the conditions of an optimum hold."""
    rng = np.random.default_rng(3)
    for k, n in ((50, 400), (50, 30), (7, 60), (1, 9)):
        p = rng.normal(size=(n, k)) + rng.normal(size=(n, 1))
        y = p[:, : max(1, k // 5)].mean(axis=1) * 1.4 + rng.normal(0, 0.2, n)
        gram, cross = p.T @ p / n, p.T @ y / n
        w = mb.simplex_weights(gram, cross)
        slope = 2 * (gram @ w - cross)
        assert (w >= 0).all() and w.sum() <= 1 + 1e-9
        price = -min(0.0, slope[w > 1e-9].min()) if (w > 1e-9).any() and w.sum() > 1 - 1e-9 else 0.0
        assert (slope + price >= -1e-5).all() and np.abs((slope + price)[w > 1e-9]).max(initial=0) < 1e-5
    assert mb.simplex_weights(np.zeros((3, 3)), np.zeros(3)).tolist() == [0, 0, 0]


def test_small_weights_against_every_active_set():
    rng = np.random.default_rng(4)
    for _ in range(40):
        p, y = rng.normal(size=(40, 4)), rng.normal(size=40) * 2
        gram, cross = p.T @ p / 40, p.T @ y / 40
        best = 0.0
        for size in range(1, 5):
            for i in itertools.combinations(range(4), size):
                g, c = gram[np.ix_(i, i)], cross[list(i)]
                edge = np.linalg.solve(np.block([[g, np.ones((size, 1))], [np.ones((1, size)), np.zeros((1, 1))]]), np.append(c, 1.0))[:size]
                for w in (np.linalg.solve(g, c), edge):
                    if (w >= 0).all() and w.sum() <= 1 + 1e-12:
                        best = min(best, loss(w, g, c))
        assert loss(mb.simplex_weights(gram, cross), gram, cross) == pytest.approx(best, abs=1e-10)


def test_weights_by_fold(spark):
    rng = np.random.default_rng(5)
    rows = [(f, *map(float, m), float(m[f % 3])) for f in range(3) for m in rng.normal(size=(80, 3))] + [(9, 1.0, 1.0, 1.0, 1.0)] * 3 + [(0, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, ideal double").repartition(6)
    found = mb.meta_weights_by(df, ["a", "b", "c"], ["fold"], [0.2, 0.3, 0.5]).toPandas().pivot(index="fold", columns="member", values="weight")
    assert np.allclose(found.loc[[0, 1, 2]].to_numpy(), np.eye(3), atol=1e-6) and found.loc[9].tolist() == [0.2, 0.3, 0.5]
    assert mb.meta_weights(df.where("fold = 1"), ["a", "b", "c"], [0, 0, 0]) == pytest.approx([0, 1, 0], abs=1e-6)
    assert mb.meta_weights(df.where("fold = 77"), ["a", "b", "c"], [0.1, 0.2, 0.3]) == [0.1, 0.2, 0.3]
