"""Boosted trees of all folds against a plain version, fold by fold."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import members as mb
from barloom.operators.boosting import boosted_folds

ROWS = "fold int, role string, k int, a double, b double, c double, y double"


def sample(seed=1, n=160, folds=(0, 1, 3)):
    rng = np.random.default_rng(seed)
    rows = []
    for fold in folds:
        x = rng.normal(size=(n, 3)).round(2)
        y = np.where(x[:, 0] > 0.3, 2.0, -1.0) * (1 + fold) + np.where(x[:, 1] < -0.2, 1.5, 0) + rng.normal(0, 0.3, n)
        rows += [(fold, "train" if i < n * 3 // 4 else "test", i, *map(float, x[i]), float(y[i])) for i in range(n)]
    return rows


def plain(rows, rounds, depth, rate, bins, least):
    """Trees of one fold with numpy; ``{k: forecast}`` and gains."""
    num = lambda v: 0.0 if v is None or math.isnan(v) else v
    x = np.array([[num(v) for v in r[3:6]] for r in rows])
    train = np.array([r[1] == "train" for r in rows])
    known = [r[6] for r in rows if r[1] == "train" and r[6] is not None]
    base = sum(known) / len(known)
    left = np.array([(r[6] if r[6] is not None else base) - base for r in rows])
    cells = np.zeros(x.shape, int)
    for j in range(3):
        s = np.sort(x[train, j])
        edges = sorted({s[max(0, math.ceil(i / bins * len(s)) - 1)] for i in range(1, bins)})
        cells[:, j] = np.searchsorted(edges, x[:, j], side="left")
    forecast, gains = np.full(len(rows), base), np.zeros(3)
    for _ in range(rounds):
        node = np.zeros(len(rows), int)
        for _ in range(depth):
            following = 2 * node
            for v in np.unique(node[train]):
                at = train & (node == v)
                s, n, best = left[at].sum(), at.sum(), None
                for j in range(3):
                    for cut in np.unique(cells[at, j]):
                        low = at & (cells[:, j] <= cut)
                        ls, ln = left[low].sum(), low.sum()
                        if ln < least or n - ln < least:
                            continue
                        gain = ls * ls / ln + (s - ls) ** 2 / (n - ln) - s * s / n
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, j, cut)
                if best:
                    gains[best[1]] += best[0]
                    following[(node == v) & (cells[:, best[1]] > best[2])] += 1
            node = following
        for v in np.unique(node):
            at = train & (node == v)
            step = rate * left[at].mean() if at.any() else 0.0
            left[node == v] -= step
            forecast[node == v] += step
    return {r[2]: f for r, f in zip(rows, forecast, strict=True) if r[1] == "test"}, gains / gains.sum()


@pytest.mark.parametrize("depth, least", [(1, 1), (3, 5)])
def test_folds_grow_as_alone(spark, depth, least):
    rows = sample()
    rows[3] = (*rows[3][:4], None, float("nan"), None)
    rows[150] = (*rows[150][:3], None, 0.1, 0.2, None)
    found, importance = boosted_folds(spark.createDataFrame(rows, ROWS), ["a", "b", "c"], "y", 4, depth, 0.3, 16, least)
    got = {(r["fold"], r["k"]): r["forecast"] for r in found.collect()}
    shares = {(r["fold"], r["feature"]): r["importance"] for r in importance.collect()}
    assert len(got) == 3 * 40
    for fold in (0, 1, 3):
        want, gains = plain([r for r in rows if r[0] == fold], 4, depth, 0.3, 16, least)
        assert {k: got[fold, k] for k in want} == pytest.approx(want, rel=1e-9)
        assert [shares[fold, f] for f in "abc"] == pytest.approx(list(gains), rel=1e-9)


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_depend_on_folds(spark):
    run = lambda folds: boosted_folds(spark.createDataFrame(sample(n=60, folds=folds), ROWS), ["a", "b"], "y", 2, 2)
    one, many = jobs_of(spark, "one", lambda: run((0,))), jobs_of(spark, "many", lambda: run(tuple(range(12))))
    assert many <= one + 4  # single jobs of the adaptive planner come and go


def test_trees_have_skill(spark):
    rows = sample(n=400)
    found, _ = boosted_folds(spark.createDataFrame(rows, ROWS), ["a", "b", "c"], "y", 12, 2, 0.4)
    errors = found.groupBy("fold").agg(F.avg(F.abs(F.col("forecast") - F.col("y"))).alias("mae"), F.stddev_samp("y").alias("apart")).collect()
    assert len(errors) == 3 and all(r["mae"] < 0.4 * r["apart"] for r in errors)


def test_folds_without_training_rows(spark):
    rows = [(7, "test", 1, 0.1, 0.2, 0.3, 1.0), *sample(n=40, folds=(0,))]
    found, _ = boosted_folds(spark.createDataFrame(rows, ROWS), ["a"], "y", 2, 2)
    assert {r["fold"]: r["forecast"] is None for r in found.collect()} == {7: True, 0: False}
    nothing, shares = boosted_folds(spark.createDataFrame([], ROWS), ["a"], "y", 2, 2)
    assert nothing.count() == shares.count() == 0
    flat, shares = boosted_folds(spark.createDataFrame([(0, "train", i, 1.0, 1.0, 1.0, 5.0) for i in range(9)] + [(0, "test", 9, 2.0, 2.0, 2.0, None)], ROWS), ["a", "b"], "y", 2, 2)
    assert flat.first()["forecast"] == 5.0 and {r["importance"] for r in shares.collect()} == {0.0}


def test_forecast_of_two_tables(spark):
    rows = spark.createDataFrame(sample(n=200, folds=(0,)), ROWS)
    found, importance = mb.boosted_forecast(rows.where("role = 'train'"), rows.where("role = 'test'"), ["a", "b", "c"], "y")
    assert found.columns == [*rows.columns, "forecast"] and found.count() == 50
    assert [r["feature"] for r in importance.collect()][0] == "a"
