"""Gradient-boosted trees with the fold as a key: all folds grow at once.

Features are cut into bins by quantiles of each fold's training rows. A level
of a tree is one aggregation: rows add their residual to the cell (fold, node,
feature, bin), and the best split of every (fold, node) comes from running
sums over the bins. The trees so far are a small table that joins the rows by
fold; residuals follow from it, so no state is written from round to round,
and a lost executor costs its tasks only.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.sources.folder import stored

#: Numbers of a model (cuts of features and nodes of trees of all folds) that go to every executor at most, 64 MB.
MOST_SENT = 8_000_000

Tree = dict[str, list]


def _blank(depth: int) -> Tree:
    """A tree whose nodes all send their rows left."""
    inner = 2**depth - 1
    return {"feature": [0] * inner, "cut": [1 << 20] * inner, "leaf": [0.0] * (inner + 1)}


def _place(tree: str, steps: int) -> str:
    """SQL for the number of the node, as in a heap, that a row has reached after ``steps`` levels."""
    return f"aggregate(array_repeat(0, {steps}), 0, (i, z) -> 2 * i + 1 + int(_bins[{tree}.feature[i]] > {tree}.cut[i]))" if steps else "0"


def _summed(depth: int) -> str:
    return f"aggregate(_trees, 0D, (s, t) -> s + t.leaf[{_place('t', depth)} - {2**depth - 1}])"


_TREE = "struct<feature: array<int>, cut: array<int>, leaf: array<double>>"


def _constant(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table that the plan carries, for every executor."""
    text = json.dumps(rows, default=str)
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>"))))


class _Folds:
    """Cuts, means and trees of every fold."""

    def __init__(self, train: DataFrame, features: list[Column], label: str, fold: str, bins: int, depth: int, rounds: int):
        self.fold, self.kind, self.depth, self.features = fold, train.schema[fold].dataType.simpleString(), depth, features
        levels = [i / bins for i in range(1, bins)]
        edges = [F.percentile_approx(x, levels, 10000).alias(f"_e{i}") for i, x in enumerate(features)]
        rows = train.groupBy(fold).agg(F.avg(label).alias("_base"), *edges).collect()  # a row for each fold
        size = len(rows) * (len(features) * bins + rounds * 3 * 2**depth)
        if size > MOST_SENT:
            raise ValueError(f"the models of {len(rows)} folds hold {size} numbers; boost fewer folds at a time")
        self.base = {r[fold]: r["_base"] or 0.0 for r in rows}
        self.edges = {r[fold]: [sorted(set(r[f"_e{i}"] or [])) for i in range(len(features))] for r in rows}
        self.trees: dict[Any, list[Tree]] = {f: [] for f in self.base}

    def binned(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_base`` and ``_bins``: how many cuts are below each feature; NULL in a fold without training rows."""
        cuts = _constant(rows.sparkSession, [{self.fold: f, "_base": b, "_edges": self.edges[f]} for f, b in self.base.items()], f"`{self.fold}` {self.kind}, _base double, _edges array<array<double>>")
        cell = lambda i, x: F.size(F.filter(F.get("_edges", F.lit(i)), lambda e: e < x))
        joined = rows.join(cuts, self.fold, "left")
        return joined.withColumn("_bins", F.when(F.col("_base").isNotNull(), F.array(*(cell(i, x) for i, x in enumerate(self.features))))).drop("_edges")

    def models(self, spark: SparkSession, growing: dict[Any, Tree]) -> DataFrame:
        rows = [{self.fold: f, "_trees": trees, "_growing": growing[f]} for f, trees in self.trees.items()]
        return _constant(spark, rows, f"`{self.fold}` {self.kind}, _trees array<{_TREE}>, _growing {_TREE}")


def _splits(cells: DataFrame, fold: str, least: int) -> DataFrame:
    """``(fold, node, s, n, best)`` from ``cells(fold, node, feature, bin, s, n)``; ``best`` is NULL where no cut leaves ``least`` rows on both sides and gains."""
    one = f"partition by `{fold}`, node, feature"
    sums = cells.selectExpr("*", f"sum(s) over ({one} order by bin) as ls", f"sum(n) over ({one} order by bin) as ln", f"sum(s) over ({one}) as ts", f"sum(n) over ({one}) as tn")
    gain = f"case when ln >= {least} and tn - ln >= {least} then ls * ls / ln + (ts - ls) * (ts - ls) / (tn - ln) - ts * ts / tn end"
    found = sums.selectExpr("*", f"{gain} as gain").selectExpr(f"`{fold}`", "node", "ts", "tn", "case when gain > 1e-12 then struct(gain, -feature as _f, -bin as _b, ls, ln) end as cut")
    return found.groupBy(fold, "node").agg(F.expr("max(ts) as s"), F.expr("max(tn) as n"), F.expr("max(cut) as best"))


def boosted_folds(
    rows: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 5,
    fold: str = "fold", role: str = "role",
) -> tuple[DataFrame, DataFrame]:
    """``(predictions, importance)`` of boosted regression trees, one model for each fold, from its rows with the role ``train``.

    ``predictions`` are the rows with the role ``test`` and their ``forecast``
    (NULL in a fold without training rows); ``importance(fold, feature,
    importance)`` is a feature's share of the fold's gains. Missing features
    count as 0, missing labels as the fold's training mean. There are ``rounds
    * depth`` aggregations, whatever the number of folds.
    """
    number = lambda name: F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    train, test = rows.where(F.col(role) == "train"), rows.where(F.col(role) == "test")
    folds = _Folds(train, [number(f) for f in features], label, fold, bins, depth, rounds)
    spark = rows.sparkSession
    residual = F.coalesce(F.col(label).cast("double") - F.col("_base"), F.lit(0.0))
    table = stored(folds.binned(train).select(fold, residual.alias("_y"), "_bins"), "boosting")
    gains: dict[Any, list[float]] = {f: [0.0] * len(features) for f in folds.base}
    for _ in range(rounds if folds.base else 0):
        growing = {f: _blank(depth) for f in folds.base}
        for level in range(depth):
            state = table.join(folds.models(spark, growing), fold)
            left = state.selectExpr(f"`{fold}`", "_bins", f"{_place('_growing', level)} as node", f"_y - {_summed(depth)} as _r")
            cells = left.selectExpr(f"`{fold}`", "node", "_r", "posexplode(_bins) as (feature, bin)")
            cells = cells.groupBy(fold, "node", "feature", "bin").agg(F.expr("sum(_r) as s"), F.expr("count(*) as n"))
            for r in _splits(cells, fold, least).collect():  # a row for each node of each fold
                tree, node, best = growing[r[fold]], r["node"], r["best"]
                sides = ((r["s"], r["n"]), (0.0, 0))
                if best is not None:
                    tree["feature"][node], tree["cut"][node] = -best["_f"], -best["_b"]
                    gains[r[fold]][-best["_f"]] += best["gain"]
                    sides = ((best["ls"], best["ln"]), (r["s"] - best["ls"], r["n"] - best["ln"]))
                if level == depth - 1:
                    first = 2 * node + 1 - (2**depth - 1)
                    tree["leaf"][first : first + 2] = [rate * s / n if n else 0.0 for s, n in sides]
        for f, tree in growing.items():
            folds.trees[f].append(tree)
    blank = {f: _blank(depth) for f in folds.base}
    predicted = folds.binned(test).join(folds.models(spark, blank), fold, "left").withColumn("forecast", F.expr(f"_base + {_summed(depth)}"))
    total = {f: math.fsum(g) or 1.0 for f, g in gains.items()}
    shares = [{fold: f, "feature": name, "importance": v / total[f]} for f, g in gains.items() for name, v in zip(features, g, strict=True)]
    importance = _constant(spark, shares, f"`{fold}` {folds.kind}, feature string, importance double")
    return predicted.select(*rows.columns, "forecast"), importance
