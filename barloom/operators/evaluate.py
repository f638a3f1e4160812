"""Performance statistics that allow for overfitting."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.functions.normal import norm_cdf, norm_ppf, norm_upper, psr_argument
from barloom.functions.windows import compounded

EULER_GAMMA = 0.5772156649015329


def periodic_sharpe(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Mean over deviation of ``ret``; NULL below two rows or without spread."""
    dev = F.stddev_samp("ret")
    return returns.groupBy(*keys).agg(F.count("ret").alias("n"), F.when((F.count("ret") >= 2) & (dev > 1e-15), F.avg("ret") / dev).alias("sharpe"))


def moments(returns: DataFrame, keys: list[str]) -> DataFrame:
    """``n, sharpe, skew, kurt`` with population moments, kurtosis not in excess."""
    x = F.col("ret")
    dev = F.stddev_samp(x)
    return returns.groupBy(*keys).agg(
        F.count(x).alias("n"), F.when((F.count(x) >= 2) & (dev > 1e-15), F.avg(x) / dev).alias("sharpe"),
        F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"),
    )


def psr_z(stats: DataFrame, benchmark: float | Column = 0.0) -> DataFrame:
    """``z``: the probabilistic Sharpe ratio's argument; NULL below three rows."""
    return stats.withColumn("z", psr_argument(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurt"), benchmark))


def with_psr(stats: DataFrame, benchmark: float | Column = 0.0) -> DataFrame:
    return psr_z(stats, benchmark).withColumn("psr", norm_cdf(F.col("z")))


def expected_max_factor(n: int) -> float:
    """Expected maximum of ``n`` standard normal trials (False Strategy Theorem)."""
    return (1 - EULER_GAMMA) * norm_ppf(1 - 1 / n) + EULER_GAMMA * norm_ppf(1 - 1 / (n * math.e))


def expected_max_sharpe(trials: DataFrame, declared: int | None = None) -> float | None:
    """The Sharpe ratio that the best of all trials reaches by luck, from ``trials(sharpe)``; NULL below two trials.

    ``declared`` counts trials that are not recorded; the larger number holds.
    """
    r = trials.where("sharpe is not null").agg(F.count("*").alias("n"), F.stddev_samp("sharpe").alias("dev")).first()
    n = max(r["n"], declared or 0)
    if r["n"] < 2:
        return None
    return 0.0 if (r["dev"] or 0.0) < 1e-15 else r["dev"] * expected_max_factor(n)


def deflated_sharpe(returns: DataFrame, trials: DataFrame, keys: list[str], declared: int | None = None) -> DataFrame:
    """PSR of each key against the expected maximum over ``trials``."""
    level = expected_max_sharpe(trials, declared)
    return with_psr(moments(returns, keys), 0.0 if level is None else level).withColumn("benchmark", F.lit(level).cast("double"))


def deflate(stats: DataFrame, trials: DataFrame, keys: list[str], declared: int | None = None) -> DataFrame:
    """``stats(n, sharpe, skew, kurt)`` with ``trials, sr_null, psr, dsr`` from ``trials(sharpe)`` of the same ``keys``.

    The factor of the expected maximum depends on the number of trials alone.
    NULL below two trials.
    """
    level = trials.where("sharpe is not null").groupBy(*keys).agg(F.count("*").alias("trials"), F.stddev_samp("sharpe").alias("_dev"))
    most = F.greatest(F.col("trials"), F.lit(declared or 0))
    level = level.withColumn("_most", most.cast("double"))
    factor = (1 - EULER_GAMMA) * norm_upper(1 / F.col("_most")) + EULER_GAMMA * norm_upper(1 / (F.col("_most") * math.e))
    null = F.when(F.col("trials") >= 2, F.when(F.coalesce("_dev", F.lit(0.0)) < 1e-15, 0.0).otherwise(F.col("_dev") * factor))
    both = stats.join(level.withColumn("sr_null", null).drop("_dev", "_most"), keys, "left") if keys else stats.withColumn("_k", F.lit(1)).join(F.broadcast(level.withColumn("sr_null", null).withColumn("_k", F.lit(1))), "_k", "left").drop("_k", "_dev", "_most")
    plain = psr_z(both, 0.0).withColumnRenamed("z", "psr_z")
    return psr_z(plain, F.col("sr_null")).withColumnRenamed("z", "dsr_z").withColumns({"psr": norm_cdf(F.col("psr_z")), "dsr": norm_cdf(F.col("dsr_z"))})


def overfitting_splits(slices: int) -> list[tuple[int, int]]:
    """``(split, slice)`` of every in-sample half; the other slices are out of sample."""
    if slices < 2 or slices % 2:
        raise ValueError("the number of slices must be even")
    return [(k, s) for k, half in enumerate(itertools.combinations(range(slices), slices // 2)) for s in half]


def split_scores(returns: DataFrame, slices: int) -> DataFrame:
    """``(split, strategy, inside, outside, rank, best)`` from ``returns(pos, strategy, ret)``, pos from 0 in time order.

    Rows collapse to three moments for each slice and strategy before splits
    multiply them. ``rank`` orders the out-of-sample ratios ascending, ties by
    strategy; ``best`` marks the highest in-sample ratio, the first on ties.
    """
    spark, size = returns.sparkSession, (returns.agg(F.max("pos") + 1).first()[0] or 0) // slices
    parts = returns.where(F.col("pos") < size * slices).withColumn("slice", (F.col("pos") / max(1, size)).cast("int"))
    sums = parts.groupBy("strategy", "slice").agg(F.count("ret").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    chosen = F.from_json(F.lit(str([list(x) for x in overfitting_splits(slices)])), "array<array<int>>")
    halves = spark.range(1).select(F.explode(chosen).alias("x")).groupBy(F.col("x")[0].alias("split")).agg(F.collect_set(F.col("x")[1]).alias("half"))
    # C(S, S/2) splits, a number that the data does not change
    pieces = sums.withColumn("_k", F.lit(1)).join(F.broadcast(halves.withColumn("_k", F.lit(1))), "_k")
    inside = F.array_contains("half", F.col("slice"))

    def ratio(mask: Column) -> Column:
        n, s, q = (F.sum(F.when(mask, F.col(c)).otherwise(0)) for c in ("n", "s", "q"))
        var = (q - s * s / n) / (n - 1)
        return F.when((n >= 2) & (var > 1e-24), s / n / F.sqrt(var)).otherwise(0.0)

    both = pieces.groupBy("split", "strategy").agg(ratio(inside).alias("inside"), ratio(~inside).alias("outside"))
    up = Window.partitionBy("split").orderBy("outside", "strategy")
    top = Window.partitionBy("split").orderBy(F.desc("inside"), "strategy")
    return both.withColumns({"rank": F.row_number().over(up), "best": F.row_number().over(top) == 1})


def backtest_overfitting(returns: DataFrame, slices: int = 10) -> DataFrame:
    """``(pbo, splits)``: how often the best in-sample strategy is below the median out of sample."""
    scored = split_scores(returns, slices)
    width = F.count("*").over(Window.partitionBy("split"))
    picked = scored.withColumn("_n", width).where("best").withColumn("over", (F.col("rank") / (F.col("_n") + 1) < 0.5).cast("double"))
    return picked.agg(F.avg("over").alias("pbo"), F.count("*").alias("splits"))


def expand_grid(spark, axes: dict[str, list]) -> DataFrame:
    """Every combination of the axes as ``(trial, ...)``, the last axis moving fastest."""
    rows = [(i, *values) for i, values in enumerate(itertools.product(*axes.values()))]
    kinds = ["double" if any(isinstance(v, float) for v in a) else "string" if isinstance(a[0], str) else "int" for a in axes.values()]
    return spark.createDataFrame(rows, ", ".join(["trial int", *(f"{n} {k}" for n, k in zip(axes, kinds, strict=True))]))


def grid_of_values(table: DataFrame, columns: list[str]) -> DataFrame:
    """Every combination of the columns' values as ``(trial, ...)``, in their order, the last column moving fastest."""
    out = table.agg(*(F.array_sort(F.collect_set(c)).alias(c) for c in columns))
    for c in columns:
        out = out.withColumn(c, F.explode(c))
    return out.withColumn("trial", F.row_number().over(Window.orderBy(*columns)) - 1).select("trial", *columns)


def best_deflated(returns: DataFrame, run: str, groups: list[str]) -> DataFrame:
    """Of each group the run with the highest Sharpe ratio (the first on ties), deflated by all runs of the group.

    ``returns(run, *groups, ret)``; gives ``run, n_valid, mean, std, best`` and
    what ``deflate`` adds.
    """
    stats = moments(returns, [*groups, run])
    ok = stats.where("sharpe is not null")
    top = F.row_number().over(Window.partitionBy(*groups or [F.lit(0)]).orderBy(F.desc("sharpe"), run))
    best = ok.withColumn("_rn", top).where("_rn = 1").drop("_rn").withColumn("best", F.col("sharpe"))
    whole = [F.count("*").alias("n_valid"), F.avg("sharpe").alias("mean"), F.stddev_samp("sharpe").alias("std")]
    if groups:
        best = best.join(ok.groupBy(*groups).agg(*whole), groups)
    else:
        best = best.withColumn("_k", F.lit(1)).join(F.broadcast(ok.agg(*whole).withColumn("_k", F.lit(1))), "_k").drop("_k")
    return deflate(best, ok, groups)


def nearest_to_mean(runs: DataFrame) -> DataFrame:
    """The ``seed`` of each member whose Sharpe ratio is nearest to the member's mean."""
    mean = F.avg("sharpe").over(Window.partitionBy("member"))
    return runs.withColumn("_d", F.abs(F.col("sharpe") - mean)).groupBy("member").agg(F.min_by("seed", F.struct("_d", "seed")).alias("seed"))


def trial_metrics(accounts: DataFrame) -> DataFrame:
    """Gross and net statistics of each portfolio; gross is net with the cost added back."""
    net, gross = F.col("net_return"), F.col("net_return") + F.col("cost")
    year = math.sqrt(252)
    return accounts.groupBy("portfolio").agg(
        F.count("*").alias("n_obs"), F.sum("cost").alias("total_cost"), F.avg("gross").alias("avg_gross"), F.max("gross").alias("max_gross"),
        *(F.when(F.stddev_samp(x) > 1e-15, F.avg(x) / F.stddev_samp(x) * year).alias(f"{name}_sharpe") for name, x in (("net", net), ("gross", gross))),
        *((compounded(x) - 1).alias(f"{name}_total") for name, x in (("net", net), ("gross", gross))),
    )


def claim_tier(stats: DataFrame, least: int = 60, level: float = 0.95) -> DataFrame:
    """``tier`` from ``n_obs, gross_sharpe, net_sharpe, dsr``: no_claim, mechanics, gross, net or robust."""
    gross, net = F.coalesce(F.col("gross_sharpe") > 0, F.lit(False)), F.coalesce(F.col("net_sharpe") > 0, F.lit(False))
    tier = F.when(F.col("n_obs") < least, "no_claim").when(net & F.coalesce(F.col("dsr") >= level, F.lit(False)), "robust").when(net, "net").when(gross, "gross")
    return stats.withColumn("tier", tier.otherwise("mechanics"))


def config_hash(configs: DataFrame, columns: list[str], length: int = 12) -> DataFrame:
    """The first digits of the SHA-256 of the columns as JSON with sorted keys."""
    text = F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))
    return configs.withColumn("config_hash", F.substring(F.sha2(text, 256), 1, length))
