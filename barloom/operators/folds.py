"""Folds as tables: purged walk-forward, rolling slices and what keeps them honest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def purged_folds(counts: DataFrame, k: int, purge: int, embargo: float, rolling: bool = False) -> DataFrame:
    """``(symbol, fold, train_lo, train_hi, test_lo, test_hi, embargo_hi)`` from ``counts(symbol, n)``; ends are exclusive.

    The series is cut into k + 1 chunks; fold f tests chunk f + 1, the last to
    the end. It trains on what is ``purge`` rows before the test (two chunks
    if ``rolling``). After each test a share ``embargo`` of all rows is never
    trained on. Series below 2 (k + 1) rows have no folds; a fold without
    training rows keeps its embargo alone (``train_lo = train_hi``).
    """
    n, c = F.col("n"), F.floor(F.col("n") / (k + 1)).cast("long")
    rows = counts.where(n >= 2 * (k + 1)).withColumn("_c", c).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    lo = (F.col("fold") + 1) * F.col("_c")
    hi = F.when(F.col("fold") == k - 1, n).otherwise((F.col("fold") + 2) * F.col("_c"))
    rows = rows.withColumns({"test_lo": lo, "test_hi": hi})
    start = F.greatest(F.lit(0), F.col("test_lo") - 2 * F.col("_c")) if rolling else F.lit(0)
    rows = rows.withColumns({"train_lo": start.cast("long"), "train_hi": F.greatest(F.col("test_lo") - purge, start).cast("long")})
    return rows.withColumn("embargo_hi", F.col("test_hi") + F.floor(F.lit(embargo) * n).cast("long")).select(
        "symbol", "fold", "train_lo", "train_hi", "test_lo", "test_hi", "embargo_hi"
    )


def fold_rows(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """``rows(symbol, pos, ...)`` with ``fold`` and ``role`` (train or test); embargoed rows are not trained on.

    A row meets only the folds of its symbol, k of them, so the join adds no
    more than the rows that folds share anyway.
    """
    pos = F.col("pos")
    zones = folds.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("fold", F.col("test_hi").alias("lo"), F.col("embargo_hi").alias("hi")))).alias("zones"))
    met = rows.join(folds.join(zones, "symbol"), "symbol")
    barred = F.exists("zones", lambda z: (z["fold"] < F.col("fold")) & (pos >= z["lo"]) & (pos < z["hi"]))
    role = F.when((pos >= F.col("test_lo")) & (pos < F.col("test_hi")), "test").when((pos >= F.col("train_lo")) & (pos < F.col("train_hi")) & ~barred, "train")
    found = met.withColumn("role", role).where("role is not null")
    return found.select(*rows.columns, "fold", "role")


def positions(rows: DataFrame) -> DataFrame:
    """``pos``: the row number of each symbol, from 0."""
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1).cast("long"))


def rolling_slices(spark: SparkSession, n: int, formation: int, test: int, step: int | None = None, least_test: int = 2) -> DataFrame:
    """``(fold, form_lo, form_hi, test_lo, test_hi)``, ends exclusive, with one row kept for the last fill."""
    step = test if step is None else step
    if step < test:
        raise ValueError("the step must not be below the test length")
    last = n - 1
    starts = [s for s in range(formation, n, step) if s + least_test <= last]
    rows = [(i, s - formation, s, s, min(s + test, last)) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, "fold int, form_lo int, form_hi int, test_lo int, test_hi int")


def calendar_slices(bars: DataFrame, formation: int, test: int, step: int | None = None, least_test: int = 2) -> DataFrame:
    """``rolling_slices`` over all days of ``bars``."""
    return rolling_slices(bars.sparkSession, bars.select("ts").distinct().count(), formation, test, step, least_test)


def flatten_ends(targets: DataFrame, rows: int = 2) -> DataFrame:
    """The last ``rows`` targets of each (fold, symbol) set to 0."""
    w = Window.partitionBy("fold", "symbol").orderBy(F.desc("ts"))
    return targets.withColumn("_rn", F.row_number().over(w)).withColumn("target", F.when(F.col("_rn") <= rows, 0.0).otherwise(F.col("target"))).drop("_rn")


def drop_last_target(targets: DataFrame) -> DataFrame:
    """The last target of each (fold, symbol) set to NULL."""
    w = Window.partitionBy("fold", "symbol").orderBy(F.desc("ts"))
    return targets.withColumn("_rn", F.row_number().over(w)).withColumn("target", F.when(F.col("_rn") > 1, F.col("target"))).drop("_rn")


def fold_contract(assigned: DataFrame) -> DataFrame:
    """``(symbol, fold, role, n, first, last, row_hash)``: what a replay of a fold must find again."""
    times = F.array_join(F.transform(F.array_sort(F.collect_list("ts")), lambda t: t.cast("string")), ",")
    return assigned.groupBy("symbol", "fold", "role").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.sha2(times, 256).alias("row_hash")
    )


def contract_faults(saved: DataFrame, now: DataFrame, saved_terms: dict, now_terms: dict) -> DataFrame:
    """``(symbol, fold, role, fault)`` of contracts ``fold_contract`` that do not hold any more.

    ``terms`` are what else a replay must find again, such as the horizon, the
    target and the list of features; one that differs, or is on one side only,
    is a fault of every fold and is named.
    """
    key, names = ["symbol", "fold", "role"], ["n", "first", "last", "row_hash"]
    terms = sorted(t for t in {*saved_terms, *now_terms} if saved_terms.get(t) != now_terms.get(t))
    old = saved.where("role is not null").select(*key, F.struct(*names).alias("old"))
    both = old.join(now.where("role is not null").select(*key, F.struct(*names).alias("new")), key, "full")
    same = lambda c: F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}"))
    fault = F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "unknown").when(F.lit(bool(terms)), ", ".join(terms))
    fault = fault.when(~same("n"), "rows").when(~(same("first") & same("last")), "span").when(~same("row_hash"), "row_hash")
    return both.select(*key, fault.alias("fault")).where("fault is not null")


def require_contract(saved: DataFrame, now: DataFrame, saved_terms: dict, now_terms: dict) -> None:
    """Stops a replay whose contract does not hold."""
    found = contract_faults(saved, now, saved_terms, now_terms).orderBy("symbol", "fold", "role").limit(3).collect()
    if found:
        raise ValueError("the fold contract does not hold: " + "; ".join(f"{r['symbol']} fold {r['fold']} {r['role']}: {r['fault']}" for r in found))


def replay_rows(bars: DataFrame, saved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(found, missing)``: the bars of the saved rows ``(symbol, fold, pos, ts)``, and saved rows without a bar."""
    return saved.join(bars, ["symbol", "ts"]), saved.join(bars, ["symbol", "ts"], "left_anti")


def fold_metrics(scores: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Mean and deviation of ``metric`` over the folds where it is finite; no deviation below two."""
    x = F.when(~F.isnan("metric") & (F.abs("metric") < float("inf")), F.col("metric"))
    return scores.groupBy(*keys).agg(F.count(x).alias("folds"), F.avg(x).alias("mean"), F.when(F.count(x) >= 2, F.stddev_samp(x)).alias("std"))


def leaks(assigned: DataFrame, folds: DataFrame, purge: int) -> DataFrame:
    """Training rows within ``purge`` rows of their test or inside an earlier embargo: none, if folds are sound."""
    train = assigned.where("role = 'train'").join(folds, ["symbol", "fold"])
    near = train.where((F.col("pos") > F.col("test_lo") - 1 - purge) & (F.col("pos") < F.col("test_hi"))).select("symbol", "fold", "pos")
    zones = folds.select("symbol", F.col("fold").alias("_of"), F.col("test_hi").alias("_lo"), F.col("embargo_hi").alias("_hi"))
    inside = train.join(zones, "symbol").where("_of < fold and pos >= _lo and pos < _hi").select("symbol", "fold", "pos")
    return near.union(inside).distinct()


def complete_folds(artifacts: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(complete, broken)``: folds that have every required artifact, and symbols that have none such."""
    full = artifacts.where(F.col("artifact").isin(required)).groupBy("symbol", "fold").agg(F.count_distinct("artifact").alias("n")).where(F.col("n") == len(required)).drop("n")
    return full, artifacts.select("symbol").distinct().join(full, "symbol", "left_anti")
