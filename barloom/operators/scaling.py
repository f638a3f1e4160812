"""Scalers fitted on training rows and applied to any row; the state is a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def log_volume(frame: DataFrame, columns: list[str]) -> DataFrame:
    """log1p of volumes, where zero, missing and infinite count as 1."""
    ok = lambda c: F.when((F.col(c) != 0) & (F.abs(c) < float("inf")) & ~F.isnan(c), F.col(c)).otherwise(1.0)
    return frame.withColumns({c: F.log1p(ok(c)) for c in columns})


def fit_scalers(train: DataFrame, groups: dict[str, list[str]], clipped: tuple[str, ...] = ("price", "technical"), minmax: tuple[str, ...] = ("price", "volume")) -> DataFrame:
    """``(symbol, fold, column, low, high, center, width)`` from training rows.

    Columns of a clipped group are first held within three deviations of their
    mean, both taken on rows that are complete in the group; without spread
    there is no bound. Price and volume map to [0, 1], other groups to zero
    mean and unit population deviation; a width of 0 becomes 1.
    """
    keys = ["symbol", "fold"]
    out = None
    for group, columns in groups.items():
        full = F.lit(True)
        for c in columns:
            full = full & F.col(c).isNotNull()
        bound = []
        for c in columns:
            x = F.when(full, F.col(c))
            bound += [F.avg(x).alias(f"_m_{c}"), F.stddev_samp(x).alias(f"_s_{c}")]
        limits = train.groupBy(*keys).agg(*bound)
        held = train.select(*keys, *columns).join(limits, keys)
        stats = []
        for c in columns:
            dev = F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")) if group in clipped else F.lit(None).cast("double")
            low, high = F.col(f"_m_{c}") - 3 * dev, F.col(f"_m_{c}") + 3 * dev
            x = F.when(low.isNull(), F.col(c)).otherwise(F.least(F.greatest(F.col(c), low), high))
            x = F.when(F.col(c).isNotNull(), x)
            center, width = (F.min(x), F.max(x) - F.min(x)) if group in minmax else (F.avg(x), F.stddev_pop(x))
            stats.append(F.struct(F.lit(c).alias("column"), F.first(low).alias("low"), F.first(high).alias("high"), center.alias("center"), F.when(width > 0, width).otherwise(1.0).alias("width")))
        table = held.groupBy(*keys).agg(F.array(*stats).alias("_a")).select(*keys, F.inline("_a"))
        out = table if out is None else out.unionByName(table)
    return out


def apply_scalers(frame: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """``frame(symbol, fold, ts, ...)`` with ``columns`` clipped, filled forward, then with 0, and scaled.

    The state of a fold is a map in one row, joined on (symbol, fold). A
    column that the state lacks passes through.
    """
    maps = state.groupBy("symbol", "fold").agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high", "center", "width")))).alias("_state"))
    w = Window.partitionBy("symbol", "fold").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    rows = frame.join(maps, ["symbol", "fold"])
    out = {}
    for c in columns:
        s = F.col("_state")[c]
        held = F.when(F.col(c).isNull() | s["low"].isNull(), F.col(c)).otherwise(F.least(F.greatest(F.col(c), s["low"]), s["high"]))
        filled = F.coalesce(F.last(held, ignorenulls=True).over(w), F.lit(0.0))
        out[c] = F.when(s.isNull(), F.col(c)).otherwise((filled - s["center"]) / s["width"])
    return rows.withColumns(out).drop("_state")


def missing_columns(state: DataFrame, columns: list[str]) -> list[str]:
    """Fitted columns that a frame lacks; a replay stops if there are any."""
    fitted = {r[0] for r in state.select("column").distinct().collect()}
    return sorted(fitted - set(columns))


def replay(frame: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """``symbol, fold, ts`` and exactly the saved ``columns`` of ``frame``, scaled by each row's fold; a saved column that either lacks stops the replay."""
    lacking = sorted((set(columns) - set(frame.columns)) | (set(columns) - {r[0] for r in state.select("column").distinct().collect()}))
    if lacking:
        raise ValueError(f"saved columns are missing: {', '.join(lacking)}")
    return apply_scalers(frame, state, columns).select("symbol", "fold", "ts", *columns)


def restandardize(frame: DataFrame, train: DataFrame, columns: list[str], low: float = 0.1, high: float = 1.5) -> DataFrame:
    """Columns whose training deviation is out of [low, high] are standardised once more, by training figures."""
    keys = ["symbol", "fold"]
    stats = train.groupBy(*keys).agg(*(s for c in columns for s in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))))
    rows = frame.join(stats, keys)
    again = {c: F.when((F.col(f"_s_{c}") > high) | (F.col(f"_s_{c}") < low), (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-8)).otherwise(F.col(c)) for c in columns}
    return rows.withColumns(again).select(*frame.columns)


def sparse_columns(frame: DataFrame, columns: list[str], most_null: float = 0.3) -> DataFrame:
    """``(column, null_share, dropped)`` in one pass over the frame."""
    shares = frame.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNull().cast("double")).alias("null_share")) for c in columns)).alias("a"))
    return shares.select(F.inline("a")).withColumn("dropped", F.col("null_share") > most_null)


def fill_features(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Features filled forward, then with 0; labels are left alone."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumns({c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.lit(0.0)) for c in columns})
