"""The causal operators on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.operators.conformal import adapt


def stream_bars(trades: DataFrame, size: str, late: str) -> DataFrame:
    """Tumbling bars of ``trades(symbol, ts, price, size, order)``; later rows than the watermark are dropped."""
    timed = trades.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    at = F.struct("ts", "order")
    bars = timed.groupBy("symbol", F.window("ts", size).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_mean(bars: DataFrame, size: str, slide: str, late: str) -> DataFrame:
    """Mean close over sliding windows of time; the batch form counts rows instead."""
    timed = bars.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("symbol", F.window("ts", size, slide).alias("w")).agg(F.avg("close").alias("mean")).select("symbol", F.col("w.end").alias("ts"), "mean")


def stream_sentiment(news: DataFrame, calendar: DataFrame, late: str) -> DataFrame:
    """Score, number and momentum of the news of each bar; ``calendar(symbol, prev_close, close_at)`` is static.

    The closes of a symbol are one sorted array, so a piece of news meets its
    symbol's row alone; the first close at or after it is its bar, which is
    given out once the watermark has passed it. Momentum is
    the mean of the newer half less that of the rest, 0 below two.
    """
    closes = calendar.groupBy("symbol").agg(F.array_sort(F.collect_list("close_at")).alias("closes"))
    timed = news.withColumn("published", F.col("published").cast("timestamp")).join(closes, "symbol")
    placed = timed.withColumn("close_at", F.get(F.filter("closes", lambda c: c >= F.col("published")), F.lit(0))).where("close_at is not null").withWatermark("close_at", late)
    items = F.array_sort(F.collect_list(F.struct((-F.unix_micros("published")).alias("at"), "article_id", "score")))
    bars = placed.groupBy("symbol", "close_at").agg(F.avg("score").alias("score"), F.count("*").alias("news"), items.alias("n"))
    half = F.floor(F.size("n") / 2).cast("int")
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda s, x: s + x["score"]) / F.size(part)
    momentum = F.when(F.size("n") >= 2, mean(F.slice("n", F.lit(1), half)) - mean(F.slice("n", half + 1, F.size("n")))).otherwise(0.0)
    return bars.select("symbol", "close_at", "score", "news", momentum.alias("momentum"))


def _keyed(rows: DataFrame, key: str, step: Callable[[Any, dict], tuple[Any, Any]], kind: str, columns: list[str], name: str) -> DataFrame:
    """A scan of each key with its state kept between batches; rows of a batch run in order of ``ts``."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        out = []
        for row in frame.to_dict("records"):
            held, value = step(held, {c: None if v != v else v for c, v in row.items()})
            out.append(value)
        state.update((held,))
        yield frame[[key, "ts"]].assign(**{name: out})

    picked = rows.select(key, F.col("ts").cast("timestamp").alias("ts"), *columns)
    return picked.groupBy(key).applyInPandasWithState(run, f"{key} string, ts timestamp, {name} {kind}", f"held {kind}", "append", GroupStateTimeout.NoTimeout)


def stream_alpha(misses: DataFrame, target: float = 0.1, rate: float = 0.02) -> DataFrame:
    """Adaptive alpha of ``misses(symbol, ts, miss)``."""

    def step(alpha, row):
        alpha = target if alpha is None else alpha
        if row["miss"] is not None:
            alpha = adapt(alpha, int(row["miss"]), target, rate)
        return alpha, alpha

    return _keyed(misses, "symbol", step, "double", ["miss"], "alpha")


def stream_states(scores: DataFrame, step: Callable[[Any, dict], tuple[Any, tuple]], columns: list[str]) -> DataFrame:
    """States of the batch operators' step functions, such as ``reversion_step`` or ``band_step``."""

    def one(held, row):
        held, values = step(held, row)
        return held, values[0]

    return _keyed(scores, "symbol", one, "int", columns, "state")
