"""News to bars, point in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: The words that count for and against.
POSITIVE = (
    "positive", "bullish", "upbeat", "optimistic", "growth", "profit", "up", "gain", "surge", "rally", "strong", "beat",
    "exceed", "outperform", "upgrade", "buy", "recommend", "success", "innovation", "partnership", "launch", "record", "dividend", "buyback",
)
NEGATIVE = (
    "negative", "bearish", "pessimistic", "downbeat", "decline", "loss", "down", "drop", "fall", "plunge", "weak", "miss",
    "underperform", "downgrade", "sell", "avoid", "fail", "layoff", "cut", "delay", "recall", "investigation", "lawsuit", "debt", "default", "bankruptcy",
)


def keyword_hits(title: Column, description: Column, words: tuple[str, ...]) -> Column:
    """How many of ``words`` stand anywhere in title or description, in parts of longer words too."""
    t, d = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(description, F.lit("")))
    return sum(((t.contains(w) | d.contains(w)).cast("int") for w in words), F.lit(0))


def score_of_hits(p: Column, n: Column) -> Column:
    """(p - n) / (p + n), 0 without any."""
    return F.when(p + n > 0, (p - n) / (p + n)).otherwise(0.0)


def keyword_score(title: Column, description: Column, positive: tuple[str, ...] = POSITIVE, negative: tuple[str, ...] = NEGATIVE) -> Column:
    return score_of_hits(keyword_hits(title, description, positive), keyword_hits(title, description, negative))


def keyword_scores(articles: DataFrame, title: str = "title", description: str = "description") -> DataFrame:
    """``articles`` with ``score``; the words are looked for once, in a projection of their own."""
    t, d = F.col(title), F.col(description)
    counted = articles.withColumn("_hits", F.array(keyword_hits(t, d, POSITIVE), keyword_hits(t, d, NEGATIVE)))
    return counted.withColumn("score", score_of_hits(F.col("_hits")[0], F.col("_hits")[1])).drop("_hits")


def chunked_score(articles: DataFrame, scorer: Callable[[Column], Column], window: int, overlap: int, text: str = "description") -> DataFrame:
    """``(article_id, score)``: the mean over windows of ``window`` tokens, each ``window - overlap`` on, until one reaches the end.

    ``scorer`` maps the text of a window to a number. Texts without tokens score 0.
    """
    stride = max(1, window - overlap)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    rows = articles.select("article_id", words.alias("w")).withColumn("_n", F.size("w"))
    last = F.greatest(F.ceil((F.col("_n") - window) / stride), F.lit(0)).cast("int")
    chunks = rows.where("_n > 0").select("article_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i * stride + 1, F.lit(window)), " "))).alias("chunk"))
    scored = chunks.groupBy("article_id").agg(F.avg(scorer(F.col("chunk"))).alias("score"))
    return rows.select("article_id").join(scored, "article_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def with_published(news: DataFrame, text: str) -> DataFrame:
    """``published`` in seconds from RFC 3339 text; a time without a zone is UTC, anything else NULL."""
    zoned = F.when(F.col(text).rlike(r"([zZ]|[+-]\d\d:?\d\d)$"), F.col(text)).otherwise(F.concat(F.col(text), F.lit("Z")))
    return news.withColumn("published", F.unix_timestamp(F.try_to_timestamp(zoned)))


def to_bars(news: DataFrame, closes: DataFrame) -> DataFrame:
    """``news(symbol, published, ...)`` with ``ts`` of the first bar whose ``close_at`` is not before it.

    News before the first bar belongs to that bar; news after the last bar or
    without a time is dropped. Both tables share one sort for each symbol; no
    article is compared with more than one bar.
    """
    others = [c for c in news.columns if c not in ("symbol", "published")]
    left = news.where("published is not null").select("symbol", F.col("published").alias("_at"), F.lit(0).alias("_bar"), F.lit(None).cast(closes.schema["ts"].dataType).alias("_ts"), F.struct("published", *others).alias("_n"))
    right = closes.select("symbol", F.col("close_at").alias("_at"), F.lit(1).alias("_bar"), F.col("ts").alias("_ts"), F.lit(None).cast(left.schema["_n"].dataType).alias("_n"))
    # the next bar is the last one seen from the end: a growing frame, where one over all rows to come is read anew for each row
    w = Window.partitionBy("symbol").orderBy(F.desc("_at"), F.desc("_bar")).rowsBetween(Window.unboundedPreceding, 0)
    placed = left.unionByName(right).withColumn("ts", F.last("_ts", ignorenulls=True).over(w)).where("_bar = 0 and ts is not null")
    return placed.select("symbol", "ts", "_n.*")


def bar_sentiment(placed: DataFrame, calendar: DataFrame) -> DataFrame:
    """``score``, ``news`` and ``momentum`` of every bar of ``calendar(symbol, ts)``; bars without news are 0.

    Momentum is the mean of the newer half less that of the rest, newest
    first; one article gives 0.
    """
    key = ["symbol", "ts"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("published"), "article_id"))
    ranked = placed.withColumns({"_rn": rank, "_n": F.count("*").over(Window.partitionBy(*key))})
    newer = F.col("_rn") <= F.floor(F.col("_n") / 2)
    bars = ranked.groupBy(*key).agg(
        F.avg("score").alias("score"), F.count("*").alias("news"),
        F.when(F.count("*") >= 2, F.avg(F.when(newer, F.col("score"))) - F.avg(F.when(~newer, F.col("score")))).otherwise(0.0).alias("momentum"),
    )
    return calendar.select(*key).join(bars, key, "left").fillna(0.0, subset=["score", "momentum"]).fillna(0, subset=["news"])
