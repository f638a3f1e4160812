"""Domain tables from the star-schema tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.sources.bars import bars_from_trades

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def price_bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """Bars of each brand: a line's price for each piece, by week or month of shipment."""
    line, part = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    trades = line.join(part, line["l_partkey"] == part["p_partkey"]).withColumns({
        "ts": F.to_date(F.date_trunc(unit, "l_shipdate")), "price": F.col("l_extendedprice") / F.col("l_quantity"), "size": F.col("l_quantity"),
    })
    return bars_from_trades(trades, LINE_ORDER)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type; ``ts`` in seconds."""
    hour = (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600) * 3600).cast("long")
    trades = read(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), hour.alias("ts"), F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id", F.col("ts").alias("at"))
    return bars_from_trades(trades, ["at", "event_id"])


def publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(article_id, symbol, published, doc_id)``: each event publishes the document of its id, modulo their number."""
    n = read(spark, sf_dir, "documents").count()
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("article_id"), F.col("event_type").alias("symbol"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("published"), (F.col("event_id") % n).alias("doc_id")
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, title, description)``: a document's first sentence is its title."""
    return read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("description"))


_ORDER = ", ".join(LINE_ORDER)


def bars_sql(unit: str = "week") -> str:
    return f"""trades as (
  select p_brand as symbol, cast(date_trunc('{unit}', l_shipdate) as date) as ts, l_extendedprice / l_quantity as price, lineitem.*
  from lineitem join part on l_partkey = p_partkey),
bars as (
  select symbol, ts, first(price order by {_ORDER}) as open, max(price) as high, min(price) as low,
         last(price order by {_ORDER}) as close, cast(sum(l_quantity) as double) as volume
  from trades group by symbol, ts)"""


EVENT_BARS_SQL = """ebars as (
  select event_type as symbol, cast(floor(epoch(ts) / 3600) * 3600 as bigint) as ts, first(value order by ts, event_id) as open, max(value) as high,
         min(value) as low, last(value order by ts, event_id) as close, cast(count(*) as double) as volume
  from events group by 1, 2)"""

NEWS_SQL = """news as (
  select event_id as article_id, event_type as symbol, cast(floor(epoch(events.ts)) as bigint) as published, split_part(text, '.', 1) as title, text as description
  from events join documents on doc_id = event_id % (select count(*) from documents))"""


def _offset(digits: int) -> float:
    """A hundredth or so of the last digit: with it no short decimal lies half way, where engines round differently."""
    return float(f"{0.0137731 * 10**-digits:.6e}")


def shaped(df: DataFrame, spec: str) -> DataFrame:
    """The columns of ``spec``: ``name`` as it is, ``name:i`` a long, ``name:s`` a string, ``name:4`` rounded to 4 digits after a slight offset."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind == "s":
            c = c.cast("string")
        elif kind:
            c = F.round(c.cast("double") + _offset(int(kind)), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def shaped_sql(spec: str, table: str = "out") -> str:
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        text = {"": name, "i": f"cast({name} as bigint)", "s": f"cast({name} as varchar)"}.get(kind) or f"round(cast({name} as double) + {_offset(int(kind)):.6e}, {kind}) + 0.0"
        out.append(f"{text} as {name}")
    return f"select {', '.join(out)} from {table}"
