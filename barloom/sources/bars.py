"""Bars from landed files: payloads, trades, calendars and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.sources.folder import fresh_folder

EASTERN = "America/New_York"
#: The fields of a vendor's bar payload.
BAR_FIELDS = ("open", "high", "low", "close", "volume")


def bars_from_trades(trades: DataFrame, order: list[str]) -> DataFrame:
    """``(symbol, ts, open, high, low, close, volume)`` from ``trades(symbol, ts, price, size)``.

    Open and close are the prices of the first and last trade by ``order``.
    """
    at = F.struct(*order)
    return trades.groupBy("symbol", "ts").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("size").cast("double").alias("volume"),
    )


def store_bars(bars: DataFrame, name: str, buckets: int = 16) -> DataFrame:
    """Writes ``bars`` as the table ``name``: a folder for each year, in it the symbols dealt to ``buckets`` files, sorted.

    A scan of dates reads the folders of their years, symbols are pushed to
    the sorted files, and windows by symbol need no exchange; neither do joins
    by symbol and day where Spark may co-partition by some of the keys
    (``spark.sql.requireAllClusterKeysForCoPartition`` off).
    """
    by_year = bars.withColumn("year", F.year("ts")).repartition(buckets, "symbol")
    where = fresh_folder(bars.sparkSession, name)
    by_year.write.partitionBy("year").bucketBy(buckets, "symbol").sortBy("symbol", "ts").option("path", where).mode("overwrite").saveAsTable(name)
    return bars.sparkSession.table(name)


def scan_store(store: DataFrame, symbols: list[str] | None, start: str, end: str) -> DataFrame:
    """``scan_bars`` of a stored table: years are pruned, symbols and dates are pushed to the files."""
    years = F.col("year").between(int(start[:4]), int(end[:4]))
    inside = store.where(years & F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return (inside if symbols is None else inside.where(F.col("symbol").isin(symbols))).drop("year")


def scan_bars(bars: DataFrame, symbols: list[str], start: str, end: str) -> DataFrame:
    """Bars of some symbols between two dates, both included."""
    return bars.where(F.col("symbol").isin(symbols) & F.col("ts").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def parse_bar_payload(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Rows of a JSON payload ``{"values": [{"datetime": ..., "open": "1.5", ...}]}``.

    Numbers are strings; what does not parse is NULL. Other columns are kept.
    """
    fields = ", ".join(f"{f}: string" for f in ("datetime", *BAR_FIELDS))
    parsed = payloads.withColumn("_v", F.explode(F.from_json(payload_col, f"values array<struct<{fields}>>")["values"]))
    numbers = [F.expr(f"try_cast(_v.{f} as double)").alias(f) for f in BAR_FIELDS]
    others = [c for c in payloads.columns if c != payload_col]
    return parsed.select(*others, F.try_to_timestamp(F.col("_v.datetime")).alias("ts"), *numbers)


def parse_dividends(payloads: DataFrame, start: str | None = None, end: str | None = None, payload_col: str = "payload") -> DataFrame:
    """``(symbol, ex_date, amount)`` from JSON ``{"dividends": [{"ex_date": ..., "amount": ...}]}``.

    Amounts may be strings or numbers; bad dates and amounts are dropped,
    amounts of one date added up. An error payload or another schema gives no
    rows.
    """
    rows = payloads.select("symbol", F.explode(F.from_json(payload_col, "dividends array<struct<ex_date: string, amount: string>>")["dividends"]).alias("d"))
    rows = rows.select("symbol", F.expr("try_to_date(d.ex_date, 'yyyy-MM-dd')").alias("ex_date"), F.expr("try_cast(d.amount as double)").alias("amount"))
    rows = rows.where("ex_date is not null and amount is not null")
    if start is not None:
        rows = rows.where(F.col("ex_date") >= F.lit(start).cast("date"))
    if end is not None:
        rows = rows.where(F.col("ex_date") <= F.lit(end).cast("date"))
    return rows.groupBy("symbol", "ex_date").agg(F.sum("amount").alias("amount"))


def session_close_utc(day: Column, hours: int = 16, zone: str = EASTERN) -> Column:
    """The UTC time of an exchange's close on a date."""
    return F.to_utc_timestamp(day.cast("timestamp") + F.make_interval(hours=F.lit(hours)), zone)


def exchange_day(ts: Column, zone: str = EASTERN) -> Column:
    """The exchange's date at a UTC time."""
    return F.to_date(F.from_utc_timestamp(ts, zone))


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def parse_universe(lines: DataFrame, line_col: str = "value", order_col: str = "line_no") -> DataFrame:
    """``(symbol, first_line)`` of a symbol list: comments from # on and blanks are dropped, doubles keep the first line."""
    symbol = F.upper(F.trim(F.split_part(F.col(line_col), F.lit("#"), F.lit(1))))
    return lines.select(symbol.alias("symbol"), F.col(order_col).alias("n")).where("symbol <> ''").groupBy("symbol").agg(F.min("n").alias("first_line"))


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(trial_sharpes, counts)`` of a JSONL ledger: the finite Sharpe ratios, and how many lines are corrupt."""
    schema = "name string, oos_periodic_sharpe double, _corrupt string"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where("trim(value) <> ''")
    return ledger_parts(lines.select(F.from_json("value", schema, options).alias("p")).select("p.*"))


def ledger_parts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    sharpe = F.col("oos_periodic_sharpe")
    good = lines.where(sharpe.isNotNull() & ~F.isnan(sharpe) & (F.abs(sharpe) < float("inf"))).select(sharpe)
    return good, lines.agg(F.count_if(F.col("_corrupt").isNotNull()).alias("corrupt"), F.count("*").alias("lines"))


def trial_sharpes(files: DataFrame, column: str = "payload") -> DataFrame:
    """``files`` (the text of a trial file in ``column``) with each finite number of its ``trial_sharpes`` as ``sharpe``.

    A file that is no JSON, lacks the list, or has fewer than two finite
    numbers gives no rows: nothing can be deflated by it.
    """
    parsed = F.from_json(column, "trial_sharpes array<double>", {"allowNonNumericNumbers": "true"})["trial_sharpes"]
    finite = F.filter(parsed, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = files.withColumn("_found", finite).where(F.size("_found") >= 2)
    return kept.withColumn("sharpe", F.explode("_found")).drop("_found", column)


def read_trial_sharpes(spark: SparkSession, path: str) -> DataFrame:
    """``sharpe`` of every trial file below ``path``."""
    return trial_sharpes(spark.read.text(path, wholetext=True), "value")


def write_universe(symbols: DataFrame, path: str) -> None:
    """The distinct symbols, sorted, one on each line."""
    symbols.select(F.upper(F.regexp_replace("symbol", r"\s+", "")).alias("value")).distinct().orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def append_trial(trials: DataFrame, path: str) -> None:
    trials.coalesce(1).write.mode("append").json(path)


def write_results(tables: dict[str, DataFrame], path: str, partition_by: str = "run_id") -> None:
    """Result tables, each below its name, partitioned by run."""
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy(partition_by).parquet(f"{path}/{name}")


#: Days, or symbols, that go to every executor as one array at most.
MOST_SENT = 1_000_000


def dense_panel(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Every day of the calendar for every symbol, NULL where there is no bar.

    The shorter of the two lists goes to each entry of the other as an array,
    so the grid is made without a cross join. A grid of more than MOST_SENT
    symbols and days is refused: it would have a million million rows.
    """
    n = bars.agg(F.count_distinct("ts").alias("ts"), F.count_distinct("symbol").alias("symbol")).first()
    few, many = ("ts", "symbol") if n["ts"] <= n["symbol"] or n["ts"] <= MOST_SENT // 10 else ("symbol", "ts")
    if n[few] > MOST_SENT:
        raise ValueError(f"a dense panel of {n['symbol']} symbols and {n['ts']} days is too large")
    every = bars.agg(F.array_sort(F.collect_set(few)).alias("every")).withColumn("_k", F.lit(1))
    grid = bars.select(many).distinct().withColumn("_k", F.lit(1)).join(F.broadcast(every), "_k").select(many, F.explode("every").alias(few))
    return grid.join(bars.select("symbol", "ts", *columns), ["symbol", "ts"], "left").select("symbol", "ts", *columns)


def positive_prices(bars: DataFrame, columns: list[str]) -> DataFrame:
    """Prices as finite numbers; what is not above zero is NULL."""
    out = {}
    for c in columns:
        x = F.col(c).try_cast("double")
        out[c] = F.when((x > 0) & (x < float("inf")) & ~F.isnan(x), x)
    return bars.withColumns(out)
