"""Queries that write and read back, build a universe, replay scalers, and run on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.windows import change, ordered, rolling
from barloom.operators import boosting, conformal, factors as fc, features as ft, scaling, sentiment as sn, universe, walkforward as wf
from barloom.plans import portfolio_queries as pq, signal_queries as sq
from barloom.plans.feature_queries import SCALE_SQL, W, _apply_sql, _folds, _scaled, full
from barloom.plans.panels import EVENT_BARS_SQL, price_bars, read, stories
from barloom.plans.registry import query
from barloom.sources import bars as src
from barloom.sources.folder import fresh_folder
from barloom.streaming import bars as st

S, D = SparkSession, DataFrame

# sources and sinks ------------------------------------------------------------

_TICK = "upper(regexp_replace({0}, '\\s+', '', 'g'))"


def cells_of_parts(spark: S, sf: str) -> D:
    """A table of members as cells: a row for each part, its brand as the symbol, under a header."""
    p = read(spark, sf, "part")
    row = F.array(F.struct(F.lit(0).alias("col_no"), F.lower("p_brand").alias("cell")), F.struct(F.lit(1).alias("col_no"), F.col("p_name").alias("cell")))
    body = p.select(F.lit(0).alias("table_no"), (F.col("p_partkey") + 1).cast("int").alias("row_no"), F.inline(row))
    head = spark.createDataFrame([(0, 0, 0, "Symbol"), (0, 0, 1, "Security")], body.schema)
    return head.unionByName(body)


def cells_of_orders(spark: S, sf: str) -> D:
    """A table of changes as cells: date, added, note, removed; every seventh date is none."""
    o = read(spark, sf, "orders")
    day = F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    named = lambda c, shift: F.concat(F.lit("c"), (F.col("o_custkey") + shift) % 97)
    values = [day, named("o_custkey", 0), F.col("o_orderstatus"), named("o_custkey", 31)]
    row = F.array(*(F.struct(F.lit(i).alias("col_no"), v.alias("cell")) for i, v in enumerate(values)))
    return o.select(F.lit(1).alias("table_no"), F.col("o_orderkey").cast("int").alias("row_no"), F.inline(row))


@query("ticker row_no:i", f"out as (select {_TICK.format('p_brand')} as ticker, min(p_partkey) + 1 as row_no from part group by 1)", "")
def src10_constituents(spark: S, sf: str) -> D:
    return universe.required(universe.constituents(cells_of_parts(spark, sf)), "constituents")


_CHANGES = """changes as (select cast(o_orderdate as date) as date, 'C' || (o_custkey % 97) as added, 'C' || ((o_custkey + 31) % 97) as removed, o_orderkey as row_no from orders where o_orderkey % 7 <> 0)"""


@query("date:s added removed row_no:i", _CHANGES + ", out as (select * from changes)", "")
def src11_changes(spark: S, sf: str) -> D:
    return universe.required(universe.changes(cells_of_orders(spark, sf)), "changes")


@query("members:i covered:i coverage:6", _CHANGES + """, ev as (select removed as ticker, date, row_no, 0 as k from changes union all select added, date, row_no, 1 from changes),
sq as (select *, lag(k) over w as last, row_number() over w as rn from ev window w as (partition by ticker order by date, row_no, k)), tn as (select *, lead(date) over (partition by ticker order by date, row_no, k) as next from sq where rn = 1 or k <> last),
iv as (select ticker, date as start, coalesce(next, date '2002-01-01') as "end" from tn where k = 1 union all select ticker, date '1990-01-01', date from tn where k = 0 and rn = 1
  union all select t, date '1990-01-01', date '2002-01-01' from (select distinct 'C' || (c_custkey % 120) as t from customer) where t not in (select ticker from ev)),
act as (select distinct ticker from iv where start <= "end" and start <= date '1998-12-31' and "end" >= date '1997-01-01'), priced as (select distinct 'C' || (s_suppkey % 60) as s from supplier),
out as (select count(*) as members, count(*) filter (ticker in (select s from priced)) as covered, count(*) filter (ticker in (select s from priced)) / count(*) as coverage from act)""", "")
def uni3_universe(spark: S, sf: str) -> D:
    """From tables of changes and members to intervals, the members of two years, and how many of them have prices."""
    turns = universe.changes(cells_of_orders(spark, sf))
    events = turns.select(F.col("removed").alias("ticker"), "date", "row_no", F.lit("remove").alias("kind")).unionByName(turns.select(F.col("added").alias("ticker"), "date", "row_no", F.lit("add").alias("kind")))
    current = read(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_custkey") % 120).alias("ticker"))
    active = universe.active_between(universe.membership(events, current, "2002-01-01"), "1997-01-01", "1998-12-31")
    priced = read(spark, sf, "supplier").select(F.concat(F.lit("C"), F.col("s_suppkey") % 60).alias("symbol"))
    return universe.coverage(active, priced, spark.createDataFrame([], "ticker string, vendor string"))


@query("portfolio ts:s gross_return:7 cost:10 net_return:7", pq.TARGET_SQL + ", out as (select * from acct)")
def snk1_results(spark: S, sf: str) -> D:
    """Accounts written by run and read back."""
    path = fresh_folder(spark, "results")
    src.write_results({"accounts": pq.accounts(spark, sf).withColumn("run_id", F.lit("r1"))}, path)
    return spark.read.parquet(f"{path}/accounts").where("run_id = 'r1'")


@query("sharpes:i mean:6 corrupt:i lines:i", f"r as (select symbol, close / lag(close) {W} - 1 as ret from bars), s as (select symbol, avg(ret) / stddev_samp(ret) as s from r group by 1), out as (select 2 * count(s) as sharpes, avg(s) as mean, 0 as corrupt, 2 * count(*) as lines from s)")
def snk2_ledger(spark: S, sf: str) -> D:
    """A trial of each symbol, appended twice."""
    from barloom.operators import evaluate as ev

    path = fresh_folder(spark, "ledger")
    r = price_bars(spark, sf).withColumn("ret", change(F.col("close")))
    trials = ev.periodic_sharpe(r, ["symbol"]).select(F.col("symbol").alias("name"), F.col("sharpe").alias("oos_periodic_sharpe"))
    for _ in range(2):
        src.append_trial(trials, path)
    good, counts = src.read_ledger(spark, path)
    both = good.agg(F.count("*").alias("sharpes"), F.avg("oos_periodic_sharpe").alias("mean")).withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k")
    return both.select("sharpes", "mean", "corrupt", "lines")


@query("value", f"out as (select distinct {_TICK.format('p_name')} as value from part)", "")
def snk3_universe_file(spark: S, sf: str) -> D:
    path = fresh_folder(spark, "universe")
    src.write_universe(read(spark, sf, "part").select(F.col("p_name").alias("symbol")), path)
    return spark.read.text(path)


# columns by name ------------------------------------------------------------------


@query("grp col known:i", f"""base as (select *, {full('avg', 'close', 5)} as ma5, lead(close, 5) {W} as target_5 from bars),
out as (select 'price' as grp, 'open' as col, count(open) as known from base union all select 'price', 'close', count(close) from base union all select 'price', 'ma5', count(ma5) from base
  union all select 'volume', 'volume', count(volume) from base union all select 'label', 'target_5', count(target_5) from base)""")
def prj2_column_groups(spark: S, sf: str) -> D:
    """How many values each column of each group has."""
    frame = ft.with_labels(price_bars(spark, sf)).select("symbol", "ts", "open", "close", "volume", "target_5").withColumn("ma5", rolling(F.avg, F.col("close"), 5))
    groups = wf.column_groups(frame.columns, ft.is_label)
    return frame.agg(F.array(*(F.struct(F.lit(g).alias("grp"), F.lit(c).alias("col"), F.count(c).alias("known")) for g, columns in groups.items() for c in columns)).alias("a")).select(F.inline("a"))


@query("symbol ts:s close:8 columns", "out as (select symbol, ts, close, 'symbol ts open high low close volume' as columns from bars)")
def prj10_without_labels(spark: S, sf: str) -> D:
    """Bars with labels, as a model may see them, and the columns that are left."""
    seen = ft.without_labels(ft.with_labels(price_bars(spark, sf)))
    return seen.withColumn("columns", F.lit(" ".join(seen.columns)))


# scalers and members -------------------------------------------------------------


@query("symbol fold:i col low:4 high:4 center:7 width:7", SCALE_SQL + ", out as (select * from state)")
def scl6_state_table(spark: S, sf: str) -> D:
    """The scalers' state, written and read back."""
    path = fresh_folder(spark, "scalers")
    _scaled(spark, sf)[1].write.parquet(path)
    return spark.read.parquet(path).withColumnRenamed("column", "col")


@query("symbol ts:s fold:i close:4 spread:4", SCALE_SQL + ", out as (select lv.symbol, lv.ts, lv.fold, " + ", ".join(_apply_sql(c) for c in ("close", "spread")) + " from lv join state using (symbol, fold) where lv.role = 'test' group by lv.symbol, lv.ts, lv.fold, lv.close, lv.spread)")
def scl7_fold_replay(spark: S, sf: str) -> D:
    """The saved columns of the folds' test rows, by the folds' stored scalers."""
    rows, state = _scaled(spark, sf)
    return scaling.replay(rows.where("role = 'test'"), state, ["close", "spread"])


@query("fold:i feature importance:4")
def mod2_importance(spark: S, sf: str) -> D:
    w = ordered("symbol", "fold")
    rows = _folds(spark, sf)[0].withColumns({f"r{k}": F.log(F.col("close") / F.lag("close", k).over(w)) for k in (1, 2, 5)}).withColumn("y", F.log(F.lead("close").over(w) / F.col("close")))
    return boosting.boosted_folds(rows, ["r1", "r2", "r5"], "y", rounds=4)[1]


# streams -------------------------------------------------------------------------


def drained(stream: D, name: str) -> D:
    """All that a stream gives once its files are read, from a Parquet sink."""
    spark, path = stream.sparkSession, fresh_folder(stream.sparkSession, name)
    running = stream.writeStream.format("parquet").outputMode("append").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def event_stream(spark: S, sf: str) -> D:
    path = f"{sf}/events.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():  # a stream reads folders
        return reader.option("pathGlobFilter", "events.parquet").parquet(sf)
    return reader.parquet(path)


def stored_stream(rows: D, name: str) -> D:
    """A table of results as a stream."""
    path = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


_ENDED = "(select max(epoch(ts)) - 3600 from events)"


@query("symbol ts:i open:8 high:8 low:8 close:8 volume:i", f"out as (select * from ebars where ts + 3600 <= {_ENDED})", EVENT_BARS_SQL)
def str1_stream_bars(spark: S, sf: str) -> D:
    """Hourly bars that the watermark has closed."""
    trades = event_stream(spark, sf).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("event_id").alias("order"))
    return drained(st.stream_bars(trades, "1 hour", "1 hour"), "bars").withColumn("ts", F.unix_timestamp("ts"))


@query("symbol ts:i mean:6", f"w as (select event_type as symbol, cast(floor(epoch(ts) / 3600) * 3600 + k * 3600 as bigint) as e, value from events, range(1, 5) r(k)), out as (select symbol, e as ts, avg(value) as mean from w where e <= {_ENDED} group by 1, 2)", "")
def str2_stream_mean(spark: S, sf: str) -> D:
    values = event_stream(spark, sf).select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("close"))
    return drained(st.stream_mean(values, "4 hours", "1 hour", "1 hour"), "means").withColumn("ts", F.unix_timestamp("ts"))


@query("symbol close_at:i score:6 news:i momentum:6", sq.SCORE_SQL + sq._DAILY + ", cl as (select symbol, ts, close_at from cal), lt as (select max(close_at) - 3600 as t from placed join cl using (symbol, ts)), out as (select symbol, close_at, score, news, momentum from ag join cl using (symbol, ts), lt where close_at <= t)", "")
def str3_stream_sentiment(spark: S, sf: str) -> D:
    scores, n = sn.keyword_scores(stories(spark, sf)).select("doc_id", "score"), read(spark, sf, "documents").count()
    news = event_stream(spark, sf).select("event_id", F.col("event_type").alias("symbol"), F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("published"), (F.col("event_id") % n).alias("doc_id"))
    cal = sq.calendar(spark, sf).select("symbol", F.timestamp_seconds("close_at").alias("close_at"))
    scored = news.join(scores, "doc_id").select("symbol", "published", "score", F.col("event_id").alias("article_id"))
    return drained(st.stream_sentiment(scored, cal, "1 hour"), "news").withColumn("close_at", F.unix_timestamp("close_at"))


@query(f"{pq.DAY} alpha:8", *pq.ALPHA_SQL, recursive=True)
def str4_stream_alpha(spark: S, sf: str) -> D:
    misses = conformal.realized(pq.banded(spark, sf), 5).select("symbol", "ts", "miss")
    return drained(st.stream_alpha(stored_stream(misses, "misses")), "alpha").withColumn("ts", F.to_date("ts"))


@query("symbol ts:i state:i", sq._REV + ", out as (select * from scan)", "", recursive=True)
def str5_stream_states(spark: S, sf: str) -> D:
    scores = stored_stream(sq.reversion_scores(spark, sf), "scores")
    return drained(st.stream_states(scores, fc.reversion_step(), ["sscore", "ok"]), "states").withColumn("ts", F.unix_timestamp("ts"))
