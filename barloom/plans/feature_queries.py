"""Queries over sources, joins, features, folds and scalers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions.windows import change
from barloom.operators import factors, features as ft, folds, scaling, universe
from barloom.plans.panels import EVENT_BARS_SQL, event_bars, price_bars, read
from barloom.plans.registry import query
from barloom.sources import bars as src

S, D = SparkSession, DataFrame
W = "over (partition by symbol order by ts)"
ROLL = "over (partition by symbol order by ts rows between {n} preceding and current row)"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    frame = ROLL.format(n=n - 1)
    return f"case when count({x}) {frame} >= {least or n} then {agg}({x}) {frame} end"


@query("symbol ts:s open:8 high:8 low:8 close:8 volume:2", "out as (select * from bars)")
def src6_bars(spark: S, sf: str) -> D:
    return price_bars(spark, sf)


@query("symbol ts:i open:8 high:8 low:8 close:8 volume:i", "out as (select * from ebars)", EVENT_BARS_SQL)
def src6_event_bars(spark: S, sf: str) -> D:
    return event_bars(spark, sf)


@query("symbol ts:s close:8", "out as (select * from bars where symbol in ('Brand#11', 'Brand#23') and ts between date '1996-01-01' and date '1998-12-31')")
def src1_scan(spark: S, sf: str) -> D:
    return src.scan_bars(price_bars(spark, sf), ["Brand#11", "Brand#23"], "1996-01-01", "1998-12-31")


@query("symbol ts:s close:8 change:8", f"part3 as (select * from bars where ts between date '1996-06-01' and date '1998-12-31'), out as (select symbol, ts, close, close / lag(close) {W} - 1 as change from part3)")
def src1_store_scan(spark: S, sf: str) -> D:
    """Three years of a stored table of bars, with a window by symbol over them."""
    store = src.store_bars(price_bars(spark, sf), f"barloom_bars_{uuid.uuid4().hex}")
    return src.scan_store(store, None, "1996-06-01", "1998-12-31").withColumn("change", change(F.col("close")))


_PAYLOAD = """payloads as (
  select o_custkey as symbol, o_orderkey as k, o_totalprice as p, strftime(o_orderdate, '%Y-%m-%d') as d from orders),"""


@query("symbol:i ts:s open:4 close:4 volume:4", _PAYLOAD + """
out as (select symbol, d as ts, p as open, case when k % 7 <> 0 then p / 2 end as close, cast(k as double) as volume from payloads)""", "")
def src2_payloads(spark: S, sf: str) -> D:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    close = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") / 2).cast("string")).otherwise("n/a")
    values = F.array(F.struct(day.alias("datetime"), F.col("o_totalprice").cast("string").alias("open"), close.alias("close"), F.col("o_orderkey").cast("string").alias("volume")))
    sent = read(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.to_json(F.struct(values.alias("values"))).alias("payload"))
    return src.parse_bar_payload(sent).withColumn("ts", F.col("ts").cast("date"))


@query("symbol:i ex_date:s amount:4", """out as (
  select o_custkey as symbol, cast(o_orderdate as date) as ex_date, sum(o_totalprice / 100) as amount from orders
  where o_orderkey % 5 <> 0 and o_orderkey % 11 <> 0 and o_orderdate between timestamp '1995-01-01' and timestamp '1997-12-31' group by 1, 2)""", "")
def src3_dividends(spark: S, sf: str) -> D:
    k = F.col("o_orderkey")
    day = F.when(k % 5 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    entry = F.array(F.struct(day.alias("ex_date"), (F.col("o_totalprice") / 100).alias("amount")))
    good, bad = F.to_json(F.struct(entry.alias("dividends"))), F.lit('{"status": "error", "code": 404}')
    sent = read(spark, sf, "orders").select(F.col("o_custkey").alias("symbol"), F.when(k % 11 == 0, bad).otherwise(good).alias("payload"))
    return src.parse_dividends(sent, "1995-01-01", "1997-12-31")


@query("event_id:i day:s close_at:i", """et as (select event_id, ts, timezone('America/New_York', timezone('UTC', ts)) as local from events),
out as (select event_id, cast(local as date) as day,
  epoch(timezone('America/New_York', cast(cast(local as date) as timestamp) + interval 16 hour)) as close_at from et)""", "")
def src4_zones(spark: S, sf: str) -> D:
    day = src.exchange_day(F.col("ts").cast("timestamp"))
    return read(spark, sf, "events").select("event_id", day.alias("day"), F.unix_timestamp(src.session_close_utc(day)).alias("close_at"))


@query("user_id:i day:s event_id:i value:6", """ranked as (select user_id, cast(ts as date) as day, event_id, value,
  row_number() over (partition by user_id, cast(ts as date) order by event_id desc) as rn from events),
out as (select * from ranked where rn = 1)""", "")
def src5_keep_last(spark: S, sf: str) -> D:
    return src.keep_last(read(spark, sf, "events").withColumn("day", F.to_date("ts")), ["user_id", "day"], "event_id")


@query("symbol first_line:i", """lines as (select o_orderkey as n, case when o_orderkey % 9 = 0 then '# note' when o_orderkey % 10 = 0 then ''
  else o_orderpriority || ' # ' || o_orderstatus end as v from orders),
cut as (select upper(trim(split_part(v, '#', 1))) as symbol, n from lines), out as (select symbol, min(n) as first_line from cut where symbol <> '' group by 1)""", "")
def src7_universe_file(spark: S, sf: str) -> D:
    k = F.col("o_orderkey")
    line = F.when(k % 9 == 0, "# note").when(k % 10 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" # "), "o_orderstatus"))
    return src.parse_universe(read(spark, sf, "orders").select(line.alias("value"), k.alias("line_no")))


@query("n:i mean_sharpe:6 corrupt:i lines:i", """t as (select event_id, value, event_id % 13 = 0 as broken, event_id % 17 = 0 as missing from events),
out as (select count(*) filter (not broken and not missing) as n, avg(value) filter (not broken and not missing) as mean_sharpe,
  count(*) filter (broken) as corrupt, count(*) as lines from t)""", "")
def src8_ledger(spark: S, sf: str) -> D:
    k = F.col("event_id")
    line = F.when(k % 13 == 0, '{"name": "x", "oos_per').when(k % 17 == 0, '{"name": "y"}').otherwise(F.to_json(F.struct(F.col("event_type").alias("name"), F.col("value").alias("oos_periodic_sharpe"))))
    parsed = F.from_json(line, "name string, oos_periodic_sharpe double, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    good, counts = src.ledger_parts(read(spark, sf, "events").select(parsed.alias("p")).select("p.*"))
    stats = good.agg(F.count("*").alias("n"), F.avg("oos_periodic_sharpe").alias("mean_sharpe"))
    return stats.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k")


@query("symbol n:i dev:6", """s as (select event_type as symbol, value as v, count(*) over (partition by event_type, date_trunc('hour', ts)) as inside from events where event_id % 6 <> 0),
out as (select symbol, count(*) as n, stddev_samp(v) as dev from s where inside >= 2 group by 1)""", "")
def src12_trial_file(spark: S, sf: str) -> D:
    """A trial file of each event type and hour, every sixth number of it not one; files with fewer than two finite numbers give none."""
    v = F.when(F.col("event_id") % 6 == 0, "NaN").otherwise(F.col("value").cast("string"))
    named = read(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").alias("hour"), v.alias("v"))
    text = F.concat(F.lit('{"trial_sharpes": ['), F.array_join(F.collect_list("v"), ", "), F.lit("]}"))
    kept = src.trial_sharpes(named.groupBy("symbol", "hour").agg(text.alias("payload")))
    return kept.groupBy("symbol").agg(F.count("*").alias("n"), F.stddev_samp("sharpe").alias("dev"))


@query("symbol:i price:6", "out as (select o_orderkey as symbol, case when o_orderkey % 3 > 0 and o_totalprice - 50000 > 0 then o_totalprice - 50000 end as price from orders)", "")
def prj1_positive_prices(spark: S, sf: str) -> D:
    raw = F.when(F.col("o_orderkey") % 3 == 0, "inf").otherwise((F.col("o_totalprice") - 50000).cast("string"))
    return src.positive_prices(read(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), raw.alias("price")), ["price"])


@query("col null_share:6 dropped", f"""f as (select {full('avg', 'close', 5)} as a, {full('avg', 'close', 200)} as b, case when volume > 200 then volume end as c from bars),
out as (select 'a' as col, avg(cast(a is null as int)) as null_share, avg(cast(a is null as int)) > 0.3 as dropped from f
  union all select 'b', avg(cast(b is null as int)), avg(cast(b is null as int)) > 0.3 from f union all select 'c', avg(cast(c is null as int)), avg(cast(c is null as int)) > 0.3 from f)""")
def prj3_sparse_columns(spark: S, sf: str) -> D:
    from barloom.functions.windows import rolling

    f = price_bars(spark, sf).select(rolling(F.avg, F.col("close"), 5).alias("a"), rolling(F.avg, F.col("close"), 200).alias("b"), F.when(F.col("volume") > 200, F.col("volume")).alias("c"))
    return scaling.sparse_columns(f, ["a", "b", "c"]).withColumnRenamed("column", "col")


@query("symbol ts:s close:8", """f as (select symbol, ts, case when volume > 120 then close end as x from bars),
out as (select symbol, ts, coalesce(last_value(x ignore nulls) over (partition by symbol order by ts rows between unbounded preceding and current row), 0) as close from f)""")
def prj4_fill(spark: S, sf: str) -> D:
    f = price_bars(spark, sf).withColumn("close", F.when(F.col("volume") > 120, F.col("close")))
    return scaling.fill_features(f, ["close"])


@query("symbol ts:s target_5:8", f"lab as (select symbol, ts, lead(close, 5) {W} as target_5 from bars), out as (select * from lab where target_5 is not null)")
def prj5_usable_rows(spark: S, sf: str) -> D:
    return ft.with_labels(price_bars(spark, sf), (5,)).dropna(subset=["target_5"])


@query("symbol ts:s close:8", "out as (select * from bars where symbol in (select symbol from bars group by 1 having min(ts) <= date '1995-01-16'))")
def prj6_listed_by(spark: S, sf: str) -> D:
    return universe.listed_by(price_bars(spark, sf), "1995-01-16")


@query("ts:i", "d as (select ts, count(*) as n from ebars group by 1), out as (select ts from d where n >= greatest(1, ceil(0.6 * (select max(n) from d))))", EVENT_BARS_SQL)
def prj7_consensus_days(spark: S, sf: str) -> D:
    return factors.consensus_days(event_bars(spark, sf))


@query("symbol dollar_volume:3", """r as (select *, row_number() over (partition by symbol order by ts) as rn from bars),
m as (select symbol, median(close * volume) as dollar_volume from r where rn > 60 and rn <= 120 group by 1),
out as (select * from m where dollar_volume is not null order by dollar_volume desc, symbol limit 10)""")
def prj8_top_liquid(spark: S, sf: str) -> D:
    return factors.top_liquid(price_bars(spark, sf), 120, 60, 10)


@query("symbol ts:s eligible", f"""r as (select *, close / lag(close) {W} - 1 as ret, close * volume as dv from bars),
m as (select symbol, min(ts) + 100 as s, max(ts) - 100 as e from bars group by 1),
f as (select symbol, ts, close, count(ret) {ROLL.format(n=29)} >= 30 as known, {full('median', 'dv', 20)} as dollar from r),
out as (select f.symbol, f.ts, coalesce(known and close >= 500 and dollar >= 100000, false) and f.symbol <> 'Brand#11' and f.ts between s and e as eligible from f join m using (symbol))""")
def prj9_eligibility(spark: S, sf: str) -> D:
    bars = price_bars(spark, sf)
    members = bars.groupBy("symbol").agg(F.date_add(F.min("ts"), 100).alias("start"), F.date_sub(F.max("ts"), 100).alias("end"))
    return factors.eligibility(bars, members, 30, 500.0, 1e5, ("Brand#11",))


@query("ticker vendor", """t as (select distinct upper(regexp_replace(p_type, '\\s+', '', 'g')) as ticker from part),
out as (select ticker, coalesce(v, ticker) as vendor from t left join (values ('ECONOMY', 'ECO')) m(k, v) on ticker = k)""", "")
def prj14_tickers(spark: S, sf: str) -> D:
    t = read(spark, sf, "part").select(universe.normalize_ticker(F.col("p_type")).alias("ticker")).distinct()
    names = spark.createDataFrame([("ECONOMY", "ECO")], "ticker string, v string")
    return t.join(F.broadcast(names), "ticker", "left").select("ticker", F.coalesce("v", "ticker").alias("vendor"))


# joins -------------------------------------------------------------------


@query("symbol ts:s close:8 other:8", """months as (select symbol, ts, close from bars where volume > 150), more as (select symbol, ts, open as other from bars where volume < 400),
out as (select symbol, ts, close, other from months join more using (symbol, ts))""")
def join1_alignment(spark: S, sf: str) -> D:
    b = price_bars(spark, sf)
    return b.where("volume > 150").select("symbol", "ts", "close").join(b.where("volume < 400").select("symbol", "ts", F.col("open").alias("other")), ["symbol", "ts"])


@query("symbol ts:i close:8 volume:i", """grid as (select symbol, ts from (select distinct symbol from ebars), (select distinct ts from ebars)),
out as (select symbol, ts, close, volume from grid left join ebars using (symbol, ts))""", EVENT_BARS_SQL)
def join2_dense_panel(spark: S, sf: str) -> D:
    return src.dense_panel(event_bars(spark, sf), ["close", "volume"])


@query("user_id:i ts:i event_id:i", """u as (select * from events where event_type = 'purchase'), c as (select user_id as cu, ts as cts, event_id as ce from events where event_type = 'click'),
out as (select user_id, cast(floor(epoch(ts)) as bigint) as ts, arg_min(ce, cts) as event_id from u join c on cu = user_id and cts >= ts group by user_id, ts, u.event_id)""", "")
def join4_as_of(spark: S, sf: str) -> D:
    from barloom.operators.sentiment import to_bars

    e = read(spark, sf, "events")
    sec = F.unix_micros(F.col("ts").cast("timestamp"))
    left = e.where("event_type = 'purchase'").select(F.col("user_id").alias("symbol"), sec.alias("published"), F.col("event_id").alias("article_id"))
    right = e.where("event_type = 'click'").select(F.col("user_id").alias("symbol"), sec.alias("close_at"), F.col("event_id").alias("ts"))
    return to_bars(left, right).select(F.col("symbol").alias("user_id"), F.floor(F.col("published") / 1000000).alias("ts"), F.col("ts").alias("event_id"))


_MEMBERS = """ev as (select cast(user_id as varchar) as ticker, cast(ts as date) as date, event_id as row_no, case when event_type = 'signup' then 'add' else 'remove' end as kind
  from events where event_type in ('signup', 'error')),
cur as (select distinct cast(user_id as varchar) as ticker from events where event_type = 'view'),
seen as (select *, lag(kind) over w as last_kind, row_number() over w as rn from ev window w as (partition by ticker order by date, row_no, case when kind = 'remove' then 0 else 1 end)),
turns as (select *, lead(date) over (partition by ticker order by date, row_no) as next_date from seen where rn = 1 or kind <> last_kind),
spans as (select ticker, date as start_day, coalesce(next_date, date '2024-02-15') as end_day from turns where kind = 'add'
  union all select ticker, date '1990-01-01', date from turns where rn = 1 and kind = 'remove'
  union all select ticker, date '1990-01-01', date '2024-02-15' from cur where ticker not in (select ticker from ev))"""


def _members(spark: S, sf: str) -> D:
    e = read(spark, sf, "events")
    ticker = F.col("user_id").cast("string").alias("ticker")
    events = e.where("event_type in ('signup', 'error')").select(ticker, F.to_date("ts").alias("date"), F.col("event_id").alias("row_no"), F.when(F.col("event_type") == "signup", "add").otherwise("remove").alias("kind"))
    return universe.membership(events, e.where("event_type = 'view'").select(ticker).distinct(), "2024-02-15")


@query("ticker start_day:s end_day:s", _MEMBERS + ", out as (select * from spans where start_day <= end_day)", "")
def uni1_membership(spark: S, sf: str) -> D:
    return _members(spark, sf).withColumnsRenamed({"start": "start_day", "end": "end_day"})


@query("ticker", _MEMBERS + ", out as (select distinct ticker from spans)", "")
def uni2_ever_members(spark: S, sf: str) -> D:
    return _members(spark, sf).select("ticker").distinct()


@query("symbol ts:s member", _MEMBERS + """, days as (select distinct cast(user_id as varchar) as symbol, cast(ts as date) as ts from events),
out as (select symbol, ts, coalesce(bool_or(ts between start_day and end_day), false) as member from days left join spans on ticker = symbol group by 1, 2)""", "")
def join5_membership_mask(spark: S, sf: str) -> D:
    days = read(spark, sf, "events").select(F.col("user_id").cast("string").alias("symbol"), F.to_date("ts").alias("ts")).distinct()
    return universe.membership_mask(days, _members(spark, sf))


@query("ticker", _MEMBERS + ", out as (select distinct ticker from spans where start_day <= date '2024-01-12' and end_day >= date '2024-01-10')", "")
def join6_active_between(spark: S, sf: str) -> D:
    return universe.active_between(_members(spark, sf), "2024-01-10", "2024-01-12")


@query("members:i covered:i coverage:8", _MEMBERS + """, named as (select distinct case when ticker = '7' then '8' else ticker end as symbol, ticker from spans),
out as (select count(*) as members, count(*) filter (symbol in (select cast(user_id as varchar) from events where event_type = 'purchase')) as covered,
  count(*) filter (symbol in (select cast(user_id as varchar) from events where event_type = 'purchase')) / count(*) as coverage from named)""", "")
def join7_coverage(spark: S, sf: str) -> D:
    priced = read(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("symbol"))
    return universe.coverage(_members(spark, sf), priced, spark.createDataFrame([("7", "8")], "ticker string, vendor string"))


@query("ts:s symbol ret:6", f"""r as (select symbol, ts, close / lag(close) {W} - 1 as ret from bars ),
out as (select * from r where ts in (select ts from r where ret is not null group by ts having count(distinct symbol) = (select count(distinct symbol) from bars)))""")
def join8_common_days(spark: S, sf: str) -> D:
    r = price_bars(spark, sf).withColumn("ret", change(F.col("close")))
    every = r.select("symbol").distinct().count()
    common = r.where("ret is not null").groupBy("ts").agg(F.count_distinct("symbol").alias("n")).where(F.col("n") == every)
    return r.join(common, "ts", "left_semi")


# features ----------------------------------------------------------------

_DAY = "symbol ts:s"


def _features(spark: S, sf: str) -> D:
    return ft.indicators(price_bars(spark, sf))


@query(f"{_DAY} ma5:5 ma10:5 ma20:5 ma50:5", "out as (select symbol, ts, " + ", ".join(f"{full('avg', 'close', n)} as ma{n}" for n in (5, 10, 20, 50)) + " from bars)")
def win1_means(spark: S, sf: str) -> D:
    return _features(spark, sf)


_EMA = """numbered as (select symbol, ts, close, row_number() over (partition by symbol order by ts) as rn from bars),
scan as (select symbol, ts, rn, {first} from numbered where rn = 1
  union all select n.symbol, n.ts, n.rn, {next} from scan s join numbered n on n.symbol = s.symbol and n.rn = s.rn + 1),
out as (select *{more} from scan)"""


def _ema(span: int, x: str, before: str) -> str:
    a = 2 / (span + 1)
    return f"{a!r} * {x} + {1 - a!r} * {before}"


@query(f"{_DAY} ema5:7 ema10:7 ema20:7", _EMA.format(first="close as ema5, close as ema10, close as ema20", next=", ".join(_ema(s, "n.close", f"s.ema{s}") for s in (5, 10, 20)), more=""), recursive=True)
def win2_exponential_means(spark: S, sf: str) -> D:
    return ft.exponential_means(price_bars(spark, sf))


_M = f"(({_ema(12, 'n.close', 's.e12')}) - ({_ema(26, 'n.close', 's.e26')}))"


@query(f"{_DAY} macd:5 macd_signal:5 macd_hist:5", _EMA.format(
    first="close as e12, close as e26, cast(0 as double) as macd, cast(0 as double) as macd_signal",
    next=f"{_ema(12, 'n.close', 's.e12')}, {_ema(26, 'n.close', 's.e26')}, {_M}, 0.2 * {_M} + 0.8 * s.macd_signal", more=", macd - macd_signal as macd_hist"), recursive=True)
def win7_macd(spark: S, sf: str) -> D:
    return ft.exponential_means(price_bars(spark, sf))


@query(f"{_DAY} price_change:6 price_change_5:6 price_change_10:6", "out as (select symbol, ts, " + ", ".join(f"close / lag(close, {k}) {W} - 1 as price_change{s}" for k, s in ((1, ""), (5, "_5"), (10, "_10"))) + " from bars)")
def win3_changes(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} volatility_5:4 volatility_10:4 volatility_20:4", "out as (select symbol, ts, " + ", ".join(f"{full('stddev_samp', 'close', n)} as volatility_{n}" for n in (5, 10, 20)) + " from bars)")
def win4_volatility(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} volume_change:6 volume_ma5:6 volume_ma10:6 price_volume_ratio:6", f"out as (select symbol, ts, volume / lag(volume) {W} - 1 as volume_change, {full('avg', 'volume', 5)} as volume_ma5, {full('avg', 'volume', 10)} as volume_ma10, close / (volume + 1) as price_volume_ratio from bars)")
def win5_volume(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} rsi_14:6", f"""d as (select symbol, ts, close - lag(close) {W} as d from bars), g as (select symbol, ts, case when d > 0 then d else 0.0 end as up, case when d < 0 then -d else 0.0 end as down from d),
out as (select symbol, ts, 100 - 100 / (1 + {full('avg', 'up', 14)} / ({full('avg', 'down', 14)} + 1e-10)) as rsi_14 from g)""")
def win6_rsi(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} bb_middle:4 bb_upper:4 bb_lower:4 bb_width:6", f"""b as (select symbol, ts, {full('avg', 'close', 20)} as m, {full('stddev_samp', 'close', 20)} as s from bars),
out as (select symbol, ts, m as bb_middle, m + 2 * s as bb_upper, m - 2 * s as bb_lower, ((m + 2 * s) - (m - 2 * s)) / m as bb_width from b)""")
def win8_bands(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} direction_1:i direction_5:i direction_10:i", "out as (select symbol, ts, " + ", ".join(f"case when close - lag(close, {k}) {W} > 0 then 1 else -1 end as direction_{k}" for k in (1, 5, 10)) + " from bars)")
def win9_directions(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} gap:6 daily_range:6 daily_range_ma5:6 doji:i", f"""r as (select *, (high - low) / close as daily_range, lag(close) {W} as pc from bars),
out as (select symbol, ts, (open - pc) / pc as gap, daily_range, {full('avg', 'daily_range', 5)} as daily_range_ma5,
  case when abs(open - close) / (high - low + 1e-10) < 0.1 and (high - low) / low > 0.01 then 1 else 0 end as doji from r)""")
def win10_gap_range_doji(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} roc_5:4 roc_10:4 atr_14:4", f"""t as (select *, lag(close) {W} as pc from bars), r as (select *, greatest(high - low, coalesce(abs(high - pc), high - low), coalesce(abs(low - pc), high - low)) as tr from t),
out as (select symbol, ts, (close / lag(close, 5) {W} - 1) * 100 as roc_5, (close / lag(close, 10) {W} - 1) * 100 as roc_10, {full('avg', 'tr', 14)} as atr_14 from r)""")
def win13_roc_atr(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} mfi_14:5", f"""t as (select symbol, ts, (high + low + close) / 3 as t, volume from bars), d as (select *, t - lag(t) {W} as d, t * volume as f from t),
g as (select *, case when d > 0 then f else 0.0 end as i, case when d < 0 then f else 0.0 end as o from d),
out as (select symbol, ts, 100 - 100 / (1 + {full('sum', 'i', 14)} / ({full('sum', 'o', 14)} + 1e-10)) as mfi_14 from g)""")
def win15_money_flow(spark: S, sf: str) -> D:
    return _features(spark, sf)


@query(f"{_DAY} close_lag1:8 close_lag2:8 close_lag5:8 close_lag10:8 volume_lag1:2 volume_lag10:2", "out as (select symbol, ts, " + ", ".join(f"lag(close, {k}) {W} as close_lag{k}" for k in (1, 2, 5, 10)) + f", lag(volume, 1) {W} as volume_lag1, lag(volume, 10) {W} as volume_lag10 from bars)")
def win16_lags(spark: S, sf: str) -> D:
    return ft.lagged(price_bars(spark, sf))


@query(f"{_DAY} target_5:8 direction_5:i pct_change_5:6 pct_change_1:6", f"""l as (select *, lead(close, 5) {W} as t5, lead(close) {W} as t1 from bars),
out as (select symbol, ts, t5 as target_5, case when t5 > close then 1 when t5 <= close then -1 end as direction_5, (t5 - close) / close as pct_change_5, (t1 - close) / close as pct_change_1 from l)""")
def win17_labels(spark: S, sf: str) -> D:
    return ft.with_labels(price_bars(spark, sf))


SIGMA_SQL = f"""logr as (select *, ln(close / lag(close) {W}) as lr from bars),
raws as (select *, {full('stddev_samp', 'lr', 20, 5)} as s0 from logr),
vol as (select *, greatest(first_value(s0 ignore nulls) over (partition by symbol order by ts rows between current row and unbounded following), 0.005) as sigma from raws)"""


@query(f"{_DAY} sigma:6", SIGMA_SQL + ", out as (select * from vol)")
def win18_realized_vol(spark: S, sf: str) -> D:
    return ft.realized_vol(price_bars(spark, sf))


@query("symbol ts:i ret:6", f"""grid as (select symbol, ts from (select distinct symbol from ebars), (select distinct ts from ebars)),
d as (select symbol, ts, close from grid left join ebars using (symbol, ts)), out as (select symbol, ts, close / lag(close) {W} - 1 as ret from d)""", EVENT_BARS_SQL)
def win19_strict_returns(spark: S, sf: str) -> D:
    return src.dense_panel(event_bars(spark, sf), ["close"]).withColumn("ret", change(F.col("close")))


@query(f"{_DAY} volume_weight:11", f"v as (select *, {full('avg', 'volume', 20, 10)} / volume as x from bars), out as (select symbol, ts, case when x is not null then greatest(1.0 / 3, least(3.0, x)) else 1.0 end as volume_weight from v)")
def win20_volume_time(spark: S, sf: str) -> D:
    return ft.volume_time_weights(price_bars(spark, sf))


@query(f"{_DAY} drawdown:6 cum_return:6 period_return:6", f"""out as (select symbol, ts, 1 - close / max(close) over p as drawdown, close / first_value(close) over p - 1 as cum_return, close / lag(close) {W} - 1 as period_return
  from bars window p as (partition by symbol order by ts rows between unbounded preceding and current row))""")
def win22_drawdown(spark: S, sf: str) -> D:
    return ft.drawdown(price_bars(spark, sf), "close")


@query(f"{_DAY} n:i first_ts:s oldest:8", f"""out as (select symbol, ts, count(*) over w as n, first_value(ts) over w as first_ts, first_value(close) over w as oldest from bars window w as (partition by symbol order by ts rows between 29 preceding and current row))""")
def win24_trailing_windows(spark: S, sf: str) -> D:
    w = ft.trailing_windows(price_bars(spark, sf), 30)
    return w.select("symbol", "ts", F.size("window").alias("n"), F.col("window")[0]["ts"].alias("first_ts"), F.col("window")[0]["close"].alias("oldest"))


BASELINE_SQL = f"""base as (select symbol, ts, open, close, volume, 1.0 as hold, coalesce(sign({full('avg', 'close', 20)} - {full('avg', 'close', 50)}), 0) as ma_cross,
  coalesce(sign(close / lag(close, 60) {W} - 1), 0) as tsmom from bars)"""


@query(f"{_DAY} hold:1 ma_cross:1 tsmom:1", BASELINE_SQL + ", out as (select * from base)")
def win25_baselines(spark: S, sf: str) -> D:
    return ft.baseline_positions(price_bars(spark, sf))


# folds and scaling ---------------------------------------------------------

FOLD_SQL = """num as (select *, row_number() over (partition by symbol order by ts) - 1 as pos from bars), cnt as (select symbol, count(*) as n from bars group by 1),
fold as (select symbol, f as fold, n, n // 5 as c, (f + 1) * (n // 5) as test_lo, case when f = 3 then n else (f + 2) * (n // 5) end as test_hi from cnt, range(4) r(f) where n >= 10),
folds as (select symbol, fold, 0 as train_lo, greatest(test_lo - 5, 0) as train_hi, test_lo, test_hi, test_hi + cast(floor(0.02 * n) as bigint) as embargo_hi from fold),
assigned as (select num.*, fold, case when pos >= test_lo and pos < test_hi then 'test' when pos >= train_lo and pos < train_hi and not exists (
  select 1 from folds z where z.symbol = num.symbol and z.fold < folds.fold and num.pos >= z.test_hi and num.pos < z.embargo_hi) then 'train' end as role from num join folds using (symbol))"""


def _folds(spark: S, sf: str) -> tuple[D, D]:
    rows = folds.positions(price_bars(spark, sf))
    table = folds.purged_folds(rows.groupBy("symbol").agg(F.count("*").alias("n")), 4, 5, 0.02)
    return folds.fold_rows(rows, table), table


@query("symbol fold:i train_lo:i train_hi:i test_lo:i test_hi:i embargo_hi:i", FOLD_SQL + ", out as (select * from folds)")
def fld1_purged_folds(spark: S, sf: str) -> D:
    return _folds(spark, sf)[1]


@query("symbol fold:i role n:i first_pos:i last_pos:i", FOLD_SQL + ", out as (select symbol, fold, role, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from assigned where role is not null group by 1, 2, 3)")
def fld1_fold_rows(spark: S, sf: str) -> D:
    return _folds(spark, sf)[0].groupBy("symbol", "fold", "role").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("fold:i symbol n:i mean_close:4", """num as (select *, row_number() over (partition by symbol order by ts) - 1 as pos from bars), ln as (select max(pos) + 1 as n from num), sl as (select i as fold, 100 + i * 20 as lo, least(100 + i * 20 + 20, n - 1) as hi from range(100000) t(i), ln where 100 + i * 20 + 2 <= n - 1),
out as (select fold, symbol, count(*) as n, avg(close) as mean_close from num join sl on pos >= lo and pos < hi group by 1, 2)""")
def fld2_rolling_slices(spark: S, sf: str) -> D:
    rows = folds.positions(price_bars(spark, sf))
    n = rows.agg(F.max("pos")).first()[0] + 1
    slices = folds.rolling_slices(spark, n, 100, 20)
    days = slices.select("fold", F.explode(F.sequence(F.col("test_lo").cast("long"), F.col("test_hi").cast("long") - 1)).alias("pos"))
    return rows.join(days, "pos").groupBy("fold", "symbol").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close"))


_TEST = FOLD_SQL + ", t as (select symbol, ts, fold, close / open - 1 as target, row_number() over (partition by fold, symbol order by ts desc) as rn from assigned where role = 'test')"


def _targets(spark: S, sf: str) -> D:
    return _folds(spark, sf)[0].where("role = 'test'").withColumn("target", F.col("close") / F.col("open") - 1)


@query("symbol ts:s fold:i target:8", _TEST + ", out as (select symbol, ts, fold, case when rn <= 2 then 0 else target end as target from t)")
def fld3_flat_ends(spark: S, sf: str) -> D:
    return folds.flatten_ends(_targets(spark, sf))


@query("symbol ts:s fold:i target:8", _TEST + ", out as (select symbol, ts, fold, case when rn > 1 then target end as target from t)")
def fld4_drop_last(spark: S, sf: str) -> D:
    return folds.drop_last_target(_targets(spark, sf))


@query("symbol fold:i role n:i first:s last:s row_hash", FOLD_SQL + """, out as (select symbol, fold, role, count(*) as n, min(ts) as "first", max(ts) as "last", sha256(string_agg(cast(ts as varchar), ',' order by ts)) as row_hash from assigned where role is not null group by 1, 2, 3)""")
def fld5_contract(spark: S, sf: str) -> D:
    return folds.fold_contract(_folds(spark, sf)[0])


@query("symbol fold:i role fault", FOLD_SQL + """, co as (select symbol, fold, role, count(*) as n, min(ts) as f, max(ts) as l, sha256(string_agg(cast(ts as varchar), ',' order by ts)) as h from assigned where role is not null group by 1, 2, 3),
cn as (select symbol, fold, role, count(*) as n, min(ts) as f, max(ts) as l, sha256(string_agg(cast(ts as varchar), ',' order by ts)) as h from assigned where role is not null and volume >= 120 group by 1, 2, 3),
out as (select symbol, fold, role, case when cn.n is null then 'missing' when co.n is null then 'unknown' when co.n <> cn.n then 'rows' when co.f <> cn.f or co.l <> cn.l then 'span' when co.h <> cn.h then 'row_hash' end as fault from co full join cn using (symbol, fold, role) where cn.n is null or co.n is null or co.n <> cn.n or co.h <> cn.h)""")
def fld5_contract_faults(spark: S, sf: str) -> D:
    """Contracts of all folds against folds that lack the bars of low volume."""
    assigned = _folds(spark, sf)[0]
    terms = {"horizon": 1, "target": "close", "features": ["r1"]}
    return folds.contract_faults(folds.fold_contract(assigned), folds.fold_contract(assigned.where("volume >= 120")), terms, dict(terms))


_METRIC = FOLD_SQL + ", m as (select symbol, fold, case when count(*) > 1 then avg(close / open - 1) / stddev_samp(close / open - 1) end as metric from assigned where role = 'test' group by 1, 2)"


@query("symbol folds:i mean:6 std:6", _METRIC + ", out as (select symbol, count(metric) as folds, avg(metric) as mean, case when count(metric) >= 2 then stddev_samp(metric) end as std from m group by 1)")
def fld6_fold_metrics(spark: S, sf: str) -> D:
    scored = _targets(spark, sf).groupBy("symbol", "fold").agg((F.avg("target") / F.stddev_samp("target")).alias("metric"))
    return folds.fold_metrics(scored)


@query("leaks:i", "out as (select 0 as leaks)")
def fld7_no_leaks(spark: S, sf: str) -> D:
    assigned, table = _folds(spark, sf)
    return folds.leaks(assigned, table, 5).agg(F.count("*").alias("leaks"))


@query("symbol fold:i", """art as (select distinct p_brand as symbol, p_size % 10 as fold, p_partkey % 4 as artifact from part),
out as (select symbol, fold from art group by 1, 2 having count(distinct artifact) = 4)""", "")
def fld8_complete_folds(spark: S, sf: str) -> D:
    art = read(spark, sf, "part").select(F.col("p_brand").alias("symbol"), (F.col("p_size") % 10).alias("fold"), (F.col("p_partkey") % 4).cast("string").alias("artifact"))
    return folds.complete_folds(art, ["0", "1", "2", "3"])[0]


@query("symbol ts:s fold:i close:8", FOLD_SQL + ", out as (select symbol, ts, fold, close from assigned where role = 'test')")
def join12_fold_replay(spark: S, sf: str) -> D:
    saved = _folds(spark, sf)[0].where("role = 'test'").select("symbol", "fold", "pos", "ts")
    found, missing = folds.replay_rows(price_bars(spark, sf), saved)
    return found.join(missing.select("symbol").distinct(), "symbol", "left_anti")


def _stats_sql(c: str, kind: str) -> str:
    x = f"greatest(least({c}, m_{c} + 3 * s_{c}), m_{c} - 3 * s_{c})" if kind != "volume" else c
    a, b = ("min", f"max({x}) - min({x})") if kind in ("price", "volume") else ("avg", f"stddev_pop({x})")
    lo, hi = (f"first(m_{c} - 3 * s_{c})", f"first(m_{c} + 3 * s_{c})") if kind != "volume" else ("cast(null as double)",) * 2
    return f"select symbol, fold, '{c}' as col, {lo} as low, {hi} as high, {a}({x}) as center, case when {b} > 0 then {b} else 1 end as width from tr join lim using (symbol, fold) group by 1, 2"


SCALE_SQL = FOLD_SQL + """, lv as (select symbol, ts, fold, role, open, close, ln(1 + case when volume <> 0 then volume else 1 end) as volume, (high - low) / close as spread from assigned where role is not null),
tr as (select * from lv where role = 'train'),
lim as (select symbol, fold, avg(open) as m_open, nullif(stddev_samp(open), 0) as s_open, avg(close) as m_close, nullif(stddev_samp(close), 0) as s_close, avg(spread) as m_spread, nullif(stddev_samp(spread), 0) as s_spread from tr group by 1, 2),
state as (""" + " union all ".join(_stats_sql(c, k) for c, k in (("open", "price"), ("close", "price"), ("volume", "volume"), ("spread", "technical"))) + ")"
_GROUPS = {"price": ["open", "close"], "volume": ["volume"], "technical": ["spread"]}


def _scaled(spark: S, sf: str) -> tuple[D, D]:
    rows = _folds(spark, sf)[0].withColumn("spread", (F.col("high") - F.col("low")) / F.col("close"))
    rows = scaling.log_volume(rows, ["volume"])
    return rows, scaling.fit_scalers(rows.where("role = 'train'"), _GROUPS)


@query("symbol fold:i col low:4 high:4 center:7 width:7", SCALE_SQL + ", out as (select * from state)")
def scl1_fit(spark: S, sf: str) -> D:
    return _scaled(spark, sf)[1].withColumnRenamed("column", "col")


def _apply_sql(c: str) -> str:
    return f"""(greatest(least(lv.{c}, coalesce(max(high) filter (col = '{c}'), lv.{c})), coalesce(max(low) filter (col = '{c}'), lv.{c})) - max(center) filter (col = '{c}')) / max(width) filter (col = '{c}') as {c}"""


@query("symbol ts:s fold:i role open:4 close:4 volume:4 spread:4", SCALE_SQL + ", out as (select lv.symbol, lv.ts, lv.fold, lv.role, " + ", ".join(_apply_sql(c) for c in ("open", "close", "volume", "spread")) + " from lv join state using (symbol, fold) group by lv.symbol, lv.ts, lv.fold, lv.role, lv.open, lv.close, lv.volume, lv.spread)")
def scl4_transform(spark: S, sf: str) -> D:
    rows, state = _scaled(spark, sf)
    return scaling.apply_scalers(rows, state, ["open", "close", "volume", "spread"])


@query("symbol ts:s fold:i spread:4 volume:4", SCALE_SQL + """, st as (select symbol, fold, avg(spread) as ms, stddev_samp(spread) as ss, avg(volume) as mv, stddev_samp(volume) as sv from tr group by 1, 2),
out as (select symbol, ts, fold, case when ss > 1.5 or ss < 0.1 then (spread - ms) / (ss + 1e-8) else spread end as spread, case when sv > 1.5 or sv < 0.1 then (volume - mv) / (sv + 1e-8) else volume end as volume from lv join st using (symbol, fold) where role = 'test')""")
def scl5_restandardize(spark: S, sf: str) -> D:
    rows, _ = _scaled(spark, sf)
    return scaling.restandardize(rows.where("role = 'test'"), rows.where("role = 'train'"), ["spread", "volume"])
