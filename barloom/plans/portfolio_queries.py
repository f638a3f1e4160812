"""Queries over members, portfolios, evaluation and conformal bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from barloom.functions.windows import change, clip, ordered
from barloom.operators import conformal, evaluate as ev, features as ft, members as mb, portfolio as pf
from barloom.plans.feature_queries import BASELINE_SQL, SIGMA_SQL, W, full
from barloom.plans.normal_sql import cdf_sql, deflated_sql, luck_sql
from barloom.plans.panels import price_bars, read
from barloom.plans.registry import query

S, D = SparkSession, DataFrame
DAY = "symbol ts:s"
KINDS = ("hold", "ma_cross", "tsmom")
WEIGHT = 0.03


def baselines(spark: S, sf: str) -> D:
    return ft.baseline_positions(price_bars(spark, sf))


def member_table(spark: S, sf: str) -> D:
    """Positions of three members in long form."""
    rows = baselines(spark, sf)
    items = F.array(*(F.struct(F.lit(k).alias("member"), F.col(k).cast("double").alias("pos")) for k in KINDS))
    return rows.select("symbol", "ts", F.inline(items))


def weights(spark: S) -> D:
    return spark.createDataFrame([("hold", "policy", 0.5), ("ma_cross", "forecast", 0.8), ("tsmom", "forecast", 0.0)], "member string, kind string, weight double")


MEMBER_SQL = BASELINE_SQL + """, mem as (select symbol, ts, 'hold' as member, hold as pos from base union all select symbol, ts, 'ma_cross', ma_cross from base union all select symbol, ts, 'tsmom', tsmom from base),
wt as (select * from (values ('hold', 0.5), ('ma_cross', 0.8), ('tsmom', 0.0)) v(member, weight)),
blended as (select symbol, ts, greatest(-0.9, least(0.9, sum(pos * weight) filter (weight > 0) / sum(weight) filter (weight > 0))) as position from mem join wt using (member) group by 1, 2),
agreed as (select symbol, ts, coalesce(abs(avg(sign(pos)) filter (pos <> 0)), 0) as agreement from mem group by 1, 2),
conf as (select symbol, ts, position, agreement, 0.5 * abs(position) + 0.5 * agreement as confidence from blended join agreed using (symbol, ts))"""


def blended(spark: S, sf: str) -> D:
    return mb.blend(member_table(spark, sf), weights(spark), 0.9)


def confident(spark: S, sf: str) -> D:
    return mb.confidence(blended(spark, sf), mb.agreement(member_table(spark, sf)))


@query(f"{DAY} position:6", SIGMA_SQL + f", out as (select symbol, ts, greatest(-1, least(1, 0.02 * (close / lag(close) {W} - 1) / sigma)) * nullif(cast(lag(close) {W} is not null as int), 0) as position from vol)")
def mod5_return_position(spark: S, sf: str) -> D:
    b = ft.realized_vol(price_bars(spark, sf)).withColumn("r", change(F.col("close")))
    return b.withColumn("position", mb.return_position(F.col("r"), F.col("sigma"), 0.02, 1.0))


@query(f"{DAY} position:6", SIGMA_SQL + ", out as (select symbol, ts, greatest(-1, least(1, 0.02 * ((open - close) / close) / sigma)) as position from vol)")
def mod6_price_position(spark: S, sf: str) -> D:
    b = ft.realized_vol(price_bars(spark, sf))
    return b.withColumn("position", mb.price_position(F.col("close"), F.col("open"), F.col("sigma"), 0.02, 1.0))


IDEAL_SQL = SIGMA_SQL + f", ideals as (select *, case when lead(close, 5) {W} is not null then greatest(-1, least(1, 0.02 * ((lead(close, 5) {W} - close) / close) / sigma)) end as ideal from vol)"


def ideals(spark: S, sf: str) -> D:
    return mb.ideal_positions(ft.realized_vol(price_bars(spark, sf)), 5, 0.02, 1.0)


@query(f"{DAY} ideal:6", IDEAL_SQL + ", out as (select * from ideals)")
def mod7_ideal_position(spark: S, sf: str) -> D:
    return ideals(spark, sf)


@query("member kind weight:3", "out as (select * from (values ('hold', 'policy', 0.5), ('ma_cross', 'forecast', 0.8), ('tsmom', 'forecast', 0.0)) v(member, kind, weight) where member in (select distinct 'hold' from bars union select distinct 'ma_cross' from bars union select distinct 'tsmom' from bars))")
def mod8_members(spark: S, sf: str) -> D:
    return weights(spark).join(member_table(spark, sf).select("member").distinct(), "member", "left_semi")


@query(f"{DAY} position:6", MEMBER_SQL + ", out as (select * from blended)")
def mod9_blend(spark: S, sf: str) -> D:
    return blended(spark, sf)


@query(f"{DAY} position:6", MEMBER_SQL + ", out as (select symbol, ts, greatest(-2, least(2, sum(pos * weight) filter (weight > 0))) as position from mem join wt using (member) group by 1, 2)")
def mod10_conviction_score(spark: S, sf: str) -> D:
    return mb.blend(member_table(spark, sf), weights(spark), 2.0, renormalize=False)


@query(f"{DAY} member pos:4 weight:4 contrib:6", MEMBER_SQL + ", out as (select symbol, ts, member, pos, weight, pos * weight as contrib from mem join wt using (member))")
def mod13_contributions(spark: S, sf: str) -> D:
    return mb.contributions(member_table(spark, sf), weights(spark))


@query("symbol n:i mae:6 mse:6 rmse:6 r2:5", IDEAL_SQL + ", " + MEMBER_SQL + """, j as (select symbol, position - ideal as e, ideal from blended join ideals using (symbol, ts) where ideal is not null),
out as (select symbol, count(*) as n, avg(abs(e)) as mae, avg(e * e) as mse, sqrt(avg(e * e)) as rmse, 1 - avg(e * e) / var_pop(ideal) as r2 from j group by 1)""")
def mod14_evaluation(spark: S, sf: str) -> D:
    return mb.evaluate(blended(spark, sf).join(ideals(spark, sf).select("symbol", "ts", "ideal"), ["symbol", "ts"]), ["symbol"])


@query("member symbol n:i mae:6 rmse:6", IDEAL_SQL + ", " + MEMBER_SQL + """, j as (select member, symbol, pos - ideal as e from mem join ideals using (symbol, ts) where ideal is not null and pos is not null),
out as (select member, symbol, count(*) as n, avg(abs(e)) as mae, sqrt(avg(e * e)) as rmse from j group by 1, 2)""")
def mod14_member_errors(spark: S, sf: str) -> D:
    """Errors of each member beside those of the blend."""
    judged = member_table(spark, sf).withColumnRenamed("pos", "position").join(ideals(spark, sf).select("symbol", "ts", "ideal"), ["symbol", "ts"])
    return mb.evaluate(judged, ["member", "symbol"])


def _simplex_sql() -> str:
    """``best``: the weights of least loss among the stationary points of every set of three members, inside the simplex and on its edge."""
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    points = [["0", "0", "0"]]
    put = lambda w: [w.get(i, "0") for i in range(3)]
    for i in range(3):
        points += [put({i: f"c{i} / nullif({g(i, i)}, 0)"}), put({i: "1"})]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        det = f"nullif({g(i, i)} * {g(j, j)} - {g(i, j)} * {g(i, j)}, 0)"
        points.append(put({i: f"(c{i} * {g(j, j)} - c{j} * {g(i, j)}) / {det}", j: f"(c{j} * {g(i, i)} - c{i} * {g(i, j)}) / {det}"}))
        on = f"({g(j, j)} - {g(i, j)} + c{i} - c{j}) / nullif({g(i, i)} + {g(j, j)} - 2 * {g(i, j)}, 0)"
        points.append(put({i: on, j: f"1 - {on}"}))
    minor = lambda r, s: f"({g(*r)} * {g(*s)})"
    a = {(0, 0): f"{minor((1, 1), (2, 2))} - {minor((1, 2), (1, 2))}", (0, 1): f"{minor((0, 2), (1, 2))} - {minor((0, 1), (2, 2))}", (0, 2): f"{minor((0, 1), (1, 2))} - {minor((0, 2), (1, 1))}",
         (1, 1): f"{minor((0, 0), (2, 2))} - {minor((0, 2), (0, 2))}", (1, 2): f"{minor((0, 1), (0, 2))} - {minor((0, 0), (1, 2))}", (2, 2): f"{minor((0, 0), (1, 1))} - {minor((0, 1), (0, 1))}"}
    inv = lambda i, j: f"({a[min(i, j), max(i, j)]})"
    det = f"nullif(g00 * {inv(0, 0)} + g01 * {inv(0, 1)} + g02 * {inv(0, 2)}, 0)"
    free = [f"(({' + '.join(f'{inv(i, j)} * c{j}' for j in range(3))}) / {det})" for i in range(3)]
    rows = [f"(({' + '.join(inv(i, j) for j in range(3))}) / {det})" for i in range(3)]
    over = f"(({' + '.join(free)}) - 1) / nullif({' + '.join(rows)}, 0)"
    points += [free, [f"{f} - {r} * ({over})" for f, r in zip(free, rows, strict=True)]]
    every = " union all ".join(f"select *, {w0} as w0, {w1} as w1, {w2} as w2 from mo" for w0, w1, w2 in points)
    loss = " + ".join(f"w{i} * w{j} * {g(i, j)}" for i in range(3) for j in range(3)) + " - 2 * (w0 * c0 + w1 * c1 + w2 * c2)"
    return f"pts as ({every}), best as (select arg_min(struct_pack(w0 := w0, w1 := w1, w2 := w2), {loss}) as w from pts where w0 >= -1e-12 and w1 >= -1e-12 and w2 >= -1e-12 and w0 + w1 + w2 <= 1 + 1e-12)"


@query("member weight:6", IDEAL_SQL + ", " + MEMBER_SQL + """, oo as (select b.hold::double as m0, b.ma_cross::double as m1, b.tsmom::double as m2, ideal from base b join ideals using (symbol, ts) where ideal is not null and b.hold is not null and b.ma_cross is not null and b.tsmom is not null),
mo as (select avg(m0 * m0) as g00, avg(m0 * m1) as g01, avg(m0 * m2) as g02, avg(m1 * m1) as g11, avg(m1 * m2) as g12, avg(m2 * m2) as g22, avg(m0 * ideal) as c0, avg(m1 * ideal) as c1, avg(m2 * ideal) as c2 from oo), """ + _simplex_sql() + """,
out as (select 'hold' as member, w.w0 as weight from best union all select 'ma_cross', w.w1 from best union all select 'tsmom', w.w2 from best)""")
def mod11_meta_weights(spark: S, sf: str) -> D:
    """Weights of three members over all rows."""
    oof = baselines(spark, sf).select("symbol", "ts", *(F.col(k).cast("double") for k in KINDS)).join(ideals(spark, sf).select("symbol", "ts", "ideal"), ["symbol", "ts"])
    return mb.meta_weights_by(oof.withColumn("_all", F.lit(0)), list(KINDS), ["_all"], [0.5, 0.8, 0.0])


@query(f"{DAY} agreement:6 confidence:6", MEMBER_SQL + ", out as (select * from conf)")
def mod15_agreement(spark: S, sf: str) -> D:
    return confident(spark, sf)


@query(f"{DAY} position:6 confidence:6", MEMBER_SQL + """, s as (select c.symbol, c.ts, position, confidence, (b.close - b.open) / (b.close + b.open) as score, case when b.volume > 200 then 0.25 end as momentum from conf c join bars b on b.symbol = c.symbol and b.ts = c.ts),
out as (select symbol, ts, greatest(-1, least(1, 0.7 * position + 0.3 * greatest(-1, least(1, (score + coalesce(momentum, 0)) / 3)))) as position, confidence + least(0.2, (abs(score) + abs(coalesce(momentum, 0))) / 10) as confidence from s)""")
def mod16_sentiment_overlay(spark: S, sf: str) -> D:
    b = price_bars(spark, sf)
    tone = b.select("symbol", "ts", ((F.col("close") - F.col("open")) / (F.col("close") + F.col("open"))).alias("score"), F.when(F.col("volume") > 200, 0.25).alias("momentum"))
    return mb.sentiment_overlay(confident(spark, sf).join(tone, ["symbol", "ts"]))


@query(f"{DAY} signal confidence:6", MEMBER_SQL + ", out as (select symbol, ts, case when position > 0.1 then 'LONG' when position < -0.1 then 'SHORT' else 'FLAT' end as signal, confidence * greatest(0, 1 - agreement / 1.8) as confidence from conf)")
def mod17_signals(spark: S, sf: str) -> D:
    return mb.signals(confident(spark, sf), 0.1, 0.9, "agreement")


@query(f"{DAY} label", MEMBER_SQL + ", out as (select symbol, ts, case when position * 2 < -1 then 'Strong Buy' when position * 2 < -0.5 then 'Strong Sell' when position * 2 < 0 then 'Sell' when position * 2 < 0.5 then 'Hold' when position * 2 < 1 then 'Buy' else 'Strong Buy' end as label from blended)")
def prj13_signal_labels(spark: S, sf: str) -> D:
    return blended(spark, sf).withColumn("label", mb.signal_label(F.col("position") * 2))


@query(f"{DAY} position:6", MEMBER_SQL + ", l as (select symbol, max(ts) as t, arg_max(position, ts) as position from blended group by 1), out as (select symbol, cast(t + cast(k as int) as date) as ts, position from l, (select unnest(range(1, 6)) as k))")
def mod18_flat_forecast(spark: S, sf: str) -> D:
    last = blended(spark, sf).groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("position", "ts").alias("position"))
    return mb.flat_forecast(last, 5)


@query(f"{DAY} reward:8", MEMBER_SQL + f""", p as (select symbol, ts, close, ma_cross as position from base),
out as (select symbol, ts, (position * (lead(close) {W} - close) / close - 0.001 * abs(position - coalesce(lag(position) {W}, 0))) * 10 as reward from p)""")
def mod19_rewards(spark: S, sf: str) -> D:
    return mb.reward_stream(baselines(spark, sf).withColumn("position", F.col("ma_cross").cast("double")), 0.001, 10.0)


# portfolios ----------------------------------------------------------------

TARGET_SQL = BASELINE_SQL + f""", tgt as (select 'ma_cross' as portfolio, symbol, ts, open, close, volume, case when volume < 60 then null else ma_cross * {WEIGHT} end as target from base
  union all select 'tsmom', symbol, ts, open, close, volume, case when volume < 60 then null else tsmom * {WEIGHT} end from base),
held as (select *, coalesce(last_value(target ignore nulls) over (partition by portfolio, symbol order by ts rows between unbounded preceding and 1 preceding), 0) as held from tgt),
moves as (select *, lead(open) over s / open - 1 as move, held - coalesce(lag(held) over s, 0) as trade from held window s as (partition by portfolio, symbol order by ts)),
acc as (select portfolio, ts, sum(held * coalesce(move, 0)) as gross_return, sum(abs(trade)) * 1.5 / 1e4 as trading, sum(trade * trade) * 5 / 1e4 as impact, sum(greatest(-held, 0)) * 50 / 1e4 / 252 as borrow,
  sum(abs(trade)) as turnover, sum(abs(held)) as gross, sum(held) as net from moves group by 1, 2),
acct as (select *, trading + impact + borrow as cost, gross_return - trading - impact - borrow as net_return from acc)"""


def targets(spark: S, sf: str) -> D:
    rows = baselines(spark, sf)
    both = F.array(*(F.struct(F.lit(k).alias("portfolio"), F.when(F.col("volume") >= 60, F.col(k) * WEIGHT).alias("target")) for k in ("ma_cross", "tsmom")))
    return rows.select("symbol", "ts", "open", "close", "volume", F.inline(both))


def accounts(spark: S, sf: str, costs: pf.Costs = pf.Costs()) -> D:
    return pf.account(pf.fills(targets(spark, sf)), costs)


def flagship(spark: S, sf: str) -> D:
    return pf.metrics(accounts(spark, sf))


@query(f"{DAY} weight:8", BASELINE_SQL + ", b as (select symbol, ts, tsmom * 0.07 as weight, sum(abs(tsmom * 0.07)) over (partition by ts) as g from base), out as (select symbol, ts, weight * case when g > 1 then 1 / g else 1 end as weight from b)")
def port1_scale_to_gross(spark: S, sf: str) -> D:
    return pf.scale_to_gross(baselines(spark, sf).withColumn("weight", F.col("tsmom") * 0.07), 1.0)


@query(f"{DAY} weight:8", BASELINE_SQL + """, u as (select symbol, ts, hold * 0.05 as weight from base union all select symbol, ts, ma_cross * 0.05 from base), c as (select symbol, ts, greatest(-0.06, least(0.06, sum(weight))) as weight from u group by 1, 2),
g as (select *, sum(abs(weight)) over (partition by ts) as g from c), out as (select symbol, ts, weight * case when g > 0.8 then 0.8 / g else 1 end as weight from g)""")
def port2_combine_books(spark: S, sf: str) -> D:
    b = baselines(spark, sf)
    legs = b.select("ts", "symbol", (F.col("hold") * 0.05).alias("weight")).unionByName(b.select("ts", "symbol", (F.col("ma_cross") * 0.05).alias("weight")))
    return pf.combine_books(legs, 0.06, 0.8)


_CAPPED = BASELINE_SQL + f", b as (select *, (close / lag(close) {W} - 1) as weight from base), g as (select *, sum(abs(coalesce(weight, 0))) over (partition by ts) as g from b)"


@query(f"{DAY} weight:8", _CAPPED + ", out as (select symbol, ts, greatest(-0.2, least(0.2, coalesce(weight, 0) * case when g > 1 then 1 / g else 1 end)) as weight from g)")
def port3_cap_book(spark: S, sf: str) -> D:
    return pf.cap_book(price_bars(spark, sf).withColumn("weight", change(F.col("close"))), 0.2, 1.0)


@query(f"{DAY} held:10", """num as (select symbol, ts, round(close / open - 1, 10) as w, row_number() over (partition by symbol order by ts) as rn from bars),
scan as (select symbol, ts, rn, case when abs(w) > 0.3 then w else 0 end as held from num where rn = 1
  union all select n.symbol, n.ts, n.rn, case when abs(n.w - s.held) > 0.3 then n.w else s.held end from scan s join num n on n.symbol = s.symbol and n.rn = s.rn + 1), out as (select * from scan)""", recursive=True)
def port4_no_trade_band(spark: S, sf: str) -> D:
    return pf.no_trade_band(price_bars(spark, sf).select("symbol", "ts", F.round(F.col("close") / F.col("open") - 1, 10).alias("weight")), 0.3)


@query(f"{DAY} weight:8", _CAPPED + """, d as (select symbol, ts, weight is not null as known, greatest(-1, least(1, weight)) * 0.1 as x from g), e as (select *, sum(abs(coalesce(x * known::int, 0))) over (partition by ts) as gg from d),
out as (select symbol, ts, case when known then greatest(-0.08, least(0.08, x * case when gg > 1 then 1 / gg else 1 end)) end as weight from e)""")
def port5_directional_targets(spark: S, sf: str) -> D:
    return pf.directional_targets(price_bars(spark, sf).withColumn("score", change(F.col("close"))), 0.1, 0.08, 1.0)


@query(f"portfolio {DAY} target:8", TARGET_SQL + """, g as (select *, sum(abs(coalesce(target, 0))) over (partition by portfolio, ts) as g from tgt),
out as (select portfolio, symbol, ts, case when target is not null then target * case when g > 0.4 then 0.4 / g else 1 end end as target from g)""")
def port6_target_matrix(spark: S, sf: str) -> D:
    t = targets(spark, sf).withColumn("_known", F.col("target").isNotNull())
    return pf.scale_to_gross(t, 0.4, "target", ("portfolio", "ts")).withColumn("target", F.when(F.col("_known"), F.col("target")))


@query(f"portfolio {DAY} held:8", TARGET_SQL + ", out as (select * from held)")
def port7_fills(spark: S, sf: str) -> D:
    return pf.fills(targets(spark, sf))


_HELD = "list_transform(range(1, len(s.held) + 1), lambda i: case when s.tg[i] is null or abs(s.tg[i] - s.held[i]) <= 0.01 then s.held[i] else s.tg[i] end)"


@query(f"portfolio {DAY} held:8", TARGET_SQL + f""", dg as (select portfolio, ts, list(target order by symbol) as tg, list(symbol order by symbol) as sy from (select p.portfolio, d.ts, n.symbol, target from (select distinct portfolio from tgt) p cross join (select distinct ts from tgt) d cross join (select distinct symbol from tgt) n left join tgt using (portfolio, ts, symbol)) group by 1, 2),
dn as (select *, row_number() over (partition by portfolio order by ts) as rn from dg),
scan as (select portfolio, ts, sy, tg, rn, list_transform(tg, lambda x: 0.0::double) as held from dn where rn = 1
  union all select portfolio, ts, sy, tg, rn, case when len(list_filter(range(1, len(book) + 1), lambda i: abs(book[i] - was[i]) > 1e-8 + 1e-5 * abs(was[i]))) > 0 then book else was end as held
  from (select portfolio, ts, sy, tg, rn, was, case when g > 0.4 then list_transform(raw, lambda x: x * 0.4 / g) else raw end as book from
    (select *, list_sum(list_transform(raw, lambda x: abs(x))) as g from (select n.portfolio, n.ts, n.sy, n.tg, n.rn, s.held as was, {_HELD} as raw from scan s join dn n on n.portfolio = s.portfolio and n.rn = s.rn + 1)))),
un as (select portfolio, ts, unnest(sy) as symbol, unnest(held) as held from scan), out as (select un.* from un join tgt using (portfolio, ts, symbol))""", recursive=True)
def port7_banded_fills(spark: S, sf: str) -> D:
    """Fills with a no-trade band of 0.01 and a gross limit of 0.4."""
    return pf.banded_fills(targets(spark, sf).select("portfolio", "symbol", "ts", "target"), 0.01, 0.4)


@query("portfolio ts:s gross_return:7 trading:10 impact:10 borrow:10 cost:10 turnover:7 gross:7 net:7 net_return:7", TARGET_SQL + ", out as (select * from acct)")
def port8_accounts(spark: S, sf: str) -> D:
    return accounts(spark, sf)


@query("portfolio ts:s impact:9", TARGET_SQL.replace("from moves group", "from moves group") + ", out as (select portfolio, ts, sum(abs(trade) * 5 / 1e4 * sqrt(abs(trade) * 1e6 / greatest(close * volume, 1))) as impact from moves group by 1, 2)")
def port9_adv_impact(spark: S, sf: str) -> D:
    t = pf.fills(targets(spark, sf)).withColumn("adv", F.col("close") * F.col("volume"))
    return pf.account(t, pf.Costs(impact_model="adv_sqrt"))


@query("portfolio ts:s gross_return:7", TARGET_SQL + """, dv as (select *, case when month(ts) = 3 then close * 0.01 end as dividend from moves), nx as (select *, lead(dividend) over (partition by portfolio, symbol order by ts) as paid from dv),
out as (select portfolio, ts, sum(held * (coalesce(move, 0) + coalesce(paid, 0) / open)) as gross_return from nx group by 1, 2)""")
def join11_dividends(spark: S, sf: str) -> D:
    t = pf.fills(targets(spark, sf)).withColumn("dividend", F.when(F.month("ts") == 3, F.col("close") * 0.01))
    return pf.account(t, pf.Costs(), dividends=True)


METRIC_SQL = TARGET_SQL + """, safe as (select *, net_return as r from acct),
eq as (select *, product(1 + r) over (partition by portfolio order by ts rows between unbounded preceding and current row) as e from safe),
dd as (select *, 1 - e / greatest(1, max(e) over (partition by portfolio order by ts rows between unbounded preceding and current row)) as d from eq)"""


def signed_log_sql(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


def signed_log(x: Column) -> Column:
    """Values of either sign and any size on one scale: prices made of single trades jump by more than any market's."""
    return F.signum(x) * F.log1p(F.abs(x))


def with_logs(metrics: D, *names: str) -> D:
    return metrics.withColumns({c: signed_log(F.col(c)) for c in names})


@query("portfolio ts:s equity:5", METRIC_SQL + f", out as (select portfolio, ts, {signed_log_sql('e')} as equity from eq)")
def port10_log_equity(spark: S, sf: str) -> D:
    """Equity, through ruin and back, as a signed logarithm."""
    return with_logs(pf.equity(accounts(spark, sf), 1.0), "equity")


def metrics_sql(rows: str) -> str:
    """``mt``: the metrics of the drawdown rows ``rows(portfolio, r, d, gross, net, turnover, cost)``."""
    return f"""mo as (select portfolio, count(r) as bars, product(1 + r) as g, avg(r) as m, stddev_samp(r) as sd, max(d) as max_drawdown, avg(gross) as avg_gross, avg(net) as avg_net, avg(turnover) as avg_turnover, sum(cost) as total_cost from {rows} group by 1),
mc as (select portfolio, avg((r - m) ** 3) / pow(avg((r - m) ** 2), 1.5) as skew, avg((r - m) ** 4) / pow(avg((r - m) ** 2), 2) as kurt from {rows} join (select portfolio, m from mo) using (portfolio) group by 1),
my as (select *, g - 1 as total_return, case when g >= 0 then pow(g, 252.0 / bars) - 1 end as annual_return, sd * sqrt(252) as volatility, case when sd > 1e-15 then m / sd end as sr from mo join mc using (portfolio)),
mz as (select *, case when bars >= 3 and 1 - skew * sr + (kurt - 1) / 4 * sr * sr > 0 then sr * sqrt(bars - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) end as z from my),
mt as (select *, sr * sqrt(252) as sharpe, {cdf_sql('z')} as psr, case when max_drawdown > 1e-9 then annual_return / max_drawdown end as calmar from mz)"""


LOGGED = ("total_return", "annual_return", "max_drawdown", "calmar")
METRICS = "portfolio bars:i total_return:5 annual_return:5 volatility:5 sharpe:6 psr:6 max_drawdown:5 calmar:5 avg_gross:6 avg_net:6 avg_turnover:6 total_cost:10"
_LOGGED_SQL = "select * replace (" + ", ".join(f"{signed_log_sql(c)} as {c}" for c in LOGGED) + ") from mt"


@query(METRICS, METRIC_SQL + ", " + metrics_sql("dd") + f", out as ({_LOGGED_SQL})")
def port11_metrics(spark: S, sf: str) -> D:
    """All metrics of the accounts as they are; those that ruin throws far as signed logarithms."""
    return with_logs(pf.metrics(accounts(spark, sf), 1.0), *LOGGED)


@query("portfolio ts:s equity:5", METRIC_SQL + f", x as (select *, product(1 + r) over (partition by portfolio order by ts rows between unbounded preceding and current row) as q from safe where ts >= date '1999-01-01'), out as (select portfolio, ts, {signed_log_sql('q')} as equity from x)")
def port12_slice(spark: S, sf: str) -> D:
    a = accounts(spark, sf)
    return with_logs(pf.slice_result(a, a.where("ts >= date '1999-01-01'").select("portfolio", "ts"), 1.0), "equity")


SIDE_SQL = BASELINE_SQL + f", sd as (select symbol, ts, open, close, cast(ma_cross as int) as side, 0.5 as confidence from base), ch as (select *, coalesce(lag(side) {W}, 0) as before from sd), ords as (select symbol, ts, 'close' as kind, -before as side, close, open, 0 as shares from ch where side <> before and before <> 0 union all select symbol, ts, 'open', side, close, open, 100000 * 0.5 / close from ch where side <> before and side <> 0)"


def sides(spark: S, sf: str) -> D:
    return baselines(spark, sf).select("symbol", "ts", "open", "close", F.col("ma_cross").cast("int").alias("side"), F.lit(0.5).alias("confidence"))


@query(f"{DAY} kind side:i shares:6", SIDE_SQL + ", out as (select symbol, ts, kind, side, case when kind = 'open' then shares end as shares from ords)")
def port13_orders(spark: S, sf: str) -> D:
    return pf.orders(sides(spark, sf), 1e6, 0.1)


LOG_SQL = SIDE_SQL + ", lg as (select *, lead(ts) over w as exit_ts, lead(close) over w as exit_price from ords window w as (partition by symbol order by ts, case when kind = 'close' then 0 else 1 end)), trips as (select symbol, ts, side, shares, exit_ts, side * shares * (exit_price - close) as pnl from lg where kind = 'open')"


def trips(spark: S, sf: str) -> D:
    o = pf.orders(sides(spark, sf), 1e6, 0.1).join(price_bars(spark, sf).select("symbol", "ts", F.col("close").alias("price")), ["symbol", "ts"])
    return pf.trade_log(o)


@query(f"{DAY} side:i exit_ts:s pnl:3", LOG_SQL + ", out as (select * from trips)")
def port14_trade_log(spark: S, sf: str) -> D:
    return trips(spark, sf)


@query("trades:i win_rate:6 avg_win:2 avg_loss:2 profit_factor:6", LOG_SQL + """, t as (select pnl from trips where pnl is not null),
out as (select count(*) as trades, count(*) filter (pnl > 0) / count(*) as win_rate, coalesce(avg(pnl) filter (pnl > 0), 0) as avg_win, coalesce(avg(pnl) filter (pnl <= 0), 0) as avg_loss, case when sum(pnl) filter (pnl <= 0) < 0 then coalesce(sum(pnl) filter (pnl > 0), 0) / -sum(pnl) filter (pnl <= 0) end as profit_factor from t)""")
def port17_trade_statistics(spark: S, sf: str) -> D:
    return pf.trade_statistics(trips(spark, sf))


@query("kind long_opens:i short_opens:i notional:1", SIDE_SQL + ", out as (select kind, count(*) filter (kind = 'open' and side > 0) as long_opens, count(*) filter (kind = 'open' and side < 0) as short_opens, sum(shares * close) as notional from ords group by 1)")
def port22_breakdown(spark: S, sf: str) -> D:
    o = pf.orders(sides(spark, sf), 1e6, 0.1).join(price_bars(spark, sf).select("symbol", "ts", "close"), ["symbol", "ts"])
    opened = F.col("kind") == "open"
    return o.groupBy("kind").agg(F.count_if(opened & (F.col("side") > 0)).alias("long_opens"), F.count_if(opened & (F.col("side") < 0)).alias("short_opens"), F.sum(F.coalesce("shares", F.lit(0.0)) * F.col("close")).alias("notional"))


@query("ts:s value:2", LOG_SQL + """, mk as (select b.ts, case when side > 0 then shares * b.close else shares * (2 * lg.close - b.close) end as v from lg join bars b on b.symbol = lg.symbol and b.ts >= lg.ts and b.ts < coalesce(exit_ts, date '9999-01-01') where kind = 'open'),
out as (select ts, sum(v) + 1000 as value from mk group by 1)""")
def port15_marked_value(spark: S, sf: str) -> D:
    t = trips(spark, sf).withColumnRenamed("price", "entry")
    bars = price_bars(spark, sf).select("symbol", F.col("ts").alias("at"), F.col("close").alias("price"))
    w = Window.partitionBy("symbol").orderBy("at", "_k").rowsBetween(Window.unboundedPreceding, 0)
    opened = t.select("symbol", F.col("ts").alias("at"), F.lit(0).alias("_k"), F.struct("side", "shares", "entry", "exit_ts").alias("p"), F.lit(None).cast("double").alias("price"))
    marks = bars.select("symbol", "at", F.lit(1).alias("_k"), F.lit(None).cast(opened.schema["p"].dataType).alias("p"), "price")
    live = opened.unionByName(marks).withColumn("p", F.last("p", ignorenulls=True).over(w)).where("_k = 1 and p is not null and (p.exit_ts is null or at < p.exit_ts)")
    return pf.marked_value(live.select(F.col("at").alias("ts"), "p.side", "p.shares", "p.entry", "price"), 1000.0)


@query("ts:s ret:6", f"r as (select ts, close / lag(close) {W} - 1 as ret from bars), out as (select ts, avg(ret) as ret from r group by 1)")
def port18_combined_returns(spark: S, sf: str) -> D:
    return pf.combine_returns(price_bars(spark, sf).withColumn("ret", change(F.col("close"))))


@query("capital:1 portfolio total_impact:8", TARGET_SQL + ", caps as (select * from (values (1e5), (1e6), (1e7)) v(capital)), out as (select capital, portfolio, sum(abs(trade) * 5 / 1e4 * sqrt(abs(trade) * capital / greatest(close * volume, 1))) as total_impact from moves, caps group by 1, 2)")
def port19_capacity(spark: S, sf: str) -> D:
    held = pf.fills(targets(spark, sf)).withColumn("adv", F.col("close") * F.col("volume"))
    curves = [pf.account(held, pf.Costs(impact_model="adv_sqrt", capital=c)).groupBy("portfolio").agg(F.sum("impact").alias("total_impact")).withColumn("capital", F.lit(c)) for c in (1e5, 1e6, 1e7)]
    return curves[0].unionByName(curves[1]).unionByName(curves[2])


@query(f"{DAY} weight:8", MEMBER_SQL + ", t as (select symbol, ts, 0.1 * greatest(-1, least(1, position)) as w from blended), g as (select *, sum(abs(w)) over (partition by ts) as g from t), out as (select symbol, ts, w * case when g > 1 then 1 / g else 1 end as weight from g)")
def port20_target_from_position(spark: S, sf: str) -> D:
    t = blended(spark, sf).withColumn("weight", 0.1 * clip(F.col("position"), -1.0, 1.0))
    return pf.scale_to_gross(t, 1.0)


@query("fold:i " + METRICS, BASELINE_SQL + f""", t as (select 'hold/' || symbol as portfolio, symbol, ts, open, hold * 1.0 as target from base union all select 'tsmom/' || symbol, symbol, ts, open, tsmom from base),
h as (select *, coalesce(lag(target) over (partition by portfolio order by ts), 0) as held from t),
m as (select *, coalesce(lead(open) over w / open - 1, 0) as move, held - coalesce(lag(held) over w, 0) as trade from h window w as (partition by portfolio order by ts)),
ac as (select portfolio, ts, held * move as gross_return, abs(trade) * 1.5 / 1e4 + trade * trade * 5 / 1e4 + greatest(-held, 0) * 50 / 1e4 / 252 as cost, abs(trade) as turnover, abs(held) as gross, held as net from m),
fs as (select ts, floor((row_number() over (order by ts) - 1) * 4 / count(*) over ()) as fold from (select distinct ts from bars)),
ar as (select ac.portfolio || '@' || fold::int as portfolio, ts, gross_return - cost as r, cost, turnover, gross, net from ac join fs using (ts)),
eq as (select *, product(1 + r) over (partition by portfolio order by ts rows between unbounded preceding and current row) as e from ar),
dd as (select *, 1 - e / greatest(1, max(e) over (partition by portfolio order by ts rows between unbounded preceding and current row)) as d from eq), """ + metrics_sql("dd") + f""", lo as ({_LOGGED_SQL}),
out as (select * replace (split_part(portfolio, '@', 1) as portfolio), split_part(portfolio, '@', 2)::int as fold from lo)""")
def port23_baseline_runs(spark: S, sf: str) -> D:
    """Baselines of every symbol as portfolios with the costs of the blend, their metrics in each quarter of the calendar."""
    b = baselines(spark, sf)
    t = b.select("symbol", "ts", "open", F.inline(F.array(*(F.struct(F.concat_ws("/", F.lit(k), "symbol").alias("portfolio"), F.col(k).cast("double").alias("target")) for k in ("hold", "tsmom")))))
    place = F.row_number().over(Window.orderBy("ts")) - 1
    quarter = F.floor(place * 4 / F.count("*").over(Window.partitionBy())).cast("int")
    folds = b.select("ts").distinct().select("ts", quarter.alias("fold"))
    a = pf.account(pf.fills(t), pf.Costs()).join(folds, "ts").withColumn("portfolio", F.concat_ws("@", "portfolio", "fold"))
    m = with_logs(pf.metrics(a, 1.0), *LOGGED)
    return m.withColumns({"fold": F.split_part("portfolio", F.lit("@"), F.lit(2)).cast("int"), "portfolio": F.split_part("portfolio", F.lit("@"), F.lit(1))})


@query("order_id:i symbol submit_bar:i fill_bar:i ref_price:8 slip_bps:8 fill_price:6 slippage_cost:6 commission:6", """b as (select symbol, cast(row_number() over (partition by symbol order by ts) as int) as bar, case when volume >= 80 then open end as open from bars),
o as (select symbol, bar, bar * 100 + cast(substr(symbol, 7) as int) as order_id, cast(floor(bar / 50) * 50 + 49 as int) as fold_end, case when bar % 2 = 0 then 1 else -1 end as side from b where bar % 3 = 0),
f as (select order_id, o.symbol, o.bar as submit_bar, any_value(side) as side, min(b.bar) as fill_bar, arg_min(b.open, b.bar) as ref_price from o join b on b.symbol = o.symbol and b.bar > o.bar and b.bar <= fold_end and b.open > 0 group by 1, 2, 3),
s as (select *, 1.0 + 0.5 * abs(10 * ref_price) / 1e6 as slip_bps from f), p as (select *, ref_price * (1 + side * slip_bps / 1e4) as fill_price from s),
out as (select *, abs(fill_price - ref_price) * 10 as slippage_cost, 10 * fill_price * 0.5 / 1e4 as commission from p)""")
def join9_order_fills(spark: S, sf: str) -> D:
    b = price_bars(spark, sf).select("symbol", F.row_number().over(ordered("symbol")).alias("bar"), F.when(F.col("volume") >= 80, F.col("open")).alias("open"))
    key = (F.col("bar") * 100 + F.substring("symbol", 7, 10).cast("int")).cast("long")
    o = b.where("bar % 3 = 0").select(key.alias("order_id"), "symbol", "bar", (F.floor(F.col("bar") / 50) * 50 + 49).cast("int").alias("fold_end"))
    filled = pf.fill_orders(o, b).withColumns({"side": F.when(F.col("submit_bar") % 2 == 0, 1).otherwise(-1), "shares": F.lit(10.0)})
    return pf.price_fills(filled, 1.0, 0.5, 0.5, 1e6)


# evaluation ------------------------------------------------------------------

_RET = TARGET_SQL + ", ret as (select portfolio, ts, net_return as ret, cost, gross from acct)"


def returns(spark: S, sf: str) -> D:
    return accounts(spark, sf).withColumn("ret", F.col("net_return"))


@query("portfolio n:i sharpe:7", _RET + ", out as (select portfolio, count(ret) as n, avg(ret) / stddev_samp(ret) as sharpe from ret group by 1)")
def eval1_sharpe(spark: S, sf: str) -> D:
    return ev.periodic_sharpe(returns(spark, sf), ["portfolio"])


_MOM = _RET + """, c as (select portfolio, ret, avg(ret) over (partition by portfolio) as m from ret),
mo as (select portfolio, count(*) as n, avg(ret) / stddev_samp(ret) as sharpe, avg((ret - m) ** 3) / pow(avg((ret - m) ** 2), 1.5) as skew, avg((ret - m) ** 4) / pow(avg((ret - m) ** 2), 2) as kurt from c group by 1)"""


@query("portfolio n:i skew:5 kurt:4 z:5", _MOM + ", out as (select *, sharpe * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from mo)")
def eval2_psr_argument(spark: S, sf: str) -> D:
    return ev.psr_z(ev.moments(returns(spark, sf), ["portfolio"]))


@query("portfolio benchmark:6 psr:5 z:5", _MOM + f""", tri as (select symbol, close / lag(close) {W} - 1 as ret from bars), ts as (select symbol, avg(ret) / stddev_samp(ret) as sharpe from tri group by 1), bm as (select stddev_samp(sharpe) * {luck_sql('50')} as benchmark from ts where sharpe is not null),
zz as (select *, (sharpe - benchmark) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) as z from mo, bm), out as (select *, {cdf_sql('z')} as psr from zz)""")
def eval4_deflated_sharpe(spark: S, sf: str) -> D:
    r = price_bars(spark, sf).withColumn("ret", change(F.col("close")))
    trials = ev.periodic_sharpe(r, ["symbol"])
    return ev.deflated_sharpe(returns(spark, sf), trials, ["portfolio"], declared=50)


@query("portfolio calmar_known calmar:5 max_drawdown:5", METRIC_SQL + ", " + metrics_sql("dd") + f", out as (select *, calmar is not null as calmar_known from ({_LOGGED_SQL}))")
def eval6_calmar(spark: S, sf: str) -> D:
    return with_logs(pf.metrics(accounts(spark, sf), 1.0), *LOGGED).withColumn("calmar_known", F.col("calmar").isNotNull())


STRAT_SQL = f"""r0 as (select symbol as strategy, ts, close / lag(close) {W} - 1 as ret from bars),
days as (select ts, row_number() over (order by ts) - 1 as pos from (select ts from r0 where ret is not null group by 1 having count(*) = (select count(distinct symbol) from bars))),
rr as (select strategy, pos, ret from r0 join days using (ts))"""


def strategies(spark: S, sf: str) -> D:
    """Returns of all symbols on the days that every one has."""
    r = price_bars(spark, sf).withColumn("ret", change(F.col("close")))
    every = r.select("symbol").distinct().count()
    days = r.where("ret is not null").groupBy("ts").count().where(F.col("count") == every).select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("pos"))
    return r.join(days, "ts").select(F.col("symbol").alias("strategy"), "pos", "ret")


PBO_SQL = STRAT_SQL + """, sz as (select (max(pos) + 1) // 10 as size from rr), ps as (select strategy, pos // size as slice, ret from rr, sz where pos < size * 10),
masks as (select m from range(1024) t(m) where bit_count(m) = 5),
sc as (select m, strategy, avg(ret) filter (m >> slice & 1 = 1) / stddev_samp(ret) filter (m >> slice & 1 = 1) as inside, avg(ret) filter (m >> slice & 1 = 0) / stddev_samp(ret) filter (m >> slice & 1 = 0) as outside from ps, masks group by 1, 2),
rk as (select *, row_number() over (partition by m order by outside, strategy) as rank, row_number() over (partition by m order by inside desc, strategy) as top from sc)"""


@query("pbo:6 splits:i", PBO_SQL + ", out as (select avg(cast(rank / ((select count(distinct strategy) from sc) + 1) < 0.5 as int)) as pbo, count(*) as splits from rk where top = 1)")
def eval7_overfitting(spark: S, sf: str) -> D:
    return ev.backtest_overfitting(strategies(spark, sf))


@query("strategy n:i mean_inside:6 mean_outside:6 times_best:i sharpe:6 psr:6 dsr:6 pbo:6", PBO_SQL + f""", {deflated_sql('sd', 'rr', 'strategy', '')},
pb as (select avg(cast(rank / ((select count(distinct strategy) from sc) + 1) < 0.5 as int)) as pbo from rk where top = 1),
ta as (select strategy, count(*) as n, avg(inside) as mean_inside, avg(outside) as mean_outside, count(*) filter (top = 1) as times_best from rk group by 1),
out as (select ta.*, sharpe, psr, dsr, pbo from ta join (select strategy, sharpe, psr, dsr from sd_df) using (strategy), pb)""")
def eval16_strategy_table(spark: S, sf: str) -> D:
    """Every strategy with its own figures, its deflation by all of them, and the overfitting of the choice among them."""
    rows = strategies(spark, sf)
    s = ev.split_scores(rows, 10)
    table = s.groupBy("strategy").agg(F.count("*").alias("n"), F.avg("inside").alias("mean_inside"), F.avg("outside").alias("mean_outside"), F.count_if("best").alias("times_best"))
    stats = ev.moments(rows, ["strategy"])
    judged = ev.deflate(stats, stats, []).select("strategy", "sharpe", "psr", "dsr")
    pbo = ev.backtest_overfitting(rows).select("pbo", F.lit(1).alias("_k"))
    return table.join(judged, "strategy").withColumn("_k", F.lit(1)).join(F.broadcast(pbo), "_k")


_GRID = "grid as (select row_number() over (order by a, b, c) - 1 as trial, f, s, w from (values (0, 5), (1, 10), (2, 20)) x(a, f), (values (0, 30), (1, 50), (2, 60)) y(b, s), (values (0, 0.02), (1, 0.04)) z(c, w))"


def grid(spark: S) -> D:
    return ev.expand_grid(spark, {"f": [5, 10, 20], "s": [30, 50, 60], "w": [0.02, 0.04]})


@query("trial:i f:i s:i w:4 bars:i", _GRID + ", out as (select trial, f, s, w, (select count(*) from bars) as bars from grid)")
def eval8_grid(spark: S, sf: str) -> D:
    n = price_bars(spark, sf).agg(F.count("*").alias("bars")).withColumn("_k", F.lit(1))
    return grid(spark).withColumn("_k", F.lit(1)).join(n, "_k")


@query("trial:i segment nation:i", "s as (select distinct c_mktsegment as segment from customer), n as (select distinct c_nationkey as nation from customer), out as (select row_number() over (order by segment, nation) - 1 as trial, segment, nation from s cross join n)", "")
def eval8_grid_of_values(spark: S, sf: str) -> D:
    return ev.grid_of_values(read(spark, sf, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation")), ["segment", "nation"])


_SWEEP = "avs as (select symbol, ts, close, " + ", ".join(f"{full('avg', 'close', n)} as a{n}" for n in (5, 10, 20, 30, 50, 60)) + f""", lead(close) {W} / close - 1 as fwd from bars), {_GRID},
tr as (select trial, ts, avg(sign(case f when 5 then a5 when 10 then a10 else a20 end - case s when 30 then a30 when 50 then a50 else a60 end) * w * fwd) as ret from avs, grid group by 1, 2),
st as (select trial, avg(ret) / stddev_samp(ret) as sharpe from tr group by 1)"""


def sweep_returns(spark: S, sf: str) -> D:
    """``(trial, ts, ret)``: every trial on every bar; the trial is one more key."""
    from barloom.functions.windows import rolling

    c = F.col("close")
    means = {n: rolling(F.avg, c, n) for n in (5, 10, 20, 30, 50, 60)}
    b = price_bars(spark, sf).withColumns({f"a{n}": m for n, m in means.items()}).withColumn("fwd", F.lead("close").over(ordered("symbol")) / c - 1)
    trials = F.from_json(F.lit(str([[i, f, s, int(100 * w)] for i, (f, s, w) in enumerate((f, s, w) for f in (5, 10, 20) for s in (30, 50, 60) for w in (0.02, 0.04))])), "array<array<int>>")
    rows = b.withColumn("t", F.explode(trials))
    pick = lambda i, ns: F.coalesce(*(F.when(F.col("t")[i] == n, F.col(f"a{n}")) for n in ns))
    pos = F.signum(pick(1, (5, 10, 20)) - pick(2, (30, 50, 60))) * F.col("t")[3] / 100
    return rows.groupBy(F.col("t")[0].alias("trial"), "ts").agg(F.avg(pos * F.col("fwd")).alias("ret"))


def sweep(spark: S, sf: str) -> D:
    return ev.periodic_sharpe(sweep_returns(spark, sf), ["trial"])


@query("trial:i sharpe:6", _SWEEP + ", out as (select * from st)")
def eval17_sweep(spark: S, sf: str) -> D:
    return sweep(spark, sf)


@query("best:6 n_valid:i mean:6 std:6 sr_null:6 psr:6 dsr:6", _SWEEP + ", " + deflated_sql("sw", "tr", "trial", "") + ", out as (select sharpe as best, trials as n_valid, mean, std, sr_null, psr, dsr from sw_df where place = 1)")
def eval9_sweep_summary(spark: S, sf: str) -> D:
    """The best trial of the sweep, deflated by all trials; trials that differ by size alone tie."""
    return ev.best_deflated(sweep_returns(spark, sf), "trial", [])


_SEED = f"sr as (select substr(symbol, 1, 7) as member, symbol as seed, close / lag(close) {W} - 1 as ret from bars), ss as (select member, seed, avg(ret) / stddev_samp(ret) as sharpe from sr group by 1, 2 having count(ret) > 2)"


def seeds(spark: S, sf: str) -> D:
    r = price_bars(spark, sf).select(F.substring("symbol", 1, 7).alias("member"), F.col("symbol").alias("seed"), change(F.col("close")).alias("ret"))
    return ev.periodic_sharpe(r, ["member", "seed"]).where("n > 2")


@query("member seed n_valid:i mean:6 std:6 best:6 sr_null:6 psr:6 dsr:6", _SEED + ", " + deflated_sql("sd", "sr", "seed", "member") + ", out as (select member, seed, trials as n_valid, mean, std, sharpe as best, sr_null, psr, dsr from sd_df where place = 1)")
def eval10_seed_summary(spark: S, sf: str) -> D:
    """Each member's seeds and its best one, deflated by all of them."""
    r = price_bars(spark, sf).select(F.substring("symbol", 1, 7).alias("member"), F.col("symbol").alias("seed"), change(F.col("close")).alias("ret"))
    return ev.best_deflated(r, "seed", ["member"])


@query("member seed", _SEED + ", m as (select *, abs(sharpe - avg(sharpe) over (partition by member)) as d from ss), out as (select member, arg_min(seed, (d, seed)) as seed from m group by 1)")
def eval18_representative(spark: S, sf: str) -> D:
    return ev.nearest_to_mean(seeds(spark, sf))


@query("portfolio n_obs:i total_cost:12 avg_gross:6 max_gross:6 net_sharpe:6 gross_sharpe:6 net_total:5 gross_total:5", TARGET_SQL + f""", out as (select portfolio, {signed_log_sql('product(1 + net_return) - 1')} as net_total, {signed_log_sql('product(1 + net_return + cost) - 1')} as gross_total, count(*) as n_obs, sum(cost) as total_cost, avg(gross) as avg_gross, max(gross) as max_gross,
  avg(net_return) / stddev_samp(net_return) * sqrt(252) as net_sharpe, avg(net_return + cost) / stddev_samp(net_return + cost) * sqrt(252) as gross_sharpe from acct group by 1)""")
def eval11_trial_metrics(spark: S, sf: str) -> D:
    return with_logs(ev.trial_metrics(accounts(spark, sf)), "net_total", "gross_total")


_ALONE = BASELINE_SQL + """, al as (select 'hold/' || symbol as portfolio, symbol, ts, open, hold * 1.0 as target from base union all select 'tsmom/' || symbol, symbol, ts, open, tsmom from base union all select 'ma_cross/' || symbol, symbol, ts, open, ma_cross from base),
ah as (select *, coalesce(lag(target) over (partition by portfolio order by ts), 0) as held from al), am as (select *, coalesce(lead(open) over w / open - 1, 0) as move, held - coalesce(lag(held) over w, 0) as trade from ah window w as (partition by portfolio order by ts)),
ac as (select portfolio, ts, held * move as gross_ret, abs(trade) * 1.5 / 1e4 + trade * trade * 5 / 1e4 + greatest(-held, 0) * 50 / 1e4 / 252 as cost from am), ar as (select portfolio, ts, gross_ret, gross_ret - cost as ret from ac),
gs as (select portfolio, count(*) as n_obs, avg(gross_ret) / stddev_samp(gross_ret) as gross_sharpe from ar group by 1)"""


@query("portfolio n_obs:i tier", _ALONE + ", " + deflated_sql("tp", "ar", "portfolio", "") + """, out as (select portfolio, n_obs, case when n_obs < 80 then 'no_claim' when sharpe > 0 and dsr >= 0.95 then 'robust' when sharpe > 0 then 'net' when gross_sharpe > 0 then 'gross' else 'mechanics' end as tier from gs join (select portfolio, sharpe, dsr from tp_df) using (portfolio))""")
def eval12_claim_tiers(spark: S, sf: str) -> D:
    """Tiers of every baseline on every symbol, net of costs and deflated by all of them."""
    b = baselines(spark, sf)
    t = b.select("symbol", "ts", "open", F.inline(F.array(*(F.struct(F.concat_ws("/", F.lit(k), "symbol").alias("portfolio"), F.col(k).cast("double").alias("target")) for k in KINDS))))
    a = pf.account(pf.fills(t), pf.Costs())
    stats = ev.moments(a.withColumn("ret", F.col("net_return")), ["portfolio"])
    judged = ev.deflate(stats, stats, []).select("portfolio", F.col("sharpe").alias("net_sharpe"), "dsr")
    gross = a.groupBy("portfolio").agg(F.count("*").alias("n_obs"), (F.avg("gross_return") / F.stddev_samp("gross_return")).alias("gross_sharpe"))
    return ev.claim_tier(gross.join(judged, "portfolio"), least=80)


@query("k:i config_hash", """out as (select p_partkey as k, substr(sha256('{"brand":"' || p_brand || '","size":' || p_size || '}'), 1, 12) as config_hash from part)""", "")
def eval13_config_hash(spark: S, sf: str) -> D:
    c = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return ev.config_hash(c, ["size", "brand"])


# conformal ---------------------------------------------------------------------

_RESID = IDEAL_SQL + ", " + MEMBER_SQL + ", res as (select symbol, ts, position, ideal, position - ideal as residual from blended join ideals using (symbol, ts))"


def residuals(spark: S, sf: str) -> D:
    j = blended(spark, sf).join(ideals(spark, sf).select("symbol", "ts", "ideal"), ["symbol", "ts"])
    return j.withColumn("residual", F.col("position") - F.col("ideal"))


_Q = _RESID + """, nn as (select symbol, count(*) as n from res where residual is not null group by 1),
qs as (select symbol, n, quantile_cont(abs(residual), least(1, 0.9 * (n + 1) / n)) as q from res join nn using (symbol) where residual is not null group by 1, 2)""" .replace("quantile_cont(abs(residual), least(1, 0.9 * (n + 1) / n))", "list_sort(list(abs(residual)))[cast(floor(least(1, 0.9 * (n + 1) / n) * (n - 1)) as bigint) + 1] + (least(1, 0.9 * (n + 1) / n) * (n - 1) - floor(least(1, 0.9 * (n + 1) / n) * (n - 1))) * (list_sort(list(abs(residual)))[cast(ceil(least(1, 0.9 * (n + 1) / n) * (n - 1)) as bigint) + 1] - list_sort(list(abs(residual)))[cast(floor(least(1, 0.9 * (n + 1) / n) * (n - 1)) as bigint) + 1])")


@query("symbol n:i q:7", _Q + ", out as (select symbol, n, case when n >= 5 then q end as q from qs)")
def cnf1_residual_quantile(spark: S, sf: str) -> D:
    return conformal.residual_quantile(residuals(spark, sf), 0.1)


_GROW = _RESID + """, known as (select symbol, ts, residual, count(residual) over w as n, list_sort(list_filter(list(abs(residual)) over w, lambda x: x is not null)) as a from res window w as (partition by symbol order by ts rows between unbounded preceding and current row)),
placed as (select *, least(1, 0.9 * (n + 1) / n) * (n - 1) as p from known), grown as (select symbol, ts, case when n >= 5 then a[cast(floor(p) as bigint) + 1] + (p - floor(p)) * (a[cast(ceil(p) as bigint) + 1] - a[cast(floor(p) as bigint) + 1]) end as q from placed)"""


@query("symbol ts:s q:7", _GROW + ", out as (select * from grown)")
def cnf1_expanding_quantile(spark: S, sf: str) -> D:
    """The conformal quantile as it was known at every bar."""
    return conformal.expanding_quantile(residuals(spark, sf), 0.1)


_BANDS = _RESID + ", bd as (select *, greatest(-1, least(1, position - 0.6)) as low, greatest(-1, least(1, position + 0.6)) as high from res)"


def banded(spark: S, sf: str) -> D:
    return conformal.bands(residuals(spark, sf).withColumn("q", F.lit(0.6)), 1.0)


@query(f"{DAY} low:6 high:6", _BANDS + ", out as (select * from bd)")
def cnf2_bands(spark: S, sf: str) -> D:
    return banded(spark, sf)


_MISS = _BANDS + f", mi as (select *, lead(ideal, 5) {W} as later from bd), ms as (select *, case when later is not null then cast(later < low or later > high as int) end as miss from mi)"


@query("symbol n:i coverage:6", _MISS + ", out as (select symbol, count(*) as n, 1 - avg(miss) as coverage from ms where miss is not null group by 1)")
def cnf5_coverage(spark: S, sf: str) -> D:
    return conformal.coverage(conformal.realized(banded(spark, sf), 5))


ALPHA_SQL = (_MISS + """, num as (select symbol, ts, miss, row_number() over (partition by symbol order by ts) as rn from ms),
scan as (select symbol, ts, miss, rn, case when miss is null then 0.1::double else least(0.9999, greatest(0.0001, 0.1::double + 0.02 * (0.1 - miss))) end as alpha from num where rn = 1
  union all select n.symbol, n.ts, n.miss, n.rn, case when n.miss is null then s.alpha else least(0.9999, greatest(0.0001, s.alpha + 0.02 * (0.1 - n.miss))) end from scan s join num n on n.symbol = s.symbol and n.rn = s.rn + 1), out as (select * from scan)""",)


@query(f"{DAY} miss:i alpha:8", *ALPHA_SQL, recursive=True)
def cnf3_adaptive_alpha(spark: S, sf: str) -> D:
    m = conformal.realized(banded(spark, sf), 5).select("symbol", "ts", "miss")
    return conformal.adaptive_alpha(m)
