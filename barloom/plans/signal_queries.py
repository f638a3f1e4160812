"""Queries over pairs, factors and news."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.functions.windows import change, ordered
from barloom.operators import factors as fc, members as mb, pairs as pr, sentiment as sn, universe, walkforward as wf
from barloom.plans.feature_queries import W
from barloom.plans.normal_sql import cdf_sql
from barloom.plans.panels import EVENT_BARS_SQL, NEWS_SQL, event_bars, price_bars, publications, read, stories
from barloom.plans.registry import query

S, D = SparkSession, DataFrame
PAIR = "fold:i y x"

#: Hourly bars of five event types: few symbols, long common series.
PAIR_SQL = EVENT_BARS_SQL + """, px as (select 0 as fold, ts, symbol, case when close > 0 then ln(close) end as l from ebars),
pairs as (select a.fold, a.symbol as y, b.symbol as x, a.ts, a.l as ly, b.l as lx from px a join px b on a.fold = b.fold and a.ts = b.ts and a.symbol < b.symbol where a.l is not null and b.l is not null),
rn as (select *, row_number() over w as rn, count(*) over (partition by fold, y, x) as n, ly - lag(ly) over w as dy, lx - lag(lx) over w as dx from pairs window w as (partition by fold, y, x order by ts)),
fit as (select fold, y, x, count(*) as n, regr_intercept(ly, lx) as alpha, regr_slope(ly, lx) as beta, corr(dy, dx) as return_corr,
  regr_slope(ly, lx) filter (rn <= floor(n / 2)) as b1, regr_slope(ly, lx) filter (rn > floor(n / 2)) as b2 from rn group by 1, 2, 3),
sp as (select p.*, alpha, beta, ly - alpha - beta * lx as s from pairs p join fit using (fold, y, x)),
st as (select *, lag(s) over w as b, s - lag(s) over w as d from sp window w as (partition by fold, y, x order by ts)),
te as (select fold, y, x, regr_slope(d, b) as slope, sum(b * d) as bd, sum(b * b) filter (d is not null) as bb, sum(d * d) as dd, count(d) as m, stddev_samp(s) as spread_std from st group by 1, 2, 3),
stats as (select fold, y, x, n, alpha, beta, return_corr, case when slope >= -1e-12 then 'inf'::double else greatest(1, -ln(2) / slope) end as half_life, abs(b2 - b1) / abs(beta) as beta_drift,
  (bd / bb) / sqrt((dd - bd / bb * bd) / (m - 1) / bb) as stat, spread_std from fit join te using (fold, y, x))"""


def pair_prices(spark: S, sf: str) -> D:
    return event_bars(spark, sf).withColumn("fold", F.lit(0))


def stats(spark: S, sf: str) -> D:
    return pr.pair_table(pair_prices(spark, sf))


@query(f"{PAIR} n:i", PAIR_SQL + ", out as (select fold, y, x, count(*) as n from pairs group by 1, 2, 3)", "")
def join3_pairs(spark: S, sf: str) -> D:
    return stats(spark, sf)


@query(f"{PAIR} n:i alpha:6 beta:6", PAIR_SQL + ", out as (select * from stats)", "")
def pair1_hedge_ratios(spark: S, sf: str) -> D:
    return stats(spark, sf)


@query(f"{PAIR} half_life:6", PAIR_SQL + ", out as (select * from stats)", "")
def pair2_half_life(spark: S, sf: str) -> D:
    return stats(spark, sf)


@query(f"{PAIR} beta_drift:5", PAIR_SQL + ", out as (select * from stats)", "")
def pair3_beta_drift(spark: S, sf: str) -> D:
    return stats(spark, sf)


@query(f"{PAIR} return_corr:6", PAIR_SQL + ", out as (select * from stats)", "")
def pair4_return_corr(spark: S, sf: str) -> D:
    return stats(spark, sf)


@query(f"{PAIR} stat:4 lag:i adf_stat:4 adf_lag:i")
def pair6_aic_lags(spark: S, sf: str) -> D:
    return pr.aic_table(pair_prices(spark, sf))


#: Random walks: the running sum of each type's centred log prices, so that some pairs revert and others do not.
WALK_SQL = PAIR_SQL.replace("px as (select 0 as fold, ts, symbol, case when close > 0 then ln(close) end as l from ebars)", """lg as (select symbol, ts, ln(close) - avg(ln(close)) over (partition by symbol) as d from ebars where close > 0),
px as (select 0 as fold, ts, symbol, 0.05 * sum(d) over (partition by symbol order by ts rows between unbounded preceding and current row) as l from lg)""")
_BOTH = WALK_SQL.replace("a.symbol < b.symbol", "a.symbol <> b.symbol") + """, ad as (select fold, y, x, regr_slope(d, b) as sl, regr_sxx(d, b) as xx, regr_sxy(d, b) as xy, regr_syy(d, b) as yy, count(b) as m from st where b is not null group by 1, 2, 3),
adf as (select fold, y, x, sl / sqrt((yy - sl * xy) / (m - 2) / xx) as adf_stat from ad),
zz as (select stats.*, adf_stat, case when stat <= -2.62 then 2.92 + 1.5012 * stat + 0.039796 * stat ** 2 else 2.1945 + 0.64695 * stat - 0.29198 * stat ** 2 - 0.042377 * stat ** 3 end as z,
  case when adf_stat <= -1.61 then 2.1659 + 1.4412 * adf_stat + 0.038269 * adf_stat ** 2 else 1.7339 + 0.93202 * adf_stat - 0.12745 * adf_stat ** 2 - 0.010368 * adf_stat ** 3 end as az from stats join adf using (fold, y, x)),
pv as (select *, case when stat < -18.86 then 0 when stat > 0.92 then 1 else """ + cdf_sql("z") + """ end as p, case when adf_stat < -18.83 then 0 when adf_stat > 2.74 then 1 else """ + cdf_sql("az") + """ end as adf_p from zz),
od as (select *, row_number() over (partition by fold, least(y, x), greatest(y, x) order by p, y) as o from pv), ps as (select * exclude (o) from od where o = 1)"""
_BH = _BOTH.replace("as adf_p from zz)", "as adf_p from zz where true)").replace("order by p, y) as o from pv)", "order by p, y) as o from (select * replace (case when n >= 100 and abs(beta) >= 0.01 then p end as p) from pv))") + """,
rk as (select *, row_number() over (partition by fold, p is null order by p) as k, count(p) over (partition by fold) as m from ps),
bh as (select *, p <= max(case when p <= 0.5 * k / m then p end) over (partition by fold) as pass from rk), bhp as (select *, coalesce(pass, false) as passes from bh)"""
SELECTION = pr.Selection(least_rows=100, max_p=0.3, max_adf_p=0.25, fdr=0.5, min_corr=0.005, max_half_life=60.0, max_drift=5.0, min_beta=0.01, most=2)


def walk_prices(spark: S, sf: str) -> D:
    by = Window.partitionBy("symbol")
    logs = event_bars(spark, sf).where("close > 0").withColumn("d", F.log("close") - F.avg(F.log("close")).over(by))
    path = F.sum("d").over(ordered("symbol").rowsBetween(Window.unboundedPreceding, 0))
    return logs.select(F.lit(0).alias("fold"), "ts", "symbol", F.exp(0.05 * path).alias("close"), F.exp(0.05 * path).alias("open"))


def walk_stats(spark: S, sf: str) -> D:
    return pr.pair_table(walk_prices(spark, sf), both_orders=True)


def selected(spark: S, sf: str) -> D:
    return pr.choose_pairs(walk_stats(spark, sf), SELECTION)


@query(f"{PAIR} stat:5 adf_stat:5 p:7 adf_p:7", _BOTH + ", out as (select * from ps)", "")
def pair5_engle_granger(spark: S, sf: str) -> D:
    """Each pair in the order with the lower p-value."""
    return pr.best_order(pr.with_p_values(walk_stats(spark, sf)))


@query(f"{PAIR} p:7 adf_p:7 passes", _BH + ", out as (select * from bhp)", "")
def pair7_false_discovery(spark: S, sf: str) -> D:
    return selected(spark, sf)


_GATE = _BH + """, gt as (select *, case when stat is null or n < 100 or abs(beta) < 0.01 then 'candidate_unavailable' when not passes then 'fdr' when p > 0.3 then 'coint_pvalue' when adf_p > 0.25 then 'adf_pvalue'
  when abs(return_corr) < 0.005 then 'return_corr' when half_life > 60 or half_life < 1 then 'half_life' when beta_drift > 5 then 'beta_drift' end as reason from bhp),
rs as (select *, case when reason is null then row_number() over (partition by fold, reason is null order by p, half_life, beta_drift, y, x) end as rank from gt),
sel as (select * replace (case when rank > 2 then 'max_pairs' else reason end as reason) from rs)"""


@query(f"{PAIR} reason", _GATE + ", out as (select * from gt)", "")
def pair8_gates(spark: S, sf: str) -> D:
    return pr.rejection_reason(pr.tested_pairs(walk_stats(spark, sf), SELECTION), SELECTION)


@query(f"{PAIR} rank:i reason", _GATE + ", out as (select * from sel)", "")
def win23_top_pairs(spark: S, sf: str) -> D:
    return selected(spark, sf)


@query("fold:i reason n:i", _GATE + ", out as (select 0 as fold, r as reason, (select count(*) from sel where reason = r) as n from (values ('candidate_unavailable'), ('fdr'), ('coint_pvalue'), ('adf_pvalue'), ('return_corr'), ('half_life'), ('beta_drift'), ('max_pairs')) v(r))", "")
def pair9_rejections(spark: S, sf: str) -> D:
    return pr.rejection_counts(selected(spark, sf))


@query(f"{PAIR} return_corr:6", PAIR_SQL + ", out as (select * from stats where abs(return_corr) >= 0.01)", "")
def pair10_prior(spark: S, sf: str) -> D:
    return stats(spark, sf).where("abs(return_corr) >= 0.01")


@query(f"{PAIR} evidence:6", PAIR_SQL + """, e0 as (select *, abs(stat) as s, avg(abs(stat)) over (partition by fold) as m, count(*) over (partition by fold) as k from stats),
e1 as (select *, sum((s - m) * (s - m)) over (partition by fold) as ss from e0), e2 as (select *, m + case when k < 3 or ss <= 0 then 1 else greatest(0, 1 - (k - 2) / ss) end * (s - m) as w from e1),
out as (select *, w / max(w) over (partition by fold) as evidence from e2)""", "")
def pair11_evidence(spark: S, sf: str) -> D:
    return pr.evidence_weights(stats(spark, sf))


_ZS = PAIR_SQL + """, roll as (select *, count(s) over w as c, avg(s) over w as m, stddev_samp(s) over w as sd from sp window w as (partition by fold, y, x order by ts rows between 59 preceding and current row)),
zs as (select *, case when c >= 40 and sd > 1e-12 then (s - m) / sd end as z from roll)"""


def scores(spark: S, sf: str) -> D:
    return pr.spread_scores(pr.rows_of_pairs(pair_prices(spark, sf), stats(spark, sf)), stats(spark, sf))


@query(f"{PAIR} ts:i z:5", _ZS + ", out as (select * from zs)", "")
def win21_spread_scores(spark: S, sf: str) -> D:
    return scores(spark, sf)


_STATE = _ZS + """, num as (select fold, y, x, ts, beta, round(z, 6) as z, row_number() over (partition by fold, y, x order by ts) as rn from zs),
scan as (select fold, y, x, ts, beta, rn, case when z >= 1.2 then -1 when z <= -1.2 then 1 else 0 end as state from num where rn = 1
  union all select n.fold, n.y, n.x, n.ts, n.beta, n.rn, case when n.z is null then 0 when s.state <> 0 then case when abs(n.z) >= 2.2 or abs(n.z) <= 0.5 then 0 else s.state end when n.z >= 1.2 then -1 when n.z <= -1.2 then 1 else 0 end
  from scan s join num n on n.fold = s.fold and n.y = s.y and n.x = s.x and n.rn = s.rn + 1)"""


def states(spark: S, sf: str) -> D:
    z = scores(spark, sf).select("fold", "y", "x", "ts", "beta", F.round("z", 6).alias("z"))
    return pr.pair_positions(z, 1.2, 0.5, 2.2)


@query(f"{PAIR} ts:i state:i", _STATE + ", out as (select * from scan)", "", recursive=True)
def pair12_states(spark: S, sf: str) -> D:
    return states(spark, sf)


@query(f"{PAIR} ts:i symbol weight:6", _STATE + ", out as (select fold, y, x, ts, y as symbol, state * 0.5 / (1 + abs(beta)) as weight from scan union all select fold, y, x, ts, x, -beta * state * 0.5 / (1 + abs(beta)) from scan)", "", recursive=True)
def pair13_legs(spark: S, sf: str) -> D:
    return pr.pair_legs(states(spark, sf), 0.5)


_LATER = WALK_SQL + """, mid as (select quantile_disc(ts, 0.5) as t from px), f1 as (select fold, y, x, regr_intercept(ly, lx) as alpha, regr_slope(ly, lx) as beta from pairs, mid where ts <= t group by 1, 2, 3),
s1 as (select fold, y, x, ts, ly, lx, ly - alpha - beta * lx as s from pairs join f1 using (fold, y, x), mid where ts > t),
s2 as (select *, lag(s) over w as b, s - lag(s) over w as d, ly - lag(ly) over w as dy, lx - lag(lx) over w as dx from s1 window w as (partition by fold, y, x order by ts)),
s3 as (select fold, y, x, count(*) as n, corr(dy, dx) as return_corr, stddev_samp(s) as spread_std, regr_slope(d, b) as sl, regr_sxx(d, b) as xx, regr_sxy(d, b) as xy, regr_syy(d, b) as yy, count(b) as m from s2 group by 1, 2, 3),
out as (select fold, y, x, n, return_corr, spread_std, case when sl >= -1e-12 then 'inf'::double else greatest(1, -ln(2) / sl) end as half_life, sl / sqrt((yy - sl * xy) / (m - 2) / xx) as adf_stat from s3)"""


@query(f"{PAIR} n:i return_corr:6 spread_std:6 half_life:4 adf_stat:5", _LATER, "")
def pair14_diagnostics(spark: S, sf: str) -> D:
    """Pairs fitted on the first half of the hours and judged on the second."""
    prices = walk_prices(spark, sf)
    middle = prices.agg(F.expr("percentile_disc(0.5) within group (order by ts)").alias("t")).first()["t"]
    fitted = pr.pair_table(prices.where(F.col("ts") <= middle))
    return pr.pair_diagnostics(pr.rows_of_pairs(prices.where(F.col("ts") > middle), fitted), fitted)


_CHOSEN = "chosen as (select distinct p_size % 6 as fold, p_brand as y, substr(p_type, 1, 5) as x from part)"


@query("fold:i added:i dropped:i turnover:6", _CHOSEN + """, f as (select a.fold is not null as now, b.fold is not null as past, coalesce(a.fold, b.fold + 1) as fold from chosen a full join chosen b on b.fold + 1 = a.fold and a.y = b.y and a.x = b.x),
out as (select fold, count(*) filter (not past) as added, count(*) filter (not now) as dropped, count(*) filter (not past or not now) / count(*) as turnover from f where fold <= (select max(fold) from chosen) group by 1)""", "")
def pair15_turnover(spark: S, sf: str) -> D:
    c = read(spark, sf, "part").select((F.col("p_size") % 6).alias("fold"), F.col("p_brand").alias("y"), F.substring("p_type", 1, 5).alias("x")).distinct()
    return pr.fold_turnover(c)


@query("symbol ts:s residual:6", f"""r as (select symbol, ts, close, close / lag(close) {W} - 1 as r from bars), e as (select *, coalesce(r - avg(r) over (partition by ts), 0) as e from r),
out as (select symbol, ts, ln(exp(sum(e) over (partition by symbol order by ts rows between unbounded preceding and current row))) as residual from e)""")
def pair16_residual_prices(spark: S, sf: str) -> D:
    return pr.residual_prices(price_bars(spark, sf)).withColumn("residual", F.log("residual"))


# factors -----------------------------------------------------------------------

RET_SQL = f"rets as (select symbol, ts, close / lag(close) {W} - 1 as ret from bars), cal as (select ts, row_number() over (order by ts) as rn from (select distinct ts from bars)), reb as (select ts as rebalance, rn as hi from cal where rn >= 60 and (rn - 60) % 5 = 0), win as (select rebalance, cal.ts from reb join cal on rn > hi - 60 and rn <= hi)"


def rets(spark: S, sf: str) -> D:
    return price_bars(spark, sf).withColumn("ret", change(F.col("close"))).select("symbol", "ts", "ret")


def windows(spark: S, sf: str) -> D:
    return fc.rebalance_days(price_bars(spark, sf).select("ts").distinct(), 60, 5)


@query("rebalance:s a b corr:6", RET_SQL + """, w as (select rebalance, symbol, ts, ret from win join rets using (ts) where ret is not null),
out as (select p.rebalance, p.symbol as a, q.symbol as b, corr(p.ret, q.ret) as corr from w p join w q on p.rebalance = q.rebalance and p.ts = q.ts and p.symbol < q.symbol group by 1, 2, 3)""")
def fac1_correlations(spark: S, sf: str) -> D:
    return fc.correlations(rets(spark, sf), windows(spark, sf)).withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))


@query("rebalance:s factor:i symbol weight:5 explained:5")
def fac2_eigenportfolios(spark: S, sf: str) -> D:
    return fc.eigenportfolios(rets(spark, sf), windows(spark, sf), 3)


_ONE = RET_SQL + """, mk as (select ts, avg(ret) as f from rets group by 1), ro as (select rebalance, r.symbol, r.ts, ret, f from win join rets r using (ts) join mk using (ts) where ret is not null),
cf as (select rebalance, symbol, regr_slope(ret, f) as beta, regr_intercept(ret, f) as alpha, count(*) as n from ro group by 1, 2),
re as (select ro.*, beta, alpha, ret - alpha - beta * f as residual from ro join cf using (rebalance, symbol) where n >= 20)"""


def one_factor(spark: S, sf: str) -> D:
    r = rets(spark, sf)
    market = r.groupBy("ts").agg(F.avg("ret").alias("f"))
    inside = fc.windowed(r, windows(spark, sf)).join(market, "ts")
    enough = F.count("*").over(Window.partitionBy("rebalance", "symbol"))
    return fc.one_factor_residuals(inside.withColumn("n", enough).where("n >= 20"), ["rebalance", "symbol"])


@query("rebalance:s symbol ts:s alpha:6 beta:6 residual:6", _ONE + ", out as (select * from re)")
def fac3_one_factor(spark: S, sf: str) -> D:
    return one_factor(spark, sf)


@query("symbol ts:s factor f:6", RET_SQL + ", out as (select a.symbol, a.ts, b.symbol as factor, b.ret as f from rets a join rets b using (ts) where b.symbol in ('Brand#11', 'Brand#12') and a.symbol not in ('Brand#11', 'Brand#12'))")
def fac4_fund_factors(spark: S, sf: str) -> D:
    r, funds = rets(spark, sf), F.col("symbol").isin("Brand#11", "Brand#12")
    return r.where(~funds).join(r.where(funds).select("ts", F.col("symbol").alias("factor"), F.col("ret").alias("f")), "ts")


_OU = _ONE + """, xs as (select rebalance, symbol, ts, sum(residual) over (partition by rebalance, symbol order by ts rows between unbounded preceding and current row) as x from re),
lg as (select *, lag(x) over (partition by rebalance, symbol order by ts) as b0 from xs), of as (select rebalance, symbol, regr_slope(x, b0) as b, regr_intercept(x, b0) as a, arg_max(x, ts) as x_end, regr_syy(x, b0) as yy, regr_sxy(x, b0) as xy, count(b0) as n from lg group by 1, 2),
ou as (select *, case when b > 0 and b < 1 then a / (1 - b) end as m, case when b > 0 and b < 1 then sqrt(greatest((yy - b * xy) / (n - 2), 0) / (1 - b * b)) end as sigma_eq, case when b > 0 and b < 1 then -ln(2) / ln(b) end as half_life from of),
oa as (select *, coalesce(b > 0 and b < 1 and sigma_eq > 1e-9, false) as valid from ou), al as (select rebalance, symbol, any_value(alpha) as alpha from re group by 1, 2)"""


def ou(spark: S, sf: str) -> D:
    left = one_factor(spark, sf)
    alpha = left.groupBy("rebalance", "symbol").agg(F.first("alpha").alias("alpha"))
    return fc.ou_fit(left, ["rebalance", "symbol"]).join(alpha, ["rebalance", "symbol"])


@query("rebalance:s symbol b:5 m:4 sigma_eq:5 half_life:4 x_end:5 valid", _OU + ", out as (select * from oa)")
def fac5_mean_reversion(spark: S, sf: str) -> D:
    return ou(spark, sf)


_SC = _OU + ", ss as (select rebalance as ts, symbol, half_life, valid, case when valid then (x_end - m - alpha / -ln(b)) / sigma_eq end as sscore from oa join al using (rebalance, symbol))"


def s_scores(spark: S, sf: str) -> D:
    return fc.s_score(ou(spark, sf), "alpha").withColumnRenamed("rebalance", "ts")


@query("ts:s symbol sscore:4", _SC + ", out as (select * from ss)")
def fac6_s_scores(spark: S, sf: str) -> D:
    return s_scores(spark, sf)


@query("ts:s symbol rebalance:s active valid sscore:4 half_life:4 tradeable")
def fac7_residual_panel(spark: S, sf: str) -> D:
    """Scores of every bar against two eigenportfolios, volume time on."""
    return fc.residual_panel(price_bars(spark, sf), fc.ResidualSpec(60, 40, 2, 5, 1.0, 1000.0, 30.0, volume_time=True)).scores


FUND = fc.ResidualSpec(60, 40, 1, 5, 1.0, 1000.0, 4.0, funds=("Brand#11",))
_FUND = f"""cal as (select ts, row_number() over (order by ts) - 1 as pos from (select distinct ts from bars)), grid as (select cal.pos, cal.ts, s.symbol, close, volume from cal cross join (select distinct symbol from bars) s left join bars b on b.ts = cal.ts and b.symbol = s.symbol),
pr as (select *, close / lag(close) over (partition by symbol order by pos) - 1 as ret from grid),
el as (select *, count(ret) over (partition by symbol order by pos rows between 59 preceding and current row) >= 60 and close >= 1 and count(close * volume) over w20 >= 20 and quantile_cont(close * volume, 0.5) over w20 >= 1000 and symbol <> 'Brand#11' as ok from pr window w20 as (partition by symbol order by pos rows between 19 preceding and current row)),
cand as (select pos, ts, symbol from el where ok and pos >= 100), fund as (select pos, coalesce(ret, 0) as f from pr where symbol = 'Brand#11'),
win as (select c.pos as aw, c.ts, c.symbol, p.pos, p.ret, f from cand c join pr p on p.symbol = c.symbol and p.pos > c.pos - 40 and p.pos <= c.pos join fund on fund.pos = p.pos),
fit as (select aw, ts, symbol, count(ret) = 40 as active, regr_slope(ret, f) as beta, regr_intercept(ret, f) as alpha from win group by 1, 2, 3),
xs as (select w.aw, w.symbol, w.pos, sum(ret - alpha - beta * f) over (partition by w.aw, w.symbol order by w.pos rows between unbounded preceding and current row) as x from win w join fit using (aw, symbol) where active),
lg as (select *, lag(x) over (partition by aw, symbol order by pos) as b0 from xs),
of as (select aw, symbol, regr_slope(x, b0) as b, regr_intercept(x, b0) as a, arg_max(x, pos) as x_end, regr_syy(x, b0) as yy, regr_sxy(x, b0) as xy, count(b0) as n from lg group by 1, 2),
ou as (select *, b > 0 and b < 1 as inside, case when b > 0 and b < 1 then sqrt(greatest(yy - b * xy, 0) / (n - 2) / (1 - b * b)) end as sg from of),
ss as (select fit.aw as pos, ts, symbol, active, coalesce(inside and sg > 1e-9, false) as valid, case when inside then -ln(2) / ln(b) end as half_life, case when inside and sg > 1e-9 then (x_end - a / (1 - b) - alpha / -ln(b)) / sg end as sscore from fit left join ou using (aw, symbol))"""


def fund_panel(spark: S, sf: str) -> fc.ResidualPanel:
    return fc.residual_panel(price_bars(spark, sf), FUND)


@query("ts:s symbol active valid sscore:3 half_life:3 tradeable", _FUND + ", out as (select *, valid and half_life <= 4 as tradeable from ss)")
def fac7_fund_panel(spark: S, sf: str) -> D:
    """Scores of every bar against one fund."""
    return fund_panel(spark, sf).scores


@query("evaluations:i invalid_rate:6 slow_rate:6 missing_rate:6", _FUND + ", out as (select count(*) filter (active) as evaluations, count(*) filter (active and not valid) / count(*) filter (active) as invalid_rate, count(*) filter (active and valid and half_life > 4) / count(*) filter (active) as slow_rate, count(*) filter (not active) / count(*) as missing_rate from ss)")
def fac8_health(spark: S, sf: str) -> D:
    return fc.signal_health(fund_panel(spark, sf).scores, 4.0)


_REV = EVENT_BARS_SQL + f""", zz as (select symbol, ts, round((close - avg(close) over w) / stddev_samp(close) over w, 6) as sscore, volume > 1 as ok, row_number() over (partition by symbol order by ts) as rn from ebars window w as (partition by symbol order by ts rows between 19 preceding and current row)),
scan as (select symbol, ts, rn, case when not ok or sscore is null then 0 when sscore < -1.25 then 1 when sscore > 1.25 then -1 else 0 end as state from zz where rn = 1
  union all select n.symbol, n.ts, n.rn, case when not n.ok or n.sscore is null then 0 when (s.state = 1 and not n.sscore > -0.5) or (s.state = -1 and not n.sscore < 0.75) then s.state when n.sscore < -1.25 then 1 when n.sscore > 1.25 then -1 else 0 end from scan s join zz n on n.symbol = s.symbol and n.rn = s.rn + 1)"""


@query("symbol ts:i state:i", _REV + ", out as (select * from scan)", "", recursive=True)
def fac9_reversion_states(spark: S, sf: str) -> D:
    return fc.reversion_positions(reversion_scores(spark, sf), ["symbol"])


def reversion_scores(spark: S, sf: str) -> D:
    w = ordered("symbol").rowsBetween(-19, 0)
    return event_bars(spark, sf).select("symbol", "ts", F.round((F.col("close") - F.avg("close").over(w)) / F.stddev_samp("close").over(w), 6).alias("sscore"), (F.col("volume") > 1).alias("ok"))


_BOOK = _SC + """, sd as (select ts, symbol, case when sscore < -0.5 then 1 when sscore > 0.5 then -1 else 0 end as state from ss), lo as (select distinct rebalance as ts, symbol, 0 as factor, beta from re),
po as (select ts, 0 as factor, symbol, 1.0 / count(*) over (partition by ts) as weight from ss), legs as (select ts, symbol, state * 0.02 as weight from sd where state <> 0),
ex as (select legs.ts, factor, sum(legs.weight * beta) as e from legs join lo using (ts, symbol) group by 1, 2), al2 as (select * from legs union all select ex.ts, po.symbol, -e * po.weight from ex join po using (ts, factor)),
out as (select ts, symbol, sum(weight) as weight from al2 group by 1, 2)"""


@query("ts:s symbol weight:7", _BOOK)
def fac10_residual_book(spark: S, sf: str) -> D:
    s = s_scores(spark, sf)
    state = s.select("ts", "symbol", F.when(F.col("sscore") < -0.5, 1).when(F.col("sscore") > 0.5, -1).otherwise(0).alias("state"))
    load = one_factor(spark, sf).select(F.col("rebalance").alias("ts"), "symbol", F.lit(0).alias("factor"), "beta").distinct()
    even = s.select("ts", F.lit(0).alias("factor"), "symbol", (1.0 / F.count("*").over(Window.partitionBy("ts"))).alias("weight"))
    return fc.residual_book(state, load, even, 0.02)


@query("ts:s symbol size:5 band:7", _SC + ", out as (select ts, symbol, coalesce(greatest(0, least(2, case when sscore is not null then (abs(sscore) - 0.5) / 0.5 end)) * (sscore is not null)::int, 0) as size, coalesce(case when half_life > 0 then 0.1 * sqrt(0.001 / (ln(2) / half_life)) end, 0) as band from ss)")
def fac11_conviction_and_band(spark: S, sf: str) -> D:
    return s_scores(spark, sf).withColumns({"size": fc.conviction(F.col("sscore"), 0.5, 2.0), "band": fc.cost_aware_band(F.col("half_life"), 0.001, 0.1)})


# news --------------------------------------------------------------------------


def _hits(words: tuple[str, ...]) -> str:
    return " + ".join(f"(contains(lower(title), '{w}') or contains(lower(description), '{w}'))::int" for w in words)


_FOR = _hits(sn.POSITIVE)
_AGAINST = _hits(sn.NEGATIVE)
SCORE_SQL = NEWS_SQL + f""", hit as (select article_id, symbol, published, {_FOR} as p, {_AGAINST} as n from news),
scored as (select article_id, symbol, published, case when p + n > 0 then (p - n) / (p + n) else 0 end as score from hit)"""


def scored(spark: S, sf: str) -> D:
    """Every document is scored once; its articles share the score."""
    scores = sn.keyword_scores(stories(spark, sf)).select("doc_id", "score")
    return publications(spark, sf).join(scores, "doc_id").drop("doc_id")


@query("article_id:i symbol score:6", SCORE_SQL + ", out as (select * from scored)", "")
def prj11_keywords(spark: S, sf: str) -> D:
    return scored(spark, sf)


@query("article_id:i score:6", """wd as (select doc_id as article_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') as w from documents), ln as (select article_id, w, len(w) as n from wd),
ch as (select article_id, w[i * 30 + 1 : i * 30 + 40] as c from (select *, unnest(range(0, cast(greatest(ceil((n - 40) / 30.0), 0) as bigint) + 1)) as i from ln where n > 0)),
av as (select article_id, avg(len(list_filter(c, lambda x: len(x) > 5)) / len(c)) as score from ch group by 1), out as (select article_id, coalesce(score, 0) as score from ln left join av using (article_id))""", "")
def prj12_chunks(spark: S, sf: str) -> D:
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("article_id"), F.col("text").alias("description"))

    def share(chunk):
        words = F.split(chunk, " ")
        return F.size(F.filter(words, lambda w: F.length(w) > 5)) / F.size(words)

    return sn.chunked_score(docs, share, 40, 10)


_DAILY = """, cal as (select symbol, ts, ts + 3600 * 6 as close_at, row_number() over (partition by symbol order by ts) as rn from (select distinct symbol, cast(floor(published / 86400) * 86400 as bigint) as ts from news)),
edge as (select *, case when rn = 1 then -1 else lag(close_at) over (partition by symbol order by ts) end as prev from cal),
placed as (select e.symbol, e.ts, s.article_id, s.published, s.score from scored s join edge e on e.symbol = s.symbol and s.published > e.prev and s.published <= e.close_at),
rk as (select *, row_number() over (partition by symbol, ts order by published desc, article_id) as rn, count(*) over (partition by symbol, ts) as n from placed),
ag as (select symbol, ts, avg(score) as score, count(*) as news, case when count(*) >= 2 then avg(score) filter (rn <= floor(n / 2)) - avg(score) filter (rn > floor(n / 2)) else 0 end as momentum from rk group by 1, 2)"""


def calendar(spark: S, sf: str) -> D:
    day = (F.floor(F.col("published") / 86400) * 86400).cast("long")
    return publications(spark, sf).select("symbol", day.alias("ts")).distinct().withColumn("close_at", F.col("ts") + 3600 * 6)


@query("symbol ts:i article_id:i", SCORE_SQL + _DAILY + ", out as (select * from placed)", "")
def join4_news_to_bars(spark: S, sf: str) -> D:
    return sn.to_bars(scored(spark, sf), calendar(spark, sf))


@query("symbol ts:i score:6 news:i momentum:6", SCORE_SQL + _DAILY + ", out as (select cal.symbol, cal.ts, coalesce(score, 0) as score, coalesce(news, 0) as news, coalesce(momentum, 0) as momentum from cal left join ag using (symbol, ts))", "")
def sen1_bar_sentiment(spark: S, sf: str) -> D:
    cal = calendar(spark, sf)
    return sn.bar_sentiment(sn.to_bars(scored(spark, sf), cal), cal)


# trained members ------------------------------------------------------------------


@query("fold:i member mae:5 n:i")
def mod1_boosted_forecast(spark: S, sf: str) -> D:
    """Skill of boosted trees on every fold against a forecast of nothing."""
    from barloom.plans.feature_queries import _folds

    assigned = _folds(spark, sf)[0]
    names = [f"r{k}" for k in (1, 2, 5)]
    w = ordered("symbol", "fold")
    rows_ = assigned.withColumns({n: F.log(F.col("close") / F.lag("close", int(n[1:])).over(w)) for n in names}).withColumn("y", F.log(F.lead("close").over(w) / F.col("close")))
    predicted = wf.out_of_fold(rows_, names, "y", rounds=8).join(rows_.where("role = 'test' and y is not null").select("symbol", "ts", "fold", "y"), ["symbol", "ts", "fold"])
    items = F.array(F.struct(F.lit("boosted").alias("member"), F.abs(F.col("forecast") - F.col("y")).alias("e")), F.struct(F.lit("nothing").alias("member"), F.abs("y").alias("e")))
    return predicted.select("fold", F.inline(items)).groupBy("fold", "member").agg(F.avg("e").alias("mae"), F.count("*").alias("n"))


@query("symbol p:i d:i aic:3 forecast:4")
def mod3_autoregression(spark: S, sf: str) -> D:
    return mb.autoregression(price_bars(spark, sf).select("symbol", "ts", F.log("close").alias("x")))


@query("symbol p:i d:i q:i season:i n:i forecast:4")
def mod3_arima(spark: S, sf: str) -> D:
    """Orders with moving-average and seasonal terms, and yesterday's volume as a regressor."""
    bars = price_bars(spark, sf).select("symbol", "ts", F.log("close").alias("x"), F.log("volume").alias("lv"))
    return mb.arima(bars, ["lv"], seasons=(4, 13), least_seasonal=200)


@query("symbol n:i mae:4")
def mod4_seasonal_trend(spark: S, sf: str) -> D:
    b = price_bars(spark, sf).select("symbol", "ts", F.log("close").alias("close"), F.log("volume").alias("lv"))
    cut = F.col("ts") < F.lit("2000-01-01").cast("date")
    f = mb.seasonal_trend(b.where(cut), b.where(~cut), ["lv"])
    return f.join(b, ["symbol", "ts"]).groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("forecast") - F.col("close"))).alias("mae"))


@query("page_id:i cells:i tables:i longest:i")
def src9_html_tables(spark: S, sf: str) -> D:
    """Cells of the tables of every page; each page's words come as a table of their own, as the pages have none."""
    text = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[<>&]", " ")
    rows_ = F.transform(F.split(text, r"\s+"), lambda w: F.concat(F.lit("<tr><td>"), w, F.lit("[1]</td><td> x  y </td></tr>")))
    pages = read(spark, sf, "pages").select("page_id", F.concat("html", F.lit("<table>"), F.array_join(rows_, ""), F.lit("</table>")).alias("html"))
    cells = universe.html_tables(spark, pages)
    return cells.groupBy("page_id").agg(F.count("*").alias("cells"), F.count_distinct("table_no").alias("tables"), F.max(F.length("cell")).alias("longest"))
