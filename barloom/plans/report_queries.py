"""Queries over whole reports and composed pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from barloom.functions.windows import ordered
from barloom.operators import evaluate as ev, factors as fc, folds, packets, pairs as pr, sentiment as sn, walkforward as wf
from barloom.plans import portfolio_queries as pq, signal_queries as sq
from barloom.plans.feature_queries import FOLD_SQL, _folds
from barloom.plans.panels import price_bars
from barloom.plans.portfolio_queries import LOG_SQL, MEMBER_SQL, _SWEEP, member_table, accounts, trips, weights
from barloom.plans.registry import query
from barloom.sources import bars as src

S, D = SparkSession, DataFrame


PAIR_FOLDS = dict(formation=240, test=60, least_test=10)


def pairs_walk(spark: S, sf: str) -> dict[str, D]:
    """Pairs of the event types' random walks, over folds through all hours; evidence weighs the pairs."""
    bars = sq.walk_prices(spark, sf).drop("fold")
    selection = pr.Selection(least_rows=100, max_p=0.9, fdr=0.9, min_corr=0.0, max_half_life=200.0, max_drift=1e6, min_beta=1e-6, most=3, shrunk=True)
    return wf.pairs_report(bars, folds.calendar_slices(bars, **PAIR_FOLDS), selection, wf.PairBook(1.0, 0.2, 3.5, 0.5, 60, 40))


@query("fold:i y x rank:i reason p:4 adf_p:4 evidence:4")
def pair18_walk_forward(spark: S, sf: str) -> D:
    return pairs_walk(spark, sf)["candidates"]


@query("portfolio n:i sharpe:5")
def pair19_trial_sharpes(spark: S, sf: str) -> D:
    return pairs_walk(spark, sf)["trials"]


@query("portfolio bars:i trials:i sharpe:4 avg_gross:5 avg_turnover:5 pair_set_dsr:4")
def pair18_summary(spark: S, sf: str) -> D:
    return pairs_walk(spark, sf)["summary"]


@query("fold:i bars:i names:i evaluations:i invalid_rate:5 slow_rate:5 avg_gross:5 avg_turnover:5 cost_share:3")
def fac13_residual_report(spark: S, sf: str) -> D:
    """Walk-forward of the eigenportfolio residuals, a band from costs and sizes from conviction."""
    bars = price_bars(spark, sf)
    panel = fc.residual_panel(bars, fc.ResidualSpec(60, 40, 2, 5, 1.0, 1000.0, 30.0))
    return wf.residual_report(panel, bars, folds.calendar_slices(bars, 110, 40, least_test=10), band="cost", strength=True)["folds"]


@query("symbol ts:s residual:5")
def pair17_pca_residual(spark: S, sf: str) -> D:
    r, w = sq.rets(spark, sf), sq.windows(spark, sf)
    return wf.pca_residual_prices(r, fc.eigenportfolios(r, w, 2), w, 2)


@query("fold:i n:i mae:4")
def mod12_out_of_fold(spark: S, sf: str) -> D:
    w = ordered("symbol")
    b = _folds(spark, sf)[0]
    by_fold = Window.partitionBy("symbol", "fold").orderBy("ts")
    rows = b.withColumns({"r1": F.log(F.col("close") / F.lag("close").over(by_fold)), "y": F.log(F.lead("close").over(by_fold) / F.col("close"))}).where("y is not null")
    found = wf.out_of_fold(rows, ["r1"], "y", rounds=4)
    return found.join(rows.where("role = 'test'").select("symbol", "ts", "fold", "y"), ["symbol", "ts", "fold"]).groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("forecast") - F.col("y"))).alias("mae"))


@query("symbol ts:s borrow:4", LOG_SQL + ", out as (select b.symbol, b.ts, sum(case when side < 0 then shares * b.close else 0 end) * 0.05 / 252 as borrow from lg join bars b on b.symbol = lg.symbol and b.ts >= lg.ts and b.ts < exit_ts where kind = 'open' group by 1, 2)")
def port16_borrow(spark: S, sf: str) -> D:
    t = trips(spark, sf).where("exit_ts is not null").select("symbol", "side", "shares", F.col("ts").alias("from"), "exit_ts")
    bars = price_bars(spark, sf).select("symbol", "ts", F.col("close").alias("price"))
    w = Window.partitionBy("symbol").orderBy("ts", "_k").rowsBetween(Window.unboundedPreceding, 0)
    opened = t.select("symbol", F.col("from").alias("ts"), F.lit(0).alias("_k"), F.struct("side", "shares", "exit_ts").alias("p"), F.lit(None).cast("double").alias("price"))
    marks = bars.select("symbol", "ts", F.lit(1).alias("_k"), F.lit(None).cast(opened.schema["p"].dataType).alias("p"), "price")
    live = opened.unionByName(marks).withColumn("p", F.last("p", ignorenulls=True).over(w)).where("_k = 1 and p is not null and ts < p.exit_ts")
    return wf.borrow_accrual(live.select("symbol", "ts", "p.side", "p.shares", "price"), 0.05)


@query("symbol ts:s fold:i target:8", MEMBER_SQL + ", " + FOLD_SQL + """, sc as (select symbol, ts, greatest(-1, least(1, sum(pos * weight) filter (weight > 0))) as score from mem join wt using (member) group by 1, 2),
te as (select symbol, ts, fold, score, score * 0.1 as w0, row_number() over (partition by fold, symbol order by ts desc) as rn from assigned join sc using (symbol, ts) where role = 'test'),
g as (select *, sum(abs(w0)) over (partition by ts) as g from te), out as (select symbol, ts, fold, case when rn > 1 then greatest(-0.1, least(0.1, w0 * case when g > 1 then 1 / g else 1 end)) end as target from g)""")
def port21_shared_targets(spark: S, sf: str) -> D:
    return wf.shared_targets(member_table(spark, sf), weights(spark), _folds(spark, sf)[0], 0.1, 1.0)


_SESSION = """, raw as (select article_id, symbol, score, case when article_id % 11 = 0 then 'soon' when article_id % 13 = 0 then null else strftime(to_timestamp(published) at time zone 'UTC', '%Y-%m-%dT%H:%M:%S') || case when article_id % 2 = 0 then 'Z' else '' end end as said from scored),
arts as (select article_id, symbol, score, epoch(try_cast(replace(said, 'Z', '') as timestamp)) as published from raw), good as (select * from arts where published is not null),
days as (select distinct symbol, cast(timezone('America/New_York', to_timestamp(published)) as date) as ts from good),
cal as (select symbol, ts, epoch(timezone('America/New_York', cast(ts as timestamp) + interval 16 hour)) as close_at from days), edge as (select *, coalesce(lag(close_at) over (partition by symbol order by ts), -1) as prev from cal),
placed as (select e.symbol, e.ts, a.article_id, a.published, a.score from good a join edge e on e.symbol = a.symbol and a.published > e.prev and a.published <= e.close_at),
rk as (select *, row_number() over (partition by symbol, ts order by published desc, article_id) as rn, count(*) over (partition by symbol, ts) as n from placed),
ag as (select symbol, ts, avg(score) as score, count(*) as news, case when count(*) >= 2 then avg(score) filter (rn <= floor(n / 2)) - avg(score) filter (rn > floor(n / 2)) else 0 end as momentum from rk group by 1, 2)"""


@query("symbol ts:s score:6 news:i momentum:6", sq.SCORE_SQL + _SESSION + ", out as (select cal.symbol, cal.ts, coalesce(score, 0) as score, coalesce(news, 0) as news, coalesce(momentum, 0) as momentum from cal left join ag using (symbol, ts))", "")
def sen2_sentiment_features(spark: S, sf: str) -> D:
    """From published times as text (UTC where they name no zone, dropped where they are none) to sessions that close at 16:00 in New York."""
    scored, k = sq.scored(spark, sf), F.col("article_id")
    text = F.concat(F.date_format(F.timestamp_seconds("published"), "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 2 == 0, "Z").otherwise(""))
    said = scored.withColumn("said", F.when(k % 11 == 0, "soon").when(k % 13 != 0, text))
    good = sn.with_published(said, "said").where("published is not null")
    day = src.exchange_day(F.timestamp_seconds("published"))
    cal = good.select("symbol", day.alias("ts")).distinct().withColumn("close_at", F.unix_timestamp(src.session_close_utc(F.col("ts"))))
    return sn.bar_sentiment(sn.to_bars(good.drop("said"), cal), cal)


@query("symbol ts:i score:6 news:i")
def sen3_long_text_sentiment(spark: S, sf: str) -> D:
    """Each distinct document is scored once in chunks; its articles share the score."""
    docs = sq.read(spark, sf, "documents")
    chunks = sn.chunked_score(docs.select(F.col("doc_id").alias("article_id"), F.col("text").alias("description")), lambda c: sn.keyword_score(c, F.lit("")), 40, 10)
    scored = sq.publications(spark, sf).join(chunks.withColumnRenamed("article_id", "doc_id"), "doc_id").drop("doc_id")
    cal = sq.calendar(spark, sf)
    return sn.bar_sentiment(sn.to_bars(scored, cal), cal)


@query("pbo:6 splits:i", _SWEEP.replace("st as (", "sz0 as (select ts, row_number() over (order by ts) - 1 as pos from (select distinct ts from tr where ret is not null)), st as (") + """, rr as (select trial as strategy, pos, coalesce(ret, 0) as ret from tr join sz0 using (ts)), sz as (select (max(pos) + 1) // 4 as size from rr), ps as (select strategy, pos // size as slice, ret from rr, sz where pos < size * 4),
masks as (select m from range(16) t(m) where bit_count(m) = 2), sc as (select m, strategy, coalesce(avg(ret) filter (m >> slice & 1 = 1) / nullif(stddev_samp(ret) filter (m >> slice & 1 = 1), 0), 0) as inside, coalesce(avg(ret) filter (m >> slice & 1 = 0) / nullif(stddev_samp(ret) filter (m >> slice & 1 = 0), 0), 0) as outside from ps, masks group by 1, 2),
rk as (select *, row_number() over (partition by m order by round(outside, 9), strategy) as rank, row_number() over (partition by m order by round(inside, 9) desc, strategy) as top from sc), out as (select avg(cast(rank / 19 < 0.5 as int)) as pbo, count(*) as splits from rk where top = 1)""")
def eval19_sweep_overfitting(spark: S, sf: str) -> D:
    """Overfitting probability over the sweep's trials; trials that differ by size alone tie and go by number."""
    daily = pq.sweep_returns(spark, sf)
    days = daily.where("ret is not null").select("ts").distinct().withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)
    rows = daily.join(days, "ts").select(F.col("trial").alias("strategy"), "pos", F.coalesce("ret", F.lit(0.0)).alias("ret"))
    scored = ev.split_scores(rows, 4).withColumns({"inside": F.round("inside", 9), "outside": F.round("outside", 9)})
    up, top = Window.partitionBy("split").orderBy("outside", "strategy"), Window.partitionBy("split").orderBy(F.desc("inside"), "strategy")
    width = F.count("*").over(Window.partitionBy("split"))
    picked = scored.withColumns({"rank": F.row_number().over(up), "top": F.row_number().over(top), "width": width}).where("top = 1")
    return picked.agg(F.avg((F.col("rank") / (F.col("width") + 1) < 0.5).cast("double")).alias("pbo"), F.count("*").alias("splits"))


@query("name sound fault")
def eval14_packets(spark: S, sf: str) -> D:
    """Packets of the accounts, of which one is spoilt, and what their check finds."""
    m = ev.trial_metrics(accounts(spark, sf)).withColumnRenamed("portfolio", "name")
    tiers = ev.claim_tier(m.withColumn("dsr", F.lit(float("nan"))), least=60).withColumnRenamed("tier", "claim_tier")
    runs = ev.config_hash(tiers.withColumn("artifacts", F.array(F.lit("fills.parquet"))), ["name"])
    made = packets.build_packets(runs, ["net_sharpe", "gross_sharpe", "total_cost", "dsr"], ["name", "config_hash", "claim_tier", "artifacts"])
    spoilt = made.limit(1).select(F.lit("spoilt").alias("name"), F.regexp_replace("packet", '"claim_tier"', '"tier"').alias("packet"))
    files = made.select("name", F.lit("fills.parquet").alias("file"))
    every = made.unionByName(spoilt)
    faults = packets.packet_faults(every, files)
    return every.join(faults, "name", "left").select("name", F.col("fault").isNull().alias("sound"), "fault")
