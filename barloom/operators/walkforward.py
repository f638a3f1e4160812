"""Whole walk-forward reports; folds are a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.windows import ordered
from barloom.operators import evaluate as ev, factors as fc, folds, members as mb, pairs as pr, portfolio as pf
from barloom.operators.boosting import boosted_folds
from barloom.sources.folder import stored


def column_groups(columns: list[str], is_label) -> dict[str, list[str]]:
    """Columns by name; groups may overlap, and labels belong to none."""
    free = [c for c in columns if not is_label(c)]
    return {
        "price": [c for c in free if c in ("open", "high", "low", "close") or c.startswith(("ma", "ema", "bb_"))],
        "volume": [c for c in free if "volume" in c],
        "sentiment": [c for c in free if "sentiment" in c],
        "technical": [c for c in free if c.startswith(("rsi", "macd", "atr", "mfi", "roc", "volatility", "price_change", "gap", "daily_range")) or "sentiment" in c],
        "label": [c for c in columns if is_label(c)],
    }


def fold_days(bars: DataFrame, slices: DataFrame) -> DataFrame:
    """``(fold, ts, formation)``: the days of ``slices(fold, form_lo, form_hi, test_lo, test_hi)``, in rows of the calendar."""
    calendar = bars.select("ts").distinct().withColumn("pos", F.row_number().over(Window.orderBy("ts")) - 1)
    spans = slices.withColumn("pos", F.explode(F.sequence(F.col("form_lo"), F.col("test_hi") - 1)))
    return spans.select("fold", "pos", (F.col("pos") < F.col("form_hi")).alias("formation")).join(calendar, "pos")


def _flat_at_the_end(book: DataFrame, days: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """``book`` with 0 on the last two test days of each fold."""
    last = days.where("not formation").withColumn("_rn", F.row_number().over(Window.partitionBy("fold").orderBy(F.desc("ts")))).select("fold", "ts", (F.col("_rn") <= 2).alias("_end"))
    return book.join(last, ["fold", "ts"]).withColumn(weight, F.when(F.col("_end"), 0.0).otherwise(F.col(weight))).select(*keys, weight)


def _on_all_days(targets: DataFrame, bars: DataFrame, portfolio: str) -> DataFrame:
    """Targets ``(ts, symbol, target)`` on every bar, 0 where there is none, and ``adv``, the bar's dollar volume, where bars have volumes."""
    adv = [(F.col("close") * F.col("volume")).alias("adv")] if {"close", "volume"} <= set(bars.columns) else []
    filled = bars.select("ts", "symbol", "open", *adv).join(targets, ["ts", "symbol"], "left")
    return filled.withColumns({"target": F.coalesce("target", F.lit(0.0)), "portfolio": F.lit(portfolio)})


@dataclass(frozen=True)
class PairBook:
    """Signals and limits of a pairs book."""

    entry: float = 2.0
    leave: float = 0.5
    stop: float = 4.0
    gross_per_pair: float = 1.0
    window: int = 60
    least: int = 40
    cap: float = 0.35
    gross: float = 1.0


def pairs_report(
    bars: DataFrame, slices: DataFrame, selection: pr.Selection = pr.Selection(), book: PairBook = PairBook(), costs: pf.Costs = pf.Costs(), lags: bool = True
) -> dict[str, DataFrame]:
    """Walk-forward pairs: ``candidates, turnover, diagnostics, trials, accounts, folds, summary``.

    Pairs are tested on a fold's formation rows in both orders (lags by AIC,
    or none), gated, ranked and weighted. Scores run over formation and test
    rows together, so a test starts with a warm window; positions count on
    test rows alone and end flat. Each pair's own account gives a trial; the
    books of all folds, clipped and scaled, are one portfolio, whose Sharpe
    ratio ``summary`` deflates by the trials (``pair_set_dsr``).
    """
    days = fold_days(bars, slices)
    prices = bars.join(days, "ts").select("fold", "ts", "symbol", "close", "formation")
    formed = prices.where("formation")
    stats = pr.pair_table(formed, both_orders=True)
    if lags:
        stats = stats.drop("stat", "adf_stat").join(pr.aic_table(formed, both_orders=True).select(*pr.PAIR, "stat", "adf_stat"), pr.PAIR)
    candidates = stored(pr.choose_pairs(stats, selection), "candidates")
    chosen = candidates.where("reason is null")
    held = pr.rows_of_pairs(prices, chosen)
    test = days.where("not formation").select("fold", "ts")
    scored = pr.spread_scores(held, chosen, book.window, book.least).select(*pr.PAIR, "ts", "beta", "z")
    states = pr.pair_positions(scored, book.entry, book.leave, book.stop)
    legs = pr.pair_legs(states, book.gross_per_pair).join(chosen.select(*pr.PAIR, "evidence"), pr.PAIR).join(test, ["fold", "ts"], "left_semi")
    legs = stored(_flat_at_the_end(legs.withColumn("weight", F.col("weight") * F.col("evidence")), days, [*pr.PAIR, "ts", "symbol"], "weight"), "legs")

    opens = bars.select("ts", "symbol", "open")
    alone = legs.withColumnRenamed("weight", "target").withColumn("portfolio", F.concat_ws("/", "fold", "y", "x")).join(opens, ["ts", "symbol"])
    trials = ev.periodic_sharpe(pf.account(pf.fills(alone), costs).withColumn("ret", F.col("net_return")), ["portfolio"])

    combined = pf.combine_books(legs.select("ts", "symbol", "weight"), book.cap, book.gross)  # test days of folds do not overlap
    accounts = pf.account(pf.fills(_on_all_days(combined.withColumnRenamed("weight", "target"), bars, "pairs")), costs)
    accounts = stored(accounts.join(test, "ts"), "accounts")
    by_fold = pf.metrics(accounts.withColumn("portfolio", F.col("fold").cast("string"))).withColumnRenamed("portfolio", "fold")
    return {
        "candidates": candidates, "turnover": pr.fold_turnover(chosen), "trials": trials, "accounts": accounts, "folds": by_fold,
        "diagnostics": pr.pair_diagnostics(held.join(test, ["fold", "ts"], "left_semi"), chosen),
        "summary": pf.metrics(accounts).join(_deflated(accounts, trials), "portfolio"),
    }


def _deflated(accounts: DataFrame, trials: DataFrame) -> DataFrame:
    """``(portfolio, trials, pair_set_dsr)``; NULL below two trials with a Sharpe ratio."""
    out = ev.deflate(ev.moments(accounts.withColumn("ret", F.col("net_return")), ["portfolio"]), trials, [])
    return out.select("portfolio", F.col("trials"), F.col("dsr").alias("pair_set_dsr"))


def residual_report(
    panel: fc.ResidualPanel, bars: DataFrame, slices: DataFrame, unit: float = 0.02, cap: float = 0.35, gross: float = 1.0, band: float | str = 0.0,
    strength: bool = False, costs: pf.Costs = pf.Costs(),
) -> dict[str, DataFrame]:
    """Walk-forward of an s-score panel: ``folds``, ``accounts``, ``targets`` and a one-row ``summary``.

    States start flat in each fold's test rows. A bar's book holds the stock
    legs and the hedge of their exposures, scaled, then clipped; a no-trade
    band (a number, or ``"cost"`` for one from costs and the half-life last
    known before the test) is held by symbol. ``folds`` has the metrics, the
    names traded, cost over absolute gross profit and the signal's health.
    """
    days = fold_days(bars, slices)
    test = days.where("not formation").select("fold", "ts")
    scores, portfolios = stored(panel.scores, "scores"), stored(panel.portfolios, "portfolios")
    scored = scores.join(test, "ts")
    states = fc.reversion_positions(scored.select("fold", "symbol", "ts", "sscore", F.col("tradeable").alias("ok")), ["fold", "symbol"])
    states = states.withColumn("scale", fc.conviction(F.col("sscore"), 1.25, 2.0) if strength else F.lit(1.0))
    betas = scored.where("betas is not null").select("ts", "symbol", F.posexplode("betas").alias("factor", "beta"))
    weights = scores.select("ts", "rebalance").distinct().join(portfolios, "rebalance").select("ts", "factor", "symbol", "weight")
    net = fc.residual_book(states.select("ts", "symbol", "state", "scale"), betas, weights, unit, "scale")
    book = pf.cap_book(_on_all_days(net.withColumnRenamed("weight", "target"), bars, "residual").withColumnRenamed("target", "weight").join(test, "ts"), cap, gross)
    if band == "cost" or band > 0:
        width = F.lit(None if band == "cost" else float(band)).cast("double")
        book = book.withColumn("band", width)
        if band == "cost":
            speed = fc.last_half_life(scores, days).withColumn("_w", fc.cost_aware_band(F.col("half_life"), (costs.commission_bps + costs.spread_bps) * 2 / 1e4, 1.0))
            book = book.join(speed.select("fold", "symbol", "_w"), ["fold", "symbol"], "left").withColumn("band", F.coalesce("_w", F.lit(0.0))).drop("_w")
        held = pf.no_trade_band(book.select("fold", "symbol", "ts", "weight", "band"), "band", keys=("fold", "symbol"))
        book = pf.cap_book(held.select("fold", "symbol", "ts", F.col("held").alias("weight")), cap, gross)
    targets = stored(_flat_at_the_end(book, days, ["fold", "ts", "symbol"], "weight").withColumnRenamed("weight", "target"), "targets")
    accounts = stored(pf.account(pf.fills(_on_all_days(targets.select("ts", "symbol", "target"), bars, "residual")), costs).join(test, "ts"), "accounts")

    traded = targets.where((F.abs("target") > 0) & ~F.col("symbol").isin(list(panel.spec.funds))).groupBy("fold").agg(F.count_distinct("symbol").alias("names"))
    share = accounts.groupBy("fold").agg((F.sum("cost") / F.greatest(F.abs(F.sum("gross_return")), F.lit(1e-9))).alias("cost_share"))
    health = fc.signal_health(scored, panel.spec.max_half_life, ("fold",))
    by_fold = pf.metrics(accounts.withColumn("portfolio", F.col("fold").cast("string"))).withColumn("fold", F.col("portfolio").cast("int")).drop("portfolio")
    by_fold = by_fold.join(traded, "fold", "left").fillna(0, subset=["names"]).join(share, "fold").join(health, "fold", "left")
    weighed = lambda c: (F.sum(F.col(c) * F.col("evaluations")) / F.sum("evaluations")).alias(c)
    totals = by_fold.agg(F.count("*").alias("folds"), F.avg("names").alias("avg_names"), F.sum("evaluations").alias("evaluations"), weighed("invalid_rate"), weighed("slow_rate"))
    summary = pf.metrics(accounts).join(totals.withColumn("portfolio", F.lit("residual")), "portfolio")
    return {"folds": by_fold, "accounts": accounts, "targets": targets, "summary": summary}


def pca_residual_prices(returns: DataFrame, portfolios: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """``(symbol, ts, residual)``: running sum of each window's last regression residual on its eigenportfolios, as a price."""
    names = [f"f{j}" for j in range(k)]
    inside = fc.windowed(returns, windows)
    f = fc.factor_returns(inside.select("symbol", "ts", "ret").distinct(), portfolios).groupBy("rebalance", "ts").pivot("factor", list(range(k))).agg(F.first("f"))
    used = inside.join(portfolios.select("rebalance", "symbol").distinct(), ["rebalance", "symbol"], "left_semi").join(f.toDF("rebalance", "ts", *names), ["rebalance", "ts"])
    last = fc.factor_residuals(used, names).where("ts = rebalance")
    return last.withColumn("residual", F.exp(F.sum("residual").over(ordered("symbol").rowsBetween(Window.unboundedPreceding, 0)))).select("symbol", "ts", "residual")


def out_of_fold(assigned: DataFrame, features: list[str], label: str, **options) -> DataFrame:
    """Forecasts of boosted trees for the test rows of every fold, each from its own training rows; all folds grow at once."""
    found, _ = boosted_folds(assigned, features, label, **options)
    return found.select("symbol", "ts", "fold", "forecast")


def borrow_accrual(positions: DataFrame, rate: float) -> DataFrame:
    """``(symbol, ts, borrow)``: a day's share of the yearly rate on short notional at the mark."""
    short = F.when(F.col("side") < 0, F.col("shares") * F.col("price")).otherwise(0.0)
    return positions.groupBy("symbol", "ts").agg((F.sum(short) * rate / 252).alias("borrow"))


def shared_targets(member_positions: DataFrame, members: DataFrame, assigned: DataFrame, size: float, limit: float) -> DataFrame:
    """Targets of all folds' test rows from the conviction score, without the last of each fold."""
    score = mb.blend(member_positions, members, 1.0, renormalize=False).withColumnRenamed("position", "score")
    rows = assigned.where("role = 'test'").select("symbol", "ts", "fold").join(score, ["symbol", "ts"])
    cap = min(size, limit)
    targets = pf.directional_targets(rows, size, cap, limit).withColumnRenamed("weight", "target")
    return folds.drop_last_target(targets)
