"""From target weights to fills, costs, returns and metrics.

``portfolio`` is a key column throughout: folds, pairs, trials and capital
levels are portfolios of their own and run in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from barloom.functions.scan import banded_step, scan_by_day, scan_by_key
from barloom.functions.normal import norm_cdf, psr_argument
from barloom.functions.windows import clip, compounded, ordered, so_far

YEAR = 252


@dataclass(frozen=True)
class Costs:
    """Trading costs in basis points, and what impact needs."""

    commission_bps: float = 0.5
    spread_bps: float = 1.0
    impact_bps: float = 5.0
    multiplier: float = 1.0
    borrow_bps: float = 50.0
    impact_model: str = "quadratic"
    capital: float = 1e6

    def __post_init__(self) -> None:
        if min(self.commission_bps, self.spread_bps, self.impact_bps, self.multiplier, self.borrow_bps) < 0 or self.capital <= 0:
            raise ValueError("costs must not be negative and capital must be positive")
        if self.impact_model not in ("quadratic", "adv_linear", "adv_sqrt"):
            raise ValueError(f"unknown impact model {self.impact_model}")


def scale_to_gross(book: DataFrame, limit: float, weight: str = "weight", keys: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Scale each row of the book down to the gross limit, never up; NULL counts as 0."""
    w = F.coalesce(weight, F.lit(0.0))
    gross = F.sum(F.abs(w)).over(Window.partitionBy(*keys))
    return book.withColumn(weight, w * F.when(gross > limit, F.lit(limit) / gross).otherwise(1.0))


def combine_books(books: DataFrame, cap: float, limit: float) -> DataFrame:
    """``(ts, symbol, weight)``: legs summed, clipped to +-cap, then scaled to the gross limit."""
    summed = books.groupBy("ts", "symbol").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    return scale_to_gross(summed.withColumn("weight", clip(F.col("weight"), -cap, cap)), limit)


def cap_book(book: DataFrame, cap: float, limit: float) -> DataFrame:
    """Scaled to the gross limit, then clipped to +-cap."""
    return scale_to_gross(book, limit).withColumn("weight", clip(F.col("weight"), -cap, cap))


def no_trade_band(targets: DataFrame, band: float | str, target: str = "weight", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``held``: the target where it is more than the band away from what is held, else what is held; from 0."""

    def step(held, row):
        held = 0.0 if held is None else held
        width = row[band] if isinstance(band, str) else band
        x = row[target]
        if x is not None and abs(x - held) > (width or 0.0):
            held = x
        return held, (held,)

    return scan_by_key(targets, list(keys), "ts", step, {"held": "double"}, [target, *([band] if isinstance(band, str) else [])])


def directional_targets(scores: DataFrame, size: float, cap: float, limit: float) -> DataFrame:
    """Scores (+-1) times size, scaled and capped; no decision stays NULL."""
    raw = scores.withColumn("_open", F.col("score").isNotNull()).withColumn("weight", clip(F.col("score"), -1.0, 1.0) * size)
    return cap_book(raw, cap, limit).withColumn("weight", F.when(F.col("_open"), F.col("weight"))).drop("_open")


def fills(targets: DataFrame, keys: tuple[str, ...] = ("portfolio", "symbol")) -> DataFrame:
    """``held`` after the open of each bar: the last target before the bar; a NULL target keeps what is held."""
    w = ordered(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return targets.withColumn("held", F.coalesce(F.last("target", ignorenulls=True).over(w), F.lit(0.0)))


def banded_fills(targets: DataFrame, band: float, limit: float | None) -> DataFrame:
    """``held`` with a band and a gross limit.

    The limit ties the symbols of a portfolio together: one scan for each
    portfolio, day by day. Without it, symbols are scans of their own. A bar
    without any target gives no order; a single missing target keeps its
    position; targets within the band of the position keep it; the rest is
    scaled to the limit; a book equal to the last within 1e-5 relative and
    1e-8 absolute trades nothing.
    """
    keys = ["portfolio", *(["symbol"] if limit is None else [])]
    return scan_by_day(targets, keys, "ts", banded_step(band, limit), {"held": "double"}, ["symbol", "target"], "symbol")


def account(held: DataFrame, costs: Costs, dividends: bool = False) -> DataFrame:
    """``(portfolio, ts, gross_return, trading, impact, borrow, cost, turnover, gross, net, net_return)``.

    ``held`` has ``portfolio, ts, symbol, held, open`` and, where asked for,
    ``dividend`` and ``adv``. Returns run from open to open with the last known
    price; an unknown or zero price returns 0.
    """
    w = ordered("portfolio", "symbol")
    known = F.last(F.when(F.col("open") > 0, F.col("open")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = held.withColumn("_p", known)
    ahead = F.lead("_p").over(w)
    move = F.when(F.col("_p") > 0, F.coalesce(ahead / F.col("_p") - 1, F.lit(0.0))).otherwise(0.0)
    if dividends:
        paid = F.coalesce(F.lead("dividend").over(w), F.lit(0.0))
        move = move + F.when(F.col("_p") > 0, paid / F.col("_p")).otherwise(0.0)
    rows = rows.withColumns({"_move": F.coalesce(move, F.lit(0.0)), "_trade": F.col("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))})
    size = F.abs("_trade")
    if costs.impact_model == "quadratic":
        impact = size * size * (costs.impact_bps * costs.multiplier / 1e4)
    else:
        share = size * costs.capital / F.greatest(F.coalesce("adv", F.lit(0.0)), F.lit(1.0))
        impact = size * (costs.impact_bps * costs.multiplier / 1e4) * (share if costs.impact_model == "adv_linear" else F.sqrt(share))
    rate = (costs.commission_bps + costs.spread_bps) * costs.multiplier / 1e4
    by_bar = rows.groupBy("portfolio", "ts").agg(
        F.sum(F.col("held") * F.col("_move")).alias("gross_return"), (F.sum(size) * rate).alias("trading"), F.sum(impact).alias("impact"),
        (F.sum(F.greatest(-F.col("held"), F.lit(0.0))) * (costs.borrow_bps / 1e4 / YEAR)).alias("borrow"),
        F.sum(size).alias("turnover"), F.sum(F.abs("held")).alias("gross"), F.sum("held").alias("net"),
    )
    cost = F.col("trading") + F.col("impact") + F.col("borrow")
    return by_bar.withColumn("cost", cost).withColumn("net_return", F.col("gross_return") - F.col("cost"))


def equity(returns: DataFrame, capital: float, column: str = "net_return") -> DataFrame:
    return returns.withColumn("equity", capital * compounded(F.col(column)).over(so_far("portfolio")))


def metrics(accounts: DataFrame, capital: float = 1e6) -> DataFrame:
    """One row for each portfolio: returns, risk, drawdown and average exposures.

    Losses of everything or more compound as they are: equity may pass zero,
    and then there is no annual return. ``psr`` is the probability that the
    Sharpe ratio is above zero.
    """
    curve = equity(accounts, capital).withColumn("_peak", F.greatest(F.max("equity").over(so_far("portfolio")), F.lit(float(capital))))
    grown, n = compounded(F.col("net_return")), F.count("net_return")
    mean, dev = F.avg("net_return"), F.stddev_samp("net_return")
    out = curve.groupBy("portfolio").agg(
        n.alias("bars"), (grown - 1).alias("total_return"), F.when(grown >= 0, F.pow(grown, F.lit(float(YEAR)) / n) - 1).alias("annual_return"),
        (dev * YEAR**0.5).alias("volatility"), F.when((n >= 2) & (dev > 1e-15), mean / dev * YEAR**0.5).alias("sharpe"),
        F.max(1 - F.col("equity") / F.col("_peak")).alias("max_drawdown"), F.avg("gross").alias("avg_gross"), F.avg("net").alias("avg_net"),
        F.avg("turnover").alias("avg_turnover"), F.sum("cost").alias("total_cost"), F.skewness("net_return").alias("_skew"), (F.kurtosis("net_return") + 3).alias("_kurt"),
    )
    z = psr_argument(F.col("sharpe") / YEAR**0.5, F.col("bars"), F.col("_skew"), F.col("_kurt"))
    out = out.withColumn("psr", norm_cdf(z)).drop("_skew", "_kurt")
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 1e-9, F.col("annual_return") / F.col("max_drawdown")))


def slice_result(accounts: DataFrame, test_rows: DataFrame, capital: float) -> DataFrame:
    """The accounts of the test rows ``(portfolio, ts)`` with equity from ``capital`` on."""
    return equity(accounts.join(test_rows, ["portfolio", "ts"], "left_semi"), capital)


def combine_returns(returns: DataFrame) -> DataFrame:
    """Equal-weight mean of the symbols' returns on each day, NULLs skipped."""
    return returns.groupBy("ts").agg(F.avg("ret").alias("ret"))


def orders(signals: DataFrame, capital: float, size: float) -> DataFrame:
    """Order rows where the side changes: a flip closes, then opens.

    ``signals(symbol, ts, side, confidence, close)``, side -1, 0 or 1.
    """
    w = ordered("symbol")
    before = F.coalesce(F.lag("side").over(w), F.lit(0))
    shares = F.lit(capital * size) * F.col("confidence") / F.col("close")
    leg = lambda kind, side: F.struct(F.lit(kind).alias("kind"), side.cast("int").alias("side"))
    rows = signals.withColumn("_before", before).where(F.col("side") != F.col("_before"))
    legs = F.filter(
        F.array(F.when(F.col("_before") != 0, leg("close", -F.col("_before"))), F.when(F.col("side") != 0, leg("open", F.col("side")))), lambda x: x.isNotNull()
    )
    return rows.withColumn("o", F.explode(legs)).select(
        "symbol", "ts", "o.kind", "o.side", F.when(F.col("o.kind") == "open", shares).alias("shares")
    )


def fill_orders(submitted: DataFrame, bars: DataFrame) -> DataFrame:
    """Each order filled at the open of the first later bar of its symbol that has a price; none, no fill.

    ``submitted(order_id, symbol, bar, fold_end)`` and ``bars(symbol, bar, open)``;
    orders do not outlive their fold.
    """
    priced = bars.where("open > 0").select("symbol", F.col("bar").alias("fill_bar"), F.col("open").alias("fill_open"))
    both = submitted.select("symbol", "bar", F.struct("order_id", "fold_end").alias("o"), F.lit(None).cast("double").alias("open")).unionByName(
        priced.select("symbol", F.col("fill_bar").alias("bar"), F.lit(None).cast("struct<order_id: bigint, fold_end: int>").alias("o"), F.col("fill_open").alias("open"))
    )
    later = Window.partitionBy("symbol").orderBy(F.desc("bar")).rangeBetween(Window.unboundedPreceding, -1)
    price = F.last(F.when(F.col("open").isNotNull(), F.struct(F.col("bar").alias("at"), "open")), ignorenulls=True).over(later)
    found = both.withColumn("f", price).where("o is not null and f.at <= o.fold_end")
    return found.select("o.order_id", "symbol", F.col("bar").alias("submit_bar"), F.col("f.at").alias("fill_bar"), F.col("f.open").alias("ref_price"))


def price_fills(filled: DataFrame, half_spread_bps: float, impact_coeff: float, commission_bps: float, portfolio_value: float) -> DataFrame:
    """Slippage, fill price and costs of ``filled(side, shares, ref_price)``."""
    notional = F.col("shares") * F.col("ref_price")
    slip = F.lit(half_spread_bps) + (impact_coeff * F.abs(notional) / portfolio_value if portfolio_value > 0 else F.lit(0.0))
    rows = filled.withColumn("slip_bps", slip).withColumn("fill_price", F.col("ref_price") * (1 + F.col("side") * F.col("slip_bps") / 1e4))
    return rows.withColumns({
        "slippage_cost": F.abs(F.col("fill_price") - F.col("ref_price")) * F.col("shares"),
        "commission": F.col("shares") * F.col("fill_price") * (commission_bps / 1e4),
    })


def trade_log(executed: DataFrame) -> DataFrame:
    """Closed trades: each opening fill with the next fill of its symbol and the profit in between."""
    w = Window.partitionBy("symbol").orderBy("ts", F.when(F.col("kind") == "close", 0).otherwise(1))
    paired = executed.withColumns({"exit_ts": F.lead("ts").over(w), "exit_price": F.lead("price").over(w)}).where("kind = 'open'")
    return paired.select("symbol", "side", "shares", "ts", "price", "exit_ts", "exit_price", (F.col("side") * F.col("shares") * (F.col("exit_price") - F.col("price"))).alias("pnl"))


def marked_value(positions: DataFrame, cash: float) -> DataFrame:
    """Value of ``positions(ts, side, shares, entry, price)`` and cash: longs at price, shorts at twice the entry less price."""
    worth = F.when(F.col("side") > 0, F.col("shares") * F.col("price")).when(F.col("side") < 0, F.col("shares") * (2 * F.col("entry") - F.col("price"))).otherwise(0.0)
    return positions.groupBy("ts").agg((F.sum(worth) + cash).alias("value"))


def trade_statistics(trades: DataFrame) -> DataFrame:
    """Win rate, mean win and loss, and profit factor of closed trades with ``pnl``.

    A trade without profit is a loss of 0. Without wins, or losses, their mean
    is 0; without anything lost there is no profit factor.
    """
    p = F.col("pnl")
    won, lost = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)), F.abs(F.sum(F.when(p <= 0, p)))
    return trades.where("pnl is not null").agg(
        F.count("*").alias("trades"), (F.count_if(p > 0) / F.count("*")).alias("win_rate"), F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loss"), F.when(lost > 0, won / lost).alias("profit_factor"),
    )
