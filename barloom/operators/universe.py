"""Index membership over time."""

from __future__ import annotations

from html.parser import HTMLParser
from collections.abc import Iterator
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.functions import udtf

FLOOR = "1990-01-01"
_NOTE = re.compile(r"\[[^\]]*\]")


def normalize_ticker(ticker: Column) -> Column:
    return F.upper(F.regexp_replace(ticker, r"\s+", ""))


class _Tables(HTMLParser):
    """Cells of every table of a page, by table, row and column."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[list[int]] = []
        self.count, self.cell, self.out = 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([self.count, -1, -1])
            self.count += 1
        elif tag == "tr" and self.open:
            self.open[-1][1:] = [self.open[-1][1] + 1, -1]
        elif tag in ("td", "th") and self.open:
            self._close()
            self.open[-1][2] += 1
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()
        if tag == "table" and self.open:
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def _close(self):
        if self.cell is not None and self.open:
            self.out.append((*self.open[-1], " ".join(_NOTE.sub("", "".join(self.cell)).split())))
        self.cell = None


def table_cells(html: str | None) -> list[tuple[int, int, int, str]]:
    """``(table, row, column, text)`` of all tables; footnote marks go and white space collapses."""
    parser = _Tables()
    parser.feed(html or "")
    parser.close()
    parser._close()
    return parser.out


class HtmlTables:
    def eval(self, html: str) -> Iterator[tuple[int, int, int, str]]:
        yield from table_cells(html)


def html_tables(spark: SparkSession, pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` joined laterally with the cells of their tables."""
    spark.udtf.register("barloom_html_tables", udtf(HtmlTables, returnType="table_no int, row_no int, col_no int, cell string"))
    others = ", ".join(f"p.{c}" for c in pages.columns if c != html_col)
    return spark.sql(f"select {others}, t.* from {{pages}} p, lateral barloom_html_tables(p.{html_col}) t", pages=pages)


def required(table: DataFrame, what: str) -> DataFrame:
    """``table``, or an error where nothing was found: a page that changed its layout must not pass as one without members."""
    if table.isEmpty():
        raise ValueError(f"no {what} table was found")
    return table


def constituents(cells: DataFrame) -> DataFrame:
    """``(ticker, row_no)`` of the first table whose first row names a symbol column; doubles keep the first row."""
    heads = cells.where((F.col("row_no") == 0) & F.lower("cell").contains("symbol"))
    head = heads.agg(F.min(F.struct("table_no", "col_no")).alias("h")).select("h.table_no", "h.col_no")
    found = cells.join(head, ["table_no", "col_no"]).where("row_no > 0").select(normalize_ticker(F.col("cell")).alias("ticker"), "row_no")
    return found.where("ticker <> ''").groupBy("ticker").agg(F.min("row_no").alias("row_no"))


def changes(cells: DataFrame, date_format: str = "MMMM d, yyyy") -> DataFrame:
    """``(date, added, removed, row_no)``: columns 0, 1 and 3 of the tables whose date parses; other rows are skipped."""
    at = lambda k: F.max(F.when(F.col("col_no") == k, F.col("cell")))
    rows = cells.groupBy("table_no", "row_no").agg(at(0).alias("d"), at(1).alias("added"), at(3).alias("removed"))
    rows = rows.withColumn("date", F.to_date(F.try_to_timestamp("d", F.lit(date_format))))
    return rows.where("date is not null").select("date", normalize_ticker(F.col("added")).alias("added"), normalize_ticker(F.col("removed")).alias("removed"), "row_no")


def membership(events: DataFrame, current: DataFrame, end: str, floor: str = FLOOR) -> DataFrame:
    """``(ticker, start, end)`` intervals, both ends included.

    ``events(ticker, date, row_no, kind)`` with kind ``add`` or ``remove``, and
    ``current(ticker)``. Tickers are independent: one whose first event is a
    removal, or a current one without events, was a member from ``floor`` on.
    An event that repeats the state is skipped. Removal comes before addition
    within a row; open intervals end on ``end``.
    """
    w = Window.partitionBy("ticker").orderBy("date", "row_no", F.when(F.col("kind") == "remove", 0).otherwise(1))
    seen = events.withColumns({"_last": F.lag("kind").over(w), "_first": F.row_number().over(w) == 1})
    turns = seen.where(F.col("_first") | (F.col("kind") != F.col("_last")))
    turns = turns.withColumn("_next", F.lead("date").over(w))
    opened = turns.where("kind = 'add'").select("ticker", F.col("date").alias("start"), F.coalesce("_next", F.lit(end).cast("date")).alias("end"))
    early = turns.where("_first and kind = 'remove'").select("ticker", F.lit(floor).cast("date").alias("start"), F.col("date").alias("end"))
    quiet = current.select("ticker").distinct().join(events.select("ticker").distinct(), "ticker", "left_anti")
    quiet = quiet.select("ticker", F.lit(floor).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    return opened.unionByName(early).unionByName(quiet).where("start <= end")


def membership_mask(days: DataFrame, intervals: DataFrame) -> DataFrame:
    """``days(symbol, ts)`` with ``member``: inside any interval of its ticker."""
    spans = intervals.groupBy(F.col("ticker").alias("symbol")).agg(F.collect_list(F.struct("start", "end")).alias("_s"))
    inside = F.exists("_s", lambda s: (F.col("ts") >= s["start"]) & (F.col("ts") <= s["end"]))
    return days.join(spans, "symbol", "left").withColumn("member", F.coalesce(inside, F.lit(False))).drop("_s")


def active_between(intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    return intervals.where((F.col("start") <= F.lit(hi).cast("date")) & (F.col("end") >= F.lit(lo).cast("date"))).select("ticker").distinct()


def coverage(members: DataFrame, priced: DataFrame, renames: DataFrame) -> DataFrame:
    """``(members, covered, coverage)``: members with prices under their own or their vendor's name."""
    named = members.select("ticker").distinct().join(renames, "ticker", "left").select(F.coalesce("vendor", "ticker").alias("symbol"))
    have = priced.select("symbol").distinct().withColumn("_has", F.lit(1))
    return named.join(have, "symbol", "left").agg(F.count("*").alias("members"), F.count("_has").alias("covered"), (F.count("_has") / F.count("*")).alias("coverage"))


def listed_by(bars: DataFrame, as_of: str | None) -> DataFrame:
    """Bars of the symbols whose first bar is not after ``as_of``; all of them without a date."""
    if as_of is None:
        return bars
    first = bars.groupBy("symbol").agg(F.min("ts").alias("first")).where(F.col("first") <= F.lit(as_of).cast("date"))
    return bars.join(first, "symbol", "left_semi")
