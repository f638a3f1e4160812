"""Rows of a caller as one column, with a key that tells them apart."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from barloom.llm.scratch import keep


class Keyed(NamedTuple):
    """``rows(key, row)``; ``by_id``: the key is the id, which no two rows share and no row lacks."""

    rows: DataFrame
    by_id: bool


def keyed_rows(docs: DataFrame, id_col: str = "doc_id") -> Keyed:
    """Every row of ``docs`` as the struct ``row`` under a key of its own.

    Where an id is null or repeats, rows are numbered, and the numbers are
    written, so that they stay. The struct keeps the caller's columns apart
    from all others, whatever their names are.
    """
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    ids = docs.select(F.col(id_col).cast("long").alias("key"))
    if ids.groupBy("key").count().where("count > 1 or key is null").isEmpty():
        return Keyed(docs.select(F.col(id_col).cast("long").alias("key"), row), True)
    return Keyed(keep(docs.select(F.monotonically_increasing_id().alias("key"), row)), False)


#: Keys that go to every executor at most, 8 MB of them; more are joined by a shuffle.
MOST_SENT = 1_000_000


def with_keys(rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``key`` is among the written ``keys`` (or is not, with ``left_anti``); few keys move instead of the rows."""
    return rows.join(F.broadcast(keys) if keys.count() <= MOST_SENT else keys, "key", how)


def first_of_groups(keyed: Keyed, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows that come first in their group of ``groups(key, component)``, by id, nulls last, then by key; ``component`` is the smallest key of a group."""
    if keyed.by_id:
        gone = groups.where("key <> component").select("key")
    else:
        order = F.struct(F.col(f"row.{id_col}").isNull().alias("none"), F.col(f"row.{id_col}").alias("id"), "key")
        placed = groups.join(keyed.rows.select("key", order.alias("order")), "key")
        first = placed.groupBy("component").agg(F.min("order").alias("first")).select("first.key")
        gone = groups.select("key").join(first, "key", "left_anti")
    return with_keys(keyed.rows, keep(gone), "left_anti").select("row.*")
