"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barloom.llm.scratch import keep


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of ``edges(a, b)`` can reach.

    Returns ``(node, component)`` for the nodes that have an edge. Each round
    hooks every node to its smallest neighbour, follows the hooks to their
    roots by doubling, and replaces the edges by edges between roots; rounds
    shrink the graph at least by half. Null ends and loops are ignored. No
    list of neighbours is ever gathered, so a hub is only a frequent key of
    a join or of a minimum with map-side combination.
    """
    live = keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    found = None
    while not live.isEmpty():
        hooks = keep(
            live.union(live.select("b", "a"))
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("b").alias("near"))
            .select("node", F.least("node", "near").alias("root"))
        )
        while True:
            above = hooks.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = keep(hooks.join(above, "root").select("node", "root", "top"))
            hooks = jumped.select("node", F.col("top").alias("root"))
            if jumped.where("root <> top").isEmpty():
                break
        if found is None:
            found = hooks
        else:
            up = hooks.select(F.col("node").alias("component"), "root")
            found = keep(
                found.join(up, "component", "left").select(
                    "node", F.coalesce("root", "component").alias("component")
                )
            )
        found = found.select("node", F.col(found.columns[1]).alias("component"))
        left = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        live = keep(
            live.join(left, "a")
            .join(right, "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
    if found is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
