"""Nearest neighbours by counting collisions in single projections.

Largest inner product becomes smallest distance: a vector is divided by the
largest norm and gets one more entry that makes its length 1, a query gets a
zero there. Each block of rows keeps, for each of many random directions, the
sorted array of its projections. A query opens a window around its own
projection in every array and counts, for each row, in how many arrays it lies
inside; rows that collide often enough are verified by their inner product.
Windows widen (virtual rehashing: the same arrays at every width) until the
width is REACH times the distance of the k-th best verified row: a row at
that distance then collides often enough with the probability that the
threshold is set for, a nearer one with more.

Blocks are visited in rounds, each eight times as many as all before it; a
query takes its k-th best score so far from round to round, so that later
blocks open narrow windows and return few rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.scratch import keep

#: Rows of a block of the index, and queries that meet it in one task.
BLOCK, CHUNK = 4096, 2048
#: Directions; half the width of a window over the distance it is meant for; arrays that a row may miss.
DIRECTIONS, REACH, MISSES = 96, 1.9, 10
#: A window's widening, and the growth of the blocks from round to round.
WIDEN, GROW = 2.0, 8
#: Projections are kept in single precision.
EDGE = 2e-6


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim + 1, DIRECTIONS))


def _indexed(frame: pd.DataFrame, longest: float) -> pd.DataFrame:
    """One block: ids, vectors, and for each direction the order of its rows and their sorted projections."""
    frame = frame.sort_values("key")
    x = np.stack(frame["x"].to_numpy())
    scaled = x / longest
    lift = np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))
    seen = (np.hstack([scaled, lift[:, None]]) @ directions(x.shape[1])).T.astype(np.float32)
    order = np.argsort(seen, axis=1, kind="stable").astype(np.int32)
    packed = {"keys": frame["key"].to_numpy(), "ids": frame["vec_id"].to_numpy(), "vectors": x, "places": order, "seen": np.take_along_axis(seen, order, axis=1)}
    return pd.DataFrame({"dim": frame["dim"][:1].to_numpy(), "block": frame["block"][:1].to_numpy(), **{k: [v.tobytes()] for k, v in packed.items()}})


def _misses(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row, the number of arrays in which it lies outside the window [low, high) of the array."""
    n = places.shape[1]
    if int((high - low).sum()) * 2 < places.size:  # few inside: count these
        inside = np.concatenate([places[i, a:b] for i, (a, b) in enumerate(zip(low, high, strict=True))])
        return len(places) - np.bincount(inside, minlength=n)
    outside = np.concatenate([places[i, :a] for i, a in enumerate(low)] + [places[i, b:] for i, b in enumerate(high)])
    return np.bincount(outside, minlength=n)


def search_block(
    keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, seen: np.ndarray, longest: float,
    query_keys: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query, row, score)`` positions and inner products of the rows of a block that can be among a query's k best; ``bounds`` holds the k-th best scores so far."""
    n = len(ids)
    norms = np.sqrt((queries * queries).sum(axis=1))
    centre = (queries / norms[:, None]) @ directions(queries.shape[1])[:-1]
    apart = lambda score, q: np.sqrt(np.maximum(2 - 2 * score / (longest * norms[q]), 0))
    far = apart(bounds, np.arange(len(queries)))  # of the k-th best so far; infinite without one
    # the first window of a query without bound holds some 2k rows of the first array
    at = np.searchsorted(seen[0], centre[:, 0])
    edge = np.maximum(np.abs(seen[0][np.clip(at - k, 0, n - 1)] - centre[:, 0]), np.abs(seen[0][np.clip(at + k, 0, n - 1)] - centre[:, 0]))
    width = np.where(np.isfinite(far), REACH * far, np.maximum(edge, 1e-3)) + EDGE
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    live = np.arange(len(queries))
    while len(live):
        low = np.stack([np.searchsorted(seen[i], centre[live, i] - width[live], side="left") for i in range(DIRECTIONS)], axis=1)
        high = np.stack([np.searchsorted(seen[i], centre[live, i] + width[live], side="right") for i in range(DIRECTIONS)], axis=1)
        wider = []
        for q, a, b in zip(live, low, high, strict=True):
            hits = np.flatnonzero(_misses(places, a, b) <= MISSES)
            hits = hits[keys[hits] != query_keys[q]]
            # row by row and in one order, so that equal vectors score alike
            scores = (vectors[hits] * queries[q]).sum(axis=1)
            if len(hits) > k:
                top = np.lexsort((ids[hits], -scores))[:k]
                hits, scores = hits[top], scores[top]
            best[q] = hits, scores
            if len(hits) == k:
                far[q] = min(far[q], apart(scores[-1], q))
            whole = (a == 0).all() and (b == n).all()
            if not whole and width[q] < REACH * far[q]:
                width[q] = min(width[q] * WIDEN, REACH * far[q] + EDGE) if np.isfinite(far[q]) else width[q] * WIDEN
                wider.append(q)
        live = np.array(wider, np.int64)
    kept = [(q, hits[s >= bounds[q]], s[s >= bounds[q]]) for q, (hits, s) in sorted(best.items())]
    return (
        np.concatenate([np.full(len(h), q) for q, h, _ in kept]), np.concatenate([h for _, h, _ in kept]), np.concatenate([s for _, _, s in kept]),
    )


def _search(longest: dict[int, float], k: int):
    def run(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query": [], "score": [], "vec_id": [], "key": []})
        dim, block = int(key[0]), index.iloc[0]
        load = lambda name, kind: np.frombuffer(block[name], kind)
        keys, ids = load("keys", np.int64), load("ids", np.int64)
        asked = asked.sort_values("query")
        query, row, score = search_block(
            keys, ids, load("vectors", np.float64).reshape(-1, dim), load("places", np.int32).reshape(DIRECTIONS, -1), load("seen", np.float32).reshape(DIRECTIONS, -1),
            longest[dim], asked["query"].to_numpy(), np.stack(asked["x"].to_numpy()), asked["bound"].fillna(-np.inf).to_numpy(np.float64), k,
        )
        return pd.DataFrame({"query": asked["query"].to_numpy()[query], "score": score, "vec_id": ids[row], "key": keys[row]})

    return run


def nearest_by_inner_product(vectors: DataFrame, asks: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of largest inner product with each row for which ``asks`` holds.

    All rows are candidates of all queries of their length but a query's own
    row; ties go to the smaller id. Vectors that are null, empty, zero or hold
    null or non-finite entries, and rows without an id, take no part. Rows under one
    id are rows of their own, so such an id may be found twice and its own
    query finds its other row. Where there are fewer than ``k`` candidates, all
    are returned. The search is approximate: a row at the k-th best distance
    is verified with a probability of about 0.97 by the binomial law of its collisions.
    """
    entry = F.col(vector_col)
    sound = F.forall(entry, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(entry, lambda v: v != 0)
    usable = vectors.where(F.coalesce(sound, F.lit(False)) & F.col(id_col).isNotNull())
    rows = usable.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("vec_id"), F.coalesce(asks, F.lit(False)).alias("asks"),
        entry.cast("array<double>").alias("x"), F.size(entry).alias("dim"),
    )
    rows = keep(rows)
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    stats = rows.groupBy("dim").agg(F.max(norm).alias("longest"), F.count("*").alias("n"), F.count_if("asks").alias("asked")).collect()  # a row for each length of a vector
    longest = {r["dim"]: r["longest"] for r in stats}
    blocks = {r["dim"]: -(-r["n"] // BLOCK) for r in stats}
    chunks = {r["dim"]: -(-r["asked"] // CHUNK) for r in stats}
    result = "query long, score double, vec_id long, key long"
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not any(chunks.values()):
        return empty

    def dealt(to: dict[int, int]) -> Column:
        """A part for each row, of as many as its length has; equal numbers of rows make no difference to results."""
        parts = F.create_map(*(F.lit(x) for d in to for x in (d, max(to[d], 1))))
        return F.pmod(F.xxhash64("key"), parts[F.col("dim")]).cast("int")

    index = keep(
        rows.withColumn("block", dealt(blocks)).groupBy("dim", "block")
        .applyInPandas(lambda key, frame: _indexed(frame, longest[int(key[0])]), "dim int, block int, keys binary, ids binary, vectors binary, places binary, seen binary")
    )
    count = lambda of: F.create_map(*(F.lit(x) for d in of for x in (d, of[d])))[F.col("dim")]
    queries = rows.where("asks").select("dim", dealt(chunks).alias("chunk"), F.col("key").alias("query"), F.col("vec_id").alias("query_id"), "x")
    hits, begin, end = None, 0, 1
    while begin < max(blocks.values()):
        if hits is None:
            asked = queries.withColumn("bound", F.lit(None).cast("double"))
        else:
            bound = F.when(F.size("best") == k, F.get("best", F.lit(k - 1))["minus"] * -1)
            asked = queries.join(hits.select("query", bound.alias("bound")), "query", "left")
        last = F.least(count(blocks), F.lit(end)) - 1
        asked = asked.where(last >= begin).withColumn("block", F.explode(F.sequence(F.lit(begin), last)))
        there = index.where(F.col("block").between(begin, end - 1) & (count(chunks) > 0)).withColumn("chunk", F.explode(F.sequence(F.lit(0), count(chunks) - 1)))
        group = ("dim", "block", "chunk")
        found = there.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(_search(longest, k), result)
        new = found.select("query", F.struct((-F.col("score")).alias("minus"), "vec_id", "key").alias("hit"))
        if hits is not None:
            new = new.unionByName(hits.select("query", F.explode("best").alias("hit")))
        best = F.slice(F.sort_array(F.collect_list("hit")), 1, k)
        hits = keep(new.groupBy("query").agg(best.alias("best")))
        begin, end = end, end * GROW
    named = hits.join(queries.select("query", "query_id"), "query")
    placed = named.select("query_id", F.posexplode("best").alias("at", "hit"))
    return placed.select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", (F.col("hit.minus") * -1).alias("score"))
