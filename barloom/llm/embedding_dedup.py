"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products.

Vectors are compared only where labels are equal. Equal vectors are collapsed
first. Unit vectors go to the cell of their closest centroid. A vector that
could be close to a member of another cell also visits that cell: if y is at
least as close to centroid c as to h, the bisecting plane of c and h lies
between x and y or at x, so cos(x, y) >= t needs

    x.h - x.c <= sqrt(1 - t * t) * |h - c|,

and visiting where this holds loses no pair. Cells are compared in blocks of
bounded size; a block gives link counts and a spanning forest of its links,
so a group of close vectors never becomes a list of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from barloom.llm.components import connected_components
from barloom.llm.rows import keyed_rows
from barloom.llm.scratch import keep

#: Rows of one side of a block.
BLOCK = 512
#: Vectors of a label to each of its cells, cells of all labels, and sampled vectors of a label.
CELL_ROWS, MOST_CELLS, SAMPLE = 1024, 4096, 8192


def _units(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spherical_kmeans(units: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centroids of unit vectors; a cell that empties keeps its centroid."""
    rng = np.random.default_rng(seed)
    centroids = units[[rng.integers(len(units))]]
    best = units @ centroids[0]
    while len(centroids) < min(k, len(units)):  # far points first, drawn by squared distance
        weight = np.maximum(1 - best, 0) + 1e-12
        pick = units[rng.choice(len(units), p=weight / weight.sum())]
        centroids = np.vstack([centroids, pick])
        best = np.maximum(best, units @ pick)
    for _ in range(rounds):
        home = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, units)
        norm = np.sqrt((sums * sums).sum(axis=1))
        centroids = np.where(norm[:, None] > 1e-12, sums / np.maximum(norm, 1e-12)[:, None], centroids)
    return centroids


def _kind(rows: DataFrame, column: str) -> str:
    return rows.schema[column].dataType.simpleString()


def _fit_cells(rows: DataFrame, sizes: dict[tuple, int]) -> dict[tuple, np.ndarray]:
    """Centroids of each (label, dim) that has more than one cell, fitted on a sample of at most about SAMPLE vectors a label."""
    total = sum(sizes.values())
    cells = {g: min(n // CELL_ROWS, MOST_CELLS * n // total) for g, n in sizes.items()}
    cells = {g: k for g, k in cells.items() if k > 1}
    if not cells:
        return {}

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = spherical_kmeans(_units(frame.sort_values("rep")["embedding"]), cells[(key[0], key[1])])
        return pd.DataFrame({"label": key[0], "dim": key[1], "centroid": list(found)})

    wanted = [(F.col("label") == g[0]) & (F.col("dim") == g[1]) & (F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / sizes[g]) * (1 << 20))) for g in cells]
    mask = wanted[0]
    for w in wanted[1:]:
        mask = mask | w
    schema = f"label {_kind(rows, 'label')}, dim int, centroid array<double>"
    fitted = rows.where(mask).groupBy("label", "dim").applyInPandas(fit, schema).collect()  # at most MOST_CELLS rows
    out: dict[tuple, list] = {}
    for r in fitted:
        out.setdefault((r["label"], r["dim"]), []).append(r["centroid"])
    return {g: np.array(c) for g, c in out.items()}


def _to_cells(rows: DataFrame, centroids: dict[tuple, np.ndarray], threshold: float) -> DataFrame:
    """Each vector in its home cell and, as a visitor, in later cells that it may have links to."""
    reach = float(np.sqrt(max(0.0, 1 - threshold * threshold))) + 1e-9
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for group, part in frame.groupby(["label", "dim"]):
                c = shared.value.get(group)
                if c is None:
                    yield part.assign(cell=0, visitor=False)
                    continue
                sims = _units(part["embedding"]) @ c.T
                home = sims.argmax(axis=1)
                yield part.assign(cell=home, visitor=False)
                between = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))
                near = sims[np.arange(len(part)), home][:, None] - sims <= reach * between[home]
                near &= np.arange(len(c))[None, :] > home[:, None]
                at, cell = np.nonzero(near)
                if len(at):
                    yield part.iloc[at].assign(cell=cell, visitor=True)

    return rows.mapInPandas(assign, f"rep long, n long, label {_kind(rows, 'label')}, dim int, embedding {_kind(rows, 'embedding')}, cell int, visitor boolean")


def _compare(threshold: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        left, right = frame[frame["side"] != 1], frame[frame["side"] != 0]
        same = bool((frame["side"] == 2).all())
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")
        a = _units(left["embedding"])
        linked = (a @ a.T if same else a @ _units(right["embedding"]).T) >= threshold
        ids_a, n_a = left["rep"].to_numpy(), left["n"].to_numpy()
        if same:
            np.fill_diagonal(linked, False)
            ids_b, n_b = ids_a, n_a
        else:
            ids_b, n_b = right["rep"].to_numpy(), right["n"].to_numpy()
        root_a, root_b = ids_a.copy(), ids_b.copy()
        while True:  # the smallest id spreads over the links of the block
            far = np.iinfo(np.int64).max
            next_a = np.minimum(root_a, np.where(linked, root_b[None, :], far).min(axis=1))
            next_b = next_a if same else np.minimum(root_b, np.where(linked, next_a[:, None], far).min(axis=0))
            if (next_a == root_a).all() and (next_b == root_b).all():
                break
            root_a, root_b = next_a, next_b
        out = [pd.DataFrame({"rep": ids_a, "links": linked @ n_b, "root": root_a})]
        if not same:
            out.append(pd.DataFrame({"rep": ids_b, "links": linked.T @ n_a, "root": root_b}))
        found = pd.concat(out)
        return found[found["links"] > 0]

    return run


def near_embeddings(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``: one row for every row of ``vectors``.

    ``n_links`` counts the other rows with the same label at cosine
    ``threshold`` or more, in double precision; ``component_id`` is the
    smallest id that links reach. Vectors that are null, empty, zero or hold
    nulls or non-finite components, and rows with a null label or id, link with
    nothing and are kept (a null id has a null component). Vectors of
    different lengths do not link. Vectors under one id are rows of their own,
    each judged by itself. An empty table gives an empty result.
    """
    number = keyed_rows(vectors, id_col)
    rows = number.rows.select(
        "key", F.col(f"row.{id_col}").cast("long").alias("vec_id"), F.col(f"row.{vector_col}").alias("embedding"), F.col(f"row.{label_col}").alias("label")
    )
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("usable", usable)
    good = rows.where("usable")
    reps = keep(
        good.groupBy("label", "embedding").agg(F.min("key").alias("rep"), F.min("vec_id").alias("first_id"), F.count("*").alias("n")).withColumn("dim", F.size("embedding"))
    ).select("rep", "first_id", "n", "label", "dim", "embedding")
    firsts, reps = reps.select("rep", "first_id"), reps.drop("first_id")
    sizes = {(r["label"], r["dim"]): r["count"] for r in reps.groupBy("label", "dim").count().collect()}  # a row for each label
    placed = keep(_to_cells(reps, _fit_cells(reps, sizes), threshold))

    cell = ["label", "dim", "cell"]
    counts = placed.groupBy(*cell).agg(F.count_if("visitor").alias("visitors"), F.count_if(~F.col("visitor")).alias("members"))
    blocks = keep(counts.select(*cell, F.ceil(F.col("members") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("visitors") / BLOCK).cast("int").alias("vb")))
    dealt = placed.join(blocks, cell).withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("visitor"), F.col("vb")).otherwise(F.col("mb"))).cast("int"))
    among = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda j: F.struct(
        F.lit(0).alias("kind"), F.least("own", j).alias("i"), F.greatest("own", j).alias("j"),
        F.when(F.col("own") == j, 2).when(F.col("own") < j, 0).otherwise(1).alias("side"),
    ))
    hosting = F.when(F.col("vb") > 0, F.transform(F.sequence(F.lit(0), F.col("vb") - 1), lambda j: F.struct(
        F.lit(1).alias("kind"), F.col("own").alias("i"), j.alias("j"), F.lit(0).alias("side"),
    ))).otherwise(F.filter(among, lambda _: F.lit(False)))
    visiting = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.col("mb"), F.lit(1)) - 1), lambda i: i < F.col("mb")), lambda i: F.struct(
        F.lit(1).alias("kind"), i.alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"),
    ))
    tasks = F.when(F.col("visitor"), visiting).otherwise(F.concat(among, hosting))
    sides = dealt.withColumn("t", F.explode(tasks)).select(*cell, "t.kind", "t.i", "t.j", "t.side", "rep", "n", "embedding")
    found = keep(sides.groupBy(*cell, "kind", "i", "j").applyInPandas(_compare(threshold), "rep long, links long, root long"))

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    placed = reps.join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").join(firsts, "rep")
    placed = placed.select("label", "embedding", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("group"))
    placed = keep(placed)
    smallest = placed.groupBy("group").agg(F.min("first_id").alias("component_id"))
    classes = keep(placed.join(smallest, "group").select("label", "embedding", "n_links", "component_id"))
    joined = good.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = joined.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
