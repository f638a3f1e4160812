"""Near-duplicate documents by the Jaccard similarity of their word shingles.

A document is the set of the 64-bit hashes of its shingles, written once.
Elements are ordered from rare to frequent, as far as tasks have seen them
repeat, and by hash among themselves; any order that all sets share is right,
and this one keeps passages that many documents share out of the prefixes.
Two sets of similarity t or more share an element among the first
n - ceil(t * n) + 1 of both (prefix filter), whose places leave room for
enough common elements (positional filter), and their sizes differ by at most
the factor t (length filter); the number of elements that two prefixes share
bounds what the whole sets can share. What passes is verified on the whole sets, so
no link is lost and none is added.

Equal sets are one node. Nodes with equal or close SimHash prints meet first
(the grid join of ``simhash``); those links are certain once verified. Prints
miss most pairs near the threshold, so the prefix join goes over all nodes:
each meets one node under every prefix element, another one in each round, as
long as many pairs are open; then all nodes of different groups meet whose
parity signatures leave room for the similarity. A large
group of near copies becomes one group in a few rounds and never makes all its
pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm.components import connected_components
from barloom.llm.parts import parts_of
from barloom.llm.rows import MOST_SENT, first_of_groups, keyed_rows, with_keys
from barloom.llm.scratch import drop, keep, settled
from barloom.llm.simhash import SEED, close_pairs, print_of, shingle_hashes


#: Words of a set's parity signature: with 2,048 bits, sets of some thousand elements that differ in a fourth still differ in more bits than similar ones may.
SIGN = 32


def parity_sign(hashes: np.ndarray) -> list[int]:
    """A bit for each residue modulo 64 * SIGN, set if an odd number of ``hashes`` has it.

    Two sets differ in at least as many elements as their signatures in bits.
    """
    odd = np.bincount(hashes.view("<u8") % np.uint64(64 * SIGN), minlength=64 * SIGN).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8").tolist()


_SCHEMA = "key long, w1 long, w2 long, n int, fp long, sign array<long>, part array<long>, first int"
_NAMES = [field.split()[0] for field in _SCHEMA.split(", ")]
#: Elements among which a task looks for repeated ones at a time, and how many are ordered by how often they repeat, at most: the most frequent. Both affect speed and never the result.
BLOCK, MOST_RANKED = 1 << 19, 1 << 18


def _repeated(found: list[np.ndarray]) -> pa.RecordBatch:
    """The elements that several sets have as rows without a key: ``w1`` is the element and ``n`` the number of sets."""
    every = np.concatenate(found)
    every.sort()
    values, again = np.unique(every[1:][every[1:] == every[:-1]], return_counts=True)
    none = [pa.nulls(len(values), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())]
    return pa.RecordBatch.from_arrays([none[0], pa.array(values), none[1], pa.array(again + 1, pa.int32()), *none[2:]], names=_NAMES)


def _sets(words: int, threshold: float):
    """``(key, w1, w2, n, fp, sign, part, first)``: a 128-bit digest, SimHash, signature, whole set and length of the prefix of every row, and rows of ``_repeated``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in parts_of(batches, rows=1024, size=1 << 21):
            hashes = [shingle_hashes(t or b"", words) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            found = [np.unique(h.view("<i8")) for h in hashes]
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in found), "<i8").reshape(-1, 2)
            part = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate(found)))
            first = [min(len(s), len(s) - math.ceil(threshold * len(s) - 1e-9) + 1) for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(np.ascontiguousarray(digests[:, k])) for k in (0, 1)), pa.array([len(s) for s in found], pa.int32()), pa.array([print_of(h) for h in hashes], pa.int64()), pa.array([parity_sign(s) for s in found], pa.list_(pa.int64())), part, pa.array(first, pa.int32())],
                names=_NAMES,
            )
            held += found
            if sum(map(len, held)) >= BLOCK:
                yield from _filled(held)
                held = []
        if held:
            yield from _filled(held)

    return run


def _filled(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    batch = _repeated(found)
    if batch.num_rows:
        yield batch


def _ranked(repeated: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Elements of ``repeated(w1, n)``, ascending, and the rank of each, twice the binary logarithm of its number: those of the highest ranks, MOST_RANKED at most."""
    counted = keep(repeated.groupBy("w1").agg(F.sum("n").alias("n")).select("w1", F.least(F.floor(F.lit(2) * F.log2("n")), F.lit(126)).cast("long").alias("rank")))
    least, total = 127, 0
    for rank, n in sorted(((r["rank"], r["count"]) for r in counted.groupBy("rank").count().collect()), reverse=True):
        total += n
        if total > MOST_RANKED:
            break
        least = rank
    table = counted.where(F.col("rank") >= least).toArrow()
    values, ranks = (table.column(c).to_numpy() for c in ("w1", "rank"))
    drop(counted)
    order = np.argsort(values)
    return values[order], ranks[order]


def _prefixes(values: np.ndarray, ranks: np.ndarray):
    """``(node, n, part)`` of sets ``(key, part, first)``: the first elements by rank, without one before all others, and hash.

    An element of a prefix is its rank and 56 bits of its hash. Different ones that this makes equal only add pairs to verify.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, rows=4096, size=1 << 18, column="part"):
            sizes, first = (batch.column(1).value_lengths().to_numpy(), batch.column(2).to_numpy())
            ends, flat = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), batch.column(1).flatten().to_numpy()
            placed = (flat.view("<u8") >> np.uint64(8)).view("<i8")
            if len(values):
                at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
                placed |= np.where(values[at] == flat, ranks[at], 0) << 56
            for a, b in itertools.pairwise(ends.tolist()):
                placed[a:b].sort()
            inside = np.arange(len(flat)) - np.repeat(ends[:-1], sizes) < np.repeat(first, sizes)
            part = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(first))).astype(np.int32)), pa.array(placed[inside]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes.astype(np.int32)), part], names=["node", "n", "part"])

    return run


#: Rounds of meeting one node of each key before all nodes that are left meet.
ROUNDS = 6
def _alike(pairs: DataFrame, written: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs(a, b)`` of nodes that are similar, judged on the whole sets of ``written(key, part)``."""
    pairs = keep(pairs)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().select(F.col("node").alias("key"))
    sets = keep(with_keys(written, keep(wanted)).select(F.col("key").alias("node"), "part"))
    left, right = sets.select(F.col("node").alias("a"), F.col("part").alias("x")), sets.select(F.col("node").alias("b"), F.col("part").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    similar = common >= F.lit(threshold) * (F.size("x") + F.size("y") - common) - 1e-9
    # pairs and elements of prefixes are many times as large in memory as the files by which Spark sizes them: none is broadcast
    links = keep(pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(similar).select("a", "b"))
    drop(sets, pairs)
    return links


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: nodes whose fingerprints are equal or close, one node standing for all of a fingerprint."""
    heads = keep(nodes.groupBy("fp").agg(F.min("node").alias("head")))
    same = nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    near = close_pairs(heads.select("fp").repartition("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("head_a")), "a")
    near = near.join(heads.select(F.col("fp").alias("b"), F.col("head").alias("head_b")), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return same.union(near)


def similar_groups(rows: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``(key, component)`` of every row of ``rows(key, text)``, whose keys differ.

    Rows whose shingle sets have Jaccard similarity ``threshold`` or more are
    linked, wordless texts with each other; ``component`` is the smallest key
    that links reach.
    """
    every = keep(rows.select("key", "text").mapInArrow(_sets(words, threshold), _SCHEMA))
    prints = every.where("key is not null")
    sets = prints.select("key", "part")
    # equal sets, by 128 bits of digest, are one node under the smallest of their keys
    nodes = keep(prints.groupBy("w1", "w2").agg(F.min("key").alias("node"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("sign").alias("sign")))
    members = keep(prints.select("key", "w1", "w2").join(nodes.select("w1", "w2", "node"), ["w1", "w2"]).select("key", "node"))
    links = _alike(_simhash_pairs(nodes), sets, threshold)
    groups = connected_components(links)

    ranked = _ranked(every.where("key is null").select("w1", "n"))
    heads = keep(nodes.select(F.col("node").alias("key")))
    # sets are long: where nodes are too many to be sent, all rows get a prefix and the short prefixes move
    few = heads.count() <= MOST_SENT
    ordered = prints.select("key", "part", "first")
    ordered = (ordered.join(F.broadcast(heads), "key", "left_semi") if few else ordered).mapInArrow(_prefixes(*ranked), "node long, n int, part array<long>")
    parts = keep(ordered if few else ordered.join(heads.withColumnRenamed("key", "node"), "node", "left_semi"))
    keyed = parts.select("node", F.explode("part").alias("key"))
    # most shingles are in one document; what is dealt out for them is as slim as can be
    shared = keep(keyed.groupBy("key").count().where("count > 1").select("key"))
    held = keep(keyed.join(shared, "key"))
    drop(shared)
    place = (F.array_position("part", F.col("key")) - 1).cast("int").alias("place")
    met = keep(held.join(parts.hint("merge"), "node").select("key", "node", "n", place, (F.col("n") - F.size("part")).alias("rest"), F.element_at("part", -1).alias("last")))
    drop(held)

    def fits(n1: str, p1: str, n2: str, p2: str):
        small, large = F.least(n1, n2), F.greatest(n1, n2)
        need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col(n1) + F.col(n2)) - 1e-9)
        return (small >= F.lit(threshold) * large - 1e-9) & (F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2)) >= need)

    for turn in range(ROUNDS + 1):
        written = keep(met.join(groups, "node", "left").select("key", "node", "n", "place", "rest", "last", F.coalesce("component", "node").alias("group")))
        inside = written.groupBy("key", "group").agg(F.count("*").alias("n"))
        apart = inside.groupBy("key").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same")).where("all * all > same")
        open_ = keep(apart.select("key", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("pairs"), "all"))
        left = open_.agg(F.sum("pairs").alias("pairs"), F.sum("all").alias("rows")).first()
        placed = written.join(open_.select("key"), "key", "left_semi")
        if turn == ROUNDS or (left["pairs"] or 0) <= 2 * (left["rows"] or 0):
            break
        # each node meets one of its key's; another one each time, so that near copies of one text soon are one group
        draw = F.xxhash64(F.lit(turn), "node")
        heads = placed.groupBy("key").agg(*(F.min_by(c, draw).alias(f"head_{c}") for c in ("node", "n", "place", "group")))
        first = placed.join(heads, "key").where((F.col("group") != F.col("head_group")) & fits("n", "place", "head_n", "head_place"))
        fresh = _alike(first.select(F.col("head_node").alias("a"), F.col("node").alias("b")).distinct(), sets, threshold)
        if fresh.isEmpty() and turn:
            break
        drop(written)
        links = keep(links.union(fresh))
        groups = connected_components(links)

    placed = keep(placed.join(nodes.select("node", *(F.get("sign", F.lit(i)).alias(f"s{i}") for i in range(SIGN))).hint("merge"), "node"))
    fields = ("node", "n", "rest", "last", "group", *(f"s{i}" for i in range(SIGN)))
    a, b = (placed.select("key", *(F.col(c).alias(f"{c}_{side}") for c in fields)) for side in "ab")
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    apart = sum((F.bit_count(F.col(f"s{i}_a").bitwiseXOR(F.col(f"s{i}_b"))) for i in range(SIGN)), F.lit(0))
    close = apart <= small + large - 2 * F.ceil(F.lit(threshold / (1 + threshold)) * (small + large) - 1e-9)
    met_across = a.join(b, "key").where((F.col("node_a") < F.col("node_b")) & (F.col("group_a") != F.col("group_b")) & (small >= F.lit(threshold) * large - 1e-9) & close)
    # the prefix that ends first is whole below the other's end: beyond the shared elements only its set's rest is open
    rest = F.when(F.col("last_a") < F.col("last_b"), F.col("rest_a")).when(F.col("last_a") > F.col("last_b"), F.col("rest_b")).otherwise(F.greatest("rest_a", "rest_b"))
    room = F.min(rest) + F.count("*")
    need = F.min(F.ceil(F.lit(threshold / (1 + threshold)) * (small + large) - 1e-9))
    counted = met_across.groupBy("node_a", "node_b").agg(room.alias("room"), need.alias("need")).where("room >= need")
    across = counted.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    links = links.union(_alike(across, sets, threshold))
    drop(every)
    groups = connected_components(links)

    return members.join(groups, "node", "left").select("key", F.coalesce("component", "node").alias("component"))


def keep_first_of_similar(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar ones: the first by id, rows without an id last."""
    keyed = keyed_rows(docs)
    texts = keyed.rows.select("key", F.col("row.text").alias("text"))
    return first_of_groups(keyed, settled(lambda: similar_groups(texts, words, threshold)))
