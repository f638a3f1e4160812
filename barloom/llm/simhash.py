"""Near-duplicate documents by SimHash fingerprints.

Fingerprints are mapped to the bit counts of their 4-bit segments. A bit that
differs moves one count by one, so the Manhattan distance of two count vectors
never exceeds the Hamming distance of the fingerprints. Two vectors at
distance 2 or less have a grid point at distance 1 or less from both, hence
every fingerprint enters its own cell and the adjacent ones, and an equi-join
on the cell meets every pair. The fingerprints themselves then decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.components import connected_components
from barloom.llm.rows import first_of_groups, keyed_rows
from barloom.llm.scratch import keep

SEED = 42
SEGMENT_BITS = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def shingles_of(text: bytes, words: int) -> list[bytes]:
    """Shingles of UTF-8 ``text`` in order; a shorter text is one shingle."""
    tokens = text.translate(_LOWER).split()
    if not tokens:
        return []
    if len(tokens) < words:
        return [b" ".join(tokens)]
    return [b" ".join(s) for s in zip(*(tokens[i:] for i in range(words)), strict=False)]


def simhash(text: bytes, words: int) -> int:
    """Fingerprint of UTF-8 ``text`` as a signed 64-bit number."""
    return print_of(shingle_hashes(text, words))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """Hashes of all shingles of UTF-8 ``text``, repeats included."""
    shingles, digest, seed = shingles_of(text, words), xxhash.xxh64_intdigest, SEED
    return np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=len(shingles))


def print_of(hashes: np.ndarray) -> int:
    """Fingerprint of shingle hashes: the bits that more than half of them have."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)``: the fingerprint of every whole text.

    A-Z are lower-cased, words are runs of bytes other than ASCII white space,
    shingles of ``words`` words count as often as they occur; a shorter text is
    one shingle. Null and wordless texts have fingerprint 0. Rows with a null
    id and repeated rows are kept; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = pa.array([simhash(t or b"", words) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, "doc_id long, fp long")


def _cells(fp: Column) -> Column:
    """The cell of a fingerprint's segment counts and the adjacent cells.

    Each count, plus one so that no step borrows, takes four bits of the key.
    """
    key = F.lit(0).cast("long")
    for i in range(0, 64, SEGMENT_BITS):
        ones = F.bit_count(F.shiftrightunsigned(fp, i).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1)))
        key = key + F.shiftleft((ones + 1).cast("long"), i)
    steps = [0] + [s * (1 << i) for i in range(0, 60, SEGMENT_BITS) for s in (1, -1)] + [1 << 60, -(1 << 60)]
    return F.transform(F.array(*(F.lit(s).cast("long") for s in steps)), lambda s: s + key)


def close_pairs(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits."""
    if max_bits not in (0, 1, 2):
        raise ValueError("the grid join covers distances up to 2")
    cells = prints.select("fp", F.explode(_cells(F.col("fp"))).alias("cell"))
    left, right = cells.withColumnRenamed("fp", "a"), cells.withColumnRenamed("fp", "b")
    near = F.expr(f"a < b and bit_count(a ^ b) <= {max_bits}")
    # Spark sizes the cells as the prints before the explode, with a 33rd of their rows, and would broadcast them: they are shuffled at every size
    return left.join(right.hint("merge"), "cell").where(near).select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2
) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row for every row of ``docs``.

    ``component_id`` is the smallest id that is reachable over links, the
    document itself included. Equal fingerprints are one node of the graph,
    so copies never make pairs. An empty table gives an empty result; a group
    whose ids are all null has a null component.
    """
    prints = keep(fingerprints(docs, id_col, text_col, words))
    nodes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    groups = connected_components(close_pairs(nodes, max_bits))
    linked = groups.withColumnRenamed("node", "fp")
    placed = nodes.join(linked, "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("group"))
    placed = keep(placed)
    smallest = placed.groupBy("group").agg(F.min("first_id").alias("component_id"))
    classes = keep(placed.join(smallest, "group").select("fp", "component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_representatives(docs: DataFrame, words: int = 5, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group: the first by id, rows without an id last.

    Rows are told apart even if they share an id or have none.
    """
    keyed = keyed_rows(docs)
    found = near_duplicates(keyed.rows.select("key", F.col("row.text").alias("text")), "key", "text", words, max_bits)
    return first_of_groups(keyed, found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")))
