"""Removal of byte strings that repeat anywhere in a collection of documents.

Every string of ``length`` bytes holds the smallest hash of its ``gram``-byte
substrings, so two equal strings hold equal grams at equal places: these grams
are the anchors. Anchors that occur once in the collection cannot lie in a
repeat. Around each other anchor lies its context, the bytes of all strings of
``length`` that contain it. Anchors with the same context repeat all of it, as
a hash of the context shows; one of them stands for all from there on, and
only where a gram has different contexts do bytes go to the task of the gram.

There the contexts are a small collection of documents, and its suffix order
is built column by column from the right: each round inserts one symbol of
every context, sorts stably by that symbol (which turns the order of the
suffixes one symbol shorter into the order of the new ones) and carries the
array of common prefixes along. Neighbours with a common prefix of ``length``
or more start equal strings. A round reads its two arrays front to back.

A gram with very many different contexts gives way to longer grams: of the
bytes of a string beside the gram, at least half stand on one side of it, so
the gram and those bytes are a gram of two groups that are each half as wide.

Inserting whole documents would take a round for each byte of the longest
document over the whole collection; contexts bound the rounds by
2 * length - gram and split the collection into independent tasks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from barloom.llm.rows import with_keys
from barloom.llm.scratch import drop, keep

LENGTH, GRAM = 400, 100
#: Different contexts of one gram in one task; a gram with more gives way to longer ones.
SPLIT = 4096
#: Contexts ordered at once; groups are never cut.
BATCH = 4096
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 22
_PLACE = np.uint64((1 << 24) - 1)
_powers: list[np.ndarray] = []


def _power_table(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < size:
        size = max(size, 1 << 16)
        ones = np.full(size, _BASE, dtype=np.uint64)
        back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        ones[0] = back[0] = 1
        _powers[:] = [np.multiply.accumulate(ones), np.multiply.accumulate(back)]
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on."""
    n = len(data)
    up, down = _power_table(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return _mixed((sums[gram:] - sums[: n - gram + 1]) * down[: n - gram + 1])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of a document, the leftmost of equal ones."""
    width, places, hashes = length - gram + 1, [], []
    for at in range(0, max(0, len(data) - length) + 1, _PIECE):
        part = np.frombuffer(data, dtype=np.uint8)[at : at + _PIECE + length - 1]
        if len(part) < length:
            continue
        h = gram_hashes(part, gram)
        keys = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        blocks = -(-len(keys) // width)
        padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keys)] = keys
        grid = padded.reshape(blocks, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(keys) - width + 1
        least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _PLACE
        chosen = least[np.concatenate(([True], least[1:] != least[:-1]))].astype(np.int64)
        places.append(chosen + at)
        hashes.append(h[chosen].view(np.int64))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def columnwise_order(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Suffix order of equally long rows, one column more in each round, from the last to the first.

    Yields ``(column, order, common)``: the rows sorted by what stands from
    ``column`` on, and the common prefix of each with the one before it (0 for
    the first).
    """
    rows, columns = matrix.shape
    order, common = np.arange(rows), np.zeros(rows + 1, dtype=np.int32)
    turned = np.ascontiguousarray(matrix.T)
    for column in range(columns - 1, -1, -1):
        symbol = turned[column][order]
        move = np.argsort(symbol, kind="stable")
        sorted_symbol = symbol[move]
        same = sorted_symbol[1:] == sorted_symbol[:-1]
        # between two rows with the same symbol: the least common prefix of those passed over
        spans = np.empty(2 * (rows - 1), dtype=np.int64)
        spans[0::2], spans[1::2] = move[:-1] + 1, move[1:] + 1
        backward = spans[0::2] > spans[1::2]
        spans[0::2][backward] = spans[1::2][backward]
        # the first round compares empty suffixes, which are all equal
        least = np.minimum.reduceat(common, spans)[0::2] if rows > 1 else common[:0]
        fresh = np.zeros(rows + 1, dtype=np.int32)
        fresh[1:rows] = np.where(same, least + 1, 0)
        order, common = order[move], fresh
        yield column, order, common[:rows]


def _ordered_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of a gram, BATCH rows or a little more at a time; the input is sorted by the gram."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < BATCH:
            continue
        table = pa.Table.from_batches(held)
        gram = table.column("gram").to_numpy()
        ends = np.flatnonzero(gram[1:] != gram[:-1]) + 1
        start = 0
        while (later := ends[ends >= start + BATCH]).size:
            yield table.slice(start, int(later[0]) - start)
            start = int(later[0])
        held, rows = table.slice(start).to_batches(), table.num_rows - start
    if rows:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts as rows with the anchors in one column, and the columns that each one fills.

    Other columns hold 255, which no UTF-8 text has.
    """
    lead = length - gram
    texts = table.column("context").to_pylist()
    left = table.column("lead").to_numpy().astype(np.int64)
    matrix = np.full((len(texts), 2 * length - gram), 255, dtype=np.uint8)
    first = lead - left
    last = first.copy()
    for i, text in enumerate(texts):
        matrix[i, first[i] : first[i] + len(text)] = np.frombuffer(text, dtype=np.uint8)
        last[i] += len(text)
    return matrix, first, last


def _repeats(length: int, gram: int):
    """``(doc, lo, hi)``: the bytes of each context that repeated strings around its anchor cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = length - gram
        for table in _ordered_groups(batches):
            matrix, first, last = _matrix(table, length, gram)
            low, high = np.full(len(matrix), lead + 1), np.full(len(matrix), -1)
            for column, order, common in columnwise_order(matrix):
                if column > lead:
                    continue
                match = np.flatnonzero(common >= length)
                rows = np.concatenate((order[match], order[match - 1]))
                rows = rows[(first[rows] <= column) & (last[rows] >= column + length)]
                low[rows] = column
                high[rows] = np.maximum(high[rows], column)
            hit = np.flatnonzero(high >= 0)
            at = table.column("place").to_numpy().astype(np.int64)[hit] - lead
            yield pa.RecordBatch.from_arrays(
                [table.column("doc").combine_chunks().take(pa.array(hit)), pa.array(at + low[hit]), pa.array(at + high[hit] + length)],
                names=["doc", "lo", "hi"],
            )

    return run


def _rows_in_batches(rows: Iterator[tuple], kinds: tuple, names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def _contexts(length: int, gram: int):
    """``(gram, doc, place, lead, context)`` of the marks ``(place, gram)`` of every text."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, doc in enumerate(batch.column(0).to_pylist()):
                text = texts[i].as_py()
                for m in batch.column(2)[i].as_py():
                    at, left = m["place"], min(m["place"], length - gram)
                    yield m["gram"], doc, at, left, text[at - left : at + length]

    return lambda batches: _rows_in_batches(rows(batches), kinds, _CONTEXT_NAMES)


_CONTEXT_NAMES = ["gram", "doc", "place", "lead", "context"]
_CONTEXT = "gram long, doc long, place long, lead int, context binary"


def context_hash(context: bytes, lead: int) -> tuple[int, int]:
    """128 bits of a context and of where its gram stands, as two signed numbers."""
    return struct.unpack("<qq", xxhash.xxh3_128_digest(context, lead))


def _halves(length: int, gram: int, half: int):
    """The contexts of a gram as contexts of the two grams that are ``half`` bytes longer, with their hashes.

    The longer gram reaches ``half`` bytes on or begins ``half`` bytes
    before; contexts that hold no string of ``length`` around it drop out.
    """
    kinds, rest = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()), length - gram - half

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                for back in (0, half):
                    at = r["lead"] - back
                    begin, end = max(0, at - rest), min(len(r["context"]), at + length)
                    if at < 0 or at + gram + half > len(r["context"]) or end - begin < length:
                        continue
                    key = struct.unpack("<q", xxhash.xxh3_64_digest(r["context"][at : at + gram + half]))[0]
                    context = r["context"][begin:end]
                    yield key, r["doc"], r["place"] - back, at - begin, context, *context_hash(context, at - begin)

    return lambda batches: _rows_in_batches(rows(batches), kinds, [*_CONTEXT_NAMES, "w1", "w2"])


def _classes(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc, lo, hi)`` of contexts that repeat as a whole, and ``(gram, doc, place, n)``: one mark for each different context of the grams that have ``n`` > 1."""
    key = ["gram", "w1", "w2"]
    classes = keep(marks.groupBy(*key).agg(F.count("*").alias("copies"), F.min(F.struct("doc", "place")).alias("first")))
    whole = marks.join(classes.where("copies > 1").select(*key), key).select("doc", "lo", "hi")
    many = classes.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    return whole, classes.join(many, "gram").select("gram", "first.doc", "first.place", "n")


def _cut(with_kept: bool):
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary(), pa.string())
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in kinds]
            texts = batch.column(1).cast(pa.binary())
            for i, spans in enumerate(batch.column(2).to_pylist()):
                text, runs = texts[i].as_py() or b"", []
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or []):
                    if runs and lo <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], hi)
                    else:
                        runs.append([lo, hi])
                edges = [0, *(x for r in runs for x in r), len(text)]
                kept = b"".join(text[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                row = (len(text), len(text) - len(kept), runs, kept if with_kept else None, hashlib.sha256(kept).hexdigest())
                for column, value in zip(cols, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, spans, kept, kept_sha256)`` for every row of ``docs``.

    ``spans`` are the maximal runs of bytes that some string of ``length``
    bytes covers which also starts elsewhere, in this document or another;
    ``kept`` are the other bytes, concatenated (a cut may fall inside a
    character; null if ``with_kept`` is off). Null and empty texts have no
    bytes. Every row counts: rows that share an id, or have none, are rows of
    their own, so strings of ``length`` repeat among them if their texts have
    them. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    told = docs.select(doc_id).groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty()
    texts = docs.select((doc_id if told else F.monotonically_increasing_id()).alias("doc"), doc_id, F.col(text_col).alias("text"))
    if not told:  # rows are numbered, and the numbers written, so that they stay
        texts = keep(texts)
    lead = F.least("place", F.lit(length - gram))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "place", "gram", "size", "w1", "w2"]
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                places, grams = anchors(text, length, gram)
                begins = np.maximum(places - (length - gram), 0)
                sizes = np.minimum(places + length, len(text)) - begins
                hashes = b"".join(xxhash.xxh3_128_digest(text[b : b + n], p - b) for p, b, n in zip(places.tolist(), begins.tolist(), sizes.tolist(), strict=True))
                w = np.frombuffer(hashes, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(places), doc, np.int64)), pa.array(places.astype(np.int64)), pa.array(grams), pa.array(sizes, pa.int32()), *(pa.array(np.ascontiguousarray(w[:, k])) for k in (0, 1))],
                    names=names,
                )

    marks = keep(texts.select("doc", "text").where(F.octet_length("text") >= length).mapInArrow(find, "doc long, place long, gram long, size int, w1 long, w2 long"))
    shared = keep(marks.groupBy("gram").count().where("count > 1").select("gram"))
    used = keep(marks.join(shared, "gram", "left_semi"))
    drop(marks, shared)
    used = used.withColumn("lo", F.col("place") - lead).withColumn("hi", F.col("lo") + F.col("size"))

    dealt = texts.repartition(parts, "doc")

    def contexts_of(chosen: DataFrame, texts: DataFrame) -> DataFrame:
        lists = chosen.groupBy("doc").agg(F.collect_set(F.struct("place", "gram")).alias("marks"))
        return texts.join(lists, "doc").select("doc", "text", "marks").mapInArrow(_contexts(length, gram), _CONTEXT)

    def repeats_in(contexts: DataFrame, gram: int) -> DataFrame:
        grouped = contexts.repartition(parts, "gram").sortWithinPartitions("gram")
        return grouped.mapInArrow(_repeats(length, gram), "doc long, lo long, hi long")

    whole, different = _classes(used)
    different = keep(different)
    ranges = whole.unionByName(repeats_in(contexts_of(different.where(F.col("n") <= SPLIT), dealt), gram))
    hot = different.where(F.col("n") > SPLIT)
    if not hot.isEmpty():
        of_hot = with_keys(texts.withColumnRenamed("doc", "key"), keep(hot.select(F.col("doc").alias("key")).distinct())).withColumnRenamed("key", "doc")
        ranges = ranges.unionByName(_in_longer_grams(keep(contexts_of(hot, of_hot)), length, gram, repeats_in))
    spans = ranges.groupBy("doc").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    return dealt.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(
        _cut(with_kept), "doc_id long, n_bytes long, n_removed long, spans array<array<long>>, kept binary, kept_sha256 string"
    )


def _in_longer_grams(hot: DataFrame, length: int, gram: int, repeats_in: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``(doc, lo, hi)`` of repeats in contexts of grams that have too many of them; grams grow until none has."""
    found = []
    while not hot.isEmpty():
        half = (length - gram + 1) // 2
        # a place can come from two grams, with the same context
        narrow = keep(hot.mapInArrow(_halves(length, gram, half), f"{_CONTEXT}, w1 long, w2 long").dropDuplicates(["doc", "place"]))
        gram += half
        lo = F.col("place") - F.col("lead")
        slim = narrow.select("gram", "w1", "w2", "doc", "place", lo.alias("lo"), (lo + F.octet_length("context")).alias("hi"))
        whole, different = _classes(slim)
        different = keep(different)
        bytes_of = lambda chosen: narrow.drop("w1", "w2").join(chosen.select("gram", "doc", "place"), ["gram", "doc", "place"], "left_semi")  # noqa: B023, E731
        found += [keep(whole), keep(repeats_in(bytes_of(different.where(F.col("n") <= SPLIT)), gram))]
        hot = keep(bytes_of(different.where(F.col("n") > SPLIT)))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out
