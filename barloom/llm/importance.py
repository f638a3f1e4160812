"""Importance resampling towards a target distribution, by hashed word n-grams.

A batch's texts are joined with a separator sentinel, one pass of a regular
expression finds the words of all of them, and the offsets of the documents,
searched in sorted order, tell which n-grams would cross from one document to
the next. What stays is hashed and counted as arrays, never as strings.

A bucket gains the logarithm of its share in the target over its share in the
corpus. A document weighs the mean gain of its features; Gumbel noise from a
hash of its id turns the highest scores into a draw without replacement in
proportion to the exponential of the weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barloom.llm.rows import keyed_rows, with_keys
from barloom.llm.scratch import keep

#: Digits, small letters and all that is not ASCII, as UTF-8; capitals are made small first.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SENTINEL = b"\x00"
#: Bytes of text in one join; a longer text is one by itself.
CHUNK = 4 << 20
#: Words of more bytes are hashed one by one.
LONGEST = 64
FULL = np.uint32(0xFFFFFFFF)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The table of CRC-32, and ``shift[n, k, b]``: byte k of a checksum, of value b, moved over n bytes that follow."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    shift = np.empty((LONGEST + 1, 4, 256), np.uint32)
    shift[0] = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    for n in range(LONGEST):
        shift[n + 1] = table[shift[n] & 255] ^ (shift[n] >> 8)
    return table, shift


def _word_checksums(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-32 of every word, a byte of all words at a time, longest words first."""
    table, _ = _tables()
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(-np.minimum(sizes, LONGEST + 1).astype(np.int8), kind="stable")
    long = int((sizes > LONGEST).sum())
    for w in order[:long]:
        out[w] = zlib.crc32(data[starts[w] : starts[w] + sizes[w]])
    rest = order[long:]
    at, left = starts[rest], sizes[rest]
    raw, buffer = np.full(len(rest), FULL), np.frombuffer(data, np.uint8)
    live = np.searchsorted(-left, -np.arange(left[0] if len(left) else 0), side="left")  # words of more than 0, 1, 2 ... bytes
    for n, m in enumerate(live):
        raw[:m] = table[(raw[:m] ^ buffer[at[:m] + n]) & 255] ^ (raw[:m] >> 8)
    out[rest] = raw ^ FULL
    return out


def _followed(first: np.ndarray, data: bytes, starts: np.ndarray, sizes: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Checksums of texts with checksum ``first``, a space, and words with checksum ``second``."""
    table, shift = _tables()
    raw = first ^ FULL
    spaced = table[(raw ^ 32) & 255] ^ (raw >> 8) ^ FULL
    n = np.minimum(sizes, LONGEST)
    out = second.copy()
    for k in range(4):
        out ^= shift[n, k, (spaced >> np.uint32(8 * k)) & 255]
    for i in np.flatnonzero(sizes > LONGEST):
        out[i] = zlib.crc32(data[starts[i] : starts[i] + sizes[i]], int(spaced[i]))
    return out


def ngrams(texts: list[bytes | None], most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, documents, checksums)``: words of each text, and for each n-gram of 1 to ``most_words`` words its text's number and CRC-32."""
    data = SENTINEL.join([t or b"" for t in texts]).lower()
    offsets = np.cumsum([0] + [len(t or b"") + 1 for t in texts[:-1]])
    spans = np.fromiter(chain.from_iterable(map(re.Match.span, WORD.finditer(data))), np.int64).reshape(-1, 2)
    starts, sizes = spans[:, 0], spans[:, 1] - spans[:, 0]
    of = np.searchsorted(offsets, starts, side="right") - 1
    words = _word_checksums(data, starts, sizes)
    run, runs, owners = words, [words], [of]
    for n in range(1, most_words):
        inside = of[n:] == of[:-n]  # else the run goes on in another text
        run = _followed(run[: len(inside)], data, starts[n:], sizes[n:], words[n:])
        runs.append(run[inside])
        owners.append(of[n:][inside])
    return np.bincount(of, minlength=len(texts)), np.concatenate(owners), np.concatenate(runs)


def _joins(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """The texts of a batch by runs of about CHUNK bytes, each with the number of its first row."""
    texts = column.cast(pa.large_binary())
    begin, size = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if size + (n or 0) > CHUNK and i > begin:
            yield begin, texts[begin:i].to_pylist()
            begin, size = i, 0
        size += n or 0
    if len(texts) > begin:
        yield begin, texts[begin:].to_pylist()


def bucket_counts(texts: DataFrame, text_col: str = "text", most_words: int = 2, buckets: int = 10000) -> DataFrame:
    """``(bucket, n)``: how many n-grams of all texts fall into each bucket; every task sends one row for each bucket it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in _joins(batch.column(0)):
                total += np.bincount(ngrams(part, most_words)[2] % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], ["bucket", "n"])

    return texts.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """A thousandth's logarithm of how much likelier each bucket is in the target, smoothed by one; two rows a bucket come to the driver."""
    counts = np.zeros((2, buckets), np.int64)
    both = corpus.withColumn("side", F.lit(0)).unionByName(target.withColumn("side", F.lit(1)))
    for r in both.collect():
        counts[r["side"], r["bucket"]] = r["n"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.array(
        [math.floor(1000 * math.log(float((int(b) + 1) * (int(all_s) + buckets)) / float((int(a) + 1) * (int(all_t) + buckets)))) for a, b in zip(s, t, strict=True)], np.int64
    )


def _weighed(rows: DataFrame, gain: np.ndarray, most_words: int) -> DataFrame:
    """``rows(key, id, text)`` as ``(key, id, n_words, n_features, weight)``."""
    shared = rows.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for begin, part in _joins(batch.column(2)):
                words, owners, sums = ngrams(part, most_words)
                features = np.bincount(owners, minlength=len(part))
                # sums of whole numbers are exact in doubles
                total = np.bincount(owners, weights=gain[sums % np.uint32(len(gain))], minlength=len(part)).astype(np.int64)
                mean = np.where(features > 0, total // np.maximum(features, 1), 0)
                ids = batch.slice(begin, len(part))
                columns = [ids.column(0), ids.column(1), pa.array(words.astype(np.int64)), pa.array(features.astype(np.int64)), pa.array(mean)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(weigh, "key long, id long, n_words long, n_features long, weight long")


def gumbel_noise(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from a hash of the id; a null id counts as the text ``null``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def _scored(rows: DataFrame, target: DataFrame, text_col: str, most_words: int, buckets: int, seed: int) -> DataFrame:
    gain = gains(bucket_counts(rows, "text", most_words, buckets), bucket_counts(target, text_col, most_words, buckets), buckets)
    return keep(_weighed(rows, gain, most_words).withColumn("score", F.col("weight") + gumbel_noise(F.col("id"), seed)))


def _ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """``scored`` with ``rank``: places of the drawn rows, null elsewhere.

    Scores are whole numbers that lie within some 110,000 of each other (gains
    are thousandths of logarithms of counts, noise those of a 32-bit hash), so
    their counts come to the driver, and each score's rows are placed among
    themselves.
    """
    able = F.col("n_words") >= least_words
    by_score = sorted(((r["score"], r["n"]) for r in scored.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = share * sum(n for _, n in by_score) // 100
    before, cut, offsets = 0, None, []
    for score, n in by_score:
        if before >= drawn:
            break
        offsets.append((score, before))
        before, cut = before + n, score
    nobody = F.lit(None).cast("long")
    if cut is None:
        return scored.withColumn("rank", nobody)
    placed = scored.sparkSession.createDataFrame(offsets, "score long, above long")
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "n_words", "key"))
    chosen = scored.where(able & (F.col("score") >= cut)).withColumn("place", within).join(F.broadcast(placed), "score")
    rank = F.col("above") + F.col("place")
    chosen = chosen.select(*scored.columns, F.when(rank <= drawn, rank).alias("rank"))
    return chosen.unionByName(scored.where(~able | (F.col("score") < cut)).withColumn("rank", nobody))


def resampling_report(
    docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, most_words: int = 2, buckets: int = 10000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)``: one row for every row of ``docs``.

    Counts are over all rows of ``docs`` and of ``target``. ``share`` percent
    (rounded down) of the rows with at least ``least_words`` words are drawn,
    highest score first, ties to the smaller id, nulls last. A null or wordless
    text has no features and weight 0. Rows under one id are rows of their own
    with the same noise. Empty tables count as zeros; without documents the
    result is empty.
    """
    rows = docs.select(F.lit(0).cast("long").alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ranked = _ranked(_scored(rows, target, text_col, most_words, buckets, seed), share, least_words)
    return ranked.select(F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", "rank")


def resampled_documents(
    docs: DataFrame, target: DataFrame, share: int = 25, least_words: int = 20, most_words: int = 2, buckets: int = 10000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns; see ``resampling_report``."""
    keyed = keyed_rows(docs, id_col)
    rows = keyed.rows.select("key", F.col(f"row.{id_col}").cast("long").alias("id"), F.col(f"row.{text_col}").alias("text"))
    ranked = _ranked(_scored(rows, target, text_col, most_words, buckets, seed), share, least_words)
    return with_keys(keyed.rows, keep(ranked.where("rank is not null").select("key"))).select("row.*")
