"""SentencePiece encoding with the N best segmentations, and decoding.

A chunk of text is a lattice whose edges are the pieces. The forward Viterbi
pass gives, at every position, the best score of any way to get there. Going
backward from the end, that score is the exact cost still ahead, so an A*
search over partial paths pops complete segmentations in order of score and
never expands a path that is not part of one of the best.

Chunks that no piece joins are lattices of their own, and a text's best
segmentations combine those of its chunks: a chunk outside the N - 1 with the
smallest loss between best and second best keeps its best segmentation in all
of the N best, so only those few chunks of a text need the search. The
forward pass keeps the two best scores into every position and so gives the
loss as well.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.parts import parts_of
from barloom.llm.piece_walk import UNKNOWN_PENALTY, PieceWalk
from barloom.llm.pieces import SPACE, Pieces, load_pieces

#: Words and chunks that each Python worker keeps at hand, none of them longer than LONG_WORD.
CACHED_WORDS, CACHED_CHUNKS, LONG_WORD = 200_000, 30_000, 64
#: Characters of new words that walk the tree at once: their edges take a few hundred bytes for each.
WALKED = 1 << 16


class WordRows:
    """What is known of words, as columns that grow; forgotten as a whole when there are too many."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self._parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        self._ids = 0

    def make_room(self) -> None:
        """Forget all words if there are more than CACHED_WORDS, or eight ids for each of those."""
        if len(self.at) > CACHED_WORDS or self._ids > 8 * CACHED_WORDS:
            self.__init__()

    def add(self, words: list[str], score: np.ndarray, loss: np.ndarray, size: np.ndarray, whole: np.ndarray, ids: np.ndarray) -> None:
        self.at.update(zip(words, range(len(self.at), len(self.at) + len(words)), strict=True))
        first = self._ids + np.cumsum(size) - size
        self._ids += len(ids)
        for part, column in zip(self._parts, (score, loss, size, whole, first, ids), strict=True):
            part.append(column)

    def columns(self) -> list[np.ndarray]:
        """``score, loss, size, whole, first, ids``: a row for each word, whose ids are ``size`` ones from ``first`` on."""
        for part in self._parts:
            if len(part) != 1:
                part[:] = [np.concatenate(part) if part else np.zeros(0, dtype=np.int64)]
        return [part[0] for part in self._parts]


class Encoded(NamedTuple):
    """Texts as ids: those of text k are ``ids[ends[k]:ends[k + 1]]``."""

    ids: np.ndarray
    ends: np.ndarray
    best: list[list[tuple[float, list]]]
    back: list[bool]

    def every_ids(self) -> pa.ListArray:
        """The ids of all N best segmentations of each text, best first."""
        parts, sizes = [np.zeros(0, dtype=np.int32)], []
        for lo, hi, best in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), self.best, strict=True):
            for _, changes in best:
                at, size = lo, hi - lo
                for start, dropped, put in sorted(changes):
                    parts += (self.ids[at : lo + start], np.array(put, dtype=np.int32))
                    at, size = lo + start + dropped, size + len(put) - dropped
                parts.append(self.ids[at:hi])
                sizes.append(size)
        flat = pa.array(np.concatenate(parts), pa.int32())
        each = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, self.best)]), pa.int32()), each)


def least_of(values: np.ndarray, n: int) -> list[int]:
    """Where the ``n`` smallest values are, the first of equal ones."""
    if len(values) > n > 0:
        bound = np.partition(values, n - 1)[n - 1]
        below = np.flatnonzero(values < bound)
        return [*below.tolist(), *np.flatnonzero(values == bound)[: n - len(below)].tolist()]
    return list(range(len(values))) if n > 0 else []


class Lattice:
    """N-best segmentation over the pieces of one model."""

    def __init__(self, pieces: Pieces, n: int) -> None:
        self.pieces, self.n = pieces, n
        self.walk = PieceWalk(pieces)
        self._first: dict[str, tuple[float, tuple[int, ...], float]] = {}
        self._nbest: dict[str, tuple[list[tuple[float, tuple[int, ...]]], bool]] = {}
        self._rows = WordRows()

    def _scan(self, chunk: str) -> tuple[list[tuple[int, int, float, int]], list[float], list[int]]:
        """All edges ``(start, end, score, id)`` by start, the best forward scores, and the best start of an edge into each position.

        For a look at short chunks: the search asks for the edges of the positions it visits. The id is -1 for a character without a piece.
        """
        starts, score, size = self.pieces.starts, self.pieces.score, len(chunk)
        ahead, back, edges = [float("-inf")] * (size + 1), [0] * (size + 1), []
        ahead[0] = 0.0
        for start in range(size):
            here, end = ahead[start], start + 1
            while end <= size:
                token = starts.get(chunk[start:end])
                if token is None:
                    break
                if token >= 0:
                    w = score[token]
                    edges.append((start, end, w, token))
                    if here + w > ahead[end]:
                        ahead[end], back[end] = here + w, start
                end += 1
            if chunk[start] not in self.pieces.ids:
                w = self.pieces.lowest - UNKNOWN_PENALTY
                edges.append((start, start + 1, w, -1))
                if here + w > ahead[start + 1]:
                    ahead[start + 1], back[start + 1] = here + w, start
        return edges, ahead, back

    def _forward(self, chunk: str) -> tuple[list[float], list[int], list[int], list[float]]:
        """For each position the best score of any way to it, start and id of the last edge of that way, and the best score with another last edge."""
        tree, size, none = self.pieces.tree, len(chunk), float("-inf")
        ahead, back, by, other = [none] * (size + 1), [0] * (size + 1), [-1] * (size + 1), [none] * (size + 1)
        ahead[0] = 0.0
        for start in range(size):
            here, node = ahead[start], tree
            entry = node.get(chunk[start])
            if entry is None or entry[0] < 0:
                value, end = here + self.pieces.lowest - UNKNOWN_PENALTY, start + 1
                if value > ahead[end]:
                    other[end], ahead[end], back[end], by[end] = ahead[end], value, start, -1
                elif value > other[end]:
                    other[end] = value
            for end in range(start, size):
                entry = node.get(chunk[end])
                if entry is None:
                    break
                token, w, node = entry
                if token >= 0:
                    value = here + w
                    if value > ahead[end + 1]:
                        other[end + 1], ahead[end + 1], back[end + 1], by[end + 1] = ahead[end + 1], value, start, token
                    elif value > other[end + 1]:
                        other[end + 1] = value
        return ahead, back, by, other

    def _edges_into(self, chunk: str, at: int, ahead: list[float]) -> list[tuple[float, int, float, int]]:
        """``(score of the best way through it, start, score, id)`` of the edges that end at ``at``, best first; the id is -1 for a character without a piece."""
        ids, score, out = self.pieces.ids, self.pieces.score, []
        for start in range(max(0, at - self.pieces.longest), at):
            token = ids.get(chunk[start:at])
            if token is not None:
                out.append((ahead[start] + score[token], start, score[token], token))
        if chunk[at - 1] not in ids:
            w = self.pieces.lowest - UNKNOWN_PENALTY
            out.append((ahead[at - 1] + w, at - 1, w, -1))
        out.sort(key=lambda e: (-e[0], e[1]))
        return out

    def _ids(self, chunk: str, start: int, end: int, token: int) -> tuple[int, ...]:
        return (token,) if token >= 0 else tuple(self.pieces.fallback(chunk[start:end]))

    def chunk_viterbi(self, chunk: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of the best segmentation of a chunk, and the loss of the second best.

        One forward pass keeps the two best scores into every position.
        """
        found = self._first.get(chunk)
        if found is not None:
            return found
        tree, size, none = self.pieces.tree, len(chunk), float("-inf")
        best, second, back, by = [none] * (size + 1), [none] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        for start in range(size):
            here, other, node = best[start], second[start], tree
            entry = node.get(chunk[start])
            if entry is None or entry[0] < 0:  # the character has no piece
                value, end = here + self.pieces.lowest - UNKNOWN_PENALTY, start + 1
                if value > best[end]:
                    second[end], best[end], back[end], by[end] = best[end], value, start, -1
                elif value > second[end]:
                    second[end] = value
                if other + value - here > second[end]:
                    second[end] = other + value - here
            for end in range(start, size):
                entry = node.get(chunk[end])
                if entry is None:
                    break
                token, w, node = entry
                if token >= 0:
                    value = here + w
                    if value > best[end + 1]:
                        second[end + 1], best[end + 1], back[end + 1], by[end + 1] = best[end + 1], value, start, token
                    elif value > second[end + 1]:
                        second[end + 1] = value
                    if other + w > second[end + 1]:
                        second[end + 1] = other + w
        ids, at = [], size
        while at:
            ids.append(self._ids(chunk, back[at], at, by[at]))
            at = back[at]
        found = (best[size], tuple(chain.from_iterable(reversed(ids))), best[size] - second[size])
        if size <= LONG_WORD:
            if len(self._first) >= CACHED_CHUNKS:
                self._first.clear()
            self._first[chunk] = found
        return found

    def chunk_best(self, chunk: str) -> tuple[list[tuple[float, tuple[int, ...]]], bool]:
        """Up to N segmentations of a chunk as ``(score, ids)``, best first, and whether all of them decode to it.

        The first is the one that ``chunk_viterbi`` gives; other equal scores
        are in the order in which the search meets them. The queue holds no
        more partial paths than segmentations are still wanted, and a path is a
        chain of edges, so memory is linear in the chunk.
        """
        found = self._nbest.get(chunk)
        if found is not None:
            return found
        (ahead, back, by, other), out = self._forward(chunk), []
        unknown = self.pieces.lowest - UNKNOWN_PENALTY
        # what a search pops: the rank, its turn, the end of a text in reverse (a chain of edges) with its score, and the edge into its first position to go on with
        queue, turn = [(-ahead[-1], 0, None, 0.0, len(chunk), 0)], count(1)
        while queue and len(out) < self.n:
            rank, _, tail, done, at, k = heapq.heappop(queue)
            if k:  # the next best edge
                ways = self._edges_into(chunk, at, ahead)
                if k + 1 < len(ways):
                    queue.append((-(ways[k + 1][0] + done), next(turn), tail, done, at, k + 1))
                _, start, w, token = ways[k]
                tail, done, at = (start, at, token, tail), done + w, start
            apart = []
            while at:  # the best edges on keep the rank, so the search goes straight on; it may come back to the next best of each
                if other[at] > float("-inf"):
                    apart.append((-(other[at] + done), next(turn), tail, done, at, 1))
                    if len(apart) > 8 * self.n:
                        apart = heapq.nsmallest(self.n, apart)
                tail, done, at = (back[at], at, by[at], tail), done + (self.pieces.score[by[at]] if by[at] >= 0 else unknown), back[at]
            ids = []
            while tail:
                start, end, token, tail = tail
                ids += self._ids(chunk, start, end, token)
            out.append((-rank, tuple(ids)))
            queue = heapq.nsmallest(self.n - len(out), chain(queue, apart))  # each gives one segmentation; sorted is a heap
        score, first, _ = self.chunk_viterbi(chunk)
        options = [(score, first), *[x for x in out if x[1] != first]][: self.n]
        found = options, all("".join(decode_pieces(self.pieces, ids)) == chunk for _, ids in options)
        if len(chunk) <= LONG_WORD:
            if len(self._nbest) >= CACHED_CHUNKS:
                self._nbest.clear()
            self._nbest[chunk] = found
        return found

    def _word_best(self, word: str) -> tuple[float, tuple[int, ...], float, bool]:
        """Of a word: score and ids of the best, the least loss of its chunks, and whether it decodes; chunk by chunk."""
        parts = [self.chunk_viterbi(c) for c in self.pieces.chunks(word)]
        ids = tuple(chain.from_iterable(p[1] for p in parts))
        whole = "".join(decode_pieces(self.pieces, ids)) == word
        return sum(p[0] for p in parts), ids, min(p[2] for p in parts), whole

    def _learn(self, words: list[str]) -> None:
        """Give every one of the distinct new ``words`` a row."""
        short = [w for w in words if len(w) <= LONG_WORD]
        turn = np.cumsum([len(w) for w in short], dtype=np.int64) // WALKED
        cuts = np.flatnonzero(np.diff(turn, prepend=-1, append=-1))  # where each turn begins, and the end
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self._rows.add(short[lo:hi], *self.walk.best(short[lo:hi]))
        long = [w for w in words if len(w) > LONG_WORD]
        if long:
            found = [self._word_best(w) for w in long]
            self._rows.add(
                long, *(np.array([f[k] for f in found]) for k in (0, 2)), np.array([len(f[1]) for f in found]), np.array([f[3] for f in found]),
                np.fromiter(chain.from_iterable(f[1] for f in found), dtype=np.int32),
            )

    def _losses(self, word: str, at: int) -> list[tuple[float, int, str]]:
        """``(loss, position in the ids, chunk)`` of the chunks of a word that has its ids from ``at`` on."""
        out = []
        for chunk in self.pieces.chunks(word):
            _, ids, loss = self.chunk_viterbi(chunk)
            if loss < float("inf"):
                out.append((loss, at, chunk))
            at += len(ids)
        return out

    def encode(self, texts: list[str]) -> Encoded:
        """All ``texts`` at once: ids in a row with their ends, N best segmentations, and whether all of them decode to the text."""
        rows = self._rows
        rows.make_room()
        words = [self.pieces.words(t) for t in texts]
        ends = np.cumsum([len(w) for w in words], dtype=np.int64)
        every = list(chain.from_iterable(words))
        at = list(map(rows.at.get, every))
        fresh = [k for k, row in enumerate(at) if row is None]
        if fresh:
            self._learn(list(dict.fromkeys(every[k] for k in fresh)))
            for k in fresh:
                at[k] = rows.at[every[k]]
        at = np.array(at, dtype=np.int64)
        score, loss, size, whole, first, ids = rows.columns()
        score, loss, size, whole = score[at], loss[at], size[at], whole[at]
        after = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.repeat(first[at] - after[:-1], size) + np.arange(int(after[-1]))]
        best, back, lo = [], [], 0
        for text, of, hi in zip(texts, words, ends.tolist(), strict=True):
            few = least_of(loss[lo:hi], self.n - 1)
            losses = [x for i in few for x in self._losses(of[i], int(after[lo + i] - after[lo]))]
            combined, decoded = self._combine(float(score[lo:hi].sum()), losses)
            best.append(combined)
            # the words decode, and only U+2581 is lost between them
            back.append(bool(whole[lo:hi].all()) and decoded and SPACE not in text)
            lo = hi
        return Encoded(flat, after[np.concatenate(([0], ends))], best, back)

    def best(self, text: str) -> tuple[list[int], list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        """The best ids of ``text`` and its N best segmentations.

        Each segmentation is its score and its changes against the best:
        ``(position in the best ids, ids dropped, ids put there)``.
        """
        found = self.encode([text])
        return found.ids.tolist(), found.best[0]

    def _combine(self, score: float, losses: list[tuple[float, int, str]]) -> tuple[list[tuple[float, list]], bool]:
        """The N best of a text from its best score and the chunks with the least ``losses``, and whether what those chunks become decodes.

        No other chunk is changed by any of the N best.
        """
        combined: list[tuple[float, list]] = [(score, [])]
        decoded = True
        for _, offset, chunk in heapq.nsmallest(self.n - 1, losses):
            options, whole = self.chunk_best(chunk)
            decoded = decoded and whole
            top, first = options[0]
            grown = [
                (score - (top - alt), changes if k == 0 else [*changes, (offset, len(first), put)])
                for score, changes in combined
                for k, (alt, put) in enumerate(options)
            ]
            combined = heapq.nsmallest(self.n, grown, key=lambda x: -x[0])
        return combined, decoded

    def apply(self, ids: list[int], changes: list[tuple[int, int, tuple[int, ...]]]) -> list[int]:
        """The ids of one of the N best segmentations."""
        out = list(ids)
        for at, dropped, put in sorted(changes, reverse=True):
            out[at : at + dropped] = put
        return out


def decode_pieces(pieces: Pieces, ids: tuple[int, ...] | list[int]) -> list[str]:
    """The escaped text of ``ids`` in parts; bytes that follow each other are one part."""
    out, raw, byte_of = [], bytearray(), _bytes_of(pieces)
    for i in ids:
        b = byte_of.get(i)
        if b is not None:
            raw.append(b)
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(pieces.piece[i])
    out.append(raw.decode("utf-8", "replace"))
    return out


def decode_ids(pieces: Pieces, ids: list[int]) -> str:
    """The text of ``ids``: the exact inverse of encoding."""
    return "".join(decode_pieces(pieces, ids)).replace(SPACE, " ")[1:]


def _bytes_of(pieces: Pieces) -> dict[int, int]:
    found = getattr(pieces, "_bytes_of", None)
    if found is None:
        found = pieces._bytes_of = {i: b for b, i in enumerate(pieces.byte_id)}
    return found


@lru_cache(maxsize=4)
def load_lattice(model_file: str, n: int) -> Lattice:
    return Lattice(load_pieces(model_file), n)


ENCODED = "doc_id long, n_tokens int, token_ids array<int>, best_score double, nbest_scores array<double>, nbest_tokens array<int>, nbest_ids array<array<int>>, round_trip boolean"


def encode_documents(docs: DataFrame, model_file: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every whole text as the ids of its best segmentation, with the N best beside it.

    Returns ``doc_id``, ``n_tokens``, ``token_ids`` (best segmentation),
    ``best_score``, ``nbest_scores``, ``nbest_tokens`` and ``nbest_ids``
    (scores, lengths and ids of the N best, best first; fewer where the text
    has fewer), and ``round_trip``: decoding any of them gives the text again.
    The model reads U+2581 as a space, so it is the one character that does
    not come back. Null and empty texts have no ids and one empty segmentation
    of score 0. Repeated rows and null ids are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = load_lattice(model_file, n)
        for batch in parts_of(batches):
            found = lattice.encode([t or "" for t in batch.column(1).to_pylist()])
            tops, every = [[s for s, _ in best] for best in found.best], found.every_ids()
            sizes = pa.ListArray.from_arrays(every.offsets, every.values.value_lengths())
            ids = pa.ListArray.from_arrays(pa.array(found.ends.astype(np.int32)), pa.array(found.ids, pa.int32()))
            arrays = [
                pa.array(np.diff(found.ends), pa.int32()), ids, pa.array([t[0] for t in tops], pa.float64()), pa.array(tops, pa.list_(pa.float64())),
                sizes, every, pa.array(found.back, pa.bool_()),
            ]
            names = ["doc_id", "n_tokens", "token_ids", "best_score", "nbest_scores", "nbest_tokens", "nbest_ids", "round_trip"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ENCODED)


def nbest_segmentations(docs: DataFrame, model_file: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, place, score, token_ids)``: each of the N best segmentations as a row, ``place`` from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = load_lattice(model_file, n)
        for batch in parts_of(batches):
            for doc_id, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids, best = lattice.best(text or "")
                rows = [(k, s, lattice.apply(ids, c)) for k, (s, c) in enumerate(best, 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id.as_py()] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                     pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                    names=["doc_id", "place", "score", "token_ids"],
                )

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return picked.mapInArrow(run, "doc_id long, place int, score double, token_ids array<int>")


def decode_documents(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """``(doc_id, text)`` from token ids; null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_pieces(model_file)
        for batch in parts_of(batches):
            texts = [decode_ids(pieces, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col)).mapInArrow(run, "doc_id long, text string")
