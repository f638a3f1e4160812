"""Best segmentations of many words at once.

The words stand in one array of characters. Every position walks down the
tree of pieces side by side with all others, which gives the edges of all
lattices; the forward Viterbi pass then goes from position to position, over
all words together, and keeps the two best scores into each.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from barloom.llm.pieces import Pieces

#: Below the lowest piece score: what one character without a piece costs.
UNKNOWN_PENALTY = 10.0
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class Found(NamedTuple):
    """Of each word: score, loss of the second best, number of ids, whether they decode; and all ids in a row."""

    score: np.ndarray
    loss: np.ndarray
    size: np.ndarray
    whole: np.ndarray
    ids: np.ndarray


class PieceWalk:
    """The tree of a model's pieces as a hash table of steps ``(node, character) -> node``."""

    def __init__(self, pieces: Pieces) -> None:
        #: What a character without a piece counts as; the character is added to it in the end.
        self.unknown = len(pieces.piece)
        self.byte_id = np.array(pieces.byte_id, dtype=np.int32)
        self.spells_bytes = len(set(pieces.byte_id)) == 256
        names = sorted(pieces.starts, key=len)
        node = {"": 0} | {name: i for i, name in enumerate(names, 1)}
        self.token = np.array([-1, *(pieces.starts[n] for n in names)], dtype=np.int64)
        self.score = np.array([*pieces.score, pieces.lowest - UNKNOWN_PENALTY])
        self.length = np.array([*map(len, pieces.piece), 1])
        self.text_at = np.concatenate(([0], np.cumsum(self.length)))
        self.text = np.frombuffer(("".join(pieces.piece) + "\0").encode("utf-32-le"), dtype="<u4")
        keys = np.array([node[n[:-1]] << 21 | ord(n[-1]) for n in names], dtype=np.uint64)
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = (1 << bits) - 1
        self._keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self._nodes = np.full(1 << bits, -1, dtype=np.int64)
        slots, values = self._slots(keys), np.arange(1, len(names) + 1)
        while len(keys):  # the first of those that want a free slot gets it, the others go on to the next
            free = self._nodes[slots] < 0
            _, first = np.unique(slots, return_index=True)
            won = np.zeros(len(keys), dtype=bool)
            won[first] = True
            won &= free
            self._keys[slots[won]], self._nodes[slots[won]] = keys[won], values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & self._mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> self._shift).astype(np.int64)

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The nodes one character on, -1 where no piece goes on so."""
        key = node.astype(np.uint64) << np.uint64(21) | code.astype(np.uint64)
        slot = self._slots(key)
        out = self._nodes[slot]
        open_ = np.flatnonzero((self._keys[slot] != key) & (out >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            out[open_] = self._nodes[slot[open_]]
            open_ = open_[(self._keys[slot[open_]] != key[open_]) & (out[open_] >= 0)]
        return out

    def edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(start, token)`` of every piece that stands at a position and ends by the ``ends`` of it, ordered by length."""
        at, node, starts, tokens, depth = np.arange(len(codes)), np.zeros(len(codes), np.int64), [], [], 0
        while len(at):
            node = self.step(node, codes[at + depth])
            live = node >= 0
            at, node = at[live], node[live]
            token = self.token[node]
            hit = token >= 0
            starts.append(at[hit])
            tokens.append(token[hit])
            depth += 1
            live = at + depth < ends[at]
            at, node = at[live], node[live]
        return np.concatenate(starts), np.concatenate(tokens)

    def best(self, words: list[str]) -> Found:
        """The best segmentations of ``words``, none of them empty."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        word = np.repeat(np.arange(len(words)), size)
        start, token = self.edges(codes, (first + size)[word])
        length = self.length[token]
        known = np.zeros(len(codes), dtype=bool)
        known[start[length == 1]] = True
        alone = np.flatnonzero(~known)
        if len(alone):
            start, token = np.concatenate((start, alone)), np.concatenate((token, np.full(len(alone), self.unknown)))
            length = self.length[token]

        # a slot for the place before each character and one for the end of each word
        slot = start + word[start]
        place = start - first[word[start]]
        order = np.argsort(place, kind="stable")
        slot, token, length = slot[order], token[order], length[order]
        bounds = np.searchsorted(place[order], np.arange(int(size.max()) + 1))
        least = float("-inf")
        best, second = np.full(len(codes) + len(words), least), np.full(len(codes) + len(words), least)
        by = np.zeros(len(best), dtype=np.int64)
        begin = first + np.arange(len(words))
        best[begin] = 0.0
        with np.errstate(invalid="ignore"):
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                s, t = slot[lo:hi], token[lo:hi]
                end, w = s + length[lo:hi], self.score[t]
                value, top = best[s] + w, best[end]
                better = value > top
                second[end] = np.maximum(np.where(better, top, np.maximum(second[end], value)), second[s] + w)
                best[end] = np.where(better, value, top)
                by[end] = np.where(better, t, by[end])
            last = begin + size
            score, loss = best[last], best[last] - second[last]

        rows, at, found = np.arange(len(words)), last, []
        while len(rows):
            t = by[at]
            bare = t == self.unknown
            if bare.any():
                t = np.where(bare, self.unknown + codes[np.minimum(at - 1 - rows, len(codes) - 1)].astype(np.int64), t)
            found.append((rows, t))
            at = at - np.where(bare, 1, self.length[np.minimum(t, self.unknown)])
            live = at > begin[rows]
            rows, at = rows[live], at[live]
        count = np.zeros(len(words), dtype=np.int64)
        for rows, _ in found:
            count[rows] += 1
        after = np.cumsum(count)
        ids = np.zeros(int(after[-1]), dtype=np.int64)
        for k, (rows, t) in enumerate(found):
            ids[after[rows] - 1 - k] = t
        whole = self._decode(ids, count, codes, size, first)
        if len(alone):
            ids, count = self._as_bytes(ids, count)
        return Found(score, loss, count, whole, ids.astype(np.int32))

    def _as_bytes(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece as the byte pieces of their UTF-8 form."""
        bare = np.flatnonzero(ids >= self.unknown)
        code = ids[bare] - self.unknown
        width = np.ones(len(ids), dtype=np.int64)
        width[bare] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out, end = np.repeat(ids, width), np.cumsum(width)
        raw = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        at = np.repeat((end - width)[bare] - (np.cumsum(width[bare]) - width[bare]), width[bare]) + np.arange(len(raw))
        out[at] = self.byte_id[np.frombuffer(raw, dtype=np.uint8)]
        return out, np.add.reduceat(width, np.cumsum(count) - count)

    def _decode(self, ids: np.ndarray, count: np.ndarray, codes: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether the texts of each word's ids, put together, are the word; bytes spell their character."""
        kind = np.minimum(ids, self.unknown)
        length = self.length[kind]
        ends = np.cumsum(length)
        text = self.text[np.repeat(self.text_at[kind] - (ends - length), length) + np.arange(int(ends[-1]))].copy()
        if self.spells_bytes:
            bare = np.flatnonzero(kind == self.unknown)
            text[ends[bare] - 1] = (ids[bare] - self.unknown).astype(np.uint32)
        spelled = np.add.reduceat(length, np.cumsum(count) - count)
        out = spelled == size
        same = np.zeros(len(codes), dtype=bool)
        same[np.repeat(out, size)] = codes[np.repeat(out, size)] == text[np.repeat(out, spelled)]
        return out & np.logical_and.reduceat(same, first)
