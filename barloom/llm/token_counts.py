"""Exact token counts of every prefix of a text, by prefix dynamic programming.

Byte-pair merging gives every string one token sequence, and a sequence is
the one of its string exactly if every two neighbours in it are the sequence
of their own concatenation. Hence the last token of a prefix is the only
token ending there that follows the last token of the shorter prefix in such
a valid pair, and

    count(prefix) = count(prefix without its last token) + 1.

A table of the last token and the count at each prefix answers how many
tokens a text cut at any character has, and where to cut for a budget of
tokens, without another encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barloom.llm.pieces import Pieces, load_pieces

#: Words, chunks and pairs of pieces that each Python worker keeps at hand; none is longer than LONG_WORD.
CACHED_WORDS, CACHED_PAIRS, LONG_WORD = 400_000, 1_000_000, 64


class PrefixCounter:
    """Counts of byte-pair tokens at every prefix, for one model."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self._valid: dict[int, bool] = {}
        #: The pieces that merging makes; others never are tokens.
        self._tree = pieces.tree_of({p: i for p, i in pieces.ids.items() if self.merge(p) == [p]})
        self._chunk: dict[str, tuple[int, ...]] = {}
        self._word: dict[str, tuple[int, ...]] = {}

    def merge(self, text: str) -> list[str]:
        """``text`` merged by descending score, leftmost first; meant for short strings."""
        ids, score, parts = self.pieces.ids, self.pieces.score, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or score[found] > best):
                    best, at = score[found], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, left: str, right: str, key: int) -> bool:
        if len(self._valid) >= CACHED_PAIRS:
            self._valid.clear()
        valid = self._valid[key] = self.merge(left + right) == [left, right]
        return valid

    def chunk_counts(self, chunk: str) -> tuple[int, ...]:
        """Token counts of the prefixes of a chunk, from one character on."""
        piece, valid, n = self.pieces.piece, self._valid, len(chunk)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for start in range(n):
            before, node = last[start], self._tree
            for end in range(start, n):
                entry = node.get(chunk[end])
                if entry is None:  # no piece begins so
                    break
                token, _, node = entry
                if token >= 0 and last[end + 1] == -1:
                    ok = True
                    if before >= 0:
                        key = before << 20 | token
                        ok = valid.get(key)
                        if ok is None:
                            ok = self._follows(piece[before], piece[token], key)
                    if ok:
                        last[end + 1], count[end + 1] = token, count[start] + 1
            if last[start + 1] == -1 and chunk[start] not in self.pieces.ids:
                count[start + 1] = count[start] + len(self.pieces.fallback(chunk[start]))
        return tuple(count[1:])

    def word_counts(self, word: str) -> tuple[int, ...]:
        """Token counts of the prefixes of a word, from one character on."""
        found = self._word.get(word)
        if found is None:
            out, base = [], 0
            for chunk in self.pieces.chunks(word):
                part = self._chunk.get(chunk)
                if part is None:
                    part = self.chunk_counts(chunk)
                    if len(chunk) <= LONG_WORD:
                        if len(self._chunk) >= CACHED_WORDS:
                            self._chunk.clear()
                        self._chunk[chunk] = part
                out.extend(part if not base else [base + c for c in part])
                base += part[-1]
            found = tuple(out)
            if len(word) <= LONG_WORD:
                if len(self._word) >= CACHED_WORDS:
                    self._word.clear()
                self._word[word] = found
        return found

    def total(self, text: str) -> int:
        """Tokens of the whole text: the last entry of its prefix table."""
        known, counts, n = self._word.get, self.word_counts, 0
        for word in self.pieces.words(text):
            n += (known(word) or counts(word))[-1]
        return n

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of ``text[:0]``, ``text[:1]`` and so on to the whole text.

        The space that the model puts before a text comes with its first
        character.
        """
        out, base = [0], 0
        for word in self.pieces.words(text):
            part = self.word_counts(word)
            out.extend(base + c for c in part)
            base += part[-1]
        return out[:1] + out[2:]

    def longest_fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix that has ``budget`` tokens or fewer."""
        base, at, best = 0, -1, 0
        for word in self.pieces.words(text):
            part = self.word_counts(word)
            if base > budget + self.pieces.longest * 4:
                break
            for c in part:
                at += 1
                if at > 0 and base + c <= budget:
                    best = at
            base += part[-1]
        return best


@lru_cache(maxsize=4)
def load_counter(model_file: str) -> PrefixCounter:
    return PrefixCounter(load_pieces(model_file))


def count_tokens(
    docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)`` for every row of ``docs``.

    ``fit_chars`` is the length of the longest prefix within ``limit`` tokens,
    the whole text where it fits. Null texts count as empty and have no
    tokens. Rows are kept as they come, repeated ids and null ids included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            counts = [counter.total(t) for t in texts]
            fits = [len(t) if n <= limit else counter.longest_fit(t, limit) for t, n in zip(texts, counts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_()), pa.array(fits, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    picked = docs.select(F.col(id_col).cast("long"), size, F.col(text_col))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def prefix_tables(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, prefix_tokens)``: the token count at every prefix of each text, the empty one first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load_counter(model_file)
        for batch in batches:
            tables = [counter.prefix_counts(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tables, pa.list_(pa.int32()))], names=["doc_id", "prefix_tokens"])

    picked = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return picked.mapInArrow(run, "doc_id long, prefix_tokens array<int>")
