"""The pieces of a SentencePiece model and the chunks that encode apart.

The models read here leave text as it is: no normalisation, a space before
the text, white space escaped as U+2581, bytes for characters that have no
piece. No piece joins a character to a following U+2581, and many other
character pairs occur in no piece either; text can be cut between such
characters and encoded chunk by chunk.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

SPACE = "▁"
NORMAL, BYTE = "normal", "byte"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Pieces:
    """Pieces with their ids and scores, prepared for scans over text."""

    def __init__(self, model_file: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        probe = "A  Àﬁ ① x"
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("the model normalises text; only models that keep it are handled")
        self.ids: dict[str, int] = {}
        self.score: list[float] = [0.0] * sp.vocab_size()
        self.byte_id: list[int] = [sp.unk_id()] * 256
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            self.score[i] = sp.get_score(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
        self.piece = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.longest = max(map(len, self.ids))
        #: Every beginning of a piece: the id of the piece it is, or -1.
        self.starts = {p[:i]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        #: The pieces as a tree: character -> (id or -1, score, tree of what may follow).
        self.tree = self.tree_of(self.ids)
        self.joined = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.lowest = min(self.score)
        if any(pair[0] != SPACE and pair[1] == SPACE for pair in self.joined):
            raise ValueError("a piece holds a space after another character")

    def tree_of(self, ids: dict[str, int]) -> dict:
        root: dict = {}
        for piece, i in sorted(ids.items(), key=lambda x: len(x[0])):
            node = root
            for char in piece[:-1]:
                if char not in node:
                    node[char] = (-1, 0.0, {})
                node = node[char][2]
            node[piece[-1]] = (i, self.score[i], node[piece[-1]][2] if piece[-1] in node else {})
        return root

    def words(self, text: str) -> list[str]:
        """``text`` as escaped words, each with the spaces before it."""
        return _WORD.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def chunks(self, word: str) -> list[str]:
        """``word`` cut wherever no piece holds the two characters side by side."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in joined:
                out.append(word[start:i])
                start = i
        out.append(word[start:])
        return out

    def fallback(self, char: str) -> list[int]:
        """The byte pieces of a character that has no piece."""
        return [self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")]


@lru_cache(maxsize=4)
def load_pieces(model_file: str) -> Pieces:
    """The model's pieces, read once in each Python worker."""
    return Pieces(model_file)
