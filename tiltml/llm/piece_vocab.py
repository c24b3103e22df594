"""Pieces and scores of a SentencePiece model with byte fallback.

The public model ranks its pieces; a piece of rank r gets the log-probability -log(r + 2), up to
a constant (Zipf's law over ranks), which serves as its unigram score. A character that is no piece
by itself costs ``BYTE_SCORE`` for each of its UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable

SPACE = "▁"
BYTE_SCORE = -12.0


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes_of: list[bytes] = [b""] * model.get_piece_size()
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece] = (i, -math.log(2.0 + abs(model.get_score(i))))
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.pieces))

    def byte_tokens(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()]


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(place: Callable[[], str]) -> Vocabulary:
    """One vocabulary for each worker process."""
    path = place()
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]
