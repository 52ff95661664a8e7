"""Token ids of whole texts by a public tokenizer file, fast enough for whole corpora.

The tokenizer splits at white space and between letters, digits and signs before anything else, so the ids of
a text are those of its pieces, one after another.  Pieces recur: the ids of white-space separated chunks
and of single pieces are kept in bounded tables, and only a new piece goes to the tokenizer's model.  Texts
with any character outside a plain set (printable ASCII and Latin-1 letters, whose lower case and normal
form are the same everywhere), and texts that may hold a special token, go to the tokenizer whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np

#: Chunks, and pieces, whose ids one worker keeps.
KEPT_CHUNKS, KEPT_PIECES = 200_000, 400_000
#: Signs that may end a chunk after a word; together they are one piece.
_TAIL = ".,!#$%&*|;:?-"
_PLAIN = bytes([*range(0x09, 0x0E), *range(0x20, 0x7F)])
_PLAIN_LATIN = _PLAIN + bytes(x for x in range(0xC0, 0x100) if x not in (0xD7, 0xF7))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """encoded(texts) gives each text's ids as bytes; `path` is a file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        import regex

        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # Only tokenizers that split that way, on lower case, are taken apart; others see every text whole.
        self.by_piece = False
        try:
            self.bytes_of = {k: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(k))[0][0] for k in range(0xC0, 0x100) if k not in (0xD7, 0xF7)}
            probe = "A bC, it's d9 x--y $$$ ÉÜ. 'd'll"
            self.by_piece = b"".join(self._chunk(c) for c in probe.lower().split()) == self._whole(probe)
        except Exception:  # a tokenizer of another kind
            self.by_piece = False
        self.chunks, self.pieces = {}, {}

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _plain(self, text: str) -> bool:
        if "<|" in text and any(s in text for s in self.special):
            return False
        try:
            return not (text.encode("ascii").translate(None, _PLAIN) if text.isascii() else text.encode("latin-1").translate(None, _PLAIN_LATIN))
        except UnicodeEncodeError:
            return False

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = array(self.code, [t.id for t in self.model.tokenize(piece if piece.isascii() else piece.translate(self.bytes_of))]).tobytes()
            if len(self.pieces) < KEPT_PIECES:
                self.pieces[piece] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(_TAIL)
        if word.isalpha():
            ids = self._piece(word)
            if len(word) < len(chunk):
                ids += self._piece(chunk[len(word) :])
        else:
            ids = b"".join([self._piece(x) for x in self.split(chunk)])
        if len(self.chunks) < KEPT_CHUNKS:
            self.chunks[chunk] = ids
        return ids

    def encoded(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids, little-endian in self.dtype; null is the empty text."""
        out, get, chunk = [], self.chunks.get, self._chunk
        for t in texts:
            if self.by_piece and t and self._plain(t):
                out.append(b"".join([get(c) or chunk(c) for c in t.lower().split()]))
            else:
                out.append(self._whole(t))
        return out

    def _whole(self, text: str | None) -> bytes:
        return np.array(self._one(text), self.dtype).tobytes() if text else b""


_encoders: dict[str, Encoder] = {}


def forget() -> None:
    """Drops the encoders of this worker and their tables."""
    _encoders.clear()


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
