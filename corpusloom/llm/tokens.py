"""Token ids by the tokenizers library, with a cache of pieces.

The vocabulary file's pre-tokenizer never crosses white space, so a text's ids are the ids of its
white-space pieces in a row; each piece is encoded by the library once and then looked up.
"""

from __future__ import annotations

from array import array

import numpy as np

from .common import kept

#: After a letter or digit these always start a new pre-token.
TAIL = b".,;:!?"
#: Pieces that a worker's cache holds before it starts anew (about 200 bytes each).
CACHE = 600_000
END_ID = 1


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: itself if it prints in Latin-1, else the next free one from 256 on."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
#: Letters under this one have no case, composition or normalisation that depends on their neighbours.
PLAIN = "\u0130"


class Pieces(dict):
    """piece (bytes) -> its ids (little-endian unsigned 32-bit)."""

    def __init__(self, vocab: str):
        super().__init__()
        self.tails = {}  # ids of runs of closing punctuation
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocab)
        self.word = self.tokenizer.model.tokenize
        # special tokens hold more than letters, so no plain word is one
        self.whole = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids

    def __missing__(self, piece: bytes) -> bytes:
        core = piece.rstrip(TAIL)
        if core.isalpha():  # ASCII letters: one pre-token, which byte level leaves as it is
            ids = [t.id for t in self.word(core.lower().decode())]
        else:
            text = core.decode()
            if text.isalpha() and max(text) < PLAIN:
                ids = [t.id for t in self.word(text.lower().encode().decode("latin-1").translate(_LETTERS))]
            elif core and text[-1].isalnum() and text[-1] < PLAIN:
                ids = self.whole(text)
            else:  # letters and marks at the end may hang together
                core, ids = piece, self.whole(piece.decode())
        out = array("I", ids).tobytes()
        if len(core) < len(piece):
            tail = piece[len(core) :]
            out += self.tails[tail] if tail in self.tails else self.tails.setdefault(tail, array("I", self.whole(tail.decode())).tobytes())
        if len(self) >= CACHE:
            self.clear()
        self[piece] = out
        return out

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text; none for null or empty ones."""
        if not text:
            return b""
        raw = text.encode()
        if b"<|" not in raw:  # special tokens are told by case, the rest is lower-cased anyway
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


def pieces(vocab: str) -> Pieces:
    """One cache for a worker process and vocabulary."""
    known = kept("tokens")
    if vocab not in known:
        known[vocab] = Pieces(vocab)
    return known[vocab]


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def sentence_ends(vocab: str) -> np.ndarray:
    """Ids of tokens that end a word and consist of sentence punctuation, perhaps closed by quotes or brackets."""
    import re

    found = [i for t, i in pieces(vocab).tokenizer.get_vocab().items() if re.fullmatch(r"[.!?]+[\"')\]]*</w>", t)]
    return np.array(sorted(found), np.uint32)
