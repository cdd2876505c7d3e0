"""Whole-text encoding with the tokenizers library, each distinct piece of text encoded once for a worker."""

from __future__ import annotations

import gc
import os
import re

import numpy as np

#: White_Space of Unicode.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
SIGN = "!-/:-@\\[-`{-~"
#: A byte-level pre-tokenizer never joins what is not blank to a blank after it, nor a letter to an ASCII sign after it,
#: so a text may be cut there, and after a single line feed. The encoding of a text is that of its pieces, one after another.
PIECE = re.compile(f" ?[{LETTER}]++(?![^{SPACE}{SIGN}])|\\n(?![{SPACE}])|[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
MOST_CACHED = 600_000
LONGEST_CACHED = 64
_encoders: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}  # once full, it serves on as the older half
        self.older: dict[str, bytes] = {}
        self.line_feed = self._ids(["\n"])[0][0]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the cache is long to walk through
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        pieces = [PIECE.findall(t) for t in texts]
        if len(self.known) > MOST_CACHED:
            self.known, self.older = {}, self.known
        known, older, once = self.known, self.older, {}
        missing = set().union(*pieces).difference(known)
        again = [p for p in missing if p in older]
        known.update((p, older[p]) for p in again)
        missing.difference_update(again)
        # letters after a space at most keep their encoding between line feeds, whose token they don't hold
        plain = [p for p in missing if len(p) <= LONGEST_CACHED and (p[1:] if p[0] == " " else p).isalpha()]
        odd = list(missing.difference(plain))
        for at in range(0, len(plain), 256):
            some = plain[at : at + 256]
            ids = np.array(self._ids(["\n".join(some)])[0], self.dtype)
            ends = np.flatnonzero(ids == self.line_feed) * self.dtype.itemsize
            if len(ends) != len(some) - 1:  # no plain byte-level vocabulary: one by one
                odd += some
                continue
            raw, lo = ids.tobytes(), 0
            for piece, end in zip(some, [*ends.tolist(), len(raw)], strict=True):
                known[piece] = raw[lo:end]
                lo = end + self.dtype.itemsize
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for piece, ids in zip(some, self._ids(some), strict=True):
                (known if len(piece) <= LONGEST_CACHED else once)[piece] = np.array(ids, self.dtype).tobytes()
        if once:
            return [b"".join([known[p] if p in known else once[p] for p in x]) for x in pieces]
        return [b"".join(map(known.__getitem__, x)) for x in pieces]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def encoder(path: str) -> PieceEncoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
