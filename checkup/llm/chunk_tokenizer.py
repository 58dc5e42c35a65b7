"""A memo in front of a ``tokenizers`` tokenizer, used inside tasks.

A text is cut where two neighbouring pre-tokens always part, each distinct
piece is encoded by the library once, and its result is kept in a bounded
memo. The cuts are exact for

* ``word``: tokenizers that drop white space (the piece is a run without white
  space), and
* ``byte``: byte-level BPE whose pattern joins one blank to the word behind it
  (the piece is a blank or line feed with the word behind it).

Texts for which that is not certain (other white space, neighbouring blanks in
``byte`` mode, the separator control characters) go to the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from itertools import islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

# white space other than blank and line feed, and control characters that
# Python counts as white space
_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -     　]")
_FILE_MEMO: dict = {}


def load_tokenizer(path: str):
    """The tokenizer of a file, read once per Python worker."""
    if path not in _FILE_MEMO:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _FILE_MEMO[path] = t
    return _FILE_MEMO[path]


def memo_encoder(path: str, mode: str, what: str, max_entries: int = 900_000) -> "ChunkEncoder":
    """One encoder per worker, file, mode and kind of result."""
    key = (path, mode, what)
    if key not in _FILE_MEMO:
        _FILE_MEMO[key] = ChunkEncoder(load_tokenizer(path), mode, what, max_entries)
    return _FILE_MEMO[key]


class ChunkEncoder:
    """Token counts (``what="count"``) or ids (``what="ids"``, as little-endian
    unsigned 32-bit integers in bytes) of texts."""

    def __init__(self, tokenizer, mode: str, what: str, max_entries: int = 900_000):
        assert mode in ("word", "byte") and what in ("count", "ids")
        self.tokenizer, self.mode, self.what = tokenizer, mode, what
        self.max_entries, self.memo = max_entries, {}

    def _encode(self, pieces: list[str]) -> list:
        out = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [len(e) for e in out] if self.what == "count" else [_packed(e.ids) for e in out]

    def _pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where the cuts are not certain."""
        if _ODD.search(text):
            return None
        if self.mode == "word":
            return (text.lower() if _plain(text) else text).split()
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return None
        # one mark in front of each piece: blank, line feed, or (first) none
        return ("\r" + text.replace("\n", " \n")).split(" ")

    def _learn(self, seen: set) -> None:
        """Encode what the memo lacks. When it is full, the half that came first
        stays: frequent pieces come early."""
        new = seen.difference(self.memo)
        if len(self.memo) + len(new) > self.max_entries:
            self.memo = dict(islice(self.memo.items(), self.max_entries // 2))
            new = seen.difference(self.memo)
        new = list(new)
        if self.mode == "word":
            new = self._learn_words(new)
            raw = new
        else:
            raw = [p[1:] if p.startswith("\r") else p if p.startswith("\n") else " " + p for p in new]
        self.memo.update(zip(new, self._encode(raw)))

    def _learn_words(self, new: list[str]) -> list[str]:
        """Learn words of letters, alone or before one punctuation mark, straight
        from the tokenizer's model: such a word is one pre-token, and the mark
        another. The other pieces are returned."""
        memo, model, others = self.memo, self.tokenizer.model, []
        for piece in new:
            word, mark = (piece[:-1], piece[-1]) if piece[-1] in _MARKS else (piece, "")
            low = word.lower()
            # decided before the memo is asked: some letters become a letter and a
            # combining mark, which joins the punctuation mark in one pre-token
            if not word.isalpha() or max(word) > _LAST_LETTER or not low.isalpha():
                others.append(piece)
                continue
            if mark and mark not in memo:
                memo[mark] = self._encode([mark])[0]
            got = memo.get(word)
            if got is None:
                if not low.isascii():
                    low = "".join(map(_BYTE_CHARS.__getitem__, low.encode()))
                ids = [t.id for t in model.tokenize(low)]
                got = len(ids) if self.what == "count" else _packed(ids)
            memo[piece] = got + memo[mark] if mark else got
        return others

    def __call__(self, texts: list[str]) -> list:
        """A count, or packed ids, for each text."""
        cut = [self._pieces(t) for t in texts]
        seen: set = set()
        for pieces in cut:
            if pieces is not None:
                seen.update(pieces)
        self._learn(seen)
        get, out = self.memo.__getitem__, []
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out.append(self._encode([text])[0])
            elif self.what == "count":
                out.append(sum(map(get, pieces)))
            else:
                out.append(b"".join(map(get, pieces)))
        return out


def _plain(text: str) -> bool:
    """Whether lower-casing the text beforehand changes nothing: one-byte
    characters need no normalisation, and no special token can come about."""
    if "<|" in text:
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_chars() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: visible
    ones for themselves, the others from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


_BYTE_CHARS = _byte_chars()
_MARKS = ".,!?;:"
_LAST_LETTER = "\u017f"  # up to here letters are precomposed and lower-case one by one


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()
