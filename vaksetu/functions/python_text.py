"""The text functions that Python workers need, with the same results as their Column forms in ``functions.text``."""

from __future__ import annotations

import re
import unicodedata

_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")
_SENTENCE_END = re.compile(r"(?<=[।॥.!?])\s+")
#: Pieces kept by a tokenizer; only bounds memory.
CACHE = 400_000


class _Separators(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = " " if unicodedata.category(chr(code))[0] in "PSZ" else chr(code)
        return out


_SEPARATORS = _Separators()


def tokenize(text: str | None) -> list[str]:
    return unicodedata.normalize("NFC", text or "").lower().translate(_DIGITS).translate(_SEPARATORS).split()


class Tokenizer:
    """``tokenize`` that looks at each white-space piece once."""

    def __init__(self) -> None:
        self.pieces: dict[str, list[str]] = {}

    def __call__(self, text: str | None) -> list[str]:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        out: list[str] = []
        for piece in (text or "").split():
            got = self.pieces.get(piece)
            if got is None:
                got = self.pieces[piece] = tokenize(piece)
            out += got
        return out


def split_sentences(text: str | None) -> list[str]:
    return [s for part in _SENTENCE_END.split(text or "") if (s := part.strip())]
