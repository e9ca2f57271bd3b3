"""Words of a text as 64-bit hashes, and distinct runs of consecutive words, over whole Arrow batches.

A word is a token of the project's ``tokenize`` (NFC, lower case, Devanagari digits as 0-9, all P*, S* and Z*
characters as spaces, split on white space); each Han character and each character of U+3040-U+30FF is a word of its own.
Null texts have no words. Nothing is capped: texts of any length are processed whole.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import xxhash

#: Devanagari digits zero to nine.
DEVANAGARI_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")
#: Entries after which a worker's word cache starts anew; it only bounds memory.
CACHE_WORDS = 400_000
#: Longer pieces without white space (scripts without spaces) are not worth caching.
CACHE_LENGTH = 24

U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)


class _Separators(dict):
    """Code point -> what stands for it; learned on first sight."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if unicodedata.category(ch)[0] in "PSZ":
            out = " "
        elif 0x3400 <= code <= 0x9FFF or 0x3040 <= code <= 0x30FF:
            out = f" {ch} "
        else:
            out = ch
        self[code] = out
        return out


_SEPARATE = _Separators()


def words(text: str | None) -> list[str]:
    """The words of one text as strings."""
    if not text:
        return []
    return unicodedata.normalize("NFC", text).lower().translate(DEVANAGARI_DIGITS).translate(_SEPARATE).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (the public splitmix64 constants)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHasher:
    """Turns texts into word hashes. White-space pieces repeat, so each distinct piece is normalised once."""

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        hasher = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> int:
                found = words(piece)
                hashes = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in found]
                hasher.met(piece, found)
                at = len(hasher.starts)
                hasher.starts.append(len(hasher.pool))
                hasher.pool.extend(hashes)
                if len(piece) <= CACHE_LENGTH:
                    self[piece] = at
                return at

        self.pieces, self.starts, self.pool = Pieces(), [], []

    def met(self, piece: str, found: list[str]) -> None:
        """Called for each new piece; for subclasses that keep more about pieces."""

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words, offsets of the texts in them)."""
        return self.hashed(*self.index(texts))

    def index(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all pieces, pieces of each text after a leading 0)."""
        if len(self.starts) > CACHE_WORDS:
            self._reset()
        at: list[int] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        get = self.pieces.__getitem__
        for n, text in enumerate(texts):
            if text:
                got = list(map(get, text.split()))
                counts[n + 1] = len(got)
                at.extend(got)
        return np.array(at, np.int64), counts

    def hashed(self, index: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.array([*self.starts, len(self.pool)], np.int64)
        pool = np.array(self.pool, U64)
        begin, size = starts[index], starts[index + 1] - starts[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
        return pool[where], ends[np.cumsum(counts)]


def runs(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` consecutive words, and the number of the text of each."""
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), np.maximum(n - size + 1, 0))
    if not len(doc):
        return np.zeros(0, U64), doc
    each = np.maximum(n - size + 1, 0)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(len(doc))
    out = np.zeros(len(doc), U64)
    for k in range(size):
        out = mix(out * GOLDEN + hashes[first + k])
    return out, doc


def distinct_runs(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``runs``, each run once a text; sorted by text and hash."""
    run, doc = runs(hashes, offsets, size)
    order = np.lexsort((run, doc))
    run, doc = run[order], doc[order]
    keep = np.ones(len(run), bool)
    keep[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    return run[keep], doc[keep]
