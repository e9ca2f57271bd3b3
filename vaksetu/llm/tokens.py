"""Problem 6: encoding of whole texts with a public byte-level tokenizer.

The tokenizers library encodes each distinct piece of text once: a text is cut at single spaces between two visible
characters, where the byte-level pre-tokenizer always ends a word, so the ids of the pieces in a row are the ids of
the text. Pieces repeat, so most texts are put together from known ids by offsets, in numpy, over a whole Arrow batch.

Null and empty texts have an empty list of ids; marker strings in a text are encoded as plain text.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter of every operator here.
TOKENIZERS = os.environ.get("VAKSETU_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Pieces after which a worker's cache starts anew, and the longest piece that is kept; both only bound memory.
CACHE_PIECES, CACHE_LENGTH = 300_000, 64

_CUT = re.compile(r"(?<=\S) (?=\S)")


def load(name: str = NAME, folder: str = TOKENIZERS):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    tokenizer.encode_special_tokens = True
    return tokenizer


class Encoder:
    def __init__(self, name: str = NAME, folder: str = TOKENIZERS) -> None:
        self.tokenizer = load(name, folder)
        self._reset()

    def _reset(self) -> None:
        encoder = self

        class Pieces(dict):
            def __init__(self, before: str) -> None:
                self.before = before

            def __missing__(self, piece: str) -> int:
                at = encoder.add(self.before + piece)
                if len(piece) <= CACHE_LENGTH:
                    self[piece] = at
                return at

        self.first, self.rest, self.sizes, self.pool = Pieces(""), Pieces(" "), [], []

    def add(self, piece: str) -> int:
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        self.sizes.append(len(ids))
        self.pool.append(np.array(ids, np.int32))
        return len(self.sizes) - 1

    def _pieces(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(piece numbers, number of pieces of each text)."""
        if len(self.sizes) > CACHE_PIECES:
            self._reset()
        at: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        rest, first, split = self.rest.__getitem__, self.first, _CUT.split
        for n, text in enumerate(texts):
            if text:
                head, *tail = split(text)
                at.append(first[head])
                at.extend(map(rest, tail))
                counts[n] = 1 + len(tail)
        return np.array(at, np.int64), counts

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        at, pieces = self._pieces(texts)
        ends = np.concatenate([[0], np.cumsum(np.array(self.sizes, np.int64)[at])])
        bounds = np.concatenate([[0], np.cumsum(pieces)])
        return ends[bounds[1:]] - ends[bounds[:-1]]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        at, pieces = self._pieces(texts)
        sizes = np.array(self.sizes, np.int64)
        if not len(at):
            return np.zeros(0, np.int32), pieces
        self.pool = [np.concatenate(self.pool)] if len(self.pool) > 1 else self.pool
        starts = np.cumsum(sizes) - sizes
        size = sizes[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat(starts[at] - ends[:-1], size) + np.arange(ends[-1])
        bounds = np.concatenate([[0], np.cumsum(pieces)])
        return self.pool[0][where], ends[bounds[1:]] - ends[bounds[:-1]]


def byte_table() -> dict[str, int]:
    """Character of the byte-level alphabet -> byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class Decoder:
    """ids -> text. Bytes are joined before they are read as UTF-8, so a character split over several ids comes back whole;
    bytes that form no character (a list cut inside one) become U+FFFD, unknown ids are an error."""

    def __init__(self, name: str = NAME, folder: str = TOKENIZERS) -> None:
        table = byte_table()
        vocabulary = load(name, folder).get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            self.bytes[number] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "replace")

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """Of each id the code points [start, end) of the text that its bytes touch; the ids of a split character share it."""
        out, begun, at = [], 0, 0
        for i in ids:
            heads = sum((b & 0xC0) != 0x80 for b in self.bytes[i])
            start = begun if not self.bytes[i] or (self.bytes[i][0] & 0xC0) != 0x80 else max(begun - 1, 0)
            begun += heads
            out.append((start, begun))
        return out


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, ids ARRAY<INT>) of every row; other columns are dropped. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                block = batch.slice(at, 512)
                ids, counts = encoder.encode(block.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = NAME, folder: str = TOKENIZERS) -> DataFrame:
    """(id_col, n_tokens BIGINT) of every row, 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                block = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([block.column(0), pa.array(encoder.counts(block.column(1).to_pylist()))], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")


def decoded(ids: str | Column, name: str = NAME, folder: str = TOKENIZERS) -> Column:
    """The text of a list of ids; null for null."""
    state: dict = {}

    @F.pandas_udf("string")
    def decode(lists):
        import pandas as pd

        decoder = state.setdefault("decoder", None) or Decoder(name, folder)
        state["decoder"] = decoder
        return pd.Series([None if x is None else decoder.decode(x) for x in lists], dtype=object)

    return decode(ids)
