"""Scalar text functions as Column expressions.

All stay in the JVM except NFC, which Spark lacks: an Arrow UDF over whole batches.
Classes of characters are written out, as ``\\s``, ``\\w`` and ``trim`` know only some of Unicode.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values
WS = r"\t-\r\x1c-\x1f \x85\p{Z}"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
DEVANAGARI_DIGITS, ASCII_DIGITS = "०१२३४५६७८९", "0123456789"
SENTENCE_MARKS = "।॥.!?"
MARKUP = r"<2[a-z]{2}>|</?s>|<pad>|<unk>|\[(?:CLS|SEP|MASK)\]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.arrow_udf(StringType())
def _nfc(column: pa.Array) -> pa.Array:
    normal = unicodedata.normalize
    return pa.array([t if t is None or t.isascii() else normal("NFC", t) for t in column.to_pylist()], pa.string())


def nfc(c: Column | str) -> Column:
    """Canonical composition; null stays null."""
    return _nfc(_col(c))


def strip_zero_width(c: Column | str) -> Column:
    return F.translate(_col(c), ZERO_WIDTH, "")


def strip_urls(c: Column | str) -> Column:
    """Removes http... and www... up to the next white space, case-sensitively."""
    return F.regexp_replace(_col(c), f"http[^{WS}]+|www\\.[^{WS}]+", "")


def collapse_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), f"[{WS}]+", " "))


def flatten_whitespace(c: Column | str) -> Column:
    """White-space runs as one space, without trimming."""
    return F.regexp_replace(_col(c), f"[{WS}]+", " ")


def clean_text(c: Column | str) -> Column:
    """NFC, zero-width characters and URLs removed, white space collapsed; null gives the empty string."""
    return collapse_whitespace(strip_urls(strip_zero_width(nfc(F.coalesce(_col(c), F.lit(""))))))


def tokenize(c: Column | str) -> Column:
    """Lower-case words without punctuation, symbols and separators; vowel signs stay in their words. Null and empty give an empty list."""
    return tokenize_composed(nfc(F.coalesce(_col(c), F.lit(""))))


def tokenize_composed(c: Column | str) -> Column:
    """``tokenize`` of text that is NFC already; may stand in a lambda."""
    lowered = F.translate(F.lower(_col(c)), DEVANAGARI_DIGITS, ASCII_DIGITS)
    spaced = F.regexp_replace(lowered, r"[\p{P}\p{S}\p{Z}\t-\r\x1c-\x1f\x85]+", " ")
    return F.array_remove(F.split(spaced, " "), "")


def whitespace_words(c: Column | str) -> Column:
    return F.array_remove(F.split(F.coalesce(_col(c), F.lit("")), f"[{WS}]+"), "")


def split_sentences(c: Column | str) -> Column:
    """Sentences that end with a mark and white space, stripped, without blank ones."""
    parts = F.split(F.coalesce(_col(c), F.lit("")), f"(?<=[{SENTENCE_MARKS}])[{WS}]+")
    return F.array_remove(F.transform(parts, lambda s: F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", "")), "")


def split_sentences_indic(c: Column | str) -> Column:
    """Danda-aware sentences: a period divides only texts without danda, no white space is needed behind the mark, and neither a number
    nor a single letter before the mark ends a sentence."""
    text = F.coalesce(_col(c), F.lit(""))
    marks = F.when(text.rlike("[।॥]"), F.regexp_replace(text, "([।॥!?]+)", "$1\u0001")).otherwise(F.regexp_replace(text, r"(?<![\p{Nd}])(?<![\p{Z}]\p{L})([.!?]+)", "$1\u0001"))
    return F.array_remove(F.transform(F.split(marks, "\u0001"), lambda s: F.regexp_replace(s, f"^[{WS}]+|[{WS}]+$", "")), "")


def truncate_words(c: Column | str, most: int) -> Column:
    """The first words joined by one space; a text of at most so many words is left untouched."""
    words = whitespace_words(c)
    return F.when(F.size(words) <= most, _col(c)).otherwise(F.array_join(F.slice(words, 1, most) if most else F.array().cast("array<string>"), " "))


def clean_output(c: Column | str) -> Column:
    """Model marker tokens as spaces, white space collapsed."""
    return collapse_whitespace(F.regexp_replace(_col(c), MARKUP, " "))


def char_prefix(c: Column | str, n: int) -> Column:
    """The first n code points."""
    return F.substring(_col(c), 1, n)


def numbers(tokens: Column | str) -> Column:
    """The distinct tokens of ASCII digits only."""
    return F.array_distinct(F.filter(_col(tokens), lambda t: t.rlike("^[0-9]+$")))


def is_usable(text: Column | str, summary: Column | str, text_tokens: Column | str, summary_tokens: Column | str) -> Column:
    """Both non-empty, and the summary has fewer words than the text."""
    return (_col(text) != "") & (_col(summary) != "") & (F.size(_col(summary_tokens)) < F.size(_col(text_tokens)))


def has_unsupported_number(summary_tokens: Column | str, source_tokens: Column | str) -> Column:
    """Whether the summary has a number that the source lacks."""
    return F.size(F.array_except(numbers(summary_tokens), numbers(source_tokens))) > 0
