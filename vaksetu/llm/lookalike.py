"""Problem 8: visually identical text with different characters.

Two forms of every text, made by DuckDB inside the Arrow partitions with nfc_normalize, translate and regular expressions:

- form: readable; full-width, half-width and joined forms, radicals and other compatibility letters as their usual
  characters, accents composed, characters without visible form removed, every space U+0020, every line end U+000A.
- skeleton: for comparison; besides, letters and signs of one shape as one character. Texts that print the same have one skeleton.

Kept apart, as a reader sees them: raised and circled figures, fractions, other digits, a missing accent or dot, other marks, the
number of spaces, line breaks, joiners inside an emoji.

Null text has null forms and is in no pair; a text without a visible character is in no pair.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Bytes of text that DuckDB gets at once (one row at least), the memory it may use for them, and how many times its own size a longer row may take.
BLOCK_BYTES, MEMORY_MB, TIMES = 4 << 20, 256, 24

# Letters and signs of one shape at different code points (left: first of each pair, right: what it becomes).
SAME_SHAPE = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ѕ": "S", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "ӏ": "l",
    # Greek
    "ο": "o", "ν": "v", "ϳ": "j", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Armenian, Latin
    "օ": "o", "Օ": "O", "ɡ": "g", "ǀ": "|", "ǃ": "!",
    # signs
    "ः": ":", "∶": ":", "։": ":", "׃": ":", "‐": "-", "‑": "-", "∣": "|", "∕": "/", "⁄": "/", "ʼ": "’", "‚": ",", "⋅": "·", "∙": "·", "‧": "·",
    # kana and Han
    "ニ": "二", "ロ": "口", "カ": "力", "ハ": "八", "エ": "工", "ト": "卜", "タ": "夕", "ヘ": "へ", "ー": "一", "〇": "○", "靑": "青",
}
# Sequences that print as one letter.
SAME_SEQUENCE = {
    "अा": "आ", "अो": "ओ", "अौ": "औ", "अॉ": "ऑ", "आॅ": "ऑ", "आे": "ओ", "आै": "औ", "एे": "ऐ", "ाे": "ो", "ाै": "ौ", "ाॅ": "ॉ", "अॅ": "ॲ",
    "অা": "আ", "\u06cc\u0654": "\u0626",
}
# Letters whose shape depends on what follows: (letter, becomes, only before another letter).
JOINED_SHAPE = (("ي", "ی", True), ("ى", "ی", False))
# RE2 classes.
EMOJI = r"[\x{2190}-\x{2BFF}\x{1F000}-\x{1FAFF}]"
INVISIBLE = (
    r"[\x{00}-\x{08}\x{0E}-\x{1B}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}"
    r"\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0100}-\x{E01EF}]"
)
SPACES = r"[\t\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
LINE_ENDS = r"\r\n|[\r\x{0B}\x{0C}\x{1C}-\x{1F}\x{85}\x{2028}\x{2029}]"
ARABIC_LETTER = r"[\x{620}-\x{64A}\x{66E}-\x{6D3}]"
#: Stands for a joiner inside an emoji while the others are removed (a private-use character).
KEPT_JOINER = "\uE000"
#: Compatibility forms that print as their usual characters; superscripts, circled, squared figures and fractions are none.
FORMS = ((0xFF01, 0xFFEE), (0xFB00, 0xFB06), (0xFB13, 0xFB17), (0xFB1D, 0xFDEF), (0xFE30, 0xFEFC), (0x2E80, 0x2FDF), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2160, 0x217F), (0xB5, 0xB5), (0x2024, 0x2024))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def compatibility_forms() -> dict[str, str]:
    """Compatibility character -> usual characters, by the Unicode decompositions of the ranges above."""
    out = {}
    for first, last in FORMS:
        for code in range(first, last + 1):
            tag, *parts = unicodedata.decomposition(chr(code)).split() or [""]
            if tag[:1] == "<" and tag not in ("<super>", "<sub>", "<circle>", "<square>", "<vertical>"):
                usual = "".join(chr(int(p, 16)) for p in parts)
                if usual[0] != " ":  # spacing accents are signs of their own
                    out[chr(code)] = usual
    return out


def form_sql(column: str, found: set[str]) -> str:
    """The readable form as an SQL expression; found: the characters above U+007F that the batch holds, so that only
    the replacements it needs are in the expression."""
    x = f"regexp_replace({column}, {_quoted(LINE_ENDS)}, chr(10), 'g')" if found & set("\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u2028\u2029") else column
    x = f"regexp_replace({x}, '\\x{{FE0F}}', '', 'g')" if "\ufe0f" in found else x
    if "\u200d" in found:
        for _ in range(2):  # neighbours share an emoji, so every other joiner is found at a time
            x = f"regexp_replace({x}, '({EMOJI})\\x{{200D}}({EMOJI})', '\\1{KEPT_JOINER}\\2', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{INVISIBLE}', '', 'g'), '{SPACES}', ' ', 'g')"
    x = f"replace({x}, '{KEPT_JOINER}', chr(8205))" if "\u200d" in found else x
    forms = {c: u for c, u in compatibility_forms().items() if c in found}
    if single := {c: u for c, u in forms.items() if len(u) == 1}:
        x = f"translate({x}, {_quoted(''.join(single))}, {_quoted(''.join(single.values()))})"
    for c, u in forms.items():
        if len(u) > 1:
            x = f"replace({x}, {_quoted(c)}, {_quoted(u)})"
    return f"nfc_normalize({x})"


def skeleton_sql(form: str, found: set[str]) -> str:
    """The skeleton of a form as an SQL expression."""
    x = form
    for sequence, letter in SAME_SEQUENCE.items():
        if sequence[0] in found or sequence[1] in found:
            x = f"replace({x}, {_quoted(sequence)}, {_quoted(letter)})"
    for letter, becomes, before in JOINED_SHAPE:
        if letter in found or before:
            for _ in range(2):
                follow = f"({ARABIC_LETTER})" if before else f"($|[^\\x{{620}}-\\x{{64A}}\\x{{66E}}-\\x{{6D3}}])"
                x = f"regexp_replace({x}, '{letter}{follow}', '{becomes}\\1', 'g')"
    return f"translate({x}, {_quoted(''.join(SAME_SHAPE))}, {_quoted(''.join(SAME_SHAPE.values()))})"


def _blocks(batch: pa.RecordBatch, text: int = 1, most: int = 512) -> Iterator[tuple[pa.RecordBatch, int]]:
    """(rows, bytes of their texts): stretches of a batch with at most BLOCK_BYTES of text, or one row."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = min(max(int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")), at + 1), at + most, batch.num_rows)
        yield batch.slice(at, end - at), int(ends[end - 1]) - before
        at = end


def consistent(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text_key: digest of the text, form, skeleton_key: digest of the skeleton, visible: whether a character shows) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        allowed = MEMORY_MB
        for batch in batches:
            for block, size in _blocks(batch):
                if (wanted := max(MEMORY_MB, TIMES * (size >> 20))) != allowed:  # a long row has the memory it takes, for its block only
                    connection.execute(f"SET memory_limit = '{wanted}MB'")
                    allowed = wanted
                docs = pa.table({"id": block.column(0), "text": block.column(1)})  # noqa: F841 - read by name below
                connection.register("docs", docs)
                found = set("".join({c for t in block.column(1).to_pylist() if t for c in set(t)}))
                form = form_sql("text", found)
                # letters that only come out of the first step count as found in the second
                later = found | {c for f in found for c in compatibility_forms().get(f, "")}
                done = connection.sql(
                    f"SELECT id, unhex(md5(text)) AS text_key, form, unhex(md5({skeleton_sql('form', later)})) AS skeleton_key, "
                    f"regexp_matches(form, '[^\\s]') AS visible FROM (SELECT id, text, {form} AS form FROM docs)"
                ).to_arrow_table()
                yield from done.select(["id", "text_key", "form", "skeleton_key", "visible"]).cast(
                    pa.schema([("id", block.column(0).type), ("text_key", pa.binary()), ("form", pa.string()), ("skeleton_key", pa.binary()), ("visible", pa.bool_())])
                ).rename_columns([id_col, "text_key", "form", "skeleton_key", "visible"]).combine_chunks().to_batches()
        connection.close()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, text_key binary, form string, skeleton_key binary, visible boolean")


def lookalike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b, of different strings with one skeleton. Copies of a string are one class: classes are joined,
    and only where a skeleton has several; members follow, so a large group of copies is never joined with itself."""
    forms = cut(consistent(df, id_col, text_col).where("visible").select(F.col(id_col).alias("id"), "text_key", "skeleton_key"))
    classes = forms.groupBy("skeleton_key", "text_key").agg(F.count("*").alias("n"))
    mixed = classes.groupBy("skeleton_key").agg(F.count("*").alias("classes")).where("classes > 1").select("skeleton_key")
    members = forms.join(mixed, "skeleton_key", "left_semi").select("id", "text_key", "skeleton_key")
    some = members.select("skeleton_key", "text_key").distinct()
    a, b = some.withColumnRenamed("text_key", "ka"), some.withColumnRenamed("text_key", "kb")
    pairs = a.join(b, "skeleton_key").where("ka < kb").select("ka", "kb")
    left, right = members.select(F.col("id").alias("ia"), F.col("text_key").alias("ka")), members.select(F.col("id").alias("ib"), F.col("text_key").alias("kb"))
    both = pairs.join(left, "ka").join(right, "kb")
    return both.select(F.least("ia", "ib").alias(f"{id_col}_a"), F.greatest("ia", "ib").alias(f"{id_col}_b"))
