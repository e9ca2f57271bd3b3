"""SQL text of the engine's functions, as the oracle side of the queries states them for DuckDB."""

from __future__ import annotations

from ..functions.text import ASCII_DIGITS, DEVANAGARI_DIGITS

WS = r"\t-\r\x{1c}-\x{1f} \x{85}\p{Z}"


def nfc(x: str) -> str:
    return f"nfc_normalize({x})"


def strip_zero_width(x: str) -> str:
    return rf"regexp_replace({x}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}]', '', 'g')"


def strip_urls(x: str) -> str:
    return rf"regexp_replace({x}, 'http[^{WS}]+|www\.[^{WS}]+', '', 'g')"


def flatten(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"


def collapse(x: str) -> str:
    return f"trim({flatten(x)}, ' ')"


def clean(x: str) -> str:
    return collapse(strip_urls(strip_zero_width(nfc(f"coalesce({x}, '')"))))


def tokens(x: str) -> str:
    lowered = f"translate(lower({nfc(f'coalesce({x}, {chr(39)}{chr(39)})')}), '{DEVANAGARI_DIGITS}', '{ASCII_DIGITS}')"
    return rf"list_filter(string_split(regexp_replace({lowered}, '[\p{{P}}\p{{S}}\p{{Z}}\t-\r\x{{1c}}-\x{{1f}}\x{{85}}]+', ' ', 'g'), ' '), lambda t: t <> '')"


def ws_words(x: str) -> str:
    return f"list_filter(string_split({flatten(f'coalesce({x}, {chr(39)}{chr(39)})')}, ' '), lambda t: t <> '')"


def sentences(x: str) -> str:
    cut = rf"regexp_replace(coalesce({x}, ''), '([।॥.!?])[{WS}]+', '\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: regexp_replace(s, '^[{WS}]+|[{WS}]+$', '', 'g')), lambda s: s <> '')"


def numbers(t: str) -> str:
    return f"list_distinct(list_filter({t}, lambda x: regexp_full_match(x, '[0-9]+')))"


def ngrams(t: str, n: int) -> str:
    if n == 1:
        return t
    return f"list_transform(range(1, len({t}) - {n - 2}), lambda i: array_to_string(list_slice({t}, i, i + {n - 1}), chr(1)))"


def minus(a: str, b: str) -> str:
    """Distinct elements of a that b lacks."""
    return f"list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))"


def overlap(a: str, b: str) -> str:
    """Size of the multiset intersection."""
    return f"coalesce(list_sum(list_transform(list_distinct({a}), lambda g: least(len(list_filter({a}, lambda x: x = g)), len(list_filter({b}, lambda x: x = g))))), 0)"


def f1(o: str, p: str, r: str) -> str:
    return f"CASE WHEN {o} = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * {o} / ({p} + {r}) END"


def usable(text: str, summary: str, text_tokens: str, summary_tokens: str) -> str:
    return f"({text} <> '' AND {summary} <> '' AND len({summary_tokens}) < len({text_tokens}))"
