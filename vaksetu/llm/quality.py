"""Problem 2: per-document text quality statistics and structural kind.

Besides the basic counts, every text gets three distributions: of its function words (the most frequent ones of its language, the others, and
all other words), of its character classes, and of what its words stand in (sentences, separate short entries, records of cells,
broken characters or code, bare figures, menus, repetition). The first two are compared with the prose profile of the language and
with its profile of words that make no sentences, by Jensen-Shannon divergence: as far as a text is nearer to the latter, its
running words count as entries and not as sentences. The kind is that of the profile that is nearest to all three distributions,
again by Jensen-Shannon divergence. Profiles start from built-in ones and are mixed with the rows judged by hand, those of prose by language (at
most LABELLED_ROWS, a documented bound of the training sample).

Null and blank texts have counts of 0, ratios of 0 and the kind junk. Ties go to the first of KINDS.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import FUNCTION_WORDS, OF_SCRIPT, SCRIPT_NAMES, _Script, decide
from .neardup import blocks
from .sentences import LINE_BREAK
from .words import CACHE_LENGTH, CACHE_WORDS, words

KINDS = ("prose", "list", "table", "junk")
LABELLED_ROWS = 5000
#: Weight of the built-in profiles in rows, against the labelled ones.
PRIOR_ROWS = 20
# What menus and page remains say.
MENU = set(
    "menu home login log in logout sign up register share search subscribe print next previous page comments comment advertisement privacy cookie cookies accept download app photos gallery video live top back more "
    "मेनू होम लॉगिन लॉग साइन साझा खोजें सब्सक्राइब प्रिंट अगला पिछला पेज टिप्पणी विज्ञापन गोपनीयता कुकी स्वीकार डाउनलोड ऐप फ़ोटो फोटो गैलरी वीडियो लाइव ऊपर जाएँ फ़ॉन्ट और पढ़ें शेयर "
    "মেনু হোম লগইন শেয়ার খুঁজুন ছাপুন বিজ্ঞাপন মন্তব্য مینو ہوم لاگ شیئر تلاش اشتہار تبصرے 首页 登录 注册 搜索 分享 广告 评论 ホーム ログイン 検索 共有 広告 コメント मुख्यपृष्ठ शोधा जाहिरात सामायिक".split()
)
SENTENCE_END = "।॥۔。！？!?.|؟…．"
PUNCTUATION_END = re.compile(r"[\W_]$")
ORDINAL = re.compile(r"(?:(?<=\s)|^)(?:[(（]?[0-9०-९০-৯۰-۹]{1,3}[.)）।、]|[(（][^\W\d_]\w{0,2}[)）])(?=\s)")
BULLET = re.compile(r"^\s*(?:[-*•·▪◦‣–—●○■□➤►✓★]|[(（]?[0-9०-९০-৯۰-۹]{1,3}[.)）。、।]|[(（]?[^\W\d_]\w{0,2}[)）])\s+")
SEPARATORS = set("|¦│•·▪-–—/*;:,.।॥") | {"---"}
#: (a string that must be there, the separator)
INLINE = tuple((m, re.compile(p)) for m, p in (("•", r"\s*•\s+"), ("·", r"\s*·\s+"), ("▪", r"\s*[▪◦●■►‣]\s+"), (" | ", r"\s+\|\s+"), (" / ", r"\s+/\s+"), (" ¦ ", r"\s+¦\s+"), ("\t", r"\t"), ("  ", r" {2,}"), (";", r";\s*")))
DASHED = re.compile(r"(?:^|\s+)[-–—]\s+(?=\S)")
#: (a string that must be there, the separator, 1: cells must hold figures or be regular, 2: also be short)
CELLS = tuple((m, re.compile(p), strict) for m, p, strict in (("\t", r"\t", 0), ("¦", r"\s*¦\s*", 0), ("|", r"\s*\|\s*", 0), ("│", r"\s*│\s*", 0), (";", r"\s*;\s*", 1), ("  ", r" {2,}", 0), (",", r",(?=\S)", 1), (",", r"\s*,\s*", 2), ("/", r"\s*/\s*", 2)))
RECORD = re.compile(r"^[\d०-९০-৯۰-۹.,%+\-–—−]+$")
CODE = re.compile(r"[<>{}=\\]|#[0-9a-fA-F]{3,6}\b|\w\(\w*\)")
RANDOM_LATIN = re.compile(r"^[A-Za-z0-9]+$")
BROKEN = re.compile("^[?�]+[.,।!]?$|�")
INDIC_BROKEN = re.compile(r"(?:^|[^ऀ-ॿঀ-৿])[ऀ-ःऺ-़ा-ॏঁ-ঃ়া-্]|[ा-ौা-ৌ][ा-्া-্]|्[ऀ-ःा-्]|[ऀ-ं][ऀ-ः]")
BINS = ("sentences", "entries", "records", "broken", "figures", "menu", "repeated")
SENTENCES, ENTRIES = BINS.index("sentences"), BINS.index("entries")
CLASSES = ("letters", "marks", "digits", "symbols")
#: Weights of the three distributions in the joint one.
W_STRUCTURE, W_FUNCTION, W_CLASS = 0.5, 0.3, 0.2
#: Function words of a language that have a bin each; the others share one, and all other words have the last.
TOP = 6
LANGUAGES = tuple(FUNCTION_WORDS)
#: Weight of a language's built-in prose profile in rows, against its labelled ones; words of a text's profile that its own words are mixed with.
PRIOR_LANGUAGE, SMOOTH = 5, 8
#: Built-in profiles of a language: prose, and words that make no sentences; classes of scripts with vowel signs, and of others.
PROSE_FUNCTION, LOOSE_FUNCTION, LOOSE_PART = np.array([0.03] * TOP + [0.14, 0.68]), 0.03, 0.15
UNSPACED_FUNCTION = np.array([0.01] * TOP + [0.06, 0.88])
SIGNS, PLAIN = np.array([0.70, 0.22, 0.04, 0.04]), np.array([0.90, 0.01, 0.04, 0.05])
WITH_SIGNS = {lang for script in ("devanagari", "bengali", "gurmukhi", "gujarati", "odia", "tamil", "telugu", "kannada", "malayalam", "thai") for lang in OF_SCRIPT[script]}


class Shape(NamedTuple):
    """What a text is judged by: its language and its three distributions."""

    lang: str | None
    bins: np.ndarray
    function: np.ndarray
    classes: np.ndarray
    words: float


def _profile(function: float, classes: tuple[float, ...], **bins: float) -> tuple[np.ndarray, float, np.ndarray]:
    part = np.array([bins.get(b, 0.0) for b in BINS])
    return part / part.sum(), function, np.array(classes) / sum(classes)


#: (kind, bins, share of function words, character classes)
PROFILES = (
    ("prose", *_profile(0.35, (0.70, 0.22, 0.04, 0.04), sentences=0.94, entries=0.05, figures=0.01)),
    ("list", *_profile(0.04, (0.62, 0.22, 0.06, 0.10), entries=0.95, sentences=0.05)),
    ("table", *_profile(0.03, (0.50, 0.15, 0.22, 0.13), records=0.95, entries=0.05)),
    ("junk", *_profile(0.02, (0.50, 0.20, 0.05, 0.25), broken=0.95, entries=0.05)),
    ("junk", *_profile(0.02, (0.70, 0.20, 0.03, 0.07), menu=0.90, entries=0.10)),
    ("junk", *_profile(0.00, (0.00, 0.00, 0.95, 0.05), figures=0.95, entries=0.05)),
    ("junk", *_profile(0.02, (0.70, 0.20, 0.03, 0.07), repeated=0.95, sentences=0.05)),
)


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits, 0 to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.where(p > 0, p * np.log2(p / m), 0).sum() / 2 + np.where(q > 0, q * np.log2(q / m), 0).sum() / 2)


class Analyser:
    """Figures and distribution of one text; pieces between white space are looked at once each."""

    def __init__(self, common: set[str]) -> None:
        self.common = common
        self.script, self.numbers = _Script(), {}
        for k, listed in enumerate(FUNCTION_WORDS.values()):
            for n, w in enumerate(dict.fromkeys(listed.split())):
                self.numbers.setdefault(w, []).append(k * (TOP + 1) + min(n, TOP))
        self.function = {w for ws in FUNCTION_WORDS.values() for w in ws.split()} | common
        self.cache: dict[str, tuple] = {}
        self.classes: dict[str, int] = {}

    def _class(self, ch: str) -> int:
        got = self.classes.get(ch)
        if got is None:
            kind = unicodedata.category(ch)
            got = self.classes[ch] = {"L": 0, "M": 1, "N": 2, "Z": 4}.get(kind[0], 3)
        return got

    def piece(self, piece: str) -> tuple:
        """(words, their length, common, function, letters, marks, digits, symbols, flag, scripts of its letters as numbers, function words as numbers);
        flag b: broken, f: figure, s: no letter or digit."""
        got = self.cache.get(piece)
        if got is not None:
            return got
        found = words(piece)
        classes = [0, 0, 0, 0, 0]
        for ch in piece:
            classes[self._class(ch)] += 1
        script = tuple(k for ch in piece if (k := self.script[ch]) >= 0)
        flag = ""
        high = sum("\x80" <= c <= "\xbf" for c in piece)
        if BROKEN.search(piece) or high >= 2 or CODE.search(piece):
            flag = "b"
        elif not classes[0] and classes[2]:
            flag = "f"
        elif not classes[0] and not classes[2]:
            flag = "" if set(piece) <= SEPARATORS else "s"
        elif RANDOM_LATIN.match(piece) and (
            len(piece) >= 25 or (len(piece) >= 3 and re.search(r"[a-z][A-Z]|[A-Z][A-Z][a-z]", piece) and len(re.findall(r"[a-z][A-Z]|[A-Za-z][0-9]|[0-9][A-Za-z]", piece)) >= 2) or (len(piece) >= 5 and len(re.findall(r"[A-Za-z][0-9]|[0-9][A-Za-z]", piece)) >= 2)
        ):
            flag = "b"
        elif INDIC_BROKEN.search(piece):
            flag = "i"
        got = (len(found), sum(map(len, found)), sum(w in self.common for w in found), sum(w in self.function for w in found), *classes[:4], flag, script, tuple(n for w in found for n in self.numbers.get(w, ())))
        if len(piece) <= CACHE_LENGTH:
            if len(self.cache) > CACHE_WORDS:
                self.cache.clear()
            self.cache[piece] = got
        return got

    @staticmethod
    def _cells(lines: list[str]) -> list[bool] | None:
        """Which lines are records of at least three cells, or None."""
        best: list[bool] | None = None
        for mark, split, strict in CELLS:
            if sum(mark in line for line in lines) < 2:
                continue
            rows = []
            for line in lines:
                cells = [c for c in split.split(line.strip().strip("|│").strip())]
                rows.append(cells if len(cells) >= 3 else None)
            several = [len(r) for r in rows if r]
            if not several:
                continue
            size, times = Counter(several).most_common(1)[0]
            if times < 2 and len(lines) > 1 or times < 0.5 * len(several):
                continue
            good = [bool(r) and len(r) == size and max(len(c.split()) for c in r) <= 6 for r in rows]
            cells = [c for r, g in zip(rows, good, strict=True) if g for c in r]
            figures = sum(bool(RECORD.match(c)) for c in cells)
            regular = sum(good) >= max(3, 0.8 * len(lines))  # so regular that the cells need not be figures
            if not cells or strict and figures < 0.2 * len(cells) and not (regular and strict == 1) or len(lines) == 1 or strict == 2 and max((len(c.split()) for c in cells), default=9) > 3:
                continue
            if figures == 0 and (size < 3 or len(set(cells)) < 0.6 * len(cells)):
                continue
            if best is None or sum(good) > sum(best):
                best = good
        return best

    @staticmethod
    def _inline_record(line: str) -> bool:
        """Whether a line holds records of cells one after another."""
        n = len(line.split())
        for mark, least in (("¦", 6), ("|", 6), (";", 6), ("\t", 6), (",", 6), ("    ", 6)):
            if line.count(mark) < least:
                continue
            if mark in ";,|":
                # cells without space between: pieces with two marks at least inside
                inner = [p for p in line.split() if p.strip(mark).count(mark) >= 2 and not RECORD.match(p) or mark in "|;" and p.strip(mark).count(mark) >= 2]
                if len(inner) >= 3 and sum(map(len, inner)) >= 0.4 * len(line):
                    return True
            cells = [c.strip() for c in line.split(mark)]
            figures = sum(bool(RECORD.match(c)) for c in cells if c)
            words_a_cell = n / len(cells)
            if mark in "¦|\t    " and mark != ";" and len(cells) >= 9 and figures >= 0.25 * len(cells) and words_a_cell <= 4:
                return True
        return False

    def _units(self, line: str) -> list[str]:
        """A line, or its separate entries where separators are dense."""
        n = len(line.split())
        marks = ORDINAL.findall(" " + line)
        if len(marks) >= 4 and n / len(marks) <= 9:
            return [u for u in ORDINAL.split(line) if u.strip()]
        for mark, split in (*INLINE, *((("", DASHED),) if line.lstrip()[:1] in "-–—" else ())):
            if mark not in line:
                continue
            parts = [u for u in split.split(line) if u.strip()]
            if len(parts) >= 5 and n / len(parts) <= 6.5:
                return parts
        return [line]

    def analyse(self, text: str | None) -> tuple[tuple[float, ...], Shape]:
        """((word count, mean word length, symbol ratio, share of lines that end in punctuation, share of common words), distributions)."""
        text = text or ""
        lines = [line for line in LINE_BREAK.split(text) if line.strip()]
        flat = [self.piece(p) for p in text.split()]
        *sums, flag_column, scripts, numbers = zip(*flat, strict=True) if flat else ((),) * 11
        total = np.array([sum(c) for c in sums], float) if flat else np.zeros(8)
        flags = Counter(flag_column)
        n_words, seen = total[0], max(total[4:8].sum(), 1)
        punctuated = sum(bool(PUNCTUATION_END.search(line.rstrip())) and unicodedata.category(line.rstrip()[-1])[0] in "PS" for line in lines)
        figures = (int(n_words), total[1] / max(n_words, 1), total[7] / seen, punctuated / max(len(lines), 1), total[2] / max(n_words, 1))
        bins = dict.fromkeys(BINS, 0.0)
        if lines:
            self._structure(text, lines, flags, bins)
        part = np.array([bins[b] for b in BINS])
        part = part / part.sum() if part.sum() else np.array([0, 0, 0, 1.0, 0, 0, 0])
        hits = np.bincount(np.array(list(chain.from_iterable(numbers)), int), minlength=len(LANGUAGES) * (TOP + 1)).reshape(-1, TOP + 1)
        letters = np.bincount(np.array(list(chain.from_iterable(scripts)), int), minlength=len(SCRIPT_NAMES))
        lang = decide({SCRIPT_NAMES[k]: letters[k] for k in np.flatnonzero(letters)}, {LANGUAGES[k]: n for k, n in enumerate(hits.sum(axis=1)) if n})
        own = hits[LANGUAGES.index(lang)] if lang in LANGUAGES else np.zeros(TOP + 1)
        function = np.append(own, max(n_words - own.sum(), 0)) / max(n_words, own.sum(), 1)
        if not n_words:
            function[-1] = 1
        return figures, Shape(lang, part, function, total[4:8] / seen, float(n_words))

    def _structure(self, text: str, lines: list[str], flags: Counter, bins: dict[str, float]) -> None:
        pieces = sum(flags.values())
        broken = flags["b"] + flags["i"] * (2.5 if flags["i"] >= 0.08 * pieces else 0) + (flags["s"] if flags["s"] >= 0.25 * pieces and flags["b"] >= 0.02 * pieces or flags["s"] >= 0.45 * pieces else 0)
        if broken >= 0.3 * pieces:
            bins["broken"] = 1.0
            return
        plain = text.split()
        if len(plain) >= 12:
            triples = set(zip(plain, plain[1:], plain[2:]))
            # the same few words again and again: a tenth of the runs would do
            if len(triples) <= 0.2 * (len(plain) - 2):
                bins["repeated"] = 1.0
                return
        records = self._cells(lines) if len(lines) > 1 else None
        units: list[tuple[str, str]] = []
        for k, line in enumerate(lines):
            if records and records[k] or self._inline_record(line):
                units.append(("records", line))
                continue
            marked = BULLET.match(line)
            parts = self._units(line[marked.end() :] if marked else line)
            units += [("marked" if marked else "inline" if len(parts) > 1 else "", p) for p in parts]
        seen: list[tuple[str, float, str]] = []
        for how, unit in units:
            got = [self.piece(p) for p in unit.split()]
            mass = float(sum(g[0] for g in got) or len(got))
            if how == "records":
                seen.append(("records", mass, unit))
                continue
            n, f = sum(g[0] for g in got), sum(g[3] for g in got)
            unspaced = n > 3 * len(got) + 3
            inner = unit.strip().rstrip(SENTENCE_END + ";,; ")
            if all(g[8] in ("f", "s") for g in got) and any(g[8] == "f" for g in got):
                seen.append(("figures", mass, unit))
            elif unspaced:
                seen.append(("entries" if n <= 22 and unit.strip()[-1:] not in "。！？!?" and not any(c in unit for c in "。！？") else "sentences", mass, unit))
            elif n <= (12 if how else 7) and f <= 0.34 * n and not any(c in inner for c in "।॥۔!?؟"):
                seen.append(("entries", mass, inner.strip()))
            else:
                seen.append(("sentences", mass, unit))
        # a heading or one sentence before a list or table changes nothing
        if len(seen) >= 4 and seen[0][0] == "sentences" and sum(k != "sentences" for k, _, _ in seen[1:]) >= 0.8 * (len(seen) - 1):
            seen = seen[1:]
        if sum(k == "entries" for k, _, _ in seen) > sum(k == "figures" for k, _, _ in seen):  # numbers among entries are entries
            seen = [("entries" if k == "figures" else k, m, u) for k, m, u in seen]
        entries = [u.lower() for k, _, u in seen if k == "entries"]
        if len(entries) >= 6:
            again = 1 - len(set(entries)) / len(entries)
            menu = sum(any(w in MENU for w in re.split(r"[\s()]+", e)) for e in entries) / len(entries)
            if again + menu >= 0.45 or menu >= 0.3:
                seen = [("menu" if k == "entries" else k, m, u) for k, m, u in seen]
        for kind, mass, _ in seen:
            bins[kind] += mass


def built_in(lang: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(function words, character classes) of prose where no labels say more: shares where characters are words, classes by vowel signs."""
    return UNSPACED_FUNCTION if lang in ("zh", "ja") else PROSE_FUNCTION, SIGNS if lang in WITH_SIGNS else PLAIN


class Profiles:
    """The profiles of each kind, and of the prose and the loose words of each language; see ``fit``."""

    def __init__(self, kinds: list[tuple[str, np.ndarray, float, np.ndarray]], prose: dict[str | None, tuple[np.ndarray, np.ndarray]]) -> None:
        self.kinds, self.prose = kinds, prose
        self.order = sorted(range(len(kinds)), key=lambda n: (KINDS.index(kinds[n][0]), n))
        self.joint: dict[str | None, np.ndarray] = {}

    def of(self, lang: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(function words, character classes) of the language's prose."""
        if lang not in self.prose:
            self.prose[lang] = built_in(lang)
        return self.prose[lang]

    def loose(self, lang: str | None, share: float) -> np.ndarray:
        """Function words where they have so small a share, in the proportions of the language's prose; at most LOOSE_PART of the share there."""
        own = self.of(lang)[0][:-1]
        share = min(share, LOOSE_PART * own.sum())
        return np.append(share * own / max(own.sum(), 1e-9), 1 - share)

    def prose_share(self, shapes: list[Shape]) -> np.ndarray:
        """How far each text is the prose of its language and not loose words of it, 0 to 1. Few words say little and leave a text as it is."""
        prose, loose = [], []
        for x in shapes:
            function, classes = self.of(x.lang)
            prose.append(np.concatenate([function * W_FUNCTION, classes * W_CLASS]) / (W_FUNCTION + W_CLASS))
            loose.append(np.concatenate([self.loose(x.lang, LOOSE_FUNCTION) * W_FUNCTION, classes * W_CLASS]) / (W_FUNCTION + W_CLASS))
        p, q = np.array(prose), np.array(loose)
        weight = np.array([x.words for x in shapes])[:, None]
        own = np.array([np.concatenate([x.function * W_FUNCTION, x.classes * W_CLASS]) for x in shapes]) / (W_FUNCTION + W_CLASS)
        own = (own * weight + p * SMOOTH) / (weight + SMOOTH)
        far, near = divergences(own, q), divergences(own, p)
        return far**2 / np.maximum(far**2 + near**2, 1e-12)

    def nearest(self, shapes: list[Shape]) -> list[tuple[str, float]]:
        if not shapes:
            return []
        share = self.prose_share(shapes)
        vectors = []
        for x, s in zip(shapes, share, strict=True):
            bins = x.bins.copy()
            bins[ENTRIES] += bins[SENTENCES] * (1 - s)
            bins[SENTENCES] *= s
            vectors.append(np.concatenate([W_STRUCTURE * bins, W_FUNCTION * x.function, W_CLASS * x.classes]))
        matrices = np.array([self._joint(x.lang) for x in shapes])
        far = divergences(np.array(vectors)[:, None, :], matrices)
        best = far.argmin(axis=1)
        return [(self.kinds[self.order[b]][0], float(d)) for b, d in zip(best, far[np.arange(len(best)), best], strict=True)]

    def _joint(self, lang: str | None) -> np.ndarray:
        if lang not in self.joint:
            function, classes = self.of(lang)
            rows = []
            for n in self.order:
                kind, bins, share, own = self.kinds[n]
                rows.append(np.concatenate([W_STRUCTURE * bins, W_FUNCTION * (function if kind == "prose" else self.loose(lang, share)), W_CLASS * (classes if kind == "prose" else own)]))
            self.joint[lang] = np.array(rows)
        return self.joint[lang]


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``divergence`` along the last axis."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return (np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)).sum(axis=-1) / 2


def fit(rows: list[tuple[str, Shape]]) -> Profiles:
    """The built-in profiles, each mixed with the labelled rows of its kind that are nearest to it by what their words stand in; the prose of each
    language with its labelled prose."""
    mine: list[list[Shape]] = [[] for _ in PROFILES]
    prose: dict[str | None, list[Shape]] = {}
    for kind, shape in rows:
        own = [n for n, profile in enumerate(PROFILES) if profile[0] == kind]
        if own:
            mine[min(own, key=lambda n: divergence(shape.bins, PROFILES[n][1]))].append(shape)
        if kind == "prose":
            prose.setdefault(shape.lang, []).append(shape)

    def mixed(start, weight: float, got: list):
        return (weight * start + sum(got)) / (weight + len(got)) if got else start

    kinds = [(kind, mixed(bins, PRIOR_ROWS, [x.bins for x in got]), float(mixed(share, PRIOR_ROWS, [1 - x.function[-1] for x in got])), mixed(classes, PRIOR_ROWS, [x.classes for x in got])) for (kind, bins, share, classes), got in zip(PROFILES, mine, strict=True)]
    of = {lang: tuple(mixed(start, PRIOR_LANGUAGE, [x[k] for x in got]) for k, start in zip((2, 3), built_in(lang), strict=True)) for lang, got in prose.items()}
    return Profiles(kinds, of)


def nearest(shape: Shape, profiles: Profiles) -> tuple[str, float]:
    return profiles.nearest([shape])[0]


def labelled_profiles(df: DataFrame, labels: DataFrame, common: set[str], id_col: str = "row_id", text_col: str = "text") -> Profiles:
    """Profiles fitted on the decided labels, at most LABELLED_ROWS of them (least hash of the id first). Texts are analysed where they are;
    only their distributions reach the driver."""
    some = labels.where(F.col("kind").isin(*KINDS)).orderBy(F.xxhash64(id_col), id_col).limit(LABELLED_ROWS)

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(common)
        for batch in batches:
            got = [analyser.analyse(text)[1] for text in batch.column(1).to_pylist()]
            lists = [pa.array([list(map(float, x[k])) for x in got], pa.list_(pa.float64())) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.lang for x in got], pa.string()), *lists, pa.array([x.words for x in got], pa.float64())], names=["kind", "lang", "bins", "function", "classes", "words"])

    rows = df.select(id_col, text_col).join(F.broadcast(some.select(id_col, "kind")), id_col).select("kind", text_col)
    found = rows.mapInArrow(shapes, "kind string, lang string, bins array<double>, function array<double>, classes array<double>, words double").collect()
    return fit([(r["kind"], Shape(r["lang"], np.array(r["bins"]), np.array(r["function"]), np.array(r["classes"]), r["words"])) for r in found])


def statistics(df: DataFrame, profiles: Profiles, common: set[str], id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id_col, word_count, mean_word_length, symbol_ratio, punctuated_lines, common_share, kind, divergence) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        analyser = Analyser(common)
        for batch in batches:
            for block in blocks(batch):
                got = [analyser.analyse(text) for text in block.column(1).to_pylist()]
                kinds, far = zip(*profiles.nearest([x for _, x in got]), strict=True)
                columns = list(zip(*(f for f, _ in got), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), pa.array(columns[0], pa.int64()), *(pa.array(np.array(c, float)) for c in columns[1:]), pa.array(kinds), pa.array(far)],
                    names=[id_col, "word_count", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_share", "kind", "divergence"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {kind}, word_count bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_share double, kind string, divergence double"
    )


def common_words(table: DataFrame) -> set[str]:
    """The words of the fixed table common_words (125 rows). An entry that is several words here (of scripts whose characters are
    words) counts for none of them."""
    found = [words(r["word"]) for r in table.select("word").where("word IS NOT NULL").distinct().collect()]
    return {w[0] for w in found if len(w) == 1}
