"""Problem 4: sentence boundaries, with abbreviations, collocations and sentence starters learned from the texts themselves.

Learning (after Kiss and Strunk 2006, per language, over all rows): a short type that nearly always bears a period is an abbreviation by its
log-likelihood ratio, weighted by its length, its inner periods and its occurrences without a period. In a corpus with few verbs the
ratio alone would also take sentence-final words, so one more statistic decides: types that end lines as often as other
period-bearing words do are ordinary words. Starters are words that follow sure boundaries more often than chance, collocations are
abbreviation pairs that meet more often than chance; a sentence ends after an abbreviation that also ends lines before a starter.

Deciding: danda, ideographic and Arabic full stops always end a sentence, ! and ? too; a period only in rows that use it as their
end mark, and not after abbreviations, initials, list numbers, inside numbers or dots; a bar only in rows that use it. Marks inside
quotations and brackets end nothing, except right before the closing sign. Line breaks always end a unit.

What was learned is written to the shared folder, a folder for each language; a task reads the languages that it meets. Nothing of it
reaches the driver, and neither the number of learned words nor their length has a limit.

Null, empty and blank texts have no sentences. Offsets count code points. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .language import LanguageGuesser
from .neardup import blocks
from .store import file_system, new_folder

# Fixed values
LINE_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
SURE = "।॥۔。｡？！؟!?．"
MARKS = re.compile("[।॥۔。｡？！؟!?．.…|‼⁇⁈⁉]+")
OPENING = {"“": "”", "«": "»", "‘": "’", "「": "」", "『": "』", "(": ")", "[": "]", "（": "）", "【": "】", "《": "》", "‹": "›", "„": "”", "{": "}"}
CLOSING = set(OPENING.values()) | {'"', "'"}
STRIP = "\"'“”«»‘’()[]{}「」『』（）,;:،，、"
DIGITS = re.compile(r"^[\W_]*\d+$")
#: The thresholds of the ratios (0.3 and 7.88 are the published ones).
ABBREVIATION, STARTER, COLLOCATION = 0.3, 7.88, 7.88
#: An abbreviation ends lines less often than this share of what other period-bearing words do.
LINE_END = 0.25


def association(a: float, b: float, ab: float, n: float) -> float:
    """-2 log lambda of independence of a and b, negative where they meet less often than chance."""

    def ll(k: float, m: float, x: float) -> float:
        x = min(max(x, 1e-12), 1 - 1e-12)
        return k * math.log(x) + (m - k) * math.log(1 - x)

    rest = max(n - a, 1)
    p, p1, p2 = b / max(n, 1), ab / max(a, 1), (b - ab) / rest
    value = -2 * (ll(ab, a, p) + ll(b - ab, rest, p) - ll(ab, a, p1) - ll(b - ab, rest, p2))
    return value if p1 > p2 else -value


def _letters(kind: str) -> int:
    return sum(c != "." for c in kind)


_AFTER_SURE = re.compile(r".*[।॥۔。｡？！؟!?．|](?=.)", re.S)


def _kind(piece: str) -> str:
    """The type of a piece; of two words with nothing but an end mark between, the second."""
    return _AFTER_SURE.sub("", piece.strip(STRIP)).lower()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pre-aggregated counts of a task: lang, kind (w: word, p: word with period, d: piece with digits, n: pair), a, b, n, at a line's end or a start."""
    guesser = LanguageGuesser()
    plain: dict[str, Counter] = {}
    starts: dict[str, Counter] = {}
    ends: dict[str, Counter] = {}
    pairs: dict[str, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        out = []
        for lang, pieces in plain.items():
            counts: Counter = Counter()
            figures: Counter = Counter()  # only asked for as second words of pairs
            for piece, n in pieces.items():
                core = piece.rstrip(STRIP)
                dotted = core.endswith(".") and not core.endswith("..")
                kind = _kind(core[:-1] if dotted else core.rstrip(SURE + "|."))
                if kind and not any(c.isdigit() for c in kind):
                    counts["p" if dotted else "w", kind] += n
                elif kind:
                    figures[kind] += n
            out += [(lang, k, a, "", n, 0, 0) for (k, a), n in counts.items()]
            out += [(lang, "d", a, "", n, 0, 0) for a, n in figures.items()]
            out += [(lang, "w", a, "", 0, n, 0) for a, n in starts[lang].items()]
            out += [(lang, "p", a, "", 0, 0, n) for a, n in ends[lang].items()]
            out += [(lang, "n", a, b, n, 0, 0) for (a, b), n in pairs[lang].items()]
        for group in (plain, starts, ends, pairs):
            group.clear()
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(),) * 4 + (pa.int64(),) * 3, strict=True)], names=["lang", "kind", "a", "b", "n", "starts", "line_ends"])

    for batch in batches:
        for block in blocks(batch, 1024):
            for text in block.column(0).to_pylist():
                lang = guesser.guess(text)
                if lang is None or lang in ("zh", "ja"):  # without spaces there are no period-bearing words
                    continue
                if lang not in plain:
                    plain[lang], starts[lang], ends[lang], pairs[lang] = Counter(), Counter(), Counter(), Counter()
                for line in LINE_BREAK.split(text):
                    pieces = line.split()
                    if not pieces:
                        continue
                    plain[lang].update(pieces)
                    starts[lang][_kind(pieces[0])] += 1
                    if (last := pieces[-1].rstrip(STRIP)).endswith(".") and not last.endswith(".."):
                        ends[lang][_kind(last[:-1])] += 1
                    if "." in line:
                        for one, two in zip(pieces, pieces[1:]):
                            if one[-1] == ".":
                                pairs[lang][_kind(one[:-1]), _kind(two.rstrip("."))] += 1
                    for one, two in zip(pieces, pieces[1:]):
                        if one[-1] in SURE:
                            starts[lang][_kind(two)] += 1
        if sum(map(len, plain.values())) + sum(map(len, pairs.values())) > 250_000:  # only bounds a worker's memory
            yield from rows()
    yield from rows()


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, kind, a, b, n, starts, line_ends) over all rows; one shuffle of counts that the tasks have summed up."""
    counted = df.where(F.col(text_col).isNotNull()).select(text_col)
    counted = counted.mapInArrow(_count, "lang string, kind string, a string, b string, n bigint, starts bigint, line_ends bigint")
    return counted.groupBy("lang", "kind", "a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "starts", "line_ends")))


def learn(stats: DataFrame) -> DataFrame:
    """(lang, kind, a, b): abbreviations (kind a), those of them that were seen at a line's end (e), sentence starters (s) and
    collocations (c) of each language."""
    dunning = lambda a, b, ab, n: (  # noqa: E731 - -2 log lambda that a is followed by b at the rate of b anywhere, against 0.99
        -2
        * (
            F.col(ab) * F.log(F.greatest(F.col(b) / F.col(n), F.lit(1e-9)))
            + (F.col(a) - F.col(ab)) * F.log(1 - F.least(F.col(b) / F.col(n), F.lit(1 - 1e-9)))
            - F.col(ab) * math.log(0.99)
            - (F.col(a) - F.col(ab)) * math.log(0.01)
        )
    )
    totals = stats.groupBy("lang").agg(
        F.sum(F.when(F.col("kind").isin("w", "p"), F.col("n"))).cast("double").alias("tokens"),
        F.sum(F.when(F.col("kind") == "p", F.col("n"))).cast("double").alias("periods"),
        F.sum("starts").cast("double").alias("boundaries"),
        F.sum("line_ends").cast("double").alias("all_line_ends"),
    )
    types = stats.where("kind IN ('w', 'p')").groupBy("lang", "a").agg(
        F.sum(F.when(F.col("kind") == "p", F.col("n")).otherwise(0)).alias("with"),
        F.sum(F.when(F.col("kind") == "w", F.col("n")).otherwise(0)).alias("without"),
        F.sum("starts").alias("starts"),
        F.sum("line_ends").alias("line_ends"),
    )
    types = types.join(F.broadcast(totals), "lang")  # one row a language that the guesser knows
    letters = F.length(F.translate("a", ".", ""))
    inner = F.length("a") - letters + 1
    types = types.withColumn("all", F.col("with") + F.col("without")).withColumn("letters", letters)
    score = dunning("all", "periods", "with", "tokens") * F.exp(-letters.cast("double")) * inner * F.pow(F.greatest(letters, F.lit(2)).cast("double"), -F.col("without").cast("double"))
    expected = F.col("with") * F.col("all_line_ends") / F.greatest(F.col("periods"), F.lit(1.0))
    dotted = types.where((F.col("with") > 0) & (letters > 0)).where((score >= ABBREVIATION) & (F.col("line_ends") <= LINE_END * expected))
    p1, p2 = F.col("starts") / F.col("boundaries"), (F.col("all") - F.col("starts")) / F.greatest(F.col("tokens") - F.col("boundaries"), F.lit(1.0))
    p = F.col("all") / F.col("tokens")

    def ll(k, m, x):
        x = F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(x) + (m - k) * F.log(1 - x)

    b, rest = F.col("boundaries"), F.greatest(F.col("tokens") - F.col("boundaries"), F.lit(1.0))
    k1, k2 = F.col("starts"), F.greatest(F.col("all") - F.col("starts"), F.lit(0))
    ratio = -2 * (ll(k1, b, p) + ll(k2, rest, p) - ll(k1, b, p1) - ll(k2, rest, p2))
    starters = types.where((F.col("starts") >= 5) & (p1 > p2) & (ratio >= STARTER) & (F.col("a") != "")).select("lang", F.lit("s").alias("kind"), "a", F.lit("").alias("b"))
    pairs = stats.where("kind = 'n'").select("lang", "a", "b", "n")
    second = stats.where("kind <> 'n'").groupBy("lang", F.col("a").alias("b")).agg(F.sum("n").alias("second"))
    follow = pairs.where("b <> ''").join(dotted.select("lang", "a", "with", "tokens"), ["lang", "a"]).join(second, ["lang", "b"])
    short = dotted.select("lang", F.lit("a").alias("kind"), "a", F.lit("").alias("b"))
    ending = dotted.where("line_ends > 0").select("lang", F.lit("e").alias("kind"), "a", F.lit("").alias("b"))
    # a pair is a collocation if its words meet far above chance: the ratio of association() as a Column
    one, both, other = F.col("with"), F.col("n"), F.greatest(F.col("second") - F.col("n"), F.lit(0))
    outside = F.greatest(F.col("tokens") - one, F.lit(1.0))
    chance, inside, beyond = F.col("second") / F.col("tokens"), both / one, other / outside
    meet = -2 * (ll(both, one, chance) + ll(other, outside, chance) - ll(both, one, inside) - ll(other, outside, beyond))
    collocations = follow.where((inside > beyond) & (meet >= COLLOCATION)).select("lang", F.lit("c").alias("kind"), "a", "b")
    return short.union(ending).union(starters).union(collocations)


class Splitter:
    """Sentences of one text under the learned statistics {lang: {kind: set}}."""

    def __init__(self, model: dict[str, dict[str, set]] | LearnedWords) -> None:
        self.model, self.guesser = model, LanguageGuesser()

    def _spans(self, line: str) -> list[tuple[int, int]]:
        """(open, close) positions of the quotations and brackets that close in their line."""
        spans, stack = [], []
        for i, c in enumerate(line):
            if c in OPENING and not (c == "‘" and i and line[i - 1].isalnum()):
                stack.append((i, OPENING[c]))
            elif c in ('"', "'", "’", "”", ")", "]", "»", "」", "』", "）", "】", "》", "›", "}"):
                before, after = line[i - 1 : i], line[i + 1 : i + 2]
                if c in "'’" and before.isalnum() and after.isalnum():
                    continue
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == c), None)
                if at is not None:
                    spans.append((stack[at][0], i))
                    del stack[at:]
                elif c == '"' or (c == "'" and not before.strip() and after.strip()):
                    stack.append((i, c))
        return sorted(spans)

    def split(self, text: str | None) -> list[tuple[int, int]]:
        if not text or not text.strip():
            return []
        lang = self.guesser.guess(text)
        learned = self.model.get(lang or "", {})
        period, bar = self._uses(text, learned)
        out, at = [], 0
        for brk in [*LINE_BREAK.finditer(text), None]:
            stop = brk.start() if brk else len(text)
            out += self._line(text[at:stop], at, learned, period, bar)
            at = brk.end() if brk else stop
        return out

    def _abbreviation(self, line: str, i: int, learned: dict[str, set]) -> tuple[str, bool]:
        """(type before the period at i, whether it is an abbreviation or an initial)."""
        j = i
        while j and not line[j - 1].isspace() and line[j - 1] not in STRIP:
            j -= 1
        kind = line[j:i].lower().lstrip(SURE + "|")
        # an initial is one bare letter: with a vowel sign it is a word
        return kind, kind in learned.get("a", ()) or len(kind) == 1 and kind.isalpha()

    def _uses(self, text: str, learned: dict[str, set]) -> tuple[bool, bool]:
        """Whether the row ends sentences with periods, and with bars."""
        others = sum(text.count(c) for c in "।॥۔。｡．")
        bars = len(re.findall(r"[^\W\d_][ऀ-ःऺ-ॏঁ-ঃ়-ৗ]* ?\|(?=\s|$|[^\W\d_]|[\"'”’»)\]“«(])", text))
        periods = 0
        for m in re.finditer(r"(?<![.\s])\s?\.(?![.\w])", text):
            i = m.end() - 1
            before = text[:i].rstrip(" ")[-1:]
            if before.isdigit() or not self._abbreviation(text, i, learned)[1]:
                periods += 1
        bar = bars > others and text.count("|") == bars
        return periods > others + (bars if bar else 0), bar and bars >= periods

    def _line(self, line: str, base: int, learned: dict[str, set], period: bool, bar: bool) -> list[tuple[int, int]]:
        spans = self._spans(line)
        closes = {c for _, c in spans}
        starts = learned.get("s", ())
        ends, begin, after_all = [], 0, 0
        for m in MARKS.finditer(line):
            run, i, j = m.group(), m.start(), m.end()
            if i < after_all:
                continue
            core = run.strip(".…") if set(run) & set(SURE + "‼⁇⁈⁉") else run
            if set(run) <= {".", "…"}:
                if "…" in run or len(run) >= 3 or not period or not self._period_ends(line, i, j, begin, learned, starts, closes):
                    continue
            elif set(run) <= {"|"}:
                if not bar:
                    continue
            elif not core:
                continue
            while j < len(line) and (j in closes or (line[j] in CLOSING and line[j] not in "'\"")):
                j += 1
            if any(a < i and j <= b for a, b in spans):  # still inside, and no closing sign right behind
                continue
            if any(a < m.start() < b and b >= j for a, b in spans):
                continue
            ends.append(j)
            after_all = begin = j
        out, at = [], 0
        for end in [*ends, len(line)]:
            a, b = at, end
            while a < b and line[a].isspace():
                a += 1
            while b > a and line[b - 1].isspace():
                b -= 1
            if a < b:
                if out and not any(c.isalnum() for c in line[a:b]):
                    out[-1] = (out[-1][0], base + b)  # marks set off by a space belong to the sentence before
                else:
                    out.append((base + a, base + b))
            at = end
        return out

    def _period_ends(self, line: str, i: int, j: int, begin: int, learned: dict[str, set], starts, closes: set[int]) -> bool:
        before, after = line[i - 1 : i], line[j : j + 1]
        kind, short = self._abbreviation(line, i, learned)
        if before.isdigit() and after.isdigit():
            return False
        head = line[begin:i].strip()
        if DIGITS.match(head):  # the number of a listed point
            return False
        follow = line[j:].lstrip().lstrip("\"'“«‘([「（").split(None, 1)
        nxt = follow[0] if follow else ""
        if after and not after.isspace() and j not in closes and after not in CLOSING:
            if not (after.isalpha() or after.isdigit() or after in OPENING or after in "\"'—–-"):
                return False  # a mark such as a comma follows
            if short or before.isdigit() != after.isdigit() and after.isdigit():
                return False
            word = re.match(r"[^\s.]*", line[j:]).group()
            if after.isascii() and after.isalpha():
                return after.isupper() and len(kind) > 2 and before.islower()
            return len(word) > 2 and _letters(kind) > 2 and (f"{kind}.{word.lower()}" not in learned.get("a", ()))
        if not nxt:
            return True
        if nxt[0].islower():
            return False
        if short:
            following = _kind(nxt.rstrip("."))
            return kind in learned.get("e", ()) and following in starts and (kind, following) not in learned.get("c", ())
        return True


def model_rows(df: DataFrame, text_col: str = "text") -> DataFrame:
    """What ``learn`` finds in the texts; the counts are read several times, so they are cut first."""
    return learn(cut(statistics(df, text_col)))


def _as_model(rows: list) -> dict[str, dict[str, set]]:
    model: dict[str, dict[str, set]] = {}
    for r in rows:
        model.setdefault(r["lang"], {}).setdefault(r["kind"], set()).add((r["a"], r["b"]) if r["kind"] == "c" else r["a"])
    return model


class LearnedWords:
    """What was learned of each language, read from the shared folder when a text of it is met."""

    def __init__(self, folder: str) -> None:
        self.folder, self.held = folder, {}

    def get(self, lang: str, default: dict) -> dict[str, set]:
        if lang not in self.held:
            self.held[lang] = self._read(lang)
        return self.held[lang] or default

    def _read(self, lang: str) -> dict[str, set]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        files, path = file_system(self.folder)
        path = f"{path}/lang={lang}"
        if files.get_file_info(path).type == fs.FileType.NotFound:
            return {}
        found: dict[str, set] = {}
        for file in files.get_file_info(fs.FileSelector(path)):
            if file.path.endswith(".parquet"):
                with files.open_input_file(file.path) as source:
                    table = pq.ParquetFile(source).read(["kind", "a", "b"])
                for kind, a, b in zip(*(c.to_pylist() for c in table.columns), strict=True):
                    found.setdefault(kind, set()).add((a, b) if kind == "c" else a)
        return found


def _split_with(folder: str, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(LearnedWords(folder))
        for batch in batches:
            for block in blocks(batch):
                ids, start, end = [], [], []
                for key, text in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                    for a, b in splitter.split(text):
                        ids.append(key)
                        start.append(a)
                        end.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(ids, block.column(0).type), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=[id_col, "start_at", "end_at"])

    return run


def split_sentences(df: DataFrame, corpus: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """(id_col, start_at, end_at) of each sentence of df, with statistics learned from all of corpus."""
    learned = cut(model_rows(corpus, text_col))
    # a collocation decides only where its abbreviation ends lines and its second word is a starter
    ending, starter = (learned.where(F.col("kind") == k).select("lang", F.col("a").alias(c)) for k, c in (("e", "a"), ("s", "b")))
    asked = learned.where("kind = 'c'").join(ending, ["lang", "a"], "left_semi").join(starter, ["lang", "b"], "left_semi")
    folder = new_folder(df.sparkSession, "learned-words")
    learned.where("kind <> 'c'").unionByName(asked).write.partitionBy("lang").parquet(folder)
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_split_with(folder, id_col), f"`{id_col}` {kind}, start_at int, end_at int")
