"""The language of a text by script and function words, over cached white-space pieces.

Used by problems 2, 3 and 4. Scripts that one language here uses decide alone; languages that share a script are told apart by
function words. Null, blank and symbol-only texts have language None.
"""

from __future__ import annotations

import numpy as np

from .words import CACHE_LENGTH, CACHE_WORDS, WordHasher, words

# First and last code point of the scripts that matter, and what letters of them say.
SCRIPTS = (
    (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC0, 0x24F, "latin"), (0x1E00, 0x1EFF, "latin"), (0x370, 0x3FF, "greek"), (0x400, 0x52F, "cyrillic"), (0x590, 0x5FF, "hebrew"),
    (0x600, 0x6FF, "arabic"), (0x750, 0x77F, "arabic"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFC, "arabic"), (0x900, 0x963, "devanagari"), (0x970, 0x97F, "devanagari"), (0x980, 0x9E5, "bengali"), (0x9F0, 0x9FF, "bengali"), (0xA00, 0xA65, "gurmukhi"),
    (0xA80, 0xAE5, "gujarati"), (0xB00, 0xB65, "odia"), (0xB80, 0xBE5, "tamil"), (0xC00, 0xC65, "telugu"), (0xC80, 0xCE5, "kannada"), (0xD00, 0xD65, "malayalam"), (0xE00, 0xE4F, "thai"),
    (0x3040, 0x30FF, "kana"), (0xFF66, 0xFF9D, "kana"), (0x3400, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"),
)
# Frequent function words of languages that share a script.
FUNCTION_WORDS = {
    "hi": "के की का में है हैं को ने से पर और था थे थी कि यह वह इस उस जो भी नहीं तक लिए कर रहा रही रहे गया गई गए हो हुआ हुई किया जिसका बाद साथ एक अब",
    "mr": "आहे आहेत आणि या हा ही हे चे च्या चा ची ला नाही होते होता होती मध्ये यांनी यांचा यांची यांच्या येथे येथील केले केली केला असून पासून साठी बाबत कडे आता पण गेले गेली झाली झाला झाले हजार नंतर मिटला मधील अजून यांना ते त्या त्यांनी त्यांच्या ती काय आले आली येत होणार करण्यात",
    "ne": "छ छन् र को मा ले लाई हो भएको गरेको पनि थियो यो त्यो गर्न हुन्छ",
    "en": "the of and to in a is that for on with as was by at from it an be has have are not but this had were will who said after over their",
    "fr": "le la les de des du et un une est dans que qui pour sur avec au aux par ne pas ce cette il elle sont",
    "de": "der die das und ist nicht ein eine den dem des mit von zu auf im für sich auch als wird werden sind",
    "es": "el la los las de del y que en un una es por con para se no al lo como su más pero está",
    "it": "il lo la gli le di del della e che in un una è per con non si da sono dal nel alla",
    "pt": "o os as de do da dos e que em um uma é por com para se não no na ao mais foi",
    "id": "yang dan di ke dari untuk dengan ini itu pada tidak dalam akan adalah oleh",
    "ur": "میں کے کی کا کو سے اور ہے ہیں نے پر کہ اس ایک یہ نہیں تھا تھے تھی بعد گیا گئی ہو رہا لیے تک",
    "fa": "از به در که این را با است برای آن یک شد می‌شود تا بر هم",
    "ar": "في من على أن إلى هذا هذه التي الذي عن مع كان لا ما قد",
    "bn": "এবং যে এই করে থেকে না জন্য এর নিয়ে হয়েছে ও পরে করেছে ছিল কাছে সঙ্গে এলাকায় এলাকার হবে কি কী আর তার তিনি সে তা হয় করা করতে বলে বলেন বলছে আছে গেছে দিয়ে মধ্যে এখন এখনও কোনও সব দুজনেই জানিয়েছেন পেলে পেয়েছে",
    "as": "আৰু এই কৰা হৈছে পৰা বাবে কৰিছে",
    "zh": "的 了 在 是 和 与 不 有 为 将 对 就 也 从 到 据 被 以 于 还 这 那 他 等 但 会 没 来 其 中 之 及 由 而 或 所 把 让 给 后 时 都 说 要 么 怎 自 已 可 能 地 得 着 过 们 很 再 又 才 一 仍 并",
    "ja": "の に は を が と で た て も し か ら な さ れ い る あ っ",
}
OF_SCRIPT = {
    "latin": ("en", "fr", "de", "es", "it", "pt", "id"), "devanagari": ("hi", "mr", "ne"), "arabic": ("ur", "fa", "ar"), "bengali": ("bn", "as"),
    "han": ("zh",), "kana": ("ja",), "hangul": ("ko",), "cyrillic": ("ru",), "greek": ("el",), "hebrew": ("he",), "thai": ("th",), "gurmukhi": ("pa",), "gujarati": ("gu",),
    "odia": ("or",), "tamil": ("ta",), "telugu": ("te",), "kannada": ("kn",), "malayalam": ("ml",),
}
SCRIPT_NAMES = tuple(OF_SCRIPT)


class _Script(dict):
    def __missing__(self, ch: str) -> int:
        code = ord(ch)
        out = next((SCRIPT_NAMES.index(name) for first, last, name in SCRIPTS if first <= code <= last), -1)
        self[ch] = out
        return out


class LanguageGuesser:
    """Letters by script and function words by language, summed over pieces that are looked at once each."""

    def __init__(self, common: dict[str, set[str]] | None = None) -> None:
        lists = {lang: set(ws.split()) for lang, ws in FUNCTION_WORDS.items()}
        for lang, ws in (common or {}).items():
            lists.setdefault(lang, set()).update(ws)
        self.function: dict[str, tuple[str, ...]] = {}
        for lang, ws in lists.items():
            for w in ws:
                self.function[w] = (*self.function.get(w, ()), lang)
        self.script, self.cache = _Script(), {}

    def _piece(self, piece: str) -> tuple[dict[int, int], tuple[str, ...], int]:
        letters: dict[int, int] = {}
        for ch in piece:
            if (s := self.script[ch]) >= 0:
                letters[s] = letters.get(s, 0) + 1
        found = words(piece)
        return letters, tuple(lang for w in found for lang in self.function.get(w, ())), len(found)

    def evidence(self, text: str | None) -> tuple[dict[str, int], dict[str, int]]:
        """(letters by script, function-word hits by language)."""
        scripts: dict[str, int] = {}
        hits: dict[str, int] = {}
        cache = self.cache
        for piece in (text or "").split():
            got = cache.get(piece)
            if got is None:
                got = self._piece(piece)
                if len(piece) <= CACHE_LENGTH:
                    if len(cache) > CACHE_WORDS:
                        cache.clear()
                    cache[piece] = got
            for s, n in got[0].items():
                scripts[SCRIPT_NAMES[s]] = scripts.get(SCRIPT_NAMES[s], 0) + n
            for lang in got[1]:
                hits[lang] = hits.get(lang, 0) + 1
        return scripts, hits

    def guess(self, text: str | None) -> str | None:
        """The language, or None where no letters decide. A script's first language stands in where no function word is found."""
        scripts, hits = self.evidence(text)
        return decide(scripts, hits)


class EvidenceHasher(WordHasher):
    """Word hashes and the evidence of language of the same texts, over whole batches."""

    def __init__(self) -> None:
        self.guesser = LanguageGuesser()
        self.languages = tuple(FUNCTION_WORDS)
        super().__init__()

    def _reset(self) -> None:
        super()._reset()
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((0, len(SCRIPT_NAMES) + len(self.languages)), np.int32)

    def met(self, piece: str, found: list[str]) -> None:
        letters, hits, _ = self.guesser._piece(piece)
        row = np.zeros(self.table.shape[1], np.int32)
        for script, n in letters.items():
            row[script] = n
        for lang in hits:
            row[len(SCRIPT_NAMES) + self.languages.index(lang)] += 1
        self.rows.append(row)

    def batch_with_evidence(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[dict[str, int], dict[str, int]]]]:
        """(hashes, offsets, evidence of each text)."""
        index, counts = self.index(texts)
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows, np.int32)])
            self.rows = []
        sums = np.concatenate([np.zeros((1, self.table.shape[1]), np.int32), np.cumsum(self.table[index], axis=0, dtype=np.int32)])
        ends = np.cumsum(counts)
        each = sums[ends[1:]] - sums[ends[:-1]]
        split, evidence = len(SCRIPT_NAMES), []
        for row in each:
            some = np.flatnonzero(row)
            evidence.append(({SCRIPT_NAMES[k]: int(row[k]) for k in some if k < split}, {self.languages[k - split]: int(row[k]) for k in some if k >= split}))
        return *self.hashed(index, counts), evidence


def decide(scripts: dict[str, int], hits: dict[str, int]) -> str | None:
    if not scripts:
        return None
    weighed = {s: n * (3 if s in ("han", "kana", "hangul") else 1) for s, n in scripts.items()}
    if weighed.get("kana", 0) * 5 >= weighed.get("han", 0) > 0 or "kana" in weighed and "han" not in weighed:
        weighed["kana"] = weighed.get("kana", 0) + weighed.pop("han", 0)
    main = max(weighed, key=lambda s: (weighed[s], s))
    of = OF_SCRIPT[main]
    return max(of, key=lambda lang: (hits.get(lang, 0), -of.index(lang)))
