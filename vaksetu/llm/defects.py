"""Problem 3: broken article and summary pairs.

Several noisy labelling functions vote on each defect of a row: 1 for it, -1 against it, 0 no opinion; none looks at the vote of another. What
the functions are worth is learned without labels, by expectation maximisation over the counts of vote patterns (a naive-Bayes label
model). It starts from the same weak guess for every function, which counts as PRIOR_ROWS rows and keeps the two classes from changing
places; only where a function states the definition of a defect the guess is sharp. The counts of patterns are at most 3 to the number
of functions, however many rows there are. A row keeps every defect whose posterior exceeds the cutoff of that defect; where all
functions abstain, or none votes for it, there is no defect.

Two functions look at the corpus: endings that are followed by end marks elsewhere are complete, short summaries that many
different articles share say nothing about their article.

Nulls: a null summary is empty; a null text is copied by nothing and has no language. A summary without words, or only with a placeholder, has
no other defect than being empty. Every row is judged, repeated ones alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .joins import looked_up
from .language import OF_SCRIPT, EvidenceHasher, decide
from .neardup import blocks
from .quality import Analyser, nearest
from .words import words

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")
#: Posteriors above which a row has a defect; validated on defects put into sound rows by tests/llm/test_defects.py.
CUTOFFS = {"empty": 0.5, "refusal": 0.9, "copy": 0.5, "wrong_language": 0.9, "truncated": 0.5}
#: Rows of each class that the guesses below weigh as much as.
PRIOR_ROWS = 5
# What stands in place of a summary.
PLACEHOLDERS = set(
    """null none nil nan n a|na|n a|tbd|tba|todo|to do|to be done|to be added|xxx|xx|undefined|empty|blank|no summary|summary|abstract|headline|title|text|placeholder|missing|not available|unavailable|no data|no text|no summary available|summary not available|summary unavailable|not applicable|to be written|to follow|coming soon|see text|see article|as above|same as above|insert summary here|add summary|untitled|test|lorem ipsum|
    |सारांश|कोई सारांश नहीं|सारांश नहीं|सारांश उपलब्ध नहीं|सारांश उपलब्ध नहीं है|उपलब्ध नहीं|रिक्त|खाली|शून्य|अज्ञात|शीर्षक|लागू नहीं|बाद में|यहाँ सारांश लिखें|सारांश यहाँ|सारांश बाद में|कुछ नहीं|सारांश नाही|उपलब्ध नाही|रिकामे
    |সারাংশ|সারাংশ নেই|খালি|خلاصہ|خلاصہ نہیں|خالی|دستیاب نہیں|摘 要|无|无 摘 要|暂 无|待 定|空|要 約|な し|要 約 な し|未 定""".replace("\n", "").split("|")
) | {"null", "none", "nil", "nan", "n a"}
PLACEHOLDERS = {" ".join(p.split()) for p in PLACEHOLDERS} - {""}
# The writer, in the first person, says that there will be no summary.
REFUSAL = re.compile(
    r"\b(?:I|we) (?:can ?not|can['’]?t|could ?n['’]?t|won['’]?t|will not|would rather not|must (?:decline|refuse)|have to decline|decline|refuse|do not|don['’]?t|am (?:not able|unable|not allowed|not permitted|afraid)|['’]m (?:not able|unable|sorry|afraid|not allowed)|may not)\b"
    r"|^(?:unable|not able|not allowed|not permitted) to\b|\b(?:for me to|outside what I|beyond what I|against my|my guidelines)\b|\bI may (?:not )?(?:summari[sz]e|write|say)\b|not be appropriate (?:for me )?to|(?:request|article) (?:cannot|can not|can['’]t) be (?:fulfilled|completed|summari[sz]ed)"
    r"|मैं [^।]*(?:नहीं (?:कर|लिख|दे|बना|बता|पढ़)?\s?(?:सकता|सकती|सकते|पाऊँगा|पाऊंगा|पाऊँगी|पाऊंगी|करूँगा|करूंगा|करूँगी|करूंगी|दूँगा|दूंगा|दूँगी|लिखूँगा)|असमर्थ)|मुझे [^।]*(?:बचना|मना|इनकार|अनुमति नहीं|क्षमा)|हम [^।]*नहीं (?:कर|दे|लिख)\s?सकते|मुझसे [^।]*नहीं"
    r"|अनुरोध [^।]*(?:पूरा नहीं|अस्वीकार|स्वीकार नहीं)|(?:संक्षेप|सारांश)[^।]*(?:अनुमति नहीं|नहीं (?:लिख|दे|बना|कर)|संभव नहीं|मना)|मी [^.]*(?:शकत नाही|शकणार नाही|करणार नाही|देणार नाही)|मला [^.]*(?:शक्य नाही|परवानगी नाही|माफ)|विनंती [^.]*नाही"
    r"|আমি [^।]*(?:পারব না|পারছি না|পারি না|অক্ষম|করব না)|আমার পক্ষে [^।]*সম্ভব নয়|অনুরোধ [^।]*(?:নয়|না)|میں [^۔]*(?:نہیں (?:کر|لکھ|دے) ?(?:سکتا|سکتی)|قاصر ہوں|سے قاصر|معذور)|مجھے [^۔]*(?:اجازت نہیں|معذرت)|درخواست [^۔]*(?:نہیں|مسترد)"
    r"|我(?:们)?(?:不能|无法|不会|没办法|拒绝|不便)|无法(?:为您|提供|完成|生成|总结|概括|满足)|不便(?:评论|总结)|(?:要約|お手伝い|お答え|対応|回答)[^。]*(?:できません|いたしかねます|致しかねます)|お(?:答え|手伝い)でき",
    re.I,
)
OWN_VOICE = re.compile(r"(?<!\S)(?:मैं|मेर[ाेी]|मुझे|मुझसे|मुझको|मी|मला|माझ[ाेी]|माझ्या|আমি|আমার|আমাকে|مجھے|میرے|میری|میرا)(?!\S)|\b(?:I|me|my|I['’](?:m|ve|d|ll))\b|我|私は|私に|当方")
INABILITY = re.compile(
    r"संभव नहीं|असमर्थ|अनुमति नहीं|नहीं (?:कर|लिख|दे|बना|बता) ?(?:सक|पा)|शक्य नाही|परवानगी नाही|সম্ভব নয়|পারব না|পারছি না|ممکن نہیں|قاصر|معذور|\b(?:cannot|can['’]t|can not|unable|not able|not possible|impossible|decline|refuse)\b|无法|不能|不便|できません|できかねます|かねます|無理",
    re.I,
)
META = re.compile(
    r"\bas an? (?:AI|assistant|language model|model|automated)|\blanguage model\b|\bsummar(?:y|i[sz]e|ies)\b|\bcondense\b|\bcomply\b|(?:एक )?(?:सहायक|भाषा मॉडल|एआई|मॉडल) के रूप में|सारांश|संक्षेप|का सार(?!\S)|टिप्पणी नहीं|अनुरोध|एक सहाय्यक म्हणून|सारांश|সারাংশ|সহকারী হিসেবে|خلاصہ|معاون کے طور پر|作为.{0,6}(?:助手|模型)|摘要|总结|概括|要約|アシスタント",
    re.I,
)
APOLOGY = re.compile(
    r"^\W*(?:sorry|i['’]?m sorry|i am sorry|apologies|i apologi[sz]e|unfortunately|regrettably|माफ़ (?:कीजिए|करें|कीजिएगा)|माफ (?:कीजिए|करें|करा)|क्षमा (?:करें|कीजिए|चाहता|चाहती)|खेद है|मुझे खेद|मुझे माफ़|दुर्भाग्य|क्षमस्व|দুঃখিত|ক্ষমা|মাফ|معذرت|معاف|افسوس|抱歉|对不起|很抱歉|不好意思|申し訳|すみません|恐れ入り)", re.I
)
# Most matches of the two patterns above have one of these words; what has none of them, no stem below and no character of a
# script without spaces matches neither.
TRIGGERS = set(
    "i we unable not my me may request article ai assistant model language summary summarise summarize summarises summarizes summaries condense comply i'm summarised summarized "
    "मैं मुझे मुझसे हम अनुरोध संक्षेप सारांश टिप्पणी सहायक मॉडल एआई मी मला विनंती सहाय्यक আমি আমার অনুরোধ সারাংশ সহকারী میں مجھے درخواست خلاصہ معاون".split()
)
STEMS = (
    "not be appropriate", "request", "article", "as a", "language model", "summar", "condense", "comply", "मैं", "मुझे", "मुझसे", "हम", "अनुरोध", "संक्षेप", "सारांश", "टिप्पणी", "सहायक", "मॉडल", "एआई",
    "का सार", "मी ", "मला", "विनंती", "सहाय्यक", "আমি", "আমার", "অনুরোধ", "সারাংশ", "সহকারী", "میں", "مجھے", "درخواست", "خلاصہ", "معاون",
)
ALONE = re.compile(r"\b(?:I|we|me|my|unable|not)\b", re.I)
UNSPACED = re.compile("[\u3040-\u9fff]")
# Words that a sentence of these languages does not end with.
DANGLING = set(
    "the a an of to and or in on at by for with from that as but than its their his her this between after before under over has have had is are was were be been will says said "
    "ने के की का को में से पर कि और या तथा एवं लिए बाद बीच वह यह जो जिसका जिसकी जिसके द्वारा तक अब एक "
    "च्या चे ची चा आणि व किंवा यांच्या यांचा यांनी मधील येथील साठी पासून कडे बाबत "
    "এর ও এবং যে জন্য থেকে কাছে সঙ্গে নিয়ে نے کے کی کا کو میں سے پر کہ اور لیے بعد درمیان جس".split()
)
END_MARK = re.compile(r"[।॥۔。！？!?؟]+[\"'”’»」）)\]]*\s*$|(?<![.\s])\s?\.[\"'”’»)\]]*\s*$|\|\s*$")
DOTS = re.compile(r"(?:\.{2,}|…)[\"'”’»]*\s*$")
BREAK_MARK = re.compile(r"[,،、，;:\-–—(\[“«「]\s*$")
#: A short summary that so many different articles share says nothing about any; and how short it is in words.
SHARED, SHORT = 3, 10
#: Endings seen at least so often are judged by how often an end mark follows them.
SEEN, COMPLETE, INCOMPLETE = 6, 0.12, 0.03

#: First guesses: chance of a vote for the defect given it, given none, chance of a vote against it given it, given none. WEAK holds for any function
#: that is somewhat right; SHARP for the one that is the definition of its defect, MARK for one that only ever votes against.
WEAK, SHARP, MARK = (0.5, 0.02, 0.1, 0.6), (0.95, 0.0005, 0.0005, 0.95), (0.01, 0.01, 0.02, 0.6)
FUNCTIONS: dict[str, tuple[tuple[str, float, float, float, float], ...]] = {
    "empty": tuple((name, *WEAK) for name in ("no_words", "placeholder", "in_brackets", "shared_short")),
    "refusal": tuple((name, *WEAK) for name in ("first_person", "about_summaries", "apology", "own_voice", "inability", "shared")),
    "copy": (("run_of_words", *SHARP), ("words_in_text", *WEAK)),
    "wrong_language": tuple((name, *WEAK) for name in ("script", "function_words", "foreign_words")),
    "truncated": tuple((name, *(MARK if name in ("end_mark", "final_pair") else WEAK)) for name in ("ending", "final_word", "final_pair", "unknown_word", "end_mark", "break_mark", "dangling")),
}
SCRIPT_OF = {lang: name for name, langs in OF_SCRIPT.items() for lang in langs}
#: Hashes of the end of a summary: its last two words, its last word, the last word and the last two as the articles' sentences have them, and all words.
HASHES = ("h2", "h1", "hf", "hp", "hs")
VOTES = [f"{d}.{f[0]}" for d in DEFECTS for f in FUNCTIONS[d]]


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


#: Sets the hashes of words that end sentences of articles apart.
FINAL = "\x1e"


def _number_free(word: str) -> str:
    return "#" if word.isdigit() else word


def _unspaced(word: str) -> bool:
    return "\u3040" <= word[-1] <= "\u9fff"


def _sentences_of(summary: str) -> list[tuple[list[str], bool]]:
    """(words, whether an end mark follows) of the stretches between end marks."""
    out = []
    parts = re.split(r"([।॥۔。！？!?؟|]+|\.{2,}|…|\.(?=\s|$|[\"'”’»)]))", summary)
    for k in range(0, len(parts), 2):
        found = [_number_free(w) for w in words(parts[k])]
        mark = parts[k + 1] if k + 1 < len(parts) else ""
        if found:
            out.append((found, bool(mark) and not mark.startswith("..") and mark != "…"))
    return out


def endings(df: DataFrame, text_col: str = "text", summary_col: str = "summary") -> DataFrame:
    """(h, seen, marked): how often each word and pair of words stands in the summaries, and with an end mark right behind; and how
    often each word and pair ends a sentence of the articles (seen alone, under hashes of their own)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        marked: Counter = Counter()

        def rows():
            yield pa.RecordBatch.from_arrays([pa.array([_hash(*g) for g in seen], pa.int64()), pa.array(list(seen.values()), pa.int64()), pa.array([marked[g] for g in seen], pa.int64())], names=["h", "seen", "marked"])
            seen.clear()
            marked.clear()

        for batch in batches:
            for block in blocks(batch, 1024):
                for summary in block.column(0).to_pylist():
                    for found, mark in _sentences_of(summary or ""):
                        one, two = [(w,) for w in found], list(zip(found, found[1:]))
                        seen.update(one)
                        seen.update(two)
                        if _unspaced(found[-1]):
                            seen.update(three := list(zip(found, found[1:], found[2:])))
                            if mark and three:
                                marked[three[-1]] += 1
                        if mark:
                            marked[one[-1]] += 1
                            if two:
                                marked[two[-1]] += 1
                for text in block.column(1).to_pylist():
                    # what follows the last mark ends no sentence
                    ends = [w for part in _ends_of(text).split(text or "")[:-1] if (w := _last_words(part))]
                    seen.update([(FINAL, w[-1]) for w in ends])
                    seen.update([(FINAL, *w) for w in ends if len(w) == 2])
            if len(seen) > 400_000:  # only bounds a worker's memory
                yield from rows()
        yield from rows()

    return df.select(summary_col, text_col).mapInArrow(count, "h bigint, seen bigint, marked bigint").groupBy("h").agg(F.sum("seen").alias("seen"), F.sum("marked").alias("marked"))


#: Where sentences end, for counting their last words: sure marks, bars, and periods before white space and no figure or small letter; periods
#: end nothing in a text that has other full stops.
SURE_ENDS = re.compile(r"[।॥۔。！？!?؟|]+")
SENTENCE_ENDS = re.compile(r"[।॥۔。！？!?؟|]+|\.(?=\s+[^\s0-9०-९a-z]|\s*$)")
QUOTES = str.maketrans("", "", "\"'“”«»‘’()[]「」『』,;:")
#: Words that end so many sentences of the articles may end a summary.
FINAL_TIMES = 5


def _ends_of(text: str | None) -> re.Pattern:
    return SURE_ENDS if text and ("।" in text or "۔" in text or "。" in text) else SENTENCE_ENDS


def _last_words(stretch: str) -> tuple[str, ...]:
    """The last two words of a stretch of text without their marks, as far as there are two; of scripts without spaces, its last two characters
    and the last four."""
    found = tuple(w for piece in stretch.rsplit(None, 2)[-2:] if (w := piece.translate(QUOTES).lower()))
    if found and "\u3040" <= found[-1][-1] <= "\u9fff":
        return (found[-1][-4:], found[-1][-2:]) if len(found[-1]) > 2 else found[-1:]
    return found


def _final(summary: str | None) -> tuple[str, ...]:
    """The last words of a summary, as those of the articles' sentences are counted."""
    return _last_words(re.sub(r"[\s।॥۔。！？!?|.,;:…()\"“”«»'’\-–—،؟]+$", "", summary or ""))


def _row_votes(profiles: list, common: set[str], id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, analyser = EvidenceHasher(), Analyser(common)
        for batch in batches:
            for block in blocks(batch):
                texts, summaries = block.column(1).to_pylist(), block.column(2).to_pylist()
                t_hash, t_at, t_lang = hasher.batch_with_evidence(texts)
                s_hash, s_at, s_lang = hasher.batch_with_evidence(summaries)
                out: dict[str, list] = {name: [] for name in (*HASHES, "short", "said", *VOTES)}
                for n, (text, summary) in enumerate(zip(texts, summaries, strict=True)):
                    own = words(summary)
                    votes = _votes(text, summary, own, t_hash[t_at[n] : t_at[n + 1]], s_hash[s_at[n] : s_at[n + 1]], t_lang[n], s_lang[n], analyser, profiles)
                    said = bool(own) and votes["empty.placeholder"] != 1
                    last = _sentences_of(summary) if said else []
                    tail = last[-1][0] if last else []
                    # characters that are words alone say little: two of them count as the last word there
                    size = 2 if tail and _unspaced(tail[-1]) else 1
                    out["h2"].append(_hash(*tail[-size - 1 :]) if len(tail) > size else None)
                    out["h1"].append(_hash(*tail[-size:]) if tail else None)
                    final = _final(summary) if said else ()
                    out["hf"].append(_hash(FINAL, final[-1]) if final else None)
                    out["hp"].append(_hash(FINAL, *final) if len(final) == 2 else None)
                    out["hs"].append(_hash("s", *own) if own else None)
                    out["short"].append(len(own) <= SHORT)
                    out["said"].append(said)
                    for name in VOTES:
                        out[name].append(votes.get(name, 0))
                yield pa.RecordBatch.from_arrays(
                    [block.column(0), *(pa.array(out[c], pa.int64()) for c in HASHES), *(pa.array(out[c], pa.bool_()) for c in ("short", "said")), *(pa.array(out[v], pa.int8()) for v in VOTES)],
                    names=[id_col, *HASHES, "short", "said", *(v.replace(".", "_") for v in VOTES)],
                )

    return run


def _maybe(raw: str, own: list[str]) -> bool:
    """False only where neither REFUSAL nor META matches."""
    if not TRIGGERS.isdisjoint(own) or UNSPACED.search(raw) or ALONE.search(raw):
        return True
    low = raw.casefold().replace("ı", "i").replace("\u0307", "")  # as the patterns fold cases
    return any(stem in low for stem in STEMS)


def _votes(text, summary, own: list[str], t: np.ndarray, s: np.ndarray, of_text: tuple, of_summary: tuple, analyser: Analyser, profiles: list) -> dict[str, int]:
    """The votes that a row alone decides."""
    votes: dict[str, int] = {}
    raw = (summary or "").strip()
    votes["empty.no_words"] = 1 if not own else -1
    votes["empty.placeholder"] = 1 if " ".join(own) in PLACEHOLDERS else -1 if len(own) > 2 else 0
    votes["empty.in_brackets"] = 1 if re.fullmatch(r"[\[(<{【（《][^\])>}】）》]*[\])>}】）》]", raw) and len(own) <= 4 else -1 if len(own) > 2 else 0
    # the patterns are long; a summary without any of their key words is spared them
    maybe = _maybe(raw, own)
    said = bool(own) and votes["empty.placeholder"] != 1
    for name, found in (
        ("first_person", maybe and REFUSAL.search(raw)), ("about_summaries", maybe and META.search(raw)), ("apology", APOLOGY.search(raw)), ("own_voice", OWN_VOICE.search(raw)), ("inability", INABILITY.search(raw)),
    ):
        votes[f"refusal.{name}"] = 0 if not said else 1 if found else -1
    if len(s) and len(t):
        where, needle = t.tobytes(), s.tobytes()
        at = where.find(needle)
        while at >= 0 and at % 8:
            at = where.find(needle, at + 1)
        votes["copy.run_of_words"] = 1 if at >= 0 else -1
        there = set(t.tolist())
        known = sum(x in there for x in s.tolist()) / len(s)
        votes["copy.words_in_text"] = 1 if known >= 0.999 else -1 if known < 0.9 else 0
        if said and len(s) >= 3:
            votes.update(_language_votes(text, of_text, of_summary, known, analyser, profiles))
    if said:
        closed = END_MARK.search(raw) and not DOTS.search(raw)
        votes["truncated.end_mark"] = -1 if closed else 0
        votes["truncated.break_mark"] = 1 if BREAK_MARK.search(raw) else 0
        votes["truncated.dangling"] = 1 if own[-1] in DANGLING and not closed else 0  # with nothing behind it
    return votes


def _language_votes(text: str, of_text: tuple, of_summary: tuple, known: float, analyser: Analyser, profiles: list) -> dict[str, int]:
    """What the letters, the function words and the other words of a summary say about its language. All abstain where the summary has no
    letters or fewer than three words, and where the text has no language: no letters, or junk."""
    lt, ls = decide(*of_text), decide(*of_summary)
    votes = dict.fromkeys(("wrong_language.script", "wrong_language.function_words", "wrong_language.foreign_words"), 0)
    if not lt or not ls:
        return votes
    st, ss = SCRIPT_OF[lt], SCRIPT_OF[ls]
    if st == ss and lt != ls and of_text[1].get(lt, 0) < 3:
        return votes  # the script alone does not show which of its languages the text has
    mine = sum(of_summary[0].values())
    if st in ("han", "kana") and ss in ("han", "kana"):
        kana = min(of[0].get("kana", 0) / sum(of[0].values()) for of in (of_text, of_summary))
        votes["wrong_language.script"] = 1 if lt != ls and kana < 0.02 and mine >= 6 else -1
    elif st == ss:
        votes["wrong_language.script"] = 0 if len(OF_SCRIPT[st]) > 1 else -1  # a script of several languages says nothing
    else:
        share = of_summary[0].get(st, 0) / mine
        votes["wrong_language.script"] = 1 if share < 0.3 else -1 if share > 0.6 else 0
    own, other = of_summary[1].get(ls, 0), of_summary[1].get(lt, 0)
    if lt == ls:
        votes["wrong_language.function_words"] = -1 if own else 0
    elif st == ss:
        # both sides must show their own language and not the other's
        shown = of_text[1].get(lt, 0) >= 3 and of_text[1].get(lt, 0) >= 2 * of_text[1].get(ls, 0) and own >= 2 and own > other
        votes["wrong_language.function_words"] = 1 if shown else 0
    else:
        votes["wrong_language.function_words"] = 1 if own > other or ss in ("han", "kana") else 0
    votes["wrong_language.foreign_words"] = 1 if known < 0.1 else -1 if known > 0.3 else 0
    if 1 in votes.values() and nearest(analyser.analyse(text)[1], profiles)[0] == "junk":
        return dict.fromkeys(votes, 0)
    return votes


def vote_table(df: DataFrame, profiles: list, common: set[str], id_col: str = "row_id", text_col: str = "text", summary_col: str = "summary") -> DataFrame:
    """(id_col, a column of -1, 0 or 1 for each function)."""
    kind = df.schema[id_col].dataType.simpleString()
    columns = [v.replace(".", "_") for v in VOTES]
    schema = f"`{id_col}` {kind}, {', '.join(f'{h} bigint' for h in HASHES)}, short boolean, said boolean, " + ", ".join(f"{c} tinyint" for c in columns)
    rows = cut(df.select(id_col, text_col, summary_col).mapInArrow(_row_votes(profiles, common, id_col), schema))
    known = endings(df, text_col, summary_col).where("seen >= 2")  # an ending seen once is unknown
    # only what short summaries share is asked for, so a group is counted, never gathered
    shared = rows.where("short AND hs IS NOT NULL").groupBy(F.col("hs").alias("h")).agg(F.count("*").alias("seen"), F.lit(0).cast("bigint").alias("marked")).where(F.col("seen") >= SHARED)
    joined = looked_up(rows, HASHES, known.union(shared.select("h", "seen", "marked")), id_col)

    def rate(key: str) -> Column:
        share = F.col(f"marked_{key}") / F.col(f"seen_{key}")
        return F.when(F.col(f"seen_{key}") >= SEEN, F.when(share >= COMPLETE, -1).when(share < INCOMPLETE, 1).otherwise(0)).otherwise(0)

    by_pair, by_word, finals = rate("h2"), rate("h1"), F.coalesce("seen_hf", F.lit(0))
    known_word = F.coalesce("seen_h1", F.lit(1)) >= SEEN
    among_many = F.when(F.col("seen_hs").isNotNull() & F.col("short"), 1).when(F.col("short"), 0).otherwise(-1)
    votes = {
        "truncated_ending": F.when(F.col("h2").isNull(), 0).otherwise(by_pair),
        "truncated_final_word": F.when(F.col("hf").isNull(), 0).when((finals >= FINAL_TIMES) & (by_word != 1), -1).when((finals < FINAL_TIMES) & (by_word == 1), 1).otherwise(0),
        "truncated_final_pair": F.when(F.coalesce("seen_hp", F.lit(0)) >= FINAL_TIMES, -1).otherwise(0),
        "truncated_unknown_word": F.when(F.col("h1").isNull(), 0).when(~known_word & (finals < 2), 1).when((by_word == -1) | (finals >= FINAL_TIMES), -1).otherwise(0),
        "empty_shared_short": among_many,
        "refusal_shared": F.when(F.col("said"), among_many).otherwise(0),
    }
    return joined.select(id_col, *(votes.get(c, F.col(c)).cast("int").alias(c) for c in columns))


def fit(patterns: dict[tuple[int, ...], int], functions: tuple[tuple[str, float, float, float, float], ...], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Posterior of the defect for each vote pattern, by expectation maximisation from the first guesses, which weigh PRIOR_ROWS rows. With no
    round it is what the guesses alone say. A pattern of abstentions has posterior 0 and teaches nothing; one without a vote for the defect
    has posterior 0 as well, and counts as sound."""
    keys = sorted(k for k in patterns if any(k))
    silent = dict.fromkeys((k for k in patterns if not any(k)), 0.0)
    if not keys:
        return silent
    n, votes = np.array([patterns[k] for k in keys], float), np.array(keys)
    index = np.where(votes == 0, 0, np.where(votes > 0, 1, 2))
    cast = index[:, :, None] == np.arange(3)  # pattern, function, (none, for, against)
    guess = np.array([[[1 - f[2] - f[4], f[2], f[4]], [1 - f[1] - f[3], f[1], f[3]]] for f in functions])  # function, class, vote
    chance, share = np.maximum(guess, 1e-9), 0.02
    at = np.arange(votes.shape[1])

    def posterior() -> np.ndarray:
        none, defect = (np.log(chance[at, c, index]).sum(axis=1) for c in (0, 1))
        return np.where((votes > 0).any(axis=1), 1 / (1 + np.exp(-np.clip(defect - none + np.log(share / (1 - share)), -500, 500))), 0.0)

    now = posterior()
    for _ in range(rounds):
        share = float(np.clip((now @ n + 2) / (n.sum() + 100), 1e-6, 0.5))
        for c, weight in ((0, n * (1 - now)), (1, n * now)):
            seen = np.einsum("p,pfv->fv", weight, cast)
            chance[:, c] = (seen + PRIOR_ROWS * np.maximum(guess[:, c], 1e-9)) / (weight.sum() + PRIOR_ROWS)
        before, now = now, posterior()
        if np.abs(now - before).max() < 1e-9:
            break
    return dict(zip(keys, now.tolist(), strict=True)) | silent


def posteriors(votes: DataFrame, id_col: str = "row_id") -> DataFrame:
    """(id_col, the posterior of each defect). votes is read twice: cut it."""
    out = votes
    for defect in DEFECTS:
        columns = [f"{defect}_{f[0]}" for f in FUNCTIONS[defect]]
        # at most 3 ** len(columns) rows
        counted = {tuple(r[c] for c in columns): r["count"] for r in votes.groupBy(*columns).count().collect()}
        learned = [(*k, p) for k, p in fit(counted, FUNCTIONS[defect]).items()]
        table = votes.sparkSession.createDataFrame(learned, ", ".join(f"{c} int" for c in columns) + f", `{defect}` double")
        out = out.join(F.broadcast(table), columns)
    return out.select(id_col, *DEFECTS)


def judged(df: DataFrame, profiles: list, common: set[str], id_col: str = "row_id", text_col: str = "text", summary_col: str = "summary") -> DataFrame:
    """(id_col, posterior of each defect, defects: those above their cutoffs in order)."""
    found = posteriors(cut(vote_table(df, profiles, common, id_col, text_col, summary_col)), id_col)
    return found.withColumn("defects", F.array_compact(F.array(*(F.when(F.col(d) > CUTOFFS[d], F.lit(d)) for d in DEFECTS))))
