"""Problem 3 on defects put into sound rows: the cutoffs, the figures of each defect, and what expectation maximisation adds."""

import random
from collections import Counter

import pytest

from vaksetu.llm import defects, quality, queries
from vaksetu.llm.language import LanguageGuesser
from vaksetu.llm.words import words
from vaksetu.runtime import table

EMPTY = [None, "", " \n", "…", "—", "N/A", "null", "TBD", "[सारांश]", "कोई सारांश नहीं", "summary not available", "।", "उपलब्ध नहीं", "暂无"]
REFUSAL = [
    "I'm sorry, but I can't summarise this article.", "मैं इस लेख का सारांश नहीं लिख सकता।", "क्षमा करें, इस ख़बर का सार देना मेरे लिए संभव नहीं है।", "As a language model I am unable to comply with this request.", "माफ़ कीजिए, मैं इसमें मदद नहीं कर सकती।",
    "মাফ করবেন, আমি এই লেখার সারাংশ দিতে পারব না।", "معذرت، میں اس خبر کا خلاصہ لکھنے سے قاصر ہوں۔", "很抱歉，我无法总结这篇文章。", "申し訳ありませんが、この記事を要約できません。", "क्षमस्व, मी हा सारांश लिहू शकत नाही.", "Unfortunately it is not possible for me to give a summary of this.", "मुझे इस लेख का सारांश देने की अनुमति नहीं है।",
]
GRID = [x / 20 for x in range(1, 20)]


def truncated(summary, rng):
    """Cut inside the last sentence, behind a word or inside one."""
    found = summary.rstrip(" ।॥.|。！？۔!?…").split(" ")
    if len(found) < 6:
        return summary[: max(2, len(summary) // 2)]
    kept = found[: rng.randint(len(found) - 4, len(found) - 1)]
    if rng.random() < 0.5 and len(found[len(kept)]) > 4:
        kept.append(found[len(kept)][: rng.randint(1, 2)])
    return " ".join(kept)


@pytest.fixture(scope="module")
def injected(spark, small):
    """(row_id -> defect that was put in, votes as rows, posteriors as rows) over the whole of sf0.01, a fifth of its sound rows made defective."""
    d = small.replace("sf0.001", "sf0.01")
    rng, guess = random.Random(7), LanguageGuesser().guess
    rows = {r.row_id: r for r in table(spark, d, "processed").select("row_id", "text", "summary").collect()}
    broken = {r.row_id for r in queries.p3_found(spark, d).collect()} | {r.row_id for r in queries.p2_found(spark, d).collect()}
    sound = sorted(i for i, r in rows.items() if i not in broken and len((r.text or "").split()) > 30)
    lang = {i: guess(rows[i].text) for i in sound}
    put, summary = {}, {i: r.summary for i, r in rows.items()}
    for n, i in enumerate(x for x in sound if x % 5 == 0):
        defect = defects.DEFECTS[n % 5]
        if defect == "empty":
            summary[i] = rng.choice(EMPTY)
        elif defect == "refusal":
            summary[i] = rng.choice(REFUSAL)
        elif defect == "copy":
            found = rows[i].text.split()
            at = rng.randrange(len(found) - 20)
            summary[i] = " ".join(found[at : at + rng.randint(8, 20)])
        elif defect == "wrong_language":
            summary[i] = rows[rng.choice([x for x in sound if lang[x] != lang[i] and x % 5])].summary
        else:
            summary[i] = truncated(summary[i], rng)
        put[i] = defect
    data = spark.createDataFrame([(i, r.text, summary[i]) for i, r in rows.items()], "row_id long, text string, summary string")
    votes = defects.cut(defects.vote_table(data, quality.fit([]), quality.common_words(table(spark, d, "common_words"))))
    return put, votes.collect(), {r.row_id: r for r in defects.posteriors(votes).collect()}, set(sound)


def f1(scores, cutoff, wanted):
    found = {i for i, p in scores.items() if p > cutoff}
    both = len(found & wanted)
    return 2 * both / (len(found) + len(wanted)) if both else 0.0


@pytest.mark.parametrize("defect", defects.DEFECTS)
def test_cutoffs_are_validated(injected, defect):
    """On one half of the injected rows and of the sound ones no other cutoff is better by more than 0.01; the other half gives the figures."""
    put, _, posteriors, sound = injected
    halves = [{}, {}]
    for i in sound:
        if put.get(i, defect) == defect:  # rows with another defect may have several
            halves[i // 5 % 2][i] = posteriors[i][defect]
    wanted = [{i for i in half if put.get(i) == defect} for half in halves]
    chosen = f1(halves[0], defects.CUTOFFS[defect], wanted[0])
    assert chosen >= max(f1(halves[0], c, wanted[0]) for c in GRID) - 0.01
    held_out = f1(halves[1], defects.CUTOFFS[defect], wanted[1])
    print(defect, len(wanted[1]), round(chosen, 3), round(held_out, 3))
    assert held_out >= 0.93


def test_expectation_maximisation_decides(injected):
    """Without it, from the first guesses alone, decisions are others and worse."""
    put, votes, _, sound = injected
    right = {}
    for rounds in (0, 200):
        found = {}
        for defect in defects.DEFECTS:
            columns = [f"{defect}_{f[0]}" for f in defects.FUNCTIONS[defect]]
            key = {r.row_id: tuple(r[c] for c in columns) for r in votes}
            p = defects.fit(Counter(key.values()), defects.FUNCTIONS[defect], rounds)
            for i in sound:
                if p[key[i]] > defects.CUTOFFS[defect]:
                    found.setdefault(i, defect)  # the first that holds
        right[rounds] = sum(found.get(i) == put.get(i) for i in sound)
    print(right, len(sound))
    assert right[200] > right[0] and right[200] >= 0.985 * len(sound)


def test_votes_do_not_look_at_one_another():
    """A function votes the same whatever the others of its defect say."""
    text = "लोगों को पानी का इंतज़ार है।"
    analyser = quality.Analyser(set())
    from vaksetu.llm.language import EvidenceHasher

    def votes(summary):
        t, at, lang = EvidenceHasher().batch_with_evidence([text, summary])
        return defects._votes(text, summary, words(summary), t[: at[1]], t[at[1] :], lang[0], lang[1], analyser, quality.fit([]))

    one, two = votes("माफ़ कीजिए, मैं इसका सारांश नहीं लिख सकता।"), votes("माफ़ कीजिए, लोगों को पानी मिला।")
    assert one["refusal.first_person"] == 1 and two["refusal.first_person"] == -1 and one["refusal.apology"] == two["refusal.apology"] == 1


def test_last_words_of_long_stretches():
    """The last word of a stretch is found however long it is."""
    assert defects._last_words("x" * 500) == ("x" * 500,) and defects._last_words("क " + "y" * 300) == ("क", "y" * 300)
    assert defects._last_words("地图已经准备好了") == ("准备好了", "好了") and defects._last_words("") == ()


def test_lookup_with_a_hot_key(spark):
    """A key that most rows have, one that few have, one unknown and null."""
    from vaksetu.llm.joins import looked_up

    rows = spark.range(5000).selectExpr("id", "CASE WHEN id < 3000 THEN 7 WHEN id < 4000 THEN id WHEN id < 4500 THEN NULL ELSE -1 END AS k", "IF(id % 2 = 0, 7, NULL) AS j")
    known = spark.range(4000).selectExpr("id AS h", "id * 2 AS v")
    found = looked_up(rows, ("k", "j"), known, "id").collect()
    assert len(found) == 5000 and all(r.v_k == (None if r.k is None or r.k < 0 else 2 * r.k) and r.v_j == (14 if r.id % 2 == 0 else None) for r in found)
