"""Problems 2, 3 and 4 on small hand-made cases and on the labelled rows."""

import numpy as np
import pytest

from vaksetu.llm import defects, quality, queries, sentences
from vaksetu.llm.language import EvidenceHasher, LanguageGuesser, decide

HINDI = "राहत समिति ने दिल्ली में बैठक की। लोगों को पानी का इंतज़ार है। गाँव के बुज़ुर्ग को याद है कि यहाँ पहले केवल दस घर थे।"
MARATHI = "नगरपालिका येथे बैठक झाली. शेतकऱ्यांनी सांगितले की काम अजून बाकी आहे. पाणी मिळाले नाही आणि रस्ता बंद होता."
ENGLISH = "The council met in the town on Monday. The road from the bridge was closed for two days. It has not been repaired."


@pytest.mark.parametrize(
    "text, lang",
    [(HINDI, "hi"), (MARATHI, "mr"), (ENGLISH, "en"), ("শুক্রবার শহরে বৈঠক করেছে।", "bn"), ("بلدیہ کے مطابق کام باقی ہے۔", "ur"), ("水务局的地图已经准备好了。", "zh"), ("町の地図はできた。", "ja"), ("12 ।", None), ("", None), (None, None)],
)
def test_language(text, lang):
    assert LanguageGuesser().guess(text) == lang
    assert decide(*EvidenceHasher().batch_with_evidence([HINDI, text])[2][1]) == lang


LIST = "\n".join(f"{n}. गाँव{n} वन विभाग" for n in range(1, 12))
KINDS = {
    HINDI: "prose", MARATHI: "prose", ENGLISH: "prose", "水务局开会。地图已经准备好了，居民不用再等。大风吹过县城，很多大树倒下。": "prose", LIST: "list", HINDI.split("।")[0] + ":\n" + LIST: "list", "क ख • ग घ • च छ • ज झ • ट ठ • ड ढ": "list",
    "\n".join(f"शहर{n}|{n * 7}|{n + 0.5}|नाम" for n in range(9)): "table", "\n".join(f"शहर{n}\t{n * 7}\t-" for n in range(9)): "table", "नगर;जल;दल " + " ".join(f"शहर{n};{n * 7}.5;{n}" for n in range(9)): "table",
    "Login\nमेनू\nहोम\nLogin\nविज्ञापन\nShare\nमेनू\nखोजें\nहोम": "junk", "a1B2c3D4e5F6 Gh7Ij8Kl9Mn0 q1W2e3R4t5 zX9yW8vU7tS6": "junk", ".a1{margin:3px;color:#aabbcc}\n.b2{margin:4px;color:#aabbcd}": "junk",
    "??? ���� नाम ????? �� ?????": "junk", "à¤¨à¤ à¤ªà¤°à¤¿ à¤¹à¥": "junk", "\n".join(str(n * 7919) for n in range(30)): "junk", "क ख! " * 40: "junk", "%% #@ [] {} ++ ** &&": "junk", "": "junk", None: "junk",
    HINDI * 3 + "\n- पहला काम\n- दूसरा काम": "prose",
}


def kind_of(text, profiles=None):
    return quality.nearest(quality.Analyser({"में"}).analyse(text)[1], profiles or quality.fit([]))[0]


@pytest.mark.parametrize("text", list(KINDS))
def test_kind(text):
    assert kind_of(text) == KINDS[text]


def test_figures(spark):
    rows = spark.createDataFrame([(1, "में क।\nख 12", "k"), (2, None, "k"), (3, "", "k")], "row_id long, text string, kind string")
    found = {r.row_id: r for r in quality.statistics(rows, quality.fit([]), {"में"}).collect()}
    assert found[1].word_count == 4 and found[1].common_share == 0.25 and found[1].punctuated_lines == 0.5 and found[1].mean_word_length == pytest.approx(7 / 4)
    assert found[2].word_count == found[3].word_count == 0 and found[2].kind == "junk"
    assert quality.statistics(rows.limit(0), quality.fit([]), set()).count() == 0


def test_divergence():
    p, q = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    assert quality.divergence(p, p) == 0 and quality.divergence(p, q) == 1 and quality.divergence(p, (p + q) / 2) == quality.divergence((p + q) / 2, p)


def test_labelled_rows_held_out(small):
    """Fitted on the labels of one scale, right on at least 0.95 of those of another."""
    import duckdb

    from pathlib import Path

    def labelled(folder):
        return duckdb.execute(f"SELECT l.kind, p.text FROM '{folder}/processed.parquet' p JOIN '{folder}/quality_labels.parquet' l USING (row_id) WHERE l.kind IS NOT NULL").fetchall()

    up = Path(small).parent
    analyser = quality.Analyser(set())
    profiles = quality.fit([(k, analyser.analyse(t)[1]) for k, t in labelled(up / "sf0.01")])
    other = labelled(up / "sf0.1")
    assert sum(kind_of(t, profiles) == k for k, t in other) >= 0.95 * len(other)


def judge(spark, rows):
    filler = [(1000 + n, HINDI, f"वन विभाग ने गाँव{n} में {n} परिवारों को नया नक्शा देने की माँग मान ली है।") for n in range(300)]
    filler += [(2000 + n, ENGLISH, f"Farmers in Town{n} have asked the council for a new map after {n} days of waiting for the report.") for n in range(200)]
    filler += [(3000 + n, MARATHI, f"शेतकऱ्यांनी गाव{n} येथे नवा नकाशा मागितला आहे आणि काम अजून बाकी आहे.") for n in range(100)]
    data = spark.createDataFrame([(i, t, s, "x", "y") for i, t, s in filler + rows], "row_id long, text string, summary string, w string, h string")
    found = {r.row_id: list(r.defects) for r in defects.judged(data, quality.fit([]), set()).collect()}
    assert sum(bool(found[i]) for i, _, _ in filler) == 0
    return found


def test_defects(spark):
    cases = [
        (1, HINDI, None, "empty"), (2, HINDI, "  ", "empty"), (3, HINDI, "—", "empty"), (4, HINDI, "N/A", "empty"), (5, HINDI, "[सारांश]", "empty"),
        (6, HINDI, "माफ़ कीजिए, मैं इसका सारांश नहीं लिख सकता।", "refusal"), (7, HINDI, "As an assistant, I am not able to write a summary about this.", "refusal"), (8, HINDI, "我无法总结这篇文章。", "refusal"),
        (9, HINDI, "लोगों को पानी का इंतज़ार है", "copy"), (10, HINDI, "Farmers in Town5 have asked the council for a new map.", "wrong_language"),
        (11, HINDI, "शेतकऱ्यांनी गाव7 येथे नवा नकाशा मागितला आहे आणि काम अजून बाकी आहे.", "wrong_language"), (12, HINDI, "वन विभाग ने गाँव5 में 5 परिवारों को", "truncated"), (13, HINDI, "वन विभाग ने गाँव5 में 5 परि", "truncated"),
        (14, HINDI, "वन विभाग ने गाँव5 में 7 परिवारों को नया नक्शा देने की माँग मान ली है...", None), (15, HINDI, "वन विभाग ने गाँव9 में 8 परिवारों को नया नक्शा देने की माँग मान ली है", None),
        (16, "".join(f"{n * 7919}\n" for n in range(30)), "वन विभाग ने गाँव9 में 8 परिवारों को नया नक्शा देने की माँग मान ली है।", None), (17, None, "वन विभाग ने गाँव9 में 8 परिवारों को नया नक्शा देने की माँग मान ली है।", None),
        (18, HINDI, "GDP और CSR वन विभाग ने गाँव9 में 8 परिवारों को नया नक्शा देने की माँग मान ली है।", None),
    ]
    found = judge(spark, [c[:3] for c in cases])
    assert {i: (found[i] or [None])[0] for i, *_ in cases} == {i: d for i, *_, d in cases}


@pytest.mark.parametrize(
    "said",
    [
        "दुर्भाग्य से इस लेख को सारांशित करना संभव नहीं है।", "लेख का संक्षेपण संभव नहीं है।", "সারাংশটি নেই।", "خلاصہء نہیں", "as an automated tool", "It would cannot be appropriate to say", "Subrequest cannot be fulfilled",
        "I cannot", "We won’t", "unable to help", "not allowed to", "for me to", "my guidelines", "language model", "Summarize", "condense", "comply", "मैं यह नहीं कर सकता", "मुझे क्षमा", "हम नहीं कर सकते", "मुझसे नहीं", "अनुरोध अस्वीकार",
        "मी शकत नाही", "मला माफ", "विनंती नाही", "আমি পারব না", "আমার পক্ষে সম্ভব নয়", "অনুরোধ না", "میں قاصر ہوں", "مجھے معذرت", "درخواست مسترد", "我无法", "要約できません", "お答えでき", "सहायक के रूप में", "भाषा मॉडल के रूप में", "एआई के रूप में",
        "टिप्पणी नहीं", "एक सहाय्यक म्हणून", "সহকারী হিসেবে", "معاون کے طور پر", "作为助手", "摘要", "アシスタント",
    ],
)
def test_gate_holds_every_pattern(said):
    from vaksetu.llm.words import words

    assert defects.REFUSAL.search(said) or defects.META.search(said)
    assert defects._maybe(said, words(said))


def test_label_model_learns():
    functions = (("good", 0.6, 0.2, 0.2, 0.6), ("bad", 0.6, 0.2, 0.2, 0.6), ("fair", 0.6, 0.2, 0.2, 0.6))
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.1
    votes = [np.where(rng.random(20000) < right, y, ~y) * 2 - 1 for right in (0.97, 0.5, 0.9)]
    patterns: dict = {}
    for key in zip(*(v.tolist() for v in votes)):
        patterns[key] = patterns.get(key, 0) + 1
    p = defects.fit(patterns, functions)
    guess = np.array([p[k] > 0.5 for k in zip(*(v.tolist() for v in votes))])
    assert (guess == y).mean() > 0.93 and defects.fit({}, functions) == {}


def test_defects_of_nothing(spark):
    data = spark.createDataFrame([], "row_id long, text string, summary string")
    assert defects.judged(data, quality.fit([]), set()).count() == 0


def cut(text, model=None):
    return [text[a:b] for a, b in sentences.Splitter(model or {}).split(text)]


MODEL = {"hi": {"a": {"डॉ", "कि.मी", "बी.ए", "ई"}}, "en": {"a": {"dr", "rs", "a.m", "etc"}, "e": {"etc"}, "s": {"the"}}}


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("पहला वाक्य है। दूसरा है।तीसरा है ॥", ["पहला वाक्य है।", "दूसरा है।", "तीसरा है ॥"]),
        ("वह गया था . वह आया था .", ["वह गया था .", "वह आया था ."]),
        ("यह 12 कि.मी. दूर है. डॉ. मीना गई. दर 5.5 है.", ["यह 12 कि.मी. दूर है.", "डॉ. मीना गई.", "दर 5.5 है."]),
        ("यह ऐसा है| वह वैसा है|", ["यह ऐसा है|", "वह वैसा है|"]),
        ("उसने कहा, “पानी है। रुको।” फिर वह गया।", ["उसने कहा, “पानी है। रुको।”", "फिर वह गया।"]),
        ("वह (पहले नहीं थी।) आई। क्यों?! हाँ!", ["वह (पहले नहीं थी।)", "आई।", "क्यों?!", "हाँ!"]),
        ("उसने सोचा... फिर गया।", ["उसने सोचा... फिर गया।"]),
        ("शीर्षक\n\n1. पहला काम\n2. दूसरा काम", ["शीर्षक", "1. पहला काम", "2. दूसरा काम"]),
        ("Dr. Rao paid Rs. 500 at 9.30 a.m. on Monday. The traders' union left. It ended.", ["Dr. Rao paid Rs. 500 at 9.30 a.m. on Monday.", "The traders' union left.", "It ended."]),
        ("Maps, pens etc. The end came.", ["Maps, pens etc.", "The end came."]),
        ("J. R. Rao came. He left.", ["J. R. Rao came.", "He left."]),
        ('He said, "It is ready. Wait." Then he left.', ['He said, "It is ready. Wait."', "Then he left."]),
        ("地图好了。「可以走。不用等。」他走了！", ["地图好了。", "「可以走。不用等。」", "他走了！"]),
        ("کام باقی ہے۔ کیا ہوگا؟ ہاں", ["کام باقی ہے۔", "کیا ہوگا؟", "ہاں"]),
        ("", []),
        ("  \n ", []),
        (None, []),
        ("।", ["।"]),
    ],
)
def test_sentences(text, wanted):
    assert cut(text, MODEL) == wanted


def test_learning(spark):
    rng = np.random.default_rng(1)
    nouns = [f"नाम{n}" for n in range(200)]
    rows = []
    for n in range(400):
        a, b, c = rng.choice(nouns, 3)
        mark = "।" if n % 2 else "."
        rows.append((n, f"डॉ. {a} ने {b} को 12 कि.मी. दूर देखा है{mark} फिर {c} ने कहा है{mark}\nलोग {a} को जानते हैं{mark}", "a", 1))
    data = spark.createDataFrame(rows, "row_id long, text string, lang string, n int")
    model = sentences._as_model(sentences.model_rows(data).collect())
    assert {"डॉ", "कि.मी"} <= model["hi"]["a"] and not {"है", "हैं"} & model["hi"]["a"]
    found = sentences.split_sentences(data, data).groupBy("row_id").count().collect()
    assert {r["count"] for r in found} == {3}
    assert sentences.split_sentences(data.limit(0), data).count() == 0 and sentences.split_sentences(data, data.limit(0)).count() > 0


def test_collocations_by_ratio(spark):
    names = [f"name{n}" for n in range(98)]
    rows = [("en", "p", "dr", "", 1000, 0, 0), ("en", "p", "end", "", 4000, 0, 4000), ("en", "w", "the", "", 30000, 0, 0), ("en", "w", "filler", "", 64000, 0, 0)]
    rows += [("en", "w", name, "", 10, 0, 0) for name in names] + [("en", "d", "12", "", 9, 0, 0)]
    rows += [("en", "n", "dr", name, 7 if n else 2, 0, 0) for n, name in enumerate(names)] + [("en", "n", "dr", "the", 305, 0, 0), ("en", "n", "dr", "12", 9, 0, 0), ("en", "n", "end", "the", 4000, 0, 0)]
    tokens = sum(r[4] for r in rows if r[1] in "pw")
    data = spark.createDataFrame(rows, "lang string, kind string, a string, b string, n long, starts long, line_ends long")
    found = {(r.a, r.b) for r in sentences.learn(data).where("kind = 'c'").collect()}
    size = {r[2]: r[4] for r in rows if r[1] != "n"}
    wanted = {(r[2], r[3]) for r in rows if r[1] == "n" and r[2] == "dr" and sentences.association(size[r[2]], size[r[3]], r[4], tokens) >= 7.88}
    assert found == wanted and ("dr", "the") not in found and {("dr", names[0]), ("dr", names[5]), ("dr", "12")} <= found


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, small, name):
    rows = queries.QUERIES[name](spark, small)
    assert rows.count() >= 0 and len(set(rows.columns)) == len(rows.columns)


def test_offsets_of_whole_table(spark, small):
    texts = dict(map(tuple, spark.read.parquet(f"{small}/processed.parquet").select("row_id", "text").collect()))
    last: dict = {}
    for r in queries.p4_found(spark, small).orderBy("row_id", "start_at").collect():
        piece = texts[r.row_id][r.start_at : r.end_at]
        assert piece == piece.strip() and piece and r.start_at >= last.get(r.row_id, 0)
        last[r.row_id] = r.end_at
