import itertools

from vaksetu.llm import lookalike

SAME = [
    ("Ａ１！", "A1!"), ("ｶﾞ", "ガ"), ("e\u0301", "\xe9"), ("\u0958", "\u0915\u093c"), ("a\u200bb", "ab"), ("क\xadख", "कख"), ("a\xa0b", "a b"), ("a\u3000b", "a b"), ("ﬁn", "fin"), ("\ufefb", "\u0644\u0627"), ("Мосh", "Moch"), ("\u2f54", "水"),
    ("a\r\nb", "a\nb"), ("\u0905\u093eप", "\u0906प"), ("रिपोर्टः", "रिपोर्ट:"), ("م\u064aں", "م\u06ccں"), ("ক\u09c7\u09be", "ক\u09cb"), ("ABC", "АВС"), ("x\u200ey", "xy"), ("ニ", "二"),
]
DIFFERENT = [
    ("m²", "m2"), ("①", "1"), ("½", "12"), ("१", "1"), ("café", "cafe"), ("क़", "क"), ("आँ", "आं"), ("।", "॥"), ("a  b", "a b"), ("a\nb", "a b"), ("👩\u200d🌾", "👩🌾"), ("a", "A"), ("“a”", '"a"'), ("a.", "a"), ("١", "1"),
]


def pairs(spark, texts):
    rows = spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate(texts)], "doc_id long, text string, form string, id string")
    found = lookalike.lookalike_pairs(rows).collect()
    assert len(found) == len(set(found))
    return set(map(tuple, found))


def test_same_and_different(spark):
    texts = [f"{n} {t}" for n, pair in enumerate(SAME + DIFFERENT) for t in pair]
    assert pairs(spark, texts) == {(2 * n, 2 * n + 1) for n in range(len(SAME))}


def test_copies_nulls_and_invisible(spark):
    texts = ["Ａ", "A", "A", "А", None, None, "", "\u200b", " ", " "]
    strings = texts[:4]
    wanted = {(a, b) for a, b in itertools.combinations(range(4), 2) if strings[a] != strings[b]}
    assert pairs(spark, texts) == wanted
    assert pairs(spark, []) == set()


def test_forms(spark):
    rows = spark.createDataFrame([(1, "Ａ b\u200b\r\nﬁ it's"), (2, None), (3, "")], "doc_id long, text string")
    found = {r.doc_id: r.form for r in lookalike.consistent(rows).collect()}
    assert found == {1: "A b\nfi it's", 2: None, 3: ""}


def test_long_text(spark):
    assert pairs(spark, ["क " * 20000 + "Ａ", "क " * 20000 + "A"]) == {(0, 1)}


def test_many_long_texts_in_one_batch(spark):
    """128 texts of 400,000 characters: blocks are cut by bytes, so they need no more memory than short ones."""
    rows = spark.range(128, numPartitions=1).selectExpr("id AS doc_id", "repeat('क ख ', 100000) || if(id % 2 = 0, 'Ａ', 'A') || id div 2 AS text")
    found = lookalike.lookalike_pairs(rows).collect()
    assert set(map(tuple, found)) == {(2 * n, 2 * n + 1) for n in range(64)}


def test_one_text_longer_than_a_block(spark):
    text = "ﬁ क " * 1_500_000
    rows = spark.createDataFrame([(1, "a")], "doc_id long, text string").selectExpr("doc_id", f"repeat('ﬁ क ', {len(text) // 4}) AS text")
    assert lookalike.consistent(rows).selectExpr("length(form) AS n").first().n == len(text) // 4 * 5
