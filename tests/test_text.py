import pytest
from pyspark.sql import functions as F

from vaksetu.functions import ngrams as N
from vaksetu.functions import python_text
from vaksetu.functions import text as T

TOKENS = {
    "दिल्ली में भारी बारिश हुई।": ["दिल्ली", "में", "भारी", "बारिश", "हुई"],
    '"मोदी", ने कहा: २०१९ में 5.5%': ["मोदी", "ने", "कहा", "2019", "में", "5", "5"],
    "": [],
    "।।": [],
    "Don’t stop": ["don", "t", "stop"],
    "5.5% और १,२००": ["5", "5", "और", "1", "200"],
    "10km ₹५०": ["10km", "50"],
    "नई-दिल्ली": ["नई", "दिल्ली"],
    "A\xa0B\u2028C": ["a", "b", "c"],
    "क\u200dष": ["क\u200dष"],
}


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "t string").select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


@pytest.mark.parametrize("text", list(TOKENS))
def test_tokenize(spark, text):
    assert one(spark, text, T.tokenize("t")) == TOKENS[text] == python_text.tokenize(text) == python_text.Tokenizer()(text)


def test_tokenize_null(spark):
    assert one(spark, None, T.tokenize("t")) == []


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("see http://x.y/z, ok", "see ok"),
        ("see httpfoo", "see"),
        ("http", "http"),
        ("WWW.a.b HTTP://q", "WWW.a.b HTTP://q"),
        ("ht\u200btp://a b", "b"),
        (" \x1c a\u3000b ", "a b"),
        ("भारत\u200b में\ufeff", "भारत में"),
        ("यह   एक   खबर है। http://example.com/news देखें।", "यह एक खबर है। देखें।"),
        (None, ""),
        ("", ""),
    ],
)
def test_clean_text(spark, text, wanted):
    assert one(spark, text, T.clean_text("t")) == wanted


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("पहला वाक्य। दूसरा वाक्य।", ["पहला वाक्य।", "दूसरा वाक्य।"]),
        ("one. two.", ["one.", "two."]),
        ("अ।ब। स", ["अ।ब।", "स"]),
        ("A.B. C", ["A.B.", "C"]),
        ("a.  . b", ["a.", ".", "b"]),
        ("no end", ["no end"]),
        ("", []),
        (None, []),
    ],
)
def test_split_sentences(spark, text, wanted):
    assert one(spark, text, T.split_sentences("t")) == wanted == python_text.split_sentences(text)


def test_split_sentences_indic(spark):
    assert one(spark, "पहला 5.5 है।दूसरा डॉ. क है।", T.split_sentences_indic("t")) == ["पहला 5.5 है।", "दूसरा डॉ. क है।"]
    assert one(spark, "One. Two 3. x", T.split_sentences_indic("t")) == ["One.", "Two 3. x"]


def test_truncate_words(spark):
    assert one(spark, "एक दो तीन चार पांच", T.truncate_words("t", 3)) == "एक दो तीन"
    assert one(spark, "एक  दो", T.truncate_words("t", 5)) == "एक  दो"
    assert one(spark, "एक दो", T.truncate_words("t", 0)) == ""


def test_clean_output_and_prefix(spark):
    assert one(spark, "<2hi> दिल्ली में बारिश </s> [SEP]", T.clean_output("t")) == "दिल्ली में बारिश"
    assert one(spark, "अआइ", T.char_prefix("t", 2)) == "अआ"
    assert one(spark, None, T.clean_output("t"), T.char_prefix("t", 2)) == (None, None)


def test_usable_is_strict(spark):
    rows = spark.createDataFrame([("क ख ग", "क ख"), ("क ख", "क ख"), ("", "क"), ("क ख", "")], "a string, s string")
    found = rows.select(T.is_usable("a", "s", T.tokenize("a"), T.tokenize("s")).alias("u")).collect()
    assert [r.u for r in found] == [True, False, False, False]


def test_unsupported_numbers(spark):
    rows = spark.createDataFrame([("25 लोग", "२५ लोग"), ("52 लोग", "२५ लोग"), ("10km", "x")], "s string, a string")
    assert [r[0] for r in rows.select(T.has_unsupported_number(T.tokenize("s"), T.tokenize("a"))).collect()] == [False, True, False]


def test_ngrams(spark):
    rows = spark.createDataFrame([(["a", "b", "a", "b"], ["a", "b"]), (["a"], ["a", "b"]), ([], [])], "p array<string>, r array<string>")
    found = rows.select(F.size(N.ngrams("p", 2)), F.size(N.ngram_set("p", 2)), N.multiset_overlap("p", "r"), N.novel_ngram_ratio("p", "r", 2), N.lcs_length("p", "r")).collect()
    assert [tuple(r) for r in found] == [(3, 2, 2, 0.5, 2), (0, 0, 1, 0.0, 1), (0, 0, 0, 0.0, 0)]


def test_novel_ratio(spark):
    s, a = "विपक्ष ने विरोध किया", "सरकार ने नई नीति की घोषणा की"
    rows = spark.createDataFrame([(s, a)], "s string, a string")
    assert rows.select(N.novel_ngram_ratio(T.tokenize("s"), T.tokenize("a"), 1)).first()[0] == 0.75
