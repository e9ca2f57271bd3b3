"""Problem 4: what is learned has no limit of length or number."""

import numpy as np

from vaksetu.llm import sentences


def test_long_abbreviation_and_its_collocation(spark):
    """An abbreviation of eight letters, one of seven with inner periods, and a pair that meets far above chance."""
    rng = np.random.default_rng(2)
    nouns = [f"noun{n}x" for n in range(300)]
    nouns = [n.translate(str.maketrans("0123456789", "abcdefghij")) for n in nouns]
    rows = []
    for n in range(3000):
        a, b = rng.choice(nouns, 2)
        rows.append((n, f"The road of {a} is open and the water of {b} is clean. The people of superint. {'delhi' if n % 3 == 0 else a} were with the ए.आई.सी.सी. office for two days\nThe map of {b} is clean."))
    data = spark.createDataFrame(rows, "row_id long, text string")
    model = sentences._as_model(sentences.model_rows(data).collect())["en"]
    assert {"superint", "ए.आई.सी.सी"} <= model["a"] and ("superint", "delhi") in model["c"] and not {"clean", "open"} & model["a"]


def test_learned_words_are_read_by_language(spark):
    """More learned words than a broadcast may have rows are no error: they are files of the shared folder, not rows of the driver."""
    from vaksetu.llm.store import new_folder

    folder = new_folder(spark, "learned-words")
    many = spark.range(600_000).selectExpr("'en' AS lang", "'s' AS kind", "concat('w', id) AS a", "'' AS b")
    few = spark.createDataFrame([("hi", "a", "डॉ", ""), ("hi", "c", "डॉ", "मीना")], "lang string, kind string, a string, b string")
    many.unionByName(few).write.partitionBy("lang").parquet(folder)
    found = sentences.LearnedWords(folder)
    assert len(found.get("en", {})["s"]) == 600_000 and found.get("hi", {}) == {"a": {"डॉ"}, "c": {("डॉ", "मीना")}} and found.get("fr", {}) == {}
