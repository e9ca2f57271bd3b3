import random

import pytest
from pyspark.sql import functions as F

from vaksetu.llm import packing, tokens

TEXTS = [None, "", " ", "  a  b ", "\n\n a\tb\r\n", "<|endoftext|> नमस्ते दुनिया।", "don't 'S we'll", "中文 テスト", "🙂🇮🇳 👩\u200d🌾", "a\x1cb \x1f c", "é é", "x" * 3000, "अ " * 3000]


def test_encoding_equals_the_library(spark):
    library = tokens.load()
    rows = spark.createDataFrame([(n, t, "z", "z") for n, t in enumerate(TEXTS * 2)], "doc_id long, text string, ids string, other string")
    found = {r.doc_id: list(r.ids) for r in tokens.encoded(rows).collect()}
    for n, t in enumerate(TEXTS * 2):
        assert found[n] == (library.encode(t, add_special_tokens=False).ids if t else [])
    counts = {r.doc_id: r.n_tokens for r in tokens.token_counts(rows).collect()}
    assert counts == {n: len(i) for n, i in found.items()}
    back = tokens.encoded(rows).select("doc_id", tokens.decoded("ids").alias("t")).collect()
    assert {r.doc_id: r.t for r in back} == {n: t or "" for n, t in enumerate(TEXTS * 2)}


def test_empty_table(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encoded(rows).count() == 0 and tokens.token_counts(rows).count() == 0


def test_random_texts():
    random.seed(0)
    alphabet = "ab  \n\té中हि।'1 ,.\u200b"
    library, encoder = tokens.load(), tokens.Encoder()
    cases = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(500)]
    ids, counts = encoder.encode(cases)
    at = 0
    for case, n in zip(cases, counts, strict=True):
        assert ids[at : at + n].tolist() == library.encode(case, add_special_tokens=False).ids
        at += n


def test_decoder_handles_split_characters():
    decoder = tokens.Decoder()
    ids = tokens.Encoder().encode(["🙂 क"])[0].tolist()
    assert decoder.decode(ids) == "🙂 क" and decoder.decode(ids[:1]).count("�") >= 1
    spans = decoder.offsets(ids)
    assert spans[0] == (0, 1) and spans[-1][1] == 3
    with pytest.raises(IndexError):
        decoder.decode([10**9])


def pack(spark, sizes, containers=(("small", 10),)):
    items = spark.createDataFrame([(n, s) for n, s in enumerate(sizes)], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame(list(containers), "container string, capacity int")
    return packing.packed(items, kinds), kinds


def test_packs_hold(spark):
    random.seed(3)
    sizes = [random.choice((0, 1, 2, 3, 5, 7, 9, 10, 11, 25, 30)) for _ in range(300)] + [None]
    found, kinds = pack(spark, sizes, (("small", 10), ("large", 64)))
    rows = found.collect()
    for name, capacity in (("small", 10), ("large", 64)):
        mine = [r for r in rows if r.container == name]
        filled, parts = {}, {}
        for r in mine:
            if r.tokens:
                filled[r.pack] = filled.get(r.pack, 0) + r.tokens
            parts.setdefault(r.doc_id, []).append((r.part, r.tokens))
        assert max(filled.values()) <= capacity and min(filled) == 1 and max(filled) == len(filled)
        for doc, size in enumerate(sizes):
            got = sorted(parts[doc])
            assert sum(t for _, t in got) == (size or 0)
            assert len(got) == 1 if (size or 0) <= capacity else all(t == capacity for _, t in got[:-1])
        assert len(filled) <= 1.1 * sum(s or 0 for s in sizes) / capacity + 1
    report = {r.container: r for r in packing.fill_report(found, kinds).collect()}
    assert report["large"].share_filled > 0.95


def test_patterns_keep_all_items():
    random.seed(5)
    for _ in range(50):
        capacity = random.randint(1, 40)
        histogram = {n: random.randint(1, 30) for n in random.sample(range(1, capacity + 1), random.randint(1, capacity))}
        patterns = packing.shortest_pack_first(histogram, capacity)
        assert all(sum(p) <= capacity for p, _ in patterns)
        for n, count in histogram.items():
            assert sum(p.count(n) * c for p, c in patterns) == count


def test_hot_length_and_empty(spark):
    found, _ = pack(spark, [5] * 1000)
    assert found.agg(F.countDistinct("pack")).first()[0] == 500
    assert pack(spark, [])[0].count() == 0 and pack(spark, [1], ())[0].count() == 0
