import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaksetu.llm import neardup, overlap
from vaksetu.llm.dartminhash import bands, signatures, sketch
from vaksetu.llm.words import WordHasher, distinct_runs, runs, words

SCHEMA = "row_id long, id string, text string, summary string, split string, source string, k int, d string"


def similarity(a, b):
    sets = [set(zip(w, w[1:], w[2:])) for w in (words(a), words(b))]
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else 0.0


def brute(rows):
    return {(a, b) for (a, s), (b, t) in itertools.combinations(sorted((i, t) for i, t in rows if t is not None), 2) if s == t or similarity(s, t) >= 0.6}


def texts(seed=0, n=60):
    random.seed(seed)
    vocabulary = [f"शब्द{n}" for n in range(300)]
    out = []
    for _ in range(n):
        base = random.choices(vocabulary, k=random.choice((0, 2, 3, 8, 40, 400)))
        out.append(" ".join(base))
        for _ in range(random.randint(0, 3)):
            edited = [w for w in base]
            for _ in range(random.randint(0, max(1, len(base) // 12))):
                if edited:
                    edited[random.randrange(len(edited))] = random.choice(vocabulary)
            out.append(" ".join(edited))
    return out


def test_words():
    assert words("हुई।क १२ 中文字ひ A-b") == ["हुई", "क", "12", "中", "文", "字", "ひ", "a", "b"]
    assert words(None) == [] and words(" \u200b ") == ["\u200b"]


def test_hasher_agrees_with_words():
    import xxhash

    hasher = WordHasher()
    cases = [None, "", "क ख", "a। b,c 中文", "ＡB１ " * 50, "x" * 5000]
    hashes, offsets = hasher.batch(cases)
    for n, case in enumerate(cases):
        assert hashes[offsets[n] : offsets[n + 1]].tolist() == [xxhash.xxh64_intdigest(w.encode()) for w in words(case)]
    run, doc = runs(hashes, offsets, 3)
    assert np.bincount(doc, minlength=6).tolist() == [max(len(words(c)) - 2, 0) for c in cases]
    assert distinct_runs(hashes, offsets, 3)[1].tolist().count(4) == len(set(zip(*(words(cases[4])[k:] for k in range(3)))))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, (150, 80)).astype(np.uint64)
    b = a.copy()
    b[:, 60:] = rng.integers(0, 2**63, (150, 20)).astype(np.uint64)
    elements, sets = np.concatenate([a, b]).ravel(), np.repeat(np.arange(300), 80)
    plain = signatures(elements, sets, 300, 256)
    assert (plain[:150] == plain[150:]).mean() == pytest.approx(0.6, abs=0.02)
    weight = np.tile(np.linspace(0.2, 3, 80), 300)
    shared = np.linspace(0.2, 3, 80)[:60].sum()
    total = 2 * np.linspace(0.2, 3, 80).sum() - shared
    weighed = signatures(elements, sets, 300, 256, weight)
    assert (weighed[:150] == weighed[150:]).mean() == pytest.approx(shared / total, abs=0.02)


def test_signatures_are_complete_and_ignore_repeats():
    one = signatures(np.array([7, 7, 7, 9], np.uint64), np.array([0, 0, 0, 0]), 2, 64)
    assert (one[1] == np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (one[0] != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert (one[0] == signatures(np.array([9, 7], np.uint64), np.array([0, 0]), 1, 64)[0]).all()
    assert bands(one, 4).shape == (2, 16) and sketch(one).shape == (2,)
    assert signatures(np.zeros(0, np.uint64), np.zeros(0, int), 3, 8).shape == (3, 8)


def frame(spark, rows):
    return spark.createDataFrame([(i, None, t, None, None, "s", 1, "x") for i, t in rows], SCHEMA)  # k and d clash with inner names


def test_pairs_equal_brute_force(spark):
    rows = list(enumerate(texts(), 1)) + [(900, None), (901, None), (902, ""), (903, ""), (904, "क"), (905, "क"), (906, "क ख")]
    found = neardup.row_pairs(*neardup.near_links(frame(spark, rows)), "a", "b").collect()
    assert len(found) == len(set(found)) and set(map(tuple, found)) == brute(rows)


def test_groups(spark):
    base = " ".join(f"w{n}" for n in range(60))
    rows = [(1, base), (2, base), (3, base + " x y"), (4, "other words here now"), (5, None), (6, base + " x y z q r s")]
    found = {r.row_id: r for r in neardup.article_groups(frame(spark, rows)).collect()}
    assert set(found) == {1, 2, 3, 4, 6}
    assert found[2].class_id == 1 and found[1].n_copies == 2 and {found[i].group_id for i in (1, 2, 3, 6)} == {1} and found[4].group_id == 4
    assert found[1].n_links == 2 and found[4].n_links == 0


def test_empty_table(spark):
    assert neardup.row_pairs(*neardup.near_links(frame(spark, []).limit(0)), "a", "b").count() == 0
    assert neardup.article_groups(frame(spark, []).limit(0)).count() == 0


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(1, 60), random.randint(1, 60)) for _ in range(45)] + [(n, n + 1) for n in range(100, 130)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    wanted = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    found = neardup.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert dict(map(tuple, found)) == wanted and len(found) == len(wanted)


def split_rows(n=60):
    random.seed(9)
    found = []
    for i, t in enumerate(texts(5, n), 1):
        summary = " ".join(random.choices("क ख ग घ".split(), k=random.choice((3, 9)))) if i % 3 else None
        found.append((i, random.choice((f"khel-{i % 40:04d}", "khel", None, f"a-b-{i % 40}")), t, summary, random.choice(("train", "test", "validation", None))))
    return found + [(800, "x-0", None, None, "train"), (801, "y-0", None, None, "test"), (802, "z", "", None, "train"), (803, "z", "", None, "test")]


def brute_overlaps(rows):
    import re

    out = set()
    for a, b in itertools.combinations(rows, 2):
        if {a[4] == "train", b[4] == "train"} != {True, False} or None in (a[4], b[4]):
            continue
        numbers = [m and int(m[1]) for m in (re.search(r"-([0-9]+)$", x[1] or "") for x in (a, b))]
        same_number = None not in numbers and numbers[0] == numbers[1]
        same_text = a[2] is not None and b[2] is not None and (a[2] == b[2] or similarity(a[2], b[2]) >= 0.6)
        said = [words(x[3]) for x in (a, b)]
        if same_number or same_text or said[0] == said[1] and len(said[0]) >= 8:
            out.add((a[0], b[0]))
    return out


def test_overlaps_equal_brute_force(spark, monkeypatch):
    rows = split_rows()
    data = spark.createDataFrame([(i, d, t, s, p, "src", 1, "x") for i, d, t, s, p in rows], SCHEMA)
    for shard in (overlap.SHARD_PASSAGES, 500):  # one shard and many
        monkeypatch.setattr(overlap, "SHARD_PASSAGES", shard)
        found = overlap.overlaps(data).collect()
        assert {tuple(sorted(r)) for r in found} == brute_overlaps(rows) and len(found) == len(set(found))
    split = {i: p for i, _, _, _, p in rows}
    assert all(split[r.t] == "train" and split[r.e] != "train" for r in found)


def test_coverage(spark):
    base = " ".join(f"w{n}" for n in range(40))
    rows = [(1, base, "train"), (2, base, "test"), (3, "quite other words stand in here today", "test"), (4, None, "test")]
    data = spark.createDataFrame([(i, None, t, None, p, "s", 1, "x") for i, t, p in rows], SCHEMA)
    found = {r.row_id: r for r in overlap.coverage(data).collect()}
    assert found[2].matched_texts == 1 and found[2].covered_words > 15 and found[3].covered_words == 0 and 4 not in found


def covered(text, trained):
    """Covered words and merged intervals by brute force."""
    said, held = words(text), {tuple(w[n : n + 3]) for w in map(words, trained) for n in range(len(w) - 2)}
    at = {n + k for n in range(len(said) - 2) if tuple(said[n : n + 3]) in held for k in range(3)}
    if len(said) < 3 and text in trained:
        at = set(range(len(said)))
    return len(at), sum(n - 1 not in at for n in at)


def test_coverage_equals_brute_force(spark, monkeypatch):
    base, other = [f"w{n}" for n in range(40)], [f"v{n}" for n in range(40)]
    trained = [" ".join(base), " ".join(other[:9]), " ".join(other[20:33]), "one two", "गाँव में पानी नहीं आया"]
    asked = [
        " ".join(base), " ".join(base[:12] * 3), " ".join(other), " ".join([*[f"u{n}" for n in range(60)], *base[5:8]]), "one two", "two one", "one", "", "quite other words",
        " ".join(base[:20] + other[20:30]), "गाँव में पानी नहीं आया",
    ]
    rows = [(n, t, "train") for n, t in enumerate([*trained, trained[0]])] + [(100 + n, t, ("test", "validation")[n % 2]) for n, t in enumerate(asked)]
    data = spark.createDataFrame([(i, None, t, None, p, "s", 1, "x") for i, t, p in rows], SCHEMA)
    for shard in (overlap.SHARD_PASSAGES, 50):
        monkeypatch.setattr(overlap, "SHARD_PASSAGES", shard)
        found = {r.row_id: (r.covered_words, r.intervals) for r in overlap.coverage(data).collect()}
        assert found == {100 + n: covered(t, trained) for n, t in enumerate(asked)}
    assert found[100] == (40, 1) and found[101] == (36, 1) and found[103] == (3, 1)  # a copy, repeated passages, a single run


def test_coverage_without_evaluation_rows(spark):
    data = spark.createDataFrame([(1, "a-1", "क ख ग घ", None, "train", "s", 1, "x")], SCHEMA)
    assert overlap.coverage(data).count() == 0 and overlap.coverage(data.limit(0)).count() == 0


def test_no_evaluation_rows(spark):
    data = spark.createDataFrame([(1, "a-1", "क ख ग घ", None, "train", "s", 1, "x")], SCHEMA)
    assert overlap.overlaps(data).count() == 0 and overlap.overlaps(data.limit(0)).count() == 0


def test_hot_groups_and_bands(spark, monkeypatch):
    """Parts of a band, of a group of copies and of both ends of a link: the same pairs as in one piece."""
    from vaksetu.llm import joins

    base = " ".join(f"w{n}" for n in range(40))
    rows = [(n, base) for n in range(1, 40)] + [(100 + n, f"{base} x{n}") for n in range(30)] + [(200 + n, f"{base} x7") for n in range(20)] + [(300 + n, f"other {n} text {n} here") for n in range(9)]
    for part in (joins.PART_ROWS, 4):
        monkeypatch.setattr(joins, "PART_ROWS", part)
        monkeypatch.setattr(neardup, "PART_ROWS", part)
        found = neardup.row_pairs(*neardup.near_links(frame(spark, rows)), "a", "b").collect()
        assert len(found) == len(set(found)) and set(map(tuple, found)) == brute(rows)


def test_band_shared_by_many_texts(spark):
    """12,000 different texts in one band, in six parts: those whose sketches are near find each other, and nothing else is a pair."""
    banded = spark.range(12_000).selectExpr("id AS k", "IF(id < 3, id, xxhash64(id)) AS s", "1L AS h").union(spark.range(2).selectExpr("-id - 1 AS k", "0L AS s", "2L AS h"))
    found = {tuple(r) for r in neardup.met_in_bands(banded, 3).collect()}
    assert found == {(0, 1), (0, 2), (1, 2), (-2, -1)}


def test_one_key_for_two_texts(spark):
    """Two texts with one 64-bit key: both are compared with a third."""
    one, two = " ".join(f"w{n}" for n in range(30)), " ".join(f"v{n}" for n in range(30))
    rows = spark.createDataFrame([(7, b"1", one), (7, b"2", two), (8, b"3", one + " x"), (9, b"4", two + " x")], "k long, d binary, text string").coalesce(1)
    assert {tuple(r) for r in neardup.candidates(rows).collect()} == {(7, 8), (7, 9)}
    found = neardup.verified(rows, neardup.cut(neardup.candidates(rows))).collect()
    assert {(bytes(r.da), bytes(r.db)) for r in found} == {(b"1", b"3"), (b"2", b"4")}


def matched(spark, train, evaluation):
    """Pairs of texts that the search of overlaps finds."""
    sides = [neardup.keyed(frame(spark, list(enumerate(x))), "row_id", "text").select("k", "text", "d").repartition(3) for x in (train, evaluation)]
    said = {r.k: r.text for side in sides for r in side.collect()}
    found = overlap.passage_matches(*sides).collect()
    assert len(found) == len(set(found))
    return {(said[r.kt], said[r.ke]) for r in found}


def test_phrase_of_many_texts_makes_no_pairs(spark):
    """Two thirds of each text are a phrase of all: too little for texts near the same. Only those near the same are compared."""
    phrase = " ".join(f"w{n}" for n in range(80))
    train = [phrase + " " + " ".join(f"t{i}x{n}" for n in range(40)) for i in range(40)]
    evaluation = [phrase + " " + " ".join(f"e{i}x{n}" for n in range(40)) for i in range(30)] + [train[3] + " end", "begin " + train[7]]
    assert matched(spark, train, evaluation) == {(train[3], train[3] + " end"), (train[7], "begin " + train[7])}


def test_fronts_hold_all_near_texts(spark):
    """Texts of other lengths, also at exactly 0.6, of few words, in one shard and in many: no pair near the same is lost."""
    random.seed(11)
    vocabulary = [f"w{n}" for n in range(25)]
    long_ = [random.choices(vocabulary, k=random.choice((3, 4, 8, 12, 40, 90))) for _ in range(60)] + [[f"v{n}" for n in range(size)] for size in (12, 102, 400)]
    train, evaluation = [" ".join(x) for x in long_], ["", "w1 w2"]
    for words_ in long_:
        n = len(words_) - 2
        evaluation += [" ".join(words_[: max(3, round(share * n) + 2)]) for share in (0.6, 0.62, 0.8)]
        evaluation += [" ".join(words_ + [f"x{n}" for n in range(max(0, round(more * n)))]) for more in (0.1, 2 / 3)]
        evaluation.append(" ".join(random.choice(vocabulary) if random.random() < 0.07 else w for w in words_))
    near = {(a, b) for a in train for b in set(evaluation) if a != b and similarity(a, b) >= 0.6}
    assert any(similarity(a, b) == 0.6 for a, b in near) and near <= matched(spark, train, evaluation)


def test_more_shards_send_no_more(spark):
    """Each passage goes to one shard: what is searched does not grow with their number."""
    texts_ = neardup.keyed(frame(spark, list(enumerate(texts()))), "row_id", "text")
    folder = overlap.new_folder(spark, "counts")
    buckets = overlap.count_passages(texts_, folder)
    sizes = {shards: sum(len(r.body) for r in overlap.fronts(texts_, folder, buckets, shards, 1).collect()) for shards in (1, 7, 60)}
    assert sizes[1] > 0 and len(set(sizes.values())) == 1
