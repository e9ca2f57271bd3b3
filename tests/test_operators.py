import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vaksetu.operators import corpus, metrics, select, sequence, serve
from vaksetu.sources import jsonl

ARTICLE = "दिल्ली में आज भारी बारिश हुई। सड़कों पर पानी भर गया। लोगों को परेशानी हुई। मौसम विभाग ने चेतावनी दी। कल भी बारिश होगी।"


def raw(spark, rows):
    return spark.createDataFrame(rows, "id string, split string, pos long, text string, summary string")


def test_first_usable_wins(spark):
    rows = [("a", "train", 1, "क", "क ख ग"), ("a", "train", 2, "क ख ग घ", "क ख"), ("a", "train", 3, "क ख ग घ च", "क"), ("a", "test", 1, "क ख ग", "क"), ("b", "train", 4, None, None)]
    cleaned = corpus.cleaned(raw(spark, rows))
    found = corpus.first_usable(cleaned).select("split", "id", "pos").collect()
    assert sorted(map(tuple, found)) == [("test", "a", 1), ("train", "a", 2)]
    counts = {r.split: (r.kept, r.dropped) for r in corpus.kept_and_dropped(cleaned).collect()}
    assert counts == {"train": (1, 3), "test": (1, 0)}


def test_caps_and_limits(spark):
    rows = corpus.cleaned(raw(spark, [(str(n), s, n, "क ख ग", "क") for n in range(10) for s in ("train", "test")]))
    assert corpus.capped(rows, 0).count() == 0
    assert corpus.capped(rows, 3).count() == 6
    assert corpus.capped(rows, None).count() == 20
    test = rows.where("split = 'test'")
    assert [r.pos for r in corpus.limited(test, 2, 3).collect()] == [3, 4]
    assert corpus.limited(test, 0).count() == 0 and corpus.limited(test, None).count() == 10 and corpus.limited(test, 0, 4).count() == 6


def test_empty_tables(spark):
    empty = raw(spark, []).limit(0)
    assert corpus.first_usable(corpus.cleaned(empty)).count() == 0
    assert corpus.split_stats(empty).count() == 0
    assert metrics.evaluated(metrics.scored(spark.createDataFrame([], "system string, prediction string, reference string"))).count() == 0


def test_split_stats(spark):
    found = corpus.split_stats(raw(spark, [("a", "t", 1, "क ख ग घ। च छ।", "क ज"), ("b", "t", 2, "क ख", None)])).first()
    assert found.examples == 2 and found.article_words_mean == 4 and found.article_words_p50 == 4 and found.compression_ratio_mean == pytest.approx((3 + 2) / 2)
    assert found.novel_unigram_ratio == 0.25 and found.novel_bigram_ratio == 0.5


def lead(spark, text, n):
    return spark.createDataFrame([(text,)], "t string").select(select.lead("t", n)).first()[0]


def test_lead(spark):
    assert lead(spark, ARTICLE, 1) == "दिल्ली में आज भारी बारिश हुई।"
    assert lead(spark, "एक।", 3) == "एक।" and lead(spark, None, 2) == "" and lead(spark, "", 2) == ""


def test_pagerank():
    scores = select.pagerank(np.array([[0, 1, 1], [1, 0, 0], [1, 0, 0]], float))
    assert scores.sum() == pytest.approx(1) and scores[0] > scores[1] and scores[1] == pytest.approx(scores[2])
    assert select.pagerank(np.zeros((3, 3))) == pytest.approx([1 / 3] * 3)


def rank(spark, text, n):
    return spark.createDataFrame([(text,)], "t string").select(select.textrank("t", n)).first()[0]


def test_textrank(spark):
    hub = "सरकार ने नई शिक्षा नीति घोषित की। नई शिक्षा नीति से स्कूल बदलेंगे। सरकार स्कूल खोलेगी। क्रिकेट मैच रद्द हुआ।"
    assert rank(spark, hub, 1) in ("सरकार ने नई शिक्षा नीति घोषित की।", "नई शिक्षा नीति से स्कूल बदलेंगे।")
    two = rank(spark, ARTICLE, 2)
    parts = [s for s in ARTICLE.replace("। ", "।|").split("|") if s in two]
    assert len(parts) == 2 and two == " ".join(parts)
    assert rank(spark, "एक। दो।", 2) == "एक। दो।" and rank(spark, None, 1) == ""
    assert rank(spark, "क ख ग। क ख ग। घ च छ।", 1) == "क ख ग।"


def brute_oracle(sentences, reference, n):
    """Restates the greedy choice with a plain score."""
    from collections import Counter

    from vaksetu.functions.python_text import tokenize

    def f(p, r):
        o = sum((Counter(p) & Counter(r)).values())
        return 0.0 if not o else 2 * o / (len(p) + len(r))

    def score(chosen):
        t = [w for i in sorted(chosen) for w in tokenize(sentences[i])]
        r = tokenize(reference)
        return round(f(t, r) + f(list(zip(t, t[1:])), list(zip(r, r[1:]))), 12)

    chosen, best = [], -1.0
    while len(chosen) < min(n, len(sentences)):
        i = max((i for i in range(len(sentences)) if i not in chosen), key=lambda i: (score([*chosen, i]), -i))
        if score([*chosen, i]) <= best:
            break
        best = score([*chosen, i])
        chosen.append(i)
    return " ".join(sentences[i] for i in sorted(chosen))


def test_oracle(spark):
    random.seed(1)
    words = "क ख ग घ च छ ज झ".split()
    cases = []
    for _ in range(60):
        sentences = [" ".join(random.choices(words, k=random.randint(1, 6))) + "।" for _ in range(random.randint(0, 6))]
        cases.append((" ".join(sentences), " ".join(random.choices(words, k=random.randint(0, 7))), sentences))
    rows = spark.createDataFrame([(n, t, r) for n, (t, r, _) in enumerate(cases)], "n int, t string, r string")
    found = {r.n: r.s for r in rows.select("n", select.oracle("t", "r").alias("s")).collect()}
    assert all(found[n] == brute_oracle(s, r, 3) for n, (_, r, s) in enumerate(cases))
    none = spark.createDataFrame([("एक। दो।", "कुछ और"), (None, "x"), ("एक।", None)], "t string, r string").select(select.oracle("t", "r")).collect()
    assert [r[0] for r in none] == ["एक।", "", "एक।"]


def scores_of(spark, pairs):
    rows = spark.createDataFrame([("s", n, p, r, a) for n, (p, r, a) in enumerate(pairs)], "system string, pos long, prediction string, reference string, source string")
    return metrics.scored(rows, source="source")


def test_rouge(spark):
    found = scores_of(spark, [("क ख ग", "क ख ग", "क ख ग"), ("क, ख। ग", "क ख ग", ""), ("क", "ख", None), (None, "क", "")]).orderBy("pos").collect()
    assert [(r.rouge1, r.rouge2, r.rougeL) for r in found] == [(1, 1, 1), (1, 1, 1), (0, 0, 0), (0, 0, 0)]


def test_subsequence_length():
    random.seed(2)
    for _ in range(200):
        a, b = (random.choices("abcd", k=random.randint(0, 12)) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert metrics.subsequence_length(a, b) == table[-1][-1]


def test_evaluate(spark):
    found = metrics.evaluated(scores_of(spark, [("30 लोग", "30 लोग", "20 लोग आए"), ("क ख", "क ख", "क ख ग")])).first()
    assert found.num_examples == 2 and found.unsupported_number_rate == 0.5 and found.rouge1_mean == 1.0


def test_evaluate_has_the_intervals_of_numpy(spark, monkeypatch):
    scores = scores_of(spark, [(f"क ख ग {n}", "क ख " + "ग " * (n % 3), "क") for n in range(40)])
    values = {c: np.array([r[c] for r in scores.orderBy("pos").collect()]) for c in ("rouge1", "rouge2", "rougeL")}
    for draws in (metrics.DRAWS, 70):
        monkeypatch.setattr(metrics, "DRAWS", draws)
        found = metrics.evaluated_with_intervals(scores, order="pos").first()
        for c, v in values.items():
            drawn = np.random.default_rng(0).integers(0, 40, size=(1000, 40))
            assert tuple(found[f"{c}_ci95"]) == pytest.approx(tuple(np.quantile(v[drawn].mean(axis=1), [0.025, 0.975])))
            if draws == 70:  # blocks of one resample
                assert metrics.bootstrap_interval(v) == pytest.approx(tuple(found[f"{c}_ci95"]))


def test_bootstrap(spark):
    values = np.random.default_rng(3).normal(0.5, 0.1, 400)
    low, high = metrics.bootstrap_interval(values)
    assert low < values.mean() < high and high - low < 0.1
    assert metrics.bootstrap_interval(np.array([])) == (0.0, 0.0)
    rows = spark.createDataFrame([("s", n, float(v)) for n, v in enumerate(values)], "system string, pos long, v double")
    found = metrics.bootstrap(rows, "v", resamples=200).first()
    assert found.low < values.mean() < found.high and found.high - found.low < 0.1


def test_mismatch_is_an_error(spark):
    p = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, prediction string")
    assert metrics.checked_pairs(p, p.withColumnRenamed("prediction", "reference")).count() == 2
    with pytest.raises(Exception, match="differ"):
        metrics.checked_pairs(p, p.where("id = 'a'").withColumnRenamed("prediction", "reference")).collect()


def test_relational_tfidf_agrees(spark):
    rows = spark.createDataFrame([(1, ARTICLE), (2, ""), (3, "क ख। क। ।")], "doc long, text string")
    sims = select.similarities(select.tfidf(select.sentences(rows, "doc"), "doc"), "doc").where("doc = 1").collect()
    from vaksetu.functions.python_text import split_sentences, tokenize

    matrix = select.tfidf_matrix([tokenize(s) for s in split_sentences(ARTICLE)])
    wanted = matrix @ matrix.T
    assert sims and all(r.sim == pytest.approx(wanted[r.i, r.j]) for r in sims)
    assert {r.doc for r in select.ranks(rows, "doc").collect()} == {1, 3}


def test_encode(spark):
    special = sequence.SpecialIds()
    rows = spark.createDataFrame([(" ".join(["शब्द"] * n),) for n in (3, 1000, 0)], "t string").select(sequence.encode(sequence.hashed_ids("t"), special, 32).alias("ids"))
    found = [r.ids for r in rows.collect()]
    assert [len(i) for i in found] == [5, 32, 2] and all(i[-2:] == [64001, 64006] for i in found)


def test_special_ids():
    vocabulary = {"<pad>": 0, "<s>": 1, "</s>": 2, "<2hi>": 3}
    assert sequence.SpecialIds.of(vocabulary).language == 3
    with pytest.raises(ValueError, match="<2hi>"):
        sequence.SpecialIds.of({k: v for k, v in vocabulary.items() if k != "<2hi>"})


def test_batches_and_padding(spark):
    rows = spark.createDataFrame([("s", n, list(range(n % 5))) for n in range(20)], "split string, pos long, ids array<int>")
    made = sequence.batches(rows.withColumn("n", F.size("ids")), "n", 2)
    assert {r.chunk for r in made.collect()} == {0, 1}
    first = [r.n for r in made.where("chunk = 0").orderBy("place").collect()]
    assert first == sorted(first, reverse=True)
    filled = sequence.padded(made.withColumn("b", F.struct("chunk", "batch")), "b", "ids", -1).groupBy("b").agg(F.countDistinct(F.size("ids")).alias("k"))
    assert {r.k for r in filled.collect()} == {1}


def test_training_steps():
    assert sequence.training_steps(1600, 8, 1, 1, 500, 0.1) == {"per_epoch": 200, "total": 200, "eval_steps": 200, "warmup": 20}


def test_summarize_keeps_rows(spark):
    rows = spark.createDataFrame([(1, "क ख  ग"), (2, None), (3, "http://a घ")], "id long, text string")
    found = {r.id: r.summary for r in sequence.summarize(rows, sequence.FirstWords).collect()}
    assert found == {1: "क ख ग", 2: "", 3: "घ"}


def requests(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "request_id long, texts array<string>, method string, num_sentences int")


def test_validation(spark):
    rows = [([], None, 1), (None, None, 1), (["   "], None, 1), (["a" * 20_001], None, 1), (["a"], None, 0), (["a"], "other", 1), (["a"] * 33, None, 1), (["a", None], None, 1), (["a"], "lead", 10)]
    assert [r.problem is None for r in serve.validated(requests(spark, *rows)).orderBy("request_id").collect()] == [False] * 8 + [True]


def test_answers(spark):
    rows = requests(spark, ([ARTICLE, "एक। दो।"], None, 1))
    got = serve.answer(rows, "lead")
    assert got["status"] == 200 and got["summaries"] == ["दिल्ली में आज भारी बारिश हुई।", "एक।"] and got["latency_ms"] >= 0
    assert serve.answer(rows, "textrank")["status"] == 200
    assert serve.answer(requests(spark, ([], None, 1)), "lead")["status"] == 422
    assert serve.answer(rows, "model", sequence.FirstWords)["summaries"][1] == "एक। दो।"
    assert serve.health() == {"status": "ok", "model_configured": False, "model_loaded": serve.health()["model_loaded"]}
    with pytest.raises(RuntimeError):
        sequence.ModelRegistry.get("other", None)


def test_jsonl(spark, tmp_path):
    lines = [{"id": "a", "text": "क ख ग", "summary": "क", "url": "x"}, {"id": "b", "text": None, "summary": "क"}]
    (tmp_path / "train.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines), encoding="utf-8")
    rows = jsonl.read_raw_split(spark, str(tmp_path), "train")
    assert [(r.id, r.pos) for r in rows.orderBy("pos").collect()] == [("a", 0), ("b", 1)]
    out = str(tmp_path / "out")
    jsonl.write_splits(corpus.first_usable(corpus.cleaned(rows)), out)
    assert [r.text for r in jsonl.read_processed(spark, out, "train").collect()] == ["क ख ग"]
    assert jsonl.read_processed(spark, out, "train", 0).count() == 0
    with pytest.raises(FileNotFoundError):
        jsonl.read_processed(spark, out, "test")
    (tmp_path / "val.jsonl").write_text("{broken", encoding="utf-8")
    with pytest.raises(Exception):
        jsonl.read_raw_split(spark, str(tmp_path), "validation").collect()
    jsonl.write_result({"a": "क"}, str(tmp_path / "r" / "x.json"))
    assert json.loads((tmp_path / "r" / "x.json").read_text(encoding="utf-8")) == {"a": "क"}
    assert jsonl.whole(0) is None and jsonl.whole(3) == 3


def test_streams(spark, tmp_path):
    from vaksetu.streaming.requests import answer_stream

    requests(spark, ([ARTICLE], None, 1), ([""], None, 1)).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("request_id long, texts array<string>, method string, num_sentences int").parquet(str(tmp_path / "in"))
    answer_stream(stream, "lead", str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert [r.summaries for r in spark.read.json(str(tmp_path / "out")).collect()] == [["दिल्ली में आज भारी बारिश हुई।"]]


def test_generation_metrics(spark):
    names = F.create_map(*(F.lit(x) for pair in ((0, "<pad>"), (1, "क"), (2, "ख"), (3, "</s>")) for x in pair))
    rows = spark.createDataFrame([([1, 2, 3], [1, 2, 3, -100]), ([1, 3], [2, 3, -100, -100])], "predicted array<int>, labels array<int>")
    found = sequence.generation_metrics(rows, lambda ids: F.array_join(F.transform(ids, lambda i: F.element_at(names, i)), " "), 0).first()
    assert (found.rouge1, found.rougeL, found.gen_words) == (0.5, 0.5, 1.5)
    assert sequence.generation_metrics(rows.limit(0), lambda ids: F.array_join(ids.cast("array<string>"), " "), 0).first().rouge1 == 0.0


def test_settings_and_devices():
    pinned = sequence.GenerationSettings().pinned(sequence.SpecialIds())
    assert pinned["forced_eos_token_id"] == 64001 and pinned["decoder_start_token_id"] == 64006 and pinned["num_beams"] == 4
    assert sequence.pick_device(None) == "cpu" and sequence.pick_device(None, ("mps", "cuda")) == "cuda" and sequence.pick_device("mps") == "mps"
    assert metrics.timed(lambda: 5, 10)["result"] == 5


def test_archive(tmp_path):
    import tarfile

    from vaksetu.sources.archive import unpacked

    (tmp_path / "train.jsonl").write_text("{}")
    with tarfile.open(tmp_path / "a.tar.bz2", "w:bz2") as tar:
        tar.add(tmp_path / "train.jsonl", "train.jsonl")
    folder = str(tmp_path / "raw")
    assert (tmp_path / "raw" / "train.jsonl").exists() is False
    assert unpacked(str(tmp_path / "a.tar.bz2"), folder) == folder == unpacked("missing", folder)


def test_numbered(spark):
    from vaksetu.runtime import numbered

    rows = [(("a", "b", "c")[n % 7 % 3], (n * 37) % 1000) for n in range(1000)]
    found = numbered(spark.createDataFrame(rows, "g string, o long"), "g", "o").collect()
    for g in "abc":
        mine = sorted((r.o, r.i) for r in found if r.g == g)
        assert [i for _, i in mine] == list(range(len(mine)))
    assert len(found) == 1000 and numbered(spark.createDataFrame([], "g string, o long"), "g", "o").count() == 0


def test_splits_keep_their_order(spark, tmp_path):
    rows = [{"id": f"r{n * 7 % 500}", "text": f"क ख ग {n}", "summary": "क"} for n in range(500)]
    (tmp_path / "hindi_train.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in rows), encoding="utf-8")
    read = jsonl.read_raw_split(spark, str(tmp_path), "train", jsonl.files("hindi_"))
    assert [r.id for r in read.orderBy("pos").collect()] == [x["id"] for x in rows] and read.agg(F.max("pos")).first()[0] == 499
    out = str(tmp_path / "out")
    jsonl.write_splits(read.repartition(5), out)
    assert [r.id for r in jsonl.read_processed(spark, out, "train", 123).collect()] == [x["id"] for x in rows[:123]]
    assert jsonl.read_processed(spark, out, "train").count() == 500


def test_first_usable_of_a_frequent_key_and_ties(spark):
    rows = spark.createDataFrame([("a", "train", 5, f"x{n}", "s", n > 2) for n in range(400)] + [("b", "train", 1, "t", "s", False)], "id string, split string, pos long, text string, summary string, usable boolean")
    assert [(r.id, r.text) for r in corpus.first_usable(rows).collect()] == [("a", "x10")]


def test_means_of_nothing_are_zeros(spark):
    found = metrics.evaluated_whole(metrics.scored(spark.createDataFrame([], "prediction string, reference string"))).first()
    assert (found.num_examples, found.rouge1_mean, found.rouge2_mean, found.rougeL_mean) == (0, 0, 0, 0)
    assert metrics.evaluated_whole(scores_of(spark, [("क", "क", "क")])).first().rouge1_mean == 1


def test_long_document_is_ranked_without_its_square():
    rng = np.random.default_rng(5)
    docs = [[f"w{k}" for k in rng.integers(0, 4000, 12)] for _ in range(20_000)]  # the cosines alone would take 3.2 GB
    scores = select.sentence_scores(docs)
    assert scores.sum() == pytest.approx(1, abs=1e-4) and (scores > 0).all()
    some = docs[:60] + [[]]
    dense = select.tfidf_matrix(some) @ select.tfidf_matrix(some).T
    np.fill_diagonal(dense, 0)
    assert select.sentence_scores(some) == pytest.approx(select.pagerank(dense), abs=1e-9)


def test_http(spark):
    import threading
    import urllib.error
    import urllib.request

    server = serve.http_server(spark, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def post(body):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{at}/summarize", json.dumps(body).encode(), {"Content-Type": "application/json"})) as got:
                return got.status, json.loads(got.read())
        except urllib.error.HTTPError as error:
            return error.code, json.loads(error.read())

    with urllib.request.urlopen(f"{at}/health") as got:
        assert json.loads(got.read())["status"] == "ok"
    status, body = post({"texts": [ARTICLE, "एक। दो।"], "method": "lead"})
    assert status == 200 and body["summaries"] == ["दिल्ली में आज भारी बारिश हुई।", "एक।"] and body["method"] == "lead" and body["latency_ms"] >= 0
    assert post({"texts": ["एक।"]})[0] == 503 and post({"texts": []})[0] == post({"texts": ["x"], "method": "other"})[0] == post({"texts": 5})[0] == 422
    server.shutdown()


def test_model_configuration():
    from types import SimpleNamespace as Any

    model = Any(config=Any(), generation_config=Any(), parameters=lambda: [Any(numel=lambda: 6, requires_grad=True), Any(numel=lambda: 4, requires_grad=False)])
    sequence.configure_generation(model, sequence.SpecialIds())
    assert model.config.decoder_start_token_id == model.generation_config.decoder_start_token_id == 64006 and model.config.forced_eos_token_id == 64001
    assert sequence.parameter_counts(model) == {"trainable": 6, "total": 10}
    assert sequence.imported("vaksetu.operators.sequence:FirstWords") is sequence.FirstWords
    with pytest.raises(ValueError):
        sequence.imported("vaksetu")


def test_bertscore(spark):
    rows = spark.createDataFrame([("क", "क"), (None, "ख")], "prediction string, reference string")
    found = metrics.bertscore(rows, lambda p, r: [(1.0, 0.5, float(a == b)) for a, b in zip(p, r)]).collect()
    assert [r.bert_f1 for r in found] == [1.0, 0.0]


def test_usable_stream(spark, tmp_path):
    from vaksetu.streaming.requests import usable_stream

    schema = "raw_id long, text string, summary string, delivered_at timestamp"
    spark.createDataFrame([(1, "क ख ग", "क", None), (1, "क ख ग", "क", None), (2, "क", "क ख", None)], schema).withColumn("delivered_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = usable_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).select("raw_id")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(60)
    assert [r.raw_id for r in spark.read.schema("raw_id long").parquet(str(tmp_path / "out")).collect()] == [1]
