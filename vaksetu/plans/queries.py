"""The queries of the engine's own operators, each over whole tables, and their SQL.

Floats are rounded to 6 digits on both sides. Where no SQL is given, the draws or the rules are those of a Python library; the tests compare
the operators with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ngrams as N
from ..functions import text as T
from ..operators import corpus, metrics, select, sequence, serve
from ..runtime import spread, table
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SPECIAL = sequence.SpecialIds()


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


# --- text -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT raw_id, {S.clean('text')} AS text, {S.clean('summary')} AS summary FROM raw_examples")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_examples").select("raw_id", T.clean_text("text").alias("text"), T.clean_text("summary").alias("summary"))


@query(f"SELECT raw_id, {S.nfc('text')} AS composed FROM raw_examples")
def nfc_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_examples").select("raw_id", T.nfc("text").alias("composed"))


@query(f"SELECT raw_id, {S.strip_zero_width('text')} AS text FROM raw_examples")
def strip_zero_width(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_examples").select("raw_id", T.strip_zero_width("text").alias("text"))


@query(f"SELECT raw_id, {S.strip_urls('text')} AS text FROM raw_examples")
def strip_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_examples").select("raw_id", T.strip_urls("text").alias("text"))


@query(f"SELECT raw_id, {S.collapse('text')} AS collapsed, {S.flatten('text')} AS flat FROM raw_examples")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_examples").select("raw_id", T.collapse_whitespace("text").alias("collapsed"), T.flatten_whitespace("text").alias("flat"))


@query(f"SELECT row_id, len({S.tokens('text')}) AS text_tokens, len({S.tokens('summary')}) AS summary_tokens, md5(array_to_string({S.tokens('text')}, ' ')) AS digest FROM processed")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    tokens = spread(table(spark, d, "processed").select("row_id", "text", "summary")).select("row_id", T.tokenize("text").alias("t"), T.tokenize("summary").alias("s"))
    return tokens.select("row_id", F.size("t").cast("bigint").alias("text_tokens"), F.size("s").cast("bigint").alias("summary_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"SELECT row_id, len({S.ws_words('text')}) AS words FROM processed")
def whitespace_word_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", F.size(T.whitespace_words("text")).cast("bigint").alias("words"))


@query(f"SELECT row_id, len({S.sentences('text')}) AS sentences FROM processed")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", F.size(T.split_sentences("text")).cast("bigint").alias("sentences"))


@query(f"WITH s AS (SELECT row_id, {S.sentences('text')} AS s FROM processed) SELECT row_id, i - 1 AS i, s[i] AS sentence FROM (SELECT row_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)")
def sentence_explode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", F.posexplode(T.split_sentences("text")).alias("i", "sentence")).withColumn("i", F.col("i").cast("bigint"))


@query()
def sentence_split_indic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", F.size(T.split_sentences_indic("text")).alias("sentences"))


@query(f"SELECT row_id, CASE WHEN len({S.ws_words('text')}) <= 40 THEN text ELSE array_to_string(list_slice({S.ws_words('text')}, 1, 40), ' ') END AS head FROM processed")
def truncate_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", T.truncate_words("text", 40).alias("head"))


@query("SELECT row_id, substring(text, 1, 400) AS head FROM processed")
def char_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", T.char_prefix("text", 400).alias("head"))


@query(rf"SELECT system, id, pos, created_at::VARCHAR AS created, {S.collapse(r'''regexp_replace(prediction, '<2[a-z]{2}>|</?s>|<pad>|<unk>|\[(?:CLS|SEP|MASK)\]', ' ', 'g')''')} AS prediction FROM predictions")
def clean_output(spark: SparkSession, d: str) -> DataFrame:
    created = F.regexp_replace(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    created = F.when(F.date_format("created_at", "SSSSSS") == "000000", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).otherwise(created)
    return table(spark, d, "predictions").select("system", "id", "pos", created.alias("created"), T.clean_output("prediction").alias("prediction"))


@query(f"SELECT row_id, array_to_string(list_sort({S.numbers(S.tokens('text'))}), ' ') AS numbers FROM processed")
def extract_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").select("row_id", F.array_join(F.array_sort(T.numbers(T.tokenize("text"))), " ").alias("numbers"))


FIXTURE = ("दिल्ली में भारी बारिश हुई।", '"मोदी", ने कहा: २०१९ में 5.5%', "", "।।", "Don’t stop", "5.5% और १,२००", "10km ₹५०", "नई-दिल्ली", "A B C", "क‍ष")


@query(f"SELECT n, array_to_string({S.tokens('t')}, '|') AS tokens FROM (VALUES " + ", ".join(f"({n}, '{t}')" for n, t in enumerate(FIXTURE)) + ") x(n, t)")
def hindi_tokenize_fixture(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(FIXTURE)), "n int, t string").select("n", F.array_join(T.tokenize("t"), "|").alias("tokens"))


# --- corpus ---------------------------------------------------------------------------------------------------------------

_RAW = f"""WITH c AS (SELECT raw_id, id, split, {S.clean('text')} AS text, {S.clean('summary')} AS summary FROM raw_examples),
t AS (SELECT *, {S.tokens('text')} AS tt, {S.tokens('summary')} AS st FROM c), u AS (SELECT raw_id, id, split, text, summary, {S.usable('text', 'summary', 'tt', 'st')} AS usable FROM t)"""
_FIRST = _RAW + ", f AS (SELECT *, row_number() OVER (PARTITION BY split, id ORDER BY raw_id) AS k FROM u WHERE usable)"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return corpus.cleaned(table(spark, d, "raw_examples").select("raw_id", "id", "split", "text", "summary")).drop("text_tokens", "summary_tokens")


@query(_RAW + " SELECT raw_id, usable FROM u")
def usable_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("raw_id", "usable")


@query(_FIRST + " SELECT raw_id, id, split, text, summary FROM f WHERE k = 1")
def dedup_first_usable(spark: SparkSession, d: str) -> DataFrame:
    return corpus.first_usable(_raw(spark, d), order="raw_id").select("raw_id", "id", "split", "text", "summary")


@query(_FIRST + ", g AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY raw_id) AS n FROM f WHERE k = 1) SELECT raw_id, split FROM g WHERE n <= 20")
def cap_per_split(spark: SparkSession, d: str) -> DataFrame:
    return corpus.capped(corpus.first_usable(_raw(spark, d), order="raw_id"), 20, "raw_id").select("raw_id", "split")


@query(_FIRST + " SELECT split, count(*) FILTER (WHERE k = 1) AS kept, (SELECT count(*) FROM u v WHERE v.split = f.split) - count(*) FILTER (WHERE k = 1) AS dropped FROM f GROUP BY split")
def kept_dropped_counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.kept_and_dropped(_raw(spark, d))


@query("SELECT row_id, pos FROM processed WHERE split = 'test' ORDER BY pos LIMIT 50")
def load_limit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.limited(table(spark, d, "processed").where("split = 'test'").select("row_id", "pos"), 50)


@query("SELECT row_id, pos FROM processed WHERE split = 'train' ORDER BY pos LIMIT 64 OFFSET 128")
def offset_limit(spark: SparkSession, d: str) -> DataFrame:
    return corpus.limited(table(spark, d, "processed").where("split = 'train'").select("row_id", "pos"), 64, 128)


@query("SELECT split, count(*) AS rows, count(DISTINCT id) AS ids FROM processed GROUP BY split")
def split_union(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "processed").groupBy("split").agg(F.count("*").alias("rows"), F.countDistinct("id").alias("ids"))


_SIZES = f"""WITH t AS (SELECT row_id, split, {S.tokens('text')} AS tt, {S.tokens('summary')} AS st, len({S.sentences('text')}) AS sents FROM processed),
g AS MATERIALIZED (SELECT row_id, split, sents, tt, st, {S.ngrams('tt', 2)} AS t2, {S.ngrams('st', 2)} AS s2 FROM t),
z AS (SELECT row_id, split, len(tt) AS aw, sents, len(st) AS sw, len(tt) / greatest(len(st), 1) AS cr,
coalesce(len({S.minus('st', 'tt')}) / nullif(len(list_distinct(st)), 0), 0.0) AS n1,
coalesce(len({S.minus('s2', 't2')}) / nullif(len(list_distinct(s2)), 0), 0.0) AS n2 FROM g)"""


@query(
    _SIZES
    + """ SELECT split, count(*) AS examples, round(avg(aw), 6) AS article_words_mean, round(median(aw), 6) AS article_words_p50, round(quantile_cont(aw, 0.95), 6) AS article_words_p95,
round(avg(sents), 6) AS article_sentences_mean, round(avg(sw), 6) AS summary_words_mean, round(quantile_cont(sw, 0.95), 6) AS summary_words_p95, round(avg(cr), 6) AS compression_ratio_mean,
round(avg(n1), 6) AS novel_unigram_ratio, round(avg(n2), 6) AS novel_bigram_ratio FROM z GROUP BY split"""
)
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    stats = corpus.split_stats(spread(table(spark, d, "processed").select("split", "text", "summary")))
    return stats.select("split", "examples", *(F.round(c, 6).alias(c) for c in stats.columns[2:]))


@query(_SIZES + " SELECT split, round(median(sw), 6) AS p50, round(quantile_cont(sw, 0.95), 6) AS p95 FROM z GROUP BY split")
def percentiles(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, d, "processed").select("split", F.size(T.tokenize("summary")).alias("w"))
    return sizes.groupBy("split").agg(F.round(F.median("w"), 6).alias("p50"), F.round(F.percentile("w", F.lit(0.95)), 6).alias("p95"))


@query(_SIZES + " SELECT split, round(avg(cr), 6) AS compression_ratio FROM z GROUP BY split")
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    sizes = corpus.text_sizes(table(spark, d, "processed"))
    return sizes.groupBy("split").agg(F.round(F.avg("compression"), 6).alias("compression_ratio"))


# --- n-grams --------------------------------------------------------------------------------------------------------------


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "processed").select("row_id", "split", "text", "summary")).select("row_id", "split", T.tokenize("text").alias("tt"), T.tokenize("summary").alias("st"))


@query(_SIZES + " SELECT row_id, round(n1, 6) AS ratio FROM z")
def novel_unigram_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("row_id", F.round(N.novel_ngram_ratio("st", "tt", 1), 6).alias("ratio"))


@query(_SIZES + " SELECT row_id, round(n2, 6) AS ratio FROM z")
def novel_bigram_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("row_id", F.round(N.novel_ngram_ratio("st", "tt", 2), 6).alias("ratio"))


@query(f"WITH t AS (SELECT row_id, {S.tokens('text')} AS tt, {S.tokens('summary')} AS st FROM processed) SELECT row_id, len({S.minus(S.numbers('st'), S.numbers('tt'))}) > 0 AS unsupported FROM t")
def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("row_id", T.has_unsupported_number("st", "tt").alias("unsupported"))


@query(f"WITH t AS (SELECT {S.tokens('summary')} AS st FROM processed), g AS (SELECT unnest({S.ngrams('st', 2)}) AS gram FROM t) SELECT replace(gram, chr(1), ' ') AS gram, count(*) AS n FROM g GROUP BY gram")
def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    grams = _tokens(spark, d).select(F.explode(N.ngrams("st", 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).select(F.replace("gram", F.lit(N.SEP), F.lit(" ")).alias("gram"), "n")


@query(f"WITH t AS (SELECT row_id, {S.tokens('summary')} AS st FROM processed) SELECT row_id, len(list_distinct({S.ngrams('st', 3)})) AS trigrams, len(st) AS tokens FROM t")
def ngram_sets(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(spark, d).select("row_id", F.size(N.ngram_set("st", 3)).cast("bigint").alias("trigrams"), F.size("st").cast("bigint").alias("tokens"))


# --- ROUGE ----------------------------------------------------------------------------------------------------------------

_PAIRS = f"WITH t AS (SELECT system, id, pos, created_at, {S.tokens('prediction')} AS p, {S.tokens('reference')} AS r FROM predictions)"
_KEY = "system, id, pos, strftime(created_at, '%Y%m%d%H%M%S%f') AS at"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions")
    return rows.select("system", "id", "pos", F.date_format("created_at", "yyyyMMddHHmmssSSSSSS").alias("at"), T.tokenize("prediction").alias("p"), T.tokenize("reference").alias("r"))


def _rouge_sql(n: int) -> str:
    a, b = S.ngrams("p", n), S.ngrams("r", n)
    return _PAIRS + f", g AS (SELECT *, {a} AS a, {b} AS b FROM t), o AS (SELECT *, {S.overlap('a', 'b')} AS o FROM g) SELECT {_KEY}, round({S.f1('o', 'len(a)', 'len(b)')}, 6) AS f1 FROM o"


@query(_rouge_sql(1))
def rouge1(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("system", "id", "pos", "at", F.round(N.rouge_n("p", "r", 1), 6).alias("f1"))


@query(_rouge_sql(2))
def rouge2(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("system", "id", "pos", "at", F.round(N.rouge_n("p", "r", 2), 6).alias("f1"))


_LCS = """, d AS (SELECT *, row_number() OVER () AS n FROM t), w(n, i, line) AS (SELECT n, 0, list_transform(range(0, len(r) + 1), lambda x: 0::BIGINT) FROM d UNION ALL
SELECT w.n, w.i + 1, list_prepend(0::BIGINT, list_transform(range(1, len(d.r) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN d.r[k] = d.p[w.i + 1] THEN w.line[k] + 1 ELSE w.line[k + 1] END))))
FROM w JOIN d ON d.n = w.n WHERE w.i < len(d.p)), l AS (SELECT d.*, w.line[len(d.r) + 1] AS lcs FROM w JOIN d ON d.n = w.n WHERE w.i = len(d.p))"""


@query(_PAIRS.replace("WITH t", "WITH RECURSIVE t") + _LCS + f" SELECT {_KEY}, round({S.f1('lcs', 'len(p)', 'len(r)')}, 6) AS f1 FROM l")
def rougeL(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("system", "id", "pos", "at", F.round(metrics.rouge("p", "r")["rougeL"], 6).alias("f1"))


@query(SQL["rougeL"])
def rougeL_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _predictions(spark, d).withColumn("lcs", N.lcs_length("p", "r"))
    return rows.select("system", "id", "pos", "at", F.round(N.f1(F.col("lcs"), F.size("p"), F.size("r")), 6).alias("f1"))


@query(_PAIRS + f" SELECT {_KEY}, {S.overlap('p', 'r')}::BIGINT AS overlap FROM t")
def multiset_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("system", "id", "pos", "at", N.multiset_overlap("p", "r").cast("bigint").alias("overlap"))


def _mean_sql(by: str, source: str) -> str:
    one, two = S.overlap("p", "r"), S.overlap("a", "b")
    return (
        f"WITH RECURSIVE t AS ({source}){_LCS}, g AS (SELECT *, {S.ngrams('p', 2)} AS a, {S.ngrams('r', 2)} AS b, {one} AS o1 FROM l), h AS (SELECT *, {two} AS o2 FROM g) "
        f"SELECT {by}, count(*) AS num_examples, round(avg({S.f1('o1', 'len(p)', 'len(r)')}), 6) AS rouge1_mean, round(avg({S.f1('o2', 'len(a)', 'len(b)')}), 6) AS rouge2_mean, "
        f"round(avg({S.f1('lcs', 'len(p)', 'len(r)')}), 6) AS rougeL_mean, round(avg(len(p)), 6) AS avg_summary_words FROM h GROUP BY {by}"
    )


@query(_mean_sql("system", f"SELECT system, {S.tokens('prediction')} AS p, {S.tokens('reference')} AS r FROM predictions"))
def rouge_by_group(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.evaluated(metrics.scored(table(spark, d, "predictions")))
    return found.select("system", "num_examples", *(F.round(c, 6).alias(c) for c in ("rouge1_mean", "rouge2_mean", "rougeL_mean", "avg_summary_words")))


# --- joins ----------------------------------------------------------------------------------------------------------------


@query("SELECT p.system, p.id, p.pos, p.prediction, e.summary FROM predictions p JOIN (SELECT id, min(row_id) AS row_id, arg_min(summary, row_id) AS summary FROM processed WHERE split = 'test' GROUP BY id) e ON p.id = e.id")
def predictions_with_articles(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "processed").where("split = 'test'").groupBy("id").agg(F.min(F.struct("row_id", "summary"))["summary"].alias("summary"))
    return table(spark, d, "predictions").join(first, "id").select("system", "id", "pos", "prediction", "summary")


@query("SELECT p.id, p.row_id FROM (SELECT id, row_id FROM processed WHERE split = 'test') p ANTI JOIN predictions q ON p.id = q.id")
def rows_without_prediction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processed").where("split = 'test'").select("id", "row_id")
    return rows.join(table(spark, d, "predictions").select("id"), "id", "left_anti")


@query("SELECT s.kind, s.lang, count(*) AS rows FROM processed p JOIN sources s ON p.source = s.source GROUP BY s.kind, s.lang")
def rows_by_source_kind(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "processed").groupBy("source").agg(F.count("*").alias("n"))  # before the join: a source may hold very many rows
    return rows.join(table(spark, d, "sources"), "source").groupBy("kind", "lang").agg(F.sum("n").alias("rows"))


# --- selection ------------------------------------------------------------------------------------------------------------


def _lead(n: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "processed").select("row_id", select.lead("text", n).alias("summary"))

    run.__name__ = f"lead_{n}"
    query(f"SELECT row_id, array_to_string(list_slice({S.sentences('text')}, 1, {n}), ' ') AS summary FROM processed")(run)


for _n in (1, 2, 3):
    _lead(_n)

_SENTENCES = f"""s AS MATERIALIZED (SELECT row_id, {S.sentences('text')} AS s FROM processed), e AS MATERIALIZED (SELECT row_id, len(s) AS n, i - 1 AS i, {S.tokens('s[i]')} AS tokens FROM (SELECT row_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
tf AS MATERIALIZED (SELECT row_id, n, i, token, count(*) AS tf FROM (SELECT row_id, n, i, unnest(tokens) AS token FROM e) GROUP BY ALL),
df AS (SELECT row_id, token, count(*) AS df FROM tf GROUP BY ALL), wt AS (SELECT tf.row_id, i, tf.token, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON tf.row_id = df.row_id AND tf.token = df.token),
unit AS MATERIALIZED (SELECT row_id, i, token, w / sqrt(sum(w * w) OVER (PARTITION BY row_id, i)) AS w FROM wt),
sim AS MATERIALIZED (SELECT a.row_id, a.i, b.i AS j, sum(a.w * b.w) AS sim FROM unit a JOIN unit b ON a.row_id = b.row_id AND a.token = b.token AND a.i <> b.i GROUP BY ALL)"""


def _sentence_rows(spark: SparkSession, d: str) -> DataFrame:
    return select.sentences(table(spark, d, "processed"), "row_id")


@query(f"WITH {_SENTENCES} SELECT row_id, i, token, tf FROM tf")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return select.term_frequency(_sentence_rows(spark, d), "row_id").select("row_id", F.col("i").cast("bigint").alias("i"), "token", "tf")


@query(f"WITH {_SENTENCES} SELECT row_id, token, df FROM df")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return select.document_frequency(select.term_frequency(_sentence_rows(spark, d), "row_id"), "row_id")


@query(f"WITH {_SENTENCES} SELECT row_id, i, token, round(w, 6) AS w FROM unit")
def tfidf_sentences(spark: SparkSession, d: str) -> DataFrame:
    return select.tfidf(_sentence_rows(spark, d), "row_id").select("row_id", F.col("i").cast("bigint").alias("i"), "token", F.round("w", 6).alias("w"))


@query(f"WITH {_SENTENCES} SELECT row_id, i, j, round(sim, 6) AS sim FROM sim")
def sentence_similarity(spark: SparkSession, d: str) -> DataFrame:
    found = select.similarities(select.tfidf(_sentence_rows(spark, d), "row_id"), "row_id")
    return found.select("row_id", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), F.round("sim", 6).alias("sim"))


# A dangling sentence gives its score to all alike; iteration k is kept until the change is below the tolerance.
_RANKS = f"""WITH RECURSIVE {_SENTENCES}, out AS MATERIALIZED (SELECT row_id, i, sum(sim) AS total FROM sim GROUP BY ALL), nodes AS MATERIALIZED (SELECT e.row_id, e.i, e.n, coalesce(o.total, 0) AS total FROM e LEFT JOIN out o ON o.row_id = e.row_id AND o.i = e.i),
adj AS MATERIALIZED (SELECT n.row_id, any_value(n.n) AS n, list(n.total > 0 ORDER BY n.i) AS linked FROM nodes n GROUP BY n.row_id),
inc AS MATERIALIZED (SELECT row_id, list(src ORDER BY j) AS src, list(wts ORDER BY j) AS wts FROM (SELECT n.row_id, n.i AS j, coalesce(list(s.i + 1 ORDER BY s.i) FILTER (WHERE s.i IS NOT NULL), []) AS src, coalesce(list(s.sim / o.total ORDER BY s.i) FILTER (WHERE s.i IS NOT NULL), []) AS wts
FROM nodes n LEFT JOIN sim s ON s.row_id = n.row_id AND s.j = n.i LEFT JOIN out o ON o.row_id = s.row_id AND o.i = s.i GROUP BY ALL) GROUP BY row_id),
g AS MATERIALIZED (SELECT adj.row_id, n, linked, src, wts FROM adj JOIN inc ON adj.row_id = inc.row_id),
it(row_id, k, score, done) AS (SELECT row_id, 0, list_transform(range(0, n), lambda x: 1.0::DOUBLE / n), false FROM g UNION ALL
SELECT row_id, k, now, list_sum(list_transform(range(1, n + 1), lambda q: abs(now[q] - score[q]))) < 1e-6 FROM (SELECT it.row_id, it.k + 1 AS k, it.score, g.n, (SELECT 1) AS one,
list_transform(range(1, g.n + 1), lambda j: 0.15::DOUBLE / g.n + 0.85::DOUBLE * (coalesce(list_sum(list_transform(range(1, len(g.src[j]) + 1), lambda m: it.score[g.src[j][m]] * g.wts[j][m])), 0) + coalesce(list_sum(list_transform(range(1, g.n + 1), lambda m: CASE WHEN g.linked[m] THEN 0 ELSE it.score[m] END)), 0) / g.n)) AS now
FROM it JOIN g ON g.row_id = it.row_id WHERE NOT it.done AND it.k < 200)),
fin AS (SELECT row_id, arg_max(score, k) AS score FROM it GROUP BY row_id), pr AS (SELECT fin.row_id, q - 1 AS i, fin.score[q] AS score FROM (SELECT row_id, score, unnest(range(1, len(score) + 1)) AS q FROM fin) fin)"""


@query(_RANKS + " SELECT row_id, i, round(score, 6) AS score FROM pr")
def pagerank_scores(spark: SparkSession, d: str) -> DataFrame:
    return select.ranks(table(spark, d, "processed"), "row_id").select("row_id", F.col("i").cast("bigint").alias("i"), F.round("score", 6).alias("score"))


def _textrank(n: int) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return spread(table(spark, d, "processed").select("row_id", "text")).select("row_id", select.textrank("text", n).alias("summary"))

    run.__name__ = f"textrank_{n}"
    top = f", k AS (SELECT row_id, i, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, i) AS place FROM pr) "
    top += f"SELECT s.row_id, coalesce((SELECT string_agg(s.s[k.i + 1], ' ' ORDER BY k.i) FROM k WHERE k.row_id = s.row_id AND (place <= {n} OR len(s.s) <= {n})), '') AS summary FROM s"
    query(_RANKS + top)(run)


for _n in (1, 2):
    _textrank(_n)


def _judged(source: str) -> str:
    """A source of (tok, r, r2) with ``sc``: ROUGE-1 + ROUGE-2 F1 of tok to 12 digits."""
    return (
        f"(SELECT *, round({S.f1('o1', 'len(tok)', 'len(r)')} + {S.f1('o2', 'len(b)', 'len(r2)')}, 12) AS sc FROM (SELECT *, {S.overlap('tok', 'r')} AS o1, {S.overlap('b', 'r2')} AS o2 "
        f"FROM (SELECT *, {S.ngrams('tok', 2)} AS b FROM ({source}))))"
    )


def _best(source: str) -> str:
    """The best candidate i of each row, of equal ones the first."""
    return f"(SELECT * FROM {_judged(source)} QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY sc DESC, i) = 1)"


# Three rounds, each over all sentences that are not chosen yet; a later round counts only where it is better.
_SECOND = "SELECT p.row_id, e.i, p.i AS c1, p.sc AS was, p.r, p.r2, CASE WHEN e.i < p.i THEN list_concat(e.tok, p.tok) ELSE list_concat(p.tok, e.tok) END AS tok FROM one p JOIN e ON e.row_id = p.row_id AND e.i <> p.i"
_THIRD = """SELECT p.row_id, e.i, p.a, p.z, p.sc AS was, t.r, t.r2, CASE WHEN e.i < p.a THEN list_concat(list_concat(e.tok, x.tok), y.tok) WHEN e.i < p.z THEN list_concat(list_concat(x.tok, e.tok), y.tok)
ELSE list_concat(list_concat(x.tok, y.tok), e.tok) END AS tok FROM pair p JOIN t ON t.row_id = p.row_id JOIN e x ON x.row_id = p.row_id AND x.i = p.a JOIN e y ON y.row_id = p.row_id AND y.i = p.z
JOIN e ON e.row_id = p.row_id AND e.i <> p.a AND e.i <> p.z"""
_ORACLE = f"""WITH s AS MATERIALIZED (SELECT row_id, {S.sentences('text')} AS s, {S.tokens('summary')} AS r FROM processed), t AS MATERIALIZED (SELECT *, {S.ngrams('r', 2)} AS r2 FROM s),
e AS MATERIALIZED (SELECT row_id, i, {S.tokens('s[i]')} AS tok FROM (SELECT row_id, s, unnest(range(1, len(s) + 1)) AS i FROM t)),
one AS MATERIALIZED {_best('SELECT e.*, t.r, t.r2 FROM e JOIN t ON t.row_id = e.row_id')}, two AS MATERIALIZED {_best(_SECOND)},
pair AS MATERIALIZED (SELECT row_id, least(i, c1) AS a, greatest(i, c1) AS z, sc FROM two WHERE sc > was), three AS MATERIALIZED {_best(_THIRD)},
chosen AS (SELECT o.row_id, o.i FROM one o UNION SELECT q.row_id, unnest([q.a, q.z]) FROM pair q UNION SELECT h.row_id, h.i FROM three h WHERE h.sc > h.was)
SELECT t.row_id, coalesce(string_agg(t.s[c.i], ' ' ORDER BY c.i), '') AS summary FROM t LEFT JOIN chosen c ON c.row_id = t.row_id GROUP BY t.row_id"""


@query(_ORACLE)
def oracle_3(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "processed").select("row_id", "text", "summary")).select("row_id", select.oracle("text", "summary", 3).alias("summary"))


# --- suite ----------------------------------------------------------------------------------------------------------------


_SYSTEMS = ("lead_1", "lead_2", "lead_3", "textrank_1", "oracle")


def _suite(rows: DataFrame) -> DataFrame:
    """The five systems over (id, pos, text, summary) and their scores by row. Everything about an article is made once, beside its
    systems; only the scores are stacked as rows, so no article is copied."""
    composed = spread(rows).select("id", "pos", T.nfc(F.coalesce("text", F.lit(""))).alias("nt"), T.nfc(F.coalesce("summary", F.lit(""))).alias("ns"))
    chosen = {**{f"lead_{n}": select.lead("nt", n) for n in (1, 2, 3)}, "textrank_1": select.textrank("nt", 1), "oracle": select.oracle("nt", "ns", 3)}
    made = composed.select("id", "pos", T.tokenize_composed("nt").alias("source"), T.tokenize_composed("ns").alias("r"), *(c.alias(s) for s, c in chosen.items()))
    tokens = made.select("id", "pos", "source", "r", N.ngrams("source", 2).alias("pairs"), T.numbers("source").alias("figures"), *(T.tokenize_composed(s).alias(s) for s in _SYSTEMS))
    scored = tokens.select("*", *(metrics.rouge(s, "r").alias(f"{s}_rouge") for s in _SYSTEMS))

    def scores(s: str):
        own = N.ngram_set(s, 2)
        novel = F.coalesce(F.try_divide(F.size(F.array_except(own, F.col("pairs"))), F.size(own)), F.lit(0.0))
        unsupported = F.size(F.array_except(T.numbers(s), F.col("figures"))) > 0
        return F.struct(F.lit(s).alias("system"), F.col(f"{s}_rouge").alias("r"), F.size(s).alias("words"), novel.alias("novel_bigram"), unsupported.alias("unsupported"))

    stacked = scored.select("id", "pos", F.explode(F.array(*(scores(s) for s in _SYSTEMS))).alias("x"))
    return stacked.select("x.system", "id", "pos", "x.r.*", "x.words", "x.novel_bigram", "x.unsupported")


def _articles(spark: SparkSession, d: str, split: str | None = None) -> DataFrame:
    rows = table(spark, d, "processed").select("row_id", "pos", "split", "text", "summary")
    return (rows.where(F.col("split") == split) if split else rows).select(F.col("row_id").alias("id"), "pos", "text", "summary")


@query()
def evaluate_systems(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.evaluated_with_intervals(_suite(_articles(spark, d)))
    intervals = {c for c in found.columns if c.endswith("_ci95")}
    rounded = (F.struct(*(F.round(f"{c}.{end}", 6).alias(end) for end in ("low", "high"))) if c in intervals else F.round(c, 6) for c in found.columns[2:])
    return found.select("system", "num_examples", *(r.alias(c) for r, c in zip(rounded, found.columns[2:], strict=True)))


_WORDS = f"SELECT system, id, pos, created_at, len({S.tokens('prediction')}) AS v FROM predictions"


@query(
    f"""WITH w AS ({_WORDS}), n AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY pos, created_at, id) - 1 AS i, count(*) OVER (PARTITION BY system) AS n FROM w),
d AS (SELECT system, n, r, (('0x' || substr(md5('0:' || r || ':' || i), 1, 8))::BIGINT) % n AS i FROM n, range(0, 200) x(r)),
m AS (SELECT d.system, d.r, sum(n.v) / any_value(d.n) AS m FROM d JOIN n ON n.system = d.system AND n.i = d.i GROUP BY ALL)
SELECT system, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m GROUP BY system"""
)
def bootstrap_ci_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "predictions").select("system", F.struct("pos", "created_at", "id").alias("key"), F.size(T.tokenize("prediction")).alias("v"))
    return metrics.bootstrap(rows, "v", resamples=200, order="key").select("system", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query()
def bootstrap_ci_numpy(spark: SparkSession, d: str) -> DataFrame:
    scores = metrics.scored(table(spark, d, "predictions"))
    return metrics.bootstrap_exact(scores).select("system", "metric", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT id, substring(text, 1, 400) AS text, reference, prediction FROM (SELECT q.id, q.prediction, q.reference, p.text, q.pos FROM predictions q JOIN (SELECT id, arg_min(text, row_id) AS text FROM processed WHERE split = 'test' GROUP BY id) p ON p.id = q.id WHERE q.system = 'lead_1' AND q.created_at = (SELECT min(z.created_at) FROM predictions z WHERE z.system = q.system AND z.id = q.id)) ORDER BY pos LIMIT 25")
def prediction_samples(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.jsonl import prediction_samples as samples

    first = table(spark, d, "processed").where("split = 'test'").groupBy("id").agg(F.min(F.struct("row_id", "text"))["text"].alias("text"))
    one = table(spark, d, "predictions").where("system = 'lead_1'").groupBy("id").agg(F.min(F.struct("created_at", "pos", "prediction", "reference")).alias("x")).select("id", "x.*")
    return samples(one.join(first, "id"))


# --- sequences ------------------------------------------------------------------------------------------------------------

_IDS = f"list_transform({S.ws_words('text')}, lambda w: (100 + length(w))::INTEGER)"
_ENC = "list_concat(list_slice(ids, 1, 62), [64001, 64006])"


def _encoded(spark: SparkSession, d: str, source: int = 64, target: int = 16) -> DataFrame:
    rows = table(spark, d, "processed").select("row_id", "split", "pos", sequence.hashed_ids("text").alias("a"), sequence.hashed_ids("summary").alias("b"))
    return sequence.preprocess(rows, SPECIAL, "a", "b", source, target)


@query(f"WITH i AS (SELECT row_id, {_IDS} AS ids FROM processed) SELECT row_id, array_to_string({_ENC}, ' ') AS input_ids FROM i")
def encode_suffix(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("row_id", F.array_join("input_ids", " ").alias("input_ids"))


@query(f"WITH i AS (SELECT row_id, {_IDS} AS ids, {_IDS.replace('text', 'summary')} AS lab FROM processed) SELECT row_id, len({_ENC}) AS mask, array_to_string(list_concat(list_slice(lab, 1, 14), [64001, 64006]), ' ') AS labels FROM i")
def preprocess_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d).select("row_id", F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("mask"), F.array_join("labels", " ").alias("labels"))


_BATCH = f"""WITH i AS (SELECT row_id, split, pos, {_ENC} AS e FROM (SELECT row_id, split, pos, {_IDS} AS ids FROM processed)), c AS (SELECT *, (row_number() OVER (PARTITION BY split ORDER BY pos) - 1) // 64 AS chunk FROM i),
p AS (SELECT *, row_number() OVER (PARTITION BY split, chunk ORDER BY len(e) DESC, pos) - 1 AS place FROM c), b AS (SELECT *, place // 8 AS batch FROM p)"""


def _batched(spark: SparkSession, d: str) -> DataFrame:
    rows = _encoded(spark, d).withColumn("n", F.size("input_ids"))
    return sequence.batches(rows, "n")


@query(_BATCH + " SELECT row_id, chunk, place, batch FROM b")
def length_sorted_batches(spark: SparkSession, d: str) -> DataFrame:
    return _batched(spark, d).select("row_id", "chunk", F.col("place").cast("bigint").alias("place"), "batch")


@query(_BATCH + " SELECT row_id, max(len(e)) OVER (PARTITION BY split, chunk, batch) AS width, max(len(e)) OVER (PARTITION BY split, chunk, batch) - len(e) AS pads FROM b")
def pad_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _batched(spark, d).withColumn("b", F.struct("split", "chunk", "batch"))
    filled = sequence.padded(rows, "b", "input_ids", SPECIAL.pad)
    return filled.select("row_id", F.size("input_ids").cast("bigint").alias("width"), F.size(F.filter("input_ids", lambda x: x == SPECIAL.pad)).cast("bigint").alias("pads"))


# The four above at the lengths of generation, 512 and 80.
_WHOLE = sequence.GenerationSettings()
_ENC_WHOLE = f"list_concat(list_slice(ids, 1, {_WHOLE.max_source_length - 2}), [64001, 64006])"


def _encoded_whole(spark: SparkSession, d: str) -> DataFrame:
    return _encoded(spark, d, _WHOLE.max_source_length, _WHOLE.max_target_length)


@query(SQL["encode_suffix"].replace(_ENC, _ENC_WHOLE))
def encode_suffix_512(spark: SparkSession, d: str) -> DataFrame:
    return _encoded_whole(spark, d).select("row_id", F.array_join("input_ids", " ").alias("input_ids"))


@query(SQL["preprocess_pairs"].replace(_ENC, _ENC_WHOLE).replace("list_slice(lab, 1, 14)", f"list_slice(lab, 1, {_WHOLE.max_target_length - 2})"))
def preprocess_pairs_512(spark: SparkSession, d: str) -> DataFrame:
    return _encoded_whole(spark, d).select("row_id", F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).cast("bigint").alias("mask"), F.array_join("labels", " ").alias("labels"))


def _batched_whole(spark: SparkSession, d: str) -> DataFrame:
    return sequence.batches(_encoded_whole(spark, d).withColumn("n", F.size("input_ids")), "n")


@query(SQL["length_sorted_batches"].replace(_ENC, _ENC_WHOLE))
def length_sorted_batches_512(spark: SparkSession, d: str) -> DataFrame:
    return _batched_whole(spark, d).select("row_id", "chunk", F.col("place").cast("bigint").alias("place"), "batch")


@query(SQL["pad_batches"].replace(_ENC, _ENC_WHOLE))
def pad_batches_512(spark: SparkSession, d: str) -> DataFrame:
    filled = sequence.padded(_batched_whole(spark, d).withColumn("b", F.struct("split", "chunk", "batch")), "b", "input_ids", SPECIAL.pad)
    return filled.select("row_id", F.size("input_ids").cast("bigint").alias("width"), F.size(F.filter("input_ids", lambda x: x == SPECIAL.pad)).cast("bigint").alias("pads"))


@query(f"WITH i AS (SELECT row_id, {_IDS} AS ids FROM processed) SELECT row_id, array_to_string(list_transform(list_slice(ids, 1, 8), lambda x: CASE WHEN x % 2 = 0 THEN 0 ELSE x END), ' ') AS labels FROM i")
def label_mask(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "processed").select("row_id", F.slice(sequence.hashed_ids("text"), 1, 8).alias("ids"))
    masked = F.transform("ids", lambda x: F.when(x % 2 == 0, F.lit(sequence.IGNORED)).otherwise(x))
    return ids.select("row_id", F.array_join(sequence.unmask(masked, SPECIAL.pad), " ").alias("labels"))


@query(f"WITH i AS (SELECT row_id, {_IDS} AS ids FROM processed) SELECT row_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x % 2 = 0 THEN 0 ELSE x END), ' ') AS labels FROM i")
def label_mask_whole(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "processed").select("row_id", sequence.hashed_ids("text").alias("ids"))
    masked = F.transform("ids", lambda x: F.when(x % 2 == 0, F.lit(sequence.IGNORED)).otherwise(x))
    return ids.select("row_id", F.array_join(sequence.unmask(masked, SPECIAL.pad), " ").alias("labels"))


# --- serving --------------------------------------------------------------------------------------------------------------

_BLANK = f"len(list_filter(texts, lambda t: coalesce(regexp_replace(t, '[{S.WS}]+', '', 'g'), '') = '')) > 0"
_VALID = f"""CASE WHEN texts IS NULL OR len(texts) < 1 OR len(texts) > 32 THEN 'texts: 1 to 32' WHEN {_BLANK} THEN 'texts: blank' WHEN len(list_filter(texts, lambda t: length(t) > 20000)) > 0 THEN 'texts: too long'
WHEN method IS NOT NULL AND method NOT IN ('model', 'lead', 'textrank') THEN 'method' WHEN num_sentences IS NOT NULL AND num_sentences NOT BETWEEN 1 AND 10 THEN 'num_sentences: 1 to 10' END"""


@query(f"SELECT request_id, {_VALID} AS problem FROM requests")
def request_validation(spark: SparkSession, d: str) -> DataFrame:
    return serve.validated(table(spark, d, "requests")).select("request_id", "problem")


def _any_method(spark: SparkSession, d: str) -> DataFrame:
    """Requests as the serving methods see them: spellings of methods that are not served are left to the caller, here none is asked for."""
    return table(spark, d, "requests").select("request_id", "texts", F.lit(None).cast("string").alias("method"), "num_sentences")


@query(f"""WITH r AS (SELECT request_id, texts, NULL::VARCHAR AS method, num_sentences FROM requests), v AS (SELECT *, {_VALID} AS problem FROM r)
SELECT request_id, array_to_string(list_transform(texts, lambda x: array_to_string(list_slice({S.sentences('x')}, 1, coalesce(num_sentences, 1)), ' ')), chr(10)) AS summaries FROM v WHERE problem IS NULL""")
def summarize_batch_lead(spark: SparkSession, d: str) -> DataFrame:
    return serve.summarize_batch(_any_method(spark, d), "lead").select("request_id", F.array_join("summaries", "\n").alias("summaries"))


_ASKED = f"""WITH RECURSIVE r AS (SELECT request_id, texts, NULL::VARCHAR AS method, num_sentences FROM requests), v AS (SELECT *, {_VALID} AS problem FROM r),
q AS MATERIALIZED (SELECT request_id * 64 + nth AS row_id, request_id, nth, k, texts[nth] AS text FROM (SELECT request_id, texts, coalesce(num_sentences, 1) AS k, unnest(range(1, len(texts) + 1)) AS nth FROM v WHERE problem IS NULL)), """
_TOP = """, ranked AS (SELECT row_id, i, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 9) DESC, i) AS place FROM pr),
y AS (SELECT q.request_id, q.nth, coalesce((SELECT string_agg(s.s[z.i + 1], ' ' ORDER BY z.i) FROM ranked z WHERE z.row_id = q.row_id AND (z.place <= q.k OR len(s.s) <= q.k)), '') AS summary FROM q JOIN s ON s.row_id = q.row_id)
SELECT request_id, array_to_string(list(summary ORDER BY nth), chr(10)) AS summaries FROM y GROUP BY request_id"""


@query(_ASKED + _RANKS.removeprefix("WITH RECURSIVE ").replace("FROM processed", "FROM q") + _TOP)
def summarize_batch_textrank(spark: SparkSession, d: str) -> DataFrame:
    return serve.summarize_batch(_any_method(spark, d), "textrank").select("request_id", F.array_join("summaries", "\n").alias("summaries"))


@query(f"""WITH r AS (SELECT request_id, texts, NULL::VARCHAR AS method, num_sentences FROM requests), v AS (SELECT *, {_VALID} AS problem FROM r)
SELECT request_id, array_to_string(list_transform(texts, lambda x: array_to_string(list_slice({S.ws_words(S.clean('x'))}, 1, 8), ' ')), chr(10)) AS summaries FROM v WHERE problem IS NULL""")
def summarize_batch_model(spark: SparkSession, d: str) -> DataFrame:
    return serve.summarize_batch(_any_method(spark, d), "model", sequence.FirstWords).select("request_id", F.array_join("summaries", "\n").alias("summaries"))


# --- flagship -------------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Clean, filter and deduplicate the raw examples, take the two leading sentences, and score them by split."""
    rows = corpus.first_usable(_raw(spark, d), order="raw_id").select("split", "summary", select.lead("text", 2).alias("prediction"))
    scores = metrics.scored(rows, "prediction", "summary")
    return scores.groupBy("split").agg(F.count("*").alias("examples"), F.round(F.avg("rouge1"), 6).alias("rouge1"), F.round(F.avg("rouge2"), 6).alias("rouge2"), F.round(F.avg("rougeL"), 6).alias("rougeL"))
