"""Evaluation: ROUGE per row and by group, novelty, unsupported numbers, bootstrap intervals."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions.ngrams import novel_ngram_ratio
from ..runtime import cut, numbered

#: Draws of the bootstrap held at once; bounds memory, changes nothing else.
DRAWS = 2_000_000


def subsequence_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit vectors: one integer operation a token of ``a``, so long sides stay cheap."""
    at: dict[str, int] = {}
    for j, token in enumerate(b):
        at[token] = at.get(token, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for token in a:
        hit = row & at.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _overlap_f1(p: list, r: list) -> float:
    wanted = Counter(r)
    both = sum(min(n, wanted[g]) for g, n in Counter(p).items() if g in wanted)
    return 2 * both / (len(p) + len(r)) if both else 0.0


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("rouge1", "rouge2", "rougeL")]))
def _rouge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for predictions, references in batches:
        rows = []
        for p, r in zip(predictions, references, strict=True):
            p, r = list(p if p is not None else ()), list(r if r is not None else ())
            long = subsequence_length(p, r)
            rows.append((_overlap_f1(p, r), _overlap_f1(list(zip(p, p[1:])), list(zip(r, r[1:]))), 2 * long / (len(p) + len(r)) if long else 0.0))
        yield pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL"])


def rouge(prediction_tokens: Column | str, reference_tokens: Column | str) -> Column:
    """STRUCT<rouge1, rouge2, rougeL> F1 of token lists; an empty side scores 0. Whole lists, of any length."""
    return _rouge(prediction_tokens, reference_tokens)


def checked_pairs(predictions: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """The 1:1 join of predictions and references; a row that the other side lacks is an error when it is reached."""
    p, r = predictions.withColumn("_p", F.lit(1)), references.withColumn("_r", F.lit(1))
    joined = p.join(r, key, "full_outer")
    whole = F.col("_p").isNotNull() & F.col("_r").isNotNull()
    return joined.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("prediction and reference differ at "), F.col(key).cast("string"))))).drop("_p", "_r")


def scored(df: DataFrame, prediction: str = "prediction", reference: str = "reference", source: str | None = None) -> DataFrame:
    """Per-row scores: rouge1, rouge2, rougeL, words, and with a source novel_bigram and unsupported. Tokens are made once; nulls
    count as empty."""
    columns = [prediction, reference, *([source] if source else [])]
    out = df
    for c in columns:
        out = out.withColumn(f"_{c}_tokens", T.tokenize(c))
    p, r = f"_{prediction}_tokens", f"_{reference}_tokens"
    out = out.withColumn("_rouge", rouge(p, r)).select("*", "_rouge.*", F.size(p).alias("words"))
    if source:
        s = f"_{source}_tokens"
        out = out.withColumn("novel_bigram", novel_ngram_ratio(p, s, 2)).withColumn("unsupported", T.has_unsupported_number(p, s))
    return out.drop("_rouge", *(f"_{c}_tokens" for c in columns))


def evaluated(scores: DataFrame, by: str = "system") -> DataFrame:
    """Means of per-row scores by system. A system without rows has no group; ``evaluated_whole`` gives zeros for no rows at all."""
    extra = [F.avg("novel_bigram").alias("novel_bigram_ratio"), F.avg(F.col("unsupported").cast("int")).alias("unsupported_number_rate")] if "unsupported" in scores.columns else []
    return scores.groupBy(by).agg(
        F.count("*").alias("num_examples"), *(F.avg(c).alias(f"{c}_mean") for c in ("rouge1", "rouge2", "rougeL")), F.avg("words").alias("avg_summary_words"), *extra
    )


def evaluated_whole(scores: DataFrame) -> DataFrame:
    """One row of means over all rows; of no rows the ROUGE means and the words are 0, the diagnostics null."""
    found = evaluated(scores.withColumn("_all", F.lit(0)), "_all").drop("_all")
    one = scores.sparkSession.range(1).select(F.lit(0).alias("_all"))
    zero = {"num_examples", "avg_summary_words", *(f"{c}_mean" for c in ("rouge1", "rouge2", "rougeL"))}
    joined = one.join(found.withColumn("_all", F.lit(0)), "_all", "left")
    return joined.select(*((F.coalesce(c, F.lit(0)) if c in zero else F.col(c)).alias(c) for c in found.columns))


def bootstrap(scores: DataFrame, value: str, by: str = "system", resamples: int = 1000, alpha: float = 0.05, seed: int = 0, order: str = "pos") -> DataFrame:
    """(by, low, high): the distributed bootstrap. Draw i of resample r is the row number md5(seed, r, i) mod n of its group, so a run
    repeats exactly; each row meets the draws that name it by an equi-join, and only sums are shuffled."""
    n = scores.groupBy(by).agg(F.count("*").alias("n"))
    rows = numbered(scores.select(by, order, value), by, order).select(by, "i", value)
    draws = rows.join(n, by).select(by, "n", "i", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r"))
    picked = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "r", "i")), 1, 8), 16, 10).cast("bigint") % F.col("n")
    sums = draws.select(by, "n", "r", picked.alias("i")).groupBy(by, "n", "r", "i").agg(F.count("*").alias("times"))
    means = sums.join(rows, [by, "i"]).groupBy(by, "n", "r").agg((F.sum(F.col("times") * F.col(value)) / F.col("n")).alias("m"))
    return means.groupBy(by).agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))


def _resampled(values: np.ndarray, resamples: int, seed: int) -> Iterator[float]:
    """The mean of each resample, in blocks of DRAWS draws; draws in blocks are those of one call of the generator."""
    source, rows, left = np.random.default_rng(seed), max(1, DRAWS // len(values)), resamples
    while left > 0:
        drawn = source.integers(0, len(values), size=(min(rows, left), len(values)))
        yield from values.take(drawn).mean(axis=1)
        left -= len(drawn)


def bootstrap_interval(values: np.ndarray, resamples: int = 1000, alpha: float = 0.05, seed: int = 0) -> tuple[float, float]:
    """The interval as numpy's default generator draws it; (0, 0) without values."""
    if not len(values):
        return 0.0, 0.0
    means = np.fromiter(_resampled(np.asarray(values, float), resamples, seed), float, resamples)
    return tuple(float(np.quantile(means, side)) for side in (alpha / 2, 1 - alpha / 2))


def bootstrap_exact(scores: DataFrame, values: tuple[str, ...] = ("rouge1", "rouge2", "rougeL"), by: str = "system", order: str = "pos", resamples: int = 1000) -> DataFrame:
    """(by, metric, low, high) with numpy's draws. A system's scores (8 bytes a row) meet in one task; use ``bootstrap`` beyond some million rows."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        return pd.DataFrame([(rows[by].iloc[0], v, *bootstrap_interval(rows[v].to_numpy(), resamples)) for v in values], columns=[by, "metric", "low", "high"])

    return scores.select(by, order, *values).groupBy(by).applyInPandas(one, f"`{by}` string, metric string, low double, high double")


def evaluated_with_intervals(scores: DataFrame, by: str = "system", order: str = "id", resamples: int = 1000) -> DataFrame:
    """``evaluated`` with rouge1_ci95, rouge2_ci95 and rougeL_ci95 (STRUCT<low, high>) of ``bootstrap_exact``. The scores are cut, as they
    are read twice. ``order`` is unique in a group."""
    scores, names = cut(scores), ("rouge1", "rouge2", "rougeL")
    found = bootstrap_exact(scores, names, by, order, resamples)
    intervals = found.groupBy(by).agg(*(F.max(F.when(F.col("metric") == c, F.struct("low", "high"))).alias(f"{c}_ci95") for c in names))
    return evaluated(scores, by).join(intervals, by)


def timed(action: Callable[[], object], examples: int) -> dict:
    """The result of an action, its seconds and its examples a second."""
    began = time.perf_counter()
    result = action()
    seconds = time.perf_counter() - began
    return {"result": result, "seconds": round(seconds, 1), "examples_per_second": round(examples / seconds, 2) if seconds else None}


def bertscore(df: DataFrame, scorer, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """Rows with precision, recall and f1 of a pluggable scorer ``(predictions, references) -> [(p, r, f), ...]``; the model is the caller's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = scorer(batch[prediction].fillna("").tolist(), batch[reference].fillna("").tolist())
            yield batch.assign(**{c: [g[k] for g in got] for k, c in enumerate(("bert_precision", "bert_recall", "bert_f1"))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, bert_precision double, bert_recall double, bert_f1 double")
