"""Corpus building: clean, filter, first-wins deduplication, caps, counts and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def cleaned(raw: DataFrame) -> DataFrame:
    """Cleaned text and summary, their tokens, and whether the pair is usable. Both columns share one Arrow pass."""
    out = raw.withColumn("text", T.clean_text("text")).withColumn("summary", T.clean_text("summary"))
    out = out.withColumn("text_tokens", T.tokenize_composed("text")).withColumn("summary_tokens", T.tokenize_composed("summary"))
    return out.withColumn("usable", T.is_usable("text", "summary", "text_tokens", "summary_tokens"))


def first_usable(df: DataFrame, key: tuple[str, ...] = ("split", "id"), order: str = "pos") -> DataFrame:
    """The first usable row of each key: unusable rows do not block later usable ones. Each task keeps the first row of a key before the shuffle
    (WindowGroupLimit), so a frequent key is no large group anywhere and whole rows are in no aggregate; ties of the order go to the
    least of the whole row."""
    first = Window.partitionBy(*key).orderBy(order, *(c for c in df.columns if c not in (*key, order, "usable")))
    return df.where("usable").withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def capped(df: DataFrame, cap: int | None, order: str = "pos") -> DataFrame:
    """The first rows of each split; None keeps all. Ranks are limited before the shuffle (WindowGroupLimit)."""
    if cap is None:
        return df
    rank = F.row_number().over(Window.partitionBy("split").orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= cap).drop("_rank")


def limited(df: DataFrame, n: int | None, offset: int = 0, order: str = "pos") -> DataFrame:
    """Rows [offset, offset + n) by order; n of None or 0 is no limit when there is an offset to skip."""
    out = df.orderBy(order)
    if offset:
        out = out.offset(offset)
    return out if n is None or (offset and not n) else out.limit(n)


def kept_and_dropped(cleaned_rows: DataFrame) -> DataFrame:
    """(split, kept, dropped): rows that cleaning keeps, and those that are unusable or repeat an id."""
    ids = cleaned_rows.groupBy("split", "id").agg(F.count("*").alias("n"), F.max(F.col("usable").cast("int")).alias("kept"))
    return ids.groupBy("split").agg(F.sum("kept").cast("bigint").alias("kept"), (F.sum("n") - F.sum("kept")).cast("bigint").alias("dropped"))


def text_sizes(df: DataFrame) -> DataFrame:
    """Words, sentences and novelty of each pair."""
    from ..functions.ngrams import novel_ngram_ratio

    composed = df.withColumn("_t", T.nfc(F.coalesce("text", F.lit("")))).withColumn("_s", T.nfc(F.coalesce("summary", F.lit(""))))
    tokens = composed.withColumn("_tt", T.tokenize_composed("_t")).withColumn("_st", T.tokenize_composed("_s"))
    return tokens.select(
        *df.columns,
        F.size("_tt").alias("article_words"),
        F.size(T.split_sentences("text")).alias("article_sentences"),
        F.size("_st").alias("summary_words"),
        (F.size("_tt") / F.greatest(F.size("_st"), F.lit(1))).alias("compression"),
        novel_ngram_ratio("_st", "_tt", 1).alias("novel_unigram"),
        novel_ngram_ratio("_st", "_tt", 2).alias("novel_bigram"),
    )


def split_stats(df: DataFrame, by: str = "split") -> DataFrame:
    """Ten statistics of each split, percentiles with linear interpolation."""
    sizes = text_sizes(df)
    return sizes.groupBy(by).agg(
        F.count("*").alias("examples"),
        F.avg("article_words").alias("article_words_mean"),
        F.percentile("article_words", F.lit(0.5)).alias("article_words_p50"),
        F.percentile("article_words", F.lit(0.95)).alias("article_words_p95"),
        F.avg("article_sentences").alias("article_sentences_mean"),
        F.avg("summary_words").alias("summary_words_mean"),
        F.percentile("summary_words", F.lit(0.95)).alias("summary_words_p95"),
        F.avg("compression").alias("compression_ratio_mean"),
        F.avg("novel_unigram").alias("novel_unigram_ratio"),
        F.avg("novel_bigram").alias("novel_bigram_ratio"),
    )
