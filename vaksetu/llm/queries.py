"""The queries of the eight training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread, table
from . import defects, lookalike, neardup, overlap, packing, quality, sentences, sql, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The whole of processed, the columns that a query needs."""
    return spread(table(spark, sf_dir, "processed").select(*columns))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of rows with the same or near the same text."""
    return neardup.row_pairs(*neardup.near_links(_rows(spark, sf_dir, "row_id", "text")), "row_id_a", "row_id_b")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its class of copies, its number of links and its group."""
    return neardup.article_groups(_rows(spark, sf_dir, "row_id", "text"))


def _qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "row_id", "text")
    common = quality.common_words(table(spark, sf_dir, "common_words"))
    profiles = quality.labelled_profiles(rows, table(spark, sf_dir, "quality_labels"), common)
    return quality.statistics(rows, profiles, common)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that are no prose, with their kind."""
    return _qualities(spark, sf_dir).where("kind <> 'prose'").select("row_id", "kind")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of every row alone, rounded."""
    found = _qualities(spark, sf_dir)
    return found.select("row_id", "word_count", *(F.round(c, 6).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuated_lines", "common_share")))


def p2_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures and the kind of every row."""
    return _qualities(spark, sf_dir)


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "row_id", "text", "summary")
    common = quality.common_words(table(spark, sf_dir, "common_words"))
    profiles = quality.labelled_profiles(rows, table(spark, sf_dir, "quality_labels"), common)
    return defects.judged(rows, profiles, common)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows with a defective summary and the first defect that holds."""
    return _judged(spark, sf_dir).where(F.size("defects") > 0).select("row_id", F.col("defects")[0].alias("defect"))


def p3_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All defects of every defective row, with their posteriors."""
    found = _judged(spark, sf_dir).where(F.size("defects") > 0)
    pairs = F.filter(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(d).alias("posterior")) for d in defects.DEFECTS)), lambda x: F.array_contains(F.col("defects"), x["defect"]))
    return found.select("row_id", F.explode(pairs).alias("x")).select("row_id", "x.defect", F.round("x.posterior", 6).alias("posterior"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the rows of sentence_rows, with statistics learned from all rows."""
    rows = _rows(spark, sf_dir, "row_id", "text")
    wanted = table(spark, sf_dir, "sentence_rows").select("row_id").distinct()
    return sentences.split_sentences(rows.join(wanted, "row_id", "left_semi"), rows)


def p4_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The abbreviations, sentence starters and collocations of each language."""
    return sentences.model_rows(_rows(spark, sf_dir, "row_id", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a training and an evaluation row that overlap."""
    pairs = overlap.overlaps(_rows(spark, sf_dir, "row_id", "id", "text", "summary", "split"))
    return pairs.select(F.least("t", "e").alias("row_id_a"), F.greatest("t", "e").alias("row_id_b"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps by evaluation split and source."""
    rows = _rows(spark, sf_dir, "row_id", "id", "text", "summary", "split", "source")
    return overlap.overlap_counts(overlap.overlaps(rows), rows)


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of each evaluation row training texts cover."""
    return overlap.coverage(_rows(spark, sf_dir, "row_id", "text", "split"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document."""
    return tokens.encoded(_documents(spark, sf_dir))


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its number of ids and whether decoding gives its text again."""
    docs = _documents(spark, sf_dir)
    ids = tokens.encoded(docs)
    back = ids.select("doc_id", F.size("ids").alias("n_tokens"), tokens.decoded("ids").alias("back"))
    return back.join(docs, "doc_id").select("doc_id", "n_tokens", (F.col("back") == F.coalesce("text", F.lit(""))).alias("same"))


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pack of every document (or piece of one) for each container."""
    sizes = tokens.token_counts(_documents(spark, sf_dir))
    return packing.packed(sizes, table(spark, sf_dir, "container_sizes"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the packs of each container are."""
    return packing.fill_report(p7_packs(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of different strings that look the same."""
    return lookalike.lookalike_pairs(_documents(spark, sf_dir))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent form of every document."""
    forms = lookalike.consistent(_documents(spark, sf_dir))
    return forms.select("doc_id", "form", F.hex("skeleton_key").alias("skeleton_key"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (p1_found, p1_groups, p2_found, p2_counts, p2_statistics, p3_found, p3_labels, p4_found, p4_learned, p5_found, p5_counts, p5_coverage, p6_ids, p6_round_trip, p7_packs, p7_fill, p8_found, p8_forms)}

SQL: dict[str, str] = {"p1_found": sql.P1_FOUND, "p1_groups": sql.P1_GROUPS, "p2_counts": sql.P2_COUNTS, "p5_found": sql.P5_FOUND, "p5_counts": sql.P5_COUNTS, "p8_found": sql.P8_FOUND}
