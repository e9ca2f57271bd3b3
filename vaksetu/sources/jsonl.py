"""Sources and sinks: JSON lines with fixed schemas, whole-text files, JSON result documents."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import numbered

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "summary")])
#: Split -> file of raw examples; ``files`` gives those of a corpus whose names begin with its language.
FILES = {"train": "train.jsonl", "validation": "val.jsonl", "test": "test.jsonl"}


def files(prefix: str = "") -> dict[str, str]:
    return {split: f"{prefix}{name}" for split, name in FILES.items()}


def _with_place(rows: DataFrame) -> DataFrame:
    """rows with ``_at``, which orders them as they stand in their files: the file, the block of it, and the row inside the block."""
    return rows.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("_at"))


def whole(limit: int | None) -> int | None:
    """On command lines 0 stands for the whole split."""
    return limit or None


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """One object a line, extra keys ignored, a malformed line is an error. ``.bz2`` and ``.gz`` files are read as they are."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_raw_split(spark: SparkSession, folder: str, split: str, names: dict[str, str] = FILES) -> DataFrame:
    """A raw split with its name and the order of its lines (pos, from 0), numbered by ranges of places, without a task for all rows."""
    rows = _with_place(read_jsonl(spark, f"{folder}/{names[split]}")).withColumn("split", F.lit(split))
    return numbered(rows, "split", "_at", "pos").select("id", "text", "summary", "pos", "split")


def write_splits(df: DataFrame, path: str, order: str = "pos") -> None:
    """The cleaned examples, a folder for each split, three keys a line, characters unescaped. Where df has the order column, files and the
    lines in them follow it: rows are range-partitioned and sorted."""
    out = df.repartitionByRange("split", order).sortWithinPartitions("split", order) if order in df.columns else df
    out.select("split", "id", "text", "summary").write.mode("overwrite").partitionBy("split").json(path)


def read_processed(spark: SparkSession, path: str, split: str, most: int | None = None) -> DataFrame:
    """The first ``most`` rows of a split as they stand in its files (None: all, 0: none). A missing folder is an error that says what to run."""
    source = Path(path) / f"split={split}"
    if "://" not in path and not source.exists():
        raise FileNotFoundError(f"{source} not found: build the corpus first")
    rows = spark.read.schema(RAW).json(f"{path}/split={split}")
    if most is not None:
        rows = _with_place(rows).orderBy("_at").limit(most).drop("_at")
    return rows.withColumn("split", F.lit(split))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(text): a whole file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def literal_text(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(text,)], "text string")


def write_result(result: dict | DataFrame, path: str) -> None:
    """A small result as an indented JSON document (rows of a DataFrame of results become a list)."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    content = result if isinstance(result, dict) else [r.asDict(recursive=True) for r in result.collect()]
    target.write_text(json.dumps(content, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def prediction_samples(df: DataFrame, n: int = 25, characters: int = 400) -> DataFrame:
    """The first predictions by position, texts cut to a number of code points."""
    return df.orderBy("pos").limit(n).select("id", F.substring("text", 1, characters).alias("text"), "reference", "prediction")
