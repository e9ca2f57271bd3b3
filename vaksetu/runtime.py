"""Session, shared storage and lineage helpers used by every operator."""

from __future__ import annotations

import io
import os
import random
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast, after it has been counted. Beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark. On a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("vaksetu")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: what ``spark.checkpoint.dir`` names. Only where it is unset
    (single-machine tests) a local folder is made."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="vaksetu-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; Spark deletes it once unreachable."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small file of one row group is read by one task, which leaves Python
    stages to one core. Inputs with enough partitions, as large ones have, are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def numbered(df: DataFrame, by: str, order: str, name: str = "i") -> DataFrame:
    """df with the place of each row among those of its ``by``, from 0, by ``order`` (unique in its group). No group is one task: rows are
    range-partitioned, numbered inside their partition, and offset by the counts of the partitions before."""
    ranged = cut(df.repartitionByRange(by, order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(by, "_part").agg(F.count("*").alias("_n"))  # about a row a partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(by, "_part", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(by, "_part").orderBy(order)) - 1
    return ranged.withColumn("_place", place).join(offsets, [by, "_part"]).withColumn(name, F.col("_place") + F.col("_before")).drop("_part", "_place", "_before")


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once a session, for clusters whose executors do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_vaksetu_shipped", False):
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(here.rglob("*.py")):
            archive.write(path, path.relative_to(here.parent))
    # the driver's own scratch folder: Spark serves the file to the executors from there
    target = Path(tempfile.mkdtemp(prefix="vaksetu-code-")) / "vaksetu.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    context._vaksetu_shipped = True


def set_seed(seed: int = 42) -> None:
    """Seeds Python and numpy on the driver; operators take their seeds as arguments."""
    import numpy as np

    random.seed(seed)
    np.random.seed(seed)
