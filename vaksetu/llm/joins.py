"""Joins whose keys may be so frequent that one holds a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: A key with at least this share of all rows asked for is hot: there are at most 1 / HOT_SHARE of them, so a table of them is broadcast safely.
HOT_SHARE = 0.001
#: Rows of a key that one part of it has where its rows meet those of another side.
PART_ROWS = 2_000


def looked_up(df: DataFrame, keys: tuple[str, ...], table: DataFrame, id_col: str) -> DataFrame:
    """df with ``{column}_{key}`` of table (h, columns..., unique by h) for each of the keys, columns of the table's type of h; null where the
    table lacks a key.

    Keys are counted (each task sums up first) and only what is asked for stays in the table. Hot keys meet a broadcast of at most
    ``1 / HOT_SHARE`` rows; all others shuffle. Rows without a key, or with a hot one, are spread by their id in that shuffle, so no
    task has more than its share. df and table are read several times: cut them."""
    asked = df.select(F.explode(F.array(*keys)).alias("h")).where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("_n"))
    found = cut(table.join(asked, "h"))
    least = F.lit(HOT_SHARE * (found.agg(F.sum("_n").alias("n")).first()["n"] or 0))
    columns = [c for c in table.columns if c != "h"]
    hot, cold = found.where(F.col("_n") >= least).drop("_n"), found.where(F.col("_n") < least).drop("_n")
    out = df
    for key in keys:
        one = hot.select(F.col("h").alias(key), F.struct(*columns).alias("_hot"))
        two = cold.select(F.col("h").alias("_to"), F.struct(*columns).alias("_cold"), F.lit(0).cast("bigint").alias("_spread"))
        out = out.join(F.broadcast(one), key, "left")
        seeks = F.col(key).isNotNull() & F.col("_hot").isNull()
        # what seeks nothing more goes anywhere: another number than 0 meets no row of the table
        out = out.withColumn("_to", F.when(seeks, F.col(key))).withColumn("_spread", F.when(seeks, F.lit(0)).otherwise(F.xxhash64(id_col).bitwiseOR(F.lit(1))))
        out = out.join(two, [out["_to"].eqNullSafe(two["_to"]), out["_spread"] == two["_spread"]], "left").drop("_to", "_spread")
        got = F.when(seeks, F.col("_cold")).otherwise(F.col("_hot"))
        out = out.select(*(c for c in out.columns if c not in ("_hot", "_cold")), *(got[c].alias(f"{c}_{key}") for c in columns))
    return out


def met(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """The inner join of two sides on a key. Where a key has more than PART_ROWS rows on the left they are spread over parts, and the rows of
    the right go to each part, so that no task has all rows of a frequent key. Both sides are read several times: cut them."""
    big = cut(left.groupBy(F.col(key).alias("h")).agg(F.ceil(F.count("*") / PART_ROWS).alias("parts")).where("parts > 1"))
    if big.isEmpty():
        return left.join(right, key)
    name = f"parts_{key}"
    spread = looked_up(left, (key,), big, left_id).withColumn("_part", F.pmod(F.xxhash64(left_id), F.coalesce(name, F.lit(1)))).drop(name)
    each = looked_up(right, (key,), big, right_id).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce(name, F.lit(1)) - 1))).drop(name)
    return spread.join(each, [key, "_part"]).drop("_part")
