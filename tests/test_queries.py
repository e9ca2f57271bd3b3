"""Each query with SQL against DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from vaksetu.plans.queries import QUERIES, SQL, flagship


def rows(frame):
    def text(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return ""
        return str(int(x)) if isinstance(x, float) and x == int(x) else str(x)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(text, r)) for r in frame.itertuples(index=False)), list(frame.columns)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    found = QUERIES[name](spark, small).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.execute(SQL[name]).df())


def test_whole_lengths(spark, small):
    said = {r.row_id: len(r.text.split()) for r in spark.read.parquet(f"{small}/processed.parquet").where("text IS NOT NULL").select("row_id", "text").collect()}
    held = {r.row_id: r.mask for r in QUERIES["preprocess_pairs_512"](spark, small).collect()}
    assert max(held.values()) > 64 and all(held[i] == min(n, 510) + 2 for i, n in said.items())


def test_label_mask_whole(spark, small):
    said = {r.row_id: len(r.text.split()) for r in spark.read.parquet(f"{small}/processed.parquet").where("text IS NOT NULL").select("row_id", "text").collect()}
    found = {r.row_id: len(r.labels.split()) for r in QUERIES["label_mask_whole"](spark, small).collect() if r.labels is not None}
    assert max(found.values()) > 8 and all(found[i] == n for i, n in said.items())


def test_flagship(spark, small):
    assert flagship(spark, small).count() == 3
