"""Streams: the corpus and serving operators over micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus, serve


def usable_stream(raw: DataFrame, delay: str = "1 hour", time: str = "delivered_at", key: str = "raw_id") -> DataFrame:
    """Cleaned usable examples of a stream, redelivered rows dropped while the watermark keeps their key."""
    return corpus.cleaned(raw).where("usable").withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def answer_stream(requests: DataFrame, method: str, path: str, checkpoint: str, make=None) -> StreamingQuery:
    """Answers each micro-batch of requests and appends the responses; a batch that is run again writes its own folder again."""

    def write(batch: DataFrame, number: int) -> None:
        serve.summarize_batch(batch, method, make).write.mode("overwrite").json(f"{path}/batch={number}")

    return requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
