"""Serving: requests are validated whole, then answered in their order by a method of their choice."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.errors import PythonException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import select, sequence

METHODS = ("model", "lead", "textrank")
MOST_TEXTS, MOST_CHARACTERS, MOST_SENTENCES = 32, 20_000, 10


def problem(texts: Column | str = "texts", method: Column | str = "method", k: Column | str = "num_sentences") -> Column:
    """What makes a request invalid, or null. Method and count may be missing (defaults: model, 1)."""
    texts, method, k = (F.col(c) if isinstance(c, str) else c for c in (texts, method, k))
    blank = F.exists(texts, lambda t: F.coalesce(F.regexp_replace(t, f"[{T.WS}]+", ""), F.lit("")) == "")
    long = F.exists(texts, lambda t: F.length(t) > MOST_CHARACTERS)
    return (
        F.when(texts.isNull() | (F.size(texts) < 1) | (F.size(texts) > MOST_TEXTS), "texts: 1 to 32")
        .when(blank, "texts: blank")
        .when(long, "texts: too long")
        .when(method.isNotNull() & ~method.isin(*METHODS), "method")
        .when(k.isNotNull() & ~k.between(1, MOST_SENTENCES), "num_sentences: 1 to 10")
    )


def validated(requests: DataFrame) -> DataFrame:
    return requests.withColumn("problem", problem())


def summarize_batch(requests: DataFrame, method: str, make: Callable[[], sequence.BatchSummarizer] | None = None, key: str = "request_id") -> DataFrame:
    """(key, summaries) of valid requests, in the order of their texts. lead and textrank see the texts as they are; model cleans them."""
    valid = validated(requests).where("problem IS NULL")
    rows = valid.select(key, F.coalesce("num_sentences", F.lit(1)).alias("k"), F.posexplode("texts").alias("at", "text"))
    if method == "model":
        done = sequence.summarize(rows, make)
    elif method in ("lead", "textrank"):
        # k is 1 to 10: a branch each keeps the rank of every text at one call
        parts = None
        for k in range(1, MOST_SENTENCES + 1):
            part = rows.where(F.col("k") == k).withColumn("summary", select.SYSTEMS[method]("text", k))
            parts = part if parts is None else parts.union(part)
        done = parts if method == "textrank" else rows.withColumn("summary", F.array_join(F.slice(T.split_sentences("text"), F.lit(1), F.col("k")), " "))
    else:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    # a request has at most 32 texts
    gathered = done.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "summary"))).alias("x"))
    return gathered.select(key, F.transform("x", lambda s: s["summary"]).alias("summaries"))


def answer(df: DataFrame, method: str, make=None) -> dict:
    """A response document for one request: summaries, method and latency; 422 or 503 with a reason where there is none."""
    began = time.perf_counter()
    reason = validated(df).select("problem").first()
    if reason is None or reason["problem"]:
        return {"status": 422, "detail": reason["problem"] if reason else "no request"}
    if method == "model" and make is None:
        return {"status": 503, "detail": "no model is configured"}
    try:
        got = summarize_batch(df, method, make).first()["summaries"]
    except (RuntimeError, PythonException) as error:  # a model that fails does so in a worker
        return {"status": 503, "detail": str(error)[:200]}
    return {"status": 200, "summaries": got, "method": method, "latency_ms": round((time.perf_counter() - began) * 1000, 2)}


def health(make=None, name: str = "model") -> dict:
    return {"status": "ok", "model_configured": make is not None, "model_loaded": sequence.ModelRegistry.loaded(name)}


_REQUEST = "request_id long, texts array<string>, method string, num_sentences int"


def http_server(spark: SparkSession, make: Callable[[], sequence.BatchSummarizer] | None = None, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A thin adapter: ``GET /health`` and ``POST /summarize`` (texts, method: model by default, num_sentences: 1). One request is one small
    DataFrame, judged and answered by the operators above; call ``serve_forever`` on what is returned. Batches of requests belong in
    ``summarize_batch`` or a stream."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body: dict) -> None:
            content = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(content)))
            self.end_headers()
            self.wfile.write(content)

        def do_GET(self) -> None:
            self.reply(200, health(make)) if self.path == "/health" else self.reply(404, {"detail": "not found"})

        def do_POST(self) -> None:
            if self.path != "/summarize":
                return self.reply(404, {"detail": "not found"})
            try:
                asked = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
                method = asked.get("method", "model")
                row = spark.createDataFrame([(0, asked.get("texts"), method, asked.get("num_sentences", 1))], _REQUEST)
            except Exception as error:  # whatever of a body is no request
                return self.reply(422, {"detail": str(error)[:200]})
            got = answer(row, method, make) if method in METHODS else {"status": 422, "detail": "method"}
            self.reply(got.pop("status"), got)

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
