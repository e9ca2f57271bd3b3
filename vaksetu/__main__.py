"""Command lines: build, stats, baseline, evaluate, summarize, infer, run_eval, serve. Run ``python -m vaksetu NAME --help`` or give the module to spark-submit."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import corpus, metrics, select, sequence
from .operators import serve as serving
from .runtime import cut, session, ship
from .sources import jsonl

SYSTEMS = {
    "lead_1": lambda: select.lead("text", 1),
    "lead_2": lambda: select.lead("text", 2),
    "lead_3": lambda: select.lead("text", 3),
    "textrank_1": lambda: select.textrank("text", 1),
    "oracle": lambda: select.oracle("text", "summary", 3),
}


def build(spark, args) -> None:
    """Clean the raw splits, keep first usable rows, write them and report the counts."""
    rows = None
    for split in args.splits:
        one = jsonl.read_raw_split(spark, args.input, split, jsonl.files(args.prefix))
        rows = one if rows is None else rows.unionByName(one)
    cleaned = corpus.cleaned(rows)
    jsonl.write_splits(corpus.capped(corpus.first_usable(cleaned), args.cap), args.output)
    for r in corpus.kept_and_dropped(cleaned).collect():
        print(f"{r['split']}: kept {r['kept']}, dropped {r['dropped']}")


def stats(spark, args) -> None:
    """Statistics of each processed split."""
    rows = [jsonl.read_processed(spark, args.input, s) for s in args.splits]
    found = rows[0]
    for one in rows[1:]:
        found = found.unionByName(one)
    jsonl.write_result(corpus.split_stats(found), args.output)


def predictions(rows: DataFrame, systems: list[str]) -> DataFrame:
    made = rows.select("id", "text", "summary", *(SYSTEMS[s]().alias(s) for s in systems))
    pairs = F.explode(F.array(*(F.struct(F.lit(s).alias("system"), F.col(s).alias("prediction")) for s in systems)))
    return made.select("id", F.col("text").alias("source"), F.col("summary").alias("reference"), pairs.alias("x")).select("id", "source", "reference", "x.*")


def baseline(spark, args) -> None:
    """Predict and score the extractive systems on a split."""
    began = time.perf_counter()
    rows = jsonl.read_processed(spark, args.input, args.split, jsonl.whole(args.limit))
    found = metrics.evaluated_with_intervals(metrics.scored(predictions(rows, args.systems), source="source"))
    result = {r["system"]: r.asDict(recursive=True) for r in found.collect()}
    jsonl.write_result({"systems": result, "seconds": round(time.perf_counter() - began, 1)}, args.output)


def evaluate(spark, args) -> None:
    """Score a file of predictions (system, id, prediction, reference)."""
    rows = spark.read.schema("system string, id string, prediction string, reference string").option("mode", "FAILFAST").json(args.input)
    jsonl.write_result(metrics.evaluated_with_intervals(metrics.scored(rows)), args.output)


def summarize(spark, args) -> None:
    """Summaries of a text or a text file."""
    rows = jsonl.literal_text(spark, args.text) if args.text is not None else jsonl.read_text(spark, args.file)
    for r in rows.select(select.SYSTEMS[args.method]("text", args.sentences).alias("s")).collect():
        print(r["s"])


def infer(spark, args) -> None:
    """Summaries of a text or a text file by a model."""
    rows = jsonl.literal_text(spark, args.text) if args.text is not None else jsonl.read_text(spark, args.file)
    for r in sequence.summarize(rows, sequence.imported(args.model), args.model, batch_size=args.batch_size).collect():
        print(r["summary"])


def run_eval(spark, args) -> None:
    """Predict a split with a model, score it, and save the scores, the speed of prediction and the first samples."""
    rows = jsonl.read_processed(spark, args.input, args.split, jsonl.whole(args.limit)).withColumnRenamed("summary", "reference")
    rows = cut(rows.withColumn("pos", F.monotonically_increasing_id()))
    began = time.perf_counter()
    made = cut(sequence.summarize(rows, sequence.imported(args.model), args.model, batch_size=args.batch_size).withColumnRenamed("summary", "prediction"))
    seconds, n = time.perf_counter() - began, made.count()
    scores = metrics.scored(made.withColumn("system", F.lit(args.model)), source="text")
    samples = [r.asDict() for r in jsonl.prediction_samples(made, args.samples).collect()]
    found = metrics.evaluated_with_intervals(scores).drop("system").first() if n else metrics.evaluated_whole(scores).first()
    jsonl.write_result({"model": args.model, "split": args.split, **found.asDict(recursive=True), "seconds": round(seconds, 1), "articles_per_second": round(n / seconds, 2), "samples": samples}, args.output)


def serve(spark, args) -> None:
    """Answer HTTP requests until interrupted."""
    serving.http_server(spark, sequence.imported(args.model) if args.model else None, args.host, args.port).serve_forever()


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vaksetu", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for run in (build, stats, baseline, evaluate, summarize, infer, run_eval, serve):
        one = commands.add_parser(run.__name__, help=run.__doc__)
        one.set_defaults(run=run)
        if run in (infer, run_eval, serve):
            one.add_argument("--model", required=run is not serve, help="module:attribute of what makes the model")
        if run in (infer, run_eval):
            one.add_argument("--batch-size", type=int, default=8)
        if run is serve:
            one.add_argument("--host", default="127.0.0.1")
            one.add_argument("--port", type=int, default=8000)
            continue
        if run in (summarize, infer):
            source = one.add_mutually_exclusive_group(required=True)
            source.add_argument("--text")
            source.add_argument("--file")
        if run is infer:
            continue
        if run is summarize:
            one.add_argument("--method", choices=sorted(select.SYSTEMS), default="lead")
            one.add_argument("--sentences", type=int, default=2)
            continue
        one.add_argument("--input", required=True)
        one.add_argument("--output", required=True)
        if run in (build, stats):
            one.add_argument("--splits", nargs="+", default=list(jsonl.FILES))
        if run is build:
            one.add_argument("--cap", type=int)
            one.add_argument("--prefix", default="", help="what the names of the raw files begin with")
        if run in (baseline, run_eval):
            one.add_argument("--split", default="test")
            one.add_argument("--limit", type=int, default=0, help="0: the whole split")
        if run is run_eval:
            one.add_argument("--samples", type=int, default=25)
        if run is baseline:
            one.add_argument("--systems", nargs="+", choices=sorted(SYSTEMS), default=list(SYSTEMS))
    args = parser.parse_args(arguments)
    spark = session()
    ship(spark)
    args.run(spark, args)


if __name__ == "__main__":
    main()
