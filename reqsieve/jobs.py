"""Jobs for ``spark-submit``: train, score, monitor, stream.

    spark-submit -m reqsieve.jobs train   -d 20240101 --base URI --input URI
    spark-submit -m reqsieve.jobs score   -d 20240101 --base URI --input URI --output URI
    spark-submit -m reqsieve.jobs monitor -d 20240101 --base URI --input URI --output URI
    spark-submit -m reqsieve.jobs stream  -d 20240101 --base URI --input URI --output URI --checkpoint URI

``-c`` names a JSON file with engine settings. Input is a parquet table of raw
requests, or request lines where ``--format csv`` is given.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reqsieve.config import EngineConfig
from reqsieve.operators import counters, flush
from reqsieve.operators.normalize import normalize_training
from reqsieve.plans import batch, portable, training
from reqsieve.schemas import LABEL, NORMALIZED, RAW_REQUEST
from reqsieve.session import Scratch, prepare
from reqsieve.sources import model_store, request_csv, sinks
from reqsieve.streaming import counters as stream_counters
from reqsieve.streaming import flush as stream_flush
from reqsieve.streaming import scoring


# What the train job tries; the last of each is the fixed default.
GRID = {"regParam": (0.01, 0.1, training.REG_PARAM), "elasticNetParam": (training.ELASTIC_NET_PARAM,)}


def _config(path: str | None) -> EngineConfig:
    if path is None:
        return EngineConfig()
    with open(path, encoding="utf-8") as file:
        return EngineConfig.from_mapping(json.load(file))


def _requests(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if args.format == "csv":
        return request_csv.parse_lines(request_csv.read_lines(spark, args.input))
    return spark.read.parquet(args.input)


def _extra(requests: DataFrame) -> list[str]:
    """Columns that are neither raw fields nor the label travel along."""
    return [c for c in requests.columns if c not in (*RAW_REQUEST.fieldNames(), LABEL)]


def _monitors(frame: DataFrame) -> list[str]:
    return ["monitor_id"] if "monitor_id" in frame.columns else []


def train(spark: SparkSession, args: argparse.Namespace, config: EngineConfig) -> dict[str, float]:
    """Fit on 80% of the labelled requests with the settings that do best on the next 10%,
    publish, and report on the last 10%."""
    rows = normalize_training(_requests(spark, args))
    with Scratch(spark, "train") as scratch:
        splits = training.stored_split(rows, f"{scratch.folder}/parts", seed=args.seed).persist()
        try:
            best = training.tune(splits, rows, GRID)[0]
            if isinstance(best.model, training.WideModel):  # a model in a table has no other form
                model_store.save_pipeline(best.model.pipeline(), args.base, args.model)
            model_store.publish(portable.wide_coefficient_table(spark, best.model, args.model, NORMALIZED), args.base)
            found = training.evaluate(best.model, splits.test)
            return {**found, **{k: best.params[k] for k in GRID}, **training.left_out(splits.train, best.model.encoding)}
        finally:
            splits.unpersist()


def score(spark: SparkSession, args: argparse.Namespace, config: EngineConfig) -> None:
    requests = _requests(spark, args)
    model = model_store.load_scorer(spark, args.base, args.model)
    batch.decide(requests, model, config, keep=_extra(requests)).write.mode("overwrite").parquet(args.output)


def monitor(spark: SparkSession, args: argparse.Namespace, config: EngineConfig) -> None:
    """Counters per period where the requests carry ``ts``, else totals; per monitor where they
    carry ``monitor_id``."""
    requests = _requests(spark, args)
    model = model_store.load_scorer(spark, args.base, args.model)
    scored = batch.score_labelled(requests, model, keep=_extra(requests))
    by = _monitors(scored)
    if "ts" not in scored.columns:
        report = counters.count_total(scored, by, threshold=config.threshold)
    elif by and args.flush:
        report = flush.flush_windows(scored, config.log_update_period, order=args.order, threshold=config.threshold)
    else:
        report = counters.present(counters.window_counters(scored, config.log_update_period, by=by, threshold=config.threshold))
    report.write.mode("overwrite").parquet(f"{args.output}/counters")
    stored = spark.read.schema(report.schema).parquet(f"{args.output}/counters")
    sinks.report_sink(args.output, config, [c for c in ("monitor_id", "window_start") if c in stored.columns])(stored, 0)


def stream(spark: SparkSession, args: argparse.Namespace, config: EngineConfig) -> None:
    """Score new files and report what each batch of them adds to the counters of its periods."""
    if args.format == "csv":
        requests = request_csv.parse_lines(request_csv.stream_lines(spark, args.input, args.max_files))
    else:
        schema = spark.read.parquet(args.input).schema
        requests = scoring.read_requests(spark, args.input, schema, args.max_files)
    model = model_store.load_scorer(spark, args.base, args.model)
    trigger = {"availableNow": True} if args.once else {"processingTime": args.every}
    keep = _extra(requests)
    if LABEL not in requests.columns:
        return await_all([scoring.start_scoring(requests, model, f"{args.output}/scored", f"{args.checkpoint}/scored", keep, trigger)])
    # one query scores, writes and counts
    scored = scoring.score_stream(requests, model, keep)
    by, arrival = _monitors(scored), "ts"
    if "ts" not in scored.columns:
        scored, arrival = scored.withColumn("arrived", F.current_timestamp()), "arrived"
    sink = sinks.report_sink(args.output, config, ["window_start", *by])
    where = f"{args.output}/counters", f"{args.checkpoint}/counters", config.log_update_period
    kept = f"{args.output}/scored"
    if args.flush and by:
        if args.order not in scored.columns:
            raise SystemExit(f"no column {args.order}: give --order")
        flushed = sinks.report_sink(args.output, config, ["monitor_id", "window_start"])
        options = {"order": args.order, "threshold": config.threshold, "ts": arrival}
        query = stream_flush.start_flush(scored, *where, sink=flushed, trigger=trigger, scored_out=kept, **options)
    else:
        query = stream_counters.start_counters(scored, *where, by, config.threshold, arrival, sink, trigger, scored_out=kept)
    await_all([query])


def await_all(queries: Sequence[StreamingQuery], poll_seconds: float = 1.0) -> None:
    """Wait until every query has ended; if one fails, stop the others and raise its error."""
    waiting = list(queries)
    try:
        while waiting:
            waiting = [q for q in waiting if not q.awaitTermination(poll_seconds)]
    finally:
        for query in queries:
            if query.isActive:
                query.stop()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="reqsieve.jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    for job in (train, score, monitor, stream):
        sub = jobs.add_parser(job.__name__, help=(job.__doc__ or "Score a request table.").splitlines()[0])
        sub.set_defaults(run=job)
        sub.add_argument("-c", "--config")
        sub.add_argument("-d", "--model", required=True, help="model date, YYYYMMDD")
        sub.add_argument("--base", help="model location; default from the config")
        sub.add_argument("--input", required=True)
        sub.add_argument("--format", choices=("parquet", "csv"), default="parquet")
        if job is not train:
            sub.add_argument("--output", required=True)
    jobs.choices["train"].add_argument("--seed", type=int)
    for job in ("monitor", "stream"):
        jobs.choices[job].add_argument("--flush", action="store_true", help="close windows on events")
        jobs.choices[job].add_argument("--order", default="request_id", help="tells events of one moment apart")
    extra = jobs.choices["stream"]
    extra.add_argument("--checkpoint", required=True)
    extra.add_argument("--max-files", type=int)
    extra.add_argument("--every", default="30 seconds")
    extra.add_argument("--once", action="store_true", help="stop when all present files are done")
    return top


def main(arguments: Sequence[str], spark: SparkSession | None = None):
    args = parser().parse_args(arguments)
    config = _config(args.config)
    args.base = args.base or config.model_location
    if not args.base:
        raise SystemExit("no model location: give --base or model_location in the config")
    spark = prepare(spark or SparkSession.builder.appName(f"reqsieve-{args.job}").getOrCreate())
    return args.run(spark, args, config)


if __name__ == "__main__":
    result = main(sys.argv[1:])
    if result is not None:
        print(json.dumps(result))
