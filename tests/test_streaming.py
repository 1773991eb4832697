"""Streams give the batch results, also across micro-batches and repeats."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from reqsieve.config import EngineConfig
from reqsieve.operators import counters
from reqsieve.operators.flush import flush_windows
from reqsieve.plans.batch import score_labelled
from reqsieve.sources import sinks, tables
from reqsieve.streaming import counters as stream_counters
from reqsieve.streaming import flush as stream_flush
from reqsieve.streaming import scoring

KEEP = ["request_id", "ts", "monitor_id"]
FILES = 5


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The sample requests as files in order of time."""
    base = tmp_path_factory.mktemp("requests")
    rows = tables.requests(spark, SMALL).persist()
    bounds = [r[0] for r in rows.select(F.percentile_approx("request_id", [i / FILES for i in range(FILES + 1)])).collect()][0]
    bounds[-1] += 1
    for i in range(FILES):
        part = rows.filter((F.col("request_id") >= bounds[i]) & (F.col("request_id") < bounds[i + 1]))
        part.coalesce(1).write.parquet(f"{base}/raw{i}")
        [source] = [p for p in (base / f"raw{i}").iterdir() if p.suffix == ".parquet"]
        target = base / "in" / f"part{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(source.read_bytes())
        os.utime(target, (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))
    return str(base / "in"), rows


def stream(spark, folder, **options):
    path, rows = folder
    return scoring.read_requests(spark, path, rows.schema, **options)


def test_scores_equal_batch(spark, folder, fixed_model, tmp_path):
    requests = stream(spark, folder, max_files=2)
    scored = scoring.score_stream(requests, fixed_model, KEEP)
    query = scoring.start_scoring(requests, fixed_model, str(tmp_path / "out"), str(tmp_path / "cp"), KEEP)
    query.awaitTermination()
    got = spark.read.schema(scored.schema).parquet(str(tmp_path / "out"))
    expected = score_labelled(folder[1], fixed_model, KEEP)
    assert got.exceptAll(expected.select(got.columns)).count() == 0 and got.count() == expected.count()


def test_unlabelled_stream(spark, folder, fixed_model):
    scored = scoring.score_stream(stream(spark, folder).drop("isWinning"), fixed_model, KEEP)
    assert scored.isStreaming and "real_positive" not in scored.columns


@pytest.mark.parametrize("metrics, log", [(True, True), (False, True), (True, False)])
def test_counters_equal_batch_and_sinks_are_switched(spark, folder, fixed_model, tmp_path, metrics, log):
    scored = scoring.score_stream(stream(spark, folder, max_files=1), fixed_model, KEEP)
    out = str(tmp_path / "out")
    config = EngineConfig(metric_monitoring=metrics, send_metric_logging=log)
    sink = sinks.report_sink(str(tmp_path / "report"), config, ["window_start", "monitor_id"])
    stream_counters.start_counters(scored, out, str(tmp_path / "cp"), "PT1H", ["monitor_id"], sink=sink).awaitTermination()
    report = stream_counters.stream_report(spark, out, ["monitor_id"])
    expected = counters.window_counters(score_labelled(folder[1], fixed_model, KEEP), "PT1H", by=["monitor_id"])
    assert sorted(report.collect()) == sorted(expected.select(report.columns).collect())
    assert len([p for p in os.listdir(out) if p.startswith("batch_id=")]) == FILES
    assert os.path.exists(tmp_path / "report" / "metrics") == metrics
    assert os.path.exists(tmp_path / "report" / "log") == log
    if metrics:
        # each request is reported once, over all batches
        rows = spark.read.parquet(str(tmp_path / "report" / "metrics")).filter("metric = 'Request-Histogram'")
        assert rows.agg(F.sum("value")).first()[0] == folder[1].count()
    if log:
        lines = [r.value for r in spark.read.text(str(tmp_path / "report" / "log")).collect()]
        assert lines and all(line.startswith("window_start=2024-01-") and ",monitor_id=m" in line for line in lines)


@pytest.mark.parametrize("compact_every", [2, 3, 100])
def test_late_and_timeless_events_are_counted(spark, folder, fixed_model, tmp_path, compact_every):
    """Files newest first, a tenth of the events without a time; batches are compacted on the way."""
    path = tmp_path / "in"
    path.mkdir()
    rows = folder[1].withColumn("ts", F.when(F.col("request_id") % 10 != 0, F.col("ts"))).persist()
    for i, part in enumerate(sorted(os.listdir(folder[0]), reverse=True)):
        spark.read.parquet(f"{folder[0]}/{part}").join(rows.select("request_id", F.col("ts").alias("t")), "request_id").withColumn(
            "ts", F.col("t")
        ).drop("t").select(rows.columns).coalesce(1).write.mode("append").parquet(str(path))
    requests = scoring.read_requests(spark, str(path), rows.schema, max_files=1)
    scored, out = scoring.score_stream(requests, fixed_model, KEEP), str(tmp_path / "out")
    stream_counters.start_counters(scored, out, str(tmp_path / "cp"), "P1D", compact_every=compact_every).awaitTermination()
    report = stream_counters.stream_report(spark, out)
    expected = counters.window_counters(score_labelled(rows, fixed_model, KEEP), "P1D")
    key = lambda r: str(r.window_start)
    assert sorted(report.collect(), key=key) == sorted(expected.select(report.columns).collect(), key=key)
    assert report.agg(F.sum("input")).first()[0] == 1000 and report.filter("window_start IS NULL").first().input == 100
    assert any(p.startswith("upto=") for p in os.listdir(out)) == (compact_every < FILES)


def test_repeated_batches_and_compaction_change_nothing(spark, folder, fixed_model, tmp_path):
    out = str(tmp_path / "out")
    for n in (0, 1, 2, 1):
        part = score_labelled(folder[1].filter(F.col("request_id") % 3 == n), fixed_model, KEEP)
        counters.window_counters(part, "P1D").write.mode("overwrite").parquet(f"{out}/batch_id={n}")
    before = sorted(stream_counters.stream_report(spark, out).collect())
    for last in (0, 0, 2):
        stream_counters.compact(spark, out, last)
        assert sorted(stream_counters.stream_report(spark, out).collect()) == before
    assert [p for p in os.listdir(out) if "=" in p] == ["upto=2"]
    # a compaction that did not finish is no part of the report
    (tmp_path / "out" / "upto=9").mkdir()
    assert sorted(stream_counters.stream_report(spark, out).collect()) == before
    with pytest.raises(LookupError):
        stream_counters.stream_report(spark, str(tmp_path / "nowhere"))


def test_flush_equals_batch_across_batches(spark, folder, fixed_model, tmp_path):
    scored = scoring.score_stream(stream(spark, folder, max_files=1), fixed_model, KEEP)
    out, seen = str(tmp_path / "out"), []
    query = stream_flush.start_flush(
        scored, out, str(tmp_path / "cp"), "PT20H", sink=lambda windows, batch: seen.append((batch, windows.count()))
    )
    query.awaitTermination()
    got = stream_flush.closed_windows(spark, out)
    expected = flush_windows(score_labelled(folder[1], fixed_model, KEEP), "PT20H")
    assert sorted(got.collect()) == sorted(expected.select(got.columns).collect())
    assert [batch for batch, _ in seen] == list(range(FILES)) and sum(n for _, n in seen) == got.count()


def test_repeating_a_batch_changes_nothing(spark, folder, fixed_model, tmp_path):
    """A batch reads its predecessor's open windows, so running it twice is the same."""
    scored = score_labelled(folder[1], fixed_model, KEEP)
    cut = scored.select(F.percentile_approx("request_id", 0.5)).first()[0]
    first = stream_flush.advance(scored.filter(F.col("request_id") < cut), spark.createDataFrame([], stream_flush._STORED), "PT20H")
    left_open = first.filter(~F.col("closed")).persist()
    tail = scored.filter(F.col("request_id") >= cut)
    runs = [sorted(stream_flush.advance(tail, left_open, "PT20H").collect()) for _ in range(2)]
    assert runs[0] == runs[1]
    windows = [r for r in [*first.collect(), *runs[0]] if r.closed]
    assert len(windows) == flush_windows(scored, "PT20H").count()


def test_late_events_count_into_the_open_window(spark, folder, fixed_model):
    """Arrival order decides: an event older than the open window belongs to it."""
    scored = score_labelled(folder[1], fixed_model, KEEP)
    cut = scored.select(F.percentile_approx("request_id", 0.5)).first()[0]
    newer, older = scored.filter(F.col("request_id") >= cut), scored.filter(F.col("request_id") < cut)
    opened = stream_flush.advance(newer, spark.createDataFrame([], stream_flush._STORED), "PT20H")
    left_open = opened.filter(~F.col("closed")).persist()
    after = stream_flush.advance(older, left_open, "PT20H").collect()
    assert not any(r.closed for r in after)
    assert sum(r.input for r in after) == older.count() + sum(r.input for r in left_open.collect())


def test_no_sink_computes_nothing(spark):
    class Untouched:
        def __getattr__(self, name):
            raise AssertionError(name)

    sinks.no_sink(Untouched(), 0)
