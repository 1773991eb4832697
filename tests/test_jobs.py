"""The jobs end to end: train on the sample, score it, report on it, stream it."""

import json
import os

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import SMALL
from reqsieve import jobs
from reqsieve.schemas import COUNTERS, CSV_COLUMNS
from reqsieve.sources import tables


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    tables.requests(spark, SMALL).write.parquet(f"{base}/in")
    found = jobs.main(["train", "-d", "20240101", "--base", f"{base}/store", "--input", f"{base}/in", "--seed", "1"], spark)
    assert 0.5 < found["area_under_roc"] <= 1 and 0 < found["accuracy"] <= 1 and found["coverage"] == 1
    assert found["regParam"] in jobs.GRID["regParam"]
    assert found["rows_used"] > 700 and found["rows_null"] == found["rows_unseen"] == 0
    # the parts and features of the run are gone
    left = [p for p in os.listdir(spark.conf.get("spark.checkpoint.dir")) if p.startswith("train-")]
    assert left == []
    return base


def common(place, job):
    return [job, "-d", "20240101", "--base", f"{place}/store", "--input", f"{place}/in", "--output", f"{place}/{job}"]


def test_store_has_both_forms(place):
    assert os.path.isdir(place / "store/MLModel/20240101/model/LR")
    assert os.path.isdir(place / "store/MLModel/coefficients/model_date=20240101")


def test_score(spark, place):
    jobs.main(common(place, "score"), spark)
    scored = spark.read.parquet(f"{place}/score")
    assert scored.count() == 1000 and {"request_id", "ts", "monitor_id", "filtered"} <= set(scored.columns)
    assert scored.filter("status = 'ok'").count() > 0


def test_monitor_reports(spark, place, tmp_path):
    settings = {"threshold": 0.55, "log_update_period": "PT6H", "metric_monitoring": True, "model_location": f"{place}/store"}
    (tmp_path / "c.json").write_text(json.dumps(settings))
    arguments = ["monitor", "-d", "20240101", "-c", str(tmp_path / "c.json"), "--input", f"{place}/in", "--output", f"{tmp_path}/out"]
    jobs.main(arguments, spark)
    report = spark.read.parquet(f"{tmp_path}/out/counters")
    assert report.agg(F.sum("input")).first()[0] == 1000 and report.select("monitor_id").distinct().count() == 4
    lines = spark.read.text(f"{tmp_path}/out/log")
    metrics = spark.read.parquet(f"{tmp_path}/out/metrics")
    assert lines.count() == report.count() and metrics.count() == len(COUNTERS) * report.count()
    jobs.main([*arguments, "--flush"], spark)
    assert "window_end" in spark.read.parquet(f"{tmp_path}/out/counters").columns


def test_stream_once(spark, place):
    jobs.main([*common(place, "stream"), "--checkpoint", f"{place}/cp", "--once"], spark)
    assert spark.read.parquet(f"{place}/stream/scored").count() == 1000
    counted = spark.read.parquet(f"{place}/stream/counters")
    assert counted.agg(F.sum("input")).first()[0] == 1000 and "monitor_id" in counted.columns
    assert os.path.isdir(place / "stream/log")


def test_stream_of_request_lines(spark, place, tmp_path):
    requests = spark.read.parquet(f"{place}/in")
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in CSV_COLUMNS if c != "id"]
    (tmp_path / "in").mkdir()
    lines = [r[0] for r in requests.limit(50).select(F.concat_ws(",", F.col("request_id").cast("string"), *fields)).collect()]
    (tmp_path / "in" / "a.csv").write_text("\n".join([",".join(CSV_COLUMNS), *lines, "x,broken"]) + "\n")
    arguments = ["stream", "-d", "20240101", "--base", f"{place}/store", "--input", f"{tmp_path}/in", "--output", f"{tmp_path}/out"]
    jobs.main([*arguments, "--checkpoint", f"{tmp_path}/cp", "--once", "--format", "csv"], spark)
    assert spark.read.parquet(f"{tmp_path}/out/scored").count() == 50
    assert spark.read.parquet(f"{tmp_path}/out/counters").agg(F.sum("input")).first()[0] == 50


def test_a_failing_stream_ends_the_job(spark, place, tmp_path):
    schema = spark.read.parquet(f"{place}/in").schema
    read = lambda: spark.readStream.schema(schema).parquet(f"{place}/in").writeStream

    def fail(batch, batch_id):
        raise ValueError("broken sink")

    bad = read().option("checkpointLocation", str(tmp_path / "a")).foreachBatch(fail).start()
    good = read().option("checkpointLocation", str(tmp_path / "b")).foreachBatch(lambda b, i: None).trigger(processingTime="1 second").start()
    with pytest.raises(StreamingQueryException, match="broken sink"):
        jobs.await_all([good, bad], 0.2)
    assert not good.isActive


def test_needs_a_model_location():
    with pytest.raises(SystemExit):
        jobs.main(["score", "-d", "20240101", "--input", "x", "--output", "y"])
