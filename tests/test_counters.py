import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from reqsieve.config import EngineConfig
from reqsieve.functions.periods import period_interval, period_millis
from reqsieve.operators import counters, evaluation
from reqsieve.plans.batch import score_and_monitor, score_labelled
from reqsieve.schemas import COUNTERS
from reqsieve.sources.tables import requests

SCHEMA = "ts timestamp, status string, to_filter boolean, precision double, real_positive boolean"
T0 = datetime(2024, 1, 1)
TABLE = [
    ("failure", None, None, True),
    ("ok", True, 0.7, True),
    ("ok", True, 0.69, True),
    ("ok", True, 0.9, False),
    ("ok", False, 0.9, True),
]


def frame(spark, rows):
    return spark.createDataFrame([(T0 + timedelta(seconds=i), *r) for i, r in enumerate(rows)], SCHEMA)


def fold(rows, threshold):
    total = dict.fromkeys(COUNTERS, 0)
    precision = 0.0
    for status, to_filter, confidence, real in rows:
        total["input"] += 1
        total["real_value"] += bool(real)
        if status == "failure":
            total["invalid"] += 1
            continue
        filtered = to_filter and (threshold is None or confidence >= threshold)
        total["filtered"] += filtered
        total["false_negative"] += filtered and real
        precision += confidence
    return total, precision


def test_worked_table(spark):
    row = counters.count_total(frame(spark, TABLE)).first()
    assert [row[c] for c in COUNTERS] == [5, 2, 1, 1, 4]
    assert (row.precision_sum, row.avg_precision) == (3.19, pytest.approx(0.638))


def test_empty_and_all_failures(spark):
    row = counters.count_total(frame(spark, [])).first()
    assert [row[c] for c in COUNTERS] == [0] * 5 and row.avg_precision is None
    row = counters.count_total(frame(spark, [("failure", None, None, True)] * 4)).first()
    assert [row[c] for c in COUNTERS] == [4, 0, 0, 4, 4] and row.avg_precision == 0.0


@pytest.mark.parametrize("threshold", [None, -1, 0.0, 0.7, 1.0])
def test_random_events_match_fold(spark, threshold):
    rng = random.Random(5)
    rows = [
        ("failure", None, None, rng.random() < 0.5)
        if rng.random() < 0.2
        else ("ok", rng.random() < 0.5, rng.choice([0.5, 0.7, 0.699999, 1.0, 0.812345]), rng.random() < 0.5)
        for _ in range(700)
    ]
    expected, precision = fold(rows, None if threshold == -1 else threshold)
    row = counters.count_total(frame(spark, rows), threshold=threshold).first()
    assert {c: row[c] for c in COUNTERS} == expected
    assert row.precision_sum == pytest.approx(precision, abs=1e-9)
    assert row.filtered <= row.input and row.false_negative <= min(row.filtered, row.real_value)


def test_windows_and_merges_add_up(spark, fixed_model):
    scored = score_labelled(requests(spark, SMALL), fixed_model, keep=["ts", "monitor_id"])
    whole = counters.aggregate_counters(scored).first()
    by_hour = counters.window_counters(scored, "PT1H", by=["monitor_id"])
    assert counters.merge_counters(by_hour).first() == whole
    by_day = counters.merge_counters(by_hour, [F.to_date("window_start").alias("day")])
    assert counters.merge_counters(by_day).first() == whole
    compat = counters.merge_counters(by_hour, compat=True).first()
    assert compat.input == whole.real_value and compat[1:] == whole[1:]


def test_flagship_numbers(spark, fixed_model):
    row = score_and_monitor(requests(spark, SMALL), fixed_model).first()
    assert [row[c] for c in COUNTERS] == [1000, 267, 221, 219, 548]
    assert row.precision_sum == 536.937752


def test_reports(spark):
    report = counters.count_total(frame(spark, TABLE))
    named = {r.metric: r.value for r in counters.metric_rows(report).collect()}
    assert named == {
        "Request-Histogram": 5,
        "FilteredByPrediction-Counter": 2,
        "FalseNegative-Counter": 1,
        "EvalFailure-Counter": 1,
        "RealAd-Counter": 4,
    }
    assert counters.log_lines(report).first().line == "5,4,2,1,1,0.638000"


def test_confusion_and_quality(spark):
    rows = frame(spark, TABLE).withColumn("filtered", F.coalesce(F.col("to_filter"), F.lit(False)))
    cells = {(r.real, r.predicted): r.n for r in evaluation.confusion_matrix(rows).collect()}
    assert cells == {(True, True): 2, (False, True): 1, (True, False): 1}
    row = evaluation.quality(rows, "real_positive", "filtered").first()
    assert (row.coverage, row.accuracy, row.precision, row.recall) == (0.8, 0.5, 2 / 3, 2 / 3)
    assert evaluation.quality(rows.filter("false"), "real_positive", "filtered").first().accuracy is None


@pytest.mark.parametrize(
    "text, millis",
    [("PT30S", 30_000), ("PT1M", 60_000), ("PT1H30M", 5_400_000), ("P1D", 86_400_000), ("P1W", 604_800_000), ("P1DT0.5S", 86_400_500)],
)
def test_periods(text, millis):
    assert period_millis(text) == millis
    assert period_interval(text) == f"{millis} milliseconds"


@pytest.mark.parametrize("text", ["", "P", "PT", "30S", "PT30", "P1M", "P1Y", "P1DT", "PT0S", "pt30s", "PT-5S"])
def test_bad_periods(text):
    with pytest.raises(ValueError):
        period_millis(text)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 60), st.integers(0, 48), st.integers(0, 90), st.integers(0, 90))
def test_period_parts_add_up(days, hours, minutes, seconds):
    total = ((days * 24 + hours) * 60 + minutes) * 60 + seconds
    if total:
        assert period_millis(f"P{days}DT{hours}H{minutes}M{seconds}S") == total * 1000


def test_config():
    assert EngineConfig().threshold == 0.7
    assert EngineConfig(threshold=-1.0).threshold is None
    assert EngineConfig.from_mapping({"log_update_period": "PT5M"}).log_update_period == "PT5M"
    with pytest.raises(ValueError):
        EngineConfig.from_mapping({"tresh": 1})
    with pytest.raises(ValueError):
        EngineConfig(log_update_period="P1M")
