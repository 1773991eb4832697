"""Each period is reported once; what comes later is a correction; nothing is lost."""

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from reqsieve.operators import counters
from reqsieve.plans.batch import score_labelled
from reqsieve.sources import tables
from reqsieve.streaming import periods, scoring

KEEP = ["request_id", "ts", "monitor_id"]
BY = ["monitor_id"]


def batches(spark, path, parts):
    """One file per micro-batch, in this order."""
    for rows in parts:
        rows.coalesce(1).write.mode("append").parquet(path)
    return scoring.read_requests(spark, path, parts[0].schema, max_files=1)


def run(spark, tmp_path, requests, model, **options):
    scored = scoring.score_stream(requests, model, KEEP)
    where = str(tmp_path / "out"), str(tmp_path / "cp")
    periods.start_periods(scored, *where, "PT6H", BY, **options).awaitTermination()
    reports = periods.period_reports(spark, where[0])
    return reports, periods.open_periods(spark, where[1], "monitor_id string")


def total(spark, rows, model):
    frame = counters.window_counters(score_labelled(rows, model, KEEP), "PT6H", by=BY)
    return sorted(map(tuple, frame.collect()), key=repr)


def whole(reports, still_open):
    both = reports.drop("kind").unionByName(still_open)
    columns = ["window_start", *BY, *periods.SUMS]
    return sorted(map(tuple, periods.settled(both, BY).select(columns).collect()), key=repr)


@pytest.fixture(scope="module")
def requests(spark):
    return tables.requests(spark, SMALL).persist()


def quarters(rows):
    day = F.dayofmonth("ts")
    return [rows.filter(part) for part in (day <= 7, (day > 7) & (day <= 14), (day > 14) & (day <= 21), day > 21)]


def test_one_report_per_period(spark, requests, fixed_model, tmp_path):
    seen = []
    stream = batches(spark, str(tmp_path / "in"), quarters(requests))
    reports, still_open = run(spark, tmp_path, stream, fixed_model, delay="PT1H", sink=lambda report, n: seen.append((n, report.count(), report.columns)))
    times = Counter((r.window_start, r.monitor_id) for r in reports.collect())
    assert set(times.values()) == {1} and {r.kind for r in reports.collect()} == {periods.FINAL}
    last = requests.agg(F.max("ts")).first()[0] - dt.timedelta(hours=1)
    assert all(r.window_start + dt.timedelta(hours=6) > last for r in still_open.collect()) and still_open.count()
    assert whole(reports, still_open) == total(spark, requests, fixed_model)
    assert sum(n for _, n, _ in seen) == reports.count() and "avg_precision" in seen[0][2]


def test_late_events_are_corrections_and_no_time_goes_out_at_once(spark, requests, fixed_model, tmp_path):
    """The second quarter comes last; a tenth of the requests has no time."""
    rows = requests.withColumn("ts", F.when(F.col("request_id") % 10 != 0, F.col("ts")))
    rows = rows.withColumn("monitor_id", F.when(F.col("monitor_id") != "m1", F.col("monitor_id"))).persist()
    parts = quarters(rows)
    timeless = rows.filter("ts IS NULL")
    stream = batches(spark, str(tmp_path / "in"), [parts[0].unionByName(timeless), parts[2], parts[3], parts[1]])
    reports, still_open = run(spark, tmp_path, stream, fixed_model, remember="P90D")
    kinds = Counter(r.kind for r in reports.collect())
    # the second quarter's hours were never seen before, so these reports are their first
    assert kinds[periods.NO_TIME] == 4 and kinds[periods.FINAL] > kinds[periods.CORRECTION] >= 0
    finals = Counter((r.window_start, r.monitor_id) for r in reports.filter("kind = 'final'").collect())
    assert set(finals.values()) == {1}
    assert whole(reports, still_open) == total(spark, rows, fixed_model)


def test_corrections_within_and_beyond_memory(spark, requests, fixed_model, tmp_path):
    """A request of a reported period comes late: a correction, whether the period is remembered or not."""
    first = requests.filter(F.dayofmonth("ts") <= 7)
    held = first.filter(F.col("request_id") % 5 == 0)
    for name, remember in (("long", "P90D"), ("short", "PT1H")):
        where = tmp_path / name
        stream = batches(spark, str(where / "in"), [first.filter(F.col("request_id") % 5 != 0), *quarters(requests)[1:], held])
        reports, still_open = run(spark, where, stream, fixed_model, remember=remember)
        found = reports.filter("kind = 'correction'")
        assert found.count() > 0 and whole(reports, still_open) == total(spark, requests, fixed_model)
        if name == "short":  # all that is late comes after its period was forgotten
            assert found.agg(F.sum("input")).first()[0] == held.count()


def test_a_stream_goes_on_from_its_state(spark, requests, fixed_model, tmp_path):
    parts = quarters(requests)
    stream = batches(spark, str(tmp_path / "in"), parts[:2])
    run(spark, tmp_path, stream, fixed_model)
    parts[2].unionByName(parts[3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    reports, still_open = run(spark, tmp_path, stream, fixed_model)
    assert set(Counter((r.window_start, r.monitor_id) for r in reports.collect()).values()) == {1}
    assert whole(reports, still_open) == total(spark, requests, fixed_model)


def test_a_task_sends_one_row_per_key(spark, requests, fixed_model):
    scored = score_labelled(requests.coalesce(1), fixed_model, KEEP)
    rows = periods.partial_counters(scored, "P365D", "ts", [], 0.7)
    assert rows.count() == 1 and rows.first().input == 1000
    many = periods.partial_counters(scored, "PT1S", "ts", ["monitor_id"], 0.7, rows=10)
    assert many.agg(F.sum("input")).first()[0] == 1000


def test_nothing_written(spark, tmp_path):
    with pytest.raises(LookupError):
        periods.period_reports(spark, str(tmp_path))
