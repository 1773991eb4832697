"""Flush windows against a plain event-by-event fold."""

import random
import subprocess
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark import cloudpickle

from reqsieve.operators import flush
from reqsieve.operators.flush import flush_partials, flush_windows
from reqsieve.sizing import join_side
from reqsieve.streaming import flush as stream_flush

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = (
    "monitor_id string, ts timestamp, request_id long, status string, to_filter boolean, "
    "precision double, real_positive boolean"
)
NAMES = ("input", "filtered", "false_negative", "invalid", "real_value")


def fold(rows, period_ms, threshold=0.7, starts=None):
    """One event at a time, straight from the counter table."""
    windows = []
    for monitor in sorted({r[0] for r in rows}):
        mine = sorted((r for r in rows if r[0] == monitor), key=lambda r: (r[1], r[2]))
        millis = [int((r[1] - EPOCH) / timedelta(milliseconds=1)) for r in mine]
        start = (starts or {}).get(monitor, millis[0])
        counts, total = [0] * 5, 0.0
        for (_, ts, _, status, to_filter, precision, real), ms in zip(mine, millis):
            ok = status == "ok"
            filtered = ok and to_filter and (threshold is None or precision >= threshold)
            for i, hit in enumerate((True, filtered, filtered and real, not ok, real)):
                counts[i] += bool(hit)
            total += precision if ok else 0.0
            if ok and ms - start >= period_ms:
                windows.append((monitor, start, ts, *counts, round(total, 6)))
                start, counts, total = ms, [0] * 5, 0.0
    return sorted(windows)


def rows_of(seed, n, monitors, span_ms, failure_rate, hot=0.0, micros=True):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        monitor = "m0" if rng.random() < hot else f"m{rng.randrange(monitors)}"
        ts = EPOCH + timedelta(milliseconds=rng.randrange(span_ms), microseconds=rng.randrange(1000) if micros else 0)
        ok = rng.random() >= failure_rate
        rows.append(
            (
                monitor,
                ts,
                rng.randrange(10**9) * n + i,
                "ok" if ok else "failure",
                rng.random() < 0.6 if ok else None,
                rng.choice([0.7, 0.69, 0.9, 0.512345]) if ok else None,
                rng.random() < 0.5,
            )
        )
    return rows


def collected(frame):
    out = []
    for r in frame.collect():
        start = int((r.window_start.replace(tzinfo=timezone.utc) - EPOCH) / timedelta(milliseconds=1))
        end = r.window_end.replace(tzinfo=timezone.utc)
        out.append((r.monitor_id, start, end, *[r[c] for c in NAMES], round(r.precision_sum, 6)))
    return sorted(out)


@pytest.fixture(autouse=True)
def utc_clock(monkeypatch):
    import time

    monkeypatch.setenv("TZ", "UTC")
    time.tzset()


@pytest.mark.parametrize(
    "n, monitors, span_ms, period, period_ms, failure_rate, hot, task_rows",
    [
        (400, 3, 3_600_000, "PT30S", 30_000, 0.3, 0.0, 4_000_000),
        (1200, 3, 200_000, "PT1S", 1_000, 0.2, 0.5, 20),  # tree of several levels
        (1500, 2, 2_000, "PT0.050S", 50, 0.4, 0.9, 300),  # many events per millisecond
        (200, 2, 7_200_000, "PT1M", 60_000, 0.5, 0.0, 4),  # sparse, binary tree
        (200, 3, 100_000, "PT10S", 10_000, 0.97, 0.0, 4),  # almost only failures
    ],
)
def test_flush_matches_fold(spark, n, monitors, span_ms, period, period_ms, failure_rate, hot, task_rows):
    rows = rows_of(n, n, monitors, span_ms, failure_rate, hot)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for walk_rows in (0, n):  # through the tree, and monitor by monitor
        got = collected(flush_windows(frame, period, task_rows=task_rows, walk_rows=walk_rows))
        assert got == fold(rows, period_ms)


@pytest.mark.parametrize("period, period_ms", [("PT1S", 1_000), ("PT6S", 6_000)])
def test_no_task_gets_more_steps_than_allowed(spark, monkeypatch, period, period_ms):
    """Dense successes, one every other millisecond: a period holds many times a task's rows."""
    task_rows, groups = 300, []

    def counted(frame, *keys):
        groups.append(frame.groupBy(*keys).count().agg({"count": "max"}).first()[0] or 0)

    first_steps, combine = flush._first_steps, flush._combine

    def watched(asked, later, width):
        counted(later, "monitor_id", "node", "piece")
        counted(asked.selectExpr("*", f"floor(entry / {width}) as p"), "monitor_id", "node", "p")
        return first_steps(asked, later, width)

    monkeypatch.setattr(flush, "_first_steps", watched)
    monkeypatch.setattr(flush, "_combine", lambda *a: pytest.fail("a task would get two whole buckets") if a else combine)
    rows = [("m0", EPOCH + timedelta(milliseconds=2 * i), i, "ok", True, 0.9, False) for i in range(6_000)]
    rows += [("m1", EPOCH + timedelta(milliseconds=900 * i), i, "ok" if i % 3 else "failure", i % 3 == 0, 0.9, False) for i in range(12)]
    got = collected(flush_windows(spark.createDataFrame(rows, SCHEMA).repartition(4), period, task_rows=task_rows))
    assert got == fold(rows, period_ms) and got
    assert 0 < max(groups) <= task_rows // 2


@pytest.mark.parametrize("walk_rows", [0, None])
def test_null_times_and_null_monitors_are_kept_apart(spark, walk_rows):
    at = lambda s: EPOCH + timedelta(seconds=s)
    rows = [(m, at(s), s, "ok", True, 0.9, True) for m in (None, "", "n") for s in (0, 31, 70)]
    rows += [(m, None, 5, "ok", True, 0.8, False) for m in (None, "", "m1") for _ in range(2)]
    partials = flush_partials(spark.createDataFrame(rows, SCHEMA), "PT30S", walk_rows=walk_rows).collect()
    assert sum(r.input for r in partials) == len(rows)
    untimed = {r.monitor_id: (r.input, r.closed) for r in partials if r.start_ms is None}
    assert untimed == {None: (2, True), "": (2, True), "m1": (2, True)}
    closed = {(r.monitor_id, r.input) for r in partials if r.start_ms is not None and r.closed and r.input}
    assert closed == {(m, n) for m in (None, "", "n") for n in (2, 1)}


@pytest.mark.parametrize("walk_rows", [0, None])
def test_worked_example(spark, walk_rows):
    times = [(10, True), (29, True), (31, False), (35, True), (64, True), (65, True)]
    rows = [
        ("m", EPOCH + timedelta(seconds=s), i, "ok" if ok else "failure", ok or None, 0.9 if ok else None, True)
        for i, (s, ok) in enumerate(times)
    ]
    starts = spark.createDataFrame([("m", int(EPOCH.timestamp() * 1000))], "monitor_id string, start_ms long")
    got = flush_windows(spark.createDataFrame(rows, SCHEMA), "PT30S", starts=starts, walk_rows=walk_rows).orderBy("window_start").collect()
    assert [(r.window_end.second + 60 * r.window_end.minute, r.input, r.invalid) for r in got] == [(35, 4, 1), (65, 2, 0)]


def test_buckets_too_many_to_broadcast(spark, monkeypatch):
    """The shuffle joins give the same windows, with most events in one bucket."""
    monkeypatch.setattr(flush, "join_side", lambda df: join_side(df, 0).hint("merge"))
    rows = rows_of(21, 300, 2, 300_000, 0.2) + [
        ("m0", EPOCH + timedelta(seconds=100, milliseconds=i % 7), 10**12 + i, "ok" if i % 3 else "failure", bool(i % 3) or None, 0.9 if i % 3 else None, True)
        for i in range(600)
    ]
    got = collected(flush_windows(spark.createDataFrame(rows, SCHEMA).repartition(4), "PT10S", walk_rows=0))
    assert got == fold(rows, 10_000)


@pytest.mark.parametrize("walk_rows", [0, None])
def test_batches_continue_each_other(spark, walk_rows):
    """Cut at any event, also right after a closing, the windows stay the same."""
    rows = sorted(rows_of(11, 120, 2, 400_000, 0.2), key=lambda r: (r[1], r[2]))
    expected = fold(rows, 10_000)
    first_end = expected[0][2]
    cuts = [0, [r[1] for r in rows].index(first_end) + 1, 60, len(rows)]
    state, windows = spark.createDataFrame([], stream_flush._STORED), []
    for low, high in zip(cuts, cuts[1:]):
        result = stream_flush.advance(spark.createDataFrame(rows[low:high], SCHEMA), state, "PT10S", walk_rows=walk_rows).collect()
        after = spark.createDataFrame(result, stream_flush._STORED)
        windows += collected(flush.present_windows(after))
        state = after.filter("NOT closed")
    assert sorted(windows) == expected


@pytest.mark.parametrize("walk_rows", [0, None])
def test_a_closing_opens_an_empty_window(spark, walk_rows):
    rows = [("m", EPOCH + timedelta(seconds=s), s, "ok", True, 0.9, True) for s in (0, 40)]
    got = sorted(flush_partials(spark.createDataFrame(rows, SCHEMA), "PT30S", walk_rows=walk_rows).collect(), key=lambda r: r.start_ms)
    start = int(EPOCH.timestamp() * 1000)
    assert [(r.start_ms - start, r.input, r.closed) for r in got] == [(0, 2, True), (40_000, 0, False)]


def test_only_failures_close_nothing(spark):
    rows = [("m", EPOCH + timedelta(minutes=i), i, "failure", None, None, False) for i in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert flush_windows(frame, "PT30S").count() == 0
    open_window = flush_partials(frame, "PT30S").collect()
    assert [(r.input, r.invalid, r.closed) for r in open_window] == [(50, 50, False)]


def test_dense_successes_keep_the_table_within_one_period(spark):
    """Every millisecond a success: no two chains ever meet, the worst case."""
    rows = [("m", EPOCH + timedelta(milliseconds=i), i, "ok", True, 0.9, i % 2 == 0) for i in range(3000)]
    got = collected(flush_windows(spark.createDataFrame(rows, SCHEMA), "PT0.020S", task_rows=60))
    assert got == fold(rows, 20)


def test_a_batch_of_a_stream_takes_few_jobs(spark, tmp_path):
    """One monitor with all rows, continued from the batch before."""
    rows = rows_of(5, 600, 1, 3_600_000, 0.2)
    spark.createDataFrame(sorted(rows, key=lambda r: r[1])[:300], SCHEMA).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame(sorted(rows, key=lambda r: r[1])[300:], SCHEMA).write.parquet(str(tmp_path / "b"))
    first = stream_flush.advance(spark.read.parquet(str(tmp_path / "a")), spark.createDataFrame([], stream_flush._STORED), "PT30S")
    first.write.parquet(str(tmp_path / "first"))
    before = spark.read.parquet(str(tmp_path / "first"))
    jobs = lambda: set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    known = jobs()
    stream_flush.advance(spark.read.parquet(str(tmp_path / "b")), before.filter("NOT closed"), "PT30S").write.parquet(str(tmp_path / "second"))
    assert len(jobs() - known) <= 10
    windows = before.filter("closed").unionByName(spark.read.parquet(str(tmp_path / "second")).filter("closed"))
    assert collected(flush.present_windows(windows)) == fold(rows, 30_000)


def test_empty_input(spark):
    assert flush_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_task_functions_need_no_package_on_the_executors(tmp_path):
    for i, function in enumerate((flush._combine(1000, 2, 1000), flush._enter(1000), flush._walk(1000))):
        (tmp_path / f"{i}.pkl").write_bytes(cloudpickle.dumps(function))
        code = f"import pickle; f = pickle.load(open('{i}.pkl', 'rb')); import sys; assert 'reqsieve' not in sys.modules"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "HOME": "/tmp"})
