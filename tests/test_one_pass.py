"""Scoring that counts, routes and dates in one scan; declared NOT NULL; accounted request lines."""

import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from reqsieve.config import EngineConfig
from reqsieve.operators import counters, normalize, score
from reqsieve.plans import batch, dated, portable, training
from reqsieve.schemas import CSV_COLUMNS, LABEL, check_declared, conforming, null_profile, null_rejects
from reqsieve.sources import request_csv, tables
from reqsieve.streaming import counters as stream_counters
from reqsieve.streaming import snapshots

KEEP = ["request_id", "ts", "monitor_id"]


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('view')}/requests"
    tables.requests(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("threshold", [None, 0.6])
def test_counted_while_written(spark, requests, fixed_model, tmp_path, threshold):
    config = EngineConfig(threshold=threshold)
    found = batch.score_with_counters(requests, fixed_model, str(tmp_path / "out"), config, KEEP, route=True)
    assert found.collect() == batch.score_and_monitor(requests, fixed_model, config).collect()
    kept, filtered = score.route(batch.score_labelled(requests, fixed_model, KEEP), threshold)
    for side, expected in ((False, kept), (True, filtered)):
        got = batch.read_route(spark, str(tmp_path / "out"), side)
        assert sorted(r[0] for r in got.select("request_id").collect()) == sorted(r[0] for r in expected.select("request_id").collect())


def test_no_rows_are_counted_as_none(spark, requests, fixed_model, tmp_path):
    found = batch.score_with_counters(requests.limit(0), fixed_model, str(tmp_path / "out")).first()
    assert (found.input, found.filtered, found.precision_sum, found.avg_precision) == (0, 0, 0.0, None)


DATES = ("20240108", "20240119")


@pytest.fixture(scope="module")
def models(spark):
    numbers = {"rtbFloorPriceSent": 0.02, "age": -0.01}
    texts = {"gender": {"F": 0.2, "O": 0.1, "NA": 0.0}, "country": {"CHINA": 0.4}}
    rows = portable.coefficient_rows(DATES[0], -1.2, numbers, texts)
    rows += portable.coefficient_rows(DATES[1], 0.3, {**numbers, "withGeo": 0.5}, {"gender": {"P": 0.2, "O": -0.1, "F": 0.3}})
    return portable.coefficient_frame(spark, rows)


def scored_rows(frame):
    return sorted(map(tuple, frame.select("request_id", "status", "prediction", F.round("precision", 9).alias("p")).collect()))


def test_dated_scores_equal_one_model_at_a_time(spark, requests, models):
    rows = normalize.normalize_training(requests, keep=KEEP)
    both = dated.score_by_date(rows, dated.DatedModels.from_table(models, DATES))
    for date in DATES:
        one = portable.PortableModel.from_table(models.filter(F.col("model_date") == date))
        assert scored_rows(both.filter(F.col("model_date") == date)) == scored_rows(score.score(rows, one))
    assert "__" not in " ".join(both.columns)


def test_as_of_takes_the_model_in_force(spark, requests, models):
    rows = normalize.normalize_training(requests, keep=KEEP).withColumn("ts", F.when(F.col("request_id") % 7 != 0, F.col("ts")))
    chosen = dated.score_as_of(rows, dated.DatedModels.from_table(models, DATES))
    by_date = dated.score_by_date(rows, dated.DatedModels.from_table(models, DATES))
    day = F.date_format("ts", "yyyyMMdd")
    for date, part in ((DATES[0], (day >= DATES[0]) & (day < DATES[1])), (DATES[1], day >= DATES[1])):
        assert scored_rows(chosen.filter(F.col("model_date") == date)) == scored_rows(by_date.filter(part & (F.col("model_date") == date)))
    left = chosen.filter("model_date IS NULL")
    assert left.count() == rows.filter(day.isNull() | (day < DATES[0])).count()
    assert {(r.status, r.failure_reason) for r in left.collect()} == {("failure", "no_model")}


def test_a_missing_date_is_an_error(spark, models):
    with pytest.raises(LookupError, match="20250101"):
        dated.DatedModels.from_table(models, [*DATES, "20250101"])


def test_a_missing_field_fails_only_models_that_use_it(spark, requests, models):
    rows = normalize.normalize_training(requests, keep=KEEP).drop("country")
    found = dated.score_by_date(rows, dated.DatedModels.from_table(models, DATES))
    assert found.filter(F.col("model_date") == DATES[0]).filter("status = 'ok'").count() == 0
    assert found.filter(F.col("model_date") == DATES[1]).filter("status = 'ok'").count() > 0


DECLARED = T.StructType([T.StructField("a", T.LongType(), False), T.StructField("b", T.StringType(), False), T.StructField("c", T.StringType())])


def test_not_null_is_held_against_rows(spark):
    rows = spark.createDataFrame([(1, "x", None), (None, "y", "z"), (None, None, "z"), (4, "", "")], "a long, b string, c string")
    profile = {r.field: (r.n_rows, r.n_null) for r in null_profile(rows, DECLARED).collect()}
    assert profile == {"a": (4, 2), "b": (4, 1), "c": (4, 1)}
    kept, rejected = conforming(rows, DECLARED), null_rejects(rows, DECLARED)
    assert [r.a for r in kept.collect()] == [1, 4]
    assert sorted(r.null_fields for r in rejected.collect()) == [["a"], ["a", "b"]]
    with pytest.raises(ValueError, match="a: 2 of 4 rows; b: 1 of 4 rows"):
        check_declared(rows, DECLARED)
    check_declared(rows, DECLARED, rows=False)
    check_declared(kept, DECLARED)
    with pytest.raises(ValueError, match="found"):
        conforming(rows.withColumn("a", F.col("a").cast("int")), DECLARED)
    assert null_profile(rows.limit(0), DECLARED).filter("n_rows <> 0").count() == 0


def test_export_refuses_nulls(spark):
    rows = spark.createDataFrame([(k, "xyz"[k % 3], float(k % 2)) for k in range(60)], f"request_id long, gender string, {LABEL} double")
    model = training.fit_wide(rows, rows, ("gender",), ())
    declared = T.StructType([T.StructField("gender", T.StringType(), False)])
    assert portable.export(spark, model, DATES[0], declared, rows).count() == 4
    with pytest.raises(ValueError, match="NOT NULL"):
        portable.export(spark, model, DATES[0], declared, rows.withColumn("gender", F.when(F.col("request_id") > 3, F.col("gender"))))
    with pytest.raises(ValueError, match="gender must be text"):
        portable.coefficient_table(spark, model, DATES[0], T.StructType([T.StructField("gender", T.LongType())]))


def test_every_line_is_accounted_for(spark, tmp_path):
    good = "1,IL,33,F,b,50,320,w,0,1,77,1.5,1.0"
    header = ",".join(CSV_COLUMNS)
    files = {
        "a.csv": [header, good, "", good.replace("33", "x3"), "   ", good + ",extra"],
        "b.csv": ["other,header", good, "short,line", header],
        "c.csv": [],
        "d.csv": [header],
    }
    (tmp_path / "in").mkdir()
    for name, lines in files.items():
        (tmp_path / "in" / name).write_text("".join(line + "\n" for line in lines))
    out = str(tmp_path / "out")
    request_csv.account_lines(spark, str(tmp_path / "in"), out)
    found = {re.search(r"(\w)\.csv", r.file)[1]: (r.n_lines, r.n_kept, r.n_rejected, r.n_header, r.n_blank) for r in request_csv.accounting(spark, out).collect()}
    # b's header is none that is known, so it is a rejected line; its last line repeats one in the first block
    assert found == {"a": (6, 2, 1, 1, 2), "b": (4, 1, 2, 1, 0), "d": (1, 0, 0, 1, 0)}
    kept = request_csv.accounted(spark, out, request_csv.KEPT)
    expected = request_csv.parse_lines(request_csv.read_lines(spark, str(tmp_path / "in" / "a.csv")))
    got = kept.filter(F.col("file").endswith("a.csv")).select(expected.columns)
    assert sorted(got.collect()) == sorted(expected.collect()) and got.count() == 2
    rejected = {(r.line, r.reject_reason) for r in request_csv.accounted(spark, out, request_csv.REJECTED).collect()}
    assert rejected == {(good.replace("33", "x3"), "age"), ("other,header", "publisherId"), ("short,line", "publisherId")}


def test_a_report_can_be_read_across_a_compaction(spark, requests, fixed_model, tmp_path):
    out = str(tmp_path / "out")

    def add(n):
        part = batch.score_labelled(requests.filter(F.col("request_id") % 6 == n), fixed_model, KEEP)
        counters.window_counters(part, "P1D").write.mode("overwrite").parquet(f"{out}/batch_id={n}")

    for n in range(3):
        add(n)
    opened = stream_counters.stream_report(spark, out)
    before = sorted(opened.collect())
    stream_counters.compact(spark, out, 1, keep=True)
    assert sorted(opened.collect()) == before == sorted(stream_counters.stream_report(spark, out).collect())
    opened = stream_counters.stream_report(spark, out)
    add(3)
    stream_counters.compact(spark, out, 3, keep=True)
    assert sorted(opened.collect()) == before
    # what the first compaction replaced is gone by now, what the second one replaced is not
    assert snapshots.parts(spark, out) == (3, [])
    left = {p.name for p in (tmp_path / "out").iterdir() if "=" in p.name}
    assert left == {"upto=1", "upto=3", "batch_id=2", "batch_id=3"}
