import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from reqsieve.config import EngineConfig
from reqsieve.operators import score
from reqsieve.plans import batch, portable
from reqsieve.plans.portable import PortableModel
from reqsieve.sources import sinks, tables

SCHEMA = "featuresId string, rtbFloorPriceSent double, age int, withBundleId int, withGeo int, gender string, conType string"
GOOD = ("id", 10.0, 30, 1, 0, "F", "2-HIGH")


def scored(spark, model, *rows, schema=SCHEMA):
    return score.score(spark.createDataFrame(list(rows), schema), model)


def test_known_value(spark, fixed_model):
    row = scored(spark, fixed_model, GOOD).first()
    z = -1.2 + 0.02 * 10 - 0.01 * 30 + 0.25 + 0.2 - 0.2
    p1 = 1 / (1 + math.exp(-z))
    assert row.probability_1 == pytest.approx(p1, abs=1e-15)
    assert (row.status, row.prediction, row.to_filter) == ("ok", 0.0, True)
    assert row.precision == pytest.approx(1 - p1, abs=1e-15)


@pytest.mark.parametrize(
    "change, reason, field",
    [
        ({1: None}, "null_value", "rtbFloorPriceSent"),
        ({1: float("nan")}, "bad_type", "rtbFloorPriceSent"),
        ({5: None}, "null_value", "gender"),
        ({5: "X"}, "unseen_category", "gender"),
        ({6: "3-MEDIUM"}, "unseen_category", "conType"),
        ({2: None, 6: "3-MEDIUM"}, "null_value", "age"),
    ],
)
def test_failures_stay_as_rows(spark, fixed_model, change, reason, field):
    row = scored(spark, fixed_model, tuple(change.get(i, v) for i, v in enumerate(GOOD))).first()
    assert (row.status, row.failure_reason, row.failed_field) == ("failure", reason, field)
    assert row.to_filter is None and row.precision is None and row.prediction is None


def test_missing_and_mistyped_columns(spark, fixed_model):
    frame = spark.createDataFrame([GOOD], SCHEMA)
    row = score.score(frame.drop("withGeo"), fixed_model).first()
    assert (row.status, row.failure_reason, row.failed_field) == ("failure", "missing_field", "withGeo")
    row = score.score(frame.withColumn("age", F.lit(True)), fixed_model).first()
    assert (row.failure_reason, row.failed_field) == ("bad_type", "age")
    text = frame.withColumn("age", F.lit("30"))
    assert score.score(text, fixed_model).first().precision == score.score(frame, fixed_model).first().precision
    row = score.prepare(text.withColumn("age", F.lit("3O")), fixed_model).first()
    assert (row.failure_reason, row.failed_field) == ("bad_type", "age")


def test_tie_goes_to_class_zero(spark):
    row = score.score(spark.createDataFrame([(0.0,)], "x double"), PortableModel(0.0, {"x": 1.0}, {})).first()
    assert (row.probability_1, row.prediction, row.to_filter, row.precision) == (0.5, 0.0, True, 0.5)


def test_extreme_margins(spark):
    rows = spark.createDataFrame([(1e6,), (-1e6,)], "x double")
    got = score.score(rows, PortableModel(0.0, {"x": 1.0}, {})).collect()
    assert [(r.prediction, r.precision) for r in got] == [(1.0, 1.0), (0.0, 1.0)]


def test_default_and_own_id(spark, fixed_model):
    rows = scored(spark, fixed_model, GOOD, (*GOOD[:5], "X", "NA"))
    with_default = [r.result for r in score.with_prediction(rows, default=True).collect()]
    assert tuple(with_default[1]) == ("NA", False, 0.0)
    assert with_default[0].features_id == "id" and with_default[0].to_filter
    assert [r.result is None for r in score.with_prediction(rows).collect()] == [False, True]


def test_gate(spark, fixed_model):
    schema = "status string, to_filter boolean, precision double"
    rows = [("ok", True, 0.7), ("ok", True, 0.69), ("ok", False, 0.9), ("failure", None, None)]
    frame = spark.createDataFrame(rows, schema)
    for threshold, expected in ((0.7, [True, False, False, False]), (None, [True, True, False, False]), (-1, [True, True, False, False])):
        assert [r.filtered for r in score.with_gate(frame, threshold).collect()] == expected
    kept, filtered = score.route(frame, 0.7)
    assert (kept.count(), filtered.count()) == (3, 1)


def test_joined_categories_equal_inline_ones(spark, fixed_model):
    table = portable.coefficient_frame(
        spark,
        portable.coefficient_rows("20240101", fixed_model.intercept, fixed_model.numeric_weights, fixed_model.categories),
    )
    rows = tables.requests(spark, SMALL)
    columns = ["request_id", "status", "failure_reason", "failed_field", "to_filter", "precision"]
    results = []
    for limit in (64, 0):
        model = PortableModel.from_table(table, inline_limit=limit)
        assert (model.inline_weights("gender") is None) == (limit == 0)
        scores = batch.score_labelled(rows, model, keep=["request_id"]).select(columns)
        results.append(sorted(map(tuple, scores.collect())))
    assert results[0] == results[1]


def test_large_lists_are_not_broadcast(spark, monkeypatch):
    """Beyond the counted bound the category join is a plain shuffle join with the same result."""
    monkeypatch.setattr("reqsieve.plans.portable.join_side", lambda df: df.hint("merge"))
    rows = portable.coefficient_rows("20240101", 0.1, {"x": 2.0}, {"c": {str(i): i / 7 for i in range(50)}})
    model = PortableModel.from_table(portable.coefficient_frame(spark, rows), inline_limit=3)
    data = spark.range(1000).select((F.col("id") / 100).alias("x"), F.when(F.col("id") % 3 > 0, "7").otherwise((F.col("id") % 60).cast("string")).alias("c"))
    joined = score.score(data, model)
    assert "SortMergeJoin" in joined._jdf.queryExecution().toString()
    inline = score.score(data, PortableModel(0.1, {"x": 2.0}, {"c": {str(i): i / 7 for i in range(50)}}))
    key = lambda r: (r.x, r.c)
    assert sorted(joined.select(inline.columns).collect(), key=key) == sorted(inline.collect(), key=key)


def test_model_table_must_hold_one_model(spark):
    one = portable.coefficient_rows("20240101", 0.1, {"x": 1.0}, {"c": {"a": 1.0}})
    for extra in (portable.coefficient_rows("20240102", 0.1, {}, {}), [one[1]], [one[2]]):
        with pytest.raises(ValueError):
            PortableModel.from_table(portable.coefficient_frame(spark, one + extra))
    assert PortableModel.from_table(portable.coefficient_frame(spark, one)).features == ("x", "c")


def test_model_of_joined_categories_only(spark):
    rows = portable.coefficient_rows("20240101", 0.5, {}, {"c": {"a": 1.0, "b": -2.0}})
    model = PortableModel.from_table(portable.coefficient_frame(spark, rows), inline_limit=0)
    got = score.score(spark.createDataFrame([("a",), ("b",), ("z",)], "c string"), model).collect()
    assert {r.c: r.prediction for r in got} == {"a": 1.0, "b": 0.0, "z": None}


def test_scoring_stays_in_generated_code(spark, fixed_model):
    plan = batch.score_labelled(tables.requests(spark, SMALL), fixed_model).select("to_filter", "precision")
    text = plan._jdf.queryExecution().toString()
    assert "PythonUDF" not in text and "Cartesian" not in text and "NestedLoop" not in text
    # Only the model's inputs are read: no product name, customer name or order price.
    physical = plan._jdf.queryExecution().executedPlan().toString()
    assert "p_brand" not in physical and "c_name" not in physical and "props" not in physical


def test_decide_and_prediction_lines(spark, fixed_model, tmp_path):
    decided = batch.decide(tables.requests(spark, SMALL).drop("isWinning"), fixed_model, EngineConfig(threshold=0.8), keep=["request_id"])
    assert decided.filter("filtered and precision < 0.8").count() == 0
    sinks.write_predictions(decided, str(tmp_path / "lines"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()]
    assert len(lines) == decided.filter("status = 'ok'").count()
    assert all(line.split(",")[0] in ("true", "false") and len(line.split(".")[1]) == 6 for line in lines)
