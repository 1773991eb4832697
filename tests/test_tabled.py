"""The fit with its coefficients in a table gives the optimum that Spark ML's fit gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from reqsieve.operators.normalize import normalize_training
from reqsieve.plans import certificate, portable, tabled, training
from reqsieve.schemas import LABEL
from reqsieve.sources import tables


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('rows')}/rows"
    normalize_training(tables.requests(spark, SMALL), keep=["request_id"]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def splits(rows):
    return training.hash_split(rows, "request_id")


def coefficients(spark, model):
    key = lambda r: (r.feature, r.category or "")
    return {key(r): r.coefficient for r in portable.wide_coefficient_table(spark, model, "20240101").collect()}


@pytest.mark.parametrize("head, params", [(20, {}), (1024, {"regParam": 0.05, "elasticNetParam": 0.5}), (1024, {"regParam": 0.05, "elasticNetParam": 0.0}), (3, {"regParam": 0.5, "elasticNetParam": 0.02})])
def test_the_same_optimum(spark, rows, splits, monkeypatch, head, params):
    """With a short head features have rare categories, which are joined; with one of three most of them."""
    exact = training.fit_wide(splits.train, rows, params={"tol": 1e-12, **params})
    monkeypatch.setattr(training, "DRIVER_SLOTS", 0)
    monkeypatch.setattr(tabled, "HEAD", head)
    model = training.fit_wide(splits.train, rows, params={"tol": 1e-7, **params})
    assert isinstance(model, training.TableModel) and 0 < model.iterations < 300
    expected, found = coefficients(spark, exact), coefficients(spark, model)
    assert found.keys() == expected.keys()
    assert [found[k] for k in expected] == pytest.approx([expected[k] for k in expected], abs=2e-4)
    mixing = {"reg_param": params.get("regParam", 0.3), "elastic_net_param": params.get("elasticNetParam", training.ELASTIC_NET_PARAM)}
    table = portable.coefficient_table(spark, model, "20240101")
    checked = certificate.optimality(splits.train, table, training.NUMERIC, training.CATEGORICAL, certificate.reference_categories(model.encoding), **mixing)
    assert checked.agg(F.max("violation")).first()[0] < 1e-5
    own, theirs = (training.evaluate(m, splits.test) for m in (model, exact))
    assert own == {k: pytest.approx(v, abs=1e-3) for k, v in theirs.items()}


def test_tune_ranks_alike(spark, rows, splits, monkeypatch):
    grid = {"regParam": [0.01, 100.0], "elasticNetParam": [1.0]}
    by_vector = training.tune(splits, rows, grid, ("gender", "country"), ("age",))
    monkeypatch.setattr(training, "DRIVER_SLOTS", 0)
    by_table = training.tune(splits, rows, grid, ("gender", "country"), ("age",))
    assert [t.params["regParam"] for t in by_table] == [t.params["regParam"] for t in by_vector]
    assert [t.area_under_roc for t in by_table] == pytest.approx([t.area_under_roc for t in by_vector], abs=1e-3)


def test_labels_of_one_class_and_strange_ones(spark, rows, splits, monkeypatch):
    monkeypatch.setattr(training, "DRIVER_SLOTS", 0)
    for value, expected in ((1.0, np.inf), (0.0, -np.inf)):
        model = training.fit_wide(splits.train.withColumn(LABEL, F.lit(value)), rows, ("gender",), ("age",))
        assert model.intercept == expected and set(model.numeric_weights.values()) == {0.0}
    with pytest.raises(ValueError):
        training.fit_wide(splits.train.withColumn(LABEL, F.lit(2.0)), rows, ("gender",), ("age",))
    with pytest.raises(ValueError):
        training.fit_wide(splits.train.limit(0), rows, ("gender",), ("age",))


def test_no_coefficient_vector_on_the_driver(spark, monkeypatch):
    """More rare categories than any part of the fit may hold whole: the driver gets the head alone."""
    monkeypatch.setattr(training, "DRIVER_SLOTS", 1000)
    many = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 20_011).cast("string")).alias("site"),
        (F.col("id") % 7).cast("double").alias("x"),
        ((F.col("id") * 7919) % 10 < 4 + (F.col("id") % 7) / 2).cast("double").alias(LABEL),
    )
    model = training.fit_wide(many, many, ["site"], ["x"], params={"regParam": 0.1})
    assert isinstance(model, training.TableModel)
    assert model.entries.count() == model.encoding.sizes["site"][0] > 13_000
    assert portable.wide_coefficient_table(spark, model, "20240101").count() == model.encoding.sizes["site"][0] + 2


def test_a_side_that_is_not_counted_small_is_never_broadcast(spark):
    """Its files may look small to Spark where its rows are not."""
    from reqsieve.sizing import join_side

    side = spark.range(5).withColumnRenamed("id", "k")
    plan = spark.range(9).join(join_side(side, known_bytes=1 << 30), F.col("id") == F.col("k"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
