"""The real fits are optimal, by the gradient of their loss; penalties fall from the largest useful one."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from reqsieve.operators.normalize import normalize_training
from reqsieve.plans import certificate, hashed, path, portable, training
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


def worst(found):
    return found.agg(F.max("violation")).first()[0]


@pytest.mark.parametrize("params", [{}, {"regParam": 0.05, "elasticNetParam": 0.5}, {"regParam": 0.05, "elasticNetParam": 0.0}])
def test_fits_are_optimal(spark, rows, splits, params):
    """300 iterations, 0.3 and 7.48e-05 by default, as documented."""
    wide = training.fit_wide(splits.train, rows, params={"tol": 1e-9, **params})
    piped = training.fit(splits.train, rows, params=params)
    left_out = certificate.reference_categories(wide.encoding)
    mixing = {"reg_param": params.get("regParam", 0.3), "elastic_net_param": params.get("elasticNetParam", 7.482741259139502e-05)}
    for model in (wide, piped):
        table = portable.coefficient_table(spark, model, "20240101")
        found = certificate.optimality(splits.train, table, training.NUMERIC, training.CATEGORICAL, left_out, **mixing)
        assert found.count() == table.count() and worst(found) < 1e-4
    # a model that was fitted under another penalty is found out
    other = certificate.optimality(splits.train, table, training.NUMERIC, training.CATEGORICAL, left_out, reg_param=1.0, elastic_net_param=0.9)
    assert worst(other) > 1e-2


def test_the_settings_are_the_documented_ones(rows, splits):
    assert training._settings(None) == {"maxIter": 300, "regParam": 0.3, "elasticNetParam": 7.482741259139502e-05}
    assert training._settings({"regParam": 0.1})["regParam"] == 0.1


def test_the_path_starts_where_the_first_coefficient_appears(spark, rows, splits):
    encoding = training.Encoding.of(rows, ("gender", "conType"), ("age", "rtbFloorPriceSent"))
    at_zero = certificate.gradient_at_zero(splits.train, encoding)
    largest = path.largest_penalty(at_zero, 0.8)
    for share, expected in ((1.001, 0), (0.97, 1)):
        settings = {"regParam": largest * share, "elasticNetParam": 0.8, "tol": 1e-9}
        model = training.fit_wide(splits.train, rows, ("gender", "conType"), ("age", "rtbFloorPriceSent"), params=settings)
        assert sum(abs(w) > 1e-6 for w in model.regression.coefficients.toArray()) == expected
    assert path.largest_penalty(at_zero, 0.0) == math.inf and path.largest_penalty(at_zero.limit(0), 0.5) == 0.0


def test_falling_penalties():
    assert path.falling_penalties(2.0, 3, 0.01) == pytest.approx([2.0, 0.2, 0.02])
    assert path.falling_penalties(2.0, 1) == [2.0] and path.falling_penalties(2.0, 0) == []


def test_tune_path_ranks_finished_trials_first(spark, rows, splits):
    kept = splits.persist()
    trials = path.tune_path(kept, rows, 0.5, points=4, categorical=("gender",), numeric=("rtbFloorPriceSent",), rungs=(0.5, 1.0))
    kept.unpersist()
    assert [t.share for t in trials] == [1.0, 1.0, 0.5, 0.5]
    assert trials[0].area_under_roc >= trials[1].area_under_roc and trials[2].area_under_roc >= trials[3].area_under_roc
    assert len({t.params["regParam"] for t in trials}) == 4
    with pytest.raises(ValueError):
        path.tune_path(splits, rows, 0.0)


def test_a_fit_beyond_the_indexers_goes_on_by_joins(spark, rows, splits):
    within = training.fit(splits.train, rows)
    beyond = training.fit(splits.train, rows, limit=10)
    assert isinstance(beyond, training.WideModel)
    tables_ = [portable.coefficient_table(spark, m, "20240101").withColumn("coefficient", F.round("coefficient", 6)) for m in (within, beyond)]
    assert sorted(map(tuple, tables_[0].collect()), key=repr) == sorted(map(tuple, tables_[1].collect()), key=repr)
    indexes = [training.indexed(rows, rows, ("gender", "publisherId"), limit).select("request_id", "gender_index", "publisherId_index") for limit in (1 << 24, 10)]
    assert sorted(indexes[0].collect()) == sorted(indexes[1].collect())
    assert training.evaluate(beyond, splits.test) == training.evaluate(within, splits.test)


def test_nulls_and_unseen_rows_are_left_out(spark, rows, splits):
    table = portable.coefficient_table(spark, training.fit_wide(splits.train, rows, ("gender",), ("age",)), "20240101")
    reference = certificate.reference_categories(training.Encoding.of(rows, ("gender",), ("age",)))
    extra = rows.limit(5).withColumn("age", F.lit(None).cast("int")).unionByName(rows.limit(5).withColumn("gender", F.lit("unseen")))
    extra = extra.unionByName(rows.limit(5).withColumn(LABEL, F.lit(None).cast("double")))
    known, more = (certificate.optimality(r, table, ("age",), ("gender",), reference) for r in (splits.train, splits.train.unionByName(extra)))
    key = lambda r: (r.feature, r.category or "")
    for a, b in zip(sorted(known.collect(), key=key), sorted(more.collect(), key=key)):
        assert a.violation == pytest.approx(b.violation) and a.deviation == pytest.approx(b.deviation)


def test_hashed_categories(spark, rows, splits):
    """As many slots as a fit needs, whatever the categories; unseen ones are scored too."""
    model = hashed.fit_hashed(splits.train, width=64)
    assert model.regression.numFeatures == len(training.NUMERIC) + 64 * len(training.CATEGORICAL)
    unseen = rows.limit(20).withColumn("country", F.lit("NOWHERE"))
    assert model.transform(unseen).count() == 20
    assert model.transform(rows.limit(20).withColumn("country", F.lit(None).cast("string"))).count() == 0
    found = training.evaluate(model, splits.test)
    assert found["coverage"] == 1 and 0.5 < found["area_under_roc"] <= 1
    counted = {r.feature: r for r in hashed.collisions(rows, width=4).collect()}
    assert counted["country"].slots <= 4 and counted["country"].colliding > 4
    assert {r.feature: r.colliding for r in hashed.collisions(rows, ("gender",), 1 << 18).collect()} == {"gender": 0}


def test_hashed_equals_one_hot_where_nothing_collides(spark, rows, splits):
    both = [
        training.evaluate(m, splits.test)
        for m in (hashed.fit_hashed(splits.train, ("gender",), ("age",), 1 << 12, params={"tol": 1e-9}), training.fit_wide(splits.train, rows, ("gender",), ("age",), params={"regParam": 0.3, "tol": 1e-9}))
    ]
    assert both[0]["area_under_roc"] == pytest.approx(both[1]["area_under_roc"], abs=0.02)
