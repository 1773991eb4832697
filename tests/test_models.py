import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SMALL
from reqsieve.operators import score
from reqsieve.operators.normalize import normalize_training
from reqsieve.operators.vocabulary import vocabulary
from reqsieve.plans import portable, training
from reqsieve.schemas import LABEL, NORMALIZED, check_declared
from reqsieve.sources import model_store, tables

CATEGORICAL, NUMERIC = ("gender", "conType", "country"), ("age", "rtbFloorPriceSent", "withGeo")


@pytest.fixture(scope="module")
def rows(spark):
    return normalize_training(tables.requests(spark, SMALL), keep=["request_id"]).persist()


@pytest.fixture(scope="module")
def splits(rows):
    return training.hash_split(rows, "request_id").persist()


@pytest.fixture(scope="module")
def fitted(rows, splits):
    return training.fit(splits.train, rows, CATEGORICAL, NUMERIC, params={"regParam": 0.01, "maxIter": 40})


def test_splits_cover_everything_once(spark, rows, splits):
    parts = [splits.train, splits.cv, splits.test]
    assert sum(p.count() for p in parts) == rows.count()
    ids = splits.train.select("request_id").unionAll(splits.cv.select("request_id")).unionAll(splits.test.select("request_id"))
    assert ids.distinct().count() == rows.count()
    assert 0.7 < splits.train.count() / rows.count() < 0.9
    drawn = training.random_split(rows, seed=3)
    assert drawn.train.count() + drawn.cv.count() + drawn.test.count() == rows.count()
    assert splits.train.storageLevel.useMemory and splits.train.storageLevel.useDisk


def test_table_scores_like_the_pipeline(spark, fitted, splits):
    model = portable.PortableModel.from_table(portable.coefficient_table(spark, fitted, "20240101"))
    own = score.score(splits.test, model).select("request_id", "probability_1", F.col("prediction").alias("own"))
    ml = fitted.transform(splits.test).select("request_id", vector_to_array("probability")[1].alias("p1"), "prediction")
    both = own.join(ml, "request_id")
    assert both.count() == splits.test.count()
    worst = both.agg(F.max(F.abs(F.col("p1") - F.col("probability_1"))), F.count_if(F.col("own") != F.col("prediction"))).first()
    assert worst[0] < 1e-12 and worst[1] == 0


def test_unseen_category_is_dropped_in_training_and_fails_in_scoring(spark, fitted, rows):
    strange = rows.limit(5).withColumn("gender", F.lit("X"))
    assert fitted.transform(strange).count() == 0
    model = portable.PortableModel.from_table(portable.coefficient_table(spark, fitted, "20240101"))
    assert {(r.status, r.failed_field) for r in score.score(strange, model).collect()} == {("failure", "gender")}


def test_vocabulary_order(spark):
    data = spark.createDataFrame([(v,) for v in "bbbaaccccd"], "c string")
    assert training.fit_indexers(data, ["c"])[0].labels == ["c", "b", "a", "d"]
    ties = spark.createDataFrame([(v,) for v in ("z", "a", "m")], "c string")
    assert training.fit_indexers(ties, ["c"])[0].labels == ["a", "m", "z"]


def test_vocabulary_over_many_partitions(spark):
    """Frequencies with many ties, far more categories than one partition takes."""
    data = spark.range(20_000).select(
        F.concat(F.lit("c"), (F.col("id") % 7_001).cast("string")).alias("a"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 11).cast("string")).alias("b"),
    )
    got = vocabulary(data, ["a", "b"]).collect()
    for column in ("a", "b"):
        counts = data.groupBy(column).count().collect()
        expected = [r[0] for r in sorted(counts, key=lambda r: (-r["count"], r[0]))]
        assert [r.category for r in sorted((r for r in got if r.feature == column), key=lambda r: r.idx)] == expected
        assert sorted(r.idx for r in got if r.feature == column) == list(range(len(expected)))
    with pytest.raises(training.TooManyCategories):
        training.fit_indexers(data, ["a"], limit=100)


@pytest.mark.parametrize("merge", [False, True])
def test_wide_fit_equals_the_pipeline(spark, rows, splits, fitted, monkeypatch, merge):
    if merge:
        monkeypatch.setattr("reqsieve.operators.vocabulary.join_side", lambda df, **_: df.hint("merge"))
    wide = training.fit_wide(splits.train, rows, CATEGORICAL, NUMERIC, params={"regParam": 0.01, "maxIter": 40})
    key = lambda r: (r.feature, r.category or "")
    own = sorted(portable.wide_coefficient_table(spark, wide, "20240101").collect(), key=key)
    ml = sorted(portable.coefficient_table(spark, fitted, "20240101").collect(), key=key)
    assert [r[:4] for r in own] == [r[:4] for r in ml]
    assert [r.coefficient for r in own] == pytest.approx([r.coefficient for r in ml], abs=1e-9)


def test_params_reach_the_fit(fitted):
    lr = fitted.stages[-1]
    assert (lr.getMaxIter(), lr.getRegParam(), lr.getElasticNetParam()) == (40, 0.01, training.ELASTIC_NET_PARAM)


def test_unpenalized_fit_is_the_maximum_likelihood(rows, splits):
    """Against Newton's method on the same numbers."""
    model = training.fit(splits.train, rows, (), NUMERIC, params={"regParam": 0.0, "maxIter": 100})
    data = splits.train.select(*NUMERIC, LABEL).toPandas().to_numpy(dtype=float)
    x, y = np.column_stack([np.ones(len(data)), data[:, :-1]]), data[:, -1]
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ weights))
        weights += np.linalg.solve((x.T * (p * (1 - p))) @ x, x.T @ (y - p))
    lr = model.stages[-1]
    assert [lr.intercept, *lr.coefficients] == pytest.approx(list(weights), rel=1e-3, abs=1e-5)


def test_refit_gives_the_same_model(rows, splits, fitted):
    again = training.fit(splits.train, rows, CATEGORICAL, NUMERIC, params={"regParam": 0.01, "maxIter": 40})
    assert again.stages[-1].coefficients.toArray() == pytest.approx(fitted.stages[-1].coefficients.toArray(), abs=1e-9)


def test_tune_ranks_by_cv(rows, splits):
    grid = {"regParam": [0.01, 100.0], "elasticNetParam": [1.0]}
    trials = training.tune(splits, rows, grid, CATEGORICAL, NUMERIC, params={"maxIter": 20})
    areas = [t.area_under_roc for t in trials]
    assert len(trials) == 2 and areas == sorted(areas, reverse=True) and areas[0] > areas[-1]
    # The strongest penalty removes every coefficient.
    assert trials[-1].params["regParam"] == 100.0
    held_out = training.evaluate(trials[0].model, splits.test)
    assert held_out["area_under_roc"] > 0.6 and 0 < held_out["accuracy"] <= 1


def test_any_number_of_categories(spark, monkeypatch):
    """More categories than a broadcast or an indexer takes, and a hot one."""
    from reqsieve.sizing import join_side

    monkeypatch.setattr("reqsieve.operators.vocabulary.join_side", lambda df, **known: join_side(df, 1000, **known))
    many = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 20_011).cast("string")).alias("site"),
        (F.col("id") % 7).cast("double").alias("x"),
        ((F.col("id") * 7919) % 10 < 4 + (F.col("id") % 7) / 2).cast("double").alias(LABEL),
    )
    with pytest.raises(training.TooManyCategories):
        training.fit_indexers(many, ["site"], limit=1000)
    wide = training.fit_wide(many, many, ["site"], ["x"], params={"maxIter": 5, "regParam": 1.0})
    assert wide.sizes["site"] > 13_000
    table = portable.wide_coefficient_table(spark, wide, "20240101")
    assert table.count() == wide.sizes["site"] + 2
    assert training.left_out(many, wide.encoding) == {"rows_used": 40_000, "rows_null": 0, "rows_unseen": 0}


def test_rows_with_null_numbers_are_left_out_and_counted(spark, rows, splits):
    odd = splits.train.withColumn("age", F.when(F.col("request_id") % 4 != 0, F.col("age")))
    odd = odd.withColumn("rtbFloorPriceSent", F.when(F.col("request_id") % 5 == 1, float("nan")).otherwise(F.col("rtbFloorPriceSent")))
    whole = odd.filter((F.col("request_id") % 4 != 0) & (F.col("request_id") % 5 != 1))
    options = {"params": {"regParam": 0.01, "maxIter": 10}}
    wide = training.fit_wide(odd, rows, CATEGORICAL, NUMERIC, **options)
    same = training.fit_wide(whole, rows, CATEGORICAL, NUMERIC, **options)
    assert list(wide.regression.coefficients) == pytest.approx(list(same.regression.coefficients), abs=1e-9)
    assert list(training.fit(odd, rows, CATEGORICAL, NUMERIC, **options).stages[-1].coefficients) == pytest.approx(list(wide.regression.coefficients), abs=1e-6)
    counted = training.left_out(odd, wide.encoding)
    assert counted == {"rows_used": whole.count(), "rows_null": odd.count() - whole.count(), "rows_unseen": 0}
    found = training.evaluate(wide, odd)
    assert found["coverage"] == pytest.approx(whole.count() / odd.count())


def test_unseen_categories_are_counted(rows, splits):
    known = splits.train.filter("gender <> 'F'")
    encoding = training.Encoding.of(known, CATEGORICAL, NUMERIC)
    counted = training.left_out(splits.test, encoding)
    assert counted["rows_unseen"] >= splits.test.filter("gender = 'F'").count() > 0
    assert counted["rows_used"] + counted["rows_unseen"] == splits.test.count()


def test_the_area_is_exact_on_any_number_of_partitions(spark, rows):
    from reqsieve.operators.evaluation import area_under_roc

    scored = rows.select(F.round(F.col("rtbFloorPriceSent"), 0).alias("s"), LABEL)
    data = scored.collect()
    won, lost = [r.s for r in data if r[LABEL] == 1.0], [r.s for r in data if r[LABEL] != 1.0]
    exact = sum((a > b) + (a == b) / 2 for a in won for b in lost) / (len(won) * len(lost))
    for n in (1, 5, 64):
        found = area_under_roc(scored.repartition(n), "s", F.col(LABEL) == 1.0).first()
        assert tuple(found) == (len(won), len(lost), pytest.approx(exact, abs=1e-12))
    assert area_under_roc(scored.limit(0), "s", F.col(LABEL) == 1.0).first() == (0, 0, None)


def test_stored_split(spark, rows, tmp_path):
    parts = training.stored_split(rows, str(tmp_path / "parts"), seed=3)
    assert parts.train.dtypes == rows.dtypes
    counts = [p.count() for p in (parts.train, parts.cv, parts.test)]
    assert sum(counts) == rows.count() and counts == [p.count() for p in (parts.train, parts.cv, parts.test)]
    assert parts.train.unionByName(parts.cv).unionByName(parts.test).exceptAll(rows).count() == 0
    plan = parts.cv._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan


def test_the_wide_model_is_stored_as_a_pipeline_over_indexed_rows(spark, rows, splits, tmp_path):
    wide = training.fit_wide(splits.train, rows, CATEGORICAL, NUMERIC, params={"maxIter": 5})
    model_store.save_pipeline(wide.pipeline(), str(tmp_path), "20240101")
    loaded = model_store.load_pipeline(str(tmp_path), "20240101")
    again = loaded.transform(wide.encoding.index(splits.test)).select("request_id", "prediction")
    assert again.exceptAll(wide.transform(splits.test, ["request_id"]).select("request_id", "prediction")).count() == 0


def test_numeric_only_model(spark, rows, splits):
    model = training.fit(splits.train, rows, (), NUMERIC, params={"maxIter": 5})
    table = portable.coefficient_table(spark, model, "20240101")
    assert {r.feature for r in table.collect()} == {"(intercept)", *NUMERIC}


def test_store_round_trip(spark, fitted, splits, tmp_path):
    base = str(tmp_path)
    model_store.save_pipeline(fitted, base, "20240101")
    loaded = model_store.load_pipeline(base, "20240101")
    assert list(loaded.stages[-1].coefficients) == list(fitted.stages[-1].coefficients)
    model_store.publish(portable.coefficient_table(spark, fitted, "20240101"), base)
    scorer = model_store.load_scorer(spark, base, "20240101")
    assert scorer.intercept == fitted.stages[-1].intercept
    assert set(scorer.category_features) == set(CATEGORICAL) and set(scorer.numeric_weights) == set(NUMERIC)


def test_publish_replaces_only_its_date(spark, tmp_path):
    base = str(tmp_path)

    def put(date, intercept):
        rows = portable.coefficient_rows(date, intercept, {"x": 1.0}, {})
        model_store.publish(portable.coefficient_frame(spark, rows), base)

    put("20240101", 1.0)
    put("20240102", 2.0)
    put("20240101", 3.0)
    found = {d: model_store.load_scorer(spark, base, d).intercept for d in ("20240101", "20240102")}
    assert found == {"20240101": 3.0, "20240102": 2.0}
    plan = model_store.coefficients(spark, base, "20240102")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_date" in plan


def test_missing_models_are_errors(spark, tmp_path):
    with pytest.raises(LookupError):
        model_store.load_scorer(spark, str(tmp_path), "20240101")
    rows = portable.coefficient_rows("20240101", 1.0, {"x": 1.0}, {})
    model_store.publish(portable.coefficient_frame(spark, rows), str(tmp_path))
    with pytest.raises(LookupError):
        model_store.load_scorer(spark, str(tmp_path), "20240102")
    with pytest.raises(ValueError):
        model_store.load_scorer(spark, str(tmp_path), "2024-01-01")


def test_declared_schema(rows):
    check_declared(rows, NORMALIZED)
    check_declared(rows, T.StructType([T.StructField("gender", T.StringType(), nullable=False)]))
    wrong = T.StructType([T.StructField("age", T.StringType(), False), T.StructField("feature1", T.StringType(), False)])
    with pytest.raises(ValueError, match="age: declared string, found int; feature1: declared string, missing"):
        check_declared(rows, wrong)


def test_export_checks_the_declared_schema(spark, fitted):
    assert portable.coefficient_table(spark, fitted, "20240101", NORMALIZED).count() > 0
    short = T.StructType([f for f in NORMALIZED.fields if f.name not in ("gender", "age")])
    with pytest.raises(ValueError, match="age must be a number, gender must be text"):
        portable.coefficient_table(spark, fitted, "20240101", short)


def test_feature_selects(spark, rows):
    by_list = tables.select_features(rows, ["gender", "age", LABEL])
    by_sql = tables.select_features(rows, f"SELECT gender, age, {LABEL} FROM my_rows", "my_rows")
    assert by_list.schema == by_sql.schema and by_list.count() == by_sql.count()
