import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqsieve.llm import quality, queries

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    rows = queries.op7_positive_unlabelled_quality(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    return rows.join(labels, "doc_id", "left").toPandas()


def test_held_out_accuracy(scored):
    assert len(scored) == 10_000 and scored.score.between(0, 1).all()
    assert (scored.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id]).all()
    assert (scored.predicted == (scored.score >= 0.3)).all()
    held = scored[scored.held_out & scored.quality.notna()]
    good = held.quality == 1
    assert (held.predicted == held.quality).mean() > 0.97
    assert held.predicted[good].mean() > 0.99 and held.predicted[~good].mean() < 0.2


def test_the_prior_is_found_without_negatives():
    draw = np.random.default_rng(1)
    good = lambda n: draw.normal(0, 1, (n, 3))
    for share in (0.4, 0.7, 0.9):
        bad = draw.normal(2.5, 1, (4000 - int(4000 * share), 3))
        model = quality.fit(good(3000), np.concatenate([good(int(4000 * share)), bad]))
        assert abs(model.prior - share) < 0.08
        assert (quality.score(model, good(2000)) >= 0.5).mean() > 0.85
        assert (quality.score(model, draw.normal(2.5, 1, (2000, 3))) < 0.5).mean() > 0.85


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 40_000, "c"), (4, "%%% ###", "d"), (None, "A fine text.", "e"), (3, "word " * 40_000, "c"), (5, "\n\n \x00", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    good = spark.createDataFrame([(1, None), (3, 1.0), (3, 1.0), (None, 1.0), (77, 1.0)], "doc_id long, score double")
    model = spark.sparkContext.broadcast(quality.train(docs, good))
    found = quality.score_texts(docs, model, ["doc_id"]).collect()
    assert len(found) == 7 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id == 3}) == 1
    kept = quality.keep_good(docs, model, least=0.0)
    assert kept.schema == docs.schema and sorted(kept.collect(), key=repr) == sorted(docs.collect(), key=repr)
    assert quality.keep_good(docs, model, least=1.1).count() == 0
    assert quality.score_texts(docs.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("case", ["no labels", "no rows"])
def test_nothing_to_learn_from(spark, case):
    docs = spark.createDataFrame([(1, "a")] if case == "no labels" else [], "doc_id long, text string")
    good = spark.createDataFrame([] if case == "no labels" else [(1,)], "doc_id long")
    model = spark.sparkContext.broadcast(quality.train(docs, good))
    assert [r.score for r in quality.score_texts(docs, model, ["doc_id"]).collect()] == [0.5] * docs.count()


def test_labels_and_other_columns_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = docs.filter("doc_id % 3 = 0").select("doc_id")
    one = quality.train(docs, good)
    other = quality.train(docs.withColumns({"lang": F.lit("x"), "source": F.lit(None), "n_chars": F.lit(0)}), good)
    assert (one.weights == other.weights).all()


def test_the_sample_is_bounded(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda p, u, *more: seen.append((len(p), len(u))) or fit(p, u, *more)
        quality.train(docs, docs, most_positive=7, most_unlabelled=9)
    finally:
        quality.fit = fit
    assert seen == [(7, 9)]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", FOLDER])
def test_held_out_bad_texts_are_rejected_at_every_scale(spark, folder):
    rows = queries.op7_positive_unlabelled_quality(spark, folder).filter("held_out").toPandas()
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").toPandas()
    held = rows.merge(labels, on="doc_id")
    good = held.quality == 1
    assert held.predicted[good].mean() > 0.97 and held.predicted[~good].mean() < 0.2


def brute_risk(weights, p, u, prior):
    score = lambda row: 1 / (1 + np.exp(-(weights[0] + sum(weights[c] for c in row))))
    lost = sum(1 - score(r) for r in p) / len(p)
    kept = sum(score(r) for r in u) / len(u) - prior * sum(score(r) for r in p) / len(p)
    return prior * lost, kept


def test_risk_and_gradient_against_brute_force():
    draw = np.random.default_rng(6)
    p, u = draw.integers(1, 9, (12, 3)), draw.integers(1, 9, (17, 3))
    weights = draw.normal(size=9)
    positive, negative, up, down = quality.risk(weights, p, u, 0.7)
    assert (positive, negative) == pytest.approx(brute_risk(weights, p, u, 0.7))
    for k in range(9):
        step = np.zeros(9)
        step[k] = 1e-6
        high, low = brute_risk(weights + step, p, u, 0.7), brute_risk(weights - step, p, u, 0.7)
        assert up[k] == pytest.approx((high[0] - low[0]) / 2e-6, abs=1e-6) and down[k] == pytest.approx((high[1] - low[1]) / 2e-6, abs=1e-6)
    # the part that must not be negative is not fitted further once it is
    _, negative, _, down = quality.risk(weights, p, p, 1.5)
    assert negative < 0 and np.allclose(quality._non_negative(p, p, 1.5)(weights), -0.1 * down)


def test_steps_and_prior_come_from_all_rows():
    draw = np.random.default_rng(7)
    values = np.concatenate([np.zeros(500), draw.exponential(0.05, 4500)])
    counts = np.bincount(quality._histogram_cell(values), minlength=quality._FEATURE_CELLS)
    [steps] = quality._steps_of(counts[None, :])
    exact = np.unique(np.quantile(values, quality._LEVELS))
    assert np.abs(np.interp(exact, steps, steps) / np.maximum(exact, 1e-9) - 1)[exact > 0].max() < 0.1
    cells = quality._histogram_cell(np.array([0.0, 2.0**-30, 1e-3, 0.5, 7.0]))
    assert (np.diff(cells) > 0).all() and (quality._cell_start(cells[2:]) <= [1e-3, 0.5, 7.0]).all()
    assert quality.prior_from_shares(np.array([1, 0.9, 0.5]), np.array([1, 0.54, 0.3]), 10**6, 10**6) == pytest.approx(0.6)


def test_no_text_is_scored_by_a_model_that_saw_it():
    draw = np.random.default_rng(8)
    p, u = draw.normal(0, 1, (60, 2)), draw.normal(1, 1, (90, 2))
    folds = np.arange(60) % quality.FOLDS, np.arange(90) % quality.FOLDS
    steps = quality.feature_steps(np.concatenate([p, u]))
    before = quality.left_out_scores(quality.fit_plain(p, u, folds, steps), p, folds[0])
    changed = p.copy()
    changed[folds[0] == 0] += 5
    after = quality.left_out_scores(quality.fit_plain(changed, u, folds, steps), p, folds[0])
    assert np.allclose(before[folds[0] == 0], after[folds[0] == 0]) and not np.allclose(before[folds[0] == 1], after[folds[0] == 1])
