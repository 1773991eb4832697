"""Settings are compared by fits on the whole training part, none by a fit on a sample of it."""

import pytest

from conftest import SMALL
from reqsieve.plans import path, portable, tabled, training
from reqsieve.samples import queries


def test_every_trial_of_the_query_is_a_whole_fit(spark):
    rows, splits = queries._splits(spark, SMALL)
    found = queries.tune_lr(spark, SMALL).collect()
    areas = [r.area_under_roc for r in found]
    assert areas == sorted(areas, reverse=True)
    expected = {}
    for r in found:
        settings = {"regParam": r.reg_param, "elasticNetParam": r.elastic_net_param}
        model = training.fit_wide(splits.train, rows, params=settings)
        expected[tuple(settings.values())] = training.evaluate(model, splits.cv)["area_under_roc"]
    assert len(expected) == 4
    assert {(r.reg_param, r.elastic_net_param): r.area_under_roc for r in found} == pytest.approx(expected, abs=1e-4)


def test_a_path_is_whole_unless_shares_are_named(spark):
    rows, splits = queries._splits(spark, SMALL)
    trials = path.tune_path(splits, rows, 0.5, points=3, categorical=("gender",), numeric=("rtbFloorPriceSent",))
    assert [t.share for t in trials] == [1.0] * 3


def test_fits_side_by_side_are_those_made_alone(spark, monkeypatch):
    """Each goes by its own steps and ends by itself, also where others go on."""
    monkeypatch.setattr(tabled, "HEAD", 5)
    rows, splits = queries._splits(spark, SMALL)
    encoding = training.Encoding.of(rows, ("country",), ("age", "rtbFloorPriceSent"))
    encoded = training.cut_lineage(encoding.encode(splits.train), "features")
    points = [training._settings(p) for p in ({"maxIter": 2}, {"regParam": 0.05, "elasticNetParam": 0.5, "maxIter": 7}, {"regParam": 10.0, "elasticNetParam": 1.0})]
    together, alone = encoding.fit_each_encoded(encoded, points), [encoding.fit_encoded(encoded, p) for p in points]
    assert [m.iterations for m in together] == [m.iterations for m in alone] == [2, 7, 0]
    for one, other in zip(together, alone):
        a, b = ({(r.feature, r.category): r.coefficient for r in portable.wide_coefficient_table(spark, m, "20240101").collect()} for m in (one, other))
        assert a == pytest.approx(b, abs=1e-9)
