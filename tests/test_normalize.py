import pytest
from pyspark.sql import functions as F

from reqsieve.functions.identity import features_id
from reqsieve.operators import normalize
from reqsieve.schemas import LABEL, NORMALIZED, RAW_REQUEST

BASE = dict(
    publisherId=7, country="US", age=30, gender="F", brand="Acme", height=50, width=320,
    connectionType="wifi", withBundleId=True, withGeoInfo=False, rtbFloorSent=0.5,
)


def requests(spark, *changes, label=None):
    schema = RAW_REQUEST.simpleString()[len("struct<") : -1].replace(":", " ") + f", {LABEL} boolean"
    rows = [tuple({**BASE, **change}[c] for c in RAW_REQUEST.fieldNames()) + (label,) for change in changes]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "column, value, training, prediction",
    [
        ("country", None, "NA", "NA"),
        ("country", "", "NA", "NA"),
        ("country", " ", " ", " "),
        ("brand", None, "NA", "NA"),
        ("brand", "", "NA", "NA"),
        ("brand", " ", " ", " "),
        ("gender", None, "NA", "NA"),
        ("gender", "null", "NA", "null"),
        ("gender", "", "", ""),
        ("connectionType", None, "NA", "NA"),
        ("connectionType", "(null)", "(null)", "NA"),
        ("connectionType", "", "", ""),
        ("withBundleId", True, 1, 1),
        ("withBundleId", False, 0, 0),
        ("withGeoInfo", True, 1, 1),
        ("age", None, None, -1),
        ("rtbFloorSent", None, None, 0.0),
        ("publisherId", 7, "7", "7"),
        ("publisherId", None, "NA", "NA"),
    ],
)
def test_null_rules(spark, column, value, training, prediction):
    target = {raw: model for model, raw in normalize.RENAMES.items()}.get(column, column)
    rows = requests(spark, {column: value}, label=True)
    assert normalize.normalize_training(rows).first()[target] == training
    assert normalize.normalize_prediction(rows).first()[target] == prediction


def test_shapes(spark):
    rows = requests(spark, {}, label=True)
    training = normalize.normalize_training(rows)
    prediction = normalize.normalize_prediction(rows)
    assert training.columns == NORMALIZED.fieldNames() + [LABEL]
    assert [f.dataType for f in prediction.schema] == [f.dataType for f in NORMALIZED]
    assert training.first()[LABEL] == 1.0
    assert normalize.normalize_training(requests(spark, {}, label=False)).first()[LABEL] == 0.0


def test_mixed_follows_the_label(spark):
    change = {"gender": "null", "connectionType": "(null)", "age": None}
    labelled = normalize.normalize_mixed(requests(spark, change, label=False)).first()
    unlabelled = normalize.normalize_mixed(requests(spark, change, label=None)).first()
    assert (labelled.gender, labelled.conType, labelled.age, labelled[LABEL]) == ("NA", "(null)", None, 0.0)
    assert (unlabelled.gender, unlabelled.conType, unlabelled.age, unlabelled[LABEL]) == ("null", "NA", -1, None)


def test_unified_and_own_rules(spark):
    rows = requests(spark, {"gender": "null", "connectionType": "(null)", "brand": "?"}, label=True)
    both = normalize.normalize_training(rows, unified=True).first()
    assert (both.gender, both.conType, both.brand) == ("NA", "NA", "?")
    own = normalize.normalize_training(rows, rules={"brand": ("?",)}).first()
    assert (own.gender, own.conType, own.brand) == ("null", "(null)", "NA")


def test_features_id(spark):
    rows = requests(spark, {}, {}, {"country": None}, {"country": ""}, {"gender": "US", "country": "F"}, {"rtbFloorSent": 0.5000001})
    for method in ("md5", "xxhash64"):
        ids = [r[0] for r in rows.select(features_id(method=method)).collect()]
        assert ids[0] == ids[1]
        assert len(set(ids)) == 5


def test_label_polarity(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,), (float("nan"),), (None,)], f"{LABEL} double")
    got = rows.select(normalize.real_positive(), normalize.real_positive(win_is_positive=True)).collect()
    assert [tuple(r) for r in got] == [(False, True), (True, False), (True, False), (None, None)]


def test_feature_map_keeps_nulls(spark):
    row = normalize.normalize_training(requests(spark, {"age": None}, label=True)).select(
        normalize.feature_json(with_label=True).alias("j")
    )
    text = row.first().j
    assert '"age":null' in text and text.endswith('"isWinning":1.0}')
    assert row.select(F.get_json_object("j", "$.conType")).first()[0] == "wifi"
