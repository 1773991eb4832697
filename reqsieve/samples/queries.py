"""Every operator as a query over the sample tables.

Timestamps leave as plain TIMESTAMP (no zone) and fractional results are
rounded, so that other engines can compare them value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqsieve.config import EngineConfig
from reqsieve.functions.identity import features_id
from reqsieve.operators import counters, evaluation, flush, normalize, score
from reqsieve.operators import vocabulary as vocabularies
from reqsieve.plans import batch, certificate, dated, hashed, path, portable, training
from reqsieve.schemas import COUNTERS, CSV_COLUMNS, LABEL, NORMALIZED, null_profile, null_rejects, schema_problems
from reqsieve.session import cut_lineage, prepare, scratch_path, written_folders
from reqsieve.sizing import join_side
from reqsieve.sources import model_store, request_csv, sinks, tables
from reqsieve.streaming import counters as stream_counters_
from reqsieve.streaming import flush as stream_flush_
from reqsieve.streaming import periods as stream_periods
from reqsieve.streaming import scoring as stream_scoring

Query = Callable[[SparkSession, str], DataFrame]

ROW = ("request_id", "ts", "monitor_id")
# Class 1 = win. A category not listed is unseen and fails.
FIXED_INTERCEPT = -1.2
FIXED_NUMERIC = {"rtbFloorPriceSent": 0.02, "age": -0.01, "withBundleId": 0.25, "withGeo": -0.3}
FIXED_CATEGORIES = {
    "gender": {"F": 0.2, "O": 0.1, "P": -0.1, "NA": 0.0},
    "conType": {"1-URGENT": 0.3, "2-HIGH": -0.2, "(null)": 0.15, "NA": 0.0},
}
# A second published model: steeper in the floor price.
LATER_NUMERIC = {**FIXED_NUMERIC, "rtbFloorPriceSent": 0.05}
FIXED_DATE, LATER_DATE = "20240101", "20240201"
FLUSH_PERIOD = "PT6H"


def fixed_model() -> portable.PortableModel:
    return portable.PortableModel(FIXED_INTERCEPT, FIXED_NUMERIC, FIXED_CATEGORIES)


def _number(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _plain(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    return batch.score_labelled(tables.requests(spark, folder), fixed_model(), keep=ROW)


def _gated(spark: SparkSession, folder: str, threshold: float | None = 0.7) -> DataFrame:
    return score.with_gate(_scored(spark, folder), threshold)


def _report(frame: DataFrame, *keys: Column) -> DataFrame:
    # Both are one division of whole numbers, so they need no rounding.
    return frame.select(*keys, *COUNTERS, "precision_sum", "avg_precision")


# --- sources -----------------------------------------------------------------


def feature_select(spark: SparkSession, folder: str) -> DataFrame:
    return tables.select_features(
        tables.requests(spark, folder),
        "SELECT request_id, publisherId, country, age, rtbFloorSent, isWinning FROM feature_rows",
        "feature_rows",
    )


def _csv_text(requests: DataFrame) -> Column:
    """Request lines with every kind of malformed field mixed in."""
    age = F.col("age")
    text = age.cast("string")
    floor = F.col("rtbFloorSent").cast("string")
    fields = [
        F.col("request_id").cast("string"),
        F.col("country"),
        F.when(age % 11 == 0, F.concat(text, F.lit(".7")))
        .when(age % 13 == 0, F.concat(F.lit(" "), text))
        .when(age % 17 == 0, F.concat(F.lit("+"), text))
        .otherwise(text),
        F.coalesce("gender", F.lit("")),
        F.when(age % 8 == 0, F.concat(F.lit('"'), F.col("brand"))).otherwise(F.col("brand")),
        F.col("height").cast("string"),
        F.col("width").cast("string"),
        F.coalesce("connectionType", F.lit("")),
        F.when(age % 6 == 0, "").when(F.col("withBundleId"), "1").otherwise("0"),
        F.when(F.col("withGeoInfo"), "1").otherwise("0"),
        F.col("publisherId").cast("string"),
        F.when(age % 9 == 3, F.concat(floor, F.lit("d")))
        .when(age % 9 == 4, F.concat(F.lit(" "), floor))
        .when(age % 9 == 5, F.concat(floor, F.lit("x")))
        .otherwise(floor),
        F.when(age % 19 == 0, "").otherwise(F.col("isWinning").cast("string")),
    ]
    whole = F.concat_ws(",", *fields)
    return (
        F.when(age % 23 == 0, F.concat_ws(",", *fields[:4]))
        .when(age % 5 == 0, F.concat(whole, F.lit(",extra")))
        .otherwise(whole)
    )


def _csv_lines(spark: SparkSession, folder: str) -> DataFrame:
    requests = tables.requests(spark, folder)
    path = scratch_path(spark, "request-csv")
    lines = requests.select(_csv_text(requests).alias(",".join(CSV_COLUMNS)))
    writer = lines.write.option("header", True).option("sep", "\x01").option("quote", "\x00")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return request_csv.read_lines(spark, path)


def csv_parse(spark: SparkSession, folder: str) -> DataFrame:
    return request_csv.parse_lines(_csv_lines(spark, folder))


def csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    return request_csv.rejected_lines(_csv_lines(spark, folder)).select("id", "reject_reason")


CSV_FILES = 3


def csv_accounting(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of three files, blank ones among them, by what became of it; all in one pass."""
    requests, lines_path, out = tables.requests(spark, folder), scratch_path(spark, "request-csv"), scratch_path(spark, "accounted")
    blank = F.when(F.col("request_id") % 40 == 0, F.lit("  "))
    text = requests.select(F.explode(F.array_compact(F.array(_csv_text(requests), blank))).alias(",".join(CSV_COLUMNS)))
    writer = text.repartition(CSV_FILES).write.option("header", True).option("sep", "\x01").option("quote", "\x00")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(lines_path)
    request_csv.account_lines(spark, lines_path, out)
    files = request_csv.accounting(spark, out)
    names = ["n_lines", "n_kept", "n_rejected", "n_header", "n_blank"]
    parts = sum((F.col(n) for n in names[2:]), F.col(names[1]))
    typed = request_csv.accounted(spark, out, request_csv.KEPT).agg(F.sum("age").alias("sum_age"), F.sum("publisherId").alias("sum_publisher"))
    totals = files.agg(F.count(F.lit(1)).alias("n_files"), *[F.sum(n).alias(n) for n in names], F.every(F.col("n_lines") == parts).alias("adds_up"))
    return totals.join(typed)  # one row each


# --- normalization -----------------------------------------------------------


def normalize_training(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"])


def normalize_prediction(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize_prediction(tables.requests(spark, folder), keep=["request_id"])


def normalize_unified(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"], unified=True)


def normalize_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Requests without a bundle id have no label and follow the prediction rules."""
    requests = tables.requests(spark, folder).withColumn(LABEL, F.when(F.col("withBundleId"), F.col(LABEL)))
    return normalize.normalize_mixed(requests, keep=["request_id"])


def normalize_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Age and floor absent on some rows: defaults for prediction, null for training."""
    requests = tables.requests(spark, folder).withColumns(
        {
            "age": F.when(F.col("brand") != "", F.col("age")),
            "rtbFloorSent": F.when(F.col("country") != "", F.col("rtbFloorSent")),
        }
    )
    prediction = normalize.normalize_prediction(requests, keep=["request_id"])
    training_rows = normalize.normalize_training(requests, keep=["request_id"])
    columns = ["request_id", "age", "rtbFloorPriceSent"]
    return (
        prediction.select(F.lit("prediction").alias("mode"), *columns)
        .unionByName(training_rows.select(F.lit("training").alias("mode"), *columns))
    )


def features_id_query(spark: SparkSession, folder: str) -> DataFrame:
    return tables.requests(spark, folder).select("request_id", features_id().alias("features_id"))


def feature_map_json(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"])
    rows = rows.withColumn("rtbFloorPriceSent", F.col("rtbFloorPriceSent").cast("decimal(18,6)"))
    return rows.select("request_id", normalize.feature_json(with_label=False).alias("features"))


def label_outcome(spark: SparkSession, folder: str) -> DataFrame:
    real = normalize.real_positive()
    return tables.requests(spark, folder).select(
        "request_id",
        real.alias("real_positive"),
        real.cast("bigint").alias("real_count"),
        normalize.real_positive(win_is_positive=True).alias("won"),
    )


# --- training preparation ----------------------------------------------------


def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    return tables.requests(spark, folder).select("request_id", training.hash_part("request_id").alias("part"))


def _indexes(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    return training.indexed(rows, vocabulary).select("request_id", *[F.col(f"{c}_index").cast("bigint").alias(f"{c}_index") for c in training.CATEGORICAL])


def string_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=ROW)
    return _indexes(rows, rows)


def string_index_skip(spark: SparkSession, folder: str) -> DataFrame:
    """Categories known from winning purchases only; rows with others are left out."""
    requests = tables.requests(spark, folder)
    rows = normalize.normalize_training(requests, keep=ROW)
    return _indexes(rows, rows.filter((F.col(LABEL) == 1.0) & (F.col("rtbFloorPriceSent") > 100)))


def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalize.normalize_training(tables.requests(spark, folder))
    return vocabularies.vocabulary(rows, training.CATEGORICAL)


def string_index_joined(spark: SparkSession, folder: str) -> DataFrame:
    """The same indexes by joins, for vocabularies of any size."""
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=ROW)
    rows = training.Encoding.of(rows, training.CATEGORICAL, ()).index(rows)
    return rows.select("request_id", *[F.col(f"{c}_index").cast("bigint").alias(f"{c}_index") for c in training.CATEGORICAL])


def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    """The active slot of each encoded column and the slots it has; the last category has none (-1)."""
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"])
    encoding = training.Encoding.of(rows, training.CATEGORICAL, ())
    encoded = PipelineModel(encoding.stages()[:1]).transform(encoding.index(rows))
    slots = []
    for c in training.CATEGORICAL:
        vector = F.unwrap_udt(f"{c}_vector")
        slot = F.coalesce(F.get(vector["indices"], F.lit(0)), F.lit(-1))
        slots.append(F.struct(F.lit(c).alias("feature"), slot.cast("bigint").alias("slot"), vector["size"].cast("bigint").alias("slots")))
    return encoded.select("request_id", F.inline(F.array(*slots)))


def assembled(spark: SparkSession, folder: str) -> DataFrame:
    """Every request as the regression sees it: how many slots, how many filled, and their sum."""
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"])
    encoding = training.Encoding.of(rows, training.CATEGORICAL, training.NUMERIC)
    ready = encoding.assemble(rows, ["request_id"]).select("request_id", F.unwrap_udt("features").alias("v"))
    # a vector with few zeros is stored whole, and then has no indices
    total = F.aggregate(F.col("v.values"), F.lit(0.0), lambda a, x: a + x)
    filled = F.size(F.filter(F.col("v.values"), lambda x: x != 0.0))
    slots = F.coalesce(F.col("v.size"), F.size(F.col("v.values")))
    return ready.select("request_id", slots.cast("bigint").alias("slots"), filled.cast("bigint").alias("filled"), F.round(total, 4).alias("total"))


def normalize_custom_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The user's own texts for "not available"."""
    rules = {"country": ("", "FRANCE", "CHINA"), "brand": ("Brand#11", "Brand#23"), "gender": ("F", "null")}
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"], rules=rules)
    return rows.select("request_id", "publisherId", "country", "gender", "brand", "conType")


def declared_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that fit a declared schema, and the fields that do not, as rows."""
    rows = normalize.normalize_training(tables.requests(spark, folder))
    declared = T.StructType([*NORMALIZED.fields[1:], T.StructField("publisherId", T.LongType()), T.StructField("feature1", T.StringType())])
    problems = schema_problems(rows, declared)
    named = [F.struct(*[F.lit(v).cast("string").alias(k) for k, v in zip(("field", "declared", "found"), p)]) for p in problems]
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.inline(F.array(*named)))


def _strict(requests: DataFrame) -> tuple[DataFrame, T.StructType]:
    """Raw requests, and their schema with gender, connection type and country declared NOT NULL."""
    strict = ("gender", "connectionType", "country")
    return requests, T.StructType([T.StructField(f.name, f.dataType, f.name not in strict) for f in requests.schema.fields])


def declared_not_null(spark: SparkSession, folder: str) -> DataFrame:
    """Nulls of every declared field, and how many rows are rejected for one where it is NOT NULL."""
    requests, declared = _strict(tables.requests(spark, folder))
    rejected = null_rejects(requests, declared).select("request_id", F.explode("null_fields").alias("field"))
    per_field = rejected.groupBy("field").agg(F.count(F.lit(1)).alias("n_rejected"))
    strict = {f.name: not f.nullable for f in declared.fields}
    known = spark.createDataFrame(list(strict.items()), "field string, not_null boolean")  # one row per field
    profile = null_profile(requests, declared).join(known, "field").join(per_field, "field", "left")
    return profile.select("field", "not_null", "n_rows", "n_null", F.coalesce("n_rejected", F.lit(0).cast("long")).alias("n_rejected"))


def null_rejected_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows against the declaration, with the fields that are null."""
    requests, declared = _strict(tables.requests(spark, folder))
    return null_rejects(requests, declared).select("request_id", F.array_join("null_fields", ",").alias("null_fields"))


# --- scoring -----------------------------------------------------------------


def prepare_status(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows handed to the model as they are, the floor price as text."""
    requests = tables.requests(spark, folder)
    floor = F.when(F.col("brand") == "", "n/a").otherwise(F.col("rtbFloorSent").cast("string"))
    rows = requests.withColumn("rtbFloorPriceSent", floor).withColumnsRenamed(
        {"connectionType": "conType", "withGeoInfo": "withGeo"}
    )
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("withGeo", "withBundleId")})
    return score.prepare(rows, fixed_model()).select("request_id", "status", "failure_reason", "failed_field")


def prepare_missing_field(spark: SparkSession, folder: str) -> DataFrame:
    """No ``age`` column at all: every row fails, none is lost."""
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"]).drop("age")
    return score.score(rows, fixed_model()).select("request_id", "status", "failure_reason", "failed_field", "to_filter")


def _score_columns(scored: DataFrame, id_column: str = "featuresId") -> DataFrame:
    return scored.select(
        "request_id",
        F.col(id_column).alias("features_id"),
        "status",
        "prediction",
        _number("probability_0").alias("probability_0"),
        _number("probability_1").alias("probability_1"),
        "to_filter",
        _number("precision").alias("precision"),
    )


def score_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return _score_columns(_scored(spark, folder))


def score_unlabelled(spark: SparkSession, folder: str) -> DataFrame:
    requests = tables.requests(spark, folder).drop(LABEL)
    return _score_columns(batch.score_unlabelled(requests, fixed_model(), keep=ROW))


def _results(scored: DataFrame, **options) -> DataFrame:
    result = score.with_prediction(scored, **options)
    return result.select("request_id", "result.features_id", "result.to_filter", _number("result.precision").alias("precision"))


def score_default_on_failure(spark: SparkSession, folder: str) -> DataFrame:
    return _results(_scored(spark, folder), default=True)


def prediction_from_class(spark: SparkSession, folder: str) -> DataFrame:
    """The caller's own id instead of the hash; failures stay empty."""
    return _results(_scored(spark, folder), id_column="request_id")


def score_csv_line(spark: SparkSession, folder: str) -> DataFrame:
    done = _scored(spark, folder).filter(F.col("status") == score.OK)
    return done.select("request_id", score.prediction_csv(F.col("to_filter"), F.col("precision")).alias("line"))


def confidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder).select("request_id", "to_filter", "filtered")


def gate_off(spark: SparkSession, folder: str) -> DataFrame:
    return _gated(spark, folder, -1.0).select("request_id", "to_filter", "filtered")


def route_kept(spark: SparkSession, folder: str) -> DataFrame:
    kept, _ = score.route(_scored(spark, folder), 0.7)
    return kept.select("request_id", "status", "to_filter")


def route_filtered(spark: SparkSession, folder: str) -> DataFrame:
    _, filtered = score.route(_scored(spark, folder), 0.7)
    return filtered.select("request_id", "status", "to_filter")


def score_with_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Counted while it is written, next to the sums of what was written."""
    out = scratch_path(spark, "scored")
    counted = batch.score_with_counters(tables.requests(spark, folder), fixed_model(), out, keep=ROW)
    written = spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n_written"), F.count_if("filtered").alias("n_filtered"))
    return _report(counted, F.lit("counted").alias("source")).join(written)  # one row each


def route_written(spark: SparkSession, folder: str) -> DataFrame:
    """Kept and filtered requests from one scoring, each read from its own folder."""
    out = scratch_path(spark, "routed")
    batch.score_with_counters(tables.requests(spark, folder), fixed_model(), out, keep=ROW, route=True)
    parts = [batch.read_route(spark, out, side).select("request_id", "status", "to_filter", F.lit(side).alias("filtered")) for side in (False, True)]
    return parts[0].unionByName(parts[1])


# --- portable models ---------------------------------------------------------


def _fixed_rows(model_date: str, numeric) -> list[tuple]:
    return portable.coefficient_rows(model_date, FIXED_INTERCEPT, numeric, FIXED_CATEGORIES)


def _store(spark: SparkSession) -> str:
    base = scratch_path(spark, "models")
    rows = _fixed_rows(FIXED_DATE, FIXED_NUMERIC) + _fixed_rows(LATER_DATE, LATER_NUMERIC)
    model_store.publish(portable.coefficient_frame(spark, rows), base)
    return base


def coefficient_table_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Each request with the published coefficients of its categories."""
    prepare(spark)
    table = model_store.coefficients(spark, _store(spark), FIXED_DATE).filter(F.col("kind") == portable.CATEGORY)
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=["request_id"])
    for feature in FIXED_CATEGORIES:
        side = table.filter(F.col("feature") == feature).select(
            F.col("category").alias(feature), F.col("coefficient").alias(f"{feature}_coefficient")
        )
        rows = rows.join(join_side(side), feature, "left")
    return rows.select("request_id", *FIXED_CATEGORIES, *[f"{f}_coefficient" for f in FIXED_CATEGORIES])


def score_by_model_date(spark: SparkSession, folder: str) -> DataFrame:
    """The same requests under two published models, side by side, read once."""
    prepare(spark)
    models = dated.load_dated(spark, _store(spark), (FIXED_DATE, LATER_DATE))
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=ROW)
    scored = dated.score_by_date(rows, models)
    return scored.select("model_date", "request_id", "to_filter", _number("precision").alias("precision"))


AS_OF_DATES = ("20240108", "20240119")


def score_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """Each request by the model in force on its day; before the first one there is none."""
    prepare(spark)
    base = scratch_path(spark, "models")
    # the later model does not know the gender
    later = [r for r in _fixed_rows(AS_OF_DATES[1], LATER_NUMERIC) if r[1] != "gender"]
    model_store.publish(portable.coefficient_frame(spark, _fixed_rows(AS_OF_DATES[0], FIXED_NUMERIC) + later), base)
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=ROW)
    scored = dated.score_as_of(rows, dated.load_dated(spark, base, AS_OF_DATES))
    return scored.select("request_id", "model_date", "status", "failure_reason", "to_filter", _number("precision").alias("precision"))


def export_declared(spark: SparkSession, folder: str) -> DataFrame:
    """A trained model exported under a declared schema, whose NOT NULL the rows are held to."""
    rows, _, model = _saturated(spark, folder)
    declared = T.StructType([T.StructField("gender", T.StringType(), nullable=False), T.StructField("publisherId", T.StringType(), nullable=False)])
    return _coefficients(portable.export(spark, model, FIXED_DATE, declared, rows))


def score_large_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """A model whose publisher list is a table of its own, joined instead of inlined."""
    prepare(spark)
    parts = tables.table(spark, folder, "part")
    known = parts.filter(F.col("p_size") % 10 != 0).select(
        F.lit("20240301").alias("model_date"),
        F.lit("publisherId").alias("feature"),
        F.lit(portable.CATEGORY).alias("kind"),
        F.col("p_partkey").cast("string").alias("category"),
        ((F.col("p_size") - 25) / F.lit(50.0)).alias("coefficient"),
    )
    numbers = portable.coefficient_frame(
        spark, portable.coefficient_rows("20240301", -0.5, {"rtbFloorPriceSent": 0.02}, {})
    )
    base = scratch_path(spark, "models")
    model_store.publish(known.unionByName(numbers), base)
    model = model_store.load_scorer(spark, base, "20240301", inline_limit=10)
    return _score_columns(batch.score_labelled(tables.requests(spark, folder), model, keep=ROW))


# --- monitoring --------------------------------------------------------------


def counters_total(spark: SparkSession, folder: str) -> DataFrame:
    return _report(batch.score_and_monitor(tables.requests(spark, folder), fixed_model()))


def counters_by_monitor(spark: SparkSession, folder: str) -> DataFrame:
    report = batch.score_and_monitor(tables.requests(spark, folder), fixed_model(), by=["monitor_id"])
    return _report(report, F.col("monitor_id"))


def counters_intended_polarity(spark: SparkSession, folder: str) -> DataFrame:
    """Winning as the positive outcome and no confidence gate."""
    scored = batch.score_labelled(
        tables.requests(spark, folder),
        fixed_model(),
        outcome=lambda label: normalize.real_positive(label, win_is_positive=True),
    )
    return _report(counters.count_total(scored, threshold=None))


def counters_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    parts = counters.window_counters(_scored(spark, folder), "PT1H", by=["monitor_id"])
    return _report(counters.present(parts), _plain("window_start").alias("window_start"), F.col("monitor_id"))


def counters_default_period(spark: SparkSession, folder: str) -> DataFrame:
    parts = counters.window_counters(_scored(spark, folder))
    return _report(counters.present(parts), _plain("window_start").alias("window_start"))


def _flush_report(windows: DataFrame) -> DataFrame:
    return _report(
        windows, F.col("monitor_id"), _plain("window_start").alias("window_start"), _plain("window_end").alias("window_end")
    )


def counters_flush(spark: SparkSession, folder: str) -> DataFrame:
    return _flush_report(flush.flush_windows(_scored(spark, folder), FLUSH_PERIOD))


def _merged(spark: SparkSession, folder: str, compat: bool) -> DataFrame:
    hours = counters.window_counters(_scored(spark, folder), "PT1H", by=["monitor_id"])
    day = F.to_date("window_start").alias("day")
    return _report(counters.present(counters.merge_counters(hours, [day], compat)), F.col("day"))


def counters_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, compat=False)


def counters_merge_compat(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder, compat=True)


def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    report = batch.score_and_monitor(tables.requests(spark, folder), fixed_model(), by=["monitor_id"])
    return counters.metric_rows(report, ["monitor_id"])


def metrics_log_line(spark: SparkSession, folder: str) -> DataFrame:
    report = batch.score_and_monitor(tables.requests(spark, folder), fixed_model(), by=["monitor_id"])
    return counters.log_lines(report, ["monitor_id"])


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.confusion_matrix(_gated(spark, folder))


def quality_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """Does filtering hit the losing requests? Losing is the positive outcome here."""
    return evaluation.quality(_gated(spark, folder), "real_positive", "filtered", by=["monitor_id"])


def holdout_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Only the test part of the split: the model's class against the label."""
    test = training.hash_split(tables.requests(spark, folder), "request_id").test
    scored = batch.score_labelled(test, fixed_model(), keep=ROW)
    return evaluation.confusion_matrix(scored, LABEL, "prediction")


# --- trained models ----------------------------------------------------------


def _splits(spark: SparkSession, folder: str) -> tuple[DataFrame, training.Splits]:
    rows = normalize.normalize_training(tables.requests(spark, folder), keep=ROW).select(
        *ROW, *NORMALIZED.fieldNames(), LABEL
    )
    return rows, training.hash_split(rows, "request_id")


def train_lr(spark: SparkSession, folder: str) -> DataFrame:
    rows, splits = _splits(spark, folder)
    model = training.fit(splits.train, rows)
    return portable.coefficient_table(spark, model, FIXED_DATE)


def train_wide(spark: SparkSession, folder: str) -> DataFrame:
    rows, splits = _splits(spark, folder)
    return portable.wide_coefficient_table(spark, training.fit_wide(splits.train, rows), FIXED_DATE)


def tune_lr(spark: SparkSession, folder: str) -> DataFrame:
    rows, splits = _splits(spark, folder)
    grid = {"regParam": [0.01, training.REG_PARAM], "elasticNetParam": [0.0, training.ELASTIC_NET_PARAM]}
    return _trials(spark, training.tune(splits, rows, grid))


def _trials(spark: SparkSession, trials: list[training.Trial]) -> DataFrame:
    found = [(t.params["regParam"], t.params["elasticNetParam"], t.area_under_roc) for t in trials]
    shape = "reg_param double, elastic_net_param double, area_under_roc double"
    return spark.createDataFrame(found, shape).withColumn("area_under_roc", _number("area_under_roc"))


# A model of one category without penalty has a closed form: each category's log-odds.
SATURATED = {"categorical": ("gender",), "numeric": ()}
EXACT = {"regParam": 0.0, "elasticNetParam": 0.0, "tol": 1e-12}


def _saturated(spark: SparkSession, folder: str) -> tuple[DataFrame, training.Splits, training.WideModel]:
    rows, splits = _splits(spark, folder)
    return rows, splits, training.fit_wide(splits.train, rows, **SATURATED, params=EXACT)


def _coefficients(table: DataFrame) -> DataFrame:
    return table.select("feature", "kind", "category", F.round("coefficient", 4).alias("coefficient"))


def train_saturated(spark: SparkSession, folder: str) -> DataFrame:
    return _coefficients(portable.wide_coefficient_table(spark, _saturated(spark, folder)[2], FIXED_DATE))


# Two numbers under the fixed penalty: few enough for SQL to fit by Newton's method.
PENALISED = {"categorical": (), "numeric": ("age", "rtbFloorPriceSent")}


def train_penalised(spark: SparkSession, folder: str) -> DataFrame:
    rows, splits = _splits(spark, folder)
    model = training.fit_wide(splits.train, rows, **PENALISED, params={"tol": 1e-12})
    table = portable.wide_coefficient_table(spark, model, FIXED_DATE)
    return table.select("feature", "kind", F.round("coefficient", 5).alias("coefficient"))


OPTIMAL_WITHIN = 1e-4


def train_certificate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the whole fit under the fixed settings is optimal: no coefficient's gradient is off."""
    rows, splits = _splits(spark, folder)
    model = training.fit_wide(splits.train, rows)
    table = cut_lineage(portable.wide_coefficient_table(spark, model, FIXED_DATE), "coefficients")
    left_out = certificate.reference_categories(model.encoding)
    found = certificate.optimality(splits.train, table, training.NUMERIC, training.CATEGORICAL, left_out)
    return found.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_coefficients"), F.count("violation").alias("n_checked"), (F.max("violation") < OPTIMAL_WITHIN).alias("optimal")
    )


def optimality_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """How far the fixed model is from the optimum of the penalised loss, coefficient by coefficient."""
    _, splits = _splits(spark, folder)
    table = portable.coefficient_frame(spark, _fixed_rows(FIXED_DATE, FIXED_NUMERIC))
    found = certificate.optimality(splits.train, table, tuple(FIXED_NUMERIC), tuple(FIXED_CATEGORIES))
    return found.select("feature", "category", *[_number(c).alias(c) for c in ("deviation", "gradient", "violation")])


PATH_MIXING = 0.5


def penalty_path_start(spark: SparkSession, folder: str) -> DataFrame:
    """The steepest gradient of each feature at coefficients of 0, and the largest useful penalty."""
    rows, splits = _splits(spark, folder)
    at_zero = certificate.gradient_at_zero(splits.train, training.Encoding.of(rows, training.CATEGORICAL, training.NUMERIC))
    largest = path.largest_penalty(at_zero, PATH_MIXING)
    steepest = F.max(F.abs("gradient"))
    return at_zero.groupBy("feature").agg(F.count(F.lit(1)).alias("n_coefficients"), _number(steepest).alias("steepest")).withColumn(
        "largest_penalty", F.round(F.lit(largest), 6)
    )


SLOTS = 8


def train_hashed(spark: SparkSession, folder: str) -> DataFrame:
    """Countries in eight slots, without penalty: each slot's learned probability, for every category of the whole table."""
    rows, splits = _splits(spark, folder)
    model = hashed.fit_hashed(splits.train, ("country",), (), SLOTS, params=EXACT)
    learned = model.transform(rows, ["country"]).select("country", vector_to_array("probability")[1].alias("p"))
    return learned.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.max("p"), 4).alias("probability")).withColumn(
        "slot", hashed.slot("country", SLOTS)
    )


def hashed_collisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = normalize.normalize_training(tables.requests(spark, folder))
    return hashed.collisions(rows, training.CATEGORICAL, 64)


def train_pipeline_saturated(spark: SparkSession, folder: str) -> DataFrame:
    """The same fit by the stages of one Spark ML pipeline."""
    rows, splits = _splits(spark, folder)
    model = training.fit(splits.train, rows, **SATURATED, params=EXACT)
    return _coefficients(portable.coefficient_table(spark, model, FIXED_DATE))


def tune_saturated(spark: SparkSession, folder: str) -> DataFrame:
    """No penalty against one that leaves no coefficient, and so no order."""
    rows, splits = _splits(spark, folder)
    grid = {"regParam": [10.0, 0.0], "elasticNetParam": [1.0]}
    return _trials(spark, training.tune(splits, rows, grid, **SATURATED, params={"tol": 1e-12}))


def holdout_saturated(spark: SparkSession, folder: str) -> DataFrame:
    _, splits, model = _saturated(spark, folder)
    found = training.evaluate(model, splits.test)
    shape = ", ".join(f"{name} double" for name in found)
    return spark.createDataFrame([tuple(found.values())], shape).select(*[_number(c).alias(c) for c in found])


def model_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Saved and loaded by date in both forms: the stored pipeline and the published
    coefficients score the test part alike."""
    rows, splits = _splits(spark, folder)
    base, model = scratch_path(spark, "models"), training.fit(splits.train, rows, **SATURATED, params=EXACT)
    model_store.save_pipeline(model, base, FIXED_DATE)
    model_store.publish(portable.coefficient_table(spark, model, FIXED_DATE), base)
    stored = model_store.load_pipeline(base, FIXED_DATE).transform(splits.test)
    stored = stored.select("request_id", F.round(vector_to_array("probability")[1], 4).alias("pipeline_probability"))
    scored = score.score(splits.test, model_store.load_scorer(spark, base, FIXED_DATE))
    scored = scored.select("request_id", F.round("probability_1", 4).alias("published_probability"))
    return stored.join(scored, "request_id")


def split_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each part while the parts are cached, and again after."""
    rows, splits = _splits(spark, folder)
    kept = splits.persist()
    cached = [p.count() for p in (kept.train, kept.cv, kept.test)]
    held = all(p.storageLevel.useMemory and p.storageLevel.useDisk for p in (kept.train, kept.cv, kept.test))
    kept.unpersist()
    later = [p.count() for p in (splits.train, splits.cv, splits.test)]
    found = [(n, a, b, held) for n, a, b in zip(("train", "cv", "test"), cached, later)]
    return spark.createDataFrame(found, "part string, cached_rows long, rows long, was_cached boolean")


def stored_split(spark: SparkSession, folder: str) -> DataFrame:
    """Requests per part of a split drawn once, next to the share each part should have."""
    rows, _ = _splits(spark, folder)
    parts = training.stored_split(rows, scratch_path(spark, "parts"), seed=11)
    named = [p.select("request_id", F.lit(n).alias("part")) for n, p in zip(("train", "cv", "test"), (parts.train, parts.cv, parts.test))]
    drawn = named[0].unionByName(named[1]).unionByName(named[2])
    sizes = drawn.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # three rows
    sizes = sizes.withColumn("n_rows", F.sum("n").over(Window.partitionBy()))
    share = F.when(F.col("part") == "train", 0.8).otherwise(0.1)
    # a part of n rows is off by more than five deviations once in a million draws
    near = F.abs(F.col("n") - share * F.col("n_rows")) <= 5 * F.sqrt(F.col("n_rows") * share * (1 - share))
    return sizes.select("part", "n_rows", near.alias("near_its_share"))


def holdout_fixed(spark: SparkSession, folder: str) -> DataFrame:
    """Exact area under ROC of the fixed model on the scored requests of the test part."""
    scored = batch.score_labelled(training.hash_split(tables.requests(spark, folder), "request_id").test, fixed_model(), keep=ROW)
    return evaluation.area_under_roc(scored.filter("status = 'ok'"), "probability_1", F.col(LABEL) == 1.0).select(
        "positives", "negatives", _number("area_under_roc").alias("area_under_roc")
    )


def score_trained(spark: SparkSession, folder: str) -> DataFrame:
    """Train, publish the coefficients, and score the test part from the table."""
    rows, splits = _splits(spark, folder)
    base = scratch_path(spark, "models")
    model_store.publish(portable.coefficient_table(spark, training.fit(splits.train, rows), FIXED_DATE), base)
    return _score_columns(score.score(splits.test, model_store.load_scorer(spark, base, FIXED_DATE)))


def holdout_trained(spark: SparkSession, folder: str) -> DataFrame:
    rows, splits = _splits(spark, folder)
    found = training.evaluate(training.fit(splits.train, rows), splits.test)
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} double" for name in found))


def random_split(spark: SparkSession, folder: str) -> DataFrame:
    """In how many of the three random parts each request is: exactly one."""
    rows, _ = _splits(spark, folder)
    parts = training.random_split(cut_lineage(rows, "requests"), seed=7)
    drawn = parts.train.unionByName(parts.cv).unionByName(parts.test)
    return drawn.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_parts"))


def trained_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What a trained coefficient table lists: every input and every category seen."""
    return train_lr(spark, folder).select("feature", "kind", "category")


# --- streams -----------------------------------------------------------------

BATCHES, FILES_PER_BATCH = 4, 2


def _request_stream(spark: SparkSession, folder: str, newest_first: bool = False, late: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The requests in files by time, as a stream of one stretch of time per micro-batch; those
    that are ``late`` come with the last one."""
    rows, path = cut_lineage(tables.requests(spark, folder), "requests"), scratch_path(spark, "stream-in")
    micros = F.unix_micros("ts")
    cuts = rows.select(micros.cast("double").alias("t")).approxQuantile("t", [k / BATCHES for k in range(1, BATCHES)], 0.01)
    stretch = F.lit(0)
    for cut in cuts:
        stretch = stretch + (micros >= int(cut)).cast("int")
    if late is not None:
        stretch = F.when(late(rows), BATCHES - 1).otherwise(stretch)
    for k in sorted(range(BATCHES), reverse=newest_first):
        rows.filter(stretch == k).repartition(FILES_PER_BATCH).write.mode("append").parquet(path)
    return stream_scoring.read_requests(spark, path, rows.schema, max_files=FILES_PER_BATCH)


def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    requests, run = _request_stream(spark, folder), scratch_path(spark, "stream-score")
    scored = stream_scoring.score_stream(requests, fixed_model(), keep=ROW)
    query = stream_scoring.start_scoring(requests, fixed_model(), f"{run}/out", f"{run}/checkpoint", keep=ROW)
    query.awaitTermination()
    return _score_columns(spark.read.schema(scored.schema).parquet(f"{run}/out"))


def _counted_stream(spark: SparkSession, folder: str, newest_first: bool = False, **options) -> str:
    requests, run = _request_stream(spark, folder, newest_first), scratch_path(spark, "stream-counters")
    scored = stream_scoring.score_stream(requests, fixed_model(), keep=ROW)
    stream_counters_.start_counters(scored, f"{run}/out", f"{run}/checkpoint", "PT1H", ["monitor_id"], **options).awaitTermination()
    return run


def _stream_report(spark: SparkSession, run: str) -> DataFrame:
    report = counters.present(stream_counters_.stream_report(spark, f"{run}/out", ["monitor_id"]))
    return _report(report, _plain("window_start").alias("window_start"), F.col("monitor_id"))


def stream_counters(spark: SparkSession, folder: str) -> DataFrame:
    return _stream_report(spark, _counted_stream(spark, folder, compact_every=2))


def stream_counters_late(spark: SparkSession, folder: str) -> DataFrame:
    """The newest requests come first, so that all others are late, up to a month."""
    return _stream_report(spark, _counted_stream(spark, folder, newest_first=True))


def stream_metric_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Named metrics as a sink of the user's own gets them: added up, each request counts once."""
    deltas = scratch_path(spark, "metrics")

    def sink(report: DataFrame, batch_id: int) -> None:
        counters.metric_rows(report, ["monitor_id"]).write.mode("overwrite").parquet(f"{deltas}/batch_id={batch_id}")

    _counted_stream(spark, folder, sink=sink)
    return spark.read.parquet(deltas).groupBy("monitor_id", "metric").agg(F.sum("value").alias("value"))


def _late(rows: DataFrame) -> Column:
    """Every fiftieth request of the first eighth of the time comes late."""
    first, last = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return (F.col("request_id") % 50 == 0) & ((F.unix_micros("ts") - int(first or 0)) * 8 < int((last or 0) - (first or 0)))


def stream_period_once(spark: SparkSession, folder: str) -> DataFrame:
    """Each hour of each monitor reported once over four batches, what came too late as corrections,
    and the hours that have not ended by the stream's clock, a day behind."""
    scored = stream_scoring.score_stream(_request_stream(spark, folder, late=_late), fixed_model(), keep=ROW)
    run, by = scratch_path(spark, "stream-periods"), ["monitor_id"]
    where = f"{run}/out", f"{run}/checkpoint", "PT1H"
    stream_periods.start_periods(scored, *where, by, delay="P1D", remember="P365D").awaitTermination()
    still_open = stream_periods.open_periods(spark, where[1], "monitor_id string").withColumn("kind", F.lit("open"))
    rows = stream_periods.period_reports(spark, where[0]).unionByName(still_open)
    grouped = rows.groupBy("window_start", *by, "kind").agg(F.count(F.lit(1)).alias("n_reports"), *counters.counter_sums())
    return _report(counters.present(grouped), _plain("window_start").alias("window_start"), F.col("monitor_id"), F.col("kind"), F.col("n_reports"))


def sink_switches(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that the report sink writes under each setting of its two switches."""
    report = counters.present(counters.window_counters(_scored(spark, folder), "P7D", by=["monitor_id"]))
    found = []
    for metrics, log in ((True, True), (True, False), (False, True), (False, False)):
        path = scratch_path(spark, "report")
        sinks.report_sink(path, EngineConfig(metric_monitoring=metrics, send_metric_logging=log), ["window_start", "monitor_id"])(report, 0)
        sinks.no_sink(report, 0)
        written = written_folders(spark, f"{path}/metrics"), written_folders(spark, f"{path}/log")
        n_metrics = spark.read.parquet(f"{path}/metrics").count() if written[0] else 0
        n_lines = spark.read.text(f"{path}/log").count() if written[1] else 0
        found.append((metrics, log, n_metrics, n_lines))
    return spark.createDataFrame(found, "metric_monitoring boolean, send_metric_logging boolean, metric_rows long, log_lines long")


def counters_null_ts(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth request has no time: it is counted in a window without a start."""
    scored = _scored(spark, folder).withColumn("ts", F.when(F.col("request_id") % 10 != 0, F.col("ts")))
    report = counters.present(counters.window_counters(scored, "P1D"))
    return _report(report, _plain("window_start").alias("window_start"))


def stream_flush(spark: SparkSession, folder: str) -> DataFrame:
    scored = stream_scoring.score_stream(_request_stream(spark, folder), fixed_model(), keep=ROW)
    run = scratch_path(spark, "stream-flush")
    stream_flush_.start_flush(scored, f"{run}/out", f"{run}/checkpoint", FLUSH_PERIOD).awaitTermination()
    return _flush_report(stream_flush_.closed_windows(spark, f"{run}/out"))


QUERIES: dict[str, Query] = {
    query.__name__.removesuffix("_query"): query
    for query in (
        feature_select, csv_parse, csv_rejects, csv_accounting,
        normalize_training, normalize_prediction, normalize_unified, normalize_mixed, normalize_defaults, normalize_custom_rules,
        features_id_query, feature_map_json, label_outcome, declared_schema, declared_not_null, null_rejected_rows,
        hash_split, vocabulary, string_index, string_index_skip, string_index_joined, one_hot, assembled,
        prepare_status, prepare_missing_field, score_fixed, score_unlabelled, score_default_on_failure,
        prediction_from_class, score_csv_line, confidence_gate, gate_off, route_kept, route_filtered, route_written, score_with_counters,
        coefficient_table_lookup, score_by_model_date, score_as_of, score_large_vocabulary,
        counters_total, counters_by_monitor, counters_intended_polarity, counters_tumbling, counters_default_period, counters_null_ts,
        counters_flush, counters_merge, counters_merge_compat, metrics_long, metrics_log_line, sink_switches,
        confusion_matrix, quality_ratios, holdout_confusion, holdout_fixed,
        train_lr, trained_fields, train_wide, tune_lr, score_trained, holdout_trained, random_split, stored_split, split_sizes,
        train_saturated, train_pipeline_saturated, export_declared, train_penalised, train_certificate, optimality_fixed, penalty_path_start, train_hashed, hashed_collisions, tune_saturated, holdout_saturated, model_round_trip,
        stream_score, stream_counters, stream_counters_late, stream_metric_deltas, stream_period_once, stream_flush,
    )
}
