"""Table sources: plain parquet tables, feature selects, and the sample request view."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqsieve.session import prepare
from reqsieve.sizing import join_side


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def select_features(df: DataFrame, features: Sequence[str] | str, table_name: str = "features") -> DataFrame:
    """The model's columns of ``df``: a column list, or a SELECT over ``table_name``."""
    if isinstance(features, str):
        df.createOrReplaceTempView(table_name)
        return df.sparkSession.sql(features)
    return df.select(*features)


def requests(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """One labelled request per event of the sample tables.

    ``events`` may be a stream; the other tables are static. Event ``i`` looks up
    part ``i`` modulo the number of parts; that side is broadcast where it is
    counted small. Orders, customers and events are joined on their own keys, which Spark
    sorts and merges, or broadcasts where the statistics allow.
    """
    prepare(spark)
    e = table(spark, folder, "events") if events is None else events
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_size")
    n_parts = max(1, parts.count())  # from the file footers
    e = e.selectExpr("event_id", "ts", "user_id", "event_type", "value", f"event_id % {n_parts} AS part_key")
    # Nations are 25 rows; Spark broadcasts them by its own size check.
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    buyers = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_orderstatus", "o_orderpriority", "n_nationkey", "n_name")
    )
    joined = e.join(join_side(parts), F.col("part_key") == F.col("p_partkey")).join(
        buyers, F.col("event_id") == F.col("o_orderkey")
    )
    return joined.selectExpr(
        "event_id AS request_id",
        "CAST(ts AS TIMESTAMP) AS ts",
        "concat('m', user_id % 4) AS monitor_id",
        "p_partkey AS publisherId",
        "CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS country",
        "p_size AS age",
        "CASE WHEN event_type = 'view' THEN 'null' WHEN event_type <> 'error' THEN o_orderstatus END AS gender",
        "CASE WHEN p_size % 7 = 0 THEN '' ELSE p_brand END AS brand",
        "(p_size % 5 + 1) * 50 AS height",
        "(p_size % 3 + 1) * 320 AS width",
        "CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '(null)' "
        "WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS connectionType",
        "event_id % 2 = 0 AS withBundleId",
        "user_id % 3 = 0 AS withGeoInfo",
        "value AS rtbFloorSent",
        "CAST(event_type = 'purchase' OR value > 60 AS DOUBLE) AS isWinning",
    )
