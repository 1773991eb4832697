from types import SimpleNamespace

import pytest

from reqsieve import session
from reqsieve.sizing import fits, join_side


def fake(master, setting=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: setting))


def test_the_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark) == folder
    assert session.scratch_path(spark, "x").startswith(folder)
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("yarn"))
    assert session.shared_dir(fake("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert session.shared_dir(fake("local[8]")).startswith("/tmp/run-")


def test_written_tables_keep_their_rows_and_types(spark):
    frame = spark.range(1000).selectExpr("id", "cast(id as string) s", "struct(id as a) t", "cast(null as timestamp) n")
    again = session.cut_lineage(frame, "t")
    assert again.dtypes == frame.dtypes and again.exceptAll(frame).count() == 0 and again.count() == 1000
    assert "Range" not in again._jdf.queryExecution().executedPlan().toString()


def test_a_folder_of_one_machine_is_refused_on_a_cluster():
    with pytest.raises(RuntimeError, match="all executors share"):
        session.shared_dir(fake("spark://host:7077", "file:///tmp/x"))
    assert session.shared_dir(fake("local-cluster[2,1,1024]", "file:///tmp/x")) == "file:///tmp/x"


def test_scratch_tables_go_with_their_block(spark):
    with session.Scratch(spark, "block") as scratch:
        assert scratch.table(spark.range(10), "a").count() == 10
        assert session.written_folders(spark, scratch.folder) == ["1-a"]
    assert session.written_folders(spark, scratch.folder) == []
    with pytest.raises(ValueError):
        with session.Scratch(spark, "block") as scratch:
            scratch.table(spark.range(10), "a")
            raise ValueError
    assert session.written_folders(spark, scratch.folder) == []


def test_broadcast_only_what_was_counted_small(spark):
    frame = spark.range(100)
    assert fits(frame, 800) and not fits(frame, 799)
    texts = spark.createDataFrame([("x" * 1000, [1, 2], None)], "a string, b array<int>, c string")
    assert fits(texts, 1100) and not fits(texts, 1020)
    assert "broadcast" in join_side(frame, 800)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in join_side(frame, 799)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in join_side(frame, 800, known_bytes=801)._jdf.queryExecution().logical().toString()
    assert spark.conf.get("spark.sql.adaptive.forceOptimizeSkewedJoin") == "true"
