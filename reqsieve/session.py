"""Session settings the jobs rely on, and where they may write scratch tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

_HOT_KEYS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the join's partitioning would save a later
    # shuffle: a join followed by a grouping on the same key.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def _set(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    for key, value in settings.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def split_hot_keys(spark: SparkSession) -> SparkSession:
    """Let Spark split the partition of a hot key in shuffle joins."""
    return _set(spark, _HOT_KEYS)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results and plans depend on: UTC clock, skew joins, and how many
    rows Python gets at once, which bounds its memory where rows are whole texts."""
    ship_package(spark)
    return split_hot_keys(_set(spark, {"spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}))


_SHIPPED = "reqsieve.shipped"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python this package, once per application."""
    context, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(context, _SHIPPED, False) or not root.is_dir():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    folder = tempfile.TemporaryDirectory()  # Spark serves it from here as long as the application runs
    path = Path(folder.name, "reqsieve.zip")
    path.write_bytes(packed.getvalue())
    context.addPyFile(str(path))
    setattr(context, _SHIPPED, folder)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting gets a folder of its own; on
    a cluster a missing setting is an error, since a machine-local folder would
    be lost with its machine.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    if not context.master.startswith("local") and folder.startswith("file:"):
        raise RuntimeError(f"spark.checkpoint.dir is {folder}; set it to a folder all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run's table under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    Later steps do not recompute it, a lost executor costs nothing, and parquet
    keeps it small and lets each reader take only its columns.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _location(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this run from the shared folder."""
    at, files = _location(spark, path)
    files.delete(at, True)


def written_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished tables inside a folder of any Hadoop file system."""
    at, files = _location(spark, path)
    if not files.exists(at):
        return []
    names = [status.getPath().getName() for status in files.listStatus(at) if status.isDirectory()]
    return [n for n in names if files.exists(_location(spark, f"{path}/{n}/_SUCCESS")[0])]


class Scratch:
    """The intermediate tables of one computation; they go when it ends.

    What outlives the block must have been written elsewhere, e.g. by ``cut_lineage``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.count = spark, scratch_path(spark, name), 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Like ``cut_lineage``."""
        self.count += 1
        path = f"{self.folder}/{self.count}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        remove(self.spark, self.folder)
