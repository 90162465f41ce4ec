"""Session settings and the lineage cut that the graph loops use."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app_name: str = "orgweft", **conf: str) -> SparkSession:
    """A session with the settings every operator here assumes.

    UTC keeps epochs equal on every machine. Adaptive execution sizes the shuffles,
    splits skewed join partitions and switches to a broadcast only after it has
    measured the side, so the library itself gives no broadcast hints.
    """
    builder = SparkSession.builder.appName(app_name)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make a scratch one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="orgweft-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and return the stored rows.

    The result has no lineage, and lost executors cost no recomputation.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scalar(df: DataFrame, value: Column) -> Column:
    """One aggregate of ``df`` as a scalar subquery, usable in any other frame."""
    return df.select(value.alias("value")).scalar()


def empty_like(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


FEW = 500_000


def few(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast in joins if it was counted and found to have few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, where every executor can write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a scan of it.

    Every later operator then reads only the columns and partitions it needs instead of
    running the steps before it again, and lost executors cost no recomputation.
    """
    path = shared_folder(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by is None:
        writer.parquet(path)
    else:
        with _several_writers(df.sparkSession):
            writer.partitionBy(partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def _several_writers(spark: SparkSession) -> Iterator[None]:
    """A task writes a few partitions side by side, instead of sorting its whole rows by them."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name, None)
    spark.conf.set(name, 8)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Their Python workers import it by name, and see neither the driver's folder nor its path.
    Sessions of ``session`` have it; others need it where the package is not installed on
    every machine. The archive lies in the shared folder, where each executor fetches it.
    """
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, f"{package.name}/{file.relative_to(package)}")
    path = f"{shared_folder(spark, 'package')}/{package.name}.zip"
    place, store = _place(spark, path)
    out = store.create(place)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(place.makeQualified(store.getUri(), store.getWorkingDirectory()).toString())
    _SHIPPED.add(application)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, store = _place(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place, store = _place(spark, path)
    store.delete(place, True)


class Scratch:
    """Stored steps of one piece of work, removed together at its end.

    Nothing that is read after the ``with`` block may still depend on them.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []
        self.steps: dict[str, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_error: object) -> None:
        for path in self.paths:
            remove(self.spark, path)

    def step(self, df: DataFrame, name: str) -> DataFrame:
        """``keep`` for a loop: the step before of the same name is removed."""
        before = self.steps.get(name)
        kept = self.keep(df, name)
        self.steps[name] = self.paths[-1]
        if before is not None:
            remove(self.spark, before)
            self.paths.remove(before)
        return kept

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written once and read again, like ``stored``."""
        path = shared_folder(self.spark, name)
        self.paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
