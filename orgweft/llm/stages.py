"""Stage boundaries of the operators in this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from orgweft.session import shared_folder
from orgweft.session import stored as store

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The shuffle files behind it are released with the write, as nothing reads them again;
    an operator of several stages then needs the disk of its largest stage only.
    """
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        return store(df, name)
    finally:
        spark.conf.set(_CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporary(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` written once like ``stored``, for steps that store their own results; the folder is
    removed behind them, so nothing that is read later may still depend on it.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    try:
        yield spark.read.schema(df.schema).parquet(path).select(*df.columns)
    finally:
        remove(spark, path)
