"""Commit logs written with record separators, and the mapping of paths to modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.functions.text import trailer_dependencies
from orgweft.schemas import COMMIT_ROW, conform
from orgweft.session import FEW, stored

# Separators of the log format.
RECORD_SEPARATOR, FIELD_SEPARATOR = "\x1e", "\x1f"


def ancestors(path: Column) -> Column:
    """The path and every folder above it: ``a/b/c`` gives ``a``, ``a/b``, ``a/b/c``."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda _part, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))


def path_modules(paths: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``id, module_keys`` from ``id, path`` and ``prefix, module``.

    A path belongs to a prefix that equals it or one of its folders, which makes the
    prefix test an equi join. Where the prefixes were counted and found few, the steps meet them
    before any shuffle.
    """
    bases = prefixes.select(F.regexp_replace("prefix", "/+$", "").alias("base"), "module").distinct()
    steps = paths.select("id", F.explode(ancestors(F.col("path"))).alias("base"))
    if bases.limit(FEW + 1).count() <= FEW:
        bases = F.broadcast(bases)
    else:
        steps = steps.distinct()
    return (
        steps.join(bases, "base")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("module")).alias("module_keys"))
    )


def read_git_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per commit block. Logs without record separators are split at blank lines."""
    lines = spark.read.text(path)
    marked = not lines.where(F.contains("value", F.lit(RECORD_SEPARATOR))).isEmpty()
    separator = RECORD_SEPARATOR if marked else "\n\n"
    return spark.read.option("lineSep", separator).text(path)


def commit_blocks(blocks: DataFrame) -> DataFrame:
    """``sha, occurred_at_epoch, author_id, message, paths, dependency_keys`` per block."""
    every = F.transform(F.split("value", r"\r\n|[\n\r]"), lambda line: F.trim(F.regexp_replace(line, "^[\\t ]+|[\\t ]+$", "")))
    lines = F.filter(every, lambda line: F.length(line) > 0)
    rows = blocks.where(F.col("value").rlike(r"[^\t\n\r ]")).select(lines.alias("lines"))
    split = rows.select(
        F.split(F.get("lines", F.lit(0)), FIELD_SEPARATOR).alias("head"),
        F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))).alias("rest"),
    )
    is_path = lambda line: F.contains(line, F.lit("/")) | (
        F.contains(line, F.lit(".")) & ~F.contains(line, F.lit(" "))
    )
    body = F.concat(F.array(F.coalesce(F.get("head", F.lit(4)), F.lit(""))), F.filter("rest", lambda x: ~is_path(x)))
    short = F.raise_error(F.lit("a commit header must hold sha, epoch, author and subject"))
    return split.select(
        F.when(F.size("head") >= 4, F.get("head", F.lit(0))).otherwise(short.cast("string")).alias("sha"),
        F.get("head", F.lit(1)).cast("bigint").alias("occurred_at_epoch"),
        F.lower(F.get("head", F.lit(2))).alias("author_id"),
        F.get("head", F.lit(3)).alias("message"),
        F.filter("rest", is_path).alias("paths"),
        trailer_dependencies(F.array_join(body, "\n")).alias("dependency_keys"),
    )


def git_log_rows(spark: SparkSession, path: str, prefixes: DataFrame) -> DataFrame:
    """Commit rows. ``prefixes``: prefix, module."""
    commits = stored(commit_blocks(read_git_log(spark, path)), "commits")
    touched = path_modules(
        commits.select(F.col("sha").alias("id"), F.explode("paths").alias("path")), prefixes
    ).withColumnRenamed("id", "sha")
    joined = commits.join(touched, "sha", "left")
    return conform(
        joined.withColumn(
            "module_keys", F.coalesce("module_keys", F.array().cast("array<string>"))
        ),
        COMMIT_ROW,
    )
