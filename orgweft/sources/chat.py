"""Slack-style export folders: one folder per channel, one JSON array per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.functions.text import mentions
from orgweft.schemas import SLACK_ROW, conform
from orgweft.session import stored

# Values are read as text first: a user id that is not a JSON string is not an id.
MESSAGE = "user STRING, ts STRING, thread_ts STRING, text STRING"


def write_chat_days(days: DataFrame, folder: str) -> None:
    """One folder per channel with one file, from ``channel, value`` with one row per channel.

    Tasks write the files themselves: Spark's writer takes tens of milliseconds for each folder of a
    partition column. A file gets its name when it is whole, so that a task can run again.
    """

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        local = folder.startswith("file:")
        target, root = fs.FileSystem.from_uri("/" + folder.removeprefix("file:").lstrip("/") if local else folder)
        for batch in batches:
            for row in batch.to_pylist():
                place = f"{root}/{row['channel']}"
                target.create_dir(place, recursive=True)
                part = f"{place}/.{uuid.uuid4().hex}"
                with target.open_output_stream(part, compression=None) as out:
                    out.write(row["value"].encode() + b"\n")
                target.move(part, f"{place}/day.json")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    days.select("channel", "value").mapInArrow(write, "n BIGINT").agg(F.sum("n")).collect()


def read_chat_export(spark: SparkSession, folder: str) -> DataFrame:
    """``channel, user, ts, thread_ts, text`` of every message written by a user."""
    rows = spark.read.schema(MESSAGE).option("multiLine", True).json(f"{folder}/*/*.json")
    channel = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)
    return rows.withColumn("channel", F.url_decode(channel)).where("user IS NOT NULL")


def chat_rows(messages: DataFrame, channel_modules: DataFrame | None = None) -> DataFrame:
    """Slack rows with thread parents resolved inside the export.

    A parent that is not in the export keeps its id, and the gap operators find it.
    ``channel_modules``: channel, module.
    """
    stamp = F.trim("ts")
    plain = messages.select("channel", F.trim("user").alias("author_id"), stamp.alias("ts"), "thread_ts", "text")
    authors = (
        plain.groupBy(F.col("channel"), F.col("ts").alias("thread_ts"))
        .agg(F.max("author_id").alias("parent_author_id"))
    )
    is_reply = F.col("thread_ts").isNotNull() & (F.col("thread_ts") != F.col("ts"))
    linked = plain.withColumn("thread_ts", F.when(is_reply, F.col("thread_ts"))).join(
        authors, ["channel", "thread_ts"], "left"
    )
    if channel_modules is not None:
        listed = channel_modules.groupBy("channel").agg(
            F.array_sort(F.collect_set("module")).alias("module_keys")
        )
        linked = linked.join(listed, "channel", "left")
    else:
        linked = linked.withColumn("module_keys", F.array().cast("array<string>"))
    return conform(
        linked.select(
            F.concat_ws("-", "channel", "ts").alias("id"),
            F.floor(F.col("ts").cast("decimal(38,9)")).cast("bigint").alias("occurred_at_epoch"),
            "author_id",
            F.when(
                F.col("thread_ts").isNotNull(), F.concat_ws("-", "channel", "thread_ts")
            ).alias("thread_parent_id"),
            "parent_author_id",
            F.coalesce(mentions(F.col("text")), F.array().cast("array<string>")).alias("mentions"),
            F.coalesce("module_keys", F.array().cast("array<string>")).alias("module_keys"),
            "text",
        ),
        SLACK_ROW,
    )


def slack_export_rows(
    spark: SparkSession, folder: str, channel_modules: DataFrame | None = None
) -> DataFrame:
    return chat_rows(stored(read_chat_export(spark, folder), "messages"), channel_modules)
