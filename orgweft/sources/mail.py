"""mbox files, split into messages by the text reader, headers decoded per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC
from email import message_from_bytes
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from orgweft.schemas import EMAIL_ROW, conform

MESSAGE = (
    "file STRING, block BIGINT, place BIGINT, message_id STRING, epoch BIGINT, "
    "senders ARRAY<STRING>, recipients ARRAY<STRING>, in_reply_to STRING, subject STRING, "
    "body STRING"
)


def _header_addresses(message: Message, *names: str) -> list[str]:
    values = [str(value) for name in names for value in message.get_all(name, ())]
    found = {address.lower() for _name, address in getaddresses(values) if "@" in address}
    return sorted(found)


def _bare_id(value: object) -> str | None:
    text = "" if value is None else str(value).strip()
    return text.removeprefix("<").removesuffix(">") or None


def _sent_epoch(message: Message) -> int | None:
    try:
        sent = parsedate_to_datetime(str(message["Date"]))
    except (TypeError, ValueError):
        return None
    return int((sent if sent.tzinfo else sent.replace(tzinfo=UTC)).timestamp())


def _first_text(message: Message) -> str | None:
    for part in message.walk():
        if part.get_content_type() == "text/plain":
            raw = part.get_payload(decode=True)
            if not isinstance(raw, bytes):
                return None
            try:
                text = raw.decode(part.get_content_charset() or "utf-8", errors="replace")
            except LookupError:
                text = raw.decode("utf-8", errors="replace")
            return text.strip() or None
    return None


def _decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Header fields of each message; ``place`` counts messages of a file block in file order."""
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        out = []
        for file, block, raw in zip(batch["file"], batch["block"], batch["raw"], strict=True):
            place = seen.get((file, block), 0)
            seen[(file, block)] = place + 1
            # The first line is the envelope line, with or without its "From ".
            message = message_from_bytes(bytes(raw).partition(b"\n")[2])
            subject = message["Subject"]
            out.append(
                (
                    file,
                    block,
                    place,
                    _bare_id(message["Message-ID"]),
                    _sent_epoch(message),
                    _header_addresses(message, "from"),
                    _header_addresses(message, "to", "cc"),
                    _bare_id(message["In-Reply-To"]),
                    None if subject is None else str(subject),
                    _first_text(message),
                )
            )
        columns = [part.split(" ")[0] for part in MESSAGE.split(", ")]
        yield pd.DataFrame(out, columns=columns).astype({"epoch": "Int64"})


def read_mailbox(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Decoded messages of ``paths``; large files are read by several tasks.

    A message without an id is named by its file and its number in the file. The number
    is its place in the file block plus the messages of the blocks before. Files of one name
    in several folders are told apart by their paths.
    """
    text = spark.read.option("lineSep", "\nFrom ").text(paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("raw"),
    ).where(F.length("raw") > 0)
    decoded = text.drop("name").mapInPandas(_decode, MESSAGE)
    sizes = text.groupBy("file", "name", "block").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "file", "name", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    fallback = F.concat_ws(":", "name", (F.col("start") + F.col("place")).cast("string"))
    return decoded.join(starts, ["file", "block"]).withColumn(
        "message_id", F.coalesce("message_id", fallback)
    )


def mail_rows(
    messages: DataFrame,
    *,
    message_modules: DataFrame | None = None,
    ignore_addresses: DataFrame | None = None,
    skip_senders: DataFrame | None = None,
) -> DataFrame:
    """Email rows. Side inputs: ``message_id, module``; ``address``; ``address``.

    The parent's sender is looked up before automated senders are dropped. Broadcasts
    without recipient or thread, and mails without a date, are left out.
    """
    sent = messages.withColumn("from_id", F.try_element_at("senders", F.lit(1))).where(
        "from_id IS NOT NULL"
    )
    senders = sent.groupBy(F.col("message_id").alias("in_reply_to")).agg(
        F.max_by("from_id", F.struct("file", "block", "place")).alias("parent_author_id")
    )
    linked = sent.join(senders, "in_reply_to", "left")
    if skip_senders is not None:
        skipped = skip_senders.select(F.lower("address").alias("from_id"))
        linked = linked.join(skipped, "from_id", "left_anti")
    if ignore_addresses is not None:
        people = (
            linked.select("file", "block", "place", F.explode("recipients").alias("address"))
            .join(ignore_addresses.select(F.lower("address").alias("address")), "address", "left_anti")
            .groupBy("file", "block", "place")
            .agg(F.array_sort(F.collect_set("address")).alias("people"))
        )
        linked = linked.join(people, ["file", "block", "place"], "left").withColumn(
            "recipients", F.coalesce("people", F.array().cast("array<string>"))
        )
    personal = (
        (F.size("recipients") > 0)
        | F.col("parent_author_id").isNotNull()
        | F.col("in_reply_to").isNotNull()
    )
    kept = linked.where(personal & F.col("epoch").isNotNull())
    if message_modules is not None:
        listed = message_modules.groupBy("message_id").agg(
            F.array_sort(F.collect_set("module")).alias("module_keys")
        )
        kept = kept.join(listed, "message_id", "left")
    else:
        kept = kept.withColumn("module_keys", F.array().cast("array<string>"))
    return conform(
        kept.select(
            F.col("message_id").alias("id"),
            F.col("epoch").alias("occurred_at_epoch"),
            "from_id",
            F.col("recipients").alias("to_ids"),
            F.col("in_reply_to").alias("in_reply_to_id"),
            "parent_author_id",
            "subject",
            "body",
            F.coalesce("module_keys", F.array().cast("array<string>")).alias("module_keys"),
        ),
        EMAIL_ROW,
    )


def mbox_rows(spark: SparkSession, paths: str | list[str], **side_inputs: DataFrame) -> DataFrame:
    return mail_rows(read_mailbox(spark, paths), **side_inputs)
