"""Ticket exports as CSV and wiki exports as XML."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.functions.text import blank_to_null, clean_list, iso_epoch, ticket_epoch
from orgweft.schemas import TICKET_ROW, conform

# Column names accepted in ticket exports; the first filled one wins.
KEY_FIELDS = ("Issue key", "key", "Key")
CREATED_FIELDS = ("Created", "created")
REPORTER_FIELDS = ("Reporter", "reporter_id", "reporter")
SUMMARY_FIELDS = ("Summary", "summary", "title")
DESCRIPTION_FIELDS = ("Description", "description")
MODULE_FIELDS = ("Component/s", "components", "Components")
# Column names accepted in issue exports.
NUMBER_FIELDS = ("number", "Number", "issue_number")
TITLE_FIELDS = ("title", "Title")
BODY_FIELDS = ("body", "Body")
ISSUE_CREATED_FIELDS = ("created_at", "Created At", "created")
USER_FIELDS = ("user", "User", "author", "Author")
LABELS_FIELDS = ("labels", "Labels")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quoted cells may span lines."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )


def _named(df: DataFrame, names: tuple[str, ...] | str) -> list[Column]:
    """Columns of the given names in order; repeated headers carry a number after the name."""
    wanted = (names,) if isinstance(names, str) else names
    found = []
    for name in wanted:
        for column in df.columns:
            plain = column.lstrip("﻿").strip()
            repeated = plain.startswith(name) and re.fullmatch(r"\d+", plain[len(name) :])
            if plain == name or repeated:
                found.append(F.col(f"`{column}`"))
    return found


def _first(df: DataFrame, names: tuple[str, ...] | str) -> Column:
    values = [blank_to_null(column) for column in _named(df, names)]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def _required(value: Column, name: str) -> Column:
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.lit(f"ticket column {name!r} is required")).cast("string")
    )


def jira_rows(
    table: DataFrame,
    *,
    key_field: tuple[str, ...] | str = KEY_FIELDS,
    created_field: tuple[str, ...] | str = CREATED_FIELDS,
    reporter_field: tuple[str, ...] | str = REPORTER_FIELDS,
    module_field: tuple[str, ...] | str = MODULE_FIELDS,
) -> DataFrame:
    """Ticket rows; a row without key, date or reporter is an error, an empty row is not."""
    every = F.array(*[F.col(f"`{column}`") for column in table.columns])
    filled = table.where(F.exists(every, lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0)) > 0))
    modules = _named(table, module_field)
    parts = F.split(F.concat_ws(",", *modules), "[,;]") if modules else F.array().cast("array<string>")
    created = _required(_first(table, created_field), "created")
    epoch = ticket_epoch(created)
    unreadable = F.raise_error(F.concat(F.lit("unrecognised ticket date "), created)).cast("bigint")
    return conform(
        filled.select(
            _required(_first(table, key_field), "key").alias("id"),
            F.coalesce(epoch, unreadable).alias("occurred_at_epoch"),
            _required(_first(table, reporter_field), "reporter").alias("reporter_id"),
            _first(table, SUMMARY_FIELDS).alias("title"),
            _first(table, DESCRIPTION_FIELDS).alias("body"),
            clean_list(parts).alias("module_keys"),
        ),
        TICKET_ROW,
    )


def jira_csv_rows(spark: SparkSession, path: str, **fields) -> DataFrame:
    return jira_rows(read_csv(spark, path), **fields)


def issue_rows(
    table: DataFrame, *, repo_module: str | None = None, label_modules: DataFrame | None = None
) -> DataFrame:
    """Ticket rows of issues; rows without number, date or user are left out.

    Labels are separated by ``;`` or ``,``. ``label_modules``: label, module.
    """
    plain = table.select(
        _first(table, NUMBER_FIELDS).alias("number"),
        iso_epoch(_first(table, ISSUE_CREATED_FIELDS)).alias("occurred_at_epoch"),
        _first(table, USER_FIELDS).alias("reporter_id"),
        _first(table, TITLE_FIELDS).alias("title"),
        _first(table, BODY_FIELDS).alias("body"),
        clean_list(F.split(_first(table, LABELS_FIELDS), "[;,]")).alias("labels"),
    ).where("number IS NOT NULL AND occurred_at_epoch IS NOT NULL AND reporter_id IS NOT NULL")
    keyed = plain.withColumn("id", F.concat(F.lit("github-issue-"), F.col("number")))
    own = F.array(F.lit(repo_module)) if repo_module else F.array().cast("array<string>")
    modules = own
    if label_modules is not None:
        mapped = label_keys(keyed.select("id", "labels"), label_modules)
        keyed = keyed.join(mapped, "id", "left")
        modules = F.concat(own, F.coalesce("mapped", F.array().cast("array<string>")))
    return conform(
        keyed.withColumn("module_keys", F.array_sort(F.array_distinct(modules))), TICKET_ROW
    )


def label_keys(rows: DataFrame, label_modules: DataFrame) -> DataFrame:
    """``id, mapped``: modules of the row's labels."""
    return (
        rows.select("id", F.explode("labels").alias("label"))
        .join(label_modules, "label")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set("module")).alias("mapped"))
    )


def github_csv_rows(spark: SparkSession, path: str, **kw) -> DataFrame:
    return issue_rows(read_csv(spark, path), **kw)


WIKI_OBJECT = (
    "_class STRING, id STRING, property ARRAY<STRUCT<_VALUE: STRING, _name: STRING>>"
)


def confluence_xml_rows(
    spark: SparkSession, path: str, space_modules: DataFrame | None = None
) -> DataFrame:
    """Ticket rows of wiki pages and comments; a comment's title is its text.

    Objects without creator or readable date are left out. ``space_modules``: space, module.
    """
    raw = (
        spark.read.format("xml")
        .schema(WIKI_OBJECT)
        .option("rowTag", "object")
        .option("mode", "DROPMALFORMED")
        .load(path)
        .where(F.col("_class").isin("Page", "Comment"))
    )
    prop = lambda name: blank_to_null(
        F.try_element_at(F.filter("property", lambda p: p["_name"] == name), F.lit(1))["_VALUE"]
    )
    plain = raw.select(
        F.coalesce(F.trim("id"), F.lit("")).alias("id"),
        iso_epoch(F.regexp_replace(prop("creationDate"), r"\.0$", "")).alias("occurred_at_epoch"),
        prop("creatorName").alias("reporter_id"),
        prop("title").alias("text"),
        F.when(F.col("_class") == "Page", prop("space")).alias("space"),
        (F.col("_class") == "Page").alias("is_page"),
    ).where("reporter_id IS NOT NULL AND occurred_at_epoch IS NOT NULL")
    if space_modules is not None:
        listed = space_modules.groupBy("space").agg(
            F.array_sort(F.collect_set("module")).alias("module_keys")
        )
        plain = plain.join(listed, "space", "left")
    else:
        plain = plain.withColumn("module_keys", F.array().cast("array<string>"))
    return conform(
        plain.select(
            "id",
            "occurred_at_epoch",
            "reporter_id",
            F.when(F.col("is_page"), F.col("text")).alias("title"),
            F.when(~F.col("is_page"), F.col("text")).alias("body"),
            F.coalesce("module_keys", F.array().cast("array<string>")).alias("module_keys"),
        ),
        TICKET_ROW,
    )
