"""Export rows to canonical records (projections and in-row explodes; no shuffle)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgweft.functions.text import bare_module, blank_to_null, clean_list
from orgweft.schemas import META, RECORD_COLUMNS, meta_struct

def empty_sha256() -> Column:
    return F.sha2(F.lit("").cast("binary"), 256)



def records_of(df: DataFrame, meta: Column, **columns: Column) -> DataFrame:
    """A records frame. Columns not given are null; metadata text follows from ``meta``."""
    defaults = {
        "author_external_id": F.lit(None),
        "parent_external_id": F.lit(None),
        "content": F.lit(None),
        "content_sha256": empty_sha256(),
    }
    values = {**defaults, **columns}
    types = {"occurred_at_epoch": "bigint", "subjects": "array<string>"}
    plain = [
        values[name].cast(types.get(name, "string")).alias(name) for name in RECORD_COLUMNS[:9]
    ]
    # The struct is built once; its text is made from the finished column.
    return df.select(*plain, meta.alias("meta")).select(
        *RECORD_COLUMNS[:9], F.to_json("meta").alias("metadata_json"), "meta"
    )


def parse_records(df: DataFrame) -> DataFrame:
    """Records read from files: parse the metadata text once, keep it in canonical form.

    Typed parsing is strict: a quoted number or a boolean does not become an integer.
    """
    canonical = F.to_json(F.parse_json("metadata"))
    return df.select(
        *[F.col(name) for name in RECORD_COLUMNS[:9]],
        canonical.alias("metadata_json"),
        F.from_json("metadata", META).alias("meta"),
    )


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def content_hash(*parts: Column) -> Column:
    return F.sha2(
        F.concat_ws("\n", *[F.coalesce(part, F.lit("")) for part in parts]).cast("binary"), 256
    )


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws("\n\n", *[blank_to_null(part) for part in parts]), F.lit(""))


def module_subjects(module_keys: Column) -> Column:
    return F.transform(clean_list(module_keys), lambda k: F.concat(F.lit("module:"), bare_module(k)))


def artifact_records(
    df: DataFrame,
    source: str,
    artifact_kind: str,
    *,
    external_id: Column,
    author: Column,
    parent: Column | None = None,
    content: Column,
) -> DataFrame:
    key = F.concat(F.lit(f"artifact:{source}:"), external_id)
    return records_of(
        df,
        meta_struct(artifact_kind=F.lit(artifact_kind), canonical_key=key),
        source=F.lit(source),
        external_id=F.concat(F.lit(f"{source}:"), external_id),
        kind=F.lit("artifact"),
        occurred_at_epoch=F.col("occurred_at_epoch"),
        author_external_id=author,
        parent_external_id=F.lit(None) if parent is None else parent,
        subjects=F.concat(F.array(key), module_subjects(F.col("module_keys"))),
        content_sha256=content_hash(content),
        content=content,
    )


def communication_records(df: DataFrame, source: str) -> DataFrame:
    """From columns ``external_id, occurred_at_epoch, sender, recipient, kind``."""
    sender, recipient = F.col("sender"), F.col("recipient")
    epoch = F.col("occurred_at_epoch")
    return records_of(
        df,
        meta_struct(
            first_epoch=epoch,
            interaction_count=F.lit(1),
            interaction_kind=F.col("kind"),
            last_epoch=epoch,
            recipient_external_id=recipient,
            sender_external_id=sender,
        ),
        source=F.lit(source),
        external_id=F.concat(
            F.lit(f"{source}:"), F.col("external_id"), F.lit(":communication:"), recipient, F.col("tail")
        ),
        kind=F.lit("communication_aggregate"),
        occurred_at_epoch=epoch,
        author_external_id=sender,
        subjects=F.array(F.concat(F.lit("person:"), sender), F.concat(F.lit("person:"), recipient)),
        content_sha256=content_hash(
            F.lit(source), F.col("external_id"), sender, recipient, F.col("kind")
        ),
    )


def _exchanges(sender: Column, reply_to: Column, others: Column, other_kind: str) -> Column:
    """Reply first, then one entry per other recipient, never to the sender.

    Someone who is answered and named as well gets two entries; the second has a ``tail`` that
    keeps the ids of both records apart.
    """
    reply = F.filter(
        F.array(F.struct(reply_to.alias("recipient"), F.lit("reply").alias("kind"), F.lit("").alias("tail"))),
        lambda x: x["recipient"].isNotNull() & (x["recipient"] != sender),
    )
    rest = F.transform(
        F.filter(others, lambda x: x != sender),
        lambda x: F.struct(
            x.alias("recipient"),
            F.lit(other_kind).alias("kind"),
            F.when(x.eqNullSafe(reply_to), F.lit(f":{other_kind}")).otherwise(F.lit("")).alias("tail"),
        ),
    )
    return F.concat(reply, rest)


def slack_records(rows: DataFrame) -> DataFrame:
    """A message artifact, a reply to the thread author, and one mention per mentioned id."""
    author = F.trim("author_id")
    parent_author = blank_to_null(F.col("parent_author_id"))
    exchanges = rows.select(
        F.trim("id").alias("external_id"),
        "occurred_at_epoch",
        author.alias("sender"),
        F.explode(
            _exchanges(author, parent_author, clean_list(F.col("mentions")), "mention")
        ).alias("x"),
    ).select("external_id", "occurred_at_epoch", "sender", "x.recipient", "x.kind", "x.tail")
    return union_all(
        artifact_records(
            rows,
            "slack",
            "message",
            external_id=F.trim("id"),
            author=author,
            parent=blank_to_null(F.col("thread_parent_id")),
            content=blank_to_null(F.col("text")),
        ),
        communication_records(exchanges, "slack"),
    )


def email_records(rows: DataFrame) -> DataFrame:
    """A mail artifact, a reply to the parent's sender, then each other recipient once."""
    sender = F.trim("from_id")
    parent_author = blank_to_null(F.col("parent_author_id"))
    others = F.array_except(
        clean_list(F.col("to_ids")), F.array(sender, F.coalesce(parent_author, sender))
    )
    exchanges = rows.select(
        F.trim("id").alias("external_id"),
        "occurred_at_epoch",
        sender.alias("sender"),
        F.explode(_exchanges(sender, parent_author, others, "email")).alias("x"),
    ).select("external_id", "occurred_at_epoch", "sender", "x.recipient", "x.kind", "x.tail")
    return union_all(
        artifact_records(
            rows,
            "email",
            "email",
            external_id=F.trim("id"),
            author=sender,
            parent=blank_to_null(F.col("in_reply_to_id")),
            content=_joined(F.col("subject"), F.col("body")),
        ),
        communication_records(exchanges, "email"),
    )


def ticket_records(rows: DataFrame) -> DataFrame:
    """A ticket artifact by its reporter; an assignee is not ownership."""
    return artifact_records(
        rows,
        "ticket",
        "ticket",
        external_id=F.trim("id"),
        author=F.trim("reporter_id"),
        content=_joined(F.col("title"), F.col("body")),
    )


def commit_artifacts(rows: DataFrame) -> DataFrame:
    return artifact_records(
        rows,
        "git",
        "commit",
        external_id=F.trim("sha"),
        author=F.trim("author_id"),
        content=blank_to_null(F.col("message")),
    )


def cochange_records(rows: DataFrame) -> DataFrame:
    """One record per unordered pair of modules that one commit touches.

    The pairs come from the commit's own sorted module list, inside its row.
    """
    modules = clean_list(F.col("module_keys"))
    pairs = F.flatten(
        F.transform(
            modules,
            lambda left, place: F.transform(
                F.slice(modules, place + 2, F.greatest(F.size(modules) - place - 1, F.lit(0))),
                lambda right: F.struct(left.alias("left"), right.alias("right")),
            ),
        )
    )
    exploded = rows.select(
        F.trim("sha").alias("external_id"), "occurred_at_epoch", F.explode(pairs).alias("pair")
    )
    left, right = bare_module(F.col("pair.left")), bare_module(F.col("pair.right"))
    left_key, right_key = F.concat(F.lit("module:"), left), F.concat(F.lit("module:"), right)
    return records_of(
        exploded,
        meta_struct(
            cochange_count=F.lit(1),
            relationship_class=F.lit("inferred_coupling"),
            source_module_external_id=left,
            target_module_external_id=right,
        ),
        source=F.lit("git"),
        external_id=F.concat(
            F.lit("git:"), F.col("external_id"), F.lit(":cochange:"), left_key, F.lit(":"), right_key
        ),
        kind=F.lit("cochange"),
        occurred_at_epoch=F.col("occurred_at_epoch"),
        subjects=F.array(left_key, right_key),
        content_sha256=content_hash(F.lit("git"), F.col("external_id"), left_key, right_key),
    )


def dependency_records(rows: DataFrame) -> DataFrame:
    """Every module of a commit depends on every module its trailers name, weight 1."""
    exploded = rows.select(
        F.trim("sha").alias("external_id"),
        "occurred_at_epoch",
        clean_list(F.col("dependency_keys")).alias("targets"),
        F.explode(clean_list(F.col("module_keys"))).alias("module"),
    ).select(
        "external_id", "occurred_at_epoch", "module", F.explode("targets").alias("target")
    )
    left, right = bare_module(F.col("module")), bare_module(F.col("target"))
    left_key, right_key = F.concat(F.lit("module:"), left), F.concat(F.lit("module:"), right)
    return records_of(
        exploded,
        meta_struct(
            dependency_kind=F.lit("explicit_reference"),
            source_module_external_id=left,
            target_module_external_id=right,
            weight=F.lit(1),
        ),
        source=F.lit("git"),
        external_id=F.concat(
            F.lit("git:"), F.col("external_id"), F.lit(":dependency:"), left_key, F.lit(":"), right_key
        ),
        kind=F.lit("dependency"),
        occurred_at_epoch=F.col("occurred_at_epoch"),
        subjects=F.array(left_key, right_key),
        content_sha256=content_hash(F.lit("git"), F.col("external_id"), left_key, right_key),
    )


def code_records(rows: DataFrame) -> DataFrame:
    return union_all(commit_artifacts(rows), cochange_records(rows), dependency_records(rows))
