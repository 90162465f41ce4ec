"""Workspace dumps: an employee map, a team tree, and one JSON file per product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.functions.text import slug, workspace_epoch
from orgweft.operators.normalize import records_of, union_all
from orgweft.schemas import COMMIT_ROW, SLACK_ROW, TICKET_ROW, conform, meta_struct

# Rank of a stated role; exact title first, then the first title contained.
ROLE_RANKS = {
    "chief product officer": 6,
    "vp of engineering": 6,
    "vp": 6,
    "director": 5,
    "engineering lead": 3,
    "technical architect": 3,
    "product manager": 3,
    "marketing manager": 3,
    "ux researcher": 2,
    "marketing research analyst": 2,
    "software engineer": 1,
    "qa specialist": 1,
}
# Members of a team tree entry that are not groups of people.
TREE_FIELDS = ("engineering_leads", "employee_id", "name", "role", "location", "org")
DIRECTORY_EPOCH = 1735689600
PRODUCT = (
    "slack ARRAY<STRUCT<id: STRING, Channel: STRUCT<name: STRING>, Message: STRUCT<User: "
    "STRUCT<userId: STRING, text: STRING, timestamp: STRING, utterranceID: STRING>>>>, "
    "prs ARRAY<STRUCT<id: STRING, number: STRING, title: STRING, created_at: STRING, "
    "user: STRUCT<login: STRING>, reviews: ARRAY<STRUCT<submitted_at: STRING, comment: STRING, "
    "user: STRUCT<login: STRING>>>>>, "
    "documents ARRAY<STRUCT<id: STRING, author: STRING, date: STRING, type: STRING>>"
)


def role_rank(role: Column) -> Column:
    title = F.lower(F.trim(role))
    rank = F.lit(0)
    for needle, value in reversed(ROLE_RANKS.items()):
        rank = F.when(F.contains(title, F.lit(needle)), F.lit(value)).otherwise(rank)
    for name, value in ROLE_RANKS.items():
        rank = F.when(title == name, F.lit(value)).otherwise(rank)
    return F.coalesce(rank, F.lit(0))


def _whole(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.from_json("value", shape).alias("x"))


def team_index(spark: SparkSession, path: str) -> DataFrame:
    """``employee_id, team_key``: the lead a person sits under; other groups hang off the head."""
    text = spark.read.option("wholetext", True).text(path)
    heads = text.select(
        F.coalesce(
            F.from_json("value", "array<map<string,string>>"),
            F.array(F.from_json("value", "map<string,string>")),
        ).alias("heads")
    ).select(F.posexplode("heads").alias("at", "head"))
    head_id = F.coalesce(F.col("head")["employee_id"], F.lit("vp"))
    leads = heads.select(
        "at",
        F.posexplode(
            F.from_json(
                F.col("head")["engineering_leads"],
                "array<struct<employee_id string, engineers array<struct<employee_id string>>, "
                "qa_specialists array<struct<employee_id string>>>>",
            )
        ).alias("lead_at", "lead"),
    )
    lead_team = F.concat(F.lit("team:"), F.coalesce("lead.employee_id", F.lit("lead")))
    nobody = F.array().cast("array<struct<employee_id string>>")
    firm = union_all(
        heads.select(
            head_id.alias("employee_id"),
            F.concat(F.lit("team:"), head_id).alias("team_key"),
            F.struct("at", F.lit(0).alias("l"), F.lit(0).alias("m")).alias("place"),
        ),
        leads.select(
            F.coalesce("lead.employee_id", F.lit("lead")).alias("employee_id"),
            lead_team.alias("team_key"),
            F.struct("at", (F.col("lead_at") + 1).alias("l"), F.lit(0).alias("m")).alias("place"),
        ),
        leads.select(
            F.explode(
                F.concat(
                    F.coalesce("lead.engineers", nobody), F.coalesce("lead.qa_specialists", nobody)
                )
            ).alias("member"),
            lead_team.alias("team_key"),
            F.struct("at", (F.col("lead_at") + 1).alias("l"), F.lit(1).alias("m")).alias("place"),
        ).select("member.employee_id", "team_key", "place"),
    )
    loose = (
        heads.select("at", head_id.alias("head_id"), F.explode("head").alias("group", "members"))
        .where(~F.col("group").isin(*TREE_FIELDS))
        .select(
            "at", "head_id", F.explode(F.from_json("members", "array<struct<employee_id string>>")).alias("m")
        )
        .select(
            F.col("m.employee_id").alias("employee_id"),
            F.concat(F.lit("team:"), F.col("head_id")).alias("team_key"),
            (-F.col("at")).alias("earlier"),
        )
    )
    stated = firm.where("employee_id IS NOT NULL").groupBy("employee_id").agg(
        F.max_by("team_key", "place").alias("firm_team")
    )
    fallback = loose.where("employee_id IS NOT NULL").groupBy("employee_id").agg(
        F.max_by("team_key", "earlier").alias("loose_team")
    )
    return stated.join(fallback, "employee_id", "full_outer").select(
        "employee_id", F.coalesce("firm_team", "loose_team").alias("team_key")
    )


def directory_records(
    spark: SparkSession,
    employees: str,
    team_tree: str,
    products: DataFrame,
    *,
    epoch: int = DIRECTORY_EPOCH,
    source: str = "herb-directory",
) -> DataFrame:
    """Person and module records. ``products``: product."""
    people = _whole(
        spark, employees, "map<string, struct<name string, role string, location string, org string>>"
    ).select(F.explode("x").alias("employee_id", "profile"))
    placed = people.join(team_index(spark, team_tree), "employee_id", "left")
    org_team = F.concat(F.lit("team:"), F.coalesce("profile.org", F.lit("unknown")))
    persons = records_of(
        placed,
        meta_struct(
            display_name=F.coalesce(F.nullif(F.col("profile.name"), F.lit("")), F.col("employee_id")),
            role_rank=role_rank(F.col("profile.role")),
            role=F.coalesce("profile.role", F.lit("")),
            location=F.col("profile.location"),
            team_key=F.coalesce("team_key", org_team),
            source_identity_count=F.lit(1),
        ),
        source=F.lit(source),
        external_id=F.col("employee_id"),
        kind=F.lit("directory_person"),
        occurred_at_epoch=F.lit(epoch),
        subjects=F.array(F.concat(F.lit("person:"), F.col("employee_id"))),
    )
    named = products.select("product").distinct().withColumn("key", slug(F.col("product")))
    module_key = F.concat(F.lit("module:"), F.col("key"))
    modules = records_of(
        named,
        meta_struct(canonical_key=module_key, criticality=F.lit(1.0), product=F.col("product")),
        source=F.lit(source),
        external_id=F.col("key"),
        kind=F.lit("module"),
        occurred_at_epoch=F.lit(epoch),
        subjects=F.array(module_key),
    )
    return union_all(persons, modules)


def read_products(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per product file with its name."""
    raw = spark.read.schema(PRODUCT).option("multiLine", True).json(paths)
    return raw.withColumn("product", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))


def product_chat_rows(products: DataFrame) -> DataFrame:
    """Slack rows: authors that are employees, explicit employee mentions, product module."""
    items = products.select("product", F.explode("slack").alias("item")).select(
        "product", "item.id", F.col("item.Message.User").alias("user")
    )
    author = F.col("user.userId")
    found = F.array_distinct(F.regexp_extract_all(F.coalesce("user.text", F.lit("")), F.lit("(eid_[0-9a-f]{8})"), 1))
    rows = items.where(F.startswith(author, F.lit("eid_"))).select(
        F.concat(
            F.lit("herb:"), F.col("product"), F.lit(":slack:"), F.coalesce("id", "user.utterranceID", F.lit("None"))
        ).alias("id"),
        workspace_epoch(F.col("user.timestamp")).alias("occurred_at_epoch"),
        author.alias("author_id"),
        F.array_sort(F.array_remove(found, author)).alias("mentions"),
        F.array(slug(F.col("product"))).alias("module_keys"),
        F.col("user.text").alias("text"),
    )
    return conform(rows.where("occurred_at_epoch IS NOT NULL"), SLACK_ROW)


def _pull_requests(products: DataFrame) -> DataFrame:
    pr_id = F.coalesce("pr.id", F.concat(F.lit("pr-"), F.coalesce("pr.number", F.lit("None"))))
    return (
        products.select("product", F.explode("prs").alias("pr"))
        .select(
            F.concat(F.lit("herb:"), F.col("product"), F.lit(":pr:"), pr_id).alias("artifact_id"),
            workspace_epoch(F.col("pr.created_at")).alias("epoch"),
            F.col("pr.user.login").alias("author"),
            F.coalesce("pr.title", F.lit("")).alias("title"),
            F.array(slug(F.col("product"))).alias("module_keys"),
            F.col("pr.reviews").alias("reviews"),
        )
        .where("author IS NOT NULL AND epoch IS NOT NULL")
    )


def product_commit_rows(products: DataFrame) -> DataFrame:
    rows = _pull_requests(products).select(
        F.col("artifact_id").alias("sha"),
        F.col("epoch").alias("occurred_at_epoch"),
        F.col("author").alias("author_id"),
        F.col("title").alias("message"),
        "module_keys",
        F.array().cast("array<string>").alias("dependency_keys"),
    )
    return conform(rows, COMMIT_ROW)


def product_review_rows(products: DataFrame) -> DataFrame:
    """Reviews as replies to the pull request's author; an undated review takes its date."""
    rows = (
        _pull_requests(products)
        .select("*", F.posexplode("reviews").alias("at", "review"))
        .where("review.user.login IS NOT NULL")
        .select(
            F.concat(F.col("artifact_id"), F.lit(":review:"), F.col("at").cast("string")).alias("id"),
            F.coalesce(
                F.nullif(workspace_epoch(F.col("review.submitted_at")), F.lit(0)), "epoch"
            ).alias("occurred_at_epoch"),
            F.col("review.user.login").alias("author_id"),
            F.concat(F.lit("artifact:git:"), F.col("artifact_id")).alias("thread_parent_id"),
            F.col("author").alias("parent_author_id"),
            F.array().cast("array<string>").alias("mentions"),
            "module_keys",
            F.col("review.comment").alias("text"),
        )
    )
    return conform(rows, SLACK_ROW)


def product_document_rows(products: DataFrame) -> DataFrame:
    rows = products.select("product", F.explode("documents").alias("doc")).select(
        F.concat(F.lit("herb:"), F.col("product"), F.lit(":doc:"), F.coalesce("doc.id", F.lit("None"))).alias("id"),
        workspace_epoch(F.col("doc.date")).alias("occurred_at_epoch"),
        F.col("doc.author").alias("reporter_id"),
        F.coalesce(F.nullif(F.col("doc.type"), F.lit("")), F.lit("document")).alias("title"),
        F.array(slug(F.col("product"))).alias("module_keys"),
    )
    return conform(
        rows.where("reporter_id IS NOT NULL AND occurred_at_epoch IS NOT NULL"), TICKET_ROW
    )
