"""Canonical record files, small side inputs and published rosters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from orgweft.functions.text import slug
from orgweft.operators.normalize import parse_records
from orgweft.operators.questions import substring_pairs
from orgweft.schemas import CONTRACT_FILE, RECORD_FILE

# Words in a repository's text and the group they point to, in this order.
GROUP_KEYWORDS = {
    "network": "network",
    "cni": "network",
    "schedule": "scheduling",
    "storage": "storage",
    "csi": "storage",
    "auth": "auth",
    "kubectl": "cli",
    "cli": "cli",
    "docs": "docs",
    "website": "docs",
    "test": "testing",
    "node": "node",
    "cloud": "cloud-provider",
    "window": "windows",
    "instrument": "instrumentation",
    "metric": "instrumentation",
    "cluster": "cluster-lifecycle",
    "release": "release",
    "security": "security",
    "api": "api-machinery",
    "client": "api-machinery",
    "app": "apps",
    "autoscal": "autoscaling",
    "multi": "multicluster",
    "contrib": "contributor-experience",
    "infra": "k8s-infra",
    "etcd": "etcd",
    "ui": "ui",
}
GROUP_TOPIC = r"k8s-sig-([a-z0-9-]+)"


def read_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Canonical records of JSON array files."""
    rows = spark.read.schema(RECORD_FILE).option("multiLine", True).json(paths)
    return parse_records(rows)


def split_directory(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directory people, everything else)."""
    person = F.col("kind") == "directory_person"
    return records.where(person), records.where(~person)


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Sequence contracts under ``contracts`` of a JSON file."""
    contract = StructType.fromDDL(CONTRACT_FILE)
    shape = StructType([StructField("contracts", ArrayType(contract))])
    raw = spark.read.schema(shape).option("multiLine", True).json(path)
    return raw.select(F.explode("contracts").alias("c")).select("c.*")


def read_mapping(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """A JSON object of text to text as two columns; anything else in it is an error."""
    whole = spark.read.option("wholetext", True).text(path)
    parsed = whole.select(F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias(key, value))


def read_module_lists(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A JSON object of text to lists as ``key, module`` rows."""
    whole = spark.read.option("wholetext", True).text(path)
    shape = "map<string, array<string>>"
    parsed = whole.select(F.from_json("value", shape, {"mode": "FAILFAST"}).alias("m"))
    return parsed.select(F.explode("m").alias(key, "modules")).select(
        key, F.explode("modules").alias("module")
    )


def read_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    whole = spark.read.option("wholetext", True).text(path)
    parsed = whole.select(F.from_json("value", "array<string>", {"mode": "FAILFAST"}).alias("l"))
    return parsed.select(F.explode("l").alias(column))


# --- governance rosters -----------------------------------------------------

GROUP = (
    "kind STRING, place BIGINT, dir STRING, name STRING, leadership STRUCT<chairs: "
    "ARRAY<STRUCT<github: STRING, name: STRING>>, tech_leads: ARRAY<STRUCT<github: STRING, "
    "name: STRING>>>"
)


def roster_people(groups: DataFrame) -> DataFrame:
    """``handle, display_name, title, role_rank, team_key, manager`` from group rows.

    The first group names a person's team; the highest rank gives the title. ``groups``
    has kind (sig, wg, committee), place, dir, name, leadership.
    """
    folder = F.coalesce(F.nullif(F.trim("dir"), F.lit("")), F.nullif(F.trim("name"), F.lit("")))
    plain = F.replace(F.replace(F.replace(folder, F.lit("sig-"), F.lit("")), F.lit("wg-"), F.lit("")), F.lit("committee-"), F.lit(""))
    named = groups.where(folder.isNotNull()).select(
        "kind",
        "place",
        F.concat(F.lit("team:"), plain).alias("team_key"),
        F.coalesce(F.nullif(F.col("name"), F.lit("")), folder).alias("label"),
        F.filter("leadership.chairs", lambda p: F.trim(p["github"]) != "").alias("chairs"),
        F.filter("leadership.tech_leads", lambda p: F.trim(p["github"]) != "").alias("leads"),
    )
    first_chair = slug(F.get("chairs", F.lit(0))["github"])
    seat = lambda column, order, title, rank, manager: named.select(
        "place",
        F.lit(order).alias("order"),
        F.posexplode(column).alias("at", "p"),
        "team_key",
        F.concat(F.col("label"), F.lit(title)).alias("title"),
        rank.alias("role_rank"),
        manager.alias("manager"),
    )
    chair_rank = F.when(F.col("kind") == "committee", F.lit(5)).otherwise(F.lit(4))
    seats = seat("chairs", 0, " chair", chair_rank, F.lit(None).cast("string")).unionByName(
        seat("leads", 1, " tech lead", F.lit(3), first_chair)
    )
    handle = slug(F.col("p.github"))
    keyed = seats.select(
        handle.alias("handle"),
        F.coalesce(F.nullif(F.col("p.name"), F.lit("")), "p.github").alias("display_name"),
        "title",
        "role_rank",
        "team_key",
        "manager",
        F.struct("place", "order", "at").alias("seen"),
    ).where("handle <> ''")
    best = F.struct("role_rank", _backwards("seen").alias("r"))
    people = keyed.groupBy("handle").agg(
        F.min_by(F.struct("display_name", "team_key", "manager"), "seen").alias("f"),
        F.max_by("title", best).alias("title"),
        F.max("role_rank").alias("role_rank"),
    )
    chairs_of = named.groupBy("team_key").agg(
        F.max_by(first_chair, "place").alias("chair")
    )
    every_chair = named.select(F.explode("chairs").alias("c")).select(slug(F.col("c.github")).alias("handle")).distinct()
    flat = people.select("handle", "f.display_name", "title", "role_rank", "f.team_key", "f.manager")
    return (
        flat.join(chairs_of, "team_key", "left")
        .join(every_chair.withColumn("is_chair", F.lit(True)), "handle", "left")
        .select(
            "handle",
            "display_name",
            "title",
            "role_rank",
            "team_key",
            F.when(
                F.col("manager").isNull() & F.col("is_chair").isNull(), F.col("chair")
            ).otherwise(F.col("manager")).alias("manager"),
        )
    )


def _backwards(place: str) -> Column:
    return F.struct(*[(-F.col(f"{place}.{part}")).alias(part) for part in ("place", "order", "at")])


def classify_repos(repos: DataFrame, groups: DataFrame) -> DataFrame:
    """``repo, group`` from ``repo, name, description, topics`` and the known group ``slug``s.

    A topic that names a group wins, then the longest group name found in the text, then
    the first keyword. Names are found by an equi join on pieces of the text.
    """
    known = groups.select("slug").distinct()
    blob = F.lower(
        F.concat_ws(" ", "name", F.coalesce("description", F.lit("")), F.array_join("topics", " "))
    )
    texts = repos.select("repo", blob.alias("blob"), "topics")
    topics = texts.select("repo", F.posexplode("topics").alias("at", "topic")).select(
        "repo", "at", F.regexp_extract(F.lower("topic"), GROUP_TOPIC, 1).alias("slug")
    )
    by_topic = topics.join(known, "slug").groupBy("repo").agg(F.min_by("slug", "at").alias("by_topic"))
    found = substring_pairs(
        texts.select(F.col("repo").alias("text_id"), F.replace("blob", F.lit("_"), F.lit("-")).alias("text")),
        known.select(F.col("slug").alias("needle_id"), F.col("slug").alias("needle")),
    )
    by_name = found.groupBy(F.col("text_id").alias("repo")).agg(
        F.min_by("needle_id", F.struct((-F.length("needle_id")).alias("n"), "needle_id")).alias("by_name")
    )
    hits = [
        F.when(
            F.contains("blob", F.lit(word)),
            F.struct(F.lit(at).alias("at"), F.lit(group).alias("slug")),
        )
        for at, (word, group) in enumerate(GROUP_KEYWORDS.items())
    ]
    words = texts.select("repo", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("repo", "hit.*")
    by_word = words.join(known, "slug").groupBy("repo").agg(F.min_by("slug", "at").alias("by_word"))
    return (
        repos.select("repo")
        .join(by_topic, "repo", "left")
        .join(by_name, "repo", "left")
        .join(by_word, "repo", "left")
        .select("repo", F.coalesce("by_topic", "by_name", "by_word").alias("group"))
    )
