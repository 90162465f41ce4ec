"""Labelled synthetic organisations and curated corpora, of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.functions.ranking import global_row_number
from orgweft.operators.normalize import empty_sha256, records_of, union_all
from orgweft.schemas import meta_struct

# Shape of the synthetic organisation.
START_EPOCH = 1735689600
TEAM_SIZE = 50
BROKER_INDEX = 7
GAP_COUNT = 5
PLANTED = ((0, 9, 41), (11, 28, 37), (22, 35, 31))
COORDINATED = ((1, 2, 9), (12, 13, 8), (23, 24, 7), (34, 36, 6))
# The curated corpus.
CURATED_EPOCH = 1735689600
CURATED_COMM_EPOCH = 1735776000


def person_name(index: Column) -> Column:
    return F.concat(F.lit("p"), F.lpad(index.cast("string"), 4, "0"))


def _label(prefix: str, index: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(index.cast("string"), 2, "0"))


def synthetic_people(people: DataFrame, teams: int) -> DataFrame:
    """Directory records from ``index``: teams of fifty, the first of each its manager."""
    index = F.col("index")
    head = (F.floor(index / TEAM_SIZE) * TEAM_SIZE).cast("bigint")
    team = F.least(F.floor(index / TEAM_SIZE), F.lit(teams - 1))
    manager = (
        F.when(index == 0, F.lit(None))
        .when(index % TEAM_SIZE == 0, person_name(F.lit(0)))
        .otherwise(person_name(head))
    )
    rank = (
        F.when(index == 0, F.lit(6))
        .when(index % TEAM_SIZE == 0, F.lit(4))
        .when(index == BROKER_INDEX, F.lit(2))
        .when(index % 25 == 12, F.lit(3))
        .when(index % 3 == 0, F.lit(2))
        .otherwise(F.lit(1))
    )
    return records_of(
        people,
        meta_struct(
            display_name=F.concat(F.lit("Person "), person_name(index)),
            manager_external_id=manager,
            role_rank=rank,
            team_key=_label("team:team-", team),
        ),
        source=F.lit("synth-directory"),
        external_id=person_name(index),
        kind=F.lit("directory_person"),
        occurred_at_epoch=F.lit(START_EPOCH),
        subjects=F.array(F.concat(F.lit("person:"), person_name(index))),
    )


def module_owner(module: Column, teams: int) -> Column:
    """The person index that owns a module index."""
    return (module % teams) * TEAM_SIZE + 10 + module % 20


def synthetic_talk(people: DataFrame, teams: int, broker: int) -> DataFrame:
    """``sender, recipient, n``: hubs to the broker, hubs to their team, neighbours, owners of
    coordinated dependencies. Each person's talk follows from the index alone."""
    index, size = F.col("index"), TEAM_SIZE
    total = people.agg(F.count("*").alias("n")).select("n").scalar()
    offset = index % size
    hub = index - offset
    in_team = index < teams * size
    last = F.least(hub + size, total) - 1
    pick = lambda cond, sender, recipient, n: people.where(cond).select(
        sender.alias("sender"), recipient.alias("recipient"), n.cast("bigint").alias("n")
    )
    spark = people.sparkSession
    coordinated = spark.createDataFrame(list(COORDINATED), "a BIGINT, b BIGINT, n BIGINT").select(
        module_owner(F.col("a"), teams).alias("sender"), module_owner(F.col("b"), teams).alias("recipient"), "n"
    )
    return union_all(
        coordinated,
        pick(in_team & (offset == 0) & (index != broker), index, F.lit(broker), F.lit(12)),
        pick(in_team & (offset > 0), hub, index, 3 + offset % 5),
        pick(in_team & (offset > 0) & (offset % 2 == 0) & (index < last), index, index + 1, F.lit(1)),
    )


def synthetic_events(talk: DataFrame) -> DataFrame:
    sender, recipient, n = person_name(F.col("sender")), person_name(F.col("recipient")), F.col("n")
    return records_of(
        talk,
        meta_struct(
            first_epoch=F.lit(START_EPOCH),
            interaction_count=n,
            interaction_kind=F.lit("mention"),
            last_epoch=F.lit(START_EPOCH) + n,
            recipient_external_id=recipient,
            sender_external_id=sender,
        ),
        source=F.lit("synth-events"),
        external_id=F.concat(F.lit("comm-"), sender, F.lit("-"), recipient, F.lit("-"), n.cast("string")),
        kind=F.lit("communication_aggregate"),
        occurred_at_epoch=F.lit(START_EPOCH) + n,
        author_external_id=sender,
        subjects=F.array(F.concat(F.lit("person:"), sender), F.concat(F.lit("person:"), recipient)),
    )


def _modules(spark: SparkSession, modules: int, teams: int) -> DataFrame:
    index = F.col("id")
    name = _label("module-", index)
    key = F.concat(F.lit("module:"), name)
    table = spark.range(modules)
    stated = records_of(
        table,
        meta_struct(
            canonical_key=key,
            criticality=F.round(1 - index * 0.01, 2),
            module_name=name,
            repo=F.lit("synth-monorepo"),
        ),
        source=F.lit("synth-git-facts"),
        external_id=F.concat(F.lit("module-"), name),
        kind=F.lit("module"),
        occurred_at_epoch=F.lit(START_EPOCH),
        subjects=F.array(key),
    )
    owner = person_name(module_owner(index, teams))
    owned = records_of(
        table,
        meta_struct(
            attributed_count=30 + index % 17,
            module_external_id=name,
            total_attributed_count=34 + index % 17,
        ),
        source=F.lit("synth-git-facts"),
        external_id=F.concat(F.lit("authorship-"), owner, F.lit("-"), name),
        kind=F.lit("authorship_aggregate"),
        occurred_at_epoch=F.lit(START_EPOCH),
        author_external_id=owner,
        subjects=F.array(F.concat(F.lit("person:"), owner), key),
    )
    return union_all(stated, owned)


def _dependencies(spark: SparkSession) -> DataFrame:
    rows = [(*x, "planted") for x in PLANTED] + [(*x, "background") for x in COORDINATED]
    table = spark.createDataFrame(rows, "a BIGINT, b BIGINT, n BIGINT, label STRING")
    a, b = _label("module-", F.col("a")), _label("module-", F.col("b"))
    return records_of(
        table,
        meta_struct(
            dependency_kind=F.lit("explicit_reference"),
            source_module_external_id=a,
            target_module_external_id=b,
            weight=F.col("n"),
        ),
        source=F.lit("synth-git-facts"),
        external_id=F.concat_ws("-", F.lit("dependency"), a, b, F.col("label")),
        kind=F.lit("dependency"),
        occurred_at_epoch=F.lit(START_EPOCH + 20_000) + F.col("n"),
        subjects=F.array(F.concat(F.lit("module:"), a), F.concat(F.lit("module:"), b)),
    )


def _gap_artifacts(spark: SparkSession, people: Column) -> DataFrame:
    table = spark.range(GAP_COUNT).select(
        F.col("id").alias("i"),
        F.explode(
            F.array(
                F.struct(F.lit("directive").alias("name"), F.lit("directive").alias("kind"), F.lit(10_000).alias("at"), F.lit(0).alias("ordinal")),
                F.struct(F.lit("change").alias("name"), F.lit("code_change").alias("kind"), F.lit(10_500).alias("at"), F.lit(2).alias("ordinal")),
            )
        ).alias("s"),
    )
    i = F.col("i")
    key = F.concat(F.lit("artifact:synth-gap-"), i.cast("string"), F.lit("-"), F.col("s.name"))
    return records_of(
        table,
        meta_struct(
            artifact_kind=F.col("s.kind"),
            canonical_key=key,
            sequence_key=F.concat(F.lit("synth-gap-sequence-"), i.cast("string")),
            sequence_ordinal=F.col("s.ordinal"),
        ),
        source=F.lit("synth-events"),
        external_id=F.concat(F.lit("gap-"), i.cast("string"), F.lit("-"), F.col("s.name")),
        kind=F.lit("artifact"),
        occurred_at_epoch=F.lit(START_EPOCH) + F.col("s.at") + i * 1000,
        author_external_id=person_name((i * 73) % people),
        subjects=F.array(key, _label("module:module-", i)),
    )


def synthetic_contracts(spark: SparkSession) -> DataFrame:
    i = F.col("id").cast("string")
    step = lambda ordinal, name, kind, epoch: F.struct(
        F.lit(ordinal).alias("ordinal"),
        F.concat(F.lit("artifact:synth-gap-"), i, F.lit("-" + name)).alias("canonical_key"),
        F.lit(kind).alias("artifact_kind"),
        F.lit(True).alias("required"),
        epoch.cast("bigint").alias("earliest_epoch"),
        F.lit(None).cast("bigint").alias("latest_epoch"),
    )
    return spark.range(GAP_COUNT).select(
        F.concat(F.lit("contract:synth-gap-"), i, F.lit(":v1")).alias("contract_id"),
        F.lit("contiguous_sequence").alias("contract_kind"),
        F.concat(F.lit("synth-gap-sequence-"), i).alias("sequence_key"),
        F.concat(F.lit("fixture://synthetic/contracts/synth-gap-"), i).alias("source_uri"),
        empty_sha256().alias("content_sha256"),
        F.array(F.lit("Export filtering is an alternative explanation.")).alias("limitations"),
        F.array(
            step(0, "directive", "directive", F.lit(None)),
            step(1, "approval", "approval", F.lit(START_EPOCH + 10_250) + F.col("id") * 1000),
            step(2, "change", "code_change", F.lit(None)),
        ).alias("steps"),
    )


def synthetic_org(spark: SparkSession, people: int = 500, modules: int = 40, teams: int = 10):
    """(records, contracts): one broker, three faultlines, four controls, five gaps."""
    broker = min(BROKER_INDEX, people - 1)
    table = spark.range(people).withColumnRenamed("id", "index")
    team = _label("team-", F.col("id"))
    team_records = records_of(
        spark.range(teams),
        meta_struct(
            canonical_key=F.concat(F.lit("team:"), team), display_name=F.concat(F.lit("Team "), team)
        ),
        source=F.lit("synth-directory"),
        external_id=team,
        kind=F.lit("directory_team"),
        occurred_at_epoch=F.lit(START_EPOCH),
        subjects=F.array(F.concat(F.lit("team:"), team)),
    )
    records = union_all(
        team_records,
        synthetic_people(table, teams),
        synthetic_events(synthetic_talk(table, teams, broker)),
        _modules(spark, modules, teams),
        _dependencies(spark),
        _gap_artifacts(spark, F.lit(people)),
    )
    return records, synthetic_contracts(spark)


# --- curated corpus ---------------------------------------------------------


def leader_talk(groups: DataFrame, dependencies: DataFrame, bridge: str) -> DataFrame:
    """Communication records among group leaders, every unordered pair once.

    ``groups``: place, slug, members (chairs, then leads), chairs. ``dependencies``:
    place, src, dst, weight. The bridge talks to every chair except those of groups that
    others depend on. Pairs come from the group's own leader list, inside its row.
    """
    pair = lambda left, right, at: F.struct(
        left.alias("sender"), right.alias("recipient"), at.alias("at")
    )
    inside = F.flatten(
        F.transform(
            "members",
            lambda left, i: F.transform(
                F.slice("members", i + 2, F.greatest(F.size("members") - i - 1, F.lit(0))),
                lambda right, j: pair(left, right, i * 1000 + j),
            ),
        )
    )
    within = groups.select("place", F.explode(inside).alias("x")).select(
        F.lit(0).alias("phase"), "place", F.lit(0).alias("part"), "x.at", "x.sender", "x.recipient", F.lit(6).alias("n")
    )
    targets = dependencies.select(F.col("dst").alias("slug")).distinct()
    hubs = (
        groups.join(targets, "slug", "left_anti")
        .select("place", F.posexplode("chairs").alias("at", "recipient"))
        .select(F.lit(0).alias("phase"), "place", F.lit(1).alias("part"), "at", F.lit(bridge).alias("sender"), "recipient", F.lit(12).alias("n"))
    )
    sources = (
        dependencies.select("place", F.col("src").alias("slug"))
        .join(groups.select("slug", F.get("chairs", F.lit(0)).alias("recipient")), "slug")
        .select(F.lit(1).alias("phase"), "place", F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit(bridge).alias("sender"), "recipient", F.lit(5).alias("n"))
    )
    seen = F.struct("phase", "place", "part", "at")
    talk = union_all(within, hubs, sources).where("recipient IS NOT NULL AND sender <> recipient")
    once = (
        talk.groupBy(F.least("sender", "recipient").alias("a"), F.greatest("sender", "recipient").alias("b"))
        .agg(F.min_by(F.struct("sender", "recipient", "n"), seen).alias("x"), F.min(seen).alias("seen"))
        .select("x.sender", "x.recipient", "x.n", "seen")
    )
    numbered = global_row_number(once, [F.col("seen"), F.col("sender"), F.col("recipient")], "number")
    first = F.lit(CURATED_COMM_EPOCH) + (F.col("number") - 1) * 40
    last = first + F.greatest(F.lit(20), F.col("n"))
    return records_of(
        numbered,
        meta_struct(
            first_epoch=first,
            interaction_count=F.col("n"),
            interaction_kind=F.lit("mention"),
            last_epoch=last,
            recipient_external_id=F.col("recipient"),
            sender_external_id=F.col("sender"),
        ),
        source=F.lit("curated-talk"),
        external_id=F.concat_ws("-", F.lit("comm"), "sender", "recipient"),
        kind=F.lit("communication_aggregate"),
        occurred_at_epoch=last,
        author_external_id=F.col("sender"),
        subjects=F.array(F.concat(F.lit("person:"), F.col("sender")), F.concat(F.lit("person:"), F.col("recipient"))),
    )


def leader_ownership(groups: DataFrame) -> DataFrame:
    """Ownership assertions of the first four leaders of each group, falling in authority."""
    owners = groups.select(
        "slug", F.posexplode(F.slice(F.array_distinct("members"), 1, 4)).alias("at", "owner")
    )
    at = F.col("at")
    return records_of(
        owners,
        meta_struct(
            authority=F.lit("sigs_yaml_leadership"),
            authority_rank=95 - at,
            confidence=96 - at * 3,
            valid_from_epoch=F.lit(CURATED_EPOCH - 86_400 * 90),
        ),
        source=F.lit("curated-owners"),
        external_id=F.concat_ws("-", F.lit("owner"), "owner", "slug", at.cast("string")),
        kind=F.lit("ownership_assertion"),
        occurred_at_epoch=F.lit(CURATED_EPOCH),
        subjects=F.array(F.concat(F.lit("person:"), F.col("owner")), F.concat(F.lit("module:"), F.col("slug"))),
    )


def leader_authorship(groups: DataFrame) -> DataFrame:
    """Authorship counts of the first four leaders: 40, 35, 30, 25 of their sum."""
    owners = F.slice(F.array_distinct("members"), 1, 4)
    count = F.size(owners)
    rows = groups.select(
        "slug",
        (40 * count - 5 * (count * (count - 1) / 2)).cast("bigint").alias("total"),
        F.posexplode(owners).alias("at", "owner"),
    )
    module = F.concat(F.lit("module:"), F.col("slug"))
    return records_of(
        rows,
        meta_struct(
            attributed_count=40 - F.col("at") * 5,
            module_external_id=F.col("slug"),
            total_attributed_count=F.col("total"),
        ),
        source=F.lit("curated-git"),
        external_id=F.concat_ws("-", F.lit("auth"), "owner", "slug", F.col("at").cast("string")),
        kind=F.lit("authorship_aggregate"),
        occurred_at_epoch=F.lit(CURATED_EPOCH),
        author_external_id=F.col("owner"),
        subjects=F.array(F.concat(F.lit("person:"), F.col("owner")), module),
    )


def repo_facts(repos: DataFrame, groups: DataFrame) -> DataFrame:
    """Repositories of a classified group: owned by its first leader, depending on its module.

    ``repos``: repo, group (as ``classify_repos`` gives them). ``groups``: slug, members.
    """
    owned = repos.where("group IS NOT NULL").join(
        groups.select(F.col("slug").alias("group"), F.get("members", F.lit(0)).alias("owner")), "group"
    ).where("owner IS NOT NULL").withColumn("key", F.concat(F.lit("repo-"), F.col("repo")))
    module = F.concat(F.lit("module:"), F.col("key"))
    ownership = records_of(
        owned,
        meta_struct(
            authority=F.lit("sig_topic_heuristic"),
            authority_rank=F.lit(70),
            confidence=F.lit(80),
            valid_from_epoch=F.lit(CURATED_EPOCH - 86_400 * 30),
        ),
        source=F.lit("curated-repos"),
        external_id=F.concat_ws("-", F.lit("owner"), "owner", "key"),
        kind=F.lit("ownership_assertion"),
        occurred_at_epoch=F.lit(CURATED_EPOCH),
        subjects=F.array(F.concat(F.lit("person:"), F.col("owner")), module),
    )
    depends = records_of(
        owned,
        meta_struct(
            dependency_kind=F.lit("explicit_reference"),
            source_module_external_id=F.col("key"),
            target_module_external_id=F.col("group"),
            weight=F.lit(6),
        ),
        source=F.lit("curated-repos"),
        external_id=F.concat_ws("-", F.lit("dep"), "key", "group"),
        kind=F.lit("dependency"),
        occurred_at_epoch=F.lit(CURATED_EPOCH),
        subjects=F.array(module, F.concat(F.lit("module:"), F.col("group"))),
    )
    return ownership.unionByName(depends)
