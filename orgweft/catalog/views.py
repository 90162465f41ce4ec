"""The given tables seen as an organisation: people, commits, talk, threads, contracts.

Each view is a projection or aggregation of whole tables into one of the library's
input shapes; the registered queries run the operators on them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.functions.text import slug
from orgweft.operators import canonicalize as C
from orgweft.operators import derive as D
from orgweft.operators.lenses import communication_window, gap_findings
from orgweft.operators.normalize import (
    cochange_records,
    commit_artifacts,
    dependency_records,
    empty_sha256,
    records_of,
    slack_records,
    union_all,
)
from orgweft.plans.bundle import (
    Bundle,
    FoundGaps,
    Stated,
    canonicalize,
    complete,
    find_gaps,
    stated_nodes,
    with_observed_edges,
)
from orgweft.schemas import COMMIT_ROW, EMAIL_ROW, TICKET_ROW, conform, meta_struct
from orgweft.session import stored
from orgweft.sources.chat import chat_rows

DATASET = "bench"
BASE = 1704067200
WINDOW_DAYS = 7
ASSERTED_FROM = 789004800
FIVE_YEARS = 157680000


_OPEN: dict[tuple[str, str], Views] = {}


def open_views(spark: SparkSession, sf_dir: str) -> Views:
    """The views of a folder; within one session its graph is built once, like a snapshot."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = Views(spark, sf_dir)
    return _OPEN[key]


class Views:
    """Lazily built views of one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def supplier_count(self) -> Column:
        return self.table("supplier").select(F.count("*")).scalar()

    def handle(self, number: Column) -> Column:
        """A person's handle from any number."""
        return F.concat(F.lit("s"), (number % self.supplier_count).cast("string"))

    # --- directory ----------------------------------------------------------

    @cached_property
    def people(self) -> DataFrame:
        balance = F.col("s_acctbal")
        key = F.col("s_suppkey")
        rank = F.greatest(F.lit(0), F.least(F.lit(6), F.floor(balance / 1500)))
        handle = F.concat(F.lit("s"), key.cast("string"))
        low = balance < 1500
        rows = self.table("supplier")
        return records_of(
            rows,
            meta_struct(
                display_name=F.col("s_name"),
                role_rank=rank,
                team_key=F.concat(F.lit("team:nation-"), F.col("s_nationkey").cast("string")),
                manager_external_id=F.when(
                    key % 10 != 0, F.concat(F.lit("s"), (key - key % 10).cast("string"))
                ),
                identity_status=F.when(balance < 0, F.lit("unresolved")),
                identity_candidate_id=F.when(
                    low, F.concat(F.lit("cand:nation-"), F.col("s_nationkey").cast("string"))
                ),
                identity_confidence=F.when(low, 50 + key % 50),
                identity_primary=F.when(low, balance > 750),
                identity_signal=F.when(
                    low, F.when(balance < 0, F.lit("negative")).otherwise(F.lit("low"))
                ),
                identity_source=F.when(low, F.lit("directory")),
            ),
            source=F.lit("directory"),
            external_id=handle,
            kind=F.lit("directory_person"),
            occurred_at_epoch=F.lit(ASSERTED_FROM),
            subjects=F.array(F.concat(F.lit("person:"), handle)),
        )

    @cached_property
    def teams(self) -> DataFrame:
        name = slug(F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")))
        key = F.concat(F.lit("team:"), name)
        return records_of(
            self.table("nation"),
            meta_struct(canonical_key=key, display_name=F.col("n_name")),
            source=F.lit("directory"),
            external_id=name,
            kind=F.lit("directory_team"),
            occurred_at_epoch=F.lit(ASSERTED_FROM),
            subjects=F.array(key),
        )

    @cached_property
    def module_names(self) -> DataFrame:
        part = self.table("part")
        brands = part.select(slug(F.col("p_brand")).alias("module"), F.col("p_brand").alias("title"))
        types = part.select(
            F.concat(F.lit("type-"), slug(F.col("p_type"))).alias("module"), F.col("p_type").alias("title")
        )
        return brands.union(types).distinct()

    @cached_property
    def modules(self) -> DataFrame:
        key = F.concat(F.lit("module:"), F.col("module"))
        return records_of(
            self.module_names,
            meta_struct(canonical_key=key, module_name=F.col("title"), criticality=F.lit(1.0)),
            source=F.lit("directory"),
            external_id=F.concat(F.lit("module-"), F.col("module")),
            kind=F.lit("module"),
            occurred_at_epoch=F.lit(ASSERTED_FROM),
            subjects=F.array(key),
        )

    @cached_property
    def directory(self) -> DataFrame:
        return union_all(self.people, self.teams, self.modules)

    # --- work ---------------------------------------------------------------

    @cached_property
    def commit_rows(self) -> DataFrame:
        """One commit per order; its modules are the brands of the order's lines."""
        brands = (
            self.table("lineitem")
            .select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
            .join(self.table("part").select("p_partkey", "p_brand"), "p_partkey")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.array_sort(F.collect_set(slug(F.col("p_brand")))).alias("module_keys"))
        )
        orders = self.table("orders").join(brands, "o_orderkey", "left")
        return conform(
            orders.select(
                F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("sha"),
                F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("occurred_at_epoch"),
                self.handle(F.col("o_custkey")).alias("author_id"),
                F.col("o_orderpriority").alias("message"),
                F.coalesce("module_keys", F.array().cast("array<string>")).alias("module_keys"),
                F.array().cast("array<string>").alias("dependency_keys"),
            ),
            COMMIT_ROW,
        )

    @cached_property
    def talk(self) -> DataFrame:
        """One communication record per order line between two people."""
        line = self.table("lineitem")
        sender = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
        recipient = self.handle(F.col("l_partkey"))
        epoch = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
        kind = (
            F.when(F.col("l_returnflag") == "R", F.lit("reply"))
            .when(F.col("l_returnflag") == "A", F.lit("mention"))
            .otherwise(F.lit("email"))
        )
        return records_of(
            line.where(sender != recipient),
            meta_struct(
                first_epoch=epoch,
                interaction_count=F.col("l_quantity").cast("bigint"),
                interaction_kind=kind,
                last_epoch=epoch,
                recipient_external_id=recipient,
                sender_external_id=sender,
            ),
            source=F.lit("talk"),
            external_id=F.concat_ws(
                "-",
                *[
                    F.col(name).cast("string")
                    for name in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
                ],
            ),
            kind=F.lit("communication_aggregate"),
            occurred_at_epoch=epoch,
            author_external_id=sender,
            subjects=F.array(F.concat(F.lit("person:"), sender), F.concat(F.lit("person:"), recipient)),
        )

    @cached_property
    def dependencies(self) -> DataFrame:
        """Declared dependencies between the brands of neighbouring parts."""
        part = self.table("part")
        left = part.select(F.col("p_partkey"), slug(F.col("p_brand")).alias("a"))
        right = part.select((F.col("p_partkey") - 1).alias("p_partkey"), slug(F.col("p_brand")).alias("b"))
        pairs = left.join(right, "p_partkey").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("w"))
        a, b = F.concat(F.lit("module:"), F.col("a")), F.concat(F.lit("module:"), F.col("b"))
        return records_of(
            pairs,
            meta_struct(
                dependency_kind=F.lit("import"),
                source_module_external_id=F.col("a"),
                target_module_external_id=F.col("b"),
                weight=F.col("w"),
            ),
            source=F.lit("build"),
            external_id=F.concat_ws("-", F.lit("dep"), "a", "b"),
            kind=F.lit("dependency"),
            occurred_at_epoch=F.lit(ASSERTED_FROM),
            subjects=F.array(a, b),
        )

    @cached_property
    def assertions(self) -> DataFrame:
        key = F.col("s_suppkey")
        handle = F.concat(F.lit("s"), key.cast("string"))
        since = F.lit(ASSERTED_FROM) + key * 86400
        rank = F.greatest(F.lit(0), F.least(F.lit(6), F.floor(F.col("s_acctbal") / 1500)))
        return records_of(
            self.table("supplier"),
            meta_struct(
                authority=F.concat(F.lit("nation-"), F.col("s_nationkey").cast("string")),
                authority_rank=rank * 10,
                confidence=50 + key % 50,
                valid_from_epoch=since,
                valid_until_epoch=F.when(F.col("s_acctbal") <= 5000, since + FIVE_YEARS),
            ),
            source=F.lit("owners"),
            external_id=F.concat(F.lit("assert-"), handle),
            kind=F.lit("ownership_assertion"),
            occurred_at_epoch=since,
            subjects=F.array(
                F.concat(F.lit("person:"), handle),
                F.concat(F.lit("module:brand-"), (1 + key % 25).cast("string")),
            ),
        )

    @cached_property
    def authorship(self) -> DataFrame:
        """Stated authorship counts per person and part type."""
        lines = self.table("lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).join(
            self.table("part").select("p_partkey", "p_type"), "p_partkey"
        )
        counts = lines.groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"))
        totals = counts.groupBy("p_type").agg(F.sum("n").alias("total"))
        rows = counts.join(totals, "p_type")
        handle = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
        module = F.concat(F.lit("type-"), slug(F.col("p_type")))
        return records_of(
            rows,
            meta_struct(
                attributed_count=F.col("n"), module_external_id=module, total_attributed_count=F.col("total")
            ),
            source=F.lit("owners"),
            external_id=F.concat_ws("-", F.lit("authorship"), handle, module),
            kind=F.lit("authorship_aggregate"),
            occurred_at_epoch=F.lit(ASSERTED_FROM),
            subjects=F.array(F.concat(F.lit("person:"), handle), F.concat(F.lit("module:"), module)),
        )

    # --- threads ------------------------------------------------------------

    @cached_property
    def messages(self) -> DataFrame:
        """Conversation turns as chat messages. The first two answer a message that is not there.

        Every fourth turn mentions someone else, the others their own author; all mention the
        author of the turn before, whom most of them answer.
        """
        return self._messages(lambda text: text)

    def _messages(self, worded: Callable[[Column], Column]) -> DataFrame:
        conv, turn = F.col("conv_id"), F.col("turn")
        day = F.lit(BASE) + conv * 86400
        stamp = lambda epoch: F.concat(epoch.cast("string"), F.lit(".000100"))
        text = F.concat(
            F.lit("<@"),
            self.handle(F.when(turn % 4 == 0, conv).otherwise(conv * 7 + turn)),
            F.lit("> <@"),
            self.handle(conv * 7 + turn + self.supplier_count - 1),
            F.lit("|x> "),
            F.col("text"),
        )
        return self.table("conversations").select(
            F.concat(F.lit("c"), conv.cast("string")).alias("channel"),
            self.handle(conv * 7 + turn).alias("user"),
            stamp(day + turn * 3600).alias("ts"),
            F.when(turn <= 1, stamp(day - 3600)).otherwise(stamp(day + (turn - 1) * 3600)).alias("thread_ts"),
            worded(text).alias("text"),
        )

    @cached_property
    def full_messages(self) -> DataFrame:
        """The messages, each of which also mentions the people whose numbers are its conversation
        and its place in it.
        """
        conv, turn = F.col("conv_id"), F.col("turn")
        named = F.concat(F.lit("<@"), self.handle(conv), F.lit("> <@"), self.handle(turn), F.lit("|x> "))
        return self._messages(lambda text: F.concat(named, text))

    @cached_property
    def channel_modules(self) -> DataFrame:
        conv = F.col("conv_id")
        return self.table("conversations").select(
            F.concat(F.lit("c"), conv.cast("string")).alias("channel"),
            F.concat(F.lit("brand-"), (1 + conv % 25).cast("string")).alias("module"),
        ).distinct()

    @cached_property
    def slack_rows(self) -> DataFrame:
        return chat_rows(self.messages, self.channel_modules)

    @cached_property
    def contracts(self) -> DataFrame:
        """One contract per conversation: first turn, approval, second turn, eighth turn if any."""
        conv = F.col("conv_id")
        name = conv.cast("string")
        day = F.lit(BASE) + conv * 86400
        turn = lambda hours: F.concat(
            F.lit("artifact:slack:c"), name, F.lit("-"), (day + hours * 3600).cast("string"), F.lit(".000100")
        )
        step = lambda ordinal, key, kind, needed, earliest: F.struct(
            F.lit(ordinal).alias("ordinal"),
            key.alias("canonical_key"),
            F.lit(kind).alias("artifact_kind"),
            F.lit(needed).alias("required"),
            earliest.cast("bigint").alias("earliest_epoch"),
            F.lit(None).cast("bigint").alias("latest_epoch"),
        )
        never = F.lit(None)
        return self.table("conversations").select("conv_id").distinct().select(
            F.concat(F.lit("contract:conv-"), name).alias("contract_id"),
            F.lit("required_audit_transition").alias("contract_kind"),
            F.concat(F.lit("conv-"), name).alias("sequence_key"),
            F.concat(F.lit("contracts://conv-"), name).alias("source_uri"),
            empty_sha256().alias("content_sha256"),
            F.array(F.lit("Export filtering is an alternative explanation.")).alias("limitations"),
            F.array(
                step(0, turn(0), "message", True, never),
                step(1, F.concat(F.lit("artifact:approval-c"), name), "approval", True, day + 1800),
                step(2, turn(1), "message", True, never),
                step(3, turn(7), "message", False, never),
            ).alias("steps"),
        )

    # --- mail and tickets ---------------------------------------------------

    @cached_property
    def email_rows(self) -> DataFrame:
        """Documents as mails between raw addresses, some of them unknown."""
        doc = F.col("doc_id")
        n = self.supplier_count
        sender = lambda d: F.concat(F.lit("S"), (d % n).cast("string"), F.lit("@Example.COM"))
        return conform(
            self.table("documents").select(
                F.concat(F.lit("d"), doc.cast("string")).alias("id"),
                (F.lit(BASE) + doc * 600).alias("occurred_at_epoch"),
                sender(doc).alias("from_id"),
                F.array(
                    F.concat(F.lit("<s"), ((doc * 3) % n).cast("string"), F.lit("@example.com>")),
                    F.concat(F.lit("mailto:x"), (doc % 17).cast("string"), F.lit("@else.org")),
                ).alias("to_ids"),
                F.concat(F.lit("d"), (doc - 1).cast("string")).alias("in_reply_to_id"),
                F.when(doc > 0, sender(doc - 1)).alias("parent_author_id"),
                F.col("lang").alias("subject"),
                F.col("text").alias("body"),
                F.array(F.concat(F.lit("brand-"), (1 + doc % 25).cast("string"))).alias("module_keys"),
            ),
            EMAIL_ROW,
        )

    @cached_property
    def identity_map(self) -> DataFrame:
        handle = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))
        return self.table("supplier").select(
            F.concat(handle, F.lit("@example.com")).alias("source_id"), handle.alias("handle")
        )

    @cached_property
    def handles(self) -> DataFrame:
        return self.people.select(F.col("external_id").alias("handle"))

    @cached_property
    def ticket_rows(self) -> DataFrame:
        page = F.col("page_id")
        return conform(
            self.table("pages").select(
                F.concat(F.lit("p"), page.cast("string")).alias("id"),
                (F.lit(BASE) + page * 3600).alias("occurred_at_epoch"),
                self.handle(page).alias("reporter_id"),
                F.col("url").alias("title"),
                F.col("html").alias("body"),
                F.array(F.concat(F.lit("brand-"), (1 + page % 25).cast("string"))).alias("module_keys"),
            ),
            TICKET_ROW,
        )

    # --- graph --------------------------------------------------------------

    @cached_property
    def records(self) -> DataFrame:
        """The records that state nodes."""
        return union_all(self.directory, commit_artifacts(self.commit_rows), self.thread_records)

    @cached_property
    def facts(self) -> dict[str, DataFrame]:
        """The other records by kind; sources and forms of the ids keep them apart."""
        return {
            "communication_aggregate": self.talk,
            "cochange": cochange_records(self.commit_rows),
            "dependency": union_all(self.dependencies, dependency_records(self.commit_rows)),
            "ownership_assertion": self.assertions,
            "authorship_aggregate": self.authorship,
        }

    @cached_property
    def thread_records(self) -> DataFrame:
        """The messages themselves; ``chat_talk`` has who talks to whom."""
        return slack_records(self.slack_rows).where("kind = 'artifact'")

    @cached_property
    def base(self) -> Bundle:
        return with_observed_edges(self.stated)

    @cached_property
    def stated(self) -> Stated:
        """Evidence and nodes alone, for what reads no edges of artifacts."""
        return stated_nodes(self.records, DATASET, facts=self.facts)

    @cached_property
    def gaps(self) -> FoundGaps:
        return find_gaps(self.stated.evidence, self.stated.nodes.kept, self.contracts, DATASET)

    @property
    def gap_findings(self) -> DataFrame:
        return gap_findings(self.gaps.nodes, self.gaps.edges.kept)

    @cached_property
    def bundle(self) -> Bundle:
        return complete(self.base, found=self.gaps)

    @cached_property
    def _kept(self) -> dict[str, DataFrame]:
        return {}

    def kept(self, rel_type: str) -> DataFrame:
        """The bundle's edges of a type; derived ones are written when first asked for."""
        if rel_type not in self._kept:
            rows = self.bundle.of_type(rel_type)
            self._kept[rel_type] = stored(rows, "kept") if rel_type in ("OWNS", "DEPENDS_ON") else rows
        return self._kept[rel_type]

    @cached_property
    def answering(self) -> Bundle:
        """The bundle with its written OWNS and DEPENDS_ON, for what reads them several times."""
        return self.bundle.with_types({name: self.kept(name) for name in ("OWNS", "DEPENDS_ON")})

    @cached_property
    def observed(self) -> DataFrame:
        """The latest observation of each kind of evidence, or of all, if no fact can be later.

        Facts are reduced for it only if one is stated at a later time than all stored evidence has.
        """
        epoch = lambda df, name: df.agg(F.max(name).alias("observed_epoch"))
        written = union_all(
            self.stated.records.kept.select("observed_epoch"), self.gaps.gaps.evidence.select("observed_epoch")
        )
        # Co-change and dependencies of commits have the times of their commits; authorship has one.
        stated = union_all(
            *[epoch(df, "occurred_at_epoch") for df in (self.talk, self.commit_rows, self.dependencies, self.assertions)]
        )
        known = epoch(written, "observed_epoch").first()[0]
        bound = max(ASSERTED_FROM, epoch(stated, "observed_epoch").first()[0] or 0)
        if known is not None and bound <= known:
            return self.spark.createDataFrame([(known,)], "observed_epoch BIGINT")
        latest = self.bundle.evidence.groupBy("predicate").agg(F.max("observed_epoch").alias("observed_epoch"))
        return stored(latest, "observed")

    @property
    def owner_evidence(self) -> DataFrame:
        """Evidence of the kinds that ownership follows from."""
        kinds = ("authorship_aggregate", "ownership_assertion", "artifact")
        return self.bundle.evidence.where(F.col("predicate").isin(*kinds))

    def evidence_of(self, *records: DataFrame) -> DataFrame:
        return C.evidence_of(C.deduplicate(union_all(*records)), DATASET)

    @cached_property
    def chat_talk(self) -> DataFrame:
        """Every reply and mention of the conversations."""
        return slack_records(self.slack_rows).where("kind = 'communication_aggregate'")

    @cached_property
    def chat_edges(self) -> DataFrame:
        return stored(D.communicates(self.evidence_of(self.chat_talk), DATASET)[0], "chat")

    @cached_property
    def full_edges(self) -> DataFrame:
        """Who talks to whom by every reply and every mention of ``full_messages``."""
        talk = slack_records(chat_rows(self.full_messages, self.channel_modules))
        facts = self.evidence_of(talk.where("kind = 'communication_aggregate'"))
        return stored(D.communicates(facts, DATASET)[0], "full_chat")

    @cached_property
    def coordination(self) -> Bundle:
        """The bundle with the talk of the conversations as its communication."""
        return self.answering.with_types({"COMMUNICATES": self.chat_edges})

    @cached_property
    def talk_edges(self) -> DataFrame:
        return D.communicates(self.evidence_of(self.talk), DATASET)[0]

    @property
    def talk_pairs(self) -> DataFrame:
        """``talk_edges`` for what reads no weights. A record's id holds both its people, so its copies
        state one pair and need not be reduced first.
        """
        return D.communicates(C.evidence_of(self.talk, DATASET), DATASET)[0].select(
            "canonical_key", "rel_type", "source_key", "target_key"
        )

    @cached_property
    def recent_talk(self) -> DataFrame:
        return communication_window(self.talk_edges, WINDOW_DAYS)

    @cached_property
    def people_nodes(self) -> DataFrame:
        return canonicalize(self.people, DATASET).nodes

    @cached_property
    def artifact_records(self) -> DataFrame:
        return commit_artifacts(self.commit_rows)
