"""Snapshots: the five tables as Parquet with a manifest of counts and content digests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgweft.operators.normalize import union_all
from orgweft.plans.bundle import Bundle
from orgweft.schemas import (
    EDGE_COLUMNS,
    EDGE_PROPS,
    EVIDENCE_COLUMNS,
    META,
    NODE_COLUMNS,
    NODE_PROPS,
)

SCHEMA_VERSION = "1.0.0"
TABLES = ("nodes", "edges", "evidence", "node_evidence", "edge_evidence", "limitations")
# Lens jobs read few node labels and relation types, so these are folders.
PARTITIONED_BY = {"nodes": "label", "edges": "rel_type"}


def node_table(nodes: DataFrame) -> DataFrame:
    return nodes.select(*NODE_COLUMNS[:-1], F.to_json("props").alias("properties_json"))


def edge_table(edges: DataFrame) -> DataFrame:
    return edges.select(*EDGE_COLUMNS[:-1], F.to_json("props").alias("properties_json"))


def tables_of(bundle: Bundle) -> dict[str, DataFrame]:
    return {
        "nodes": node_table(bundle.nodes),
        "edges": edge_table(bundle.edges),
        "evidence": bundle.evidence.select(*EVIDENCE_COLUMNS),
        "node_evidence": bundle.node_evidence.select("node_id", "node_key", "evidence_id"),
        "edge_evidence": bundle.edge_evidence.select("edge_id", "edge_key", "evidence_id"),
        "limitations": bundle.limitations.select("limitation"),
    }


def table_digest(table: DataFrame) -> DataFrame:
    """``n, digest`` of the rows, whatever their order or files.

    One aggregation: the row count, the sum and the exclusive-or of two row hashes.
    """
    columns = [F.col(name) for name in sorted(table.columns)]
    row = F.xxhash64(*columns)
    other = F.xxhash64(F.lit(1), *columns)
    parts = table.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"),
        F.coalesce(F.sum(other.cast("decimal(38,0)")), F.lit(0)).alias("s"),
    )
    text = F.concat_ws("|", F.col("n").cast("string"), F.col("x").cast("string"), F.col("s").cast("string"))
    return parts.select("n", F.sha2(text, 256).alias("digest"))


def _digests(tables: dict[str, DataFrame]) -> dict[str, tuple[int, str]]:
    frame = union_all(
        *[table_digest(t).select(F.lit(name).alias("name"), "n", "digest") for name, t in tables.items()]
    )
    return {row["name"]: (row["n"], row["digest"]) for row in frame.collect()}


def snapshot_manifest(dataset_id: str, digests: dict[str, tuple[int, str]]) -> dict:
    counts = {name: digests[name][0] for name in sorted(digests)}
    table_sha256 = {name: digests[name][1] for name in sorted(digests)}
    payload = json.dumps(
        {"row_counts": counts, "table_sha256": table_sha256}, sort_keys=True, separators=(",", ":")
    )
    content = hashlib.sha256(payload.encode()).hexdigest()
    return {
        "snapshot_id": f"{dataset_id}:{content[:16]}",
        "dataset_id": dataset_id,
        "schema_version": SCHEMA_VERSION,
        "content_sha256": content,
        "row_counts": counts,
        "table_sha256": table_sha256,
    }


def _read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def write_snapshot(bundle: Bundle, root: str) -> dict:
    """Write all tables, then the manifest, whose presence marks a whole snapshot."""
    spark = bundle.nodes.sparkSession
    for name, table in tables_of(bundle).items():
        writer = table.write.mode("overwrite")
        if name in PARTITIONED_BY:
            writer = writer.partitionBy(PARTITIONED_BY[name])
        writer.parquet(f"{root}/{name}.parquet")
    stored = {name: _read_table(spark, root, name) for name in TABLES}
    manifest = snapshot_manifest(bundle.dataset_id, _digests(stored))
    text = json.dumps(manifest, sort_keys=True)
    spark.createDataFrame([(text,)], "value STRING").coalesce(1).write.mode("overwrite").text(
        f"{root}/manifest.json"
    )
    return manifest


def read_manifest(spark: SparkSession, root: str) -> dict:
    return json.loads(spark.read.text(f"{root}/manifest.json").first()["value"])


def snapshot_checks(spark: SparkSession, root: str) -> DataFrame:
    """``name, expected, actual, matches``: stored digests against the rows on disk."""
    expected = read_manifest(spark, root)["table_sha256"]
    actual = _digests({name: _read_table(spark, root, name) for name in expected})
    rows = [(name, digest, actual[name][1]) for name, digest in expected.items()]
    return spark.createDataFrame(rows, "name STRING, expected STRING, actual STRING").withColumn(
        "matches", F.col("expected") == F.col("actual")
    )


def hydrate_nodes(table: DataFrame) -> DataFrame:
    return table.withColumn("props", F.from_json("properties_json", NODE_PROPS)).select(*NODE_COLUMNS)


def hydrate_edges(table: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Edges with typed properties. Tables without endpoint keys take them from the nodes."""
    if "source_key" not in table.columns:
        if nodes is None:
            raise ValueError("edges without endpoint keys need the nodes")
        keys = nodes.select("id", "canonical_key")
        table = table.join(
            keys.withColumnsRenamed({"id": "source_id", "canonical_key": "source_key"}), "source_id"
        ).join(
            keys.withColumnsRenamed({"id": "target_id", "canonical_key": "target_key"}), "target_id"
        )
    return table.withColumn("props", F.from_json("properties_json", EDGE_PROPS)).select(*EDGE_COLUMNS)


def hydrate_evidence(table: DataFrame) -> DataFrame:
    """Evidence with its metadata parsed again for the derivation operators."""
    shape = (
        f"author_external_id STRING, parent_external_id STRING, subjects ARRAY<STRING>, "
        f"metadata STRUCT<{META.replace(' ', ': ').replace(',: ', ', ')}>"
    )
    parsed = table.withColumn("m", F.from_json("metadata_json", shape))
    return parsed.select(
        *EVIDENCE_COLUMNS,
        F.col("m.metadata").alias("meta"),
        F.col("m.parent_external_id").alias("parent_external_id"),
        F.col("m.subjects").alias("subjects"),
        F.col("m.author_external_id").alias("author_external_id"),
    )


def read_snapshot(spark: SparkSession, root: str, *, verify: bool = True) -> Bundle:
    """The bundle of a snapshot folder; ``verify`` refuses tables that were changed."""
    manifest = read_manifest(spark, root)
    if verify:
        broken = snapshot_checks(spark, root).where("NOT matches").select("name").collect()
        if broken:
            raise ValueError(f"snapshot table digest mismatch: {[row['name'] for row in broken]}")
    return Bundle(
        dataset_id=manifest["dataset_id"],
        nodes=hydrate_nodes(_read_table(spark, root, "nodes")),
        edges=hydrate_edges(_read_table(spark, root, "edges")),
        evidence=hydrate_evidence(_read_table(spark, root, "evidence")),
        node_evidence=_read_table(spark, root, "node_evidence"),
        edge_evidence=_read_table(spark, root, "edge_evidence"),
        limitations=_read_table(spark, root, "limitations"),
    )


def read_plain_snapshot(spark: SparkSession, root: str, dataset_id: str) -> Bundle:
    """A snapshot whose tables are single Parquet files without endpoint keys."""
    nodes = hydrate_nodes(_read_table(spark, root, "nodes"))
    edges = hydrate_edges(_read_table(spark, root, "edges"), nodes)
    keyed = lambda table, kind, rows: _read_table(spark, root, table).join(
        rows.select(F.col("id").alias(f"{kind}_id"), F.col("canonical_key").alias(f"{kind}_key")),
        f"{kind}_id",
    )
    notes = spark.read.option("multiLine", True).schema("limitations ARRAY<STRING>").json(
        f"{root}/limitations.json"
    )
    return Bundle(
        dataset_id=dataset_id,
        nodes=nodes,
        edges=edges,
        evidence=hydrate_evidence(_read_table(spark, root, "evidence")),
        node_evidence=keyed("node_evidence", "node", nodes),
        edge_evidence=keyed("edge_evidence", "edge", edges),
        limitations=notes.select(F.explode("limitations").alias("limitation")),
    )


def evidence_by_id(spark: SparkSession, root: str, ids: list[str]) -> DataFrame:
    """Evidence rows by id; the ids are pushed down to the Parquet scan."""
    return _read_table(spark, root, "evidence").where(F.col("evidence_id").isin(ids))


def snapshot_limitations(spark: SparkSession, root: str) -> DataFrame:
    return _read_table(spark, root, "limitations")


def snapshot_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable manifest below ``root``; unreadable ones are left out."""
    shape = (
        "snapshot_id STRING, dataset_id STRING, schema_version STRING, content_sha256 STRING, "
        "row_counts MAP<STRING, BIGINT>"
    )
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "part-*.txt").text(
        f"{root}/*/manifest.json"
    )
    parsed = text.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/manifest\.json/", 1).alias("folder"),
        F.from_json("value", shape).alias("m"),
    )
    return parsed.where("m.snapshot_id IS NOT NULL").select("folder", "m.*")


def file_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, sha256`` of small source files."""
    raw = spark.read.format("binaryFile").load(paths)
    return raw.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.sha2("content", 256).alias("sha256")
    )


def file_checks(digests: DataFrame, counts: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose digest or record count differs from the manifest's.

    ``counts``: file, records. ``expected``: file, sha256, record_count.
    """
    found = digests.withColumnRenamed("sha256", "actual_sha256").join(counts, "file", "left")
    joined = expected.join(found, "file", "left")
    wrong_hash = F.coalesce(F.col("sha256") != F.col("actual_sha256"), F.lit(True))
    wrong_count = F.coalesce(F.col("record_count") != F.col("records"), F.lit(True))
    return joined.where(wrong_hash | wrong_count).select(
        "file", wrong_hash.alias("wrong_digest"), wrong_count.alias("wrong_count")
    )
