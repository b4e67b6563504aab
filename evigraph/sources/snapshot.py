"""Snapshots of a graph as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TABLES, Graph

VERSION = 1
LISTS = ("nodes", "edges", "evidence", "edge_evidence", "metric_values", "kpi_candidates", "document_cache")


def _key(name: str) -> str:
    return {"edge_evidence": "edge_id", "document_cache": "path"}.get(name, "id")


def export(g: Graph, folder: str, exported_at: int, workspace: str = "default") -> None:
    """Writes each table as JSON lines, in order of ids, and a head with the version."""
    spark = g.nodes.sparkSession
    for name, frame in g.frames().items():
        frame.orderBy(*([_key(name), "evidence_id"] if name == "edge_evidence" else [_key(name)])).write.mode("overwrite").json(f"{folder}/{name}")
    head = json.dumps({"schema_version": VERSION, "exported_at": exported_at, "workspace_id": workspace})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/head")


def load(spark: SparkSession, folder: str) -> Graph:
    """Reads a snapshot; another version is refused before anything is read."""
    head = json.loads(spark.read.text(f"{folder}/head").first()[0])
    if head.get("schema_version") != VERSION:
        raise ValueError(f"snapshot version {head.get('schema_version')} is not {VERSION}")
    return Graph(**{name: spark.read.schema(schema).json(f"{folder}/{name}") for name, schema in TABLES.items()})


def import_log(g: Graph, batch: int) -> DataFrame:
    """A snapshot as a batch of mutations: nodes, then evidence, edges, values, candidates."""
    from ..operators.mutations import log_rows

    pairs = g.edge_evidence.groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
    frames = [("upsert_node", g.nodes), ("upsert_evidence", g.evidence), ("upsert_edge", g.edges.join(pairs, "id", "left")), ("record_value", g.metric_values), ("propose_candidate", g.kpi_candidates)]
    return log_rows(frames, batch)
