"""Tables of the graph and their fixed vocabularies. Times are unix seconds in UTC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Kinds of nodes and edges, extractors, sources of evidence, statuses.
NODE_KINDS = ("Kpi", "Metric", "Objective", "Initiative", "Risk", "Opportunity", "Decision", "Insight", "Document", "Person", "Team", "Customer", "Function", "Product", "Market", "Process", "System", "Action")
EDGE_KINDS = (
    "Influences", "Causes", "CorrelatesWith", "DependsOn", "DerivedFrom", "Blocks", "Improves", "Degrades", "OwnedBy", "MeasuredBy",
    "EvidencedBy", "MentionedIn", "DecidedBy", "AssignedTo", "InFunction", "ForProduct", "Impacts", "NextAction", "Contradicts", "Corroborates",
)
EXTRACTORS = ("Manual", "Connector", "Rule", "Llm", "Calculated")
SOURCE_TYPES = ("Document", "Table", "Note", "Meeting", "Manual", "System")
KPI_STATUSES = ("Healthy", "AtRisk", "Critical", "Unknown")
CANDIDATE_STATUSES = ("pending", "approved", "rejected", "merged")
#: Confidences by how a fact came in.
CONFIDENCE = {"Manual": 1.0, "Connector": 0.95, "Rule": 0.85, "Llm": 0.5, "cooccurrence": 0.6, "bridge": 0.5}
DRIVERS, BLOCKERS = ("Influences", "Improves", "Causes"), ("Blocks", "Degrades")

NODES = "id string, kind string, name string, attrs string, confidence double, is_tainted boolean, requires_human_review boolean, created_at long, updated_at long"
EDGES = "id string, from_id string, to_id string, kind string, confidence double, created_by string, is_tainted boolean, requires_human_review boolean, created_at long"
EVIDENCE = "id string, source_node_id string, source_type string, quote string, row_ref string, blob_sha256 string, ts long, extractor string, confidence double, is_tainted boolean, requires_human_review boolean"
EDGE_EVIDENCE = "edge_id string, evidence_id string"
METRIC_VALUES = "id string, kpi_node_id string, metric_node_id string, value double, unit string, period_start long, period_end long, as_of long, observed_at long, evidence_id string"
KPI_CANDIDATES = "id string, name string, definition string, detected_in array<string>, confidence double, proposed_at long, status string, merged_into string"
DOCUMENT_CACHE = "path string, sha256 string, structural_sha256 string, indexed_at long, node_id string"
PAGE_SECTIONS = "section_id string, doc_node_id string, parent_section_id string, ordinal int, level int, title string, path string, summary string, text string, span_start long, span_end long"
BLOCK = "struct<kind:string,level:int,text:string,language:string,span_start:bigint,span_end:bigint>"
TABLE = "struct<headers:array<string>,rows:array<array<string>>,span_start:bigint,span_end:bigint>"
NORMALIZED = f"id string, source_path string, sha256 string, title string, blocks array<{BLOCK}>, tables array<{TABLE}>, error string"
TABLES = {"nodes": NODES, "edges": EDGES, "evidence": EVIDENCE, "edge_evidence": EDGE_EVIDENCE, "metric_values": METRIC_VALUES, "kpi_candidates": KPI_CANDIDATES, "document_cache": DOCUMENT_CACHE}


@dataclass
class Graph:
    """The frames of one graph."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    edge_evidence: DataFrame
    metric_values: DataFrame
    kpi_candidates: DataFrame
    document_cache: DataFrame

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def register_views(self, prefix: str = "") -> None:
        """Makes the frames views of the session, for SQL over them."""
        for name, frame in self.frames().items():
            frame.createOrReplaceTempView(prefix + name)


def empty_graph(spark: SparkSession) -> Graph:
    return Graph(**{name: spark.createDataFrame([], schema) for name, schema in TABLES.items()})
