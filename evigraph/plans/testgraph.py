"""A fixed projection of the star-schema tables onto the graph tables, as SQL that Spark and DuckDB both run. It gives the registered queries a graph
to work on: a pure function of the tables, at any size."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..schema import Graph

_DIALECTS = {
    "spark": {"@SHA": "sha2({0}, 256)", "@EPOCH": "unix_seconds(CAST({0} AS TIMESTAMP))", "@NULLS": "CAST(NULL AS STRING)", "@NULLI": "CAST(NULL AS BIGINT)"},
    "duckdb": {"@SHA": "sha256({0})", "@EPOCH": "CAST(floor(epoch({0})) AS BIGINT)", "@NULLS": "CAST(NULL AS VARCHAR)", "@NULLI": "CAST(NULL AS BIGINT)"},
}
_NODE = "0.9 AS confidence, false AS is_tainted, false AS requires_human_review, 1704067200 AS created_at"
SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

VIEWS = {
    "g_nodes": f"""
SELECT id, kind, name, attrs, CAST(confidence AS DOUBLE) AS confidence, is_tainted, requires_human_review, CAST(created_at AS BIGINT) AS created_at, CAST(updated_at AS BIGINT) AS updated_at FROM (
SELECT 'market.' || CAST(r_regionkey AS STRING) AS id, 'Market' AS kind, r_name AS name, @NULLS AS attrs, {_NODE}, 1704067200 + r_regionkey AS updated_at FROM region
UNION ALL SELECT 'function.' || CAST(n_nationkey AS STRING), 'Function', n_name, @NULLS, {_NODE}, 1704068000 + n_nationkey FROM nation
UNION ALL SELECT 'team.' || CAST(s_suppkey AS STRING), 'Team', s_name, @NULLS, {_NODE}, 1704069000 + s_suppkey FROM supplier
UNION ALL SELECT 'customer.' || CAST(c_custkey AS STRING), 'Customer', c_name, '{{"segment":"' || c_mktsegment || '","balance":' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) || '}}', {_NODE}, 1704070000 + c_custkey FROM customer
UNION ALL SELECT 'product.' || CAST(p_partkey AS STRING), 'Product', p_name, '{{"type":"' || p_type || '","size":' || CAST(p_size AS STRING) || ',"as_of":' || CAST(1704067200 + p_partkey * 3600 AS STRING) || '}}',
  0.5 + (p_partkey % 50) / 100.0, p_partkey % 11 = 0, p_partkey % 5 = 0, 1704067200, 1704080000 + p_partkey FROM part
UNION ALL SELECT 'decision.' || CAST(o_orderkey AS STRING), 'Decision', 'Order ' || CAST(o_orderkey AS STRING), '{{"total":' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '}}', {_NODE}, 1704090000 + o_orderkey FROM orders
UNION ALL SELECT 'kpi.' || lower(replace(p_brand, '#', '_')), 'Kpi', replace(p_brand, '#', ' ') || ' revenue', '{{"definition":"Revenue of ' || p_brand || '","unit":"Count","period":"Month","value":' || CAST(count(*) AS STRING) || '}}', {_NODE}, 1704095000 FROM part GROUP BY p_brand
UNION ALL SELECT 'kpi.' || event_type, 'Kpi', event_type || ' rate', '{{"definition":"","unit":"Count","period":"Month"}}', {_NODE}, 1704096000 FROM events GROUP BY event_type
UNION ALL SELECT 'risk.' || lower(replace(replace(o_orderpriority, '-', '_'), ' ', '_')), 'Risk', o_orderpriority, @NULLS, {_NODE}, 1704097000 FROM orders GROUP BY o_orderpriority
UNION ALL SELECT 'action.' || lower(o_orderstatus), 'Action', 'Act on ' || o_orderstatus, CASE o_orderstatus WHEN 'F' THEN '{{"status":"Healthy"}}' WHEN 'O' THEN '{{"status":"AtRisk"}}' ELSE '{{}}' END, {_NODE}, 1704098000 FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'doc.' || substr(@SHA(coalesce(text, '')), 1, 8), 'Document', 'document ' || CAST(min(doc_id) AS STRING), @NULLS, {_NODE}, 1704099000 FROM documents GROUP BY 'doc.' || substr(@SHA(coalesce(text, '')), 1, 8)
) n""",
    "g_edges": """
SELECT id, from_id, to_id, kind, CAST(confidence AS DOUBLE) AS confidence, created_by, is_tainted, requires_human_review, CAST(1704067200 AS BIGINT) AS created_at FROM (
SELECT 'e.part.' || CAST(p_partkey AS STRING) AS id, 'product.' || CAST(p_partkey AS STRING) AS from_id, 'kpi.' || lower(replace(p_brand, '#', '_')) AS to_id,
  CASE p_partkey % 7 WHEN 0 THEN 'Influences' WHEN 1 THEN 'Improves' WHEN 2 THEN 'Causes' WHEN 3 THEN 'Blocks' WHEN 4 THEN 'Degrades' WHEN 5 THEN 'MeasuredBy' ELSE 'Contradicts' END AS kind,
  0.6 + (p_partkey % 4) / 10.0 AS confidence, 'Rule' AS created_by, p_partkey % 13 = 0 AS is_tainted, p_partkey % 5 = 0 AS requires_human_review FROM part
UNION ALL SELECT 'e.risk.' || b, 'kpi.brand_' || b, 'risk.' || r, 'Impacts', 0.7, 'Rule', false, false FROM (SELECT DISTINCT replace(p_brand, 'Brand#', '') AS b FROM part) x
  JOIN (SELECT DISTINCT lower(replace(replace(o_orderpriority, '-', '_'), ' ', '_')) AS r, CAST(substr(o_orderpriority, 1, 1) AS INT) AS k FROM orders) y ON CAST(b AS INT) % 5 + 1 = k
UNION ALL SELECT 'e.owner.' || b, 'kpi.brand_' || b, 'team.' || CAST(CAST(b AS INT) % 10 AS STRING), 'OwnedBy', 0.8, 'Manual', false, false FROM (SELECT DISTINCT replace(p_brand, 'Brand#', '') AS b FROM part) x
UNION ALL SELECT 'e.next.' || b || '.' || s, 'kpi.brand_' || b, 'action.' || s, 'NextAction', 0.75, 'Llm', false, CAST(b AS INT) % 3 = 0 FROM (SELECT DISTINCT replace(p_brand, 'Brand#', '') AS b FROM part) x
  JOIN (SELECT DISTINCT lower(o_orderstatus) AS s FROM orders) y ON (s = 'f' AND CAST(b AS INT) % 2 = 0) OR (s = 'o' AND CAST(b AS INT) % 2 = 1) OR (s = 'p' AND CAST(b AS INT) % 3 = 0)
UNION ALL SELECT 'e.fn.' || CAST(c_custkey AS STRING), 'customer.' || CAST(c_custkey AS STRING), 'function.' || CAST(c_nationkey AS STRING), 'InFunction', 0.9, 'Connector', false, false FROM customer
UNION ALL SELECT 'e.dep.' || CAST(n_nationkey AS STRING), 'function.' || CAST(n_nationkey AS STRING), 'market.' || CAST(n_regionkey AS STRING), 'DependsOn', 0.9, 'Connector', false, false FROM nation
UNION ALL SELECT 'e.dec.' || CAST(o_orderkey AS STRING), 'customer.' || CAST(o_custkey AS STRING), 'decision.' || CAST(o_orderkey AS STRING), 'DecidedBy', 0.85, 'Rule', false, false FROM orders
UNION ALL SELECT 'e.act.' || CAST(o_orderkey AS STRING), 'decision.' || CAST(o_orderkey AS STRING), 'action.' || lower(o_orderstatus), 'NextAction', 0.85, 'Rule', false, o_orderkey % 6 = 0 FROM orders
UNION ALL SELECT 'e.doc.' || CAST(min(doc_id) AS STRING), 'doc.' || substr(@SHA(coalesce(text, '')), 1, 8), CASE WHEN doc_id % 30 < 25 THEN 'kpi.brand_' || CAST(1 + doc_id % 25 AS STRING) ELSE 'kpi.' || CASE doc_id % 30 WHEN 25 THEN 'click' WHEN 26 THEN 'error' WHEN 27 THEN 'purchase' WHEN 28 THEN 'signup' ELSE 'view' END END, 'MentionedIn', 0.85, 'Rule', false, false
  FROM documents GROUP BY 'doc.' || substr(@SHA(coalesce(text, '')), 1, 8), CASE WHEN doc_id % 30 < 25 THEN 'kpi.brand_' || CAST(1 + doc_id % 25 AS STRING) ELSE 'kpi.' || CASE doc_id % 30 WHEN 25 THEN 'click' WHEN 26 THEN 'error' WHEN 27 THEN 'purchase' WHEN 28 THEN 'signup' ELSE 'view' END END
) e""",
    "g_evidence": """
SELECT DISTINCT id, source_node_id, 'Table' AS source_type, quote, @NULLS AS row_ref, @NULLS AS blob_sha256, ts, 'Connector' AS extractor, CAST(confidence AS DOUBLE) AS confidence, is_tainted, false AS requires_human_review FROM (
SELECT 'ev.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS id,
  CASE WHEN l_linenumber = 1 THEN 'kpi.' || lower(replace(p_brand, '#', '_')) ELSE 'decision.' || CAST(l_orderkey AS STRING) END AS source_node_id,
  CASE WHEN l_orderkey % 10 = 0 THEN @NULLS ELSE 'sold ' || CAST(CAST(l_quantity AS INT) AS STRING) || ' of ' || p_name END AS quote,
  @EPOCH(l_shipdate) AS ts, 0.5 + 4 * l_discount AS confidence, l_orderkey % 17 = 0 AS is_tainted FROM lineitem JOIN part ON l_partkey = p_partkey
) v""",
    "g_edge_evidence": """
SELECT DISTINCT 'e.part.' || CAST(l_partkey AS STRING) AS edge_id, 'ev.' || CAST(l_orderkey AS STRING) || '.' || CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || '.' || CAST(l_suppkey AS STRING) AS evidence_id FROM lineitem""",
    "g_lineage": """
SELECT DISTINCT edge_id, evidence_id, source_node_id, CASE WHEN x % 9 = 0 THEN @NULLI ELSE CAST(seen AS BIGINT) END AS ts FROM (
SELECT edge_id, 'ev.doc.' || CAST(x AS STRING) AS evidence_id, 'market.' || CAST(x % 7 AS STRING) AS source_node_id, x, 1704067200 + (x % 13) * 86400 AS seen FROM (
  SELECT edge_id, least_id AS x FROM (SELECT 'e.doc.' || CAST(min(doc_id) AS STRING) AS edge_id, min(doc_id) AS least_id FROM documents GROUP BY 'doc.' || substr(@SHA(coalesce(text, '')), 1, 8), doc_id % 30) a
  UNION ALL SELECT 'e.doc.' || CAST(min(doc_id) AS STRING), max(doc_id) - max(doc_id) % 4 FROM documents GROUP BY 'doc.' || substr(@SHA(coalesce(text, '')), 1, 8), doc_id % 30) d
UNION ALL SELECT 'e.fn.' || CAST(c_custkey AS STRING), 'ev.fn.' || CAST(c_custkey - c_custkey % 3 AS STRING), 'function.' || CAST((c_custkey - c_custkey % 3) % 30 AS STRING), c_custkey - c_custkey % 3, 1696000000 + ((c_custkey - c_custkey % 3) % 5) * 86400 FROM customer
UNION ALL SELECT @NULLS, 'ev.m.' || CAST(event_id AS STRING), 'kpi.' || event_type, event_id, @EPOCH(ts) FROM events
) l""",
    "g_metric_values": """
SELECT 'mv.' || CAST(event_id AS STRING) AS id, 'kpi.' || event_type AS kpi_node_id, 'metric.' || event_type AS metric_node_id, CAST(value AS DOUBLE) AS value, CASE WHEN event_id % 50 = 0 THEN 'COUNT' ELSE 'Count' END AS unit, @NULLI AS period_start, @NULLI AS period_end,
  CASE WHEN event_id % 3 = 0 THEN @EPOCH(date_trunc('day', ts)) END AS as_of, @EPOCH(ts) AS observed_at, 'ev.m.' || CAST(event_id AS STRING) AS evidence_id FROM events""",
    "g_document_cache": """
SELECT source || '/' || CAST(doc_id AS STRING) AS path, @SHA(coalesce(text, '')) AS sha256, @SHA(lower(coalesce(text, ''))) AS structural_sha256, CAST(1704067200 + doc_id AS BIGINT) AS indexed_at, 'doc.' || substr(@SHA(coalesce(text, '')), 1, 8) AS node_id FROM documents""",
}


def sql(view: str, dialect: str) -> str:
    """A view's SQL for spark or duckdb."""
    out = VIEWS[view]
    for macro, text in _DIALECTS[dialect].items():
        at = out.find(macro)
        while at >= 0:
            end = at + len(macro)
            if "{0}" in text:
                depth, stop = 0, end
                while True:
                    depth += {"(": 1, ")": -1}.get(out[stop], 0)
                    stop += 1
                    if not depth:
                        break
                out = out[:at] + text.format(out[end + 1 : stop - 1]) + out[stop:]
            else:
                out = out[:at] + text + out[end:]
            at = out.find(macro, at + 1)
    return out


def ctes(*views: str) -> str:
    """WITH clause for DuckDB that defines these views (without a trailing comma)."""
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({sql(v, 'duckdb')})" for v in views)


#: The column by which Spark deals out the rows of a view that are made distinct, so that joins by it need no other exchange.
_DEALT = {"g_evidence": "id", "g_edge_evidence": "evidence_id"}


def frame(spark: SparkSession, sf_dir: str, view: str, by: str | None = None) -> DataFrame:
    """One graph table, read from the star-schema tables that it needs. by: another column than that of _DEALT for the exchange of distinct rows."""
    text = sql(view, "spark")
    if by := by or _DEALT.get(view):
        head, _, body = text.partition("SELECT DISTINCT")
        columns, _, source = body.partition(" FROM ")
        rows = source.strip().removeprefix("(").rpartition(")")[0] if source.lstrip().startswith("(") else f"SELECT {columns} FROM {source}"
        names = columns if source.lstrip().startswith("(") else "*"
        text = f"{head}SELECT DISTINCT {names} FROM (SELECT /*+ REPARTITION({by}) */ * FROM ({rows}) r) v"
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCE_TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)}
    escaped = text.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", escaped), **used)


def graph(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = (), only: dict[str, tuple[str, ...]] | None = None, by: dict[str, str] | None = None) -> Graph:
    """All graph tables of a folder's star-schema tables. Those in `keep` are projected once, for queries that read them several times.

    only: columns of tables, each of their rows once, for queries that look at no others and do not count rows; by: columns as in `frame`."""
    from ..operators.graph import shared

    frames = {name: frame(spark, sf_dir, f"g_{name}", (by or {}).get(name)) for name in ("nodes", "edges", "evidence", "edge_evidence", "metric_values", "document_cache")}
    frames |= {name: frames[name].select(*columns).distinct() for name, columns in (only or {}).items()}
    frames |= {name: shared(frames[name]) for name in keep}
    candidates = spark.createDataFrame([], "id string, name string, definition string, detected_in array<string>, confidence double, proposed_at long, status string, merged_into string")
    return Graph(kpi_candidates=candidates, **frames)
