"""The registered queries over the graph projection, each with the SQL of its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells
from ..functions import text as T
from ..operators import diff, graph, search, series
from ..schema import Graph
from . import testgraph as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Anchor of month, year and cutoff queries: 2024-01-15 12:00:00 UTC.
ANCHOR = 1705320000


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Registers a query; views: graph tables that its SQL starts from."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = (P.ctes(*views) + (",\n" if sql.lstrip().startswith("--more") else "\n") + sql.replace("--more", "")) if views else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def noisy(c: str) -> str:
    return f"greatest(0.0, least(1.0, 1 - coalesce(product(1 - {c}), 1.0)))"


ALL = ("g_nodes", "g_edges", "g_evidence", "g_edge_evidence")


@query(
    "focus_kpi_sections",
    """--more k AS (SELECT id FROM g_nodes WHERE kind = 'Kpi'),
i AS (SELECT to_id AS kpi_id, CASE WHEN e.kind IN ('Influences', 'Improves', 'Causes') THEN 'driver' ELSE 'blocker' END AS section, e.id AS edge_id, e.kind, from_id AS neighbour_id, confidence FROM g_edges e WHERE e.kind IN ('Influences', 'Improves', 'Causes', 'Blocks', 'Degrades')),
o AS (SELECT from_id AS kpi_id, CASE WHEN e.kind = 'OwnedBy' THEN 'owner' ELSE 'risk' END AS section, e.id AS edge_id, e.kind, to_id AS neighbour_id, e.confidence FROM g_edges e JOIN g_nodes n ON n.id = e.to_id WHERE e.kind = 'OwnedBy' OR n.kind = 'Risk'
  QUALIFY e.kind <> 'OwnedBy' OR row_number() OVER (PARTITION BY from_id, e.kind = 'OwnedBy' ORDER BY e.id DESC) = 1)
SELECT kpi_id, section, edge_id, x.kind, neighbour_id, n.name AS neighbour_name, round(x.confidence, 6) AS edge_confidence FROM (SELECT * FROM i UNION ALL SELECT * FROM o) x JOIN g_nodes n ON n.id = neighbour_id WHERE kpi_id IN (SELECT id FROM k)""",
    ALL[:2],
)
def focus_kpi_sections(spark, sf_dir):
    return graph.focus(P.graph(spark, sf_dir))


FLAGSHIP_SQL = f"""SELECT to_id AS kpi_id, CASE WHEN e.kind IN ('Influences', 'Improves', 'Causes') THEN 'driver' ELSE 'blocker' END AS section, e.id AS edge_id, n.name AS neighbour_name, round({noisy('v.confidence')}, 6) AS evidence_confidence, count(*) AS n_evidence
FROM g_edges e JOIN g_nodes k ON k.id = e.to_id AND k.kind = 'Kpi' JOIN g_nodes n ON n.id = e.from_id JOIN g_edge_evidence j ON j.edge_id = e.id JOIN g_evidence v ON v.id = j.evidence_id
WHERE e.kind IN ('Influences', 'Improves', 'Causes', 'Blocks', 'Degrades') GROUP BY ALL"""


@query("kpi_drivers_with_evidence", "SELECT * FROM (" + FLAGSHIP_SQL.replace("GROUP BY ALL", "GROUP BY to_id, e.kind, e.id, n.name") + ")", ALL)
def kpi_drivers_with_evidence(spark, sf_dir):
    """The flagship: drivers and blockers of all KPIs with the noisy-or confidence of the evidence of their edges."""
    g = P.graph(spark, sf_dir)
    found = graph.focus(g).where("section IN ('driver', 'blocker')")
    return found.join(graph.edge_confidence(g), "edge_id").select("kpi_id", "section", "edge_id", "neighbour_name", "evidence_confidence", "n_evidence")


@query(
    "kpi_signed_confidence",
    f"""SELECT to_id AS kpi_id, round({noisy("CASE WHEN e.kind <> 'Contradicts' THEN v.confidence END")}, 6) AS support, round({noisy("CASE WHEN e.kind = 'Contradicts' THEN v.confidence END")}, 6) AS contradiction,
  round({noisy("CASE WHEN e.kind <> 'Contradicts' THEN v.confidence END")} * (1 - {noisy("CASE WHEN e.kind = 'Contradicts' THEN v.confidence END")}), 6) AS confidence, count(*) AS n_evidence
FROM g_edges e JOIN g_nodes k ON k.id = e.to_id AND k.kind = 'Kpi' JOIN g_edge_evidence j ON j.edge_id = e.id JOIN g_evidence v ON v.id = j.evidence_id GROUP BY to_id""",
    ALL,
)
def kpi_signed_confidence(spark, sf_dir):
    return graph.signed_confidence(P.graph(spark, sf_dir))


@query("evidence_by_node", "SELECT e.to_id AS node_id, e.id AS edge_id, v.id AS evidence_id, quote, v.confidence FROM g_edges e JOIN g_edge_evidence j ON j.edge_id = e.id JOIN g_evidence v ON v.id = j.evidence_id", ALL[1:])
def evidence_by_node(spark, sf_dir):
    return graph.evidence_of_nodes(P.graph(spark, sf_dir))


@query("evidence_by_edge", "SELECT edge_id, v.id AS evidence_id, source_node_id, quote, v.confidence FROM g_edge_evidence j JOIN g_evidence v ON v.id = j.evidence_id", ALL[2:])
def evidence_by_edge(spark, sf_dir):
    return graph.evidence_of_edges(P.graph(spark, sf_dir))


@query(
    "explain_kpi_text",
    f"""--more own AS (SELECT source_node_id AS id, string_agg('- ' || quote || ' (' || CAST(CAST(round_even(confidence * 100, 0) AS INT) AS VARCHAR) || '%)', chr(10) || chr(10) ORDER BY id) FILTER (WHERE quote IS NOT NULL) AS q, round({noisy('confidence')}, 6) AS c, count(*) AS n FROM g_evidence GROUP BY source_node_id)
SELECT k.id AS kpi_id, concat_ws(chr(10) || chr(10), k.name, nullif(json_extract_string(k.attrs, '$.definition'), ''), q) AS rationale, coalesce(c, 0.0) AS confidence, coalesce(n, 0) AS n_evidence FROM g_nodes k LEFT JOIN own ON own.id = k.id WHERE k.kind = 'Kpi'""",
    ("g_nodes", "g_evidence"),
)
def explain_kpi_text(spark, sf_dir):
    return graph.explain(P.graph(spark, sf_dir))


@query(
    "impact_radius_d3",
    """--more s AS (SELECT DISTINCT from_id, to_id FROM g_edges), st AS (SELECT id AS start FROM g_nodes),
l1 AS (SELECT start, to_id AS id, min(start || '>' || to_id) AS path FROM st JOIN s ON from_id = start WHERE to_id <> start GROUP BY 1, 2),
l2 AS (SELECT start, to_id AS id, min(path || '>' || to_id) AS path FROM l1 JOIN s ON from_id = l1.id WHERE to_id <> start
  AND NOT EXISTS (SELECT 1 FROM l1 a WHERE a.start = l1.start AND a.id = to_id) GROUP BY 1, 2),
l3 AS (SELECT start, to_id AS id, min(path || '>' || to_id) AS path FROM l2 JOIN s ON from_id = l2.id WHERE to_id <> start
  AND NOT EXISTS (SELECT 1 FROM l1 a WHERE a.start = l2.start AND a.id = to_id) AND NOT EXISTS (SELECT 1 FROM l2 a WHERE a.start = l2.start AND a.id = to_id) GROUP BY 1, 2)
SELECT start, id AS node_id, 1 AS depth, path FROM l1 UNION ALL SELECT start, id, 2, path FROM l2 UNION ALL SELECT start, id, 3, path FROM l3""",
    ALL[:2],
)
def impact_radius_d3(spark, sf_dir):
    """The impact radius from every node of the graph."""
    g = P.graph(spark, sf_dir)
    return graph.impact(g.edges, g.nodes.select(F.col("id").alias("start")), 3)


@query(
    "trace_decision",
    """--more r AS (SELECT to_id AS decision_id, 'caused_by' AS role, from_id AS item_id FROM g_edges WHERE kind IN ('DecidedBy', 'Causes') AND from_id IN (SELECT id FROM g_nodes)
  UNION ALL SELECT from_id, 'next_action', to_id FROM g_edges WHERE kind = 'NextAction' AND to_id IN (SELECT id FROM g_nodes) UNION ALL SELECT source_node_id, 'evidenced_by', id FROM g_evidence)
SELECT * FROM r WHERE decision_id IN (SELECT id FROM g_nodes WHERE kind = 'Decision')""",
    ALL[:3],
)
def trace_decision(spark, sf_dir):
    return graph.trace_decisions(P.graph(spark, sf_dir))


_ACTIONS = """SELECT e.from_id AS kpi_id, e.id AS edge_id, a.id AS action_id, a.name AS action_name, CASE WHEN json_extract_string(a.attrs, '$.status') IN ('Healthy', 'AtRisk', 'Critical', 'Unknown') THEN json_extract_string(a.attrs, '$.status') END AS status, round(e.confidence, 6) AS edge_confidence
FROM g_edges e JOIN g_nodes a ON a.id = e.to_id AND a.kind = 'Action'"""


@query("suggest_actions", _ACTIONS + " WHERE NOT e.requires_human_review AND coalesce(json_extract_string(a.attrs, '$.status'), 'AtRisk') = 'AtRisk'", ALL[:2])
def suggest_actions(spark, sf_dir):
    return graph.suggest_actions(P.graph(spark, sf_dir), ("AtRisk",))


@query("suggest_actions_unreviewed", _ACTIONS, ALL[:2])
def suggest_actions_unreviewed(spark, sf_dir):
    return graph.suggest_actions(P.graph(spark, sf_dir), None, True)


@query(
    "graph_stats",
    """SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_nodes WHERE kind = 'Document') AS documents, (SELECT count(*) FROM g_nodes WHERE kind <> 'Document') AS concepts,
  (SELECT round(coalesce(avg(confidence), 0.0), 6) FROM g_nodes WHERE kind <> 'Document') AS avg_confidence, (SELECT count(*) FROM g_nodes WHERE is_tainted) AS tainted_nodes, (SELECT count(*) FROM g_nodes WHERE requires_human_review) AS review_nodes,
  (SELECT count(*) FROM g_edges) AS edges, (SELECT count(*) FROM g_edges WHERE is_tainted) AS tainted_edges, (SELECT count(*) FROM g_edges WHERE requires_human_review) AS review_edges, (SELECT count(*) FROM g_evidence) AS evidence""",
    ALL[:3],
)
def graph_stats(spark, sf_dir):
    return graph.stats(P.graph(spark, sf_dir))


@query("nodes_by_kind", "SELECT kind, count(*) AS n FROM g_nodes GROUP BY kind", ALL[:1])
def nodes_by_kind(spark, sf_dir):
    return graph.kind_counts(P.graph(spark, sf_dir).nodes)


@query(
    "document_summaries",
    """SELECT n.id, n.name, c.path, c.indexed_at, coalesce(m, 0) AS n_mentions, coalesce(v, 0) AS n_evidence FROM g_nodes n LEFT JOIN g_document_cache c ON c.node_id = n.id
LEFT JOIN (SELECT from_id, count(*) AS m FROM g_edges WHERE kind = 'MentionedIn' GROUP BY 1) x ON x.from_id = n.id LEFT JOIN (SELECT source_node_id, count(*) AS v FROM g_evidence GROUP BY 1) y ON y.source_node_id = n.id WHERE n.kind = 'Document'""",
    (*ALL[:3], "g_document_cache"),
)
def document_summaries(spark, sf_dir):
    return graph.document_summaries(P.graph(spark, sf_dir))


@query("source_document_counts", "SELECT to_id AS concept_id, count(DISTINCT from_id) AS n_documents FROM g_edges WHERE kind = 'MentionedIn' AND from_id IN (SELECT id FROM g_nodes WHERE kind = 'Document') GROUP BY 1", ALL[:2])
def source_document_counts(spark, sf_dir):
    return graph.source_document_counts(P.graph(spark, sf_dir))


@query("mentioned_concepts", "SELECT DISTINCT from_id AS document_id, to_id AS concept_id FROM g_edges WHERE kind = 'MentionedIn'", ALL[1:2])
def mentioned_concepts(spark, sf_dir):
    return graph.mentioned_concepts(P.graph(spark, sf_dir))


@query(
    "kpi_candidates",
    """SELECT n.id AS kpi_id, n.name, round(least(1.0, greatest(0.0, n.confidence * least(v, 10) / 10)), 6) AS score, d AS n_documents, v AS n_evidence FROM g_nodes n JOIN (SELECT e.to_id AS id, count(DISTINCT evidence_id) AS v FROM g_edges e JOIN g_edge_evidence j ON j.edge_id = e.id JOIN g_evidence x ON x.id = j.evidence_id GROUP BY 1) a ON a.id = n.id
JOIN (SELECT to_id AS id, count(DISTINCT from_id) AS d FROM g_edges WHERE kind = 'MentionedIn' GROUP BY 1) b ON b.id = n.id WHERE n.kind = 'Kpi' AND v >= 3 AND d >= 2""",
    ALL,
)
def kpi_candidates(spark, sf_dir):
    return series.discover(P.graph(spark, sf_dir), by_edges=True)


_TOUCH = "t AS (SELECT from_id AS node, evidence_id FROM g_edges e JOIN g_edge_evidence j ON j.edge_id = e.id UNION SELECT to_id, evidence_id FROM g_edges e JOIN g_edge_evidence j ON j.edge_id = e.id UNION SELECT source_node_id, id FROM g_evidence)"


#: What quotes of nodes are made of.
_QUOTED = {"evidence": ("id", "source_node_id", "quote")}


@query("node_quotes", f"--more {_TOUCH} SELECT node AS node_id, string_agg(quote, ' | ' ORDER BY quote) AS quotes FROM (SELECT DISTINCT node, quote FROM t JOIN g_evidence v ON v.id = t.evidence_id WHERE quote IS NOT NULL) GROUP BY 1", ALL)
def node_quotes(spark, sf_dir):
    return graph.node_quotes(P.graph(spark, sf_dir, only=_QUOTED))


@query(
    "display_confidence",
    f"""--more {_TOUCH}, a AS (SELECT node, {noisy('confidence')} AS c, count(*) AS n, bool_or(requires_human_review) AS r FROM t JOIN g_evidence v ON v.id = t.evidence_id GROUP BY 1),
f AS (SELECT from_id AS node FROM g_edges WHERE requires_human_review UNION SELECT to_id FROM g_edges WHERE requires_human_review)
SELECT n.id AS node_id, round(coalesce(c, n.confidence), 6) AS shown, coalesce(n, 0) AS n_evidence, (n.requires_human_review AND (n.kind = 'Kpi' OR coalesce(c, n.confidence) < 0.5)) OR n.id IN (SELECT node FROM f) OR coalesce(r, false) AS review FROM g_nodes n LEFT JOIN a ON a.node = n.id""".replace("coalesce(n, 0)", "coalesce(a.n, 0)"),
    ALL,
)
def display_confidence(spark, sf_dir):
    return graph.display_confidence(P.graph(spark, sf_dir, by={"edge_evidence": "edge_id"}))


@query("node_degree", "SELECT node AS node_id, count(*) AS degree FROM (SELECT from_id AS node FROM g_edges UNION ALL SELECT to_id FROM g_edges) GROUP BY 1", ALL[1:2])
def node_degree(spark, sf_dir):
    return graph.degrees(P.graph(spark, sf_dir).edges)


@query(
    "neighbour_sets",
    "SELECT a AS node_id, b AS neighbour FROM (SELECT from_id AS a, to_id AS b FROM g_edges UNION SELECT to_id, from_id FROM g_edges) WHERE a <> b",
    ALL[1:2],
)
def neighbour_sets(spark, sf_dir):
    """The neighbour sets of all nodes, a row for each member, so that a hot node's set is in no single row."""
    return graph.neighbour_pairs(P.graph(spark, sf_dir).edges)


@query("visible_edges", "SELECT kind, count(*) AS n FROM g_edges WHERE kind <> 'MentionedIn' GROUP BY 1", ALL[1:2])
def visible_edges(spark, sf_dir):
    return graph.visible_edges(P.graph(spark, sf_dir).edges).groupBy("kind").agg(F.count("*").alias("n"))


_DOCS = "d AS (SELECT DISTINCT node_id AS id FROM g_document_cache WHERE path LIKE 'src0/%'), i AS (SELECT id FROM d UNION SELECT to_id FROM g_edges WHERE kind = 'MentionedIn' AND from_id IN (SELECT id FROM d))"


@query("scoped_subgraph", f"--more {_DOCS} SELECT e.kind, count(*) AS n FROM g_edges e WHERE from_id IN (SELECT id FROM i) AND to_id IN (SELECT id FROM i) GROUP BY 1", ("g_edges", "g_document_cache"))
def scoped_subgraph(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    docs = g.document_cache.where(F.col("path").startswith("src0/")).select(F.col("node_id").alias("id")).distinct()
    return graph.scoped_subgraph(g, docs)[1].groupBy("kind").agg(F.count("*").alias("n"))


@query("orphan_edges", "SELECT id, kind FROM g_edges WHERE id NOT IN (SELECT edge_id FROM g_edge_evidence)", ("g_edges", "g_edge_evidence"))
def orphan_edges(spark, sf_dir):
    return graph.orphan_edges(P.graph(spark, sf_dir, only={"edge_evidence": ("edge_id",)}, by={"edge_evidence": "edge_id"})).select("id", "kind")


# Series.
_BT = "coalesce(as_of, observed_at)"


@query("metric_latest2", f"SELECT kpi_node_id, id, value, row_number() OVER (PARTITION BY kpi_node_id ORDER BY {_BT} DESC, observed_at DESC, id DESC) AS rank FROM g_metric_values QUALIFY rank <= 2", ("g_metric_values",))
def metric_latest2(spark, sf_dir):
    return series.latest(P.graph(spark, sf_dir).metric_values, 2).select("kpi_node_id", "id", "value", F.col("rank").cast("long").alias("rank"))


_TREND = f"""r AS (SELECT kpi_node_id, value, row_number() OVER (PARTITION BY kpi_node_id ORDER BY {_BT} DESC, observed_at DESC, id DESC) AS k FROM g_metric_values),
p AS (SELECT kpi_node_id AS kpi_id, max(CASE WHEN k = 1 THEN value END) AS value, max(CASE WHEN k = 2 THEN value END) AS previous FROM r WHERE k <= 2 GROUP BY 1),
tr AS (SELECT *, CASE WHEN previous IS NULL THEN 'Unknown' WHEN value > previous THEN 'Up' WHEN value < previous THEN 'Down' ELSE 'Flat' END AS trend FROM p)"""


@query("kpi_trend", f"--more {_TREND} SELECT * FROM tr", ("g_metric_values",))
def kpi_trend(spark, sf_dir):
    return series.trends(P.graph(spark, sf_dir).metric_values)


@query(
    "kpi_recompute",
    f"""--more {_TREND}, s AS (SELECT to_id AS kpi_id, {noisy("CASE WHEN e.kind = 'Contradicts' THEN v.confidence END")} AS c, {noisy("CASE WHEN e.kind <> 'Contradicts' THEN v.confidence END")} AS p FROM g_edges e JOIN g_edge_evidence j ON j.edge_id = e.id JOIN g_evidence v ON v.id = j.evidence_id GROUP BY 1)
SELECT n.id AS kpi_id, round(coalesce(round(p * (1 - c), 6), n.confidence), 6) AS confidence, coalesce(trend, 'Unknown') AS trend, value, n.requires_human_review OR coalesce(c, 0) > 0 AS review, CAST({ANCHOR} AS BIGINT) AS at FROM g_nodes n LEFT JOIN s ON s.kpi_id = n.id LEFT JOIN tr ON tr.kpi_id = n.id WHERE n.kind = 'Kpi'""",
    (*ALL, "g_metric_values"),
)
def kpi_recompute(spark, sf_dir):
    return series.recompute(P.graph(spark, sf_dir), ANCHOR)


_LAST = f"SELECT kpi_node_id, id, value FROM g_metric_values WHERE {{}} QUALIFY row_number() OVER (PARTITION BY kpi_node_id ORDER BY {_BT} DESC, observed_at DESC, id DESC) = 1"


@query("metric_asof", _LAST.format(f"{_BT} <= {ANCHOR}"), ("g_metric_values",))
def metric_asof(spark, sf_dir):
    return series.as_of(P.graph(spark, sf_dir).metric_values, ANCHOR).select("kpi_node_id", "id", "value")


#: 2023-11-15 12:00:00 UTC, and the starts of its month and year.
_PERIOD_ANCHOR, _MONTH, _YEAR = 1700049600, 1698796800, 1672531200
_PERIOD_SQL = f"""SELECT kpi_node_id, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, {_BT} - CAST(substr(id, 4) AS BIGINT) % 26 * 2592000 AS moved FROM g_metric_values)
WHERE moved BETWEEN {{}} AND {_PERIOD_ANCHOR} GROUP BY 1"""


def _period(spark, sf_dir, period):
    """Totals of values whose times are moved back by up to 25 times 30 days, by their numbers, so that they lie in several months and years."""
    values = P.graph(spark, sf_dir).metric_values
    moved = series.business_time() - F.substr("id", F.lit(4)).cast("long") % 26 * 2592000
    rows = series.in_period(values.withColumn("as_of", moved), period, _PERIOD_ANCHOR)
    return rows.groupBy("kpi_node_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("metric_mtd", _PERIOD_SQL.format(_MONTH), ("g_metric_values",))
def metric_mtd(spark, sf_dir):
    return _period(spark, sf_dir, "mtd")


@query("metric_ytd", _PERIOD_SQL.format(_YEAR), ("g_metric_values",))
def metric_ytd(spark, sf_dir):
    return _period(spark, sf_dir, "ytd")


@query("metric_conflicts", f"SELECT kpi_node_id AS kpi_id, {_BT} AS at, lower(unit) AS unit, count(*) AS n, max(value) - min(value) AS spread FROM g_metric_values GROUP BY 1, 2, 3 HAVING max(value) - min(value) > 2.220446049250313e-16", ("g_metric_values",))
def metric_conflicts(spark, sf_dir):
    return series.conflicts(P.graph(spark, sf_dir).metric_values)


@query(
    "source_versions",
    "SELECT path, sha256, first_seen_at, row_number() OVER (PARTITION BY path ORDER BY first_seen_at, sha256) AS version FROM (SELECT source AS path, sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_seen_at FROM documents GROUP BY 1, 2)",
)
def source_versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return series.source_versions(docs.select(F.col("source").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), F.col("doc_id").alias("at"))).withColumn("version", F.col("version").cast("long"))


# Scalars.
@query(
    "slugify_parts",
    r"SELECT p_partkey, trim(regexp_replace(lower(p_name || ' -- ' || p_type || ' #' || p_brand || '!'), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS slug, trim(regexp_replace(lower(p_name || '/' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS ascii_slug FROM part",
)
def slugify_parts(spark, sf_dir):
    c = F.concat("p_name", F.lit(" -- "), "p_type", F.lit(" #"), "p_brand", F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", T.slugify(c).alias("slug"), T.ascii_slug(F.concat("p_name", F.lit("/"), "p_brand")).alias("ascii_slug"))


@query("canon_keys", "SELECT o_orderkey, regexp_replace(lower(trim(o_orderpriority)), '[^a-z0-9]', '', 'g') AS key FROM orders")
def canon_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.canon_key(F.trim("o_orderpriority")).alias("key"))


@query(
    "clause_strip",
    r"""WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '1.2. ' WHEN 1 THEN '12 ' WHEN 2 THEN '3.' WHEN 3 THEN '4.5.6  ' ELSE '' END || p_name AS s FROM part),
m AS (SELECT *, regexp_extract(s, '^([0-9.]+)\s+', 1) AS lead FROM x)
SELECT p_partkey, CASE WHEN lead LIKE '%.%' AND regexp_matches(lead, '[0-9]') AND trim(substr(s, length(lead) + 1)) <> '' THEN trim(substr(s, length(lead) + 1)) ELSE trim(s) END AS stripped FROM m""",
)
def clause_strip(spark, sf_dir):
    k = F.col("p_partkey") % 5
    lead = F.when(k == 0, "1.2. ").when(k == 1, "12 ").when(k == 2, "3.").when(k == 3, "4.5.6  ").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_clause_number(F.concat(lead, "p_name")).alias("stripped"))


_CELL = {0: ("'$' || {v} || 'K'", 1e3, "USD"), 1: ("{v} || '%'", 1, "Percent"), 2: ("'-' || {v}", -1, "Count"), 3: ("'€' || {v} || 'm'", 1e6, "EUR"), 4: ("'n/a'", None, None), 5: ("'+' || {v} || 'd'", None, None), 6: ("{v}", 1, "Count")}


@query(
    "metric_cells",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 7 "
    + " ".join(f"WHEN {k} THEN {'NULL' if f is None else f'round(l_extendedprice * {f}, 2)'}" for k, (_, f, _) in _CELL.items())
    + " END AS value, CASE l_partkey % 7 "
    + " ".join(f"WHEN {k} THEN {'NULL' if u is None else repr(u)}" for k, (_, _, u) in _CELL.items())
    + " END AS unit FROM lineitem",
)
def metric_cells(spark, sf_dir):
    v = F.format_string("%.2f", F.col("l_extendedprice"))
    parts = {0: F.concat(F.lit("$"), v, F.lit("K")), 1: F.concat(v, F.lit("%")), 2: F.concat(F.lit("-"), v), 3: F.concat(F.lit("€"), v, F.lit("m")), 4: F.lit("n/a"), 5: F.concat(F.lit("+"), v, F.lit("d")), 6: v}
    text = F.lit(None).cast("string")
    for k, c in parts.items():
        text = F.when(F.col("l_partkey") % 7 == k, c).otherwise(text)
    cell = cells.metric_cell(text)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(cell["value"], 2).alias("value"), cell["unit"].alias("unit"))


# Search.
@query(
    "graph_search_terms",
    f"""--more {_TOUCH}, q AS (SELECT node, string_agg(DISTINCT quote, ' ') AS quotes FROM t JOIN g_evidence v ON v.id = t.evidence_id WHERE quote IS NOT NULL GROUP BY 1),
x AS (SELECT n.id, n.name, n.kind, string_split_regex(lower(coalesce(n.name, '') || ' ' || coalesce(CASE WHEN n.kind = 'Kpi' THEN json_extract_string(n.attrs, '$.definition') END, '') || ' ' || coalesce(q.quotes, '')), '[^\\p{{L}}\\p{{N}}]+') AS w FROM g_nodes n LEFT JOIN q ON q.node = n.id),
h AS (SELECT id, name, kind FROM x WHERE list_contains(w, 'red') AND list_contains(w, 'bolt') ORDER BY id LIMIT 20)
SELECT * FROM h WHERE kind = 'Decision'""",
    ALL,
)
def graph_search_terms(spark, sf_dir):
    g = P.graph(spark, sf_dir, only=_QUOTED)
    query_text = 'red "bolt"'
    return search.graph_search(g.nodes, search.node_postings(g, query_text), query_text, ("Decision",))


_BM25 = r"""WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM documents),
len AS (SELECT doc_id, count(*) AS length FROM w GROUP BY 1), tot AS (SELECT count(*) AS total, avg(length) AS mean FROM len),
tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN ('the', 'license') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT tf.doc_id, round(sum(greatest(ln((total - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS k FROM tf JOIN df USING (term) JOIN len USING (doc_id), tot GROUP BY 1 HAVING count(*) = 2)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc {SCOPE} QUALIFY rank <= 20"""


def _bm25(spark, sf_dir, source=None):
    docs = table(spark, sf_dir, "documents")
    scope = docs.where(F.col("source") == source).select("doc_id") if source else None
    query_text = "the license"
    index, length = search.counted_postings(docs, "doc_id", ["text"], search.terms_of(spark, query_text))
    scored = search.bm25(index, "doc_id", [("q", query_text)], scope, length)
    return search.top(scored, "doc_id", 20).select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


@query("bm25_top20", _BM25.replace("{SCOPE}", ""))
def bm25_top20(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query("bm25_scoped", _BM25.replace("{SCOPE}", "WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3')"))
def bm25_scoped(spark, sf_dir):
    return _bm25(spark, sf_dir, "src3")


# Differences.
def _changed(g: Graph) -> Graph:
    """The graph after some parts went, some confidences moved, much or little, and some names and attributes changed: a new name makes a new key, one in
    capitals has the same. As in the SQL, edges of parts that went stay with a missing end, and are in no difference."""
    k = F.when(F.col("id").startswith("product."), F.substr("id", F.lit(9)).try_cast("long"))
    moved = F.when(k % 13 == 0, F.col("confidence") + 0.1).when(k % 19 == 0, F.col("confidence") + 0.0001).otherwise(F.col("confidence"))
    name = F.when(k % 23 == 0, F.concat("name", F.lit(" new"))).when(k % 29 == 0, F.upper("name")).otherwise(F.col("name"))
    attrs = F.when(k % 31 == 0, F.lit('{"changed":1}')).otherwise(F.col("attrs"))
    nodes = g.nodes.where((k % 17 != 0) | k.isNull()).withColumns({"confidence": moved, "name": name, "attrs": attrs})
    return replace(g, nodes=nodes)


_SLUG = r"kind || ':' || trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', '_', 'g'), '_')"
_CANON = "coalesce(array_to_string(list_sort(list_transform(json_keys(attrs), lambda j: j || '=' || json_extract_string(attrs, '$.' || j))), ';'), '')"
_PAIR = f"""a0 AS (SELECT *, {_SLUG} AS key, {_CANON} AS canon FROM g_nodes),
b0 AS (SELECT *, {_SLUG} AS key, {_CANON} AS canon FROM (SELECT * REPLACE (CASE WHEN k % 13 = 0 THEN confidence + 0.1 WHEN k % 19 = 0 THEN confidence + 0.0001 ELSE confidence END AS confidence,
  CASE WHEN k % 23 = 0 THEN name || ' new' WHEN k % 29 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN k % 31 = 0 THEN '{{"changed":1}}' ELSE attrs END AS attrs)
  FROM (SELECT *, CASE WHEN id LIKE 'product.%' THEN CAST(substr(id, 9) AS BIGINT) END AS k FROM g_nodes) WHERE k IS NULL OR k % 17 <> 0)),
an AS (SELECT key, a0.id, kind, name, round(confidence * 1000)::BIGINT AS c, canon, is_tainted AS t, requires_human_review AS r FROM a0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY a0.id) = 1),
bn AS (SELECT key, b0.id, kind, name, round(confidence * 1000)::BIGINT AS c, canon, is_tainted AS t, requires_human_review AS r FROM b0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY b0.id) = 1),
dn AS (SELECT coalesce(an.key, bn.key) AS key, CASE WHEN an.key IS NULL THEN 'added' WHEN bn.key IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN an.key IS NULL OR bn.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN an.name <> bn.name THEN 'name' END, CASE WHEN an.c <> bn.c THEN 'confidence' END, CASE WHEN an.t <> bn.t THEN 'is_tainted' END, CASE WHEN an.r <> bn.r THEN 'requires_human_review' END, CASE WHEN an.canon <> bn.canon THEN 'attrs' END) END AS fields
  FROM an FULL JOIN bn ON an.key = bn.key WHERE an.key IS NULL OR bn.key IS NULL OR an.name <> bn.name OR an.c <> bn.c OR an.t <> bn.t OR an.r <> bn.r OR an.canon <> bn.canon),
ne AS (SELECT edge_id, count(*) AS n FROM g_edge_evidence GROUP BY 1),
ae AS (SELECT x.key || '->' || y.key || ':' || e.kind AS key, e.id, round(e.confidence * 1000)::BIGINT AS c, e.is_tainted AS t, e.requires_human_review AS r, created_by AS w, coalesce(n, 0) AS n FROM g_edges e JOIN a0 x ON x.id = from_id JOIN a0 y ON y.id = to_id LEFT JOIN ne ON edge_id = e.id QUALIFY row_number() OVER (PARTITION BY x.key || '->' || y.key || ':' || e.kind ORDER BY e.id) = 1),
be AS (SELECT x.key || '->' || y.key || ':' || e.kind AS key, e.id, round(e.confidence * 1000)::BIGINT AS c, e.is_tainted AS t, e.requires_human_review AS r, created_by AS w, coalesce(n, 0) AS n FROM g_edges e JOIN b0 x ON x.id = from_id JOIN b0 y ON y.id = to_id LEFT JOIN ne ON edge_id = e.id QUALIFY row_number() OVER (PARTITION BY x.key || '->' || y.key || ':' || e.kind ORDER BY e.id) = 1),
de AS (SELECT coalesce(ae.key, be.key) AS key, CASE WHEN ae.key IS NULL THEN 'added' WHEN be.key IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN ae.key IS NULL OR be.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN ae.c <> be.c THEN 'confidence' END, CASE WHEN ae.t <> be.t THEN 'is_tainted' END, CASE WHEN ae.r <> be.r THEN 'requires_human_review' END, CASE WHEN ae.w <> be.w THEN 'created_by' END, CASE WHEN ae.n <> be.n THEN 'evidence' END) END AS fields
  FROM ae FULL JOIN be ON ae.key = be.key WHERE ae.key IS NULL OR be.key IS NULL OR ae.c <> be.c OR ae.t <> be.t OR ae.r <> be.r OR ae.w <> be.w OR ae.n <> be.n)"""


@query("graph_diff_nodes", f"--more {_PAIR} SELECT key, change, fields FROM dn", ALL)
def graph_diff_nodes(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    return diff.diff_nodes(g, _changed(g))


@query("graph_diff_edges", f"--more {_PAIR} SELECT key, change, fields FROM de", ALL)
def graph_diff_edges(spark, sf_dir):
    g = P.graph(spark, sf_dir, by={"edge_evidence": "edge_id"})
    return diff.diff_edges(g, _changed(g))


@query("graph_diff_counts", f"--more {_PAIR} SELECT 'node' AS what, change, count(*) AS n FROM dn GROUP BY change UNION ALL SELECT 'edge', change, count(*) FROM de GROUP BY change", ALL)
def graph_diff_counts(spark, sf_dir):
    g = P.graph(spark, sf_dir, by={"edge_evidence": "edge_id"})
    return diff.diff_counts(g, _changed(g))
