"""Registered queries over extraction, the write path, lenses and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import categories, extract, graph, mutations, tree
from ..schema import Graph
from ..sources import parse
from ..streaming import jobs
from . import lens
from . import testgraph as P
from .queries import ALL, ANCHOR, query, table

_TOKENS = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: octet_length(encode(t)) >= 3 AND t NOT IN ('the', 'and', 'for', 'with', 'that', 'this', 'from', 'into', 'are', 'was', 'its', 'our')))"


@query(
    "near_duplicate_names",
    f"""WITH n AS (SELECT 'n' || min(p_partkey) AS id, {_TOKENS.format("p_name || ' for ' || p_type")} AS t FROM part GROUP BY p_name, p_type), k AS (SELECT 'k' || min(p_partkey) AS id, {_TOKENS.format("p_name")} AS t FROM part GROUP BY p_name)
SELECT n.id AS a, k.id AS b FROM n, k WHERE least(len(n.t), len(k.t)) >= 2 AND len(n.t) <> len(k.t) AND len(list_intersect(n.t, k.t)) = least(len(n.t), len(k.t))""",
)
def near_duplicate_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    name = lambda letter: F.concat(F.lit(letter), F.min("p_partkey").cast("string")).alias("id")
    new = part.groupBy("p_name", "p_type").agg(name("n")).select("id", F.concat("p_name", F.lit(" for "), "p_type").alias("name"))
    known = part.groupBy("p_name").agg(name("k")).select("id", F.col("p_name").alias("name"))
    return extract.near_names(new, known)


def _as_documents(spark, sf_dir):
    """Documents in the normalized schema: the first line is a heading, every other line a paragraph."""
    docs = table(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    line = lambda x, i: F.struct(F.when(i == 0, "heading").otherwise("paragraph").alias("kind"), F.when(i == 0, 1).alias("level"), x.alias("text"), F.lit(None).cast("string").alias("language"), F.lit(0).cast("long").alias("span_start"), F.lit(0).cast("long").alias("span_end"))
    from ..schema import TABLE

    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("string").alias("id"), none.alias("source_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), none.alias("title"), F.transform(lines, line).alias("blocks"), F.array().cast(f"array<{TABLE}>").alias("tables"), none.alias("error"))


_LINE = "string_split(coalesce(text, ''), chr(10))[1]"


@query("kpi_headings", f"SELECT doc_id::VARCHAR AS doc_id, {_LINE} AS text FROM documents WHERE " + " OR ".join(f"contains(lower({_LINE}), '{t}')" for t in extract.KPI_TERMS))
def kpi_headings(spark, sf_dir):
    return extract.headings(_as_documents(spark, sf_dir)).select("doc_id", "text")


_VOCABULARY = ("license", "password", "token", "mail", "the", "und", "que")
_VERBS = lambda verbs: "(" + " OR ".join(f"contains(lower(p), '{v}')" for v in verbs) + ")"


@query(
    "comention_pairs",
    f"""WITH l AS (SELECT doc_id, k, p FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS k, unnest(x) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)) WHERE k > 1),
v AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{w}')" for k, w in enumerate(_VOCABULARY))}) t(n, w))
SELECT a.w AS a, b.w AS b, CASE WHEN {_VERBS(extract.INFLUENCE_VERBS)} THEN 'Influences' WHEN {_VERBS(extract.BLOCK_VERBS)} THEN 'Blocks' END AS kind, count(*) AS n FROM l JOIN v a ON contains(lower(p), a.w) JOIN v b ON contains(lower(p), b.w) AND a.n < b.n GROUP BY 1, 2, 3""",
)
def comention_pairs(spark, sf_dir):
    docs = _as_documents(spark, sf_dir)
    rows = docs.select(F.explode("blocks").alias("b")).where("b.kind = 'paragraph'").select(F.col("b.text").alias("p"))
    said = F.filter(F.array(*[F.lit(w) for w in _VOCABULARY]), lambda w: F.lower("p").contains(w))
    rows = rows.select(extract.relation_kind(F.col("p")).alias("kind"), F.explode(extract.pairs_in_order(said)).alias("x"))
    return rows.groupBy("x.a", "x.b", "kind").agg(F.count("*").alias("n"))


@query("structure_signature", f"SELECT doc_id::VARCHAR AS id, sha256('1:' || lower(trim({_LINE})) || chr(10) || '--' || chr(10)) AS structural_sha256 FROM documents")
def structure_signature(spark, sf_dir):
    return extract.structure(_as_documents(spark, sf_dir))


@query("change_class", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN lang = 'de' OR lang IS NULL THEN 'full' WHEN lang = 'en' OR (lang = 'fr' AND lower(text) = text) THEN 'unchanged' WHEN lang = 'fr' THEN 'cosmetic' ELSE 'full' END AS change FROM documents WHERE text IS NOT NULL) GROUP BY change")
def change_class(spark, sf_dir):
    """Documents against a cache that has English ones as they are, French ones in lower case, Spanish ones with other content, and no German ones."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    sha = lambda c: F.sha2(c, 256)
    path, low = F.col("doc_id").cast("string").alias("path"), F.lower("text")
    fresh = docs.select(path, sha(F.col("text")).alias("sha256"), sha(low).alias("structural_sha256"))
    old = docs.where("lang <> 'de'").select(path, F.when(F.col("lang") == "en", sha(F.col("text"))).when(F.col("lang") == "fr", sha(low)).otherwise(sha(F.concat("text", F.lit("?")))).alias("sha256"), F.when(F.col("lang").isin("en", "fr"), sha(low)).otherwise(sha(F.concat("text", F.lit("!")))).alias("structural_sha256"))
    return extract.change_class(fresh, old).groupBy("change").agg(F.count("*").alias("n"))


@query("page_sections")
def page_sections(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return tree.sections(parse.parse_files(pages))


@query("category_fallback", "--more d AS (SELECT node, count(*) AS d FROM (SELECT from_id AS node FROM g_edges UNION ALL SELECT to_id FROM g_edges) GROUP BY 1), x AS (SELECT kind, id, coalesce(d, 0) AS d FROM g_nodes LEFT JOIN d ON node = id WHERE kind <> 'Document'), h AS (SELECT kind, id FROM x QUALIFY row_number() OVER (PARTITION BY kind ORDER BY d DESC, id DESC) = 1) SELECT x.kind AS label, count(*) AS n, h.id AS headline_id, row_number() OVER (ORDER BY count(*) DESC, x.kind) AS rank FROM x JOIN h ON h.kind = x.kind GROUP BY x.kind, h.id QUALIFY rank <= 10", ALL[:2])
def category_fallback(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    return categories.by_kind(g.nodes, g.edges).withColumn("rank", F.col("rank").cast("long"))


@query(
    "kpi_lookup",
    """--more a AS (SELECT DISTINCT t AS asked FROM (SELECT id AS t FROM g_nodes WHERE kind = 'Kpi' UNION SELECT upper(id) FROM g_nodes WHERE kind = 'Kpi' UNION SELECT substr(id, 5) FROM g_nodes WHERE kind = 'Kpi' UNION SELECT upper(name) FROM g_nodes WHERE kind = 'Kpi' UNION SELECT name FROM g_nodes WHERE kind = 'Risk')),
k AS (SELECT id, name FROM g_nodes WHERE kind = 'Kpi'), r AS (SELECT asked, id, CASE WHEN id = asked THEN 1 WHEN id = 'kpi.' || regexp_replace(lower(trim(asked)), '[^a-z0-9]', '_', 'g') THEN 2 ELSE 3 END AS p FROM a JOIN k ON id = asked OR id = 'kpi.' || regexp_replace(lower(trim(asked)), '[^a-z0-9]', '_', 'g') OR lower(id) = lower(asked) OR lower(name) = lower(asked))
SELECT asked, id AS kpi_id FROM r QUALIFY row_number() OVER (PARTITION BY asked ORDER BY p, id) = 1""",
    ALL[:1],
)
def kpi_lookup(spark, sf_dir):
    nodes = P.frame(spark, sf_dir, "g_nodes")
    kpis = nodes.where("kind = 'Kpi'")
    asked = kpis.select(F.col("id").alias("asked")).union(kpis.select(F.upper("id"))).union(kpis.select(F.expr("substr(id, 5)"))).union(kpis.select(F.upper("name"))).union(nodes.where("kind = 'Risk'").select("name")).distinct()
    return graph.lookup_kpi(nodes, asked)


@query(
    "generation_export",
    """--more v AS (SELECT * FROM g_evidence WHERE quote LIKE '% red bolt'), j AS (SELECT * FROM g_edge_evidence WHERE evidence_id IN (SELECT id FROM v)), e AS (SELECT * FROM g_edges WHERE id IN (SELECT edge_id FROM j)),
i AS (SELECT from_id AS id FROM e UNION SELECT to_id FROM e UNION SELECT source_node_id FROM v)
SELECT 'nodes' AS what, count(*) AS n FROM g_nodes WHERE id IN (SELECT id FROM i) UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'evidence', count(*) FROM v UNION ALL SELECT 'edge_evidence', count(*) FROM j""",
    ALL,
)
def generation_export(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    evidence = g.evidence.withColumn("blob_sha256", F.sha2("quote", 256))
    contents = g.evidence.where(F.col("quote").endswith(" red bolt")).select(F.sha2("quote", 256).alias("sha256")).distinct()
    out = mutations.generation_closure(Graph(**{**g.frames(), "evidence": evidence}), contents)
    parts = [getattr(out, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("what"), "n") for n in ("nodes", "edges", "evidence", "edge_evidence")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    "remove_document_effect",
    """--more d AS (SELECT DISTINCT node_id AS id FROM g_document_cache WHERE path LIKE 'src0/%'), m AS (SELECT DISTINCT from_id AS doc, to_id AS concept FROM g_edges WHERE kind = 'MentionedIn'),
x AS (SELECT id FROM d UNION SELECT concept FROM m WHERE doc IN (SELECT id FROM d) AND concept NOT IN (SELECT concept FROM m WHERE doc NOT IN (SELECT id FROM d))),
v AS (SELECT id FROM g_evidence WHERE source_node_id NOT IN (SELECT id FROM x)), e0 AS (SELECT id FROM g_edges WHERE from_id NOT IN (SELECT id FROM x) AND to_id NOT IN (SELECT id FROM x)),
j AS (SELECT DISTINCT edge_id FROM g_edge_evidence WHERE evidence_id IN (SELECT id FROM v) AND edge_id IN (SELECT id FROM e0))
SELECT 'removed' AS what, count(*) AS n FROM x UNION ALL SELECT 'edges_left', count(*) FROM j UNION ALL SELECT 'evidence_left', count(*) FROM v""",
    (*ALL, "g_document_cache"),
)
def remove_document_effect(spark, sf_dir):
    g = P.graph(spark, sf_dir)
    docs = g.document_cache.where(F.col("path").startswith("src0/")).select(F.col("node_id").alias("id")).distinct()
    ids = graph.shared(mutations.removal_ids(g, docs))
    left = mutations.remove_nodes(g, ids)
    count = lambda name, rows: rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count("removed", ids).unionByName(count("edges_left", left.edges)).unionByName(count("evidence_left", left.evidence))


@query(
    "upsert_state",
    """WITH l AS (SELECT 'customer.' || o_custkey AS id, o_orderkey AS seq, o_orderstatus = 'P' AND o_totalprice < 50000 AS gone, o_orderpriority AS name FROM orders),
x AS (SELECT *, max(CASE WHEN gone THEN seq END) OVER (PARTITION BY id) AS last FROM l), y AS (SELECT * FROM x WHERE NOT gone AND (last IS NULL OR seq > last))
SELECT id, arg_max(name, seq) AS name, min(seq) AS created_at, max(seq) AS updated_at FROM y GROUP BY id""",
)
def upsert_state(spark, sf_dir):
    """Nodes by a log in which each order writes its customer's node, or deletes it."""
    orders = table(spark, sf_dir, "orders")
    gone = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") < 50000)
    key = F.concat(F.lit("customer."), F.col("o_custkey").cast("string"))
    no = F.lit(False)
    payload = F.to_json(F.struct(key.alias("id"), F.lit("Customer").alias("kind"), F.col("o_orderpriority").alias("name"), F.lit(0.9).alias("confidence"), no.alias("is_tainted"), no.alias("requires_human_review"), F.col("o_orderkey").alias("created_at"), F.col("o_orderkey").alias("updated_at")))
    log = orders.select(F.lit(1).cast("long").alias("batch"), F.col("o_orderkey").alias("seq"), F.when(gone, "delete_node").otherwise("upsert_node").alias("op"), key.alias("id"), F.when(~gone, payload).alias("payload"))
    return mutations.state(log).nodes.select("id", "name", "created_at", "updated_at")


LENSES = {
    "summary": {"id": "default", "name": "Check", "lenses": ["customers", "machinery", "parts", "brand", "clicks", "joint", "vague"]},
    "lenses": [
        {"id": "customers", "label": "Customers", "selector": {"type": "kind", "kind": "customer"}, "measure": {"type": "sum", "field": "balance", "unit": "USD"}, "health": {"type": "threshold", "red_gte": 1000}, "children": ["abroad"]},
        {"id": "abroad", "label": "France", "selector": {"type": "facet", "facet": "function", "equals": "france"}, "measure": {"type": "count"}, "health": {"type": "presence", "unknown_when": "missing_or_low_confidence"}},
        {"id": "machinery", "label": "Machinery", "selector": {"type": "composite", "and": [{"type": "kind", "kind": "Customer"}], "or": [{"type": "attribute", "field": "segment", "equals": "machinery"}, {"type": "attribute", "field": "segment", "equals": "FURNITURE"}]}, "measure": {"type": "count"}, "health": {"type": "presence"}},
        {"id": "parts", "label": "Parts by then", "selector": {"type": "kind", "kind": "Product"}, "measure": {"type": "sum", "field": "size", "as_of": "2024-01-20"}, "health": {"type": "threshold", "green_lt": 10, "watch_lt": 1e12}},
        {"id": "brand", "label": "Brand 1", "selector": {"type": "saved_query", "query": "all_concepts"}, "measure": {"type": "ref_kpi", "kpi": "brand_1"}, "health": {"type": "confidence"}},
        {"id": "clicks", "label": "Clicks", "selector": {"type": "kind", "kind": "Kpi"}, "measure": {"type": "ref_kpi", "kpi": "Click rate", "as_of": "2024-01-15"}, "health": {"type": "freshness", "max_age_days": 30}},
        {"id": "joint", "label": "Joint", "selector": {"type": "kind", "kind": "Kpi"}, "measure": {"type": "derived", "kpi": "kpi.view", "inputs": ["kpi.click", "kpi.nothing"]}, "health": {"type": "presence"}},
        {"id": "vague", "label": "Vague", "selector": {"type": "kind", "kind": "Risk"}, "measure": {"type": "median"}},
    ],
}


@query(
    "lens_resolution",
    f"""--more c AS (SELECT id, CAST(json_extract_string(attrs, '$.balance') AS DOUBLE) AS b, lower(json_extract_string(attrs, '$.segment')) AS s FROM g_nodes WHERE kind = 'Customer'),
f AS (SELECT DISTINCT c.id FROM c JOIN g_edges e ON e.kind = 'InFunction' AND (e.from_id = c.id OR e.to_id = c.id) JOIN g_nodes n ON n.kind = 'Function' AND n.id IN (e.from_id, e.to_id) AND lower(n.name) = 'france'),
p AS (SELECT CAST(json_extract_string(attrs, '$.size') AS DOUBLE) AS s FROM g_nodes WHERE kind = 'Product' AND CAST(json_extract_string(attrs, '$.as_of') AS BIGINT) <= 1705795199),
k AS (SELECT value, unit, coalesce(as_of, observed_at) AS seen FROM g_metric_values WHERE kpi_node_id = 'kpi.click' AND coalesce(as_of, observed_at) <= 1705363199 ORDER BY coalesce(as_of, observed_at) DESC, observed_at DESC, id DESC LIMIT 1)
SELECT 'customers' AS lens_id, 'resolved' AS state, sum(b) AS value, 'USD' AS unit, NULL::BIGINT AS observed_at, CASE WHEN sum(b) >= 1000 THEN 'at_risk' ELSE 'unknown' END AS health FROM c
UNION ALL SELECT 'abroad', 'resolved', count(*)::DOUBLE, 'count', NULL, 'unknown' FROM f
UNION ALL SELECT 'machinery', 'resolved', count(*)::DOUBLE, 'count', NULL, 'good' FROM c WHERE s IN ('machinery', 'furniture')
UNION ALL SELECT 'parts', 'resolved', sum(s), 'Count', NULL, CASE WHEN sum(s) < 10 THEN 'good' ELSE 'watch' END FROM p
UNION ALL SELECT 'brand', 'resolved', CAST(json_extract_string(attrs, '$.value') AS DOUBLE), 'Count', NULL, 'good' FROM g_nodes WHERE id = 'kpi.brand_1'
UNION ALL SELECT 'clicks', 'resolved', value, unit, seen, CASE WHEN floor(({ANCHOR} - seen) / 86400) <= 30 THEN 'good' ELSE 'unknown' END FROM k
UNION ALL SELECT 'joint', 'unknown', NULL, (SELECT unit FROM g_metric_values WHERE kpi_node_id = 'kpi.view' ORDER BY coalesce(as_of, observed_at) DESC, observed_at DESC, id DESC LIMIT 1), (SELECT max(coalesce(as_of, observed_at)) FROM g_metric_values WHERE kpi_node_id = 'kpi.view'), 'unknown'
UNION ALL SELECT 'vague', 'unknown', NULL, NULL, NULL, 'unknown'""",
    ("g_nodes", "g_edges", "g_metric_values"),
)
def lens_resolution(spark, sf_dir):
    return lens.resolve(P.graph(spark, sf_dir, ("nodes", "edges"), by={"edge_evidence": "edge_id"}), LENSES, ANCHOR).select("lens_id", "state", "value", "unit", "observed_at", "health")


#: Lenses over evidence of mentions, of facets and of values.
SOURCED = {
    "summary": {"id": "sourced", "name": "Sourced", "lenses": ["kpis", "all", "nation", "either", "sized", "views", "joint"]},
    "lenses": [
        {"id": "kpis", "label": "KPIs", "selector": {"type": "kind", "kind": "Kpi"}, "measure": {"type": "count"}, "health": {"type": "freshness", "max_age_days": 30}},
        {"id": "all", "label": "All", "selector": {"type": "saved_query", "query": "all_concepts"}, "measure": {"type": "sum", "field": "size"}, "health": {"type": "presence", "unknown_when": ["stale", "missing_evidence"]}},
        {"id": "nation", "label": "Nation", "selector": {"type": "facet", "facet": "function", "equals": "Nation_11"}, "measure": {"type": "count"}, "health": {"type": "staleness", "max_age_days": 30}},
        {"id": "either", "label": "Either", "selector": {"type": "composite", "or": [{"type": "kind", "kind": "Kpi"}, {"type": "facet", "facet": "function", "equals": "nation_11"}]}, "measure": {"type": "count"}, "health": {"type": "freshness", "max_age_days": 30}},
        {"id": "sized", "label": "Sized", "selector": {"type": "kind", "kind": "Product"}, "measure": {"type": "sum", "field": "size"}, "health": {"type": "freshness"}},
        {"id": "views", "label": "Views", "selector": {"type": "kind", "kind": "Kpi"}, "measure": {"type": "ref_kpi", "kpi": "kpi.view"}, "health": {"type": "presence", "unknown_when": "stale"}},
        {"id": "joint", "label": "Joint", "selector": {"type": "kind", "kind": "Kpi"}, "measure": {"type": "derived", "kpi": "kpi.view", "inputs": ["kpi.click", "kpi.error"]}, "health": {"type": "freshness"}},
    ],
}
_SOURCED_SQL = """--more f AS (SELECT DISTINCT n.id FROM g_edges e JOIN g_nodes k ON k.kind = 'Function' AND lower(k.name) = 'nation_11' AND k.id IN (e.from_id, e.to_id)
  JOIN g_nodes n ON n.id = CASE WHEN e.from_id = k.id THEN e.to_id ELSE e.from_id END WHERE e.kind = 'InFunction'),
members AS (SELECT 'kpis' AS lens_id, id FROM g_nodes WHERE kind = 'Kpi' UNION ALL SELECT 'all', id FROM g_nodes WHERE kind <> 'Document' UNION ALL SELECT 'nation', id FROM f
  UNION ALL SELECT 'either', id FROM (SELECT id FROM f UNION SELECT id FROM g_nodes WHERE kind = 'Kpi') UNION ALL SELECT 'sized', id FROM g_nodes WHERE kind = 'Product'),
ends AS (SELECT id AS edge_id, kind, from_id AS node FROM g_edges UNION ALL SELECT id, kind, to_id FROM g_edges),
touched AS (SELECT lens_id, evidence_id, CASE WHEN kind = 'MentionedIn' THEN 'mention' ELSE 'facet' END AS step, min(edge_id) AS edge_id FROM members JOIN ends ON id = node JOIN g_lineage USING (edge_id)
  WHERE kind = 'MentionedIn' OR (kind IN ('InFunction', 'ForProduct') AND lens_id IN ('nation', 'either')) GROUP BY 1, 2, 3),
mentioned AS (SELECT * FROM touched WHERE step = 'mention' QUALIFY row_number() OVER (PARTITION BY lens_id ORDER BY edge_id, evidence_id) <= CASE WHEN lens_id IN ('all', 'sized') THEN 32 ELSE 24 END),
newest AS (SELECT kpi_node_id, evidence_id, coalesce(as_of, observed_at) AS seen FROM g_metric_values QUALIFY row_number() OVER (PARTITION BY kpi_node_id ORDER BY coalesce(as_of, observed_at) DESC, observed_at DESC, id DESC) = 1),
lines AS (SELECT lens_id, step, edge_id, evidence_id FROM mentioned
  UNION ALL SELECT lens_id, step, edge_id, evidence_id FROM touched t WHERE step = 'facet' AND NOT EXISTS (SELECT 1 FROM mentioned m WHERE m.lens_id = t.lens_id AND m.evidence_id = t.evidence_id)
  UNION ALL SELECT 'views', 'value', NULL, evidence_id FROM newest WHERE kpi_node_id = 'kpi.view' UNION ALL SELECT 'joint', 'value', NULL, evidence_id FROM newest WHERE kpi_node_id IN ('kpi.view', 'kpi.click', 'kpi.error')),
sources AS (SELECT DISTINCT evidence_id, source_node_id, ts FROM g_lineage),
"""


def _sourced(spark, sf_dir) -> Graph:
    g = P.graph(spark, sf_dir, ("nodes", "edges"))
    lines = graph.shared(P.frame(spark, sf_dir, "g_lineage"))
    none, no = F.lit(None).cast("string"), F.lit(False)
    known = lines.select(F.col("evidence_id").alias("id"), "source_node_id", F.lit("Document").alias("source_type"), none.alias("quote"), none.alias("row_ref"), none.alias("blob_sha256"), "ts", F.lit("Rule").alias("extractor"), F.lit(0.75).alias("confidence"), no.alias("is_tainted"), no.alias("requires_human_review")).distinct()
    return Graph(**{**g.frames(), "evidence": known, "edge_evidence": lines.where("edge_id IS NOT NULL").select("edge_id", "evidence_id")})


@query(
    "lens_evidence",
    _SOURCED_SQL + """named AS (SELECT * FROM lines JOIN sources USING (evidence_id) LEFT JOIN g_nodes n ON n.id = source_node_id)
SELECT lens_id, step, edge_id, evidence_id, source_node_id, coalesce(name, source_node_id) AS source_node_name, ts FROM named""",
    ("g_nodes", "g_edges", "g_metric_values", "g_lineage"),
)
def lens_evidence(spark, sf_dir):
    """The evidence behind lenses: of mentions up to their limits, of facets and values all."""
    return lens.evidence(_sourced(spark, sf_dir), SOURCED, ANCHOR).select("lens_id", "step", "edge_id", "evidence_id", "source_node_id", "source_node_name", "ts")


@query(
    "lens_freshness",
    _SOURCED_SQL + f"""ages AS (SELECT lens_id, count(*) AS n_evidence, max(ts) AS lineage_at FROM lines JOIN sources USING (evidence_id) GROUP BY lens_id),
clash AS (SELECT count(*) > 0 AS c FROM (SELECT 1 FROM g_metric_values WHERE kpi_node_id = 'kpi.view' GROUP BY coalesce(as_of, observed_at), lower(unit) HAVING max(value) - min(value) > 2.220446049250313e-16)),
x AS (SELECT l.lens_id, coalesce(n_evidence, 0) AS n_evidence, lineage_at, CASE WHEN l.lens_id IN ('views', 'joint') THEN (SELECT seen FROM newest WHERE kpi_node_id = 'kpi.view') END AS observed_at FROM (VALUES ('kpis'), ('all'), ('nation'), ('either'), ('sized'), ('views'), ('joint')) l(lens_id) LEFT JOIN ages USING (lens_id)),
kept AS (SELECT lens_id, string_agg(id, ',' ORDER BY id) AS supporting FROM (SELECT * FROM members QUALIFY row_number() OVER (PARTITION BY lens_id ORDER BY id) <= 20) GROUP BY lens_id UNION ALL SELECT 'views', 'kpi.view' UNION ALL SELECT 'joint', 'kpi.view,kpi.click,kpi.error')
SELECT lens_id, n_evidence, lineage_at, observed_at, CASE WHEN observed_at IS NOT NULL THEN 0.75 END AS confidence, CASE WHEN observed_at IS NOT NULL AND (SELECT c FROM clash) THEN 'conflicting_observations' WHEN n_evidence = 0 THEN 'aggregate_not_evidence_backed' ELSE '' END AS gaps,
coalesce(supporting, '') AS supporting, CASE WHEN floor(({ANCHOR} - coalesce(observed_at, lineage_at)) / 86400) <= 30 THEN 'good' ELSE 'unknown' END AS health FROM x LEFT JOIN kept USING (lens_id)""",
    ("g_nodes", "g_edges", "g_metric_values", "g_lineage"),
)
def lens_freshness(spark, sf_dir):
    """Verdicts by age: of an observation, else of the newest evidence behind a lens."""
    rows = lens.resolve(_sourced(spark, sf_dir), SOURCED, ANCHOR)
    return rows.select("lens_id", "n_evidence", "lineage_at", "observed_at", "confidence", F.array_join("gaps", ",").alias("gaps"), F.array_join("supporting", ",").alias("supporting"), "health")


@query("event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    return jobs.event_windows(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "event_sessions",
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, s""",
)
def event_sessions(spark, sf_dir):
    rows = jobs.event_sessions(table(spark, sf_dir, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})
