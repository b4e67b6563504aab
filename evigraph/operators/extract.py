"""Facts from normalized documents: KPIs, metrics, relations, policy and claim rows, bridges, change classes.

Every extractor gives frames in the schemas of the graph; ids are hashes of where a fact stands, so that a job run again gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.cells import metric_cell
from ..schema import CONFIDENCE

#: What makes a heading a KPI; verbs of influence and of blocking. All are looked for within words too.
KPI_TERMS = (
    "revenue", "arr", "mrr", "churn", "cac", "ltv", "nps", "clv", "aov", "gross margin", "net revenue", "conversion rate", "retention", "burn rate", "runway", "daily active", "monthly active",
    "average order", "customer acquisition", "customer lifetime", "operating margin", "ebitda", "net promoter",
)
INFLUENCE_VERBS = ("drive", "impact", "affect", "influence", "improve", "increase")
BLOCK_VERBS = ("block", "limit", "reduce")
KPI_ATTRS = '{"definition":null,"unit":"Count","period":"Month","status":"Unknown","trend":"Unknown"}'
#: Parts of header names by column of a policy or claim table.
HEADERS = {
    "claim": ("claim",), "policy": ("policy",), "premium": ("premium",), "incurred": ("incurred",), "paid": ("paid",), "reserve": ("reserve", "outstanding"), "customer": ("customer", "client", "insured", "policyholder"),
    "product": ("product", "lob", "lineofbusiness"), "status": ("status",), "as_of": ("asof", "reportdate", "valuationdate", "snapshotdate"),
}
#: Names that a bridge is looked for among: the most recently updated concepts.
BRIDGE_WINDOW = 200


def contains_any(c: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def is_kpi_heading(c: Column) -> Column:
    return contains_any(F.lower(c), KPI_TERMS)


def made_id(*parts) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, sha256, n, level, text, kpi_id of KPI headings, in order of n."""
    rows = docs.select(F.col("id").alias("doc_id"), "sha256", F.posexplode("blocks").alias("n", "b")).where("b.kind = 'heading'")
    return rows.where(is_kpi_heading(F.col("b.text"))).select("doc_id", "sha256", "n", "b.level", "b.text", F.concat(F.lit("kpi."), T.slugify(F.col("b.text"))).alias("kpi_id"))


def _evidence(rows: DataFrame, id_: Column, quote: Column, row_ref: Column, source_type: str, now: int, extractor: str = "Rule", confidence: float = CONFIDENCE["Rule"]) -> DataFrame:
    no = F.lit(False)
    return rows.select(id_.alias("id"), F.col("doc_id").alias("source_node_id"), F.lit(source_type).alias("source_type"), quote.alias("quote"), row_ref.alias("row_ref"), F.col("sha256").alias("blob_sha256"), F.lit(now).cast("long").alias("ts"), F.lit(extractor).alias("extractor"), F.lit(confidence).alias("confidence"), no.alias("is_tainted"), no.alias("requires_human_review"))


def _node(rows: DataFrame, id_: Column, kind, name: Column, attrs: Column, now: int, review: bool = True, confidence: float = CONFIDENCE["Rule"], tainted: bool = False) -> DataFrame:
    at = F.lit(now).cast("long")
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return rows.select(id_.alias("id"), kind.alias("kind"), name.alias("name"), attrs.alias("attrs"), F.lit(confidence).alias("confidence"), F.lit(tainted).alias("is_tainted"), F.lit(review).alias("requires_human_review"), at.alias("created_at"), at.alias("updated_at"))


def _edge(rows: DataFrame, source: Column, target: Column, kind, evidence: Column, now: int, confidence: float = CONFIDENCE["Rule"], review: bool = False, tainted: bool = False, created_by: str = "Rule") -> tuple[DataFrame, DataFrame]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    out = rows.select(source.alias("from_id"), target.alias("to_id"), kind.alias("kind"), evidence.alias("evidence_id"))
    out = out.withColumn("id", made_id(F.lit("edge"), "from_id", "to_id", "kind", "evidence_id"))
    edges = out.select("id", "from_id", "to_id", "kind", F.lit(confidence).alias("confidence"), F.lit(created_by).alias("created_by"), F.lit(tainted).alias("is_tainted"), F.lit(review).alias("requires_human_review"), F.lit(now).cast("long").alias("created_at"))
    return edges, out.select(F.col("id").alias("edge_id"), "evidence_id")


Facts = dict[str, DataFrame]


def merge_facts(parts: list[Facts]) -> Facts:
    """Facts of several extractors; of nodes with one id, one stays."""
    out: Facts = {}
    for part in parts:
        for name, frame in part.items():
            out[name] = out[name].unionByName(frame) if name in out else frame
    for name, frame in out.items():
        out[name] = frame.dropDuplicates(["edge_id", "evidence_id"] if name == "edge_evidence" else ["id"])
    return out


def document_nodes(docs: DataFrame, now: int) -> DataFrame:
    name = F.coalesce("title", F.element_at(F.split("source_path", "/"), -1), "id")
    return _node(docs, F.col("id"), "Document", name, F.to_json(F.struct(F.col("source_path").alias("path"), "sha256")), now, review=False)


def kpis(docs: DataFrame, now: int) -> Facts:
    """KPI nodes from headings, each with evidence and an edge from the document."""
    rows = headings(docs)
    ev = made_id(F.lit("kpi"), "doc_id", F.col("n").cast("string"))
    edges, pairs = _edge(rows, F.col("doc_id"), F.col("kpi_id"), "MentionedIn", ev, now)
    return {"nodes": _node(rows, F.col("kpi_id"), "Kpi", F.col("text"), F.lit(KPI_ATTRS), now), "evidence": _evidence(rows, ev, F.col("text"), F.concat(F.lit("h"), F.col("level").cast("string")), "Document", now), "edges": edges, "edge_evidence": pairs}


def table_rows(docs: DataFrame) -> DataFrame:
    """doc_id, sha256, t, r, headers, row of all tables."""
    rows = docs.select(F.col("id").alias("doc_id"), "sha256", F.posexplode("tables").alias("t", "x")).select("doc_id", "sha256", "t", "x.headers", F.posexplode("x.rows").alias("r", "row"))
    return rows


def metrics(docs: DataFrame, now: int) -> Facts:
    """Metric nodes from table rows with a label and, right of it, a cell that is a number; and values of KPIs that a heading of the same document names
    like the label."""
    rows = table_rows(docs).withColumn("label", F.trim(F.get("row", F.lit(0)))).where("label <> ''")
    cells = F.filter(F.transform(F.slice("row", 2, F.greatest(F.size("row") - 1, F.lit(0))), metric_cell), lambda x: x.isNotNull())
    rows = rows.withColumn("cell", F.get(cells, F.lit(0))).where("cell IS NOT NULL")
    place = F.concat(F.lit("table:"), F.col("t").cast("string"), F.lit(" row:"), F.col("r").cast("string"))
    ev = made_id(F.lit("metric"), "doc_id", F.col("t").cast("string"), F.col("r").cast("string"))
    slug = T.slugify(F.col("label"))
    node = F.concat(F.lit("metric."), slug, F.lit(".t"), F.col("t").cast("string"), F.lit("r"), F.col("r").cast("string"))
    quote = F.concat("label", F.lit(": "), F.array_join(F.slice("row", 2, F.greatest(F.size("row") - 1, F.lit(0))), " | "))
    edges, pairs = _edge(rows, F.col("doc_id"), node, "MentionedIn", ev, now)
    attrs = F.to_json(F.struct(F.col("cell.value").alias("value"), F.col("cell.unit").alias("unit")))
    named = rows.withColumn("kpi_id", F.concat(F.lit("kpi."), slug)).join(headings(docs).select("doc_id", "kpi_id").distinct(), ["doc_id", "kpi_id"], "left_semi")
    none = F.lit(None).cast("long")
    values = named.select(made_id(F.lit("value"), "doc_id", F.col("t").cast("string"), F.col("r").cast("string")).alias("id"), F.col("kpi_id").alias("kpi_node_id"), node.alias("metric_node_id"), F.col("cell.value").alias("value"), F.col("cell.unit").alias("unit"), none.alias("period_start"), none.alias("period_end"), none.alias("as_of"), F.lit(now).cast("long").alias("observed_at"), ev.alias("evidence_id"))
    return {"nodes": _node(rows, node, "Metric", F.col("label"), attrs, now), "evidence": _evidence(rows, ev, quote, place, "Table", now), "edges": edges, "edge_evidence": pairs, "metric_values": values}


def relation_kind(paragraph: Column) -> Column:
    """Influences, else Blocks, by the verbs of a paragraph; null without one."""
    low = F.lower(paragraph)
    return F.when(contains_any(low, INFLUENCE_VERBS), "Influences").when(contains_any(low, BLOCK_VERBS), "Blocks")


def pairs_in_order(items: Column) -> Column:
    """All (a, b) of an array with a before b."""
    return F.flatten(F.transform(items, lambda a, i: F.transform(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def relations(docs: DataFrame, now: int) -> Facts:
    """Edges between KPIs that a paragraph of their document names, in the order of the headings, by the verb in it; up for review."""
    names = headings(docs).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "kpi_id"))).alias("kpis")).where(F.size("kpis") >= 2)
    text = docs.select(F.col("id").alias("doc_id"), F.posexplode("blocks").alias("p", "b")).where("b.kind = 'paragraph'").select("doc_id", "p", F.lower("b.text").alias("low")).withColumn("kind", relation_kind(F.col("low"))).where("kind IS NOT NULL")
    said = F.filter("kpis", lambda k: F.col("low").contains(F.replace(F.substr(k["kpi_id"], F.lit(5)), F.lit("_"), F.lit(" "))))
    rows = text.join(names, "doc_id").select("doc_id", "p", "kind", F.explode(pairs_in_order(said)).alias("x"))
    rows = rows.select("doc_id", "p", "kind", F.col("x.a.kpi_id").alias("a"), F.col("x.b.kpi_id").alias("b"), made_id(F.lit("kpi"), "doc_id", F.col("x.a.n").cast("string")).alias("ev"))
    edges, pairs = _edge(rows, F.col("a"), F.col("b"), F.col("kind"), F.col("ev"), now, confidence=CONFIDENCE["cooccurrence"], review=True)
    return {"edges": edges, "edge_evidence": pairs}


def policy_tables(docs: DataFrame, now: int) -> Facts:
    """Process nodes from the rows of policy and claim tables, with edges to the products and customers that they name."""
    rows = table_rows(docs)
    norm = F.transform("headers", lambda h: T.canon_key(h))
    rows = rows.withColumn("norm", norm)
    for name, parts in HEADERS.items():
        rows = rows.withColumn(f"at_{name}", F.array_position(_flags(parts), True) - 1)
    has = lambda n: F.col(f"at_{n}") >= 0
    claim = has("claim") & (has("incurred") | has("paid") | has("reserve"))
    policy = has("policy") & (has("premium") | has("customer") | has("product"))
    rows = rows.withColumn("what", F.when(claim, "claim").when(policy, "policy")).where("what IS NOT NULL")
    cell = lambda n: F.when(has(n), F.nullif(F.trim(F.get("row", F.col(f"at_{n}").cast("int"))), F.lit("")))
    external = F.when(F.col("what") == "claim", cell("claim")).otherwise(cell("policy"))
    rows = rows.withColumn("external", external)
    place = F.concat(F.lit("t"), F.col("t").cast("string"), F.lit("r"), F.col("r").cast("string"))
    node = F.concat(F.lit("process."), "what", F.lit("_row."), T.ascii_slug(F.col("doc_id")), F.lit("."), F.coalesce(T.ascii_slug(F.col("external")), place))
    title = F.when(F.col("what") == "claim", "Claim ").otherwise("Policy ")
    name = F.concat(title, F.coalesce("external", F.concat(F.lit("Row "), (F.col("r") + 1).cast("string"))))
    money = {n: metric_cell(cell(n)).alias(n) for n in ("premium", "incurred", "paid", "reserve")}
    attrs = F.to_json(F.struct(F.concat("what", F.lit("_row")).alias("object_type"), F.col("external").alias("external_id"), cell("status").alias("status"), cell("as_of").alias("as_of"), cell("policy").alias("policy_ref"), *money.values()))
    ev = made_id(F.lit("row"), "doc_id", F.col("t").cast("string"), F.col("r").cast("string"))
    rows = rows.withColumn("node", node).withColumn("label", name).withColumn("attrs", attrs).withColumn("ev", ev).withColumn("product", cell("product")).withColumn("customer", cell("customer"))
    ref = F.concat(F.lit("table:"), F.col("t").cast("string"), F.lit(" row:"), F.col("r").cast("string"))
    parts: list[Facts] = []
    edges, pairs = _edge(rows, F.col("doc_id"), F.col("node"), "MentionedIn", F.col("ev"), now)
    parts.append({"nodes": _node(rows, F.col("node"), "Process", F.col("label"), F.col("attrs"), now), "evidence": _evidence(rows, F.col("ev"), F.array_join("row", " | "), ref, "Table", now), "edges": edges, "edge_evidence": pairs})
    for column, kind, edge_kind in (("product", "Product", "ForProduct"), ("customer", "Customer", "OwnedBy")):
        some = rows.where(F.col(column).isNotNull()).withColumn("other", F.concat(F.lit(f"{column}."), T.ascii_slug(F.col(column))))
        edges, pairs = _edge(some, F.col("node"), F.col("other"), edge_kind, F.col("ev"), now)
        parts.append({"nodes": _node(some, F.col("other"), kind, F.col(column), F.lit("{}"), now), "edges": edges, "edge_evidence": pairs})
    return merge_facts(parts)


def _flags(parts: tuple[str, ...]) -> Column:
    return F.transform("norm", lambda h: contains_any(h, parts))


def recent_concepts(nodes: DataFrame, n: int = BRIDGE_WINDOW) -> DataFrame:
    return nodes.where("kind <> 'Document'").orderBy(F.desc("updated_at"), "id").limit(n)


def near_names(new: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): ids of new(id, name) and known(id, name) of which one's significant words, at least two, are a real part of the other's.

    The smaller set looks for the larger ones with its rarest word alone, and what it finds is compared whole: a word that many names have pairs only
    names that have no rarer one."""
    tokens = lambda d, i: d.select(F.col("id").alias(i), T.significant_tokens(F.col("name")).alias(f"t{i}"))
    a, b = tokens(new, "a"), tokens(known, "b")
    words = {i: d.select(i, f"t{i}", F.explode(f"t{i}").alias("w")) for i, d in (("a", a), ("b", b))}
    often = words["a"].select("w").unionAll(words["b"].select("w")).groupBy("w").agg(F.count("*").alias("n"))

    def within(i: str, j: str) -> DataFrame:
        """The pairs in which i's words are a real part of j's."""
        rarest = words[i].where(F.size(f"t{i}") >= 2).join(often, "w").groupBy(i, f"t{i}").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
        found = rarest.join(words[j], "w").where((F.size(f"t{i}") < F.size(f"t{j}")) & (F.size(F.array_except(f"t{i}", f"t{j}")) == 0))
        return found.where("a <> b").select("a", "b")

    return within("a", "b").unionByName(within("b", "a")).distinct()


def bridges(new: DataFrame, known: DataFrame, docs_of: DataFrame, now: int) -> Facts:
    """CorrelatesWith edges between near names, tainted and up for review, each with evidence of its own; docs_of(id, doc_id, sha256) says where a new
    name comes from."""
    rows = near_names(new, recent_concepts(known)).join(docs_of.withColumnRenamed("id", "a"), "a")
    rows = rows.join(new.select(F.col("id").alias("a"), F.col("name").alias("na")), "a").join(known.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
    ev = made_id(F.lit("bridge"), "a", "b")
    edges, pairs = _edge(rows, F.col("a"), F.col("b"), "CorrelatesWith", ev, now, confidence=CONFIDENCE["bridge"], review=True, tainted=True)
    evidence = _evidence(rows, ev, F.concat("na", F.lit(" ~ "), "nb"), F.lit(None).cast("string"), "Document", now, confidence=CONFIDENCE["bridge"])
    return {"evidence": evidence, "edges": edges, "edge_evidence": pairs}


def structure(docs: DataFrame) -> DataFrame:
    """id, structural_sha256: a hash of the headings with their levels, then of the tables' headers and numbers of rows, in order."""
    heads = F.transform(F.filter("blocks", lambda b: b["kind"] == "heading"), lambda b: F.concat(b["level"].cast("string"), F.lit(":"), F.lower(F.trim(b["text"]))))
    tabs = F.transform("tables", lambda t: F.concat(F.array_join(t["headers"], "\x1f"), F.lit("#"), F.size(t["rows"]).cast("string")))
    return docs.select("id", F.sha2(F.concat(F.array_join(heads, "\n"), F.lit("\n--\n"), F.array_join(tabs, "\n")), 256).alias("structural_sha256"))


def change_class(fresh: DataFrame, cache: DataFrame) -> DataFrame:
    """path, sha256, change (full, cosmetic or unchanged) of fresh(path, sha256, structural_sha256) against a cache with the same columns."""
    old = cache.select("path", F.col("sha256").alias("c"), F.col("structural_sha256").alias("s"))
    change = F.when(F.col("s").isNull(), "full").when(F.col("sha256") == F.col("c"), "unchanged").when(F.col("structural_sha256") == F.col("s"), "cosmetic").otherwise("full")
    return fresh.join(old, "path", "left").select("path", "sha256", change.alias("change"))


def extract_all(docs: DataFrame, known: DataFrame | None, now: int) -> Facts:
    """All facts of documents; known: nodes from before, for bridges."""
    good = docs.where("error IS NULL")
    facts = merge_facts([{"nodes": document_nodes(good, now)}, kpis(good, now), metrics(good, now), relations(good, now), policy_tables(good, now)])
    if known is not None:
        concepts = facts["nodes"].where("kind <> 'Document'")
        docs_of = facts["edges"].where("kind = 'MentionedIn'").select(F.col("to_id").alias("id"), F.col("from_id").alias("doc_id")).groupBy("id").agg(F.min("doc_id").alias("doc_id")).join(good.select(F.col("id").alias("doc_id"), "sha256").distinct(), "doc_id")
        facts = merge_facts([facts, bridges(concepts, known, docs_of, now)])
    return facts
