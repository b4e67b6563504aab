"""Reads over the graph. Each function answers for all nodes at once; the point forms in evigraph.engine filter the inputs first, so that the filter
reaches the scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions.jsonx import text_at
from ..schema import BLOCKERS, DRIVERS, KPI_STATUSES, Graph


def shared(df: DataFrame) -> DataFrame:
    """df computed once, in the folder named by spark.checkpoint.dir, with its lineage cut. Where that is unset, a temporary folder is taken on a local
    master; a cluster's executors would not see it, and there this raises."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="evigraph-"))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, most: int = 500_000) -> DataFrame:
    """df, sent to all tasks by joins if it has few rows. It is counted here, so it should be `shared`."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def undirected(edges: DataFrame) -> DataFrame:
    """(node, other, edge_id, kind): each edge from both of its ends."""
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.col("id").alias("edge_id"), "kind")
    return out.unionAll(edges.select("to_id", "from_id", F.col("id"), "kind"))


def edge_confidence(g: Graph) -> DataFrame:
    """(edge_id, evidence_confidence, n_evidence) of edges with evidence."""
    rows = g.edge_evidence.join(g.evidence.select(F.col("id").alias("evidence_id"), "confidence"), "evidence_id")
    return rows.groupBy("edge_id").agg(F.round(conf.noisy_or(F.col("confidence")), 6).alias("evidence_confidence"), F.count("*").alias("n_evidence"))


def focus(g: Graph) -> DataFrame:
    """kpi_id, section, edge_id, kind, neighbour_id, neighbour_name, edge_confidence for all KPIs.

    Drivers and blockers come in, risks go out to Risk nodes by any edge but OwnedBy; the owner is the target of the last OwnedBy edge. Edges whose
    neighbour is missing are left out."""
    kpis = g.nodes.where("kind = 'Kpi'").select(F.col("id").alias("kpi_id"))
    names = g.nodes.select(F.col("id").alias("neighbour_id"), F.col("name").alias("neighbour_name"), F.col("kind").alias("neighbour_kind"))
    came = F.when(F.col("kind").isin(*DRIVERS), "driver").when(F.col("kind").isin(*BLOCKERS), "blocker")
    into = g.edges.where(F.col("kind").isin(*DRIVERS, *BLOCKERS)).select(F.col("to_id").alias("kpi_id"), F.col("from_id").alias("neighbour_id"), F.col("id").alias("edge_id"), "kind", "confidence", came.alias("section"))
    out = g.edges.select(F.col("from_id").alias("kpi_id"), F.col("to_id").alias("neighbour_id"), F.col("id").alias("edge_id"), "kind", "confidence", F.when(F.col("kind") == "OwnedBy", "owner").otherwise("risk").alias("section"))
    out = out.join(kpis, "kpi_id").join(names, "neighbour_id").where("section = 'owner' OR neighbour_kind = 'Risk'")
    last = Window.partitionBy("kpi_id", "section").orderBy(F.desc("edge_id"))
    out = out.withColumn("rank", F.row_number().over(last)).where("section <> 'owner' OR rank = 1").drop("rank")
    rows = into.join(kpis, "kpi_id").join(names, "neighbour_id").unionByName(out)
    return rows.select("kpi_id", "section", "edge_id", "kind", "neighbour_id", "neighbour_name", F.round("confidence", 6).alias("edge_confidence"))


def signed_confidence(g: Graph) -> DataFrame:
    """kpi_id, support, contradiction, confidence from the evidence of each KPI's incoming edges."""
    into = g.edges.select(F.col("to_id").alias("kpi_id"), F.col("id").alias("edge_id"), (F.col("kind") == "Contradicts").alias("against"))
    rows = into.join(g.nodes.where("kind = 'Kpi'").select(F.col("id").alias("kpi_id")), "kpi_id", "left_semi").join(g.edge_evidence, "edge_id")
    rows = rows.join(g.evidence.select(F.col("id").alias("evidence_id"), "confidence"), "evidence_id")
    c, against = F.col("confidence"), F.col("against")
    return rows.groupBy("kpi_id").agg(
        F.round(conf.noisy_or(F.when(~against, c)), 6).alias("support"), F.round(conf.noisy_or(F.when(against, c)), 6).alias("contradiction"),
        F.round(conf.signed_noisy_or(c, against), 6).alias("confidence"), F.count("*").alias("n_evidence"),
    )


def evidence_of_nodes(g: Graph) -> DataFrame:
    """node_id and the evidence of the edges that come into it."""
    into = g.edges.select(F.col("to_id").alias("node_id"), F.col("id").alias("edge_id"))
    return into.join(g.edge_evidence, "edge_id").join(g.evidence.withColumnRenamed("id", "evidence_id"), "evidence_id").select("node_id", "edge_id", "evidence_id", "quote", "confidence")


def own_evidence_counts(g: Graph) -> DataFrame:
    return g.evidence.groupBy(F.col("source_node_id").alias("node_id")).agg(F.count("*").alias("n_evidence"))


def evidence_of_edges(g: Graph) -> DataFrame:
    """edge_id and its evidence."""
    return g.edge_evidence.join(g.evidence.withColumnRenamed("id", "evidence_id"), "evidence_id").select("edge_id", "evidence_id", "source_node_id", "quote", "confidence")


def explain(g: Graph) -> DataFrame:
    """kpi_id, rationale, confidence, n_evidence: name, definition and a line for each quote of the KPI's own evidence, in order of evidence ids, with
    blank lines between. The confidence is 0 without evidence."""
    percent = F.bround(F.col("confidence") * 100, 0).cast("int").cast("string")
    line = F.concat(F.lit("- "), F.col("quote"), F.lit(" ("), percent, F.lit("%)"))
    own = g.evidence.groupBy(F.col("source_node_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.when(F.col("quote").isNotNull(), F.struct(F.col("id").alias("k"), line.alias("line"))))).alias("lines"), F.round(conf.noisy_or(F.col("confidence")), 6).alias("c"), F.count("*").alias("n")
    )
    rows = g.nodes.where("kind = 'Kpi'").select("id", "name", F.nullif(text_at(F.col("attrs"), "definition"), F.lit("")).alias("definition")).join(own, "id", "left")
    quotes = F.transform(F.coalesce("lines", F.array().cast("array<struct<k:string,line:string>>")), lambda x: x["line"])
    parts = F.concat(F.array_compact(F.array("name", "definition")), quotes)
    return rows.select(F.col("id").alias("kpi_id"), F.array_join(parts, "\n\n").alias("rationale"), F.coalesce("c", F.lit(0.0)).alias("confidence"), F.coalesce("n", F.lit(0)).alias("n_evidence"))


def impact(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """start, node_id, depth, path (ids joined by >): all nodes that can be reached over outgoing edges from each of starts(start), once, at their
    smallest depth; of shortest paths the one that comes first in order. Starts are not listed.

    Distinct steps are found once; the first level is those of the starts, and each later one joins the newest level's rows alone. Rows carry their path
    without its start; visited pairs go by an anti join, and each level but the last is cut off by a checkpoint."""
    steps = shared(edges.where("to_id IS NOT NULL").select(F.col("from_id").alias("id"), F.col("to_id").alias("next")).distinct())
    first = steps.where("id <> next").select(F.col("id").alias("start"), F.col("next").alias("id"), F.col("next").alias("tail"))
    front = first.join(starts.select("start"), "start", "left_semi")
    levels, seen = [], None
    for depth in range(1, max_depth + 1):
        if depth > 1:
            found = front.join(steps, "id").where("start <> next").select("start", F.col("next").alias("id"), F.concat_ws(">", "tail", "next").alias("tail"))
            front = found.groupBy("start", "id").agg(F.min("tail").alias("tail")).join(seen, ["start", "id"], "left_anti")
        front = shared(front) if depth < max_depth else front
        levels.append(front.select("start", F.col("id").alias("node_id"), F.lit(depth).alias("depth"), F.concat_ws(">", "start", "tail").alias("path")))
        if depth < max_depth and front.isEmpty():
            break
        pairs = front.select("start", "id")
        seen = pairs if seen is None else seen.unionByName(pairs)
    return reduce(DataFrame.unionByName, levels)


def trace_decisions(g: Graph) -> DataFrame:
    """decision_id, role, item_id: causes come in by DecidedBy or Causes, actions go out by NextAction, evidence has the node as its source. Any node
    may be asked for; here those of kind Decision are."""
    nodes = g.nodes.where("kind = 'Decision'").select(F.col("id").alias("decision_id"))
    known = g.nodes.select(F.col("id").alias("item_id"))
    cause = g.edges.where("kind IN ('DecidedBy', 'Causes')").select(F.col("to_id").alias("decision_id"), F.lit("caused_by").alias("role"), F.col("from_id").alias("item_id"))
    action = g.edges.where("kind = 'NextAction'").select(F.col("from_id").alias("decision_id"), F.lit("next_action").alias("role"), F.col("to_id").alias("item_id"))
    own = g.evidence.select(F.col("source_node_id").alias("decision_id"), F.lit("evidenced_by").alias("role"), F.col("id").alias("item_id"))
    return cause.unionByName(action).join(known, "item_id", "left_semi").unionByName(own).join(nodes, "decision_id", "left_semi").select("decision_id", "role", "item_id")


def suggest_actions(g: Graph, statuses: tuple[str, ...] | None = None, include_unreviewed: bool = False) -> DataFrame:
    """kpi_id, action_id, action_name, status, edge_confidence: a row for each outgoing edge to an Action node. Unreviewed edges are left out unless
    wanted; with statuses, actions whose status is missing or unknown text stay beside those in the list."""
    status = text_at(F.col("attrs"), "status")
    actions = g.nodes.where("kind = 'Action'").select(F.col("id").alias("action_id"), F.col("name").alias("action_name"), F.when(status.isin(*KPI_STATUSES), status).alias("status"))
    if statuses is not None:
        actions = actions.where(F.col("status").isNull() | F.col("status").isin(*statuses))
    edges = g.edges if include_unreviewed else g.edges.where("NOT requires_human_review")
    rows = edges.select(F.col("from_id").alias("kpi_id"), F.col("to_id").alias("action_id"), F.col("id").alias("edge_id"), "confidence").join(actions, "action_id")
    return rows.select("kpi_id", "edge_id", "action_id", "action_name", "status", F.round("confidence", 6).alias("edge_confidence"))


def stats(g: Graph) -> DataFrame:
    """One row: totals of nodes, documents, concepts, edges and evidence, mean confidence of concepts, taint and review counts."""
    concept = F.col("kind") != "Document"
    flag = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    n = g.nodes.agg(
        F.count("*").alias("nodes"), F.count(F.when(~concept, 1)).alias("documents"), F.count(F.when(concept, 1)).alias("concepts"),
        F.round(F.coalesce(F.avg(F.when(concept, F.col("confidence"))), F.lit(0.0)), 6).alias("avg_confidence"), flag("is_tainted").alias("tainted_nodes"), flag("requires_human_review").alias("review_nodes"), F.lit(1).alias("k"),
    )
    e = g.edges.agg(F.count("*").alias("edges"), flag("is_tainted").alias("tainted_edges"), flag("requires_human_review").alias("review_edges"), F.lit(1).alias("k"))
    v = g.evidence.agg(F.count("*").alias("evidence"), F.lit(1).alias("k"))
    return n.join(e, "k").join(v, "k").drop("k")


def kind_counts(nodes: DataFrame) -> DataFrame:
    from ..schema import NODE_KINDS

    return nodes.where(F.col("kind").isin(*NODE_KINDS)).groupBy("kind").agg(F.count("*").alias("n"))


def document_summaries(g: Graph) -> DataFrame:
    """id, name, path, indexed_at, n_mentions (edges), n_evidence: documents with each of their cache rows."""
    mentions = g.edges.where("kind = 'MentionedIn'").groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("m"))
    own = own_evidence_counts(g).select(F.col("node_id").alias("id"), F.col("n_evidence").alias("v"))
    rows = g.nodes.where("kind = 'Document'").select("id", "name").join(g.document_cache.select(F.col("node_id").alias("id"), "path", "indexed_at"), "id", "left")
    return rows.join(mentions, "id", "left").join(own, "id", "left").select("id", "name", "path", "indexed_at", F.coalesce("m", F.lit(0)).alias("n_mentions"), F.coalesce("v", F.lit(0)).alias("n_evidence"))


def source_document_counts(g: Graph) -> DataFrame:
    """concept_id, n_documents: distinct documents that mention it."""
    documents = g.nodes.where("kind = 'Document'").select(F.col("id").alias("from_id"))
    return g.edges.where("kind = 'MentionedIn'").join(documents, "from_id", "left_semi").groupBy(F.col("to_id").alias("concept_id")).agg(F.countDistinct("from_id").alias("n_documents"))


def mentioned_concepts(g: Graph) -> DataFrame:
    """document_id, concept_id, each pair once."""
    return g.edges.where("kind = 'MentionedIn'").select(F.col("from_id").alias("document_id"), F.col("to_id").alias("concept_id")).distinct()


def ends_of(g: Graph) -> DataFrame:
    """(evidence_id, from_id, to_id): the ends of the edges that evidence is of, both in one row, so that they are exchanged once."""
    return g.edge_evidence.join(g.edges.select(F.col("id").alias("edge_id"), "from_id", "to_id"), "edge_id").select("evidence_id", "from_id", "to_id")


def touching_evidence(g: Graph) -> DataFrame:
    """(node, evidence_id), once: own evidence and that of edges at either end. Evidence that is missing touches nothing.

    All rows of a piece of evidence meet by its id, once: what follows by that id needs no other exchange."""
    rows = g.evidence.select(F.col("id").alias("evidence_id"), "source_node_id").join(ends_of(g), "evidence_id", "left")
    nodes = F.array_distinct(F.array_compact(F.array("source_node_id", "from_id", "to_id")))
    return rows.select(F.explode(nodes).alias("node"), "evidence_id").distinct()


def node_quotes(g: Graph) -> DataFrame:
    """node_id and its distinct quotes in order, joined by a bar.

    Quotes meet edges by the evidence's id and then go to both ends; what comes twice is dropped within the sets, not before."""
    said = g.evidence.where("quote IS NOT NULL")
    by_edge = g.edge_evidence.join(said.select(F.col("id").alias("evidence_id"), "quote"), "evidence_id").select("edge_id", "quote")
    ends = g.edges.select(F.col("id").alias("edge_id"), F.array("from_id", "to_id").alias("ends"))
    rows = by_edge.join(ends, "edge_id").select(F.explode("ends").alias("node_id"), "quote").unionByName(said.select(F.col("source_node_id").alias("node_id"), "quote"))
    return rows.groupBy("node_id").agg(F.array_join(F.sort_array(F.collect_set("quote")), " | ").alias("quotes"))


def display_confidence(g: Graph) -> DataFrame:
    """node_id, shown, n_evidence, review: noisy-or over all evidence that touches the node, else its stored confidence. A node is up for review if it
    is flagged and is a KPI or below 0.5, or an edge or a piece of evidence that touches it is flagged."""
    ev = g.evidence.select(F.col("id").alias("evidence_id"), "confidence", F.col("requires_human_review").alias("r"))
    seen = touching_evidence(g).join(ev, "evidence_id").groupBy(F.col("node").alias("id")).agg(conf.noisy_or(F.col("confidence")).alias("c"), F.count("*").alias("n"), F.bool_or("r").alias("ev_review"))
    flagged = undirected(g.edges.where("requires_human_review")).select(F.col("node").alias("id")).distinct().withColumn("edge_review", F.lit(True))
    rows = g.nodes.select("id", "kind", "confidence", "requires_human_review").join(seen, "id", "left").join(flagged, "id", "left")
    shown = F.coalesce("c", "confidence")
    own = F.col("requires_human_review") & ((F.col("kind") == "Kpi") | (shown < 0.5))
    review = own | F.coalesce("edge_review", F.lit(False)) | F.coalesce("ev_review", F.lit(False))
    return rows.select(F.col("id").alias("node_id"), F.round(shown, 6).alias("shown"), F.coalesce("n", F.lit(0)).alias("n_evidence"), review.alias("review"))


def degrees(edges: DataFrame) -> DataFrame:
    """node_id, degree: ends of edges, so that multiple edges and loops count."""
    return undirected(edges).groupBy(F.col("node").alias("node_id")).agg(F.count("*").alias("degree"))


def neighbour_pairs(edges: DataFrame) -> DataFrame:
    """node_id, neighbour: a row for each distinct other of a node. Pairs are dealt out by both ends, so a hot node's are spread."""
    return undirected(edges).where("node <> other").select(F.col("node").alias("node_id"), F.col("other").alias("neighbour")).distinct()


def visible_edges(edges: DataFrame, hidden: tuple[str, ...] = ("MentionedIn",)) -> DataFrame:
    return edges.where(~F.col("kind").isin(*hidden))


def scoped_subgraph(g: Graph, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that documents(id) mention, with those documents, and the edges between them."""
    mentioned = g.edges.where("kind = 'MentionedIn'").join(documents.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    ids = mentioned.unionByName(documents.select("id")).distinct()
    nodes = g.nodes.join(ids, "id", "left_semi")
    edges = g.edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return nodes, edges


def signature(*parts: DataFrame) -> DataFrame:
    """signature: one text for the rows of some frames as multisets, whatever their order. It is a count and two sums of hashes for each frame, so that
    partial sums add up, rows that come add to it and rows that go subtract from it."""
    total = []
    for k, rows in enumerate(parts):
        hashed = [F.sum(F.xxhash64(F.lit(f"{salt}{k}"), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rows.columns]).cast("decimal(20,0)")).cast("string") for salt in "ab"]
        total.append(rows.agg(F.concat_ws(":", F.count("*").cast("string"), *hashed).alias("s")).select(F.lit(k).alias("k"), "s"))
    every = reduce(DataFrame.unionByName, total)
    return every.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "|"), 256).alias("signature"))


def documents_page(summaries: DataFrame, text: str, page: int, size: int) -> DataFrame:
    """A page of the documents whose name or path contains a text; a page past the end is the last one."""
    want = text.strip().lower()
    rows = summaries.where(F.lower("name").contains(want) | F.lower(F.coalesce("path", F.lit(""))).contains(want)) if want else summaries
    last = max(0, (rows.count() - 1) // size)
    return rows.orderBy(F.desc("indexed_at"), "id", "path").offset(min(max(page, 0), last) * size).limit(size)


def orphan_edges(g: Graph) -> DataFrame:
    """Edges without evidence."""
    return g.edges.join(g.edge_evidence.withColumnRenamed("edge_id", "id"), "id", "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other, edge_id, kind, outgoing): each edge from either end, for reads by node."""
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), F.col("id").alias("edge_id"), "kind", F.lit(True).alias("outgoing"))
    return out.unionAll(edges.select("to_id", "from_id", "id", "kind", F.lit(False)))


def around(g: Graph, ids: DataFrame) -> Graph:
    """The part of a graph that says something about the nodes ids(id): these, the edges at them, and the evidence of both."""
    at = [g.edges.join(ids.withColumnRenamed("id", end), end, "left_semi").select(*g.edges.columns) for end in ("from_id", "to_id")]
    edges = shared(at[0].unionByName(at[1]).dropDuplicates(["id"]))
    pairs = shared(g.edge_evidence.join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select("edge_id", "evidence_id"))
    own = g.evidence.join(ids.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi").select(*g.evidence.columns)
    evidence = own.unionByName(g.evidence.join(pairs.select(F.col("evidence_id").alias("id")).distinct(), "id", "left_semi").select(*g.evidence.columns)).dropDuplicates(["id"])
    return Graph(**{**g.frames(), "nodes": g.nodes.join(ids, "id", "left_semi"), "edges": edges, "edge_evidence": pairs, "evidence": evidence})


def neighbours_of(g: Graph, ids: DataFrame) -> DataFrame:
    """Adjacency (from_id, to_id, id, kind) of edges whose ends exist, at these ids."""
    known = g.nodes.select("id")
    ends = g.edges.join(known.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(known.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return ends.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").select("id", "from_id", "to_id", "kind")


def lookup_kpi(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """asked, kpi_id: for names(asked), the KPI with that id, else with the id made of it, else with that id or name in any case."""
    kpis = nodes.where("kind = 'Kpi'").select(F.col("id").alias("kpi_id"), F.lower("id").alias("low_id"), F.lower("name").alias("low_name"))
    made = F.concat(F.lit("kpi."), F.regexp_replace(F.lower(F.trim("asked")), "[^a-z0-9]", "_"))
    keys: list[tuple[int, Column, str]] = [(1, F.col("asked"), "kpi_id"), (2, made, "kpi_id"), (3, F.lower("asked"), "low_id"), (3, F.lower("asked"), "low_name")]
    found = [names.select("asked", key.alias("key")).join(kpis, F.col("key") == F.col(column)).select("asked", "kpi_id", F.lit(rank).alias("rank")) for rank, key, column in keys]
    return reduce(DataFrame.unionByName, found).groupBy("asked").agg(F.min(F.struct("rank", "kpi_id")).alias("x")).select("asked", "x.kpi_id")
