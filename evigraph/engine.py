"""The engine: a workspace folder with a graph, its section index, blobs and summaries; and its ten tools."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers
from .functions.jsonx import patched
from .functions.text import ascii_lower
from .operators import categories, diff, extract, graph, mutations, search, series, tree
from .operators.textindex import TextIndex
from .plans import lens
from .schema import PAGE_SECTIONS, TABLES, Graph
from .sources import files, parse, snapshot
from .sources.commits import Change, Commits, Spec

#: Errors that a summary lists; it counts all.
ERRORS = 1000
#: The tables of a workspace, all in one commit log.
WORKSPACE = {
    **{name: Spec(schema, {"edge_evidence": ("edge_id", "evidence_id"), "document_cache": ("path",)}.get(name, ("id",)), {"nodes": "id", "evidence": "source_node_id"}.get(name)) for name, schema in TABLES.items()},
    "adjacency": Spec("node string, other string, edge_id string, kind string, outgoing boolean", ("edge_id", "outgoing"), "node"),
    "sections": Spec(PAGE_SECTIONS, ("section_id",), "doc_node_id"),
    "blobs": Spec("sha256 string, content binary", ("sha256",), "sha256"),
    "generations": Spec("id string, name string, created_at long", ("id",)),
    "generation_sources": Spec("generation_id string, path string, sha256 string", ("generation_id", "path")),
    "workspace": Spec("name string, created_at long", ("name",)),
    "summaries": Spec("scope string, signature string, config string, source string, created_at long, updated_at long", ("scope",)),
    "categories": Spec("scope string, label string, node_id string, is_headline boolean, size long", ("scope", "node_id"), "scope"),
}
GRAPH = tuple(TABLES)
#: The scope of the summary of all documents.
DEFAULT = "default"
FACTS = ("nodes", "edges", "evidence", "edge_evidence", "metric_values")


class NotFound(LookupError):
    """A node or edge that does not exist."""


class Engine:
    def __init__(self, spark: SparkSession, workspace: str, now: Callable[[], int] | None = None, hooks: dict | None = None, provider=None):
        import time

        self.spark, self.workspace, self.hooks, self.provider = spark, workspace.rstrip("/"), hooks, provider
        self.now = now or (lambda: int(time.time()))
        self.log = Commits(spark, self.workspace, WORKSPACE)
        self._node_index = TextIndex(spark, f"{self.workspace}/node_index", "id", search.NODE_FIELDS)
        self._section_index = TextIndex(spark, f"{self.workspace}/section_index", "section_id", search.SECTION_FIELDS)

    # State.

    def init(self, name: str = "default") -> None:
        """Names a new workspace; one that has a name keeps it."""
        base = self.log.number()
        if not self.log.read("workspace", base).isEmpty():
            raise ValueError(f"{self.workspace} is a workspace already")
        self._commit(base, {"workspace": Change(put=self.spark.createDataFrame([(name, self.now())], WORKSPACE["workspace"].schema))}, "named", name)

    def name(self) -> str:
        row = self.log.read("workspace").first()
        return row["name"] if row else "default"

    def version(self) -> int:
        """The number of the newest commit."""
        return self.log.number()

    def graph(self, at: int | None = None) -> Graph:
        """The graph as it is, or as it was in a version that is still there."""
        at = self.log.number() if at is None else at
        return Graph(**{name: self.log.read(name, at) for name in GRAPH})

    def sections(self, at: int | None = None) -> DataFrame:
        return self.log.read("sections", at)

    def _commit(self, base: int, changes: dict[str, Change], kind: str, subject: str | None = None, n: int = 0, reads: tuple[str, ...] | None = None) -> int:
        """One commit of changes to any tables, with the event that tells of it. Adjacency follows edges."""
        if "edges" in changes:
            edges = changes["edges"]
            ends = lambda rows: None if rows is None else graph.adjacency(rows)
            changes = changes | {"adjacency": Change(ends(edges.gone), ends(edges.put), ends(edges.whole), edges.fresh)}
        number = self.log.commit(base, changes, kind, subject, n, self.now(), reads)
        self.log.tidy(self.now())
        return number

    def events(self, after: int = 0, most: int = 1000) -> list[dict]:
        """What happened to the workspace after the event of this number, oldest first, at most so many. A reader keeps the number that it has read up to;
        events of versions that were dropped are gone."""
        return _rows(self.log.log(after, most))

    def follow(self) -> DataFrame:
        """The events as a stream, each once: (number, at, kind, subject, n)."""
        return self.log.stream()

    def compact(self) -> list[str]:
        """Folds the changes of all tables into them. Returns the tables that had some."""
        return [name for name in WORKSPACE if self.log.compact(name, self.now())]

    def drop_versions(self, keep: int = 2, grace: float = 86400) -> None:
        """Removes what only versions before the newest `keep` need."""
        self.log.drop(keep, grace)

    # Ingest.

    def _facts(self, docs: DataFrame, known: DataFrame, now: int) -> dict[str, DataFrame]:
        """What the rules find in documents and, where there is a provider, what it finds beyond them. Each call of it is repeated after a failure."""
        facts = extract.extract_all(docs, known, now)
        if self.provider is None or not hasattr(self.provider, "entities"):
            return facts
        facts = {k: graph.shared(f) for k, f in facts.items()}
        patient = providers.Patient(self.provider)
        seen = facts["nodes"].select("id").unionByName(known.select("id")).distinct()
        # a provider is asked once: what it said is kept
        found = {k: graph.shared(f) for k, f in providers.entities(docs, seen, patient, now).items()}
        facts = extract.merge_facts([facts, found])
        names = facts["nodes"].where("kind <> 'Document'").select("id", "name")
        mentions = facts["edges"].where("kind = 'MentionedIn'").select(F.col("to_id").alias("id"), F.col("from_id").alias("doc_id")).join(names, "id")
        linked = facts["edges"].where("kind <> 'MentionedIn'").select("from_id", "to_id")
        more = {k: graph.shared(f) for k, f in providers.relations(docs, mentions.select("doc_id", "id", "name"), linked, patient, now).items()}
        return extract.merge_facts([facts, more])

    # Ingest.

    def ingest_folder(self, folder: str, recursive: bool = True, most_bytes: int = files.MAX_BYTES, skip_unchanged: bool = False) -> dict:
        found, large = files.gated(files.list_files(self.spark, folder, recursive), most_bytes)
        summary = self.ingest_files(found, skip_unchanged)
        summary["errors"] += [(r["path"], r["error"]) for r in large.collect()]
        return summary

    def ingest_text(self, text: str, path: str = "inline.md") -> dict:
        return self.ingest_files(self.spark.createDataFrame([(path, bytearray(text.encode()))], "path string, content binary"), blobs=False)

    def ingest_files(self, found: DataFrame, skip_unchanged: bool = False, blobs: bool = True) -> dict:
        """Parses files(path, content), puts their facts into the graph and their sections into the index. Returns counts and errors."""
        now, base = self.now(), self.version()
        before = self.graph(base)
        docs = graph.shared(parse.parse_files(found, self.hooks))
        failed = docs.where("error IS NOT NULL").select("source_path", "error").orderBy("source_path")
        errors = [(r["source_path"], r["error"]) for r in failed.limit(ERRORS).collect()]
        good = docs.where("error IS NULL")
        fresh = good.join(extract.structure(good), "id").select(F.col("source_path").alias("path"), "sha256", "structural_sha256", F.col("id").alias("node_id"))
        classes = graph.shared(extract.change_class(fresh.dropDuplicates(["path"]), before.document_cache))
        counts = {r["change"]: r["n"] for r in classes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if skip_unchanged:
            good = good.join(classes.where("change <> 'unchanged'").select(F.col("path").alias("source_path")), "source_path", "left_semi")
        facts = {name: graph.shared(frame) for name, frame in self._facts(good, before.nodes, now).items()}
        changes = self._put_facts(before, facts)
        cached = fresh.select("path", "sha256", "structural_sha256", F.lit(now).cast("long").alias("indexed_at"), "node_id")
        changes["document_cache"] = mutations.upserted(before.document_cache, mutations.newest_cache(cached), ("path",))
        changes["sections"] = self._section_change(base, graph.shared(tree.sections(good.dropDuplicates(["id"]))))
        if blobs:
            changes["blobs"] = Change(put=files.new_blobs(found, self.log.read("blobs", base)), fresh=True)
        counts_of = {name: facts[name].count() for name in ("nodes", "edges", "evidence")}
        out = {"files": good.count(), "changes": counts, **counts_of, "errors": errors, "failed": failed.count()}
        self._commit(base, changes, "ingested", n=out["files"])
        return out

    @staticmethod
    def _put_facts(before: Graph, facts: dict[str, DataFrame]) -> dict[str, Change]:
        """The changes that put facts into a graph: a node keeps its first time, an edge its first ends, author and time, a value all that it was."""
        keep = {"nodes": ("created_at",), "edges": ("from_id", "to_id", "created_by", "created_at"), "metric_values": tuple(WORKSPACE["metric_values"].columns)}
        return {name: mutations.upserted(getattr(before, name), facts[name], WORKSPACE[name].key, keep.get(name, ())) for name in FACTS if name in facts}

    def _section_change(self, base: int, fresh: DataFrame, documents: DataFrame | None = None) -> Change:
        """The change that puts the sections of some documents in the place of those that they have."""
        ids = fresh.select("doc_node_id").distinct() if documents is None else documents
        old = self.sections(base)
        old = graph.shared(old.join(ids, "doc_node_id", "left_semi").select(*old.columns))
        return Change(put=fresh, fresh=True) if old.isEmpty() else mutations.difference(old, fresh)

    def remove_document(self, doc_id: str, delete_blob: bool = True) -> None:
        """Removes a document and what it alone mentions; its blob too, if no other document has it, unless that shall stay. All of it is one commit."""
        base = self.version()
        g = self.graph(base)
        self._need(g, doc_id, "Document")
        one = self.spark.createDataFrame([(doc_id,)], "id string")
        gone = mutations.removed(g, graph.shared(mutations.removal_ids(g, one)))
        changes = {name: Change(gone=rows) for name, rows in gone.items()}
        changes["sections"] = Change(gone=self.sections(base).where(F.col("doc_node_id") == doc_id))
        if delete_blob:
            kept = g.document_cache.join(gone["document_cache"].select("path"), "path", "left_anti").select("sha256")
            contents = gone["document_cache"].select("sha256").distinct().join(kept, "sha256", "left_anti")
            changes["blobs"] = Change(gone=self.log.read("blobs", base).join(contents, "sha256", "left_semi"))
        self._commit(base, changes, "removed", doc_id)

    def regenerate_document(self, doc_id: str) -> dict:
        """Extracts a document's facts anew from its blob and puts them in the place of the old ones, in one commit. Concepts that go with the old facts
        are no ends of bridges from the new ones."""
        base, now = self.version(), self.now()
        g = self.graph(base)
        self._need(g, doc_id, "Document")
        one = self.spark.createDataFrame([(doc_id,)], "id string")
        source = g.document_cache.where(F.col("node_id") == doc_id).select("path", "sha256")
        content = source.join(self.log.read("blobs", base), "sha256").select("path", "content")
        docs = graph.shared(parse.parse_files(content, self.hooks).where("error IS NULL").dropDuplicates(["id"]))
        if docs.isEmpty():
            raise NotFound(f"no content of {doc_id}")
        known = g.nodes.join(graph.shared(mutations.removal_ids(g, one)), "id", "left_anti")
        facts = {name: graph.shared(frame) for name, frame in self._facts(docs, known, now).items()}
        changes = mutations.regenerated(g, one, facts)
        changes["sections"] = self._section_change(base, graph.shared(tree.sections(docs)), one.withColumnRenamed("id", "doc_node_id"))
        self._commit(base, changes, "regenerated", doc_id)
        return {name: facts[name].count() for name in ("nodes", "edges", "evidence")}

    def rebuild_sections(self) -> int:
        """Builds the section index anew from the blobs; returns the number of documents without one."""
        base = self.version()
        blobs = graph.shared(self.graph(base).document_cache.join(self.log.read("blobs", base), "sha256", "left"))
        made = tree.sections(parse.parse_files(blobs.where("content IS NOT NULL"), self.hooks).dropDuplicates(["id"]))
        self._commit(base, {"sections": Change(whole=made)}, "sections rebuilt", reads=("sections", "document_cache", "blobs"))
        return blobs.where("content IS NULL").count()

    def stale_documents(self) -> DataFrame:
        """(id, sha256) of documents whose sections were made from another content, or that have none."""
        g, found = self.graph(), self.sections()
        docs = g.document_cache.select(F.col("node_id").alias("id"), "sha256")
        trees = found.select("doc_node_id").distinct().join(docs.withColumnRenamed("id", "doc_node_id"), "doc_node_id")
        return tree.stale(docs, trees)

    def summarize_sections(self) -> None:
        """Gives all sections summaries by the provider, children first."""
        patient, base = providers.Patient(self.provider), self.version()
        old = self.sections(base)
        self._commit(base, {"sections": mutations.difference(old, graph.shared(tree.summarize(old, patient.summarize)))}, "summarized")

    # Batches, jobs and generations.

    def apply(self, log: DataFrame) -> int:
        """Applies a batch of log rows (batch above 0) as a whole, or not at all: a row that breaks a rule makes it raise, and the graph stays. What it
        changes is written."""
        base = self.version()
        g = self.graph(base)
        rows = graph.shared(log.select("batch", "seq", "op", "id", "payload"))
        accepted = mutations.whole_batch(rows, g)
        return self._replay(base, g, accepted, g.document_cache, "applied", ())

    def _replay(self, base: int, g: Graph, accepted: DataFrame, cache: DataFrame, kind: str, more: tuple[str, ...]) -> int:
        after = mutations.state(snapshot.import_log(g, 0).unionByName(accepted), cache)
        tables = (*FACTS, "kpi_candidates", *more)
        changes = {name: mutations.difference(getattr(g, name), graph.shared(getattr(after, name))) for name in tables}
        return self._commit(base, changes, kind, n=accepted.count(), reads=GRAPH)

    def recompute_kpis(self) -> list[dict]:
        """Writes the recomputed confidence, trend and newest value of each KPI into its node, and leaves the rest of its attributes as they are; flags of
        review are set and never cleared."""
        base = self.version()
        g = self.graph(base)
        rows = graph.shared(series.recompute(g, self.now()))
        fresh = rows.select(F.col("kpi_id").alias("id"), F.struct("confidence", "review", "at", "trend", "value").alias("x"))
        new = {
            "attrs": patched(F.col("attrs"), {"trend": F.col("x.trend"), "value": F.col("x.value")}),
            "confidence": F.col("x.confidence"),
            "requires_human_review": F.col("x.review"),
            "updated_at": F.col("x.at"),
        }
        nodes = g.nodes.join(fresh, "id").select(*[new.get(c, F.col(c)).alias(c) for c in g.nodes.columns])
        self._commit(base, {"nodes": mutations.upserted(g.nodes, nodes, ("id",))}, "recomputed", n=rows.count(), reads=GRAPH)
        return _rows(rows.orderBy("kpi_id"))

    def discover_kpis(self, by_edges: bool = False) -> list[dict]:
        """Proposes candidates for KPIs with enough documents and evidence; they are pending until they are resolved."""
        base = self.version()
        g = self.graph(base)
        rows = graph.shared(series.discover(g, by_edges))
        fresh = rows.select(
            F.concat(F.lit("candidate."), F.col("kpi_id")).alias("id"),
            "name",
            F.lit("").alias("definition"),
            F.array("kpi_id").alias("detected_in"),
            F.col("score").alias("confidence"),
            F.lit(self.now()).cast("long").alias("proposed_at"),
            F.lit("pending").alias("status"),
            F.lit(None).cast("string").alias("merged_into"),
        )
        self._commit(base, {"kpi_candidates": mutations.upserted(g.kpi_candidates, fresh, ("id",))}, "discovered", n=rows.count(), reads=GRAPH)
        return _rows(rows.orderBy("kpi_id"))

    def create_generation(self, name: str, paths: list[str] | None = None) -> str:
        """Names a set of the files that the graph knows, with their contents: those of these paths, or all. Unknown paths are passed over."""
        base, now = self.version(), self.now()
        cache = self.log.read("document_cache", base)
        wanted = cache.select("path") if paths is None else self.spark.createDataFrame([(p,) for p in paths], "path string")
        generation = f"gen.{self.log.read('generations', base).count() + 1}.{now}"
        one = self.spark.createDataFrame([(generation, name, now)], WORKSPACE["generations"].schema)
        changes = {"generation_sources": Change(put=series.create_generation(wanted, cache, generation)), "generations": Change(put=one)}
        self._commit(base, changes, "generation", generation, reads=("generations", "document_cache"))
        return generation

    def list_generations(self) -> list[dict]:
        return _rows(series.generation_counts(self.log.read("generations"), self.log.read("generation_sources")))

    def generation(self, generation: str) -> Graph:
        """What rests on the contents of a generation, with the cache rows of its files alone."""
        sources = self.log.read("generation_sources").where(F.col("generation_id") == generation)
        if sources.isEmpty():
            raise NotFound(f"no generation {generation}")
        g = mutations.generation_closure(self.graph(), sources.select("sha256"))
        cache = g.document_cache.join(sources.select("path", "sha256"), ["path", "sha256"], "left_semi").select(*g.document_cache.columns)
        return Graph(**{**g.frames(), "document_cache": cache})

    def export_generation(self, generation: str, folder: str) -> None:
        snapshot.export(self.generation(generation), folder, self.now())

    # Upkeep.

    def clear_review_flags(self) -> int:
        """Takes back the flags of review that an early version set on tainted nodes; returns how many went."""
        base = self.version()
        nodes = self.log.read("nodes", base)
        change = mutations.difference(nodes, mutations.clear_review_flags(nodes))
        gone = graph.shared(change.gone)
        self._commit(base, {"nodes": Change(gone, change.put)}, "flags cleared", n=gone.count())
        return gone.count()

    def blob_use(self) -> DataFrame:
        """(sha256, n): how many cached files have each content that is kept; 0 for one that none has."""
        known = files.blob_references(self.log.read("document_cache"))
        return self.log.read("blobs").select("sha256").join(known, "sha256", "left").select("sha256", F.coalesce("n", F.lit(0)).alias("n"))

    def drop_unused_blobs(self) -> int:
        """Removes the contents that no cached file has; returns how many went."""
        base = self.version()
        gone = graph.shared(files.unreferenced_blobs(self.log.read("blobs", base), self.log.read("document_cache", base)))
        self._commit(base, {"blobs": Change(gone=gone)}, "blobs dropped", n=gone.count(), reads=("blobs", "document_cache"))
        return gone.count()

    def preview(self, folder: str, recursive: bool = True) -> DataFrame:
        """(path, supported, reason): which files of a folder an ingest would take."""
        return files.listing(files.list_files(self.spark, folder, recursive))

    def sql(self, query: str, prefix: str = "") -> DataFrame:
        """A query over the graph's tables as views: nodes, edges, evidence, edge_evidence, metric_values, kpi_candidates, document_cache."""
        self.graph().register_views(prefix)
        return self.spark.sql(query)

    # Tools.

    def nodes_by_id(self, ids: list[str]) -> DataFrame:
        """These nodes. Of folded tables only the files of their buckets are read."""
        return self.log.lookup("nodes", ids)

    def neighbours(self, ids: list[str]) -> DataFrame:
        """(node, other, edge_id, kind, outgoing) of the edges at these nodes, read like `nodes_by_id`."""
        return self.log.lookup("adjacency", ids)

    def _need(self, g: Graph, node_id: str, kind: str | None = None) -> None:
        row = self.nodes_by_id([node_id]).select("kind").first()
        if row is None or (kind and row["kind"] != kind):
            raise NotFound(f"no {kind or 'node'} {node_id}")

    def focus_kpi(self, kpi_id: str) -> list[dict]:
        g = self.graph()
        self._need(g, kpi_id, "Kpi")
        return _rows(graph.focus(g).where(F.col("kpi_id") == kpi_id).orderBy("section", "edge_id"))

    def explain_kpi(self, kpi_id: str, depth: int | None = None) -> dict:
        """The depth is taken and not used."""
        g = self.graph()
        self._need(g, kpi_id, "Kpi")
        out = _rows(graph.explain(g).where(F.col("kpi_id") == kpi_id))[0]
        quotes = [r["quote"] for r in g.evidence.where((F.col("source_node_id") == kpi_id) & F.col("quote").isNotNull()).select("quote").collect()]
        if self.provider is not None and quotes:
            try:
                out["rationale"] = self.provider.rationale(kpi_id, quotes)
            except Exception as e:  # the plain rationale stays
                out["provider_error"] = str(e)
        return out

    def get_evidence(self, node_id: str | None = None, edge_id: str | None = None) -> list[dict]:
        g = self.graph()
        if node_id is not None:
            return _rows(graph.evidence_of_nodes(g).where(F.col("node_id") == node_id).orderBy("edge_id", "evidence_id"))
        if edge_id is not None:
            return _rows(graph.evidence_of_edges(g).where(F.col("edge_id") == edge_id).orderBy("evidence_id"))
        raise ValueError("a node or an edge is needed")

    def impact_radius(self, node_id: str, max_depth: int = 3) -> list[dict]:
        g = self.graph()
        self._need(g, node_id)
        return _rows(graph.impact(g.edges, self.spark.createDataFrame([(node_id,)], "start string"), max_depth).orderBy("depth", "node_id"))

    def trace_decision(self, decision_node_id: str) -> list[dict]:
        g = self.graph()
        self._need(g, decision_node_id)
        one = g.nodes.withColumn("kind", F.when(F.col("id") == decision_node_id, F.lit("Decision")).when(F.col("kind") == "Decision", F.lit("Insight")).otherwise(F.col("kind")))
        return _rows(graph.trace_decisions(Graph(**{**g.frames(), "nodes": one})).orderBy("role", "item_id"))

    def suggest_actions(self, kpi_id: str, status_filter: list[str] | None = None, include_unreviewed: bool = False) -> list[dict]:
        g = self.graph()
        return _rows(graph.suggest_actions(g, tuple(status_filter) if status_filter is not None else None, include_unreviewed).where(F.col("kpi_id") == kpi_id).orderBy("edge_id"))

    def _nodes_indexed(self, rebuild: bool = False) -> TextIndex:
        """The index of node texts, brought up to the newest graph: the commits since tell which nodes they touched, and no others are looked at."""
        version, synced = self.version(), None if rebuild else self._node_index.version()
        if synced == version:
            return self._node_index
        touched = None if synced is None else self._touched_nodes(synced, version)
        g = self.graph(version)
        if touched is None:
            self._node_index.rebuild(search.node_texts(g.nodes, graph.node_quotes(g)), version)
        else:
            touched = graph.shared(touched)
            near = graph.around(g, touched)
            self._node_index.sync(touched, search.node_texts(near.nodes, graph.node_quotes(near).join(touched.withColumnRenamed("id", "node_id"), "node_id", "left_semi")), version)
        return self._node_index

    def _touched_nodes(self, after: int, upto: int) -> DataFrame | None:
        """(id) of the nodes whose text the commits in between may have changed: those that changed, sources of evidence that did, and ends of edges that
        did or whose evidence or pairs did. None if that is not known."""
        found = {name: self.log.changes(name, after, upto) for name in ("nodes", "edges", "evidence", "edge_evidence")}
        if any(c is None for c in found.values()):
            return None
        rows = {name: c.gone.unionByName(c.put) for name, c in found.items()}
        pairs = rows["edge_evidence"].unionByName(self.log.read("edge_evidence", upto).join(rows["evidence"].select(F.col("id").alias("evidence_id")).distinct(), "evidence_id", "left_semi"))
        edges = self.log.read("edges", upto).join(pairs.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi").select(*WORKSPACE["edges"].columns).unionByName(rows["edges"])
        ends = edges.select(F.col("from_id").alias("id")).unionByName(edges.select(F.col("to_id").alias("id")))
        return rows["nodes"].select("id").unionByName(rows["evidence"].select(F.col("source_node_id").alias("id"))).unionByName(ends).distinct()

    def _sections_indexed(self, rebuild: bool = False) -> TextIndex:
        version, synced = self.version(), None if rebuild else self._section_index.version()
        if synced == version:
            return self._section_index
        change = None if synced is None else self.log.changes("sections", synced, version)
        texts = self.sections(version).select("section_id", *search.SECTION_FIELDS)
        if change is None:
            self._section_index.rebuild(texts, version)
        else:
            touched = graph.shared(change.gone.unionByName(change.put).select("section_id").distinct())
            self._section_index.sync(touched, texts.join(touched, "section_id", "left_semi"), version)
        return self._section_index

    def rebuild_search_index(self) -> None:
        """Makes both text indexes anew."""
        self._nodes_indexed(rebuild=True)
        self._sections_indexed(rebuild=True)

    def graph_search(self, query: str, kinds: list[str] | None = None, limit: int = search.RESULTS) -> list[dict]:
        if not query.strip():
            return []
        index = self._nodes_indexed().read(search.terms_of(self.spark, query))
        return _rows(search.graph_search(self.graph().nodes, index, query, tuple(kinds) if kinds else None, limit))

    def reasoning_search(self, query: str, doc_node_ids: list[str] | None = None, max_results: int = search.RESULTS) -> list[dict]:
        if not query.strip():
            return []
        rerank = (lambda q, rows: self.provider.rerank(q, [(r["summary"] or r["text"] or "")[:150] for r in rows])) if self.provider is not None else None
        index = self._sections_indexed()
        found = search.section_search(
            self.sections(), query, doc_node_ids, max_results, reranker=rerank, index=index.read(search.terms_of(self.spark, query)), length=index.lengths()
        )
        return _rows(found)

    def graph_stats(self) -> dict:
        g = self.graph()
        return _rows(graph.stats(g))[0] | {"kinds": {r["kind"]: r["n"] for r in graph.kind_counts(g.nodes).orderBy("kind").collect()}}

    def graph_diff(self, before: str, after: str | None = None) -> dict:
        """Of two snapshot folders, or of one and the graph as it is."""
        a, b = snapshot.load(self.spark, before), snapshot.load(self.spark, after) if after else self.graph()
        return {"nodes": _rows(diff.diff_nodes(a, b).orderBy("key")), "edges": _rows(diff.diff_edges(a, b).orderBy("key")), "warnings": _rows(diff.warnings(a, b))}

    # Others.

    def list_documents(self) -> list[dict]:
        return _rows(graph.document_summaries(self.graph()).orderBy(F.desc("indexed_at"), "id"))

    def export(self, folder: str) -> None:
        snapshot.export(self.graph(), folder, self.now(), self.name())

    def import_snapshot(self, folder: str) -> dict:
        """Replays a snapshot through the mutation log onto the graph; what breaks a rule is reported and left out."""
        base = self.version()
        g, fresh = self.graph(base), snapshot.load(self.spark, folder)
        log = graph.shared(snapshot.import_log(fresh, 1))
        accepted, errors = mutations.validate(log, g)
        bad = _rows(errors.orderBy("batch", "seq").limit(ERRORS))
        accepted = graph.shared(accepted)
        self._replay(base, g, accepted, mutations.upsert_cache(g.document_cache, fresh.document_cache), "imported", ("document_cache",))
        return {"accepted": accepted.count(), "errors": bad}

    def list_page(self, text: str = "", page: int = 0, size: int = 50) -> list[dict]:
        """A page of the documents whose name or path has a text; the last page, if there are fewer."""
        return _rows(graph.documents_page(graph.document_summaries(self.graph()), text, page, size))

    # Summaries. The default one and one for each set of documents that was asked for are rows of the workspace's log, their categories' members too.

    def _scope(self, g: Graph, document_ids: list[str] | None) -> tuple[str, Graph]:
        """The name of a scope, and the graph in it: all of it, or the concepts that these documents mention and the edges between those."""
        if not document_ids:
            return DEFAULT, g
        ids = self.spark.createDataFrame([(d,) for d in sorted(set(document_ids))], "id string")
        nodes, edges = graph.scoped_subgraph(g, ids)
        cache = g.document_cache.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select(*g.document_cache.columns)
        shown = edges.where("kind <> 'MentionedIn'").select(*g.edges.columns)
        return lens.scope_key(document_ids), Graph(**{**g.frames(), "nodes": nodes.select(*g.nodes.columns), "edges": shown, "document_cache": cache})

    def scope_signature(self, g: Graph) -> str:
        """What a summary of a graph depends on: its documents' contents, names and kinds, edges, and whether there is a provider."""
        rows = (g.document_cache.select("path", "sha256", "node_id"), g.nodes.select("id", "kind", "name"), g.edges.select("id", "from_id", "to_id", "kind"))
        return f"{graph.signature(*rows).first()['signature']}:{int(hasattr(self.provider, 'categories'))}"

    def suggest_summary(self, document_ids: list[str] | None = None, mode: str = "auto") -> dict:
        """The summary of all documents or of some: scope, config, source (config, cache, llm, rules or empty). Modes for some documents: auto takes the
        one that is kept if what it was made of is unchanged, cached_only the one that is kept, and raises if there is none, regenerate makes it anew.
        The default summary is kept until it is restored."""
        if mode not in ("auto", "cached_only", "regenerate"):
            raise ValueError(f"no mode {mode}")
        base = self.version()
        scope, g = self._scope(self.graph(base), document_ids)
        known = self.log.read("summaries", base).where(F.col("scope") == scope).first()
        if known and (scope == DEFAULT or mode == "cached_only"):
            return {"scope": scope, "config": json.loads(known["config"]), "source": "config" if scope == DEFAULT else "cache"}
        if mode == "cached_only":
            raise NotFound(f"no summary of these documents is kept: {scope}")
        signature = self.scope_signature(g)
        if known and mode == "auto" and known["signature"] == signature:
            return {"scope": scope, "config": json.loads(known["config"]), "source": "cache"}
        if g.nodes.where("kind <> 'Document'").isEmpty():
            rows, source = self.spark.createDataFrame([], "label string, node_id string, is_headline boolean, size long"), "empty"
        elif hasattr(self.provider, "categories"):
            said = graph.shared(categories.suggested(g.nodes, providers.Patient(self.provider)))
            rows, source = categories.repair(said, g.nodes, g.edges), "llm"
        else:
            rows, source = categories.members_by_kind(g.nodes, g.edges), "rules"
        rows = graph.shared(rows.select("label", "node_id", "is_headline", F.col("size").cast("long").alias("size")))
        kinds = rows.join(g.nodes.select(F.col("id").alias("node_id"), "kind"), "node_id")
        found = kinds.groupBy("label").agg(F.max("size").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.max(F.when(F.col("is_headline"), F.col("node_id"))).alias("headline"))
        # at most ten categories, of at most as many kinds as there are
        heads = [{"label": r["label"], "members": r["kinds"], "headline": r["headline"]} for r in found.orderBy(F.desc("n"), "label").collect()]
        config = lens.from_categories(heads, {k: k for h in heads for k in h["members"]})
        lens.validate(config)
        now = self.now()
        row = (scope, signature, json.dumps(config, sort_keys=True), source, known["created_at"] if known else now, now)
        put = self.spark.createDataFrame([row], WORKSPACE["summaries"].schema)
        old = self.log.read("categories", base).where(F.col("scope") == scope)
        changes = {"summaries": self._put_summary(base, scope, put), "categories": mutations.difference(old, rows.select(F.lit(scope).alias("scope"), *rows.columns))}
        self._commit(base, changes, "summarized", scope, reads=("summaries", "categories"))
        return {"scope": scope, "config": config, "source": source}

    def _put_summary(self, base: int, scope: str, put: DataFrame) -> Change:
        return mutations.difference(self.log.read("summaries", base).where(F.col("scope") == scope), put)

    def summary_members(self, scope: str) -> DataFrame:
        """(label, node_id, is_headline, size) of the categories of a summary."""
        return self.log.read("categories").where(F.col("scope") == scope).drop("scope")

    def default_summary(self) -> dict:
        """The default configuration, made if there is none, and its lenses' contexts."""
        config = self.suggest_summary()["config"]
        return {"config": config, "contexts": lens.contexts(config)}

    def edit_summary(self, **changes) -> dict:
        """Changes the default configuration as `lens.edit` does."""
        self.suggest_summary()
        base = self.version()
        row = self.log.read("summaries", base).where(F.col("scope") == DEFAULT).first()
        config = lens.edit(json.loads(row["config"]), **changes)
        put = self.spark.createDataFrame([(DEFAULT, row["signature"], json.dumps(config, sort_keys=True), row["source"], row["created_at"], self.now())], WORKSPACE["summaries"].schema)
        self._commit(base, {"summaries": self._put_summary(base, DEFAULT, put)}, "summary edited", DEFAULT, reads=("summaries",))
        return {"config": config, "contexts": lens.contexts(config)}

    def restore_summary(self) -> dict:
        """Makes the default configuration anew from the graph."""
        base = self.version()
        gone = {name: Change(gone=self.log.read(name, base).where(F.col("scope") == DEFAULT)) for name in ("summaries", "categories")}
        self._commit(base, gone, "summary dropped", DEFAULT, reads=("summaries", "categories"))
        return self.default_summary()

    def resolve_summary(self, config: dict | None = None, document_ids: list[str] | None = None) -> list[dict]:
        """The lenses of a configuration, or of the default one; of some documents, the number of each category's members, which is always good."""
        if config is None and document_ids:
            scope = self.suggest_summary(document_ids)["scope"]
            rows = self.summary_members(scope).groupBy("label").agg(F.count("*").cast("double").alias("value"))
            lens_id = F.regexp_replace(ascii_lower(F.col("label")), " ", "_").alias("lens_id")
            gaps = F.array(F.lit("aggregate_not_evidence_backed")).alias("gaps")
            return _rows(rows.select(lens_id, "label", F.lit("count").alias("measure_type"), F.lit("resolved").alias("state"), "value", F.lit("count").alias("unit"), gaps, F.lit("good").alias("health")).orderBy("lens_id"))
        return _rows(lens.resolve(self.graph(), config or self.suggest_summary()["config"], self.now()).orderBy("lens_id"))

    def resolve_lenses(self, config: dict, only: list[str], document_ids: list[str] | None = None) -> list[dict]:
        """Some lenses alone, child lenses too, over the whole graph or what these documents mention."""
        g = self.graph()
        if document_ids is not None:
            nodes, edges = graph.scoped_subgraph(g, self.spark.createDataFrame([(d,) for d in document_ids], "id string"))
            g = Graph(**{**g.frames(), "nodes": nodes, "edges": edges})
        return _rows(lens.resolve(g, config, self.now(), only).orderBy("lens_id"))

    def lens_evidence(self, config: dict, only: list[str] | None = None) -> DataFrame:
        """The evidence behind the lenses, a row each."""
        return lens.evidence(self.graph(), config, self.now(), only)


def _rows(frame: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in frame.collect()]


_TEXT, _TEXTS, _INT = {"type": "string"}, {"type": "array", "items": {"type": "string"}}, {"type": "integer"}
#: The tools: inputs, and those that must be given.
TOOLS = {
    "focus_kpi": ({"kpi_id": _TEXT}, ["kpi_id"]),
    "explain_kpi": ({"kpi_id": _TEXT, "depth": _INT}, ["kpi_id"]),
    "get_evidence": ({"node_id": _TEXT, "edge_id": _TEXT}, []),
    "impact_radius": ({"node_id": _TEXT, "max_depth": _INT}, ["node_id"]),
    "trace_decision": ({"decision_node_id": _TEXT}, ["decision_node_id"]),
    "suggest_actions": ({"kpi_id": _TEXT, "status_filter": _TEXTS, "include_unreviewed": {"type": "boolean"}}, ["kpi_id"]),
    "graph_search": ({"query": _TEXT, "kinds": _TEXTS, "limit": _INT}, ["query"]),
    "reasoning_search": ({"query": _TEXT, "doc_node_ids": _TEXTS, "max_results": _INT}, ["query"]),
    "graph_stats": ({}, []),
    "graph_diff": ({"before": _TEXT, "after": _TEXT}, ["before", "after"]),
}
PROTOCOLS = ("2025-06-18", "2024-11-05")


class ToolServer:
    """JSON-RPC 2.0, one message a line: initialize, tools/list, tools/call, ping. A tool that fails gives a result that says so."""

    def __init__(self, engine: Engine):
        self.engine, self.ready = engine, False

    def handle(self, line: str) -> dict | None:
        try:
            message = json.loads(line)
        except ValueError:
            return self._error(None, -32700, "parse error")
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
            return self._error(message.get("id") if isinstance(message, dict) else None, -32600, "invalid request")
        method, params, ident = message["method"], message.get("params") or {}, message.get("id")
        if "id" not in message:
            return None
        if method == "initialize":
            self.ready = True
            wanted = params.get("protocolVersion")
            return self._result(ident, {"protocolVersion": wanted if wanted in PROTOCOLS else PROTOCOLS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "evigraph", "version": "0.1.0"}})
        if method == "ping":
            return self._result(ident, {})
        if not self.ready:
            return self._error(ident, -32600, "not initialized")
        if method == "tools/list":
            return self._result(ident, {"tools": [{"name": n, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (p, r) in TOOLS.items()]})
        if method != "tools/call":
            return self._error(ident, -32601, f"no method {method}")
        name, args = params.get("name"), params.get("arguments") or {}
        if name not in TOOLS or not isinstance(args, dict):
            return self._error(ident, -32602, f"no tool {name}")
        known, needed = TOOLS[name]
        if missing := [x for x in needed if x not in args]:
            return self._error(ident, -32602, f"missing {missing[0]}")
        try:
            out, failed = getattr(self.engine, name)(**{k: v for k, v in args.items() if k in known}), False
        except Exception as e:
            out, failed = f"{type(e).__name__}: {e}", True
        return self._result(ident, {"content": [{"type": "text", "text": out if failed else json.dumps(out)}], "isError": failed})

    def serve(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip() and (reply := self.handle(line)) is not None:
                out.write(json.dumps(reply) + "\n")
                out.flush()

    @staticmethod
    def _result(ident, result: dict) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "result": result}

    @staticmethod
    def _error(ident, code: int, text: str) -> dict:
        return {"jsonrpc": "2.0", "id": ident, "error": {"code": code, "message": text}}
