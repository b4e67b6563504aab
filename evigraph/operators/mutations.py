"""The write path: an append-only log of mutations and the state that it stands for.

Log rows: batch long, seq long, op, id, payload (JSON). Ops: upsert_node, upsert_evidence, upsert_edge, delete_node, delete_edge, record_value,
propose_candidate, resolve_candidate. State comes from the log by windows over ids; nothing is collected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EDGES, EVIDENCE, KPI_CANDIDATES, METRIC_VALUES, NODES, Graph
from ..sources.commits import Change
from . import graph as G

LOG = "batch long, seq long, op string, id string, payload string"


def log_rows(steps: list[tuple[str, DataFrame]], batch: int) -> DataFrame:
    """(batch, seq, op, id, payload) of the frames of a batch: (op, frame in a table's schema), in order. Rows are numbered after they are put together,
    so that no two have one number, whatever the frames' partitions are."""
    rows = reduce(DataFrame.unionByName, [frame.select(F.lit(op).alias("op"), "id", F.to_json(F.struct("*")).alias("payload")) for op, frame in steps])
    return rows.select(F.lit(batch).cast("long").alias("batch"), F.monotonically_increasing_id().alias("seq"), "op", "id", "payload")


class Rejected(ValueError):
    """A batch that was refused as a whole; errors has the rows that broke a rule, as many as ERRORS of them."""

    def __init__(self, errors: list[dict]):
        super().__init__(f"{errors[0]['error']}: {errors[0]['op']} {errors[0]['id']}")
        self.errors = errors


#: Errors that a refused batch reports.
ERRORS = 100


def whole_batch(batch: DataFrame, before: Graph) -> DataFrame:
    """The batch if none of its rows breaks a rule of `validate`; else it is refused as a whole."""
    accepted, bad = validate(batch, before)
    errors = [r.asDict() for r in bad.orderBy("batch", "seq").limit(ERRORS).collect()]
    if errors:
        raise Rejected(errors)
    return accepted


def _order() -> Column:
    return F.struct("batch", "seq")


def _live(log: DataFrame, upsert: str, delete: str | None) -> DataFrame:
    """The upserts of each id since its last deletion."""
    rows = log.where(F.col("op").isin(*[o for o in (upsert, delete) if o]))
    if delete is None:
        return rows
    last = Window.partitionBy("id")
    gone = F.max(F.when(F.col("op") == delete, _order())).over(last)
    return rows.withColumn("gone", gone).where((F.col("op") == upsert) & (F.col("gone").isNull() | (_order() > F.col("gone")))).drop("gone")


def _state(rows: DataFrame, schema: str, first: tuple[str, ...]) -> DataFrame:
    """The last payload of each id, with some columns from the first one."""
    rows = rows.select("id", _order().alias("o"), F.from_json("payload", schema).alias("p"))
    out = rows.groupBy("id").agg(F.max_by("p", "o").alias("new"), F.min_by("p", "o").alias("old"))
    names = [c.split()[0] for c in schema.split(", ")]
    return out.select(*[F.col(f"{'old' if n in first else 'new'}.{n}").alias(n) for n in names])


def state(log: DataFrame, cache: DataFrame | None = None) -> Graph:
    """The graph that a log stands for.

    A node keeps its first created_at; an edge its first ends, author and time; a deletion ends an id's life, and a later upsert starts a new one. Evidence
    goes with its source, edges with their ends, pairs with either side; an edge left without evidence goes."""
    spark = log.sparkSession
    nodes = _state(_live(log, "upsert_node", "delete_node"), NODES, ("created_at",))
    ids = nodes.select("id")
    evidence = _state(_live(log, "upsert_evidence", None), EVIDENCE, ())
    evidence = evidence.join(ids.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_semi").select(*[c.split()[0] for c in EVIDENCE.split(", ")])
    live = _live(log, "upsert_edge", "delete_edge")
    edges = _state(live, EDGES, ("from_id", "to_id", "created_by", "created_at"))
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_semi")
    pairs = live.select(F.col("id").alias("edge_id"), F.explode(F.from_json(F.get_json_object("payload", "$.evidence_ids"), "array<string>")).alias("evidence_id")).distinct()
    pairs = pairs.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    edges = edges.join(pairs.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi").select(*[c.split()[0] for c in EDGES.split(", ")])
    values = _state(_live(log, "record_value", None), METRIC_VALUES, tuple(c.split()[0] for c in METRIC_VALUES.split(", ")))
    values = values.join(ids.withColumnRenamed("id", "kpi_node_id"), "kpi_node_id", "left_semi").select(*[c.split()[0] for c in METRIC_VALUES.split(", ")])
    return Graph(nodes, edges, evidence, pairs.select("edge_id", "evidence_id"), values, candidates(log), cache if cache is not None else spark.createDataFrame([], "path string, sha256 string, structural_sha256 string, indexed_at long, node_id string"))


def candidates(log: DataFrame) -> DataFrame:
    """KPI candidates with the status of their first resolution: a candidate can be resolved only while it is pending."""
    base = _state(_live(log, "propose_candidate", None), KPI_CANDIDATES, tuple(c.split()[0] for c in KPI_CANDIDATES.split(", "))).drop("status", "merged_into")
    rows = log.where("op = 'resolve_candidate'").select("id", _order().alias("o"), F.from_json("payload", "action string, into string").alias("p"))
    done = rows.groupBy("id").agg(F.min_by("p", "o").alias("p"))
    status = F.when(F.col("p.action") == "approve", "approved").when(F.col("p.action") == "reject", "rejected").when(F.col("p.action") == "merge", "merged").otherwise("pending")
    return base.join(done, "id", "left").select(*base.columns, status.alias("status"), F.col("p.into").alias("merged_into"))


def validate(batch: DataFrame, before: Graph) -> tuple[DataFrame, DataFrame]:
    """(accepted, errors) of a batch of log rows, against the state before it and the batch's own upserts.

    Errors (batch, seq, op, id, error): edges without evidence, with a missing end or with missing evidence, in this order; evidence with a missing
    source; deletions of what is not there; values and candidates with an id that exists; resolutions of what is not pending."""
    mine = lambda op: batch.where(F.col("op") == op).select("id")
    nodes = before.nodes.select("id").unionByName(mine("upsert_node")).distinct().select(F.col("id").alias("k"))
    sources = batch.where("op = 'upsert_evidence'").withColumn("source", F.get_json_object("payload", "$.source_node_id"))
    bad_evidence = sources.join(nodes, F.col("source") == F.col("k"), "left_anti").select("batch", "seq", "op", "id", F.lit("source node is missing").alias("error"))
    evidence = before.evidence.select("id").unionByName(mine("upsert_evidence")).distinct().join(bad_evidence.select("id"), "id", "left_anti").select(F.col("id").alias("v"))
    edges = batch.where("op = 'upsert_edge'").select("batch", "seq", "op", "id", F.get_json_object("payload", "$.from_id").alias("f"), F.get_json_object("payload", "$.to_id").alias("t"), F.coalesce(F.from_json(F.get_json_object("payload", "$.evidence_ids"), "array<string>"), F.array().cast("array<string>")).alias("ev"))
    ends = edges.join(nodes.withColumnRenamed("k", "f").withColumn("fk", F.lit(True)), "f", "left").join(nodes.withColumnRenamed("k", "t").withColumn("tk", F.lit(True)), "t", "left")
    lost = edges.select("batch", "seq", F.explode("ev").alias("v")).join(evidence, "v", "left_anti").select("batch", "seq").distinct().withColumn("lost", F.lit(True))
    why = F.when(F.size("ev") == 0, "an edge needs evidence").when(F.col("fk").isNull() | F.col("tk").isNull(), "an end is missing").when(F.col("lost"), "evidence is missing")
    bad_edges = ends.join(lost, ["batch", "seq"], "left").select("batch", "seq", "op", "id", why.alias("error")).where("error IS NOT NULL")
    bad = bad_evidence.unionByName(bad_edges)
    known_edges = before.edges.select("id").unionByName(mine("upsert_edge")).distinct()
    for op, there in (("delete_node", nodes.withColumnRenamed("k", "id")), ("delete_edge", known_edges)):
        bad = bad.unionByName(batch.where(F.col("op") == op).join(there, "id", "left_anti").select("batch", "seq", "op", "id", F.lit("it does not exist").alias("error")))
    for op, there in (("record_value", before.metric_values), ("propose_candidate", before.kpi_candidates)):
        bad = bad.unionByName(batch.where(F.col("op") == op).join(there.select("id"), "id", "left_semi").select("batch", "seq", "op", "id", F.lit("it exists already").alias("error")))
    pending = before.kpi_candidates.where("status = 'pending'").select("id").unionByName(mine("propose_candidate")).distinct()
    bad = bad.unionByName(batch.where("op = 'resolve_candidate'").join(pending, "id", "left_anti").select("batch", "seq", "op", "id", F.lit("it is not pending").alias("error")))
    return batch.join(bad.select("batch", "seq").distinct(), ["batch", "seq"], "left_anti").select("batch", "seq", "op", "id", "payload"), bad


def summary(log: DataFrame) -> DataFrame:
    """op, n: what a batch tried."""
    return log.groupBy("op").agg(F.count("*").alias("n"))


def removed(g: Graph, ids: DataFrame) -> dict[str, DataFrame]:
    """The rows that `remove_nodes` takes from a graph whose edges all have evidence: the nodes ids(id), their evidence, values and cache rows, the edges
    at them or left without evidence, and pairs of either. Only edges that lose evidence are looked at again."""
    at = lambda column: ids.withColumnRenamed("id", column)
    evidence = G.shared(g.evidence.join(at("source_node_id"), "source_node_id", "left_semi").select(*g.evidence.columns))
    lost = G.shared(g.edge_evidence.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select("edge_id", "evidence_id"))
    touched = lost.select("edge_id").distinct()
    rest = g.edge_evidence.join(touched, "edge_id", "left_semi").join(lost, ["edge_id", "evidence_id"], "left_anti").select("edge_id").distinct()
    bare = touched.join(rest, "edge_id", "left_anti").select(F.col("edge_id").alias("id"))
    gone = [g.edges.join(at(end), end, "left_semi").select("id") for end in ("from_id", "to_id")]
    edges = G.shared(g.edges.join(reduce(DataFrame.unionByName, gone, bare).distinct(), "id", "left_semi").select(*g.edges.columns))
    pairs = g.edge_evidence.join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi").select("edge_id", "evidence_id")
    values = [g.metric_values.join(at(c), c, "left_semi").select(*g.metric_values.columns) for c in ("kpi_node_id", "metric_node_id")]
    return {
        "nodes": g.nodes.join(ids, "id", "left_semi"),
        "edges": edges,
        "evidence": evidence,
        "edge_evidence": pairs.unionByName(lost).distinct(),
        "metric_values": values[0].unionByName(values[1]).distinct(),
        "document_cache": g.document_cache.join(at("node_id"), "node_id", "left_semi").select(*g.document_cache.columns),
    }


def remove_nodes(g: Graph, ids: DataFrame) -> Graph:
    """The graph without the nodes ids(id) and all that goes with them. ids is counted; few are sent to all tasks, so that no table is exchanged for them."""
    ids = G.sized(ids)
    nodes = g.nodes.join(ids, "id", "left_anti")
    evidence = g.evidence.join(ids.withColumnRenamed("id", "source_node_id"), "source_node_id", "left_anti")
    edges = g.edges
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), end, "left_anti")
    pairs = g.edge_evidence.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").join(edges.select(F.col("id").alias("edge_id")), "edge_id", "left_semi")
    edges = edges.join(pairs.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi")
    values = g.metric_values.join(ids.withColumnRenamed("id", "kpi_node_id"), "kpi_node_id", "left_anti").join(ids.withColumnRenamed("id", "metric_node_id"), "metric_node_id", "left_anti")
    cache = g.document_cache.join(ids.withColumnRenamed("id", "node_id"), "node_id", "left_anti")
    return Graph(nodes, edges, evidence, pairs, values, g.kpi_candidates, cache)


def difference(before: DataFrame, after: DataFrame) -> Change:
    """The change that makes the rows of one frame those of another."""
    after = after.select(*before.columns)
    return Change(before.subtract(after), after.subtract(before))


def upserted(before: DataFrame, rows: DataFrame, key: tuple[str, ...], keep: tuple[str, ...] = ()) -> Change:
    """The change that puts rows into a table, in place of those with their key; a row that was there keeps its values of the columns `keep`. Rows that
    are there already as they are change nothing. Only the table's rows with these keys are compared."""
    columns, key = before.columns, list(key)
    rows = rows.select(*columns).dropDuplicates(key)
    old = G.shared(before.join(rows.select(*key), key, "left_semi").select(*columns))
    if old.isEmpty():
        return Change(put=rows, fresh=True)
    if keep:
        first = old.select(*key, F.struct(*keep).alias("_first"))
        rows = rows.join(first, key, "left")
        rows = rows.select(*[F.when(F.col("_first").isNotNull(), F.col("_first")[c]).otherwise(F.col(c)).alias(c) if c in keep else c for c in columns])
    return difference(old, G.shared(rows))


def removal_ids(g: Graph, documents: DataFrame) -> DataFrame:
    """The ids that go when documents(id) are removed: these, and the concepts that they alone mention."""
    mentioned = G.mentioned_concepts(g)
    touched = mentioned.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("concept_id").distinct()
    rest = mentioned.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_anti").select("concept_id").distinct()
    return touched.join(rest, "concept_id", "left_anti").select(F.col("concept_id").alias("id")).unionByName(documents.select("id")).distinct()


def regenerated(g: Graph, documents: DataFrame, facts: dict[str, DataFrame]) -> dict[str, Change]:
    """The changes that remove documents(id) and put in the facts that were extracted from them anew: rows that are the same stay untouched, and cache
    rows stay as they are."""
    gone = removed(g, G.shared(removal_ids(g, documents)))
    out = {}
    for name, key in (("nodes", ["id"]), ("edges", ["id"]), ("evidence", ["id"]), ("edge_evidence", ["edge_id", "evidence_id"]), ("metric_values", ["id"])):
        old, columns = G.shared(gone[name]), getattr(g, name).columns
        fresh = facts[name].select(*columns).dropDuplicates(key)
        # a row that is there and does not go stays as it is
        stays = getattr(g, name).join(fresh.select(*key), key, "left_semi").join(old.select(*key), key, "left_anti").select(*key)
        out[name] = difference(old, G.shared(fresh.join(stays, key, "left_anti").select(*columns)))
    return out


def newest_cache(rows: DataFrame) -> DataFrame:
    """The newest cache row of each path."""
    newest = Window.partitionBy("path").orderBy(F.desc("indexed_at"), F.desc("sha256"))
    return rows.withColumn("k", F.row_number().over(newest)).where("k = 1").drop("k")


def upsert_cache(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """A document cache with new rows in place of those of the same path."""
    rows = newest_cache(rows)
    return cache.join(rows.select("path"), "path", "left_anti").unionByName(rows)


def clear_review_flags(nodes: DataFrame) -> DataFrame:
    """Nodes whose flag an early version set on tainted ones of confidence 0.5 lose it, but for KPIs."""
    stale = F.col("is_tainted") & F.col("requires_human_review") & (F.abs(F.col("confidence") - 0.5) < 1e-6) & (F.col("kind") != "Kpi")
    return nodes.withColumn("requires_human_review", F.col("requires_human_review") & ~stale)


def generation_closure(g: Graph, contents: DataFrame) -> Graph:
    """What rests on contents(sha256): evidence of those blobs, its edges, their ends and the evidence's sources. Values and candidates are left out.

    Each part is computed once, for itself and for those that rest on it; few contents are sent to all tasks."""
    blobs = G.sized(G.shared(contents.select(F.col("sha256").alias("blob_sha256")).distinct()))
    evidence = G.shared(g.evidence.join(blobs, "blob_sha256", "left_semi").select(*g.evidence.columns))
    pairs = G.shared(g.edge_evidence.join(evidence.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi").select("edge_id", "evidence_id"))
    edges = G.shared(g.edges.join(pairs.select(F.col("edge_id").alias("id")).distinct(), "id", "left_semi").select(*g.edges.columns))
    ids = edges.select(F.col("from_id").alias("id")).union(edges.select("to_id")).union(evidence.select("source_node_id")).distinct()
    nodes = g.nodes.join(ids, "id", "left_semi")
    return Graph(nodes, edges, evidence, pairs, g.metric_values.limit(0), g.kpi_candidates.limit(0), g.document_cache)
