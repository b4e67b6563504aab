"""Metric values over time, and the jobs on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import confidence as conf
from ..functions.text import ascii_lower
from ..schema import Graph
from . import graph as G

#: Fixed value: smallest difference of two doubles that counts.
EPSILON = 2.220446049250313e-16


def business_time() -> Column:
    return F.coalesce("as_of", "observed_at")


def latest(values: DataFrame, n: int = 1) -> DataFrame:
    """The newest n values of each KPI by business time, then by arrival, then by id, with their rank."""
    order = Window.partitionBy("kpi_node_id").orderBy(F.desc(business_time()), F.desc("observed_at"), F.desc("id"))
    return values.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def as_of(values: DataFrame, cutoff: int | None) -> DataFrame:
    """The newest value of each KPI whose business time is not after the cutoff (unix seconds); None: no cutoff."""
    return latest(values if cutoff is None else values.where(business_time() <= cutoff))


def in_period(values: DataFrame, period: str, anchor: int) -> DataFrame:
    """Values of the anchor's month (mtd) or year (ytd), up to the anchor; other periods keep all."""
    if period not in ("mtd", "ytd"):
        return values
    at, day = F.timestamp_seconds(business_time()), F.timestamp_seconds(F.lit(anchor))
    same = F.year(at) == F.year(day)
    return values.where((same & (F.month(at) == F.month(day)) if period == "mtd" else same) & (business_time() <= anchor))


def trends(values: DataFrame) -> DataFrame:
    """kpi_id, value, previous, trend (Up, Down, Flat; Unknown without a previous value)."""
    two = latest(values, 2).groupBy("kpi_node_id").agg(F.max(F.when(F.col("rank") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("rank") == 2, F.col("value"))).alias("previous"))
    trend = F.when(F.col("previous").isNull(), "Unknown").when(F.col("value") > F.col("previous"), "Up").when(F.col("value") < F.col("previous"), "Down").otherwise("Flat")
    return two.select(F.col("kpi_node_id").alias("kpi_id"), "value", "previous", trend.alias("trend"))


def conflicts(values: DataFrame) -> DataFrame:
    """kpi_id, at, unit, n, spread: business times at which values of one unit (in any case) differ. The extremes of a group differ if any two do."""
    rows = values.groupBy(F.col("kpi_node_id").alias("kpi_id"), business_time().alias("at"), ascii_lower(F.col("unit")).alias("unit")).agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"))
    return rows.where(F.col("spread") > EPSILON)


def recompute(g: Graph, now: int) -> DataFrame:
    """kpi_id, confidence, trend, value, review, at: each KPI's confidence from the evidence of its incoming edges (its own where there is none), its
    trend and newest value; contradicted KPIs are up for review and stay so."""
    kpis = g.nodes.where("kind = 'Kpi'").select(F.col("id").alias("kpi_id"), F.col("confidence").alias("stored"), F.col("requires_human_review").alias("flagged"))
    rows = kpis.join(G.signed_confidence(g), "kpi_id", "left").join(trends(g.metric_values), "kpi_id", "left")
    review = F.col("flagged") | (F.coalesce("contradiction", F.lit(0.0)) > 0)
    return rows.select("kpi_id", F.round(F.coalesce("confidence", "stored"), 6).alias("confidence"), F.coalesce("trend", F.lit("Unknown")).alias("trend"), "value", review.alias("review"), F.lit(now).cast("long").alias("at"))


def discover(g: Graph, by_edges: bool = False, least_documents: int = 2, least_evidence: int = 3) -> DataFrame:
    """kpi_id, name, score, n_documents, n_evidence of KPIs worth proposing: mentioned by enough documents, with enough evidence, without a candidate of
    that name that was not rejected. by_edges counts the evidence of incoming edges in place of the node's own."""
    if by_edges:
        counts = G.evidence_of_nodes(g).groupBy(F.col("node_id").alias("id")).agg(F.countDistinct("evidence_id").alias("n_evidence"))
    else:
        counts = G.own_evidence_counts(g).withColumnRenamed("node_id", "id")
    rows = g.nodes.where("kind = 'Kpi'").select("id", "name", "confidence").join(counts, "id").join(G.source_document_counts(g).withColumnRenamed("concept_id", "id"), "id")
    rows = rows.where((F.col("n_documents") >= least_documents) & (F.col("n_evidence") >= least_evidence))
    rows = rows.join(g.kpi_candidates.where("status <> 'rejected'").select("name"), "name", "left_anti")
    score = conf.clamp(F.col("confidence") * F.least("n_evidence", F.lit(10)) / 10)
    return rows.select(F.col("id").alias("kpi_id"), "name", F.round(score, 6).alias("score"), "n_documents", "n_evidence")


def source_versions(sources: DataFrame) -> DataFrame:
    """path, sha256, version, first_seen_at of sources(path, sha256, at): contents are numbered in the order in which a path first had them, and one that
    comes back keeps its number."""
    first = sources.groupBy("path", "sha256").agg(F.min("at").alias("first_seen_at"))
    return first.withColumn("version", F.row_number().over(Window.partitionBy("path").orderBy("first_seen_at", "sha256")))


def generation_counts(generations: DataFrame, generation_sources: DataFrame) -> DataFrame:
    """Generations with their number of files, newest first."""
    n = generation_sources.groupBy(F.col("generation_id").alias("id")).agg(F.count("*").alias("files"))
    return generations.join(n, "id", "left").select("id", "name", "created_at", F.coalesce("files", F.lit(0)).alias("files")).orderBy(F.desc("created_at"), "id")


def create_generation(paths: DataFrame, cache: DataFrame, generation_id: str) -> DataFrame:
    """(generation_id, path, sha256) of the paths that the cache knows, each once."""
    return cache.join(paths.select("path"), "path", "left_semi").select(F.lit(generation_id).alias("generation_id"), "path", "sha256").distinct()
