"""Categories of concepts: a plain grouping by kind, and the repair of suggested ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph as G

MOST = 10
OTHER_SHARE = 12
#: Concepts that a provider is shown at once.
BATCH = 200
#: How much a kind counts as a headline.
HEADLINE_RANK = {"Kpi": 5, "Metric": 4, "Objective": 3, "Initiative": 2, "Decision": 1}


def by_kind(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """label, n, headline_id: concepts by kind, the largest groups first; the headline has the most edges, of equals the last id."""
    rows = nodes.where("kind <> 'Document'").select("id", "kind").join(G.degrees(edges).withColumnRenamed("node_id", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    groups = rows.groupBy(F.col("kind").alias("label")).agg(F.count("*").alias("n"), F.max(F.struct("degree", "id")).alias("h"))
    order = Window.orderBy(F.desc("n"), "label")
    return groups.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("label", "n", F.col("h.id").alias("headline_id"), "rank")


def members_by_kind(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """label, node_id, is_headline, size: the members of the largest kinds."""
    groups = by_kind(nodes, edges, most)
    rows = nodes.select(F.col("id").alias("node_id"), F.col("kind").alias("label")).join(F.broadcast(groups), "label")
    return rows.select("label", "node_id", (F.col("node_id") == F.col("headline_id")).alias("is_headline"), F.col("n").alias("size"))


def suggested(nodes: DataFrame, provider, batch: int = BATCH) -> DataFrame:
    """(idx, label, node_id, pos, headline) of what a provider makes of the concepts, some `batch` at a time by a hash of their ids, in any number of
    tasks: provider.categories(names, kinds) gives a list of label, members and headline, by numbers from 0. Numbers that are none of these, labels
    without words and members that are no list go. Categories of several batches are one where their labels read the same (`repair`)."""
    concepts = nodes.where("kind <> 'Document'").select("id", "name", "kind")
    groups = max(1, -(-concepts.count() // batch))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").reset_index(drop=True)
        ids, out = list(rows["id"]), []
        for k, c in enumerate(provider.categories(list(rows["name"]), list(rows["kind"]))):
            label, members = str(c.get("label") or "").strip(), c.get("members")
            known = [m for m in members if isinstance(m, int) and 0 <= m < len(ids)] if isinstance(members, list) else []
            if label:
                out += [(k * groups + int(rows["part"][0]), label, ids[m], pos, m == c.get("headline")) for pos, m in enumerate(known)]
        return pd.DataFrame(out, columns=["idx", "label", "node_id", "pos", "headline"])

    parts = concepts.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    return parts.groupBy("part").applyInPandas(run, "idx int, label string, node_id string, pos int, headline boolean")


def repair(suggested: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = MOST) -> DataFrame:
    """label, node_id, is_headline from suggested(idx, label, node_id, pos, headline).

    Unknown ids go; a node stays in the first category that lists it; labels that read the same are merged; what no category has goes to Other, or to
    the last of ten. A small Other (two nodes, or under 12 % of all) is dealt out to the categories where its nodes have most neighbours. A headline is
    the node of the highest kind, then degree; the suggested one wins ties. The largest categories come first."""
    known = nodes.where("kind <> 'Document'").select(F.col("id").alias("node_id"), "kind")
    rows = suggested.join(known, "node_id").withColumn("label", T.category_label(F.col("label")))
    rows = rows.withColumn("label", F.when(T.is_other_label(F.col("label")), F.lit("Other")).otherwise(F.col("label"))).withColumn("key", T.label_key(F.col("label")))
    first = Window.partitionBy("node_id").orderBy("idx", "pos")
    rows = rows.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
    merged = rows.groupBy("key").agg(F.min_by("label", "idx").alias("label"), F.min("idx").alias("idx"))
    rank = Window.orderBy("idx", "key")
    merged = G.shared(merged.withColumn("at", F.row_number().over(rank)).where(F.col("at") <= most))
    rows = rows.select("key", "node_id", "kind", "headline").join(merged.select("key", "at"), "key")
    full = merged.count() >= most and merged.where("key = 'other'").isEmpty()
    last = merged.orderBy(F.desc("at")).select("key", "at").first()
    rest = known.join(rows.select("node_id"), "node_id", "left_anti").select(F.lit(last["key"] if full and last else "other").alias("key"), "node_id", "kind", F.lit(False).alias("headline"))
    rows = G.shared(rows.select("key", "node_id", "kind", "headline").unionByName(rest))
    total, other = rows.count(), rows.where("key = 'other'").count()
    if other and (other <= 2 or other * 100 // total < OTHER_SHARE):
        pairs = G.undirected(edges).where("node <> other").select(F.col("node").alias("node_id"), F.col("other").alias("o")).distinct()
        score = rows.where("key = 'other'").select("node_id").join(pairs, "node_id").join(rows.where("key <> 'other'").select(F.col("node_id").alias("o"), F.col("key").alias("to")), "o").groupBy("node_id", "to").agg(F.count("*").alias("n")).join(merged.select(F.col("key").alias("to"), "at"), "to")
        best = score.groupBy("node_id").agg(F.min_by("to", F.struct((-F.col("n")).alias("n"), F.col("at"))).alias("to"))
        rows = rows.join(best, "node_id", "left").select(F.when(F.col("key") == "other", F.coalesce("to", "key")).otherwise(F.col("key")).alias("key"), "node_id", "kind", "headline")
    value = F.lit(0)
    for kind, n in HEADLINE_RANK.items():
        value = F.when(F.col("kind") == kind, n).otherwise(value)
    rows = rows.join(G.degrees(edges), "node_id", "left").withColumn("score", F.struct(value.alias("r"), F.coalesce("degree", F.lit(0)).alias("d"), F.col("headline").cast("int").alias("h"), F.col("node_id")))
    top = Window.partitionBy("key").orderBy(F.desc("score"))
    size = Window.partitionBy("key")
    rows = rows.withColumn("is_headline", F.row_number().over(top) == 1).withColumn("size", F.count("*").over(size))
    labels = merged.select("key", "label", "at")
    return rows.join(labels, "key", "left").select(F.coalesce("label", F.lit("Other")).alias("label"), "node_id", "is_headline", "size").orderBy(F.desc("size"), "label", F.desc("is_headline"), "node_id")
