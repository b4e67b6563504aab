"""Differences of two snapshots by logical keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.confidence import quantized
from ..functions.jsonx import canonical
from ..schema import Graph
from .graph import shared, sized

NODE_FIELDS = ("kind", "name", "confidence", "is_tainted", "requires_human_review", "attrs")
EDGE_FIELDS = ("confidence", "is_tainted", "requires_human_review", "created_by", "evidence")


def _collisions(rows: DataFrame) -> DataFrame:
    """Warnings of the rows of each key that others came before by id."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy("id")))
    return ranked.where("rank > 1").select("key", "id", F.lit("collision").alias("warning"))


def _key() -> Column:
    """A node's logical key."""
    return F.concat("kind", F.lit(":"), T.slugify(F.col("name")))


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by kind and slug of their name, with what is compared as text."""
    text = lambda c: F.col(c).cast("string").alias(c)
    return nodes.select(_key().alias("key"), "id", "kind", "name", quantized(F.col("confidence")).cast("string").alias("confidence"), text("is_tainted"), text("requires_human_review"), canonical(F.col("attrs")).alias("attrs"))


def keyed_edges(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Edges by the keys of their ends and their kind; and warnings of edges with a missing end."""
    keys = g.nodes.select("id", _key().alias("k"))
    n = g.edge_evidence.groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n"))
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = g.edges.join(keys.toDF("from_id", "a"), "from_id", "left").join(keys.toDF("to_id", "b"), "to_id", "left").join(n, "id", "left")
    missing = F.col("a").isNull() | F.col("b").isNull()
    found = rows.where(~missing).select(F.concat("a", F.lit("->"), "b", F.lit(":"), "kind").alias("key"), "id", quantized(F.col("confidence")).cast("string").alias("confidence"), text("is_tainted"), text("requires_human_review"), "created_by", F.coalesce("n", F.lit(0)).cast("string").alias("evidence"))
    return found, rows.where(missing).select(F.lit(None).cast("string").alias("key"), "id", F.lit("missing end").alias("warning"))


def _met(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, a, b: the rows (as structs, null if there is none) that each id has before and after; both sides are exchanged once, by id. Of several rows
    with one id any may meet any, which `_firsts` does not mind."""
    side = lambda rows, name: rows.select("id", F.struct(*[c for c in rows.columns if c != "id"]).alias(name))
    return side(before, "a").join(side(after, "b"), "id", "full_outer")


def _first_rows(rows: DataFrame) -> DataFrame:
    """key, a, b of rows(id, ka, a, kb, b): of the rows that have a key on one side the first one by id counts. A row whose keys are the same on both
    sides is exchanged once for both."""
    one = lambda key, a, b: F.struct(key.alias("key"), a.alias("a"), b.alias("b"))
    a, b, none_a, none_b = F.col("a"), F.col("b"), F.lit(None), F.lit(None)
    parts = F.when(F.col("ka") == F.col("kb"), F.array(one(F.col("ka"), a, b))).otherwise(F.array(one(F.col("ka"), a, none_b), one(F.col("kb"), none_a, b)))
    rows = rows.select("id", F.explode(parts).alias("x")).select("id", "x.*").where("key IS NOT NULL")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(c)
    return rows.groupBy("key").agg(first("a"), first("b"))


def _told(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """key, change (added, removed, modified), fields that changed, joined by commas, of rows(key, a, b)."""
    differs = lambda f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    # the members of attributes are looked at only where their texts differ
    members = differs("attrs") & ~canonical(F.col("a.attrs")).eqNullSafe(canonical(F.col("b.attrs"))) if "attrs" in fields else None
    changed = F.array_compact(F.array(*[F.when(members if f == "attrs" else differs(f), F.lit(f)) for f in fields]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.size(changed) > 0, "modified")
    told = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.array_join(changed, ",")).otherwise("")
    return rows.select("key", change.alias("change"), told.alias("fields")).where("change IS NOT NULL")


def _firsts(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """key, change, fields of rows(id, ka, a, kb, b), as `_first_rows` and `_told` have it."""
    return _told(_first_rows(rows), fields)


def diff_nodes(before: Graph, after: Graph) -> DataFrame:
    """key, change, fields of nodes, by kind and slug of their name."""
    side = lambda g: g.nodes.select("id", _key().alias("key"), "kind", "name", quantized(F.col("confidence")).alias("confidence"), "is_tainted", "requires_human_review", "attrs")
    rows = _met(side(before), side(after))
    return _firsts(rows.select("id", F.col("a.key").alias("ka"), "a", F.col("b.key").alias("kb"), "b"), NODE_FIELDS)


def _known(before: Graph, after: Graph) -> DataFrame:
    """id, a, b: the keys of each node before and after."""
    keys = lambda g: g.nodes.select("id", _key().alias("k"))
    return _met(keys(before), keys(after)).select("id", F.col("a.k").alias("a"), F.col("b.k").alias("b"))


def diff_edges(before: Graph, after: Graph) -> DataFrame:
    """key, change, fields of edges, by the keys of their ends and their kind. The two graphs meet by the edges' ids first and look up their ends'
    keys of before and after together; an edge whose ends differ is looked up for each. Edges and evidence that both graphs share need not meet."""
    if before.edges is after.edges and before.edge_evidence is after.edge_evidence:
        return _diff_shared_edges(before, after)

    def side(g: Graph) -> DataFrame:
        n = g.edge_evidence.groupBy(F.col("edge_id").alias("id")).agg(F.count("*").alias("n"))
        return g.edges.join(n, "id", "left").select("id", "from_id", "to_id", "kind", quantized(F.col("confidence")).alias("confidence"), "is_tainted", "requires_human_review", "created_by", F.coalesce("n", F.lit(0)).alias("evidence"))

    known = _known(before, after)
    rows = _met(side(before), side(after))
    same = (F.col("a.from_id") == F.col("b.from_id")) & (F.col("a.to_id") == F.col("b.to_id"))
    a, b, no = F.col("a"), F.col("b"), F.lit(None)
    one = lambda ends, a, b: F.struct(ends["from_id"].alias("from_id"), ends["to_id"].alias("to_id"), a.alias("a"), b.alias("b"))
    parts = F.when(same, F.array(one(a, a, b))).when(b.isNull(), F.array(one(a, a, no))).when(a.isNull(), F.array(one(b, no, b))).otherwise(F.array(one(a, a, no), one(b, no, b)))
    rows = rows.select("id", F.explode(parts).alias("x")).select("id", "x.from_id", "x.to_id", *[F.when(F.col(f"x.{s}").isNotNull(), F.struct(*[F.col(f"x.{s}.{f}").alias(f) for f in ("kind", *EDGE_FIELDS)])).alias(s) for s in "ab"])
    rows = rows.join(known.toDF("from_id", "fa", "fb"), "from_id").join(known.toDF("to_id", "ta", "tb"), "to_id")
    key = lambda s: F.when(F.col(s).isNotNull(), F.concat(f"f{s}", F.lit("->"), f"t{s}", F.lit(":"), f"{s}.kind"))
    return _firsts(rows.select("id", key("a").alias("ka"), "a", key("b").alias("kb"), "b"), EDGE_FIELDS)


def _diff_shared_edges(before: Graph, after: Graph) -> DataFrame:
    """The differences of edges where only nodes changed. An edge is the same on both sides, with as much evidence: a key differs only if other edges
    come first in it, and evidence is counted for these alone, before its rows are exchanged if they are few."""
    known = _known(before, after)
    said = F.struct("id", quantized(F.col("confidence")).alias("confidence"), "is_tainted", "requires_human_review", "created_by")
    rows = before.edges.select("id", "from_id", "to_id", "kind", said.alias("e"))
    rows = rows.join(known.toDF("from_id", "fa", "fb"), "from_id").join(known.toDF("to_id", "ta", "tb"), "to_id")
    key = lambda s: F.concat(f"f{s}", F.lit("->"), f"t{s}", F.lit(":"), "kind").alias(f"k{s}")
    seen = lambda s: F.when(F.col(f"k{s}").isNotNull(), F.col("e")).alias(s)
    rows = rows.select("id", "e", key("a"), key("b")).select("id", "ka", seen("a"), "kb", seen("b"))
    moved = shared(_first_rows(rows).where("NOT (a.id <=> b.id)"))
    both = moved.where("a IS NOT NULL AND b IS NOT NULL")
    asked = sized(shared(both.select(F.explode(F.array("a.id", "b.id")).alias("edge_id")).distinct()))
    n = shared(before.edge_evidence.join(asked, "edge_id", "left_semi").groupBy("edge_id").agg(F.count("*").alias("n")))
    counted = moved
    for s in "ab":
        counted = counted.withColumn("edge_id", F.col(f"{s}.id")).join(sized(n), "edge_id", "left").withColumn(s, F.when(F.col(s).isNotNull(), F.struct(f"{s}.*", F.coalesce("n", F.lit(0)).alias("evidence")))).drop("edge_id", "n")
    return _told(counted, EDGE_FIELDS)


def warnings(before: Graph, after: Graph) -> DataFrame:
    """side, what, key, id, warning: keys that several rows have, and edges whose ends are missing."""
    out = None
    for side, g in (("before", before), ("after", after)):
        edges, missing = keyed_edges(g)
        for what, rows in (("node", _collisions(keyed_nodes(g.nodes))), ("edge", _collisions(edges)), ("edge", missing)):
            part = rows.select(F.lit(side).alias("side"), F.lit(what).alias("what"), "key", "id", "warning")
            out = part if out is None else out.unionByName(part)
    return out


def diff_counts(before: Graph, after: Graph) -> DataFrame:
    """what, change, n."""
    rows = diff_nodes(before, after).select(F.lit("node").alias("what"), "change").unionByName(diff_edges(before, after).select(F.lit("edge").alias("what"), "change"))
    return rows.groupBy("what", "change").agg(F.count("*").alias("n"))
