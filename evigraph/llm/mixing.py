"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Weights of the sources in the order of their names, null last; they repeat.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes; and what a target may be of its source's size.
TOTAL, MOST = 1.5, 2.0


def size_of(text: Column) -> Column:
    """Words between white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(C.SPACE_WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash of the id: the same in each run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from sizes(source, size): shares of `total` times all sizes by weight, none above `most` times its source's size.

    Resharing what is above until none is ends at target = min(cap, weight * level) with one level for all. In the order of cap / weight, a source is
    capped if the level that the sources from it on would get is above its ratio; the first that is not sets the level. One row for each source meets
    in the running sums, after a partial sum in each task."""
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    per = per.select("source", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.lit(total) * F.sum("source_size").over(whole) - before) / rest
    per = per.withColumn("level", level).withColumn("capped", F.col("level") > F.col("cap") / F.col("weight"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    return per.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level)).alias("target"))


def copies(doc_id: Column, source_size: Column, target: Column, seed: str) -> Column:
    """floor(rate) copies and one more with the probability of rate's fraction; none of a source without words."""
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + (draw(doc_id, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs(doc_id, text, source).

    Null and empty texts have size 0; a null source is a source; rows with equal ids draw the same number. An empty table gives no rows. Only these
    three columns are read. Sizes are computed once; the join with the sources is by broadcast while they are few."""
    sizes = C.materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")))
    plan = C.materialize(targets(sizes, weights, total, most)).withColumnRenamed("source", "s")
    out = sizes.join(C.sized(plan), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("doc_id"), F.col("source_size"), F.col("target"), seed)).alias("taken"))


def emit(docs: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST, seed: str = "mix") -> DataFrame:
    """The rows that the mix takes, with all columns of docs, repeated as often as it takes them."""
    plan = C.materialize(targets(docs.select("source", size_of(F.col("text")).alias("size")), weights, total, most)).select(F.col("source").alias("s"), F.col("source_size").alias("n"), F.col("target").alias("t"))
    rows = docs.select(F.struct("*").alias("row")).join(C.sized(plan), F.col("row.source").eqNullSafe(F.col("s")))
    rows = rows.select("row", copies(F.col("row.doc_id"), F.col("n"), F.col("t"), seed).cast("int").alias("k"))
    return rows.where("k > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("copy")).select("row.*")
