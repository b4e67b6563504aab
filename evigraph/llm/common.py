"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: Words between ASCII white space (fixed value of the query contracts).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of ASCII letters and digits and of any non-ASCII characters (fixed value of the query contracts).
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The white space between SPACE_WORD words.
SPACES = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: A side of a join is broadcast up to this many rows of a few numbers (some 50 MB), and shuffled beyond.
BROADCAST_ROWS = 1_000_000
#: And up to this many bytes in its texts and arrays.
BROADCAST_BYTES = 100_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(text, _UPPER, _UPPER.lower())


def words(text: Column, pattern: str) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def at(array: Column, index: Column | int) -> Column:
    """array[index] from 0, null outside."""
    return F.get(array, F.lit(index) if isinstance(index, int) else index)


def positions(count: Column) -> Column:
    """The array 0 .. count - 1; empty if count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def running(items: str, kind: str, value: Callable[[Column], Column], fold: Callable[[Column, Column], Column], zero: Column, block: int = 256) -> Column:
    """For each x of the array column `items`, of element type `kind`: struct(before, x), where before folds the values of all elements before x.

    fold must be associative with zero at its start, as sums and largest values are. Arrays are built in blocks, and blocks are joined once, so
    that a long array does not cost its square: about `block` copies an element."""
    pair = f"array<struct<before:int,x:{kind}>>"

    def within(a: Column, x: Column) -> Column:
        here = F.array(F.struct(a["at"].alias("before"), x.alias("x")))
        return F.struct(fold(a["at"], value(x)).alias("at"), F.concat(a["out"], here).alias("out"))

    def across(a: Column, b: Column) -> Column:
        here = F.array(F.struct(a["at"].alias("base"), b["out"].alias("out")))
        return F.struct(fold(a["at"], b["at"]).alias("at"), F.concat(a["out"], here).alias("out"))

    start = F.struct(zero.alias("at"), F.array().cast(pair).alias("out"))
    blocks = F.transform(positions(F.ceil(F.size(items) / block)), lambda b: F.aggregate(F.slice(items, b * block + 1, block), start, within))
    first = F.struct(zero.alias("at"), F.array().cast(f"array<struct<base:int,out:{pair}>>").alias("out"))
    whole = F.aggregate(blocks, first, across, lambda a: a["out"])
    shifted = lambda w: F.transform(w["out"], lambda y: F.struct(fold(w["base"], y["before"]).alias("before"), y["x"].alias("x")))
    return F.flatten(F.transform(whole, shifted))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset, a temporary folder becomes it, on a local
    master alone: on a cluster executors would not see it, and this raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if path is None and known.isDefined():
        path = known.get()
    if path is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="evigraph-")
    if known.isEmpty():
        spark.sparkContext.setCheckpointDir(path)
    return path


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame) -> DataFrame:
    """Computes df once into the shared folder and cuts its lineage there; any executor can read it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows and `size` bytes in texts and arrays (32 for each element), else as it is (then its join
    shuffles, and AQE splits skewed sides). df should be materialized: it is counted."""
    parts = [F.octet_length(c) for c, kind in df.dtypes if kind in ("string", "binary")]
    parts += [F.size(c) * 32 for c, kind in df.dtypes if kind.startswith("array")]
    held = reduce(lambda a, b: a + b, [F.coalesce(F.sum(p.cast("long")), F.lit(0)) for p in parts], F.lit(0))
    count, held = df.agg(F.count("*"), held).first()
    return F.broadcast(df) if count <= rows and held <= size else df.hint("merge")


def arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Before Python runs on executors: ships the package, and keeps Arrow batches of whole texts small (at most `rows` rows at once)."""
    ship(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def filesystem(path: str):
    """(pyarrow file system, path in it) of a local path or of a URI with a scheme that pyarrow knows (file, hdfs, s3, gs)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links(a, b); nodes have one root exactly if they are connected.

    Contraction: each node points to the neighbour (or itself) that comes first in an order drawn anew by hashing in each round, links move to what
    their ends point to, and loops go. A constant share of the nodes is expected to vanish in each round. Links and pointers stay distributed; each
    round is cut off by a checkpoint. Null ends are not linked."""
    spark = links.sparkSession
    edges = materialize(links.where("a <> b").select("a", "b").distinct())
    total = None
    seed = 0
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a")).union(edges.select("a", "a")).union(edges.select("b", "b"))
        first = F.min(F.struct(F.xxhash64(F.lit(seed), "to").alias("h"), F.col("to")))
        point = materialize(both.groupBy("node").agg(first.alias("m")).select("node", F.col("m.to").alias("root")))
        a, b = point.toDF("a", "x"), point.toDF("b", "y")
        edges = materialize(edges.join(a, "a").join(b, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if total is None:
            total = point
        else:
            moved = total.join(point.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            total = materialize(moved)
        seed += 1
    if total is None:
        kind = links.schema["a"].dataType
        return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    return total
