"""Files, folders and blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .parse import EXTENSIONS

MAX_BYTES = 50 * 1024 * 1024
#: Folders that hold no documents.
SKIPPED_FOLDERS = ("node_modules", "target", "dist", "build")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """The extension as it is written; empty if there is none."""
    return F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)


def hidden(path: Column) -> Column:
    return path.rlike(r"/\.[^/]+") | F.startswith(base_name(path), F.lit("."))


def list_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length, content of the files of a folder, without hidden ones. Whether the folder itself lies in a hidden one does not matter."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")
    plain = root.replace("file:///", "file:/")
    below = F.col("path")
    for start in {root, plain}:
        below = F.when(F.startswith(F.col("path"), F.lit(f"{start}/")), F.substr(F.col("path"), F.lit(len(start) + 1))).otherwise(below)
    return files.where(~hidden(below)).select("path", "length", "content")


def gated(files: DataFrame, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files that are not too large, and (path, error) of those that are; 0 lets all pass."""
    if most <= 0:
        return files, files.limit(0).select("path", F.lit("").alias("error"))
    large = F.col("length") > most
    return files.where(~large), files.where(large).select("path", F.concat(F.lit("file is larger than "), F.lit(most), F.lit(" bytes: "), F.col("length")).alias("error"))


def listing(files: DataFrame) -> DataFrame:
    """path, supported, reason of files(path), in order."""
    known = [e for k in EXTENSIONS.values() for e in k]
    ext = extension(F.col("path"))
    reason = F.when(ext == "", "no extension").when(~ext.isin(*known), F.concat(F.lit("unsupported: ."), ext))
    skipped = F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))
    return files.where(~skipped & ~hidden(F.col("path"))).select("path", reason.isNull().alias("supported"), reason.alias("reason")).orderBy("path")


def new_blobs(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(sha256, content) of contents that blobs(sha256) does not have yet, each once."""
    rows = files.select(F.sha2("content", 256).alias("sha256"), "content").dropDuplicates(["sha256"])
    return rows.join(blobs.select("sha256"), "sha256", "left_anti")


def unreferenced_blobs(blobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Blobs that no cache row names."""
    return blobs.join(cache.select("sha256"), "sha256", "left_anti")


def blob_references(cache: DataFrame) -> DataFrame:
    return cache.groupBy("sha256").agg(F.count("*").alias("n"))
