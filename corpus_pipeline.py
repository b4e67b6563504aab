"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing, token ids. Each stage takes what the one before kept."""

from __future__ import annotations

import public_tokenizers
from evigraph.llm import common as C
from evigraph.llm import langid, mixing, simhash, tokenbin, winnowing
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document goes if no language is found or if its probability is below this.
LEAST_SCORE = 0.35
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is known with a probability of LEAST_SCORE at least; their lang is set where it was null.

    Null, empty and letterless texts go. Equal texts share their verdict. If nothing can be learned, no language is known and all go; an empty table
    stays empty. All columns are kept, whatever their names."""
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    rows = langid.identify(docs, keep_row=True).where(known)
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    return rows.select(*[F.coalesce(x, "lang_pred").alias(c) if c == "lang" else x for c, x in zip(docs.columns, columns, strict=True)])


def _key(within: str = "") -> Column:
    """A row's key: the SHA-256 of its id and text. Verdicts depend on these alone, so rows with one key share theirs, whatever ids are null or repeated."""
    doc_id, text = F.col(f"{within}doc_id").cast("string"), F.col(f"{within}text")
    return F.unhex(F.sha2(F.concat_ws(" ", F.coalesce(doc_id, F.lit("")), F.coalesce(text, F.lit(""))), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, row_key): whole rows in a struct, so that no column of theirs can clash with one of a stage."""
    return docs.select(F.struct("*").alias("row")).withColumn("row_key", _key("row."))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """docs without the rows of these keys(row_key), by broadcast while they are few."""
    gone = C.materialize(keys.select(F.col("row_key").alias("gone")).distinct())
    return _keyed(docs).join(C.sized(gone), F.col("row_key") == F.col("gone"), "left_anti").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: that of the smallest id, a null id being the last, and of rows with that id the one whose key comes first.
    Components follow op3's contract (3-word shingles, fingerprints within 2 bits), not a similarity of five-word shingles.

    Null and empty texts have no words and are one component. Of rows with one id and one text, which may differ elsewhere, the first one in order of
    the whole row, as JSON, stays, so that a run again keeps the same one. An empty table stays empty."""
    prints = C.materialize(simhash.fingerprints(docs.select("doc_id", "text", _key().alias("row_key")), key="row_key"))
    linked = C.materialize(C.components(simhash.links(C.materialize(prints.select("fp").distinct()))))
    rows = prints.join(C.sized(linked), F.col("node") == F.col("fp"), "left").select("doc_id", "row_key", F.coalesce("root", "fp").alias("part"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")).alias("first")
    several = rows.groupBy("part").agg(first, F.min("row_key").alias("low"), F.max("row_key").alias("high")).where("low <> high")
    several = C.materialize(several.select("part", F.col("first.row_key").alias("stays")))
    kept = _without(docs, rows.join(C.sized(several), "part").where("row_key <> stays"))
    repeated = C.materialize(prints.groupBy("row_key").count().where("count > 1").select("row_key"))
    if repeated.isEmpty():
        return kept
    once = C.sized(repeated.withColumnRenamed("row_key", "again"))
    some = _keyed(kept).join(once, F.col("row_key") == F.col("again"), "left_semi").groupBy("row_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return _without(kept, repeated).unionByName(some.select("row.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a window of the benchmark, whatever their ids: a row goes by its id and text, so that null and repeated ids are told apart.

    Null and empty texts have no window and stay; repeated rows share their verdict; with an empty benchmark all stay."""
    found = winnowing.contaminated(docs.select(_key().alias("doc_id"), "text"), C.table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("row_key")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the documents as often as the mix of the sources says: floor(rate) times, and once more by a hash of the id.

    A null source is a source; null and empty texts have no words, and a source without words is not taken; equal rows draw alike. An empty table
    stays empty."""
    return mixing.emit(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and reads them back: a row for each record, in order of ids, null ids first. A null text has the end id alone; repeated rows
    have a record each; an empty table has none."""
    out = tokenbin.encode_table(docs, C.fresh_dir(spark, "pipeline-ids"), public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

#: Hashing, training and tokenizing have no SQL; the stages are tested one by one against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each is written as Parquet to the shared folder and read again, and what the one before wrote is removed."""
    docs, last = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = C.fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            C.remove(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)  # its files are written: it reads them alone
    C.remove(spark, last)
    return out
