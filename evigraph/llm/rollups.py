"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are sums of signed deltas. A batch of changes is summed up to one row for each key and committed under
its batch id, once: applying a batch again changes nothing. A batch lies in `<root>/batches/<id>`; it is written aside and moved there whole, by a move
that fails if the place is taken, so that a failed writer leaves no part of it and of two writers of one id one wins.

The totals are kept, too: `<root>/totals/<n>` has the sums up to a version and the ids of the batches in them. Compaction folds the batches that came
since into the next version, which is moved into place in the same way, and then removes their folders; their ids stay known."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import move_new
from . import common as C

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Tokenizer versions that count by a pattern.
PATTERNS = {"space-words/1": C.SPACE_WORD, "plain-words/1": C.PLAIN_WORD}


def pattern_count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def pattern_counts(docs: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, tokens) by each of PATTERNS for each row of docs; a null text counts 0. Texts are counted once, before rows are made."""
    sums = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[pattern_count(F.col("text"), p).alias(f"n{i}") for i, p in enumerate(PATTERNS.values())])
    counts = C.materialize(sums)
    return reduce(DataFrame.unionByName, [counts.select("source", "lang", F.lit(v).alias("tokenizer"), F.col(f"n{i}").alias("tokens")) for i, v in enumerate(PATTERNS)])


def tokenizer_counts(docs: DataFrame, path: str, version: str) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) by a tokenizer file of the tokenizers library."""
    import numpy as np
    import pyarrow as pa

    from . import tokenbin

    C.arrow_batches(docs.sparkSession, tokenbin.BATCH_ROWS)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = tokenbin.encoder_of(path)
        for batch in batches:
            for start, stop in encoder.slices(batch.column(3)):
                rows = batch.slice(start, stop - start)
                n = np.diff(encoder.encode(rows.column(3))[1])
                names = pa.array([version] * rows.num_rows, pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[:3], names, pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def inserted(counts: DataFrame) -> DataFrame:
    """The delta of new documents: counts(source, lang, tokenizer, tokens), a row for each document and tokenizer version. Null keys are keys."""
    return counts.groupBy(*KEYS).agg(F.count("*").cast("long").alias("docs"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """The delta of documents that go, from the counts they were inserted with."""
    return negated(inserted(counts))


def negated(delta: DataFrame) -> DataFrame:
    """The delta that undoes a delta."""
    return delta.select(*KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """The delta of documents whose counts, or whose source, language or tokenizer version, change."""
    return merged([deleted(before), inserted(after)])


def merged(deltas: list[DataFrame]) -> DataFrame:
    """The sum of deltas, without keys of which nothing is left."""
    rows = reduce(DataFrame.unionByName, [d.select(*KEYS, "docs", "tokens") for d in deltas])
    sums = rows.groupBy(*KEYS).agg(F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens"))
    return sums.where("docs <> 0 OR tokens <> 0")


class Rollup:
    """Totals below a root folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))

    def version(self) -> int:
        """The newest version of the totals; 0 before the first compaction."""
        return max((int(n) for n in self._names("totals")), default=0)

    def _ids(self, version: int) -> DataFrame:
        """(batch): the ids of the batches in a version of the totals."""
        if not version:
            return self.spark.createDataFrame([], "batch string")
        return self.spark.read.schema("batch string").parquet(f"{self.root}/totals/{version}/ids")

    def pending(self, version: int | None = None) -> list[str]:
        """Ids of the committed batches that are not in the totals of the version, in order of their names."""
        version = self.version() if version is None else version
        names = self._names("batches")
        if not version or not names:
            return names
        folded = {r[0] for r in self._ids(version).where(F.col("batch").isin(names)).collect()}
        return [n for n in names if n not in folded]

    def has(self, batch: str) -> bool:
        """Whether a batch is committed."""
        return batch in self._names("batches") or not self._ids(self.version()).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Adds a batch's delta; False, and nothing done, if its id is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"bad batch id {batch!r}")
        if self.has(batch):
            return False
        aside = f"{self.root}/staged/{batch}-{uuid.uuid4().hex}"
        delta.select(*KEYS, "docs", "tokens").coalesce(1).write.parquet(aside)
        return move_new(self.spark, aside, f"{self.root}/batches/{batch}")

    def _rows(self, version: int, batches: list[str]) -> list[DataFrame]:
        paths = [f"{self.root}/batches/{b}" for b in batches]
        if version:
            paths.append(f"{self.root}/totals/{version}/rows")
        return [self.spark.read.schema(SCHEMA).parquet(*paths)] if paths else []

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs and tokens: the kept totals and the batches since; keys of which nothing is left are gone."""
        version = self.version()
        rows = self._rows(version, self.pending(version))
        return merged(rows) if rows else self.spark.createDataFrame([], SCHEMA)

    def compact(self) -> int:
        """Folds the batches since the last compaction into a new version of the totals and removes their folders. Returns the newest version. If another
        writer was faster, its version stands."""
        version = self.version()
        batches = self.pending(version)
        if not batches:
            return version
        aside = f"{self.root}/staged/totals-{uuid.uuid4().hex}"
        merged(self._rows(version, batches)).coalesce(1).write.parquet(f"{aside}/rows")
        ids = self.spark.createDataFrame([(b,) for b in batches], "batch string")
        self._ids(version).unionByName(ids).coalesce(1).write.parquet(f"{aside}/ids")
        if move_new(self.spark, aside, f"{self.root}/totals/{version + 1}"):
            for b in batches:
                self._fs.delete(self._path(f"batches/{b}"), True)
            for old in self._names("totals"):  # the version before stays for its readers
                if int(old) < version:
                    self._fs.delete(self._path(f"totals/{old}"), True)
        return self.version()


def count_all(docs: DataFrame, root: str, path: str, version: str) -> Rollup:
    """Totals of docs(doc_id, text, source, lang) as they stand, by the word patterns and by the tokenizer file at `path`, named `version`.

    Four batches: the documents arrive with no language and are counted by the first pattern; the second is added; counts are revised to the documents'
    languages, after which the totals are compacted; the tokenizer comes as a new version. The first and the last batch are then applied again, as
    after lost replies.

    Every row counts with its whole text. Null texts are documents of 0 tokens; null sources and languages are keys; repeated rows count each; an
    empty table leaves no totals. Texts are read once by the patterns and once by the tokenizer; each task sums its rows up by key before anything
    is shuffled."""
    rollup = Rollup(docs.sparkSession, root)
    words = C.materialize(inserted(pattern_counts(docs)))
    unknown = words.withColumn("lang", F.lit(None).cast("string"))
    first, second = (F.col("tokenizer") == v for v in PATTERNS)
    arrived = merged([unknown.where(first)])
    rollup.commit("1-arrived", arrived)
    rollup.commit("2-second-pattern", merged([unknown.where(second)]))
    rollup.commit("3-languages", merged([negated(unknown), words]))
    rollup.compact()
    tokens = C.materialize(inserted(tokenizer_counts(docs, path, version)))
    rollup.commit("4-tokenizer", tokens)
    if rollup.commit("1-arrived", arrived) or rollup.commit("4-tokenizer", tokens):
        raise RuntimeError("a batch was committed twice")
    return rollup


def maintain(docs: DataFrame, root: str, least_words: int = 10, strip: str = "#*$%&|<>") -> Rollup:
    """Takes docs(doc_id, text, source, lang) through four batches: all documents are inserted with their counts under the first tokenizer version;
    those under the second are added; documents of fewer than `least_words` words are deleted; the texts of the others lose the characters in
    `strip` and their counts are revised. The first and third batch are then applied again, as after a lost reply.

    Null texts count 0 and are deleted; null sources and languages are keys; repeated rows count each; an empty table leaves no totals. Texts are
    read once; each task sums its rows up by key before anything is shuffled, so that a hot source costs what any other does."""
    first, second = PATTERNS
    text = F.coalesce(F.col("text"), F.lit(""))
    clean = F.translate(text, strip, "")
    names = {(v, k): f"n{i}{k}" for i, v in enumerate(PATTERNS) for k in "oc"}
    sums = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *[pattern_count(text if k == "o" else clean, PATTERNS[v]).alias(n) for (v, k), n in names.items()])
    counts = C.materialize(sums)

    def of(version: str, kind: str, rows: DataFrame) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), F.col(names[version, kind]).alias("tokens"))

    def both(kind: str, rows: DataFrame) -> DataFrame:
        return of(first, kind, rows).unionByName(of(second, kind, rows))

    short = F.col(names[first, "o"]) < least_words
    gone, live = counts.where(short), counts.where(~short)
    rollup = Rollup(docs.sparkSession, root)
    batches = [("1-insert", inserted(of(first, "o", counts))), ("2-new-tokenizer", inserted(of(second, "o", counts))), ("3-delete", deleted(both("o", gone))), ("4-revise", revised(both("o", live), both("c", live)))]
    for name, delta in batches:
        rollup.commit(name, delta)
    rollup.compact()
    for name, delta in (batches[0], batches[2]):
        if rollup.commit(name, delta):
            raise RuntimeError("a batch was committed twice")
    return rollup
