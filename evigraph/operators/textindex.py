"""A stored text index that follows its table.

The index has a commit log of its own. `live` says for each row which part its postings are in; `postings` are only added. Bringing the index up to a
version is one commit: rows that were touched and whose text is new or another get new postings and point to them. `compact` leaves out postings that
nothing points to; as it conflicts with no writer, what is added meanwhile stays."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import index_terms
from ..sources.commits import COMPACTED, MOST_PARTS, Change, Commits, Spec
from .graph import shared
from .search import postings


class TextIndex:
    def __init__(self, spark: SparkSession, root: str, key: str, fields: list[str]):
        self.key, self.fields = key, fields
        tables = {
            "live": Spec(f"{key} string, sig long, part string, length long", (key,), key),
            "postings": Spec(f"{key} string, part string, field string, pos int, term string", (), "term"),
        }
        self.log = Commits(spark, root, tables)

    def version(self) -> int | None:
        """The version of the table that the index was last brought up to; None if it was never."""
        return next((m["n"] for n in reversed(self.log.numbers()) if (m := self.log.manifest(n))["kind"] != COMPACTED), None)

    def _signed(self, rows: DataFrame) -> DataFrame:
        marks = [c for f in self.fields for c in (F.coalesce(f, F.lit("")), F.col(f).isNull())]
        return shared(rows.select(self.key, *self.fields, F.xxhash64(*marks).alias("sig")))

    def _added(self, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The live rows and the postings of new texts."""
        part = F.lit(uuid.uuid4().hex)
        length = reduce(lambda a, b: a + b, [F.size(index_terms(F.col(f))) for f in self.fields])
        added = postings(fresh, self.key, self.fields).withColumn("part", part)
        return fresh.select(self.key, "sig", part.alias("part"), length.cast("long").alias("length")), added.sortWithinPartitions("term")

    def sync(self, touched: DataFrame, rows: DataFrame, version: int) -> None:
        """Brings the index up to a version in which the rows touched(key) may have changed; rows(key, fields) has those of them that are still there.
        Texts that are as they were keep their postings. Another writer that changed the index meanwhile makes this raise Conflict."""
        base = self.log.number()
        old = shared(self.log.read("live", base).join(touched.select(self.key).distinct(), self.key, "left_semi").select(self.key, "sig", "part", "length"))
        signed = self._signed(rows)
        gone = old.join(signed.select(self.key, "sig"), [self.key, "sig"], "left_anti").select(*old.columns)
        live, added = self._added(shared(signed.join(old.select(self.key, "sig"), [self.key, "sig"], "left_anti")))
        self.log.commit(base, {"live": Change(gone, live), "postings": Change(put=added)}, "synced", n=version, reads=("live",))
        if sum(p["kind"] != "base" for p in self.log.manifest(self.log.number())["parts"]) > 2 * MOST_PARTS:
            self.compact()

    def rebuild(self, rows: DataFrame, version: int) -> None:
        """Makes the index anew from all rows, in one commit."""
        live, added = self._added(self._signed(rows))
        self.log.commit(self.log.number(), {"live": Change(whole=live), "postings": Change(whole=added)}, "synced", n=version, reads=("live",))

    def compact(self) -> None:
        """Folds the postings that are alive, and the table that says so."""
        base = self.log.number()
        self.log.compact("postings", rows=self._alive(self.log.read("postings", base), base), base=base)
        self.log.compact("live")

    def _alive(self, found: DataFrame, at: int) -> DataFrame:
        return found.join(self.log.read("live", at).select(self.key, "part"), [self.key, "part"], "left_semi")

    def read(self, terms: list[str] | None = None) -> DataFrame:
        """The postings that are alive, of these terms alone if they are given: of folded postings, only the files of their buckets are read."""
        at = self.log.number()
        found = self.log.read("postings", at) if terms is None else self.log.lookup("postings", terms, at)
        return self._alive(found, at)

    def lengths(self) -> DataFrame:
        """(key, length): the number of terms of each row that has any."""
        return self.log.read("live").where("length > 0").select(self.key, "length")
