"""Language-model steps behind one small interface. Nothing here calls a model: a provider is passed in, and replies are checked before they count."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .functions.confidence import sanitize
from .operators import extract as X
from .operators.extract import Facts
from .schema import CONFIDENCE

WINDOW_BYTES = 12_000
REVIEW_BELOW = 0.6
LINK_CONCEPTS = 40
#: How a failed call is repeated.
RETRIES, FIRST_WAIT, FACTOR, MOST_WAIT = 3, 1.0, 2.0, 30.0


class Provider(Protocol):
    """What a model must do; all methods take and give plain data."""

    def entities(self, text: str) -> list[dict]: ...  # name, kind, quote?, confidence?

    def relation(self, text: str, a: str, b: str) -> dict | None: ...  # kind, confidence

    def links(self, left: list[str], right: list[str]) -> list[dict]: ...  # from, to (numbers from 0), kind, confidence

    def categories(self, names: list[str], kinds: list[str]) -> list[dict]: ...  # label, members and headline (numbers from 0)

    def rationale(self, name: str, quotes: list[str]) -> str: ...

    def rerank(self, query: str, previews: list[str]) -> str: ...

    def describe(self, image: bytes) -> str: ...

    def summarize(self, title: str, text: str | None, below: list[str]) -> str: ...


def with_retries(call: Callable, *args, wait: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = lambda: 1.0):
    """The call's result; after a failure it is repeated with growing waits, or after the time that the failure asks for (`retry_after`)."""
    pause = FIRST_WAIT
    for attempt in range(RETRIES + 1):
        try:
            return call(*args)
        except Exception as e:
            if attempt == RETRIES:
                raise
            wait(min(MOST_WAIT, getattr(e, "retry_after", None) or pause * jitter()))
            pause *= FACTOR


def json_reply(reply: str):
    """The JSON value in a reply, without a fence or words around it; None if there is none."""
    text = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", reply.strip())
    for opening, closing in (("{", "}"), ("[", "]")):
        a, b = text.find(opening), text.rfind(closing)
        if 0 <= a < b and (opening == "{" or text.find("{") in (-1, *range(a, len(text)))):
            try:
                return json.loads(text[a : b + 1])
            except ValueError:
                continue
    return None


def text_window(text: str, most: int = WINDOW_BYTES) -> str:
    """The first bytes of a text, up to the last line feed among them, without half a character."""
    data = text.encode()
    if len(data) <= most:
        return text
    head = data[:most].decode(errors="ignore")
    return head[: head.rfind("\n")] if "\n" in head else head


class Patient:
    """A provider whose calls are repeated after failures, by `with_retries`."""

    def __init__(self, provider):
        self.provider = provider

    def __getattr__(self, name: str):
        if name.startswith("__") or name == "provider":
            raise AttributeError(name)
        method = getattr(self.provider, name)
        return lambda *args: with_retries(method, *args)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").alias("doc_id"), "sha256", F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"))


def entities(docs: DataFrame, known: DataFrame, provider: Provider, now: int) -> Facts:
    """Tainted nodes of what a provider finds in the first part of each document. Unknown kinds go; leading clause numbers go; ids that known(id) has
    get evidence and an edge, but no node."""

    def run(batches):
        for b in batches:
            out = []
            for doc_id, sha, text in zip(b["doc_id"], b["sha256"], b["text"], strict=True):
                out += [(doc_id, sha, n, str(e.get("name", "")), str(e.get("kind", "")), e.get("quote")) for n, e in enumerate(provider.entities(text_window(text)))]
            yield pd.DataFrame(out, columns=["doc_id", "sha256", "n", "raw_name", "raw_kind", "quote"])

    rows = _texts(docs).mapInPandas(run, "doc_id string, sha256 string, n int, raw_name string, raw_kind string, quote string")
    rows = rows.withColumn("kind", T.node_kind(F.col("raw_kind"))).withColumn("name", T.strip_clause_number(F.col("raw_name"))).where("kind IS NOT NULL AND name <> '' AND kind <> 'Document'")
    rows = rows.withColumn("id", F.concat(F.lower("kind"), F.lit("."), T.slugify(F.col("name"))))
    ev = X.made_id(F.lit("entity"), "doc_id", "id")
    once = rows.groupBy("doc_id", "sha256", "id").agg(F.min_by(F.struct("kind", "name", "quote", "raw_kind"), "n").alias("x")).select("doc_id", "sha256", "id", "x.*").withColumn("ev", ev)
    stage = T.lifecycle(F.col("raw_kind"))
    attrs = F.when((F.col("kind") == "Customer") & stage.isNotNull(), F.to_json(F.struct(stage.alias("lifecycle")))).otherwise(F.lit("{}"))
    new = once.join(known.select("id"), "id", "left_anti")
    edges, pairs = X._edge(once, F.col("doc_id"), F.col("id"), "MentionedIn", F.col("ev"), now, confidence=CONFIDENCE["Llm"], tainted=True, created_by="Llm")
    return {"nodes": X._node(new, F.col("id"), F.col("kind"), F.col("name"), attrs, now, review=False, confidence=CONFIDENCE["Llm"], tainted=True).dropDuplicates(["id"]), "evidence": X._evidence(once, F.col("ev"), F.coalesce("quote", "name"), F.lit(None).cast("string"), "Document", now, extractor="Llm", confidence=CONFIDENCE["Llm"]), "edges": edges, "edge_evidence": pairs}


def relations(docs: DataFrame, mentions: DataFrame, linked: DataFrame, provider: Provider, now: int) -> Facts:
    """Edges that a provider gives for pairs of names in one paragraph: mentions(doc_id, id, name), without pairs that linked(from_id, to_id) has in
    either direction. Below 0.6 they are up for review."""
    text = docs.select(F.col("id").alias("doc_id"), "sha256", F.posexplode("blocks").alias("p", "b")).where("b.kind = 'paragraph'").select("doc_id", "sha256", "p", F.col("b.text").alias("text"))
    said = text.join(mentions, "doc_id").where(F.lower("text").contains(F.lower("name")))
    pairs = said.groupBy("doc_id", "sha256", "p", "text").agg(F.array_sort(F.collect_set(F.struct("id", "name"))).alias("m")).select("doc_id", "sha256", "p", "text", F.explode(X.pairs_in_order(F.col("m"))).alias("x")).select("doc_id", "sha256", "p", "text", F.col("x.a.id").alias("a"), F.col("x.a.name").alias("an"), F.col("x.b.id").alias("b"), F.col("x.b.name").alias("bn"))
    both = linked.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).union(linked.select("to_id", "from_id")).distinct()
    pairs = pairs.join(both, ["a", "b"], "left_anti")

    def run(batches):
        for b in batches:
            out = [(*key, r["kind"], float(r.get("confidence", 0.5))) for *key, text, an, bn in zip(b["doc_id"], b["sha256"], b["p"], b["a"], b["b"], b["text"], b["an"], b["bn"], strict=True) if (r := provider.relation(text, an, bn))]
            yield pd.DataFrame(out, columns=["doc_id", "sha256", "p", "a", "b", "raw_kind", "c"])

    rows = pairs.mapInPandas(run, "doc_id string, sha256 string, p int, a string, b string, raw_kind string, c double")
    rows = rows.withColumn("kind", T.edge_kind(F.col("raw_kind"))).where("kind IS NOT NULL AND kind <> 'MentionedIn'").withColumn("c", sanitize(F.col("c"))).withColumn("ev", X.made_id(F.lit("relation"), "doc_id", F.col("p").cast("string"), "a", "b"))
    edges, edge_evidence = X._edge(rows, F.col("a"), F.col("b"), F.col("kind"), F.col("ev"), now, tainted=True, created_by="Llm")
    scores = rows.select(F.col("ev").alias("evidence_id"), "c").join(edge_evidence, "evidence_id").select(F.col("edge_id").alias("id"), "c")
    edges = edges.drop("confidence", "requires_human_review").join(scores, "id").withColumn("requires_human_review", F.col("c") < REVIEW_BELOW).withColumnRenamed("c", "confidence").select("id", "from_id", "to_id", "kind", "confidence", "created_by", "is_tainted", "requires_human_review", "created_at")
    evidence = X._evidence(rows, F.col("ev"), F.lit(None).cast("string"), F.concat(F.lit("paragraph:"), F.col("p").cast("string")), "Document", now, extractor="Llm", confidence=CONFIDENCE["Llm"])
    return {"evidence": evidence, "edges": edges, "edge_evidence": edge_evidence}


def checked_links(reply: list[dict], left: list[str], right: list[str]) -> list[tuple[str, str, str, float]]:
    """(from id, to id, raw kind, confidence) of links by number; numbers out of range, links to oneself and MentionedIn go."""
    out = []
    for x in reply:
        a, b = x.get("from"), x.get("to")
        if isinstance(a, int) and isinstance(b, int) and 0 <= a < len(left) and 0 <= b < len(right) and left[a] != right[b] and str(x.get("kind", "")).lower().replace("_", "") != "mentionedin":
            out.append((left[a], right[b], str(x.get("kind", "")), float(x.get("confidence", 0.5))))
    return out


def cross_links(new: DataFrame, known: DataFrame, provider: Provider) -> DataFrame:
    """(from_id, to_id, kind, confidence, review) between at most 40 new and 40 known concepts, by names."""
    left = [r.asDict() for r in new.orderBy("id").limit(LINK_CONCEPTS).select("id", "name").collect()]
    right = [r.asDict() for r in X.recent_concepts(known, LINK_CONCEPTS).select("id", "name").collect()]
    found = checked_links(provider.links([x["name"] for x in left], [x["name"] for x in right]), [x["id"] for x in left], [x["id"] for x in right]) if left and right else []
    rows = new.sparkSession.createDataFrame(found, "from_id string, to_id string, raw string, c double")
    return rows.select("from_id", "to_id", T.edge_kind(F.col("raw")).alias("kind"), sanitize(F.col("c")).alias("confidence"), (sanitize(F.col("c")) < REVIEW_BELOW).alias("review")).where("kind IS NOT NULL")


class PromptLibrary:
    """Texts of prompts by name; a workspace folder's files come before the ones given."""

    def __init__(self, texts: dict[str, str], folder: str | None = None):
        self.texts, self.folder = texts, folder

    def get(self, name: str) -> str:
        import pathlib

        if self.folder and (path := pathlib.Path(self.folder) / f"{name}.md").is_file():
            return path.read_text()
        return self.texts[name]
