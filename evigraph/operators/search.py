"""Inverted index, phrase search and BM25."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_terms, query_terms
from ..schema import Graph

K1, B = 1.2, 0.75
SHORTLIST, RESULTS = 40, 20


def postings(docs: DataFrame, key: str, fields: list[str], terms: list[str] | None = None) -> DataFrame:
    """(key, field, pos, term): the terms of each field of each row, by place; of these terms alone if they are given, and then no others are exploded."""

    def of(field: str):
        found = F.transform(index_terms(F.col(field)), lambda t, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), t.alias("term")))
        return found if terms is None else F.filter(found, lambda x: x["term"].isin(*terms))

    parts = [of(f) for f in fields]
    return docs.select(key, F.explode(F.concat(*parts)).alias("p")).select(key, "p.*")


def counted_postings(docs: DataFrame, key: str, fields: list[str], terms: list[str]) -> tuple[DataFrame, DataFrame]:
    """The postings of these terms, as `postings` has them, and (key, length) as `lengths` of all postings has it. Each text is read and taken apart
    once for both; what stays of it, its length and the places of the terms, is `shared`."""
    from .graph import shared

    def of(n: int, field: str):
        return F.array_compact(F.transform(f"terms{n}", lambda t, i: F.when(t.isin(*terms), F.struct(F.lit(field).alias("field"), i.alias("pos"), t.alias("term")))))

    parsed = docs.select(key, *[index_terms(F.col(f)).alias(f"terms{n}") for n, f in enumerate(fields)])
    found = [of(n, f) for n, f in enumerate(fields)]
    length = reduce(lambda a, b: a + b, [F.size(f"terms{n}") for n in range(len(fields))]).cast("long")
    rows = shared(parsed.select(key, length.alias("length"), F.concat(*found).alias("found")))
    return rows.select(key, F.explode("found").alias("p")).select(key, "p.*"), rows.where("length > 0").groupBy(key).agg(F.sum("length").alias("length"))


def lengths(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy(key).agg(F.count("*").alias("length"))


def text_lengths(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, length) as `lengths` of all postings has it, counted in each row without a row for each term."""
    length = reduce(lambda a, b: a + b, [F.size(index_terms(F.col(f))) for f in fields]).cast("long")
    return docs.select(key, length.alias("length")).where("length > 0").groupBy(key).agg(F.sum("length").alias("length"))


def phrases(spark, queries: list[tuple[str, str]]) -> list[tuple[str, int, list[str]]]:
    """(query id, number of the phrase, its terms): each word of a query is a phrase of the terms that it has."""
    rows = spark.createDataFrame(queries, "qid string, query string").select("qid", F.posexplode(query_terms(F.col("query"))).alias("n", "word")).select("qid", "n", index_terms(F.col("word")).alias("terms")).collect()
    return sorted((r["qid"], r["n"], list(r["terms"])) for r in rows if r["terms"])


def terms_of(spark, query: str) -> list[str]:
    """The distinct terms of a query."""
    return sorted({t for _, _, terms in phrases(spark, [("q", query)]) for t in terms})


def occurrences(index: DataFrame, key: str, wanted: list[tuple[str, int, list[str]]]) -> DataFrame:
    """(qid, n, key, tf): how often each phrase occurs in each row; words of a phrase follow each other in one field. Only postings of the queries'
    terms are joined."""
    spark = index.sparkSession
    found = []
    words = [(q, n, i, t) for q, n, terms in wanted for i, t in enumerate(terms)]
    if not words:
        return spark.createDataFrame([], f"qid string, n int, tf long, {key} {index.schema[key].dataType.simpleString()}").select("qid", "n", key, "tf")
    table = F.broadcast(spark.createDataFrame(words, "qid string, n int, i int, term string"))
    sizes = {(q, n): len(t) for q, n, t in wanted}
    size = F.broadcast(spark.createDataFrame([(q, n, s) for (q, n), s in sizes.items()], "qid string, n int, size int"))
    rows = index.join(table, "term").groupBy("qid", "n", key, "field", (F.col("pos") - F.col("i")).alias("start")).agg(F.count("*").alias("hits")).join(size, ["qid", "n"]).where("hits = size")
    found.append(rows.groupBy("qid", "n", key).agg(F.count("*").alias("tf")))
    return reduce(DataFrame.unionByName, found)


def complete(tf: DataFrame, key: str, wanted: list[tuple[str, int, list[str]]]) -> DataFrame:
    """(qid, key): the rows of `occurrences` that have every phrase of their query."""
    needed: dict[str, int] = {}
    for q, _, _ in wanted:
        needed[q] = needed.get(q, 0) + 1
    rows = tf.groupBy("qid", key).agg(F.count("*").alias("k"))
    if not needed:
        return rows.select("qid", key)
    want = F.broadcast(tf.sparkSession.createDataFrame(list(needed.items()), "qid string, needed long"))
    return rows.join(want, "qid").where("k = needed").select("qid", key)


def match_all(index: DataFrame, key: str, queries: list[tuple[str, str]]) -> DataFrame:
    """(qid, key): rows with every phrase of the query; a blank query has none."""
    wanted = phrases(index.sparkSession, queries)
    return complete(occurrences(index, key, wanted), key, wanted)


def bm25(index: DataFrame, key: str, queries: list[tuple[str, str]], scope: DataFrame | None = None, length: DataFrame | None = None) -> DataFrame:
    """(qid, key, score) of rows with every phrase of the query. scope(key) limits the rows that are ranked, not the statistics. Scores are positive.

    length(key, length): the rows' numbers of terms, where index holds only the postings of the queries' terms."""
    wanted = phrases(index.sparkSession, queries)
    length = lengths(index, key) if length is None else length
    total = length.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    tf = occurrences(index, key, wanted)
    df = tf.groupBy("qid", "n").agg(F.count("*").alias("df"))
    hits = complete(tf, key, wanted)
    if scope is not None:
        hits = hits.join(scope.select(key), key, "left_semi")
    rows = tf.join(hits, ["qid", key], "left_semi").join(F.broadcast(df), ["qid", "n"]).join(length, key).join(F.broadcast(total.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    idf = F.greatest(F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return rows.groupBy("qid", key).agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, key: str, n: int = SHORTLIST) -> DataFrame:
    """The n best of each query, by score and then key, with their rank."""
    from pyspark.sql import Window

    order = Window.partitionBy("qid").orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def rerank(reply: str | None, size: int) -> list[int]:
    """Places (from 0) in the order that a reply names by numbers from 1: numbers out of range and repeated ones go; NONE gives none; a reply without a
    number, or no reply, leaves the order as it is."""
    import re

    if reply is None:
        return list(range(size))
    if reply.strip().upper() == "NONE":
        return []
    numbers = [int(x) - 1 for x in re.findall(r"\d+", reply)]
    return list(dict.fromkeys(n for n in numbers if 0 <= n < size)) if numbers else list(range(size))


def node_texts(nodes: DataFrame, quotes: DataFrame | None) -> DataFrame:
    """id, name, definition (of KPIs) and, if they are given, quotes, from nodes and quotes(node_id, quotes)."""
    from ..functions.jsonx import text_at

    definition = F.when(F.col("kind") == "Kpi", text_at(F.col("attrs"), "definition")).alias("definition")
    if quotes is None:
        return nodes.select("id", "name", definition)
    return nodes.join(quotes.withColumnRenamed("node_id", "id"), "id", "left").select("id", "name", definition, "quotes")


def node_postings(g: Graph, query: str) -> DataFrame:
    """(id, field, pos, term): the postings of nodes' texts for the terms of a query, without a text of all quotes of each node where none is needed.

    If every phrase of the query is one term, only quotes that hold a term are taken to their nodes; phrases of several terms may run from one quote into
    the next, and need all of them."""
    from .graph import node_quotes

    wanted = phrases(g.nodes.sparkSession, [("q", query)])
    terms = sorted({t for _, _, words in wanted for t in words})
    evidence = g.evidence
    if all(len(words) == 1 for _, _, words in wanted):
        low = F.lower("quote")
        near = reduce(lambda a, b: a | b, [low.contains(t) for t in terms], F.lit(False))  # cheaper than to take the quote apart
        evidence = evidence.where(near & F.arrays_overlap(index_terms(F.col("quote")), F.array(*[F.lit(t) for t in terms]).cast("array<string>")))
    quotes = node_quotes(replace(g, evidence=evidence)).withColumnRenamed("node_id", "id").join(g.nodes.select("id"), "id", "left_semi")
    named = node_texts(g.nodes, None)
    return postings(named, "id", ["name", "definition"], terms).unionByName(postings(quotes, "id", ["quotes"], terms))


NODE_FIELDS = ["name", "definition", "quotes"]
SECTION_FIELDS = ["title", "path", "summary", "text"]


def graph_search(nodes: DataFrame, index: DataFrame, query: str, kinds: tuple[str, ...] | None = None, limit: int = RESULTS) -> DataFrame:
    """id, name, kind of nodes that hold every word of the query, by the postings of `node_texts`. The limit comes first, in order of ids, and the kinds
    after it."""
    rows = match_all(index, "id", [("q", query)]).select("id").orderBy("id").limit(limit).join(nodes.select("id", "name", "kind"), "id")
    return rows.where(F.col("kind").isin(*kinds)) if kinds else rows


def section_search(
    sections: DataFrame,
    query: str,
    documents: list[str] | None = None,
    limit: int = RESULTS,
    shortlist: int = SHORTLIST,
    reranker=None,
    index: DataFrame | None = None,
    length: DataFrame | None = None,
) -> DataFrame:
    """Sections by BM25 over title, path, summary and text, then in the order that reranker(query, rows) replies with. index and length are stored
    postings and numbers of terms; without them they are made from the sections."""
    if index is None:
        index = postings(sections, "section_id", SECTION_FIELDS)
    scope = sections.where(F.col("doc_node_id").isin(*documents)).select("section_id") if documents else None
    best = top(bm25(index, "section_id", [("q", query)], scope, length), "section_id", shortlist).drop("qid")
    found = best.join(sections, "section_id").orderBy("rank")
    if reranker is None:
        return found.limit(limit)
    rows = found.collect()  # at most `shortlist` rows
    order = rerank(reranker(query, rows), len(rows))[:limit]
    return sections.sparkSession.createDataFrame([rows[k] for k in order], found.schema)
