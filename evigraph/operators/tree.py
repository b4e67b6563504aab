"""Section trees of normalized documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = " › "


def _table_text(t: Column) -> Column:
    row = lambda r: F.array_join(r, " | ")
    return F.array_join(F.concat(F.array(row(t["headers"])), F.transform(t["rows"], row)), "\n")


#: Levels that a heading may have.
LEVELS = range(1, 10)


def _section_id(number: Column) -> Column:
    """A section's id: its document and its number, of four digits at least."""
    text = number.cast("string")
    return F.concat("doc_node_id", F.lit("#"), F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text))


def _number(section_id: Column) -> Column:
    return F.substring_index(section_id, "#", -1).cast("long")


def sections(docs: DataFrame) -> DataFrame:
    """section_id, doc_node_id, parent_section_id, ordinal, level, title, path, summary, text, span_start, span_end of docs in the normalized schema.

    A section is a heading with what follows it; its parent is the nearest heading before it of a lower level, levels may be skipped. Text before the
    first heading is left out. Parsers give no places, so a document's tables go to its last section. A document without headings is one section,
    Document, of level 0; an empty one has none.

    Blocks become rows; a running count of headings tells a block's section. For each level, a running maximum has the last heading of that level: it
    is open if no heading of a lower level came after it. A section's path is that of the open headings below its level, and the last of them is its
    parent. So the work is linear in the blocks."""
    rows = docs.where("error IS NULL").select(F.col("id").alias("doc_node_id"), "blocks", F.array_join(F.transform("tables", _table_text), "\n").alias("table_text"))
    blocks = rows.select("doc_node_id", F.posexplode("blocks").alias("i", "b")).select("doc_node_id", "i", F.col("b.kind").alias("kind"), F.col("b.level").alias("level"), F.col("b.text").alias("text"))
    heading = F.col("kind") == "heading"
    running = Window.partitionBy("doc_node_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("k", F.sum(heading.cast("int")).over(running) - 1)
    parts = F.collect_list(F.when(~heading & (F.col("text") != ""), F.struct("i", "text")))
    body = F.array_join(F.transform(F.array_sort(parts), lambda x: x["text"]), "\n")
    found = blocks.groupBy("doc_node_id", "k").agg(F.max(F.when(heading, F.col("level"))).alias("level"), F.max(F.when(heading, F.col("text"))).alias("title"), body.alias("text"))
    headed = found.where("k >= 0")

    before = Window.partitionBy("doc_node_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.struct("k", "title"))).over(before).alias(f"last{n}") for n in LEVELS]
    size = F.count("*").over(Window.partitionBy("doc_node_id"))
    headed = headed.select("*", *last, size.alias("size"))
    open_ = []
    for n in LEVELS:
        here = F.col(f"last{n}")
        lower = [F.coalesce(F.col(f"last{m}.k"), F.lit(-1)) for m in LEVELS if m < n]
        newer = F.greatest(F.lit(-2), F.lit(-1), *lower) < here["k"]
        open_.append(F.when((F.col("level") > n) & newer, here))
    headed = headed.withColumn("open", F.array_compact(F.array(*open_)))
    path = F.array_join(F.concat(F.transform("open", lambda x: x["title"]), F.array("title")), SEPARATOR)
    up = F.coalesce(F.get("open", F.size("open") - 1)["k"], F.lit(-1))
    tables = rows.select("doc_node_id", F.nullif("table_text", F.lit("")).alias("table_text"))
    headed = headed.select("doc_node_id", "k", up.alias("up"), "level", "title", path.alias("path"), "text", "size").join(tables, "doc_node_id", "left")
    text = F.concat_ws("\n", F.nullif("text", F.lit("")), F.when(F.col("k") == F.col("size") - 1, F.col("table_text")))
    headed = headed.withColumn("text", text).drop("table_text", "size")

    heads = F.size(F.filter("blocks", lambda b: b["kind"] == "heading"))
    texts = F.transform(F.filter("blocks", lambda b: b["text"] != ""), lambda b: b["text"])
    plain = F.concat_ws("\n", F.nullif(F.array_join(texts, "\n"), F.lit("")), F.nullif("table_text", F.lit("")))
    title = F.lit("Document")
    single = rows.where(heads == 0).select("doc_node_id", F.lit(0).alias("k"), F.lit(-1).alias("up"), F.lit(0).alias("level"), title.alias("title"), title.alias("path"), plain.alias("text")).where("text <> ''")

    every = headed.unionByName(single)
    order = Window.partitionBy("doc_node_id", "up").orderBy("k")
    none = F.lit(0).cast("long")
    return every.select(
        _section_id(F.col("k")).alias("section_id"),
        "doc_node_id",
        F.when(F.col("up") >= 0, _section_id(F.col("up"))).alias("parent_section_id"),
        (F.row_number().over(order) - 1).alias("ordinal"),
        "level",
        "title",
        "path",
        F.lit(None).cast("string").alias("summary"),
        F.nullif("text", F.lit("")).alias("text"),
        none.alias("span_start"),
        none.alias("span_end"),
    )


def stale(docs: DataFrame, trees: DataFrame) -> DataFrame:
    """Documents whose tree is missing or of another content: docs(id, sha256) against trees(doc_node_id, sha256)."""
    return docs.join(trees.select(F.col("doc_node_id").alias("id"), "sha256"), ["id", "sha256"], "left_anti")


def replace_sections(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the sections of fresh's documents in place of what it had for them."""
    return index.join(fresh.select("doc_node_id").distinct(), "doc_node_id", "left_anti").unionByName(fresh)


def document_sections(index: DataFrame, doc: str) -> DataFrame:
    """A document's sections in the order of the document."""
    return index.where(F.col("doc_node_id") == doc).orderBy(_number(F.col("section_id")))


def summarize(index: DataFrame, summarizer) -> DataFrame:
    """Sections with summaries by summarizer(title, text, summaries of the children), from the deepest level up, a level at a time."""
    import pandas as pd

    from .graph import shared

    rows = shared(index)
    levels = sorted((r[0] for r in rows.select("level").distinct().collect()), reverse=True)  # at most seven numbers
    done = None
    for level in levels:
        here = rows.where(F.col("level") == level).drop("summary")
        if done is None:
            here = here.withColumn("children", F.array().cast("array<string>"))
        else:
            below = done.where("parent_section_id IS NOT NULL").groupBy(F.col("parent_section_id").alias("section_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "summary"))), lambda x: x["summary"]).alias("children"))
            here = here.join(below, "section_id", "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))
        names = [f for f in index.columns if f != "summary"]

        def run(batches, names=names):
            for b in batches:
                out = b[names].copy()
                out["summary"] = [summarizer(t, x, list(c)) for t, x, c in zip(b["title"], b["text"], b["children"], strict=True)]
                yield pd.DataFrame(out)

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema if f.name != "summary") + ", summary string"
        part = shared(here.mapInPandas(run, schema)).select(*index.columns)
        done = part if done is None else done.unionByName(part)
    return rows if done is None else done
