import re

import pytest
from evigraph.operators import diff, graph, mutations, search
from evigraph.plans import queries
from evigraph.plans import testgraph as P
from evigraph.schema import EDGE_EVIDENCE, EDGES, NODES, Graph, empty_graph
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(df):
    """The physical plan without broadcasts, which tables outgrow."""
    spark = df.sparkSession
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def exchanges(df, column):
    return len(re.findall(rf"Exchange hashpartitioning\({column}#\d+L?, \d+\)", plan(df)))


def test_search_takes_only_quotes_with_a_term_to_their_nodes(spark):
    """the postings are those of the whole texts; a quote without a term is dropped before the joins."""
    g = P.graph(spark, SF)
    text = 'red "bolt"'
    terms = search.terms_of(spark, text)
    rows = lambda index: {tuple(r) for r in index.select("id", "field", "term").distinct().collect()}
    whole = search.postings(search.node_texts(g.nodes, graph.node_quotes(g)), "id", search.NODE_FIELDS, terms)
    assert rows(search.node_postings(g, text)) == rows(whole) != set()
    assert "Contains(lower(quote" in plan(search.node_postings(g, text)) or "contains(lower(" in plan(search.node_postings(g, text)).lower()


@pytest.mark.parametrize("text", ["bolt of", "\"sold-1\" ring", "of"])
def test_phrases_of_several_terms_keep_all_quotes(spark, text):
    """a phrase may run from one quote into the next."""
    g = P.graph(spark, SF)
    whole = search.postings(search.node_texts(g.nodes, graph.node_quotes(g)), "id", search.NODE_FIELDS)
    ids = lambda index: {r.id for r in search.match_all(index, "id", [("q", text)]).collect()}
    assert ids(search.node_postings(g, text)) == ids(whole)


def test_evidence_is_dealt_out_by_its_id_once(spark):
    """its distinct rows and its joins by id share an exchange."""
    evidence, pairs = (P.frame(spark, SF, v) for v in ("g_evidence", "g_edge_evidence"))
    rows = pairs.join(evidence.select(F.col("id").alias("evidence_id"), "quote"), "evidence_id")
    assert exchanges(rows, "evidence_id") == 1 and exchanges(rows, "id") == 1
    narrow = plan(P.graph(spark, SF, only={"evidence": ("id", "quote")}).evidence)
    assert "l_shipdate" not in narrow and narrow.count("Exchange hashpartitioning(id#") == 1


def test_projection_is_that_of_the_sql(spark):
    """dealing rows out changes none."""
    for view, tables in (("g_evidence", ("lineitem", "part")), ("g_edge_evidence", ("lineitem",))):
        for t in tables:
            spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
        plain = spark.sql(P.sql(view, "spark"))
        dealt = P.frame(spark, SF, view)
        assert dealt.schema == plain.schema
        assert dealt.exceptAll(plain).isEmpty() and plain.exceptAll(dealt).isEmpty()


def test_evidence_touches_nodes_without_an_exchange_of_pairs(spark):
    """the pairs of node and evidence are made distinct where the evidence is."""
    g = P.graph(spark, SF, by={"edge_evidence": "edge_id"})
    assert exchanges(graph.display_confidence(g), "evidence_id") == 1
    assert not re.search(r"Exchange hashpartitioning\(node#\d+, evidence_id#", plan(graph.touching_evidence(g)))


def changed_graph(spark, g):
    """Edges that lose an end, get other ends under their id, come and go; nodes with one key, new names and other texts of the same attributes."""
    rows = lambda df, f: spark.createDataFrame([f(r.asDict()) for r in df.collect()], df.schema)
    nodes = rows(g.nodes.where("id NOT IN ('n3')"), lambda r: {**r, "name": "New" if r["id"] == "n1" else r["name"], "attrs": '{"y":2, "x":1}' if r["id"] == "n2" else r["attrs"]})
    edges = rows(g.edges.where("id <> 'e4'"), lambda r: {**r, "to_id": "n5"} if r["id"] == "e1" else r)
    return Graph(**{**g.frames(), "nodes": nodes, "edges": edges, "edge_evidence": g.edge_evidence.where("evidence_id <> 'v0'")})


def test_differences_meet_by_id_and_are_those_of_plain_rows(spark):
    """F2, F5, F8."""
    node = lambda i, name, attrs=None: (f"n{i}", "Kpi", name, attrs, 0.5, False, False, 0, 0)
    edge = lambda i, a, b, c=0.5: (f"e{i}", f"n{a}", f"n{b}", "Causes", c, "Rule", False, False, 0)
    make = spark.createDataFrame
    nodes = [node(0, "Zero"), node(1, "One"), node(2, "Two", '{"x":1,"y":2}'), node(3, "Three"), node(4, "ZERO"), node(5, "Five")]
    edges = [edge(0, 0, 1), edge(1, 0, 2), edge(2, 3, 2), edge(3, 4, 2, 0.7), edge(4, 5, 2), edge(5, 5, 0), edge(6, 0, 9)]
    g = Graph(**{**empty_graph(spark).frames(), "nodes": make(nodes, NODES), "edges": make(edges, EDGES), "edge_evidence": make([("e5", "v0"), ("e5", "v1")], EDGE_EVIDENCE)})
    h = changed_graph(spark, g)
    assert sorted(map(tuple, diff.diff_nodes(g, h).collect())) == [("Kpi:new", "added", ""), ("Kpi:one", "removed", ""), ("Kpi:three", "removed", "")]
    want = [("Kpi:five->Kpi:two:Causes", "removed", ""), ("Kpi:five->Kpi:zero:Causes", "modified", "evidence"), ("Kpi:three->Kpi:two:Causes", "removed", ""), ("Kpi:zero->Kpi:five:Causes", "added", "")]
    want += [("Kpi:zero->Kpi:new:Causes", "added", ""), ("Kpi:zero->Kpi:one:Causes", "removed", ""), ("Kpi:zero->Kpi:two:Causes", "modified", "confidence")]
    assert sorted(map(tuple, diff.diff_edges(g, h).collect())) == want
    assert len(re.findall(r"Exchange hashpartitioning\((?:from_id|to_id)#", plan(diff.diff_edges(g, h)))) == 4


def test_edges_that_both_graphs_share_do_not_meet(spark):
    """F8: where only nodes changed, the differences are those of graphs that share no table; edges go to their ends' keys alone, and evidence is
    counted for edges that come first in place of others, which are sent to it."""
    g = P.graph(spark, "/root/testdata/sf0.01", by={"edge_evidence": "edge_id"})
    h = queries._changed(g)
    apart = Graph(**{**h.frames(), "edges": h.edges.select("*"), "edge_evidence": h.edge_evidence.select("*")})
    rows = lambda df: sorted(map(tuple, df.collect()))
    found = rows(diff.diff_edges(g, h))
    assert found == rows(diff.diff_edges(g, apart)) and len({x[1] for x in found}) == 3 and any("evidence" in x[2] for x in found)
    text = plan(diff.diff_edges(g, h))
    assert "l_orderkey" not in text and "o_orderkey" not in text


def test_impact_exchanges_steps_once_and_reaches_no_missing_id(spark):
    """steps are made distinct once and not for each level; the first level is neither joined nor grouped again."""
    rows = [(a, b) for a, b in [("a", "b"), ("a", "b"), ("b", "c"), ("a", "a.c"), ("a.c", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("b", None), (None, "b"), ("x", "a")]]
    edges = spark.createDataFrame(rows, "from_id string, to_id string")
    starts = spark.createDataFrame([("a",), ("a",), ("d",), ("none",), (None,)], "start string")
    want = [("a", "a.c", 1, "a>a.c"), ("a", "b", 1, "a>b"), ("a", "c", 2, "a>a.c>c"), ("a", "d", 3, "a>a.c>c>d")]
    assert sorted(map(tuple, graph.impact(edges, starts, 3).collect())) == want
    assert sorted(map(tuple, graph.impact(edges, starts, 1).collect())) == want[:2]
    text = plan(graph.impact(edges, starts, 1))
    assert "from_id" not in text and "Aggregate" not in text


def test_orphans_read_edge_ids_alone(spark):
    """F11."""
    assert "ev." not in plan(queries.QUERIES["orphan_edges"](spark, SF))


def test_ranking_counts_lengths_without_a_row_for_each_term(spark):
    """the lengths are those of all postings."""
    docs = spark.createDataFrame([(1, "The license, the text"), (2, None), (3, " - "), (4, "one"), (4, "more words")], "doc_id long, text string")
    want = search.lengths(search.postings(docs, "doc_id", ["text"]), "doc_id")
    assert sorted(map(tuple, search.text_lengths(docs, "doc_id", ["text"]).collect())) == sorted(map(tuple, want.collect())) == [(1, 4), (4, 3)]


def test_ranking_reads_each_text_once(spark):
    """postings and lengths are those of separate passes, and what is ranked comes from them, not from the texts again."""
    rows = [(1, "The license, the text", "A the"), (2, None, None), (3, " - ", "the"), (4, "one", ""), (4, "more words", "License"), (5, "\u00c9t\u00e9 the\u00a0the", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, title string")
    index, length = search.counted_postings(docs, "doc_id", ["text", "title"], ["the", "license"])
    sort = lambda df: sorted(map(tuple, df.collect()))
    assert sort(index) == sort(search.postings(docs, "doc_id", ["text", "title"], ["the", "license"]))
    assert sort(length) == sort(search.text_lengths(docs, "doc_id", ["text", "title"])) == [(1, 6), (3, 1), (4, 4), (5, 3)]
    for name in ("bm25_top20", "bm25_scoped"):
        assert not re.search(r"FileScan parquet \[[^\]]*text#", plan(queries.QUERIES[name](spark, SF)))


def test_removal_and_closure_exchange_no_table_for_few_ids(spark):
    """F4, F9."""
    g = P.graph(spark, SF)
    left = mutations.remove_nodes(g, graph.shared(g.nodes.where("kind = 'Document'").select("id")))
    assert "BroadcastHashJoin [source_node_id" in plan(left.evidence) and not exchanges(left.evidence, "source_node_id")
    contents = g.evidence.where("quote LIKE '% red bolt'").select(F.col("id").alias("sha256"))
    out = mutations.generation_closure(Graph(**{**g.frames(), "evidence": g.evidence.withColumn("blob_sha256", F.col("id"))}), contents)
    assert out.evidence.count() == contents.count() > 0 and "l_orderkey" not in plan(out.nodes)
