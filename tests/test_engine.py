import json

import pytest
from evigraph.engine import WORKSPACE, Engine, NotFound, ToolServer
from evigraph.operators import extract, mutations, tree
from evigraph.sources import parse, snapshot
from evigraph.sources.commits import Change, Commits, Conflict

REVIEW = """# Quarterly review

Opening words.

# Net revenue

It grew by a tenth.

# Churn rate

It fell.

# Gross margin

It held.

# Outlook

A lower churn rate drives net revenue in every region.

A falling gross margin would limit net revenue growth.
"""
NOW = 1_700_000_000


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "space"), now=lambda: NOW)


def test_review_document(engine):
    got = engine.ingest_text(REVIEW, "review.md")
    assert got["files"] == 1 and got["errors"] == [] and (got["nodes"], got["edges"], got["evidence"]) == (4, 5, 3)
    g = engine.graph()
    kinds = sorted((r["from_id"], r["to_id"], r["kind"]) for r in g.edges.where("kind <> 'MentionedIn'").collect())
    assert kinds == [("kpi.net_revenue", "kpi.churn_rate", "Influences"), ("kpi.net_revenue", "kpi.gross_margin", "Blocks")]
    assert g.edges.join(g.edge_evidence.withColumnRenamed("edge_id", "id"), "id", "left_anti").count() == 0
    assert {r["section"] for r in engine.focus_kpi("kpi.churn_rate")} == {"driver"}
    assert "Churn rate" in engine.explain_kpi("kpi.churn_rate")["rationale"]
    assert [r["node_id"] for r in engine.impact_radius("kpi.net_revenue")] == ["kpi.churn_rate", "kpi.gross_margin"]
    assert engine.graph_stats()["kinds"] == {"Document": 1, "Kpi": 3}
    assert {r["name"] for r in engine.graph_search("churn", ["Kpi"])} == {"Churn rate"} and engine.graph_search("  ") == []
    found = engine.reasoning_search("churn rate")
    assert found[0]["title"] == "Churn rate"
    assert engine.list_documents()[0]["n_mentions"] == 3
    with pytest.raises(NotFound):
        engine.focus_kpi("kpi.nothing")
    again = engine.ingest_text(REVIEW, "review.md")
    assert again["changes"] == {"unchanged": 1} and engine.graph().edges.count() == 5


def test_removal_keeps_what_others_mention(engine):
    engine.ingest_text("# Revenue\n\nwords\n\n# Churn\n", "a.md")
    engine.ingest_text("# Revenue\n\nother words\n\n# Retention\n", "b.md")
    doc = next(d["id"] for d in engine.list_documents() if d["path"] == "a.md")
    engine.remove_document(doc)
    ids = {r["id"] for r in engine.graph().nodes.collect()}
    assert "kpi.revenue" in ids and "kpi.retention" in ids and "kpi.churn" not in ids and doc not in ids


def test_cosmetic_change_and_table_value(engine):
    engine.ingest_text("# Revenue\n\nfirst\n\n| Name | Q1 | Note |\n|---|---|---|\n| Revenue | n/a | $1.2M |\n", "a.md")
    assert engine.graph().metric_values.select("kpi_node_id", "value", "unit").collect()[0] == ("kpi.revenue", 1_200_000.0, "USD")
    assert engine.ingest_text("# revenue\n\nsecond text\n\n| Name | Q1 | Note |\n|---|---|---|\n| Revenue | n/a | $1.2M |\n", "a.md")["changes"] == {"cosmetic": 1}


def test_policy_and_claim_tables(spark):
    text = "| Policy Number | Insured | LOB | Written Premium |\n|---|---|---|---|\n| P-1 | Acme Corp | Motor | $1,200 |\n| | Beta | | |\n\n| Claim ID | Policy | Incurred | Status |\n|---|---|---|---|\n| C/9 | P-1 | 500 | open |\n"
    docs = parse.inline_documents(spark.createDataFrame([("t.md", text)], "path string, text string"))
    facts = extract.policy_tables(docs, NOW)
    nodes = {r["name"]: r for r in facts["nodes"].collect()}
    assert {"Policy P-1", "Policy Row 2", "Claim C/9", "Acme Corp", "Beta", "Motor"} == set(nodes)
    assert json.loads(nodes["Policy P-1"]["attrs"])["premium"] == {"value": 1200.0, "unit": "USD"} and nodes["Claim C/9"]["id"].endswith(".c_9")
    assert sorted(r["kind"] for r in facts["edges"].collect()) == ["ForProduct", "MentionedIn", "MentionedIn", "MentionedIn", "OwnedBy", "OwnedBy"]


def test_bridges(spark):
    new = spark.createDataFrame([("a", "AI-Assisted Risk Evaluation"), ("b", "Compliance"), ("c", "Platform Warranties")], "id string, name string")
    known = spark.createDataFrame([("x", "Risk Evaluation"), ("y", "Regulatory Compliance"), ("z", "Broker Warranties"), ("a", "Risk Evaluation")], "id string, name string")
    assert [tuple(r) for r in extract.near_names(new, known).collect()] == [("a", "x")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("# A\nx\n## B\ny\n### C\n# D\nz\n", [("A", None, 0, "A", "x"), ("B", 0, 0, "A › B", "y"), ("C", 1, 0, "A › B › C", None), ("D", None, 1, "D", "z")]),
        ("before\n\n# A\n\n### C\n\n## B\n", [("A", None, 0, "A", None), ("C", 0, 0, "A › C", None), ("B", 0, 1, "A › B", None)]),
        ("only text\n\nmore\n", [("Document", None, 0, "Document", "only text\nmore")]),
        ("", []),
        ("# A\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n# B\n\nend\n", [("A", None, 0, "A", None), ("B", None, 1, "B", "end\na | b\n1 | 2")]),
    ],
)
def test_section_trees(spark, text, want):
    docs = parse.inline_documents(spark.createDataFrame([("t.md", text)], "path string, text string"))
    rows = tree.document_sections(tree.sections(docs), docs.first()["id"]).collect()
    number = {r["section_id"]: k for k, r in enumerate(rows)}
    assert [(r["title"], number.get(r["parent_section_id"]), r["ordinal"], r["path"], r["text"]) for r in rows] == want


def test_log_replay_and_rules(spark):
    def row(seq, op, id_, **payload):
        return (1, seq, op, id_, json.dumps(payload))

    node = lambda seq, id_, name, at: row(seq, "upsert_node", id_, id=id_, kind="Risk", name=name, created_at=at, updated_at=at, confidence=0.5, is_tainted=False, requires_human_review=False)
    edge = lambda seq, id_, a, b, ev, kind="Blocks": row(seq, "upsert_edge", id_, id=id_, from_id=a, to_id=b, kind=kind, confidence=0.5, evidence_ids=ev)
    rows = [
        node(1, "a", "A", 10), node(2, "b", "B", 11), node(3, "a", "A2", 12), row(4, "upsert_evidence", "v", id="v", source_node_id="a", confidence=0.5), edge(5, "e", "a", "b", ["v"]), edge(6, "e", "b", "a", ["v"], "Causes"),
        edge(7, "f", "a", "b", []), edge(8, "g", "a", "nobody", ["v"]), edge(9, "h", "a", "b", ["w"]), row(10, "delete_node", "z"), row(11, "upsert_evidence", "x", id="x", source_node_id="nobody"), node(12, "c", "C", 13), row(13, "delete_node", "c"),
    ]
    from evigraph.schema import empty_graph

    log = spark.createDataFrame(rows, mutations.LOG)
    accepted, errors = mutations.validate(log, empty_graph(spark))
    assert {r["id"]: r["error"] for r in errors.collect()} == {"f": "an edge needs evidence", "g": "an end is missing", "h": "evidence is missing", "z": "it does not exist", "x": "source node is missing"}
    g = mutations.state(accepted)
    assert {r["id"]: (r["name"], r["created_at"]) for r in g.nodes.collect()} == {"a": ("A2", 10), "b": ("B", 11)}
    assert [(r["from_id"], r["to_id"], r["kind"]) for r in g.edges.collect()] == [("a", "b", "Causes")]
    twice = mutations.state(accepted.unionByName(accepted))
    assert sorted(map(tuple, twice.nodes.collect())) == sorted(map(tuple, g.nodes.collect())) and twice.edges.count() == 1
    assert mutations.remove_nodes(g, spark.createDataFrame([("b",)], "id string")).edges.count() == 0


def test_snapshot_round_trip(engine, spark, tmp_path):
    engine.ingest_text(REVIEW, "review.md")
    engine.export(str(tmp_path / "snap"))
    other = Engine(spark, str(tmp_path / "other"), now=lambda: NOW)
    assert other.import_snapshot(str(tmp_path / "snap"))["errors"] == []
    a, b = engine.graph(), other.graph()
    for name in ("nodes", "edges", "evidence", "edge_evidence"):
        x, y = getattr(a, name), getattr(b, name)
        assert sorted(map(str, x.select(*sorted(x.columns)).collect())) == sorted(map(str, y.select(*sorted(x.columns)).collect())), name
    got = engine.graph_diff(str(tmp_path / "snap"), str(tmp_path / "snap"))
    assert got == {"nodes": [], "edges": [], "warnings": []}
    (tmp_path / "bad" / "head").mkdir(parents=True)
    (tmp_path / "bad" / "head" / "part.txt").write_text('{"schema_version": 9}\n')
    with pytest.raises(ValueError, match="version"):
        snapshot.load(spark, str(tmp_path / "bad"))


def test_tool_server(engine):
    engine.ingest_text(REVIEW, "review.md")
    server = ToolServer(engine)
    ask = lambda **m: server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, **m}))
    assert server.handle("{")["error"]["code"] == -32700 and server.handle("[]")["error"]["code"] == -32600
    assert ask(method="tools/list")["error"]["code"] == -32600
    assert ask(method="initialize", params={"protocolVersion": "2024-11-05"})["result"]["protocolVersion"] == "2024-11-05"
    assert len(ask(method="tools/list")["result"]["tools"]) == 10 and ask(method="nope")["error"]["code"] == -32601
    assert ask(method="tools/call", params={"name": "focus_kpi"})["error"]["code"] == -32602
    assert ask(method="tools/call", params={"name": "focus_kpi", "arguments": {"kpi_id": "kpi.none"}})["result"]["isError"]
    assert not ask(method="tools/call", params={"name": "graph_stats", "arguments": {}})["result"]["isError"]
    assert server.handle(json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"})) is None


def test_html_and_sheets():
    text = "<nav><ul><li><a>Home</a></li></ul></nav><h1>Top &amp; more</h1><p>One<br>two</p><ul><li>x <p>inner</p></li></ul><pre><code class='language-py'>a = 1\n</code></pre><table><tr><th>A</th><th>B|C</th></tr><tr><td>1</td><td><p>2</p></td></tr></table><script>var t='</p>';</script>"
    got = parse.parse_document("x.html", text.encode())
    assert got["title"] == "Top & more" and got["tables"][0]["headers"] == ["A", "B|C"] and got["tables"][0]["rows"] == [["1", "2"]]
    assert [(b["kind"], b["text"]) for b in got["blocks"]] == [("list_item", "Home"), ("heading", "Top & more"), ("paragraph", "One two"), ("list_item", "x inner"), ("paragraph", "inner"), ("code", "a = 1")]
    sheet = parse.parse_document("s.csv", b"a,b\n1,2\n")
    assert sheet["title"] == "s" and sheet["tables"][0]["headers"] == ["a", "b"]
    assert parse.parse_document("s.csv", b"a,\n1,2\n")["tables"][0]["headers"] == ["A", "B"]
    assert parse.parse_document("x.MD", b"# a")["error"] and parse.parse_document("x", b"")["error"] and parse.parse_document("x.pdf", b"")["error"]
    large = "# Data\n\n| a |\n|---|\n" + "| 1 |\n" * 201
    assert parse.parse_markdown(large)["blocks"] == [] and len(parse.parse_markdown(large)["tables"][0]["rows"]) == 201


def model():
    """A provider whose first call fails; it names one concept and relates each pair. A class in a function goes to the workers by value."""

    class Model:
        failed = False

        def entities(self, text):
            if not type(self).failed:
                type(self).failed = True
                error = RuntimeError("busy")
                error.retry_after = 0.01
                raise error
            return [{"name": "2.1 North region", "kind": "market", "quote": "every region"}]

        def relation(self, text, a, b):
            return {"kind": "influences", "confidence": 0.55}

        def summarize(self, title, text, below):
            return f"{title} over {len(below)}"

    return Model()


def test_provider_steps(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "space"), now=lambda: NOW, provider=model())
    engine.ingest_text(REVIEW, "review.md")
    g = engine.graph()
    made = g.nodes.where("is_tainted").collect()
    assert [r["id"] for r in made] == ["market.north_region"] and made[0]["confidence"] == 0.5
    assert g.edges.where("created_by = 'Llm' AND kind = 'MentionedIn'").count() == 1
    engine.summarize_sections()
    assert {r["summary"] for r in engine.sections().where("title = 'Outlook'").collect()} == {"Outlook over 0"}


def test_regeneration_keeps_the_rest(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "space"), now=lambda: NOW)
    folder = tmp_path / ".hidden" / "docs"
    folder.mkdir(parents=True)
    (folder / "review.md").write_text(REVIEW)
    (folder / "other.md").write_text("# Churn rate\n\nwords\n")
    (folder / ".secret.md").write_text("# Gross margin\n")
    assert engine.ingest_folder(str(folder))["files"] == 2
    rows = lambda: {n: sorted(map(str, f.drop("created_at", "updated_at").collect())) for n, f in engine.graph().frames().items()}
    before, sections = rows(), engine.sections().count()
    doc = next(r["id"] for r in engine.list_documents() if r["n_mentions"] == 3)
    assert engine.regenerate_document(doc)["edges"] > 0
    assert rows() == before and engine.sections().count() == sections
    with pytest.raises(NotFound):
        engine.regenerate_document("doc.none")


def test_generations(engine, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.md").write_text("# Revenue\n\nwords\n")
    (folder / "b.md").write_text("# Churn\n\nwords\n")
    engine.ingest_folder(str(folder))
    paths = [r["path"] for r in engine.graph().document_cache.collect()]
    one = engine.create_generation("one", [p for p in paths if p.endswith("a.md")] + ["nowhere.md"])
    engine.create_generation("all")
    assert {(g["name"], g["files"]) for g in engine.list_generations()} == {("one", 1), ("all", 2)}
    g = engine.generation(one)
    assert {r["id"] for r in g.nodes.where("kind = 'Kpi'").collect()} == {"kpi.revenue"} and g.document_cache.count() == 1
    engine.export_generation(one, str(tmp_path / "out"))
    assert snapshot.load(engine.spark, str(tmp_path / "out")).nodes.count() == 2
    with pytest.raises(NotFound):
        engine.generation("gen.none")
    assert [e["kind"] for e in engine.events()] == ["ingested", "generation", "generation"] and len(engine.events(after=2)) == 1
    assert [r["name"] for r in engine.list_page("a.md", 7, 1)] == [r["name"] for r in engine.list_documents() if r["path"].endswith("a.md")]


def test_jobs_write_back(engine):
    engine.ingest_text(REVIEW, "review.md")
    engine.ingest_text(REVIEW.replace("Quarterly", "Monthly"), "second.md")
    got = {r["kpi_id"]: r for r in engine.recompute_kpis()}
    nodes = {r["id"]: r for r in engine.graph().nodes.where("kind = 'Kpi'").collect()}
    assert all(abs(nodes[k]["confidence"] - r["confidence"]) < 1e-9 and json.loads(nodes[k]["attrs"])["trend"] == r["trend"] for k, r in got.items())
    assert engine.graph().nodes.where("kind = 'Document'").count() == 2
    found = engine.discover_kpis(by_edges=True)
    pending = engine.graph().kpi_candidates.collect()
    assert {r["detected_in"][0] for r in pending} == {r["kpi_id"] for r in found} and {r["status"] for r in pending} <= {"pending"}
    assert engine.discover_kpis(by_edges=True) == []


def test_a_batch_counts_whole_or_not_at_all(spark, engine):
    engine.ingest_text(REVIEW, "review.md")
    version, nodes = engine.version(), engine.graph().nodes.count()
    node = json.dumps({"id": "kpi.new", "kind": "Kpi", "name": "New", "attrs": "{}", "confidence": 1.0, "is_tainted": False, "requires_human_review": False, "created_at": 1, "updated_at": 1})
    good = [(1, 0, "upsert_node", "kpi.new", node)]
    bad = [*good, (1, 1, "delete_node", "kpi.nothing", None)]
    with pytest.raises(mutations.Rejected) as refused:
        engine.apply(spark.createDataFrame(bad, mutations.LOG))
    assert refused.value.errors[0]["id"] == "kpi.nothing" and engine.version() == version and engine.graph().nodes.count() == nodes
    assert engine.apply(spark.createDataFrame(good, mutations.LOG)) == version + 1
    assert engine.graph().nodes.count() == nodes + 1 and engine.graph().edges.count() == 5
    assert [r["id"] for r in engine.nodes_by_id(["kpi.new", "kpi.none"]).collect()] == ["kpi.new"]


def test_numbers_of_a_log_are_unique(spark):
    from pyspark.sql import functions as F

    nodes = spark.range(400).repartition(200).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    log = mutations.log_rows([("upsert_node", nodes), ("upsert_evidence", nodes)], 1)
    assert log.count() == log.select("seq").distinct().count() == 800
    last = log.groupBy("op").agg(F.min("seq").alias("low"), F.max("seq").alias("high")).collect()
    high = {r["op"]: (r["low"], r["high"]) for r in last}
    assert high["upsert_node"][1] < high["upsert_evidence"][0]


def test_recomputed_attributes_keep_their_types(spark, engine):
    engine.ingest_text(REVIEW, "review.md")
    attrs = {"target": 12, "ok": True, "deep": {"x": {"y": 3}}, "tags": ["a", 1], "none": None, "share": 0.5, "text": 'a "b"', "trend": "old"}
    node = engine.nodes_by_id(["kpi.churn_rate"]).first().asDict() | {"attrs": json.dumps(attrs)}
    engine.apply(spark.createDataFrame([(1, 0, "upsert_node", node["id"], json.dumps(node))], mutations.LOG))
    rows = {r["kpi_id"]: r for r in engine.recompute_kpis()}
    got = json.loads(engine.nodes_by_id(["kpi.churn_rate"]).first()["attrs"])
    told = {k: v for k in ("trend", "value") if (v := rows["kpi.churn_rate"][k]) is not None}
    assert got == {k: v for k, v in attrs.items() if k != "trend"} | told and "trend" in told


def test_a_change_writes_what_it_changes(spark, engine, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.md").write_text(f"# Revenue {k}\n\nwords\n")
    engine.ingest_folder(str(folder))
    engine.compact()
    assert engine.stale_documents().isEmpty()
    engine.remove_document(next(d["id"] for d in engine.list_documents() if d["path"].endswith("1.md")))
    written = {p["table"]: (p["kind"], p["rows"]) for p in engine.log.manifest(engine.version())["wrote"]}
    assert written["nodes"] == ("gone", 2) and {written[t] for t in ("sections", "document_cache", "edges", "blobs")} == {("gone", 1)}
    g = engine.graph()
    assert g.nodes.count() == 4 and g.edges.count() == 2 and engine.sections().count() == 2 and engine.log.read("blobs").count() == 2
    assert sorted(r["node"] for r in engine.neighbours(["kpi.revenue_0", "kpi.revenue_1"]).collect()) == ["kpi.revenue_0"]
    stale = engine.sections().where("title = 'Revenue 0'")
    engine.log.commit(engine.version(), {"sections": Change(gone=stale)}, "broken")
    assert engine.stale_documents().count() == 1


def _rows_of(spark, n):
    """Nodes and edges from the first one to all others."""
    nodes = spark.range(n).selectExpr("concat('n', id) AS id", "'Risk' AS kind", "concat('N', id) AS name", "'{}' AS attrs", "1D AS confidence", "false AS is_tainted", "false AS requires_human_review", "1L AS created_at", "1L AS updated_at")
    edges = spark.range(1, n).selectExpr("concat('e', id) AS id", "'n0' AS from_id", "concat('n', id) AS to_id", "'Blocks' AS kind", "1D AS confidence", "'Rule' AS created_by", "false AS is_tainted", "false AS requires_human_review", "1L AS created_at")
    return {"nodes": Change(put=nodes), "edges": Change(put=edges)}


def test_point_reads_open_few_files(spark, engine):
    engine._commit(0, _rows_of(spark, 300), "made")
    engine.compact()
    one, near = engine.nodes_by_id(["n7"]), engine.neighbours(["n7"])
    assert one.count() == 1 and len(one.inputFiles()) * 8 <= len(engine.log.read("nodes").inputFiles())
    assert [(r["other"], r["outgoing"]) for r in near.collect()] == [("n0", False)] and len(near.inputFiles()) * 8 <= len(engine.log.read("adjacency").inputFiles())


def test_a_writer_that_stops_after_any_step_leaves_the_old_state(spark, engine, monkeypatch):
    """Whichever part, or the commit itself, fails to be written, readers see the old state, and the next commit lands whole."""
    engine._commit(0, _rows_of(spark, 3), "made")
    write = Commits._written
    for step in range(4):
        done = []

        def stops(self, *args, step=step, done=done):
            if len(done) == step:
                raise RuntimeError("stopped")
            done.append(args)
            return write(self, *args)

        monkeypatch.setattr(Commits, "_written", stops)
        if step == 3:  # nodes, edges and adjacency are written: the commit stops
            monkeypatch.setattr(Commits, "_publish", lambda self, m: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError, match="stopped"):
            engine._commit(1, _rows_of(spark, 5), "more")
        monkeypatch.undo()
        assert engine.version() == 1 and engine.graph().nodes.count() == 3 and len(engine.events()) == 1
    engine._commit(1, _rows_of(spark, 5), "more")
    engine.drop_versions(1, grace=0)
    assert engine.graph().nodes.count() == 5 and engine.graph().edges.count() == 4 and engine.log.numbers() == [2]


def test_upkeep(spark, engine, tmp_path):
    flagged = [("a", "Risk", True, 0.5), ("b", "Risk", True, 0.9), ("c", "Kpi", True, 0.5), ("d", "Risk", False, 0.5)]
    nodes = spark.createDataFrame([(i, kind, i, "{}", c, tainted, True, 1, 1) for i, kind, tainted, c in flagged], WORKSPACE["nodes"].schema)
    blobs = spark.createDataFrame([(s, bytearray(b"x")) for s in "xyz"], WORKSPACE["blobs"].schema)
    cache = spark.createDataFrame([("p", "x", "s", 1, "a"), ("q", "x", "s", 1, "b"), ("r", "y", "s", 1, "c")], WORKSPACE["document_cache"].schema)
    engine._commit(0, {"nodes": Change(put=nodes), "blobs": Change(put=blobs), "document_cache": Change(put=cache)}, "made")
    assert engine.clear_review_flags() == 1
    assert [r["id"] for r in engine.sql("SELECT id FROM t_nodes WHERE requires_human_review ORDER BY id", "t_").collect()] == ["b", "c", "d"]
    assert {tuple(r) for r in engine.blob_use().collect()} == {("x", 2), ("y", 1), ("z", 0)}
    assert engine.drop_unused_blobs() == 1 and {r["sha256"] for r in engine.log.read("blobs").collect()} == {"x", "y"}
    for name in ("a.md", "b.exe", "plain", "node_modules/c.md"):
        path = tmp_path / "docs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
    got = {r["path"].rsplit("/", 1)[1]: (r["supported"], r["reason"]) for r in engine.preview(str(tmp_path / "docs")).collect()}
    assert got == {"a.md": (True, None), "b.exe": (False, "unsupported: .exe"), "plain": (False, "no extension")}


def test_an_ingest_that_another_writer_overtakes_raises(spark, engine, monkeypatch):
    facts = Engine._facts

    def slow(self, *args):
        self._commit(self.version(), _rows_of(spark, 2), "between")
        return facts(self, *args)

    monkeypatch.setattr(Engine, "_facts", slow)
    with pytest.raises(Conflict, match="nodes"):
        engine.ingest_text("# Margin\n", "c.md")
    assert engine.graph().nodes.count() == 2 and [e["kind"] for e in engine.events()] == ["between"] and engine.sections().isEmpty()


def test_many_sections(spark):
    from evigraph.schema import NORMALIZED

    blocks = []
    for k in range(10_050):
        blocks.append(("heading", 1 + k % 3, f"h{k}", None, 0, 0))
        blocks.append(("paragraph", 0, f"p{k}", None, 0, 0))
    docs = spark.createDataFrame([("doc.x", "x.md", "s", "x", blocks, [], None)], NORMALIZED)
    got = tree.document_sections(tree.sections(docs), "doc.x").collect()
    assert len(got) == len({r["section_id"] for r in got}) == 10_050
    assert [r["title"] for r in got] == [f"h{k}" for k in range(10_050)] and got[-1]["text"] == "p10049"
    assert got[2]["path"] == "h0 › h1 › h2" and got[5]["parent_section_id"] == got[4]["section_id"] and got[10_049]["path"] == "h10047 › h10048 › h10049"
