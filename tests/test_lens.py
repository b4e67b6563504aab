import pytest
from evigraph.operators import categories
from evigraph.plans import lens
from evigraph.schema import Graph, empty_graph
from pyspark.sql import functions as F

NOW = 1_705_320_000
NODE = "id string, kind string, name string, attrs string, confidence double, is_tainted boolean, requires_human_review boolean, created_at long, updated_at long"


def node(id_, kind, name=None, attrs=None, confidence=0.9):
    return (id_, kind, name or id_, attrs, confidence, False, False, 0, 0)


def edge(id_, a, b, kind):
    return (id_, a, b, kind, 0.8, "Rule", False, False, 0)


@pytest.fixture(scope="module")
def g(spark):
    base = empty_graph(spark)
    nodes = [
        node("kpi.a", "Kpi", "Alpha", '{"value":"7","unit":{"Currency":"EUR"}}', 0.6), node("kpi.b", "Kpi", "Beta"), node("kpi.c", "Kpi", "Gamma"), node("p1", "Process", attrs='{"premium":{"value":10.5},"as_of":"2024-01-02","status":"Open"}'), node("p2", "Process", attrs='{"premium":{"value":"4"},"lob":"Motor"}'),
        node("product.motor", "Product", "Motor"), node("doc", "Document"), node("fn", "Function", "Claims"),
    ]
    edges = [edge("e1", "p1", "product.motor", "ForProduct"), edge("e2", "doc", "p1", "MentionedIn"), edge("e3", "kpi.c", "kpi.b", "DerivedFrom"), edge("e4", "fn", "p1", "InFunction")]
    evidence = [("v1", "doc", "Document", "q", None, None, 0, "Rule", 0.7, False, False), ("v2", "doc", "Document", "q", None, None, 0, "Rule", 0.9, False, False)]
    values = [("m1", "kpi.b", "m", 5.0, "USD", None, None, 1_704_000_000, 1_705_000_000, "v1"), ("m2", "kpi.b", "m", 6.0, "USD", None, None, None, 1_704_900_000, "v2"), ("m3", "kpi.b", "m", 8.0, "usd", None, None, 1_704_000_000, 1_704_000_001, "v1"), ("m4", "kpi.c", "m", 9.0, "USD", None, None, None, 1_704_900_000, "v2")]
    make = spark.createDataFrame
    return Graph(make(nodes, NODE), make(edges, base.edges.schema), make(evidence, base.evidence.schema), make([("e2", "v1"), ("e1", "v2"), ("e3", "v1"), ("e4", "v2")], base.edge_evidence.schema), make(values, base.metric_values.schema), base.kpi_candidates, base.document_cache)


def selected(g, selector):
    return sorted(r["id"] for r in lens.wide_nodes(g).where(lens.compile_selector(selector)).collect())


def test_selectors(g):
    facet = lambda name, value: {"type": "facet", "facet": name, "equals": value}
    kind = {"type": "kind", "kind": "process"}
    assert selected(g, kind) == ["p1", "p2"]
    assert selected(g, facet("lob", "MOTOR")) == ["p1", "p2"] and selected(g, facet("function", "claims")) == ["p1"]
    assert selected(g, {"type": "attribute", "field": "status", "equals": "open"}) == ["p1"]
    assert selected(g, {"type": "composite", "and": [kind], "or": []}) == [] and len(selected(g, {"type": "composite", "and": []})) == 8
    assert selected(g, {"type": "composite", "and": [kind], "or": [facet("function", "claims"), {"type": "x"}]}) == ["p1"]
    assert "doc" not in selected(g, {"type": "saved_query", "query": "all_concepts"}) and selected(g, {"type": "saved_query", "query": "x"}) == []


def config(*lenses, **summary):
    return {"summary": {"id": "s", "name": "S", "lenses": [x["id"] for x in lenses if not x.get("child")], **summary}, "lenses": list(lenses)}


def one(g, measure, health=None, selector=None):
    lens_ = {"id": "x", "selector": selector or {"type": "kind", "kind": "Process"}, "measure": measure, "health": health}
    return lens.resolve(g, config(lens_), NOW).first()


def test_count_and_sum(g):
    row = one(g, {"type": "count"}, {"type": "presence"})
    assert (row.value, row.evidence_ids, row.health) == (2.0, ["v1"], "good")
    row = one(g, {"type": "sum", "field": "premium.value"}, {"type": "threshold", "green_lt": 1, "watch_lt": 20, "red_gte": 20})
    assert (row.value, row.health) == (14.5, "watch")
    row = one(g, {"type": "sum", "field": "nothing"})
    assert (row.value, row.state, row.gaps) == (None, "unknown", ["sum_no_numeric_values"])
    row = one(g, {"type": "count", "as_of": "2024-01-31", "period": "mtd"})
    assert row.value == 1.0 and "temporal_scope_partial" in row.gaps
    assert one(g, {"type": "count", "as_of": "Latest"}).gaps == ["invalid_as_of"]
    assert one(g, {"type": "count"}, selector={"type": "facet", "facet": "lob", "equals": "motor"}).evidence_ids == ["v1", "v2"]
    assert one(g, {"type": "count"}, {"type": "presence", "unknown_when": "missing_or_low_confidence"}).health == "unknown"


def test_references(g):
    row = one(g, {"type": "ref_kpi", "kpi": "Beta"}, {"type": "confidence"})
    assert (row.value, row.confidence, row.observed_at, row.gaps, row.health) == (6.0, 0.9, 1_704_900_000, ["conflicting_observations"], "good")
    assert one(g, {"type": "ref_kpi", "kpi": "b"}, {"type": "conflict"}).health == "unknown"
    row = one(g, {"type": "ref_kpi", "kpi": "kpi.b", "as_of": "2024-01-05"}, {"type": "freshness", "max_age_days": 10})
    assert (row.value, row.health) == (5.0, "unknown")
    row = one(g, {"type": "ref_kpi", "kpi": "kpi.a"})
    assert (row.value, row.unit, row.gaps) == (7.0, "EUR", ["resolved_from_attrs_without_observation"])
    assert one(g, {"type": "ref_kpi", "kpi": "none"}).gaps == ["kpi_not_found"]
    row = one(g, {"type": "derived", "kpi": "kpi.c"})
    assert (row.value, row.confidence, sorted(row.evidence_ids), row.state) == (9.0, 0.9, ["v2"], "resolved")
    row = one(g, {"type": "derived", "kpi": "kpi.c", "inputs": ["kpi.b", "kpi.zzz"]})
    assert row.state == "unknown" and row.explanation == "unresolved inputs: kpi.zzz"


def test_contexts_and_edits():
    a = {"id": "a", "selector": {"type": "kind", "kind": "Process"}, "measure": {"type": "count", "period": "ytd"}, "children": ["b"]}
    b = {"id": "b", "child": True, "selector": {"type": "attribute", "field": "status", "equals": "Open"}, "measure": {"type": "count"}}
    found = lens.contexts(config(a, b, as_of="2024-01-01"))
    assert len(found["b"]["selector"]["and"]) == 2 and found["b"]["period"] == "ytd" and found["b"]["as_of"] == "2024-01-01"
    with pytest.raises(lens.LensError, match="cycle"):
        lens.contexts(config(a, {**b, "children": ["a"]}))
    with pytest.raises(lens.LensError, match="unknown child"):
        lens.validate(config({**a, "children": ["zz"]}))
    with pytest.raises(lens.LensError, match="branch"):
        lens.validate(config({**a, "children": [], "selector": {"type": "composite"}}))
    two = config({**a, "children": []}, {**b, "child": False})
    assert lens.edit(two, order=["b"])["summary"]["lenses"] == ["b", "a"] and two["summary"]["lenses"] == ["a", "b"]
    assert lens.edit(two, lens="a", measure_as_of="2024-02-01", label="L")["lenses"][0]["measure"]["as_of"] == "2024-02-01"
    with pytest.raises(lens.LensError):
        lens.edit(two, order=["zz"])
    assert lens.parse_as_of("2024-01-01") == 1704153599 and lens.parse_as_of("2024-01-01T00:00:00Z") == 1704067200
    made = lens.from_categories([{"label": "A b", "members": ["x"]}, {"label": "a B", "members": ["x", "y"]}, {"label": "!", "members": []}], {"x": "Kpi", "y": "Risk"})
    assert made["summary"]["lenses"] == ["a_b", "a_b_2", "lens_3"] and len(made["lenses"][1]["selector"]["or"]) == 2


def test_age_is_that_of_the_newest_evidence(g, spark):
    day = 86400
    rows = [(f"w{k:02d}", "doc" if k % 2 else "gone", "Document", "q", None, None, None if k == 7 else NOW - (40 - k) * day, "Rule", 0.7, False, False) for k in range(40)]
    pairs = [("e2", f"w{k:02d}") for k in range(36)] + [("e1", f"w{k:02d}") for k in range(20, 40)]
    h = Graph(**{**g.frames(), "evidence": spark.createDataFrame(rows, g.evidence.schema), "edge_evidence": spark.createDataFrame(pairs, g.edge_evidence.schema)})
    fresh = {"type": "freshness", "max_age_days": 10}
    row = one(h, {"type": "count"}, fresh)
    assert row.evidence_ids == [f"w{k:02d}" for k in range(24)] and row.n_evidence == 24
    assert (row.observed_at, row.lineage_at, row.health) == (None, NOW - 17 * day, "unknown")
    row = one(h, {"type": "sum", "field": "premium.value"}, fresh)
    assert row.n_evidence == 32 and (row.lineage_at, row.health) == (NOW - 9 * day, "good")
    facet = {"type": "facet", "facet": "lob", "equals": "motor"}
    row = one(h, {"type": "count"}, fresh, facet)
    assert row.n_evidence == 40 and len(set(row.evidence_ids)) == 40 and (row.lineage_at, row.health) == (NOW - day, "good")
    assert one(h, {"type": "count"}, fresh, {"type": "kind", "kind": "Risk"}).lineage_at is None
    lines = lens.evidence(h, config({"id": "x", "selector": facet, "measure": {"type": "count"}}), NOW).collect()
    assert sorted((r.evidence_id, r.edge_id, r.step) for r in lines) == [(f"w{k:02d}", "e2" if k < 24 else "e1", "mention" if k < 24 else "facet") for k in range(24)] + [(f"w{k:02d}", "e1", "facet") for k in range(24, 40)]
    assert {(r.source_node_id, r.source_node_name) for r in lines} == {("doc", "doc"), ("gone", "gone")}


def test_a_lens_keeps_few_rows_of_each_task(g, spark):
    x = {"id": "x", "selector": {"type": "kind", "kind": "Process"}, "measure": {"type": "count"}}
    plan = lens.evidence(g, config(x), NOW)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_suggested_categories(g, spark):
    class Model:
        def categories(self, names, kinds):
            at = [k for k, x in enumerate(kinds) if x == "Kpi"]
            return [{"label": "Numbers", "members": [*at, 99, "no"], "headline": at[0] if at else None}, {"label": " ", "members": [0]}, {"label": "Work", "members": [k for k, x in enumerate(kinds) if x == "Process"]}, {"label": "Odd", "members": 3}]

    for batch in (200, 2):
        said = categories.suggested(g.nodes, Model(), batch)
        got = sorted((r["label"], r["node_id"]) for r in said.collect())
        assert got == [("Numbers", "kpi.a"), ("Numbers", "kpi.b"), ("Numbers", "kpi.c"), ("Work", "p1"), ("Work", "p2")]
    rows = categories.repair(said.select("*"), g.nodes, g.edges).collect()
    labels = {r["node_id"]: r["label"] for r in rows}
    assert labels["kpi.c"] == "Numbers" and labels["p2"] == "Work" and len(labels) == 7


def test_category_repair(g, spark):
    suggested = spark.createDataFrame([(1, "1.1 Numbers", "kpi.a", 0, False), (1, "1.1 Numbers", "kpi.b", 1, True), (2, "numbers", "kpi.c", 0, False), (2, "numbers", "kpi.a", 1, False), (3, "Work", "p1", 0, False), (3, "Work", "gone", 1, False)], "idx int, label string, node_id string, pos int, headline boolean")
    rows = categories.repair(suggested, g.nodes, g.edges).collect()
    labels = {r["node_id"]: r["label"] for r in rows}
    assert labels["kpi.c"] == "Numbers" and labels["p1"] == "Work" and set(labels) == {r["id"] for r in g.nodes.where(F.col("kind") != "Document").collect()}
    assert sum(r["is_headline"] for r in rows) == len(set(labels.values()))
