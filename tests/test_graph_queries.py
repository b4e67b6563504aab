from collections import defaultdict

import pytest
from evigraph.plans import queries
from evigraph.plans import testgraph as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def g(spark):
    return P.graph(spark, SF, keep=("nodes", "edges"))


def plain_impact(ids, edges, max_depth):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    rows = []
    for start in ids:
        front, seen = {start: start}, {start}
        for depth in range(1, max_depth + 1):
            found = {}
            for node, path in front.items():
                for to in out[node] - seen:
                    found[to] = min(found.get(to, f"{path}>{to}"), f"{path}>{to}")
            rows += [(start, to, depth, path) for to, path in found.items()]
            front = found
            seen |= set(found)
    return sorted(rows)


def test_impact_radius_starts_from_every_node(spark, g):
    kinds = {r.id: r.kind for r in g.nodes.select("id", "kind").collect()}
    edges = [tuple(r) for r in g.edges.select("from_id", "to_id").collect()]
    got = sorted(map(tuple, queries.QUERIES["impact_radius_d3"](spark, SF).collect()))
    assert got == plain_impact(kinds, edges, 3)
    assert {"Customer", "Decision", "Document", "Product", "Kpi", "Function"} <= {kinds[r[0]] for r in got}


def test_neighbours_of_every_node(spark, g):
    edges = [tuple(r) for r in g.edges.select("from_id", "to_id").collect()]
    want = {(a, b) for x, y in edges for a, b in ((x, y), (y, x)) if a != b}
    got = [tuple(r) for r in queries.QUERIES["neighbour_sets"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {i.split(".")[0] for i, _ in got} >= {"action", "customer", "decision", "doc", "function", "kpi", "market", "product"}
