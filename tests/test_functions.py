import pytest
from evigraph.functions import cells, confidence, jsonx, text
from evigraph.operators import search
from evigraph.providers import checked_links, json_reply, text_window, with_retries
from pyspark.sql import functions as F


def values(spark, rows, f):
    frame = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, c string")
    return [r[0] for r in frame.orderBy("k").select(f(F.col("c"))).collect()]


def test_metric_cells(spark):
    want = {
        "$1.2M": (1.2e6, "USD"), "€1.5K": (1500.0, "EUR"), "12.5%": (12.5, "Percent"), "3,400": (3400.0, "Count"), "100": (100.0, "Count"), "-$1.2M": (-1.2e6, "USD"), "+3,400": (3400.0, "Count"), "n/a": None, "—": None, "Q1 2024": None, "": None, None: None,
        "5d": None, "Infinity": None, "1e3": (1000.0, "Count"), "--5": (5.0, "Count"), "$-5": (-5.0, "USD"), "$12%": (12.0, "Percent"), "5 %": (5.0, "Percent"), "2t": (2e12, "Count"), " 7 ": (7.0, "Count"), "5k%": None, "£ 3 m": (3e6, "GBP"), "¥1b": (1e9, "JPY"), "1e999": None,
    }
    assert [None if v is None else tuple(v) for v in values(spark, want, cells.metric_cell)] == list(want.values())


def test_slugs_and_keys(spark):
    assert values(spark, ["  Net  Revenue!", "Größe (m²)", "", None, "__a__"], text.slugify) == ["net_revenue", "größe_m²", "", None, "a"]
    assert values(spark, ["Größe/B"], text.ascii_slug) == ["gr_e_b"]
    assert values(spark, [" Owned-By ", "É"], text.canon_key) == ["ownedby", ""]
    assert values(spark, ["1.2. Scope", "12 Monkeys", "3.", "1.1 ", "4.5x"], text.strip_clause_number) == ["Scope", "12 Monkeys", "3.", "1.1", "4.5x"]
    assert values(spark, ["1.2Scope  of", "  "], text.category_label) == ["Scope of", "Other"]
    assert values(spark, ["Misc.", "R&D"], text.is_other_label) == [True, False]


def test_aliases(spark):
    assert values(spark, ["drives", "Depends On", "caused by", "OWNED_BY", "x"], text.edge_kind) == ["Influences", "DependsOn", None, "OwnedBy", None]
    assert values(spark, ["Business Function", "prospect", "zzz"], text.node_kind) == ["Function", "Customer", None]
    assert values(spark, ["Lead", "client", "x"], text.lifecycle) == ["prospect", "active", None]


def test_near_names(spark):
    pairs = [("Risk Evaluation", "AI-Assisted Risk Evaluation", True), ("Platform Warranties", "Broker Warranties", False), ("Compliance", "Regulatory Compliance", False), ("risk evaluation", "Risk Evaluation", False)]
    frame = spark.createDataFrame(pairs, "a string, b string, want boolean")
    got = frame.select(text.names_near_match(text.significant_tokens(F.col("a")), text.significant_tokens(F.col("b"))).alias("got"), "want").collect()
    assert all(r["got"] == r["want"] for r in got)


def test_confidence(spark):
    frame = spark.createDataFrame([(0.5, False), (0.5, False), (0.8, True)], "c double, against boolean")
    row = frame.agg(confidence.noisy_or(F.when(~F.col("against"), F.col("c"))), confidence.signed_noisy_or(F.col("c"), F.col("against"))).first()
    assert row[0] == pytest.approx(0.75) and row[1] == pytest.approx(0.15)
    assert frame.limit(0).agg(confidence.noisy_or(F.col("c"))).first()[0] == 0.0
    assert [r[0] for r in spark.createDataFrame([(float("nan"),), (2.0,), (-1.0,), (None,)], "c double").select(confidence.sanitize(F.col("c"))).collect()] == [0.5, 1.0, 0.0, 0.5]


def test_json(spark):
    rows = ['{"a":{"b":"12.5"},"s":"Hi","n":1.0,"t":true,"source_refs":[1]}', "null", None]
    assert values(spark, rows, lambda c: jsonx.number_at(c, "a.b")) == [12.5, None, None]
    assert values(spark, rows, lambda c: jsonx.equals(c, "s", "hI")) == [True, False, False]
    assert values(spark, rows, lambda c: jsonx.equals(c, "t", True)) == [True, False, False]
    assert "source_refs" not in values(spark, rows, jsonx.canonical)[0]
    assert values(spark, ['{"as_of":"x","date":"2024-01-02"}', '{"timestamp":1704067200}', "{}"], jsonx.node_time) == [1704153600, 1704067200, None]


def test_numbers_and_letters(spark):
    frame = spark.createDataFrame([(1.25e9,), (3400.0,), (12.0,), (0.5,)], "c double")
    assert [r[0] for r in frame.select(text.compact_number(F.col("c"))).collect()] == ["1.3B", "3.4K", "12", "0.50"]
    assert [text.column_letter(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "net revenue grew"), (2, "revenue net"), (3, "net-revenue net revenue"), (4, None)], "id long, t string")
    index = search.postings(docs, "id", ["t"])
    assert sorted(r["id"] for r in search.match_all(index, "id", [("q", '"net-revenue"')]).collect()) == [1, 3]
    assert sorted(r["id"] for r in search.match_all(index, "id", [("q", "net revenue"), ("z", " ")]).collect()) == [1, 2, 3]
    best = search.top(search.bm25(index, "id", [("q", "grew")]), "id", 5).collect()
    assert [r["id"] for r in best] == [1] and best[0]["score"] > 0


@pytest.mark.parametrize(("reply", "want"), [("3, 1, 1, 9", [2, 0]), ("NONE", []), ("no idea", [0, 1, 2]), (None, [0, 1, 2])])
def test_rerank(reply, want):
    assert search.rerank(reply, 3) == want


def test_provider_replies():
    assert json_reply('```json\n{"a": [1]}\n```') == {"a": [1]} and json_reply("Sure: [1, 2] done") == [1, 2] and json_reply("no") is None
    assert text_window("ab\ncdé", 6) == "ab" and text_window("é" * 3, 5) == "éé"
    links = [{"from": 0, "to": 1, "kind": "drives"}, {"from": 5, "to": 0, "kind": "drives"}, {"from": 0, "to": 0, "kind": "drives"}, {"from": 0, "to": 1, "kind": "mentioned_in"}]
    assert checked_links(links, ["x"], ["x", "y"]) == [("x", "y", "drives", 0.5)]
    waits, calls = [], []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert with_retries(fails, wait=waits.append) == "done" and waits == [1.0, 2.0]
