import pytest
from evigraph.engine import WORKSPACE, Engine, NotFound
from evigraph.operators import graph
from evigraph.sources.commits import Change
from pyspark.sql import functions as F


@pytest.fixture()
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "space"), now=lambda: 1_700_000_000)


def write(engine, doc, kpis, sha="s", old=None):
    """Puts a document, its KPIs and its mentions of them, in the place of the cached content `old`."""
    rows = lambda name, data: engine.spark.createDataFrame(data, WORKSPACE[name].schema)
    nodes = [(doc, "Document", doc, "{}", 0.9, False, False, 0, 0), *((k, "Kpi", k, "{}", 0.9, False, False, 0, 0) for k in kpis)]
    edges = [(f"{doc}-{k}", doc, k, "MentionedIn", 0.9, "Rule", False, False, 0) for k in kpis]
    cache = rows("document_cache", [(f"{doc}.md", sha, sha, 0, doc)])
    gone = rows("document_cache", [(f"{doc}.md", old, old, 0, doc)]) if old else None
    engine._commit(engine.version(), {"nodes": Change(put=rows("nodes", nodes)), "edges": Change(put=rows("edges", edges)), "document_cache": Change(gone=gone, put=cache)}, "written")


def test_a_signature_is_that_of_a_multiset(spark):
    rows = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "x string, n int")
    of = lambda *frames: graph.signature(*frames).first()["signature"]
    one = of(rows, rows.limit(0))
    assert one == of(rows.orderBy(F.desc("x")).repartition(3), rows.limit(0))
    others = [of(rows.distinct(), rows.limit(0)), of(rows.limit(0), rows), of(rows.na.fill(0), rows.limit(0)), of(rows.select(F.col("n").alias("x"), F.col("x").alias("n")), rows.limit(0))]
    assert len({one, *others}) == 5


def test_summaries_of_documents_follow_their_documents(engine):
    write(engine, "a", ["kpi.churn", "kpi.revenue"])
    with pytest.raises(NotFound):
        engine.suggest_summary(["a"], "cached_only")
    made = engine.suggest_summary(["a"])
    assert made["source"] == "rules" and [x["label"] for x in made["config"]["lenses"]] == ["Kpi"]
    assert sorted(r["node_id"] for r in engine.summary_members(made["scope"]).collect()) == ["kpi.churn", "kpi.revenue"]
    write(engine, "b", ["kpi.retention"])
    assert engine.suggest_summary(["a", "a"]) == {**made, "source": "cache"}
    write(engine, "a", ["kpi.margin"], "t", "s")
    assert engine.suggest_summary(["a"], "cached_only")["source"] == "cache"
    assert engine.suggest_summary(["a"])["source"] == "rules" and engine.suggest_summary(["a"])["source"] == "cache"
    assert engine.suggest_summary(["a"], "regenerate")["source"] == "rules"
    (row,) = engine.resolve_summary(document_ids=["a"])
    assert (row["lens_id"], row["value"], row["health"]) == ("kpi", 3.0, "good")


def test_the_default_summary_is_kept_edited_and_restored(engine):
    assert engine.suggest_summary(["none"])["source"] == "empty"
    write(engine, "a", ["kpi.churn", "kpi.revenue"])
    write(engine, "b", ["kpi.churn"])
    assert engine.suggest_summary()["source"] == "rules"
    assert engine.edit_summary(lens="kpi", label="Figures")["config"]["lenses"][0]["label"] == "Figures"
    assert engine.suggest_summary()["source"] == "config" and engine.resolve_summary()[0]["label"] == "Figures"
    assert engine.restore_summary()["config"]["lenses"][0]["label"] == "Kpi"
    (row,) = engine.resolve_lenses(engine.default_summary()["config"], ["kpi"], ["b"])
    assert row["value"] == 1.0
