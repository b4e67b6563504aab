import json

import pytest
from evigraph.__main__ import main
from evigraph.engine import Engine
from evigraph.operators import search
from evigraph.operators.textindex import TextIndex


@pytest.fixture()
def run(spark, tmp_path, capsys):
    def call(*args):
        code = main([args[0], "--workspace", str(tmp_path / "space"), *args[1:]], spark)
        out = capsys.readouterr().out
        return code, json.loads(out) if out else None

    return call


def test_commands(run, tmp_path, capsys):
    files = tmp_path / "files"
    files.mkdir()
    (files / "a.md").write_text("# Revenue\n\nwords\n\n# Churn rate\n\nIt fell.\n")
    (files / "b.md").write_text("# Revenue\n\nother\n")
    assert run("init", "--name", "mine") == (0, None)
    assert run("init")[0] == 1
    assert run("index", str(files))[1]["files"] == 2
    assert run("index", str(files), "--skip-unchanged")[1]["changes"] == {"unchanged": 2}
    docs = {d["path"].rsplit("/", 1)[1]: d["id"] for d in run("documents")[1]}
    holders = {"kpi.churn_rate", docs["a.md"]}  # the document by its evidence's quotes
    assert {r["id"] for r in run("search", "churn")[1]} == holders
    assert run("query", "reasoning-search", "words", "--doc", docs["a.md"])[1][0]["title"] == "Revenue"
    assert run("query", "explain-kpi", "kpi.churn_rate")[0] == 0
    assert run("query", "focus-kpi", "kpi.none")[0] == 1
    assert run("export-json", "--out", str(tmp_path / "shot"))[0] == 0
    assert run("stats")[1]["kinds"] == {"Document": 2, "Kpi": 2}
    assert run("remove", "--node-id", docs["a.md"])[0] == 0
    assert run("search", "churn")[1] == []
    assert {r["change"] for r in run("diff", str(tmp_path / "shot"))[1]["nodes"]} >= {"removed"}
    assert run("regenerate", "--node-id", docs["b.md"])[1]["nodes"] >= 1
    assert run("rebuild-page-index")[1] == {"skipped": 0}
    assert run("rebuild-search-index")[0] == 0
    assert run("import-json", str(tmp_path / "shot"))[1]["errors"] == []
    assert {r["id"] for r in run("search", "churn")[1]} == holders


def test_index_follows_its_table(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "index"), "id", ["name", "more"])
    versions = [
        [("a", "red bolt", None), ("b", None, "red"), ("c", "", "")],
        [("a", "blue bolt", None), ("b", None, "red"), ("d", "red red", "nut")],
        [("a", "red bolt", None), ("b", "red", None)],
        [],
    ]
    everything = spark.createDataFrame([(c,) for c in "abcd"], "id string")
    for version, rows in enumerate(versions, 1):
        frame = spark.createDataFrame(rows, "id string, name string, more string")
        index.sync(everything, frame, version)
        assert index.version() == version
        if version == 2:
            index.compact()
        want = search.postings(frame, "id", ["name", "more"])
        for terms in (None, ["red"]):
            told = want if terms is None else want.where("term = 'red'")
            got = index.read(terms).select("id", "field", "pos", "term")
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, told.collect()))
        assert sorted(map(tuple, index.lengths().collect())) == sorted(map(tuple, search.lengths(want, "id").collect()))
    index.rebuild(spark.createDataFrame(versions[1], "id string, name string, more string"), 9)
    assert index.read().count() == 6 and index.version() == 9


def test_only_changed_texts_are_indexed_again(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "space"), now=lambda: 1)
    engine.ingest_text("# Revenue\n\nwords\n", "a.md")
    engine.graph_search("revenue")
    before = {(r["id"], r["part"]) for r in engine._node_index.read().select("id", "part").distinct().collect()}
    engine.ingest_text("# Churn rate\n\nother\n", "b.md")
    assert [r["id"] for r in engine.graph_search("churn", ["Kpi"])] == ["kpi.churn_rate"]
    after = {(r["id"], r["part"]) for r in engine._node_index.read().select("id", "part").distinct().collect()}
    assert before <= after and len(after) > len(before)
    assert engine._node_index.version() == engine.version()
