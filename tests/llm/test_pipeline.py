import hashlib
import re
from collections import Counter

import corpus_pipeline as pipeline
from evigraph.llm import common as C
from evigraph.llm import langid
from test_simhash import plain as plain_components
from test_winnowing import plain as plain_contamination

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, sample):
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "tokens"]
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    docs, rows = sample, sample.collect()
    for name, stage in pipeline.STAGES[:-1]:
        path = C.fresh_dir(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        assert out.columns == sample.columns
        got = out.collect()
        if name == "near_duplicates":
            keep = {i for i, _, c in plain_components([(r.doc_id, r.text) for r in rows]) if i == c}
            assert sorted(r.doc_id for r in got) == sorted(keep)
        elif name == "decontaminate":
            bad = {x[0] for x in plain_contamination([(r.doc_id, r.text) for r in rows], bench) if x[5]}
            assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in rows if r.doc_id not in bad)
        elif name == "mix":
            assert {r.doc_id for r in got} <= {r.doc_id for r in rows}
        else:
            assert {r.doc_id for r in rows} - {r.doc_id for r in got} == {r.doc_id for r in rows if not any(ch.isalpha() for ch in r.text or "")}
        docs, rows = out, got
    last = sorted(pipeline.STAGES[-1][1](spark, docs, SF).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in last] == sorted(r.doc_id for r in rows)
    assert all(b.start == a.start + a.n_tokens for a, b in zip(last, last[1:]))


def test_edges(spark, edge, empty):
    kept = pipeline.language(spark, edge, SF)
    assert not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    single = pipeline.near_duplicates(spark, edge, SF).collect()
    ids = [r.doc_id for r in single]
    assert 6 in ids and 7 not in ids and ids.count(8) == 1 and None in ids
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_odd_column_names(spark, edge, odd):
    for name, stage in pipeline.STAGES[:-1]:
        want, got = stage(spark, edge, SF), stage(spark, odd, SF)
        assert got.columns == odd.columns, name
        pairs = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows.collect()), key=repr)
        assert pairs(got) == pairs(want)
        assert all(r["a b"] == "a b" and r["x.y"] == "x.y" and r["a`b"] == "a`b" for r in got.collect())
    assert pipeline.tokens(spark, odd, SF).count() == odd.count()


def test_mix_against_plain_python(spark, sample):
    rows = [(r.doc_id, r.text, r.source) for r in sample.collect()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, text, source in rows:
        sums[source] = sums.get(source, 0) + size(text)
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, left, target = 1.5 * sum(sums.values()), set(sums), {}
    while True:  # share by weight; what is above twice a source's size is shared again
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s for s in left if share[s] > 2 * sums[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * sums[s] for s in over}
        left -= over
    want = Counter()
    for doc_id, _, source in rows:
        rate = target[source] / sums[source]
        draw = int(hashlib.md5(f"mix{doc_id}".encode()).hexdigest()[:13], 16) / 2**52
        want[doc_id] += int(rate) + (draw < rate - int(rate))
    got = Counter(r.doc_id for r in pipeline.mix(spark, sample, SF).collect())
    assert got == +want


def test_stage_folders_are_removed(spark):
    import pathlib

    root = pathlib.Path(C.shared_dir(spark).removeprefix("file:"))
    before = {p.name for p in root.glob("pipeline-*")}
    rows = pipeline.run(spark, SF)
    assert rows.count() > 0
    assert sorted(p.name.split("-")[1] for p in root.glob("pipeline-*") if p.name not in before) == ["ids"]


def test_of_rows_with_one_id_and_text_the_first_stays(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{k}" for k in range(40))
    rows = [(1, text, "fr", "b", 2), (1, text, "en", "a", 9), (1, text, None, "c", 1), (2, text, "de", "a", 0), (None, text, "aa", "a", 0)]
    for order in (rows, rows[::-1]):
        got = pipeline.near_duplicates(spark, spark.createDataFrame(order, schema).repartition(3), SF).collect()
        assert [tuple(r) for r in got] == [(1, text, "en", "a", 9)]


def test_texts_of_an_uncertain_language_go(spark):
    """One that is half of either language has a probability near a half for each; a higher threshold than that rejects it."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    known = [(k, f"{'abba cabba dab ' if k % 2 else 'xyz zyx wyzzy '} " * 12, "one" if k % 2 else "two", "s", 0) for k in range(80)]
    docs = spark.createDataFrame([*known, (900, "qqq", None, "s", 0), (901, "??", None, "s", 0)], schema)
    found = {r["doc_id"]: r["score"] for r in langid.identify(docs).where("doc_id >= 900").collect()}
    ids = lambda: {r.doc_id for r in pipeline.language(spark, docs, SF).collect()}
    before, pipeline.LEAST_SCORE = pipeline.LEAST_SCORE, (found[900] + 1) / 2
    try:
        assert not {900, 901} & ids()
        pipeline.LEAST_SCORE = found[900] / 2
        assert 900 in ids() and 901 not in ids()
    finally:
        pipeline.LEAST_SCORE = before


def test_verdicts_go_by_row(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len((r.text or "").split()) >= 12)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = lambda k, n=40: " ".join(f"w{k}x{j}" for j in range(n))
    texts = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], schema), SF).collect()), key=repr)
    dirty = [(None, f"so {item} it is"), (None, words(1)), (5, item), (5, words(2)), (6, words(3))]
    assert texts(pipeline.decontaminate, dirty) == sorted([dirty[1], dirty[3], dirty[4]], key=repr)
    a, b, c = words(4), words(5), words(6)
    twice = [(3, a), (7, a), (7, b), (7, b), (9, b), (None, b), (None, c), (None, c), (8, words(7)), (8, words(8))]
    assert texts(pipeline.near_duplicates, twice) == sorted([(3, a), (7, b), (None, c), (8, words(7)), (8, words(8))], key=repr)
