import re
from collections import Counter

import public_tokenizers
import pytest
from evigraph.llm import common as C
from evigraph.llm import hostrules, mixing, rollups

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_totals(rows):
    docs, tokens = Counter(), Counter()
    for r in rows:
        text = r.text or ""
        if len(SPACE.findall(text)) < 10:
            continue
        clean = re.sub(r"[#*$%&|<>]", "", text)
        for name, pattern in (("space-words/1", SPACE), ("plain-words/1", PLAIN)):
            docs[r.source, r.lang, name] += 1
            tokens[r.source, r.lang, name] += len(pattern.findall(clean))
    return sorted(((*k, docs[k], tokens[k]) for k in docs), key=repr)


def test_totals_follow_the_batches(spark, sample, edge, empty):
    for docs in (sample, edge, empty):
        rollup = rollups.maintain(docs, C.fresh_dir(spark, "rollup"))
        assert sorted(map(tuple, rollup.totals().collect()), key=repr) == plain_totals(docs.collect())


def test_batches_count_once(spark):
    delta = spark.createDataFrame([("a", "en", "t", 1, 5), (None, None, "t", 2, 7)], rollups.SCHEMA)
    rollup = rollups.Rollup(spark, C.fresh_dir(spark, "rollup"))
    assert rollup.totals().count() == 0
    assert rollup.commit("one", delta) and not rollup.commit("one", delta) and rollup.pending() == ["one"]
    back = delta.selectExpr("source", "lang", "tokenizer", "-docs AS docs", "-tokens AS tokens")
    assert rollup.commit("two", back.where("source IS NOT NULL"))
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, None, "t", 2, 7)]
    assert rollup.compact() == 1 and rollup.compact() == 1 and rollup.pending() == []
    assert [tuple(r) for r in rollup.totals().collect()] == [(None, None, "t", 2, 7)]
    assert not rollup.commit("one", delta) and not rollup.commit("two", delta)
    assert rollup.commit("three", delta) and rollup.totals().where("docs = 3").isEmpty() and rollup.totals().where("docs = 4").count() == 1
    assert rollup.compact() == 2 and rollup.compact() == 2 and not rollup.commit("three", delta) and rollup.commit("four", delta) and rollup.compact() == 3
    assert rollup._names("totals") == ["2", "3"] and rollup.has("one") and rollup.has("four") and not rollup.has("five")
    with pytest.raises(ValueError):
        rollup.commit("../x", delta)


def test_a_failed_writer_leaves_nothing(spark):
    from pyspark.sql import functions as F

    rollup = rollups.Rollup(spark, C.fresh_dir(spark, "rollup"))
    delta = spark.createDataFrame([("a", "en", "t", 1, 5)], rollups.SCHEMA)
    with pytest.raises(Exception, match="broken"):
        rollup.commit("one", delta.withColumn("tokens", F.raise_error(F.lit("broken")).cast("long")))
    assert rollup.pending() == [] and rollup.commit("one", delta)


def test_tokenizer_counts(spark, edge):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, r.tokens) for r in rollups.tokenizer_counts(edge, path, "bpe/1").collect()), key=repr)
    assert got == sorted(((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in edge.collect()), key=repr)


def plain_whole(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs, tokens = Counter(), Counter()
    for r in rows:
        text = r.text or ""
        for name, n in (("space-words/1", len(SPACE.findall(text))), ("plain-words/1", len(PLAIN.findall(text))), ("byte_bpe_50k/1", len(t.encode(text, add_special_tokens=False).ids))):
            docs[r.source, r.lang, name] += 1
            tokens[r.source, r.lang, name] += n
    return sorted(((*k, docs[k], tokens[k]) for k in docs), key=repr)


def test_totals_cover_every_document(spark, sample, edge, empty, tmp_path):
    from evigraph.llm import queries

    path = public_tokenizers.path("byte_bpe_50k.json")
    for docs in (edge, empty):
        rollup = rollups.count_all(docs, C.fresh_dir(spark, "rollup"), path, "byte_bpe_50k/1")
        assert sorted(map(tuple, rollup.totals().collect()), key=repr) == plain_whole(docs.collect())
    short = sample.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN '# a $b' ELSE text END AS text", "CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE source END AS source", "lang")
    short.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op2_token_rollup"](spark, str(tmp_path)).collect()), key=repr)
    assert got == plain_whole(short.collect()) and any(r[0] == "short" for r in got)


def test_deletes_and_revisions_end_at_the_tables_state(spark, edge):
    path = public_tokenizers.path("byte_bpe_50k.json")
    count = lambda docs: rollups.pattern_counts(docs).unionByName(rollups.tokenizer_counts(docs, path, "byte_bpe_50k/1").drop("doc_id"))
    rollup = rollups.count_all(edge, C.fresh_dir(spark, "rollup"), path, "byte_bpe_50k/1")
    gone, old = edge.where("doc_id IN (4, 6, 8)"), edge.where("doc_id IN (1, 5, 9)")
    new = old.selectExpr("doc_id", "concat('new ', coalesce(text, '')) AS text", "lang", "'moved' AS source")
    rollup.commit("3-delete", rollups.deleted(count(gone)))
    rollup.commit("4-revise", rollups.revised(count(old), count(new)))
    state = edge.where("doc_id IS NULL OR doc_id NOT IN (1, 4, 5, 6, 8, 9)").select("doc_id", "text", "lang", "source").unionByName(new)
    assert sorted(map(tuple, rollup.totals().collect()), key=repr) == plain_whole(state.collect())


def plain_targets(sizes):
    sources = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else weight[s] * level
        if not over:
            break
        open_ -= set(over)
        left -= sum(target[s] for s in over)
    return target


def test_mixing(spark, sample, edge, empty):
    for docs in (sample, edge, empty):
        rows = mixing.mix(docs).collect()
        assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs).collect()))
        sizes = Counter()
        for r in docs.collect():
            sizes[r.source] += len(SPACE.findall(r.text or ""))
        target = plain_targets(sizes)
        by_size = {(sizes[s], round(target[s], 6)) for s in target}
        assert {(r.source_size, round(r.target, 6)) for r in rows} == by_size and len(rows) == docs.count()
        assert all(r.taken <= 2 * r.size for r in rows)
        assert sorted(r.taken for r in rows if r.size) == sorted(sum(len(SPACE.findall(x.text or "")) for x in group) for group in _groups(docs, rows))


def _groups(docs, rows):
    """What emit gives, by input row: as many copies as were taken."""
    emitted = Counter((r.doc_id, r.text) for r in mixing.emit(docs).collect())
    seen = Counter((r.doc_id, r.text) for r in docs.collect())
    out = []
    for r in docs.collect():
        if SPACE.search(r.text or ""):
            out.append([r] * (emitted[r.doc_id, r.text] // seen[r.doc_id, r.text]))
    return out


def test_emitted_rows_keep_their_columns(edge):
    got = mixing.emit(edge)
    assert got.columns == edge.columns and got.schema == edge.schema


def plain_figures(text):
    text = text or ""
    w = SPACE.findall(text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def judged(docs):
    return sorted((tuple(r) for r in hostrules.judge(docs).collect()), key=repr)


def by_sql(docs, tmp_path):
    """The registered SQL over the same rows."""
    import duckdb
    from evigraph.llm.queries import ORACLE

    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        return sorted(con.execute(ORACLE["op6_host_rules"]).fetchall(), key=repr)


def test_host_rules(spark, sample, edge, empty):
    lines = spark.createDataFrame([(1, "a b\na b\n\n \na b\nc  #$|", "h"), (2, "x " * 30, "h"), (3, " ".join(map(str, range(30))), "h")], "doc_id long, text string, source string")
    for docs in (sample, edge, lines, empty):
        got = sorted((tuple(r) for r in hostrules.judge(docs).drop("host_rejected", "kept").collect()), key=repr)
        want = []
        for r in docs.collect():
            n, chars, symbols, dup, repeated = plain_figures(r.text)
            want.append((r.doc_id, n, chars, symbols, dup, repeated, n < 10 or 100 * repeated > 20 * n))
        assert got == sorted(want, key=repr)


def test_bad_hosts_go_and_small_ones_are_shrunk(spark, tmp_path):
    """Hosts that fail by one rule each, though most of their documents pass the base rules; a small host and a null one; and the SQL says the same."""
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(k, "short", "junk" if k < 90 else good) for k in range(100)]
    rows += [(1000 + k, "symbols", good + " #$%&|<>*" if k < 80 else good) for k in range(100)]
    rows += [(2000 + k, "lines", "\n".join([good, "again", "again", "again"]) if k < 80 else good) for k in range(100)]
    rows += [(3000 + k, f"h{k % 12}", "junk" if k % 20 == 0 else good) for k in range(1200)]
    rows += [(5000, "tiny", "junk"), (5001, "tiny", good), (5002, None, "junk"), (5003, None, good)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in hostrules.judge(docs).collect()}
    source = {i: s for i, s, _ in rows}
    assert {source[i] for i, r in got.items() if r.host_rejected} == {"short", "symbols", "lines"}
    assert sum(not r.base_failed and not r.kept for r in got.values()) == 210
    assert all(r.kept != r.base_failed for i, r in got.items() if source[i] not in ("short", "symbols", "lines"))
    assert got[5001].kept and got[5003].kept
    assert judged(docs) == by_sql(docs, tmp_path)


def test_priors():
    fit = lambda hosts: hostrules.prior(len(hosts), sum(n for n, _ in hosts), sum(k for _, k in hosts), sum(n * n for n, _ in hosts), sum(k * k / n for n, k in hosts))
    # one document a host tells nothing of the spread: hosts are shrunk wholly
    assert fit([(1, k % 2) for k in range(2000)]).strength == pytest.approx(1000)
    # rates that vary as by chance, and rates that vary more
    import random

    draw = random.Random(4)
    chance = fit([(50, sum(draw.random() < 0.3 for _ in range(50))) for _ in range(400)])
    assert chance.mean == pytest.approx(0.3, abs=0.02) and chance.strength > 100
    wide = []
    for _ in range(800):
        rate = draw.betavariate(2, 6)
        wide.append((draw.choice([5, 20, 200]), rate))
    wide = fit([(n, sum(draw.random() < rate for _ in range(n))) for n, rate in wide])
    assert wide.mean == pytest.approx(0.25, abs=0.04) and 4 < wide.strength < 16
    assert fit([]).limit == fit([(10, 10)]).limit == 0.6


def test_hosts_by_sql(spark, sample, tmp_path):
    assert judged(sample) == by_sql(sample, tmp_path)
