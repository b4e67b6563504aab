import hashlib
import random
import re

from evigraph.llm import winnowing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    wins = {}
    for item, text in items:
        w = words(text)
        if w:
            k = min(10, len(w))
            for s in range(len(w) - k + 1):
                wins.setdefault(tuple(w[s : s + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in wins}:
            for s in range(len(w) - k + 1):
                if (got := wins.get(tuple(w[s : s + k]))) is not None:
                    hit.update(range(s, s + k))
                    found |= got
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def rows(frame):
    return sorted((tuple(r)[:6] for r in frame.collect()), key=repr)


def test_against_all_windows(spark, sample, edge, empty):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    bench = [tuple(r) for r in items.select("item_id", "text").collect()]
    extra = [(900, "the MIT license"), (901, "words of text to"), (902, None), (903, ""), (None, "mit"), (904, "the MIT license"), (900, "x y z end a b c"), (905, "lorem ipsum dolor " * 5)]
    more = spark.createDataFrame(bench + extra, "item_id long, text string")
    for docs in (sample, edge, empty):
        plain_docs = [(r.doc_id, r.text) for r in docs.collect()]
        assert rows(winnowing.contaminated(docs, items)) == plain(plain_docs, bench)
        assert rows(winnowing.contaminated(docs, more)) == plain(plain_docs, bench + extra)
        assert rows(winnowing.contaminated(docs, items.limit(0))) == plain(plain_docs, [])


def test_every_span_of_ten_is_found(spark):
    draw = random.Random(5)
    vocabulary = ["a", "b", "c", "dd"]
    items = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(1, 30)))) for k in range(60)]
    docs = [(k, " ".join(draw.choices(vocabulary, k=draw.randint(0, 200)))) for k in range(60)] + [(100 + k, "z " * k + items[k][1] + " z" * 3) for k in range(60)]
    got = rows(winnowing.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain(docs, items)
