import re

import numpy as np
from evigraph.llm import langid, licenses


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def template_pattern(template):
    """A template as a regular expression over words that are followed by a blank each: the brute-force version of the automata."""
    out = ""
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|(?:(?!\[\[|\]\]|\{\{).)+", template, re.S):
        if token == "[[":
            out += "(?:"
        elif token == "]]":
            out += ")?"
        elif token.startswith("{{"):
            out += f"(?:[^ ]+ ){{0,{token[2:-2]}}}"
        else:
            out += "".join(re.escape(w) + " " for w in words(token))
    return re.compile(r"(?:^|(?<= ))" + out)


def plain(text):
    w = words(text)
    found = []
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        found += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
    line = "".join(x + " " for x in w)
    extra = {k for k, t in licenses.TEMPLATES.items() if template_pattern(t).search(line)}
    base = {label for _, label in found}
    starts = [k for k, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | extra)), 1.0 if extra else 0.5 if base else 0.0


CASES = [
    "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "This very big work of ours is licensed under the Apache License, Version 2.0", "Released under the MIT License.", "released under the terms of the MIT license",
    "released under the terms of MIT license", "Licensed under CC BY-NC 4.0.", "licensed under a CC BY-NC-SA 4.0", "licensed under CC BY 4.0 licensed under the licensed under the Apache License version 2 0", "MIT mit license license, MIT LICENSE", "general public", None, "",
    licenses.TEMPLATES["mit-text"].replace("[[", "").replace("]]", "").replace("{{10}}", "the authors or copyright holders"), licenses.TEMPLATES["mit-text"].replace("[[", "").replace("]]", "").replace("{{10}}", "w " * 11), licenses.TEMPLATES["mit-text"].replace("without restriction", "with restriction"),
    re.sub(r"\[\[.*?\]\]+", "", licenses.TEMPLATES["bsd-text"]).replace("{{12}}", "the authors"),
]


def test_licenses_against_patterns(spark, sample, edge, empty):
    cases = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for docs in (cases, sample, edge, empty):
        got = sorted(map(tuple, licenses.scan(docs).collect()), key=repr)
        assert got == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=repr)


def test_bad_templates_are_refused():
    import pytest

    for bad in ("[[only optional]]", "[[open words", "{{3}} words"):
        with pytest.raises((ValueError, IndexError)):
            licenses.compile_template("x", bad)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 100 < len(held) < 300
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_edges_of_language(spark, edge, empty):
    rows = {r.doc_id: r for r in langid.identify(edge).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[3].lang_pred == "und" and rows[6].lang_pred == rows[7].lang_pred
    assert langid.identify(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None), (2, "123", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    kept = langid.identify(edge, keep_row=True)
    assert kept.select("row.*").columns == edge.columns


def test_gradients_reduce_the_error():
    rng = np.random.default_rng(0)
    a, b = rng.integers(97, 105, (200, 256), np.uint8), rng.integers(103, 111, (200, 256), np.uint8)
    x, y = np.concatenate([a, b]), np.repeat([0, 1], 200)
    net = langid.train(x, y, ["a", "b"], epochs=3)
    assert (net.logits(x).argmax(axis=1) == y).mean() > 0.95
    again = langid.train(x, y, ["a", "b"], epochs=3)
    assert np.array_equal(net.filters, again.filters)


def test_all_of_a_text_counts():
    net = langid.train(np.concatenate([np.full((50, 256), 97, np.uint8), np.full((50, 256), 98, np.uint8)]), np.repeat([0, 1], 50), ["a", "b"], epochs=4)
    assert langid.predict(["a" * 1000, "a" * 1000 + "b" * 9000], net)[0][0] == "a" and langid.predict(["a" * 1000 + "b" * 9000], net)[0][0] == "b"


def plain_prediction(text, net):
    """The forward pass written out: every window, every place, every filter, byte by byte."""
    if not text or not any(ch.isalpha() for ch in text):
        return "und", 0.0
    data = text.lower().encode()
    total = [0.0] * len(net.langs)
    for at in range(0, max(len(data), 1), langid.WINDOW):
        window = data[at : at + langid.WINDOW]
        padded, active = window.ljust(langid.WINDOW, b"\0"), []
        for f in range(net.filters.shape[1]):
            width, best = langid.WIDTHS[f // langid.FILTERS], -float("inf")
            for place in range(langid.WINDOW - langid.WIDTHS[-1] + 1):
                response = 0.0
                for k in range(width):
                    for e in range(langid.EMBEDDING):
                        response += float(net.embed[padded[place + k]][e]) * float(net.filters[k * langid.EMBEDDING + e][f])
                best = max(best, response)
            active.append(max(best + float(net.bias[f]), 0.0))
        for n in range(len(net.langs)):
            logit = float(net.out_bias[n]) + sum(a * float(net.out[f][n]) for f, a in enumerate(active))
            total[n] += logit * len(window) / len(data)
    top = max(total)
    odds = [np.exp(x - top) for x in total]
    best = max(range(len(total)), key=lambda n: total[n])
    return net.langs[best], float(odds[best] / sum(odds))


def test_language_against_a_plain_convolution(spark, sample):
    net = langid.fit(sample)
    texts = sorted((r.text for r in sample.collect() if r.text and 40 < len(r.text) < 400), key=len)[:4] + ["Größe!", "x", "", None, "12 34"]
    for text, (lang, score) in zip(texts, langid.predict(texts, net), strict=True):
        want = plain_prediction(text, net)
        assert lang == want[0] and abs(score - want[1]) < 1e-4


def test_the_training_sample_is_bounded(spark):
    from pyspark.sql import functions as F

    learned = "crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 0"
    ids = [r[0] for r in spark.range(1, 60).selectExpr("id AS doc_id").where(learned).collect()]
    one = spark.range(4000).select(F.lit(ids[0]).alias("doc_id"), F.lit("the same words").alias("text"), F.lit("en").alias("lang"))
    texts = spark.range(2000).select(F.lit(ids[1]).alias("doc_id"), F.concat(F.lit("row "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    assert langid.sample(one).count() == 1
    assert langid.sample(one.unionByName(texts), per_language=30).count() == 30
    many = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "concat('l', id % 900) AS lang")
    languages = many.where(learned).select("lang").distinct().count()
    some = langid.sample(many, total=1800)
    assert some.count() <= 1800 and some.select("lang").distinct().count() == languages > 850
    assert langid.sample(many, total=10).groupBy("lang").count().where("count = 1").count() == languages
