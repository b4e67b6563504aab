"""Benchmark decontamination by winnowing, in DataFrame functions alone.

A text's k-grams are hashed and, of each run of `span - k + 1` grams, the smallest hash is kept as a fingerprint. A stretch of `span` equal words has
equal grams and so the same smallest hash: every shared stretch of that length shares a fingerprint. Stretches of a document whose fingerprint
occurs in the benchmark are then extended to windows of `span` words and compared word by word."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 10
GRAM = 5


def _grams(hashes: Column, count: Column, k: int) -> Column:
    """The hash of each k-gram, from the hashes of its words."""
    return F.transform(C.positions(count - (k - 1)), lambda i: F.xxhash64(*[C.at(hashes, i + j) for j in range(k)]))


def _tokenized(rows: DataFrame, text: Column, span: int, gram: int) -> DataFrame:
    """rows with w (words), h (their hashes), n (how many) and m (for each window of `span` words, the smallest gram hash)."""
    keep = rows.columns
    rows = rows.select(*keep, text.alias("t")).select(*keep, C.words(C.ascii_lower(F.col("t")), C.PLAIN_WORD).alias("w"))
    rows = rows.select(*keep, "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"), F.size("w").alias("n"))
    rows = rows.select(*keep, "w", "h", "n", _grams(F.col("h"), F.col("n"), gram).alias("g"))
    least = F.transform(C.positions(F.col("n") - (span - 1)), lambda i: F.least(*[C.at(F.col("g"), i + j) for j in range(span - gram + 1)]))
    return rows.select(*keep, "w", "h", "n", least.alias("m"))


def windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(text, len, fp, id) for each window of each item of items(item_id, text), once: `span` words, or all words of an item that has fewer. id: the
    item's id as a string. A window that many items share has a row for each."""
    rows = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("t0"))
    rows = _tokenized(rows, F.col("t0"), span, gram).drop("t0")

    def window(text: Column, size: Column, fp: Column) -> Column:
        return F.struct(text.alias("text"), size.alias("len"), fp.alias("fp"))

    places = C.positions(F.col("n") - (span - 1))
    full = F.transform(places, lambda i: window(F.array_join(F.slice("w", i + 1, span), " "), F.lit(span), C.at(F.col("m"), i)))
    short = F.array(window(F.array_join("w", " "), F.col("n"), _short_hash(F.col("h"), F.col("n"), span)))
    found = F.when(F.col("n") >= span, full).when(F.col("n") > 0, short)
    return rows.select("id", F.explode(found).alias("x")).select("x.*", "id").distinct()


def _short_hash(hashes: Column, count: Column, span: int) -> Column:
    """The hash of a sequence of fewer than `span` words."""
    cases = [(count == k, F.xxhash64(*[C.at(hashes, j) for j in range(k)])) for k in range(1, span)]
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0]))


def _text_key(text: Column) -> Column:
    """A text's key: copies share it, and what a text holds depends on it alone."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _candidates(docs: DataFrame, prints: DataFrame, span: int, gram: int) -> DataFrame:
    """(doc_id, key, start, len, size): the stretches of `size` words from `start` on whose fingerprint is in prints(fp, len), and for each row of
    docs(doc_id, text) one with len 0 and its number of words as start. No words leave a document."""
    lens = sorted(r[0] for r in prints.select("len").distinct().collect())  # at most `span` numbers
    rows = docs.select("doc_id", _text_key(F.col("text")).alias("key"), F.col("text").alias("t0"))
    rows = _tokenized(rows, F.col("t0"), span, gram).drop("t0", "w")
    last = F.col("n") - (span - 1)
    begins = F.filter(C.positions(last), lambda i: (i == 0) | (C.at(F.col("m"), i) != C.at(F.col("m"), i - 1)))
    rows = rows.select("doc_id", "key", "h", "n", "m", begins.alias("runs"))

    def entry(fp: Column, start: Column, length: int, size: Column) -> Column:
        return F.struct(fp.cast("long").alias("fp"), start.cast("int").alias("start"), F.lit(length).alias("len"), size.cast("int").alias("size"))

    def run(s: Column, i: Column) -> Column:  # neighbouring windows with one smallest hash
        return entry(C.at(F.col("m"), s), s, span, F.coalesce(C.at(F.col("runs"), i + 1), last) - s + (span - 1))

    def short(k: int) -> Column:  # every place of k words
        return F.transform(C.positions(F.col("n") - (k - 1)), lambda s: entry(F.xxhash64(*[C.at(F.col("h"), s + j) for j in range(k)]), s, k, F.lit(k)))

    parts = [F.array(entry(F.xxhash64("key", "doc_id"), F.col("n"), 0, F.lit(0)))]
    parts += [F.transform("runs", run)] * (span in lens) + [short(k) for k in lens if k < span]
    rows = rows.select("doc_id", "key", F.explode(F.concat(*parts)).alias("x")).select("doc_id", "key", "x.*")
    seen = C.sized(prints.select(F.col("fp").alias("bfp"), F.col("len").alias("blen")))
    rows = rows.join(seen, (F.col("fp") == F.col("bfp")) & (F.col("len") == F.col("blen")), "left")
    return rows.where("bfp IS NOT NULL OR len = 0").select("doc_id", "key", "start", "len", "size")


def _occurrences(docs: DataFrame, stretches: DataFrame, wins: DataFrame) -> DataFrame:
    """(key, s, len, text): where the windows of wins(text) stand in the stretches(key, start, len, size) of docs(text), word by word."""
    runs = C.materialize(stretches.groupBy("key").agg(F.collect_set(F.struct("start", "len", "size")).alias("runs")))
    rows = docs.select(_text_key(F.col("text")).alias("key"), "text").join(C.sized(runs), "key")
    rows = rows.select("key", "runs", C.words(C.ascii_lower(F.col("text")), C.PLAIN_WORD).alias("w"))

    def window(start: Column, size: Column) -> Column:
        text = F.array_join(F.slice("w", start + 1, size), " ")
        return F.struct(start.alias("s"), size.alias("len"), text.alias("text"))

    def inside(x: Column) -> Column:
        return F.transform(C.positions(x["size"] - x["len"] + 1), lambda i: window(x["start"] + i, x["len"]))

    rows = rows.select("key", F.explode(F.flatten(F.transform("runs", inside))).alias("x")).select("key", "x.*")
    return rows.join(C.sized(wins.select("text")), "text", "left_semi").select("key", "s", "len", "text").distinct()


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids (sorted array) for each row of docs(doc_id, text).

    A word is hit if it lies in an occurrence of a window of items(item_id, text). Null and empty texts have no words, and items without words no
    windows; an item with a null id hits words but is not counted or listed; items with equal ids are one. Repeated rows of docs each give a row.
    Either table may be empty. Other columns are not read.

    Documents are read twice. First their fingerprints meet the benchmark's, by broadcast while those are few (counted, in rows and bytes), else by a
    shuffle of a few numbers each. Then the texts that matched are compared word by word with the windows; copies of a text share what is found.
    Ids of items join only what occurred, a row for each item and window, so that a window common to all items is no single row."""
    members = C.materialize(windows(items, span, gram))
    wins = C.materialize(members.select("text").distinct())
    prints = C.materialize(members.select("fp", "len").distinct())
    found = C.materialize(_candidates(docs.select("doc_id", "text"), prints, span, gram))
    places = C.materialize(_occurrences(docs.select("text"), found.where("len > 0"), wins))
    hits = places.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("s", "len"))).alias("hits"))
    named = C.materialize(places.select("key", "text").distinct())
    ids = named.join(C.sized(members.where("id IS NOT NULL").select("text", "id")), "text").select("key", "id").distinct()
    ids = ids.groupBy("key").agg(F.sort_array(F.collect_set("id")).alias("ids"))

    def step(a: Column, x: Column) -> Column:
        end = x["s"] + x["len"]
        more = F.greatest(F.lit(0), end - F.greatest(a["end"], x["s"]))
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["sum"] + more).cast("long").alias("sum"))

    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))
    covered = F.aggregate("hits", start, step, lambda a: a["sum"])
    verdicts = C.materialize(hits.select("key", covered.alias("hit")).join(ids, "key", "left"))
    rows = found.where("len = 0").select("doc_id", "key", F.col("start").cast("long").alias("n_words")).join(C.sized(verdicts), "key", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("ids", none).alias("item_ids"))
    count, digest = F.size("item_ids").cast("long"), F.sha2(F.array_join("item_ids", ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", count.alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")
