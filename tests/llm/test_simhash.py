import itertools
import re

import numpy as np
import xxhash
from evigraph.llm import common as C
from evigraph.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows):
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, f"{p:016x}", least.get(root(k))) for k, (i, p) in enumerate(prints)), key=repr)


def test_against_all_pairs(spark, sample, edge, empty):
    for docs in (sample, edge, empty):
        got = simhash.near_duplicates(docs)
        assert got.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_trie_finds_every_pair():
    rng = np.random.default_rng(1)
    near = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = [near] + [near ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) for _ in range(6)]
    keys = np.unique(np.concatenate([*flips, flips[1] ^ (np.uint64(1) << np.uint64(3)), np.array([0, 1, 3, 7], np.uint64)]))
    for budget in (0, 1, 2, 3):
        got = {(int(a), int(b)) for i, j in simhash.trie_pairs(keys, np.zeros(len(keys), np.int64), 64, budget) for a, b in zip(i, j, strict=True)}
        assert got == {(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if (int(keys[a]) ^ int(keys[b])).bit_count() <= budget}


def test_links_cross_batches(spark):
    rng = np.random.default_rng(2)
    base = 0x123456789ABCDEF0
    keys = sorted({base ^ sum(1 << int(b) for b in rng.choice(20, 3, replace=False)) for _ in range(400)} | {base})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(tuple(sorted(r)) for r in simhash.links(spark.createDataFrame([(k,) for k in keys], "fp long")).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == sorted((a, b) for a, b in itertools.combinations(keys, 2) if (a ^ b).bit_count() <= 2)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = dict(map(tuple, C.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert len({got[i] for i in range(201)}) == 1 and got[1000] == got[1001] != got[0] and 5000 not in got
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0
