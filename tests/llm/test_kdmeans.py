import hashlib
import math
import random

import numpy as np
from evigraph.llm import kdmeans
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, width=64, clusters=8, rounds=10, seed=3):
    """Every vector against every centroid, in Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x * 1024) < 2**26 for x in v):
            kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    z = [x for _, x in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(z))
    for _ in range(rounds):
        own = [[] for _ in z]
        for _, x in kept:
            own[near(x)[1]].append(x)
        z = [[sum(c) // len(some) for c in zip(*some, strict=True)] if some else old for some, old in zip(own, z, strict=True)]
    told = [(i, *near(x)[::-1]) for i, x in kept]
    per = {k: sum(d for _, c, d in told if c == k) for k in range(len(z))}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in z]
    return sorted(((i, k, d, per[k], sum(per.values()), text[k]) for i, k, d in told), key=repr)


def rows_of(frame, **options):
    return sorted((tuple(r) for r in kdmeans.cluster(frame, **options).collect()), key=repr)


def points(seed, n, width=64):
    draw = random.Random(seed)
    heart = [[draw.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(k, [float(np.float32(c + draw.gauss(0, 0.2))) for c in draw.choice(heart)]) for k in range(n)]


def test_against_brute_force(spark):
    rows = points(1, 300)
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] * 64), (905, [float("inf")] + [0.0] * 63), (906, [1e30] * 64), (None, [0.5] * 64)]
    rows += odd + rows[:9] + [(950, rows[3][1])]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("z") for c in ("id", "x", "name", "cluster", "distance", "ids")}).repartition(5)
    expected = brute(rows)
    assert rows_of(frame) == expected
    assert rows_of(frame, block=16, leaf=1) == expected


def test_few_components_ties_and_clusters_that_stay_empty(spark):
    """On a small grid many vectors are as near to two centroids, and many are equal."""
    draw = random.Random(2)
    rows = [(k, [draw.randint(0, 2) / 512 for _ in range(3)]) for k in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA)
    for clusters in (1, 5, 40):
        assert rows_of(frame, width=3, clusters=clusters, rounds=4, leaf=2) == brute(rows, 3, clusters, 4)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = points(3, 3)
    assert rows_of(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert rows_of(spark.createDataFrame([(1, None)], SCHEMA)) == []
    assert rows_of(spark.createDataFrame([], SCHEMA)) == []


def test_large_components_do_not_overflow():
    z = np.array([[kdmeans.LARGEST - 1] * 64, [1 - kdmeans.LARGEST] * 64], np.int64)
    tree, _ = kdmeans.build(np.concatenate([z, z]), leaf=1)
    label, counts, sums, _ = kdmeans.assign(tree, z)
    assert counts.tolist() == [2, 2] and sorted(label.tolist()) == [0, 0, 1, 1] and sums.tolist() == (2 * z).tolist()


def test_whole_nodes_are_assigned():
    """Where clusters lie apart, few vectors are compared one by one."""
    x = np.array([[round(1024 * v) for v in p] for _, p in points(4, 4000, 2)], np.int64)
    tree, order = kdmeans.build(x)
    z = x[:5]
    label, counts, _, compared = kdmeans.assign(tree, z)
    away = ((x[order][:, None] - z) ** 2).sum(axis=2)
    assert (label == away.argmin(axis=1)).all() and counts.tolist() == np.bincount(label, minlength=5).tolist()
    assert compared < 2000
