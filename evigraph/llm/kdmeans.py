"""Centroid clustering of integer vectors by kd-tree filtering.

Each partition of the vectors is cut into blocks, and each block gets a kd-tree: a node has the count of its vectors, their integer sums and the box that
they lie in. In a round, the centroids go down each tree together. At a node, the one nearest to the middle of the box is taken, and every other one goes
that is farther from the box's corner that suits it best, for it is then strictly farther from all of the box. If one centroid is left, it gets the whole
node by its count and sums; in a leaf, what is left is compared with each vector. All of it is in whole numbers, so that the result is that of comparing
each vector with each centroid, whatever the partitions, blocks and trees are.

The trees are built once and lie in the shared folder as a table. A round sends each task the centroids and gets counts and sums by cluster and component
from an aggregate: clusters x components rows come to the driver, however many vectors there are."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed values of the query contract.
COMPONENTS, CLUSTERS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Vectors of a block, and of a leaf of its tree at most.
BLOCK, LEAF = 8192, 32
#: Components beyond this, once scaled, have squared distances that no long holds.
LARGEST = 1 << 26
MOST = (1 << 63) - 1


@dataclass
class Tree:
    """Vectors x in the order of the leaves. Node i has those from start[i] to end[i], the box lo[i] .. hi[i] and their sums; its children are child[i] and
    child[i] + 1, or it is a leaf if child[i] is 0."""

    x: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    sums: np.ndarray


def build(x: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of vectors (n x components), split at the median of the widest side, and the order that its vectors are in."""
    order, starts, ends, child, low, high, sums = np.arange(len(x)), [0], [len(x)], [], [], [], []
    for start, end in zip(starts, ends, strict=False):  # both grow meanwhile
        own = x[order[start:end]]
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        sums.append(own.sum(axis=0))
        sides = high[-1] - low[-1]
        if end - start <= leaf or not sides.any():
            child.append(0)
            continue
        middle = (end - start) // 2
        order[start:end] = order[start:end][np.argpartition(own[:, sides.argmax()], middle)]
        child.append(len(starts))
        starts += [start, start + middle]
        ends += [start + middle, end]
    return Tree(x[order], np.array(starts), np.array(ends), np.array(child), np.array(low), np.array(high), np.array(sums)), order


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0] .. end[0] - 1, start[1] .. end[1] - 1 and so on, as one array."""
    size = end - start
    return np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())


def assign(tree: Tree, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The number of the nearest of the centroids z for each vector of a tree (the smaller one if two are as near), the counts and sums by centroid, and
    the number of vectors that were compared one by one."""
    label, counts, sums, compared = np.zeros(len(tree.x), np.int32), np.zeros(len(z), np.int64), np.zeros(z.shape, np.int64), 0
    nodes, alive = np.array([0]), np.ones((1, len(z)), bool)
    while len(nodes):
        lo, hi = tree.lo[nodes], tree.hi[nodes]
        far = ((lo + hi)[:, None] - 2 * z) ** 2
        nearest = z[np.where(alive, far.sum(axis=2), MOST).argmin(axis=1)][:, None]
        ahead = z - nearest
        corner = np.where(ahead > 0, hi[:, None], lo[:, None])
        alive &= (ahead * (z + nearest - 2 * corner)).sum(axis=2) <= 0
        alone = alive.sum(axis=1) == 1
        if alone.any():
            own, to = nodes[alone], alive[alone].argmax(axis=1)
            size = tree.end[own] - tree.start[own]
            label[_ranges(tree.start[own], tree.end[own])] = np.repeat(to, size)
            np.add.at(counts, to, size)
            np.add.at(sums, to, tree.sums[own])
        last = ~alone & (tree.child[nodes] == 0)
        if last.any():
            own = nodes[last]
            rows = _ranges(tree.start[own], tree.end[own])
            left = np.repeat(alive[last], tree.end[own] - tree.start[own], axis=0)
            x, away = tree.x[rows], np.full(left.shape, MOST)
            for j in range(len(z)):
                some = left[:, j]
                away[some, j] = ((x[some] - z[j]) ** 2).sum(axis=1)
            label[rows] = to = away.argmin(axis=1)
            compared += len(rows)
            np.add.at(counts, to, 1)
            np.add.at(sums, to, x)
        inner = ~alone & ~last
        below = tree.child[nodes[inner]]
        nodes = np.concatenate((below, below + 1))
        alive = np.concatenate((alive[inner], alive[inner]))
    return label, counts, sums, compared


_FIELDS = ("x", "start", "end", "child", "lo", "hi", "sums")
_TREES = "ids array<long>, " + ", ".join(f"`{f}` binary" for f in _FIELDS)


def _trees(rows: DataFrame, width: int, block: int, leaf: int) -> DataFrame:
    """A row for each block of rows(id, x): its ids and its tree as bytes, numbers being of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list]] = []

        def out() -> pa.RecordBatch:
            tree, order = build(np.concatenate([x for x, _ in held]), leaf)
            ids = [i for _, some in held for i in some]
            held.clear()
            columns = [pa.array([[ids[k] for k in order]], pa.list_(pa.int64()))]
            columns += [pa.array([getattr(tree, f).astype("<i8").tobytes()], pa.binary()) for f in _FIELDS]
            return pa.RecordBatch.from_arrays(columns, names=["ids", *_FIELDS])

        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held.append((x, batch.column(0).to_pylist()))
            if sum(len(some) for _, some in held) >= block:
                yield out()
        if any(some for _, some in held):
            yield out()

    return rows.mapInArrow(run, _TREES)


def _read(batch: pa.RecordBatch, width: int) -> Iterator[tuple[list, Tree]]:
    for k in range(batch.num_rows):
        parts = {f: np.frombuffer(batch.column(f)[k].as_py(), "<i8") for f in _FIELDS}
        yield batch.column("ids")[k].as_py(), Tree(**{f: p if f in ("start", "end", "child") else p.reshape(-1, width) for f, p in parts.items()})


def _round(trees: DataFrame, z: np.ndarray) -> np.ndarray:
    """The centroids after a round: the componentwise floor of the mean of what is assigned to each; one without vectors stays."""
    width = z.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(z), np.int64), np.zeros(z.shape, np.int64)
        for batch in batches:
            for _, tree in _read(batch, width):
                _, n, s, _ = assign(tree, z)
                counts += n
                sums += s
        some = [j for j in range(len(z)) if counts[j]]
        columns = [pa.array(some, pa.int32()), pa.array([int(counts[j]) for j in some], pa.int64()), pa.array([sums[j].tolist() for j in some], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums"])

    parts = trees.mapInArrow(run, "cluster int, n long, sums array<long>").select("cluster", "n", F.posexplode("sums").alias("place", "sum"))
    total = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "sum")]
    new = z.copy()
    for r in parts.groupBy("cluster", "place").agg(*total).collect():
        new[r["cluster"], r["place"]] = int(r["sum"]) // int(r["n"])
    return new


def cluster(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", width: int = COMPONENTS, clusters: int = CLUSTERS, rounds: int = ROUNDS,
    seed: int = SEED, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector of rows(key, vector) that is kept: one with exactly `width`
    components, none null or non-finite, or beyond LARGEST once scaled.

    A component x becomes floor(scale * x). The first centroids are the kept vectors whose `<seed>:<key>` has the smallest SHA-256, in that order; equal
    ones, as of repeated rows, by their components. A null key counts as empty text. With fewer vectors than clusters, there are as many clusters as
    vectors; an empty table gives no rows. Repeated rows each count and give a row. Other columns are not read. Inertias beyond the largest long are
    given as that."""
    spark = rows.sparkSession
    known = F.col("x").isNotNull() & (F.size("x") == width)
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < LARGEST))
    kept = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(known & F.coalesce(fine, F.lit(False)))
    kept = kept.select("id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x"))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select("x", name.alias("name")).orderBy("name", "x").limit(clusters).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    C.ship(spark)
    z, path = np.array([r["x"] for r in first], np.int64), C.fresh_dir(spark, "kd-trees")
    _trees(kept, width, block, leaf).write.parquet(path)
    trees = spark.read.schema(_TREES).parquet(path)
    for _ in range(rounds):
        z = _round(trees, z)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, tree in _read(batch, width):
                label, *_ = assign(tree, z)
                columns = [pa.array(ids, pa.int64()), pa.array(label, pa.int32()), pa.array(((tree.x - z[label]) ** 2).sum(axis=1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    told = C.fresh_dir(spark, "clusters")
    trees.mapInArrow(run, "vec_id long, cluster int, distance long").write.parquet(told)
    C.remove(spark, path)
    assigned = spark.read.schema("vec_id long, cluster int, distance long").parquet(told)
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    whole = sum(inertia.values())
    names = {j: hashlib.sha256(",".join(map(str, z[j].tolist())).encode()).hexdigest() for j in inertia}
    facts = [(j, min(d, MOST), min(whole, MOST), names[j]) for j, d in inertia.items()]
    few = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row for each cluster
    return assigned.join(F.broadcast(few), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
