"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHINGLE = 3
SEED = 42
#: Fingerprints link at so many differing bits or fewer.
BITS = 2
#: Node pairs that a traversal holds at a time; it goes on with the rest later.
FRONTIER = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the text's word shingles, repeats included. Words lie between ASCII white space, A-Z lower-cased. A bit is 1 if it is in the XXH64 of
    over half the shingles. A text of fewer words has its whole sequence as one shingle; none gives 0."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return int.from_bytes(digest(joined, SEED), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    starts, ends, counts = starts[:n].tolist(), ends[shingle - 1 :].tolist(), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 15)], ends[at : at + (1 << 15)], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: str | None = None) -> DataFrame:
    """(doc_id, fp) of docs(doc_id, text): the fingerprint's 64 bits as a signed long. A null text counts as empty. key: a binary column that comes along
    between them."""
    C.arrow_batches(docs.sparkSession)
    along = [key] if key else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(batch.num_columns - 1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=["doc_id", *along, "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *along, "text").mapInArrow(run, "doc_id long, " + "".join(f"{c} binary, " for c in along) + "fp long")


def trie_pairs(keys: np.ndarray, group: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of all pairs of one group whose lowest `bits` bits differ in at most `budget` of them.

    keys: uint64, sorted by group and value, distinct in a group, with equal higher bits there. A node of a group's trie is the stretch of keys with
    a prefix. The traversal starts from each group's root paired with itself and goes from a pair of nodes to the pairs of their children, adding 1
    where the branches differ, and drops a pair as soon as the sum is over the budget. A stretch of one key is a whole path: such pairs are settled
    by counting the bits of their difference."""
    if not len(keys):
        return
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    root = np.stack([edges[:-1], edges[1:], edges[:-1], edges[1:], np.zeros(len(edges) - 1, np.int64)])
    low = np.uint64((1 << bits) - 1) if bits < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    ones: dict[int, np.ndarray] = {}
    todo = [(bits - 1, root)]
    while todo:
        bit, pairs = todo.pop()
        if pairs.shape[1] > FRONTIER:
            todo += [(bit, pairs[:, FRONTIER:]), (bit, pairs[:, :FRONTIER])]
            continue
        a, b = pairs[1] - pairs[0], pairs[3] - pairs[2]
        single = (a == 1) & (b == 1)
        i, j = pairs[0][single], pairs[2][single]
        i, j = i[i != j], j[i != j]
        near = np.bitwise_count((keys[i] ^ keys[j]) & low) <= budget
        if near.any():
            yield i[near], j[near]
        pairs = pairs[:, ~single]
        if not pairs.shape[1] or bit < 0:
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        c = ones[bit]
        a0, a2, b0, b2, d = pairs
        a1, b1 = a2 - (c[a2] - c[a0]), b2 - (c[b2] - c[b0])
        same = a0 == b0
        children = np.concatenate([np.stack(x) for x in ((a0, a1, b0, b1, d), (a1, a2, b1, b2, d), (a0, a1, b1, b2, d + 1))] + [np.stack((a1, a2, b0, b1, d + 1))[:, ~same]], axis=1)
        children = children[:, (children[0] < children[1]) & (children[2] < children[3]) & (children[4] <= budget)]
        if children.shape[1]:
            todo.append((bit - 1, children))


def links(distinct: DataFrame, budget: int = BITS) -> DataFrame:
    """(a, b) for all pairs of distinct(fp) that differ in 1 to `budget` bits, each once.

    The 64 bits are cut into budget + 1 blocks; a near pair agrees in at least one. For each block, fingerprints are dealt out by its value and the
    tries of what remains are joined within each value; a pair comes from the first block in which it agrees. So a task gets a few groups that shrink
    as 1 / 2^(64 / (budget + 1)) of all fingerprints, and the work in a group is far below its square: no group is capped."""
    C.ship(distinct.sparkSession)
    n = budget + 1
    cuts = [64 * k // n for k in range(n + 1)]
    fp = F.col("fp")
    turned = F.array(*[F.struct(F.lit(k).alias("block"), (F.shiftleft(fp, c).bitwiseOR(F.shiftrightunsigned(fp, 64 - c)) if c else fp).alias("turned")) for k, c in enumerate(cuts[:-1])])
    widths = F.element_at(F.array(*[F.lit(64 - (cuts[k + 1] - cuts[k])) for k in range(n)]), F.col("block") + 1)
    rows = distinct.select(F.explode(turned).alias("x")).select("x.*")
    rows = rows.select("block", F.call_function("shiftrightunsigned", F.col("turned"), widths).alias("bucket"), "turned")
    rows = rows.repartition("block", "bucket").sortWithinPartitions("block", "bucket")

    def found(block: np.ndarray, turned: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in range(n):
            keys = np.sort(turned[block == k])
            bits = 64 - (cuts[k + 1] - cuts[k])
            for i, j in trie_pairs(keys, keys >> np.uint64(bits), bits, budget):
                pair = [np.bitwise_or(x >> np.uint64(cuts[k]), x << np.uint64(64 - cuts[k])) if cuts[k] else x for x in (keys[i], keys[j])]
                first = np.ones(len(i), bool)
                for e in range(k):  # agrees in no earlier block
                    first &= ((pair[0] ^ pair[1]) << np.uint64(cuts[e])) >> np.uint64(64 - (cuts[e + 1] - cuts[e])) != 0
                if first.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[first].view(np.int64)) for x in pair], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            block, bucket, turned = (batch.column(c).to_numpy() for c in range(3))
            last = np.flatnonzero((block != block[-1]) | (bucket != bucket[-1]))  # the last group may go on in the next batch
            cut = last[-1] + 1 if len(last) else 0
            if cut or held and (held[-1][0][-1], held[-1][1][-1]) != (block[0], bucket[0]):
                parts = [*held, (block[:cut], bucket[:cut], turned[:cut])]
                yield from found(np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts]).view(np.uint64))
                held = []
            held.append((block[cut:].copy(), bucket[cut:].copy(), turned[cut:].copy()))
        if held:
            yield from found(np.concatenate([p[0] for p in held]), np.concatenate([p[2] for p in held]).view(np.uint64))

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, budget: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs(doc_id, text): rows whose fingerprints are equal or joined by a chain
    of links are one component, named by its smallest doc_id.

    Copies meet in one fingerprint before anything is joined. Rows without words have fingerprint 0 and link like others. A null doc_id takes part
    but names a component only if all its ids are null. Repeated rows stay. An empty table gives no rows; other columns are not read."""
    prints = C.materialize(fingerprints(docs, shingle))
    distinct = C.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = C.materialize(C.components(links(distinct, budget)))
    least = linked.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("low"))
    named = C.materialize(linked.join(least, "root").select(F.col("node").alias("fp"), "low"))
    names = distinct.join(C.sized(named), "fp", "left").select(F.col("fp").alias("f"), F.coalesce("low", "least").alias("component_id"))
    return prints.join(C.sized(names), F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
