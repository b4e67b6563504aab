"""Language identification by a byte convolutional network, in numpy.

A text, in lower case and UTF-8, is cut into windows of 256 bytes, the last one padded with zero bytes. In a window each byte has an embedding of 8
numbers; filters of widths 2, 3 and 4 slide over them; the largest response of each filter goes through a linear layer. A text's logits are its
windows' logits weighted by their bytes, so that all of the text counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as C

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS, EMBEDDING = 8, 8
#: The training sample: so many documents of each language at most, those that hash lowest, so many documents in all, and so many windows of each. With
#: many languages each gets an equal share of the whole, of one document at least, so that none is left out. Whatever the texts are, at most TRAIN_TOTAL
#: (or as many as there are languages, if that is more) x TRAIN_WINDOWS windows come to the driver: 33 MB.
TRAIN_DOCS, TRAIN_TOTAL, TRAIN_WINDOWS = 250, 16_000, 8
EPOCHS, BATCH, RATE = 5, 64, 0.01
#: Windows that go through the network together.
CHUNK = 128
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The patches of windows (n x 256 bytes) and the filters' responses at each place. The narrower filters have zero weights at the end."""
        widest, n = WIDTHS[-1], len(windows)
        x = self.embed[windows].reshape(n, -1)
        places = WINDOW - widest + 1
        step = x.itemsize
        patches = np.lib.stride_tricks.as_strided(x, (n, places, widest * EMBEDDING), (x.strides[0], EMBEDDING * step, step))
        patches = np.ascontiguousarray(patches).reshape(n * places, -1)
        return patches, (patches @ self.filters).reshape(n, places, -1)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        out = [np.maximum(self.responses(windows[k : k + CHUNK])[1].max(axis=1) + self.bias, 0) @ self.out + self.out_bias for k in range(0, len(windows), CHUNK)]
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)


def windows_of(text: str) -> tuple[np.ndarray, int]:
    """All windows of a text, and its bytes."""
    data = text.lower().encode("utf-8", "replace")
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW), len(data)


def has_letter(text: str | None) -> bool:
    import regex

    return bool(text) and regex.search(r"\p{L}", text) is not None


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fits the network to windows and the places of their languages in langs, by Adam on the cross-entropy. Half of the windows are shortened in each
    epoch, so that short texts are known too. Languages weigh the same. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    widest, count = WIDTHS[-1] * EMBEDDING, FILTERS * len(WIDTHS)
    mask = np.zeros((widest, count), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
    f32 = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(langs, f32(256, EMBEDDING, scale=0.5), f32(widest, count, scale=0.3) * mask, np.zeros(count, np.float32), f32(count, len(langs), scale=0.3), np.zeros(len(langs), np.float32))
    net.embed[0] = 0
    params = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(labels) / len(langs) / np.maximum(np.bincount(labels, minlength=len(langs)), 1))[labels].astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, n = windows[rows].copy(), len(rows)
            short = rng.random(n) < 0.5
            ends = np.where(short, rng.integers(16, WINDOW + 1, n), WINDOW)
            x[np.arange(WINDOW)[None, :] >= ends[:, None]] = 0
            patches, z = net.responses(x)
            best = z.argmax(axis=1)
            pooled = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + net.bias
            active = np.maximum(pooled, 0)
            logits = active @ net.out + net.out_bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), labels[rows]] -= 1
            p *= (weight[rows] / n)[:, None]
            g = (p @ net.out.T) * (pooled > 0)
            chosen = patches.reshape(n, z.shape[1], -1)[np.arange(n)[:, None], best]
            grad_filters = np.einsum("nf,nfk->kf", g, chosen) * mask
            back = (g[:, :, None] * net.filters.T[None]).reshape(n, count, WIDTHS[-1], EMBEDDING)
            touched = x[np.arange(n)[:, None, None], best[:, :, None] + np.arange(WIDTHS[-1])]
            grad_embed = np.zeros_like(net.embed)
            np.add.at(grad_embed, touched.ravel(), back.reshape(-1, EMBEDDING))
            grad_embed[0] = 0
            step += 1
            for q, d, a, b in zip(params, [grad_embed, grad_filters, g.sum(axis=0), active.T @ p, p.sum(axis=0)], first, second, strict=True):
                a += 0.1 * (d - a)
                b += 0.001 * (d * d - b)
                q -= (RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return net


def held_out(doc_id):
    """Whether crc32 of the id as text is a multiple of 5; such documents are not learned from. A null id counts as empty text: held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, per_language: int = TRAIN_DOCS, total: int = TRAIN_TOTAL) -> DataFrame:
    """(key, text, lang): the distinct rows to learn from, of every language, at most per_language of each and `total` in all, but one of each at least.

    A row is known by the hash of its id, text and language: rows that share an id are rows of their own, and equal rows are one. Keys are chosen by
    a top-k for each language that each task applies to its own rows first; only the chosen ones come to the driver."""
    able = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    able = able.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    able = able.select(F.xxhash64("doc_id", "text", "lang").alias("key"), "text", "lang")
    languages = able.agg(F.count_distinct("lang")).first()[0]
    share = max(1, min(per_language, total // max(languages, 1)))
    ranked = able.select("key", "lang").withColumn("k", F.dense_rank().over(Window.partitionBy("lang").orderBy("key")))
    keys = [r[0] for r in ranked.where(F.col("k") <= share).select("key").distinct().collect()]
    few = F.broadcast(docs.sparkSession.createDataFrame([(k,) for k in keys], "chosen long"))
    return able.join(few, F.col("key") == F.col("chosen"), "left_semi").dropDuplicates(["key"])


def fit(docs: DataFrame, per_language: int = TRAIN_DOCS, total: int = TRAIN_TOTAL) -> Network | None:
    """The network learned from a bounded `sample` of docs(doc_id, text, lang): rows that are not held out, with a language and a text with a letter; None
    if there are none. Only the sample's windows come to the driver: 2 kB for each of its documents."""
    C.arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, langs, out = [], [], []
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found, _ = windows_of(text)
                for k in sorted({int(x) for x in np.linspace(0, len(found) - 1, TRAIN_WINDOWS)}):
                    keys.append(key)
                    langs.append(lang)
                    out.append(found[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["key", "lang", "x"])

    rows = sample(docs, per_language, total).mapInArrow(run, "key long, lang string, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["key"], r["lang"], bytes(r["x"])))
    langs = sorted({r["lang"] for r in rows})
    place = {lang: k for k, lang in enumerate(langs)}
    return train(np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.uint8).reshape(-1, WINDOW), np.array([place[r["lang"]] for r in rows]), langs)


def predict(texts: list[str | None], net: Network | None) -> list[tuple[str, float]]:
    """(language, its probability) of each text; ("und", 0) if it is null or has no letter, or nothing was learned."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if net is None:
        return out
    todo = [k for k, t in enumerate(texts) if has_letter(t)]
    if not todo:
        return out
    found = [windows_of(texts[k]) for k in todo]
    counts = np.array([len(w) for w, _ in found])
    sizes = np.full(counts.sum(), WINDOW, np.float32)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    sizes[starts + counts - 1] = [n - (len(w) - 1) * WINDOW for w, n in found]
    logits = net.logits(np.concatenate([w for w, _ in found])) * sizes[:, None]
    mean = np.add.reduceat(logits, starts, axis=0) / np.add.reduceat(sizes, starts)[:, None]
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for k, row in zip(todo, p, strict=True):
        best = int(row.argmax())
        out[k] = (net.langs[best], float(row[best]))
    return out


def identify(docs: DataFrame, per_language: int = TRAIN_DOCS, keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs(doc_id, text, lang), learned from its own labelled rows that are not held out.

    Texts are null, empty or of any length; repeated rows get equal answers; with no labelled row all are `und`; an empty table gives no rows.
    Every language is learned. Other columns are not read. With keep_row, the result has the whole rows, in a struct `row`, in place of doc_id. Nothing is shuffled but the sample's ids."""
    net = fit(docs, per_language)
    C.arrow_batches(docs.sparkSession, 500)

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0)
            answers = predict((first.field(place) if keep_row else first).to_pylist(), net)
            kept = range(0 if keep_row else 1, batch.num_columns)
            new = [pa.array([a for a, _ in answers], pa.string()), pa.array([s for _, s in answers], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*[batch.schema.names[c] for c in kept], "lang_pred", "score"])

    held = held_out(F.col("doc_id")).alias("held_out")
    rows = docs.select(F.struct("*").alias("row"), held) if keep_row else docs.select("text", "doc_id", held)
    schema = StructType(rows.schema.fields[0 if keep_row else 1 :]).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(run, schema)
