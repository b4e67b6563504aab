"""Token ids in framed binary files with an offset index.

A data file is a run of records. A record frames one document:

    length  uint64   bytes of the payload
    check   uint32   masked CRC-32 of the eight length bytes
    payload          flags uint8 (1: no doc_id, 2: ids of 4 bytes, else of 2), doc_id int64, number of ids uint32, the ids
    check   uint32   masked CRC-32 of the payload

All numbers are little-endian. Masking turns the CRC right by 15 bits and adds 0xA282EAD8, so that a checksum over data that hold checksums stays
sound. The index file beside a data file has 24 bytes for each record: doc_id int64 (0 if null), offset uint64, payload bytes uint32, ids uint32; it
lets a trainer read records in any order, and `read` goes through it. A manifest beside the files, in Parquet, names those that count: files of
failed or repeated tasks are not in it."""

from __future__ import annotations

import functools
import itertools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

END = 0
HEAD = "<BqI"
FRAME = "<QI"
CHECK = "<I"
#: Bytes of a record around its payload.
FRAMING = struct.calcsize(FRAME) + struct.calcsize(CHECK)
#: An entry of the index file.
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
#: Bytes of a worker's memory of encoded parts, what an entry takes besides its part and ids, and the longest part that is remembered.
CACHE_BYTES, ENTRY_BYTES, LONGEST_PART = 200_000_000, 200, 40
#: Rows of an Arrow batch, bytes of text that are cut and gathered together, and bytes of records that are read together.
BATCH_ROWS, SLICE_BYTES, BLOCK_BYTES = 2000, 8 << 20, 4 << 20
#: Kinds of bytes: what is none of these is 0.
WHITE, LETTER, DIGIT, MARK = 1, 2, 3, 4
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = MARK
KINDS[ord("0") : ord("9") + 1] = DIGIT
KINDS[ord("A") : ord("Z") + 1] = KINDS[ord("a") : ord("z") + 1] = LETTER
KINDS[ord("'")] = 0  # it may begin a piece with letters
KINDS[[*b"\t\n\v\f\r "]] = WHITE
#: UTF-8 of the white space beyond ASCII in the splitter's pattern, and the second bytes of the Latin-1 signs among the letters (fixed values).
WHITE_2 = [0xC285, 0xC2A0]
WHITE_3 = [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080]
SIGNS = [0x97, 0xB7]
WHITE_LEADS = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
#: Latin letters, perhaps after a blank.
LETTERS = re.compile("[ ]?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
MANIFEST = "part int, data_file string, index_file string, docs long, ids long"
RECORD = "doc_id long, at long, n_tokens long, ids_crc32 long, data_file string, offset long"


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 ones stand for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(others)}


BYTE_CHARS = _byte_chars()
BLANK = BYTE_CHARS[0x20]


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


class Encoder:
    """Ids of whole texts, the same as those of Tokenizer.encode(text, add_special_tokens=False).

    A byte-level BPE whose splitter is the usual one never has a piece across certain places of a text: before a run of white space, after a lone
    white space other than a blank, and inside a word between letters, digits and marks. A batch of texts is cut there by numpy; Arrow finds the
    distinct parts; each is encoded by the library once, runs of letters by its model alone, which the splitter would leave whole; and the ids of the
    texts are gathered from those of their parts. Short parts are remembered from batch to batch within a bound in bytes. A tokenizer of another
    kind, or a text that holds one of its added tokens, is one part."""

    def __init__(self, path: str, memory: int = CACHE_BYTES):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.to_str())
        splitter, model = spec.get("pre_tokenizer") or {}, spec["model"]
        usual = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token"))
        self.cuts = usual and plain and not spec.get("normalizer")
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.memory, self.held = memory, 0
        self.known: dict[bytes, bytes] = {}

    def places(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each byte, whether a part begins there; starts: where texts begin."""
        kinds = KINDS[data]
        blank = kinds == WHITE
        lead = np.flatnonzero(WHITE_LEADS[data])
        if len(lead):
            a, b, c = (np.append(data, [0, 0])[lead + k] for k in range(3))
            for width, found in ((2, np.isin(a.astype(int) * 256 + b, WHITE_2)), (3, np.isin((a.astype(int) * 256 + b) * 256 + c, WHITE_3))):
                for k in range(width):
                    blank[lead[found] + k] = True
        lead = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # two-byte Latin letters, without the signs for times and divided by
        if len(lead):
            lead = lead[~np.isin(np.append(data, 0)[lead + 1], SIGNS) | (data[lead] != 0xC3)]
            kinds[lead] = kinds[lead + 1] = LETTER
        first = np.zeros(len(data), bool)
        first[starts] = True
        cut = first.copy()
        cut[1:] |= (blank[1:] & ~blank[:-1]) | ((kinds[1:] != kinds[:-1]) & (kinds[1:] >= LETTER) & (kinds[:-1] >= LETTER))
        alone = np.flatnonzero(cut[:-1] & (kinds[:-1] == WHITE) & (data[:-1] != 0x20) & ~blank[1:])
        cut[alone + 1] = True
        return cut

    def fresh(self, part: bytes) -> bytes:
        """The ids of a part from the library."""
        text = part.decode()
        if self.cuts and LETTERS.fullmatch(text):
            chars = BLANK + text[1:] if text[0] == " " else text
            if not text.isascii():
                chars = part.decode("latin-1").translate(BYTE_CHARS)
            ids = [t.id for t in self.model.tokenize(chars)]
        else:
            ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def parts(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of distinct parts, remembered or fresh."""
        found = [*map(self.known.get, distinct)]
        for k, ids in enumerate(found):
            if ids is None:
                part = distinct[k]
                found[k] = ids = self.fresh(part)
                if len(part) <= LONGEST_PART:
                    self.known[part] = ids
                    self.held += ENTRY_BYTES + len(part) + len(ids)
        if self.held > self.memory:  # the half that came first has the frequent parts
            self.known = dict(itertools.islice(self.known.items(), len(self.known) // 2))
            self.held = sum(ENTRY_BYTES + len(k) + len(v) for k, v in self.known.items())
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts in one array, the places in it where each text's begin, and the end). A null text has none."""
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[-1] == offsets[0]:
            return np.zeros(0, self.type), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        if self.cuts:
            cut = self.places(data, starts)
            for token in self.added:
                for row in np.flatnonzero(pc.match_substring(texts, token)):
                    cut[offsets[row] + 1 : offsets[row + 1]] = False
            begins = np.flatnonzero(cut)
        else:
            begins = starts
        begins = np.append(begins, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(data)]).dictionary_encode()
        found = self.parts(parts.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(found), self.type)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        which = parts.indices.to_numpy()
        lengths = sizes[which]
        ends = np.cumsum(lengths)
        take = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - lengths), lengths)
        take += np.arange(len(take))
        return flat[take], np.concatenate(([0], ends))[np.searchsorted(begins, offsets)]

    def slices(self, texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
        """Stretches of a batch with about so many bytes of text each, and one text at least."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield at, stop
            at = stop


@functools.lru_cache(maxsize=2)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder, with the parts that it remembers from earlier tasks."""
    return Encoder(path)


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack(HEAD, (doc_id is None) + 2 * (width == 4), doc_id or 0, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(CHECK, masked(zlib.crc32(length))) + payload + struct.pack(CHECK, masked(zlib.crc32(payload)))


def read_record(file):
    """(doc_id, ids as an array of uint32, payload bytes) of the record at the file's position; None at the end."""
    head = file.read(struct.calcsize(FRAME))
    if not head:
        return None
    length, check = struct.unpack(FRAME, head)
    if masked(zlib.crc32(head[:8])) != check:
        raise ValueError("damaged length")
    payload = file.read(length)
    if masked(zlib.crc32(payload)) != struct.unpack(CHECK, file.read(struct.calcsize(CHECK)))[0]:
        raise ValueError("damaged record")
    flags, doc_id, n = struct.unpack_from(HEAD, payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, struct.calcsize(HEAD)).astype("<u4")
    return None if flags & 1 else doc_id, ids, length


def read_at(data_file: str, offset: int):
    """The record that the index has at this offset."""
    fs, path = C.filesystem(data_file)
    with fs.open_input_file(path) as file:
        file.seek(offset)
        return read_record(file)


def read_index(index_file: str) -> np.ndarray:
    """The entries of an index file: doc_id, offset, bytes (of the payload) and ids of each record, in the order of the data file."""
    fs, path = C.filesystem(index_file)
    with fs.open_input_stream(path, compression=None) as file:
        return np.frombuffer(file.read(), ENTRY)


def read_blocks(data_file: str, index: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, tuple]]:
    """(offset, record) of each entry of the index, found by its offset. Neighbouring records come with one read of about `most` bytes."""
    import io

    fs, path = C.filesystem(data_file)
    starts = index["offset"].astype(np.int64)
    stops = starts + index["bytes"] + FRAMING
    with fs.open_input_file(path) as file:
        at = 0
        while at < len(index):
            stop = at + 1
            while stop < len(index) and starts[stop] == stops[stop - 1] and stops[stop] - starts[at] <= most:
                stop += 1
            file.seek(int(starts[at]))
            block = io.BytesIO(file.read(int(stops[stop - 1] - starts[at])))
            for k in range(at, stop):
                record = read_record(block)
                if record is None or record[2] != index["bytes"][k] or len(record[1]) != index["ids"][k]:
                    raise ValueError(f"the index of {data_file} does not fit its records")
                yield int(starts[k]), record
            at = stop


def stretches(docs: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """(parts for null ids, upper bounds of the other parts but the last): the order of docs by doc_id in about n parts of as many rows. One row of some
    n numbers comes to the driver. An id that is several bounds has several parts."""
    shares = [k / n for k in range(1, n)] or [0.5]
    bounds = F.percentile_approx("doc_id", shares, max(10_000, 20 * n))
    row = docs.select(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("rows"), F.count("doc_id").alias("known"), bounds.alias("bounds")).first()
    unknown = row["rows"] - row["known"]
    return -(-n * unknown // row["rows"]) if unknown else 0, np.array(row["bounds"] or [], np.int64)


def part_of(ids: pa.Array, hashes: np.ndarray, unknown: int, bounds: np.ndarray) -> np.ndarray:
    """The parts of rows by `stretches`: null ids first. Rows of an id with several parts, or of the null id, are dealt out by ranges of their hash, so
    that the parts in their order hold rows in ascending (id, hash)."""
    null = ids.is_null().to_numpy(zero_copy_only=False)
    known = pc.fill_null(ids, 0).to_numpy()
    low = np.where(null, 0, np.searchsorted(bounds, known, "left") + unknown)
    high = np.where(null, max(unknown - 1, 0), np.searchsorted(bounds, known, "right") + unknown)
    share = hashes / 2.0**64 + 0.5
    return np.minimum(low + (share * (high - low + 1)).astype(np.int64), high).astype(np.int32)


def encode(docs: DataFrame, tokenizer: str, end: int = END, unknown: int = 0, bounds: np.ndarray | None = None) -> DataFrame:
    """(doc_id, ids, h, part) of docs(doc_id, text): a text's ids and the end id, in the bytes of the file format; a hash of the text; and the row's
    part by `stretches`."""
    C.arrow_batches(docs.sparkSession, BATCH_ROWS)
    bounds = np.zeros(0, np.int64) if bounds is None else bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_of(tokenizer)
        for batch in batches:
            for start, stop in encoder.slices(batch.column(1)):
                doc_ids, texts, hashes = (c.slice(start, stop - start) for c in batch.columns)
                ids, places = encoder.encode(texts)
                ids = np.insert(ids, places[1:], end)
                offsets = ((places + np.arange(len(places))) * ids.itemsize).astype(np.int64)
                column = pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]).cast(pa.binary())
                parts = pa.array(part_of(doc_ids, hashes.to_numpy(), unknown, bounds))
                yield pa.RecordBatch.from_arrays([doc_ids, column, hashes, parts], names=["doc_id", "ids", "h", "part"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id long, ids binary, h long, part int")


def write(docs: DataFrame, folder: str, tokenizer: str, end: int = END) -> DataFrame:
    """Writes docs(doc_id, text) in ascending doc_id order (nulls first, equal ids by a hash of their texts) and returns the manifest: a row for
    each data file, in order of `part`. The manifest lies in `<folder>/manifest` and outlives the session; it lists files of tasks that ended well.

    Texts are encoded where they are read, and the ids alone are exchanged, by parts whose bounds were found from the ids of the documents. A hot id
    has several parts; only rows with one id and one text stay together. A task streams its records into one file. A null text has the end id alone;
    an empty table gives no file; other columns are not read."""
    spark = docs.sparkSession
    width = vocabulary_width(tokenizer)
    unknown, bounds = stretches(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = encode(docs, tokenizer, end, unknown, bounds)
    ordered = rows.repartitionById(unknown + len(bounds) + 1, F.col("part")).sortWithinPartitions("doc_id", "h").select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, data, index = TaskContext.get().partitionId(), None, None
        offset, docs_written, ids_written = 0, 0, 0
        fs, base = C.filesystem(folder)
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if data is None:
                fs.create_dir(base, recursive=True)
                data = fs.open_output_stream(f"{base}/{name}.rec", compression=None, buffer_size=1 << 20)
                index = fs.open_output_stream(f"{base}/{name}.idx", compression=None, buffer_size=1 << 16)
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = frame(doc_id, ids, width)
                data.write(record)
                index.write(np.array((doc_id or 0, offset, len(record) - FRAMING, len(ids) // width), ENTRY).tobytes())
                offset += len(record)
                docs_written += 1
                ids_written += len(ids) // width
        if data is not None:
            data.close()
            index.close()
            columns = [([part], pa.int32()), ([f"{name}.rec"], pa.string()), ([f"{name}.idx"], pa.string()), ([docs_written], pa.int64()), ([ids_written], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=["part", "data_file", "index_file", "docs", "ids"])

    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def vocabulary_width(tokenizer: str) -> int:
    """Bytes of an id in the file format."""
    return encoder_of(tokenizer).type.itemsize


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder: part, data_file, index_file (names in the folder), docs and ids of each data file."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the folder's manifest, found through the index files and verified: doc_id, at (its place among the file's ids),
    n_tokens, ids_crc32, data_file, offset."""
    names = ["doc_id", "at", "n_tokens", "ids_crc32", "data_file", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data_name, index_name in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
                path, at, rows = f"{folder}/{data_name}", 0, []
                for offset, (doc_id, ids, _) in read_blocks(path, read_index(f"{folder}/{index_name}")):
                    rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes()), path, offset))
                    at += len(ids)
                    if len(rows) == 10_000:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    files = manifest(spark, folder).select("data_file", "index_file")
    return files.repartition(max(1, files.count()), "data_file").mapInArrow(run, RECORD)


def encode_table(docs: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Writes docs and reads the files back: doc_id, start (ids of all documents before it), n_tokens (with the end id), ids_crc32, data_file, offset.

    Starts need the sums of whole files alone: one row for each file, not for each document, meets in the running sum."""
    from pyspark.sql import Window

    spark = docs.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base")
    starts = write(docs, folder, tokenizer).select(F.concat(F.lit(f"{folder}/"), F.col("data_file")).alias("file"), base)
    got = read(spark, folder).join(C.sized(starts), F.col("data_file") == F.col("file"))
    return got.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "data_file", "offset")
