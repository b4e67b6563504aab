"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC/1.1 records of about a megabyte together, and a last, skippable frame with the
seek table of the Zstandard seekable format: for each frame its compressed and its plain size, then the number of frames, a descriptor and a magic
number. A reader seeks to any frame and decompresses it alone; any Zstandard tool can decompress the whole. The index, Parquet in `<folder>/index`
beside the bundles, maps a record's page_id to its bundle, frame and place in the plain frame; records are read through it."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1000
#: Plain bytes after which a frame ends, and compressed bytes after which a bundle ends; neither cuts a record.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame int, at long, length long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, bundle string, frame int, at long"
PAYLOAD = RECORD + ", payload binary"


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _uri(page_id: int | None, digest: str) -> str:
    """A record's name: its page and payload, for pages may share an id."""
    return f"urn:x-page:{'null' if page_id is None else page_id}:{digest}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record with an HTTP block around the payload, or a revisit record with the HTTP header alone that names the record that has it."""
    import base64
    from urllib.parse import quote

    name = _uri(page_id, digest)
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else name
    coded = base64.b32encode(bytes.fromhex(digest)).decode()
    shared = [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{coded}")]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
        head = [("WARC-Type", "response"), *shared]
    else:
        head = [("WARC-Type", "revisit"), *shared, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_uri(refers_to, digest)}>")]
    return _header([*head, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(header fields in lower case, block, place after the record) of the record at this place."""
    if not data.startswith(b"WARC/1.1\r\n", at):
        raise ValueError(f"no WARC record at {at}")
    end = data.index(b"\r\n\r\n", at)
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (line.partition(":") for line in data[at:end].decode().split("\r\n")[1:]))
    start = end + 4
    stop = start + int(fields["content-length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("damaged WARC record")
    return fields, data[start:stop], stop + 4


def page_of(uri: str) -> int | None:
    text = uri.strip("<>").split(":")[2]
    return None if text == "null" else int(text)


def described(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and payload of a record. A response's payload must have its header's digest and
    length; a revisit has the length in its HTTP header and no payload."""
    import base64

    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    refers = fields.get("warc-refers-to")
    if refers is None and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("damaged payload")
    return page_of(fields["warc-record-id"]), fields["warc-type"], page_of(refers) if refers else None, size, digest, None if refers else payload


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from a bundle's footer."""
    file.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE or descriptor & 0x7C:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    file.seek(size - 9 - n * width)
    table, out, at = file.read(n * width), [], 0
    for k in range(n):
        packed, plain = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, plain))
        at += packed
    return out


def read_record(bundle: str, frame: int, at: int) -> tuple[dict[str, str], bytes]:
    """The record at a place of a frame: reads the footer and that frame alone."""
    import zstandard

    fs, path = C.filesystem(bundle)
    with fs.open_input_file(path) as file:
        offset, packed, plain = read_seek_table(file, file.size())[frame]
        file.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    return parse(data, at)[:2]


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))


def revisits(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, key, refers_to): the pages whose payload another page with a larger id has too, the payload's SHA-256, and the largest such id. Only ids
    and digests are shuffled; copies of one payload are summed up in each task first. A page_id may come with several payloads."""
    big = _payloads(pages).where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull())
    keys = C.materialize(big.select("page_id", _key(least).alias("key")))
    shared = keys.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low")).where("low < refers_to").drop("low")
    found = keys.join(C.sized(C.materialize(shared)), "key").where("page_id < refers_to")
    return found.select("page_id", "key", "refers_to").distinct()


def _key(least: int) -> Column:
    """The SHA-256 of a payload that may be shared."""
    return F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256)))


def write(pages: DataFrame, folder: str, least: int = LEAST_SHARED, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes a record for each row of pages(page_id, url, html) and returns the index: page_id, bundle (a name in the folder), frame, at, length.

    Of records with equal payloads of at least `least` bytes, that of the largest page_id is a response and the others revisit it; a page_id may come
    with several payloads, and each is judged by itself. A null html is an empty payload; a null url is replaced by the record's URN; a row with a
    null page_id, and rows that share the largest page_id, are responses. An empty table writes no bundle. Other columns are not read. Pages are not
    shuffled while the revisits are few enough to be broadcast. The index lists the bundles of tasks that ended well; files of others are not in it."""
    C.arrow_batches(pages.sparkSession, 500)
    again = C.materialize(revisits(pages, least)).select(F.col("page_id").alias("p"), F.col("key").alias("k"), "refers_to")
    rows = _payloads(pages).select("page_id", "url", "payload", F.sha1("payload").alias("digest"), _key(least).alias("key"))
    rows = rows.join(C.sized(again), (F.col("page_id") == F.col("p")) & (F.col("key") == F.col("k")), "left")
    rows = rows.select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import zstandard

        press = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        fs, base = C.filesystem(folder)
        file, sizes, frame, held, entries, written, name = None, [], [], 0, [], 0, ""

        def flush():
            nonlocal frame, held, written
            if frame:
                data = press.compress(b"".join(frame))
                file.write(data)
                sizes.append((len(data), held))
                written += len(data)
                frame, held = [], 0

        def done():
            file.write(seek_table(sizes))
            file.close()
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = [pa.array(x, k) for x, k in zip(zip(*entries, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["page_id", "bundle", "frame", "at", "length"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if file is None:
                    fs.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    file, sizes, entries, written = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20), [], [], 0
                data = record(*row)
                entries.append((row[0], name, len(sizes), held, len(data)))
                frame.append(data)
                held += len(data)
                if held >= frame_bytes:
                    flush()
                    if written >= bundle_bytes:
                        yield done()
                        file = None
        if file is not None:
            flush()
            yield done()

    rows.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return index_of(pages.sparkSession, folder)


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """The index beside the bundles of a folder."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str, index: DataFrame | None = None, payload: bool = False) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest, bundle, frame, at and, if asked for, payload of the records of an index: that of
    the folder, or some of its rows.

    Rows of a bundle go to one task in the order of their frames; it reads the seek table and the frames that have a wanted record, each once.
    Digests of responses are computed from their payloads and compared with the headers."""
    index = index_of(spark, folder) if index is None else index
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "bundle", "frame", "at", "payload"]
    wanted = len(names) - (not payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain, now, data, table, path, fs = zstandard.ZstdDecompressor(), None, b"", [], "", None
        for batch in batches:
            out = []
            for bundle, frame, at, length in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if now is None or now[0] != bundle:
                    fs, path = C.filesystem(f"{folder}/{bundle}")
                    with fs.open_input_file(path) as file:
                        table = read_seek_table(file, file.size())
                if now != (bundle, frame):
                    offset, packed, size = table[frame]
                    with fs.open_input_file(path) as file:
                        file.seek(offset)
                        data = plain.decompress(file.read(packed), max_output_size=size)
                    now = (bundle, frame)
                fields, block, end = parse(data, at)
                if end != at + length:
                    raise ValueError(f"the index of {bundle} does not fit its records")
                *row, body = described(fields, block)
                out.append((*row, bundle, frame, at, body)[:wanted])
            if out:
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds[:wanted], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names[:wanted])

    C.arrow_batches(spark, 500)
    rows = index.select("bundle", "frame", "at", "length")
    bundles = rows.select("bundle").distinct().count()
    rows = rows.repartition(max(1, min(bundles, 10_000)), "bundle").sortWithinPartitions("bundle", "frame", "at")
    return rows.mapInArrow(run, PAYLOAD if payload else RECORD)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages and reads the bundles back: page_id, payload_bytes, payload_digest, record_type, refers_to, bundle."""
    write(pages, folder)
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "bundle")
