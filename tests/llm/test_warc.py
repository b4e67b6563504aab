import hashlib

import pytest
import zstandard
from evigraph.llm import common as C
from evigraph.llm import warc
from pyspark.sql import functions as F

BIG = "x" * 600 + "é" * 300
PAGES = [(1, "http://a/1", BIG, 5), (2, "http://a/2", BIG, 5), (3, None, "small", 5), (4, "http://a/4 b\r\nX: y", "small", 5), (5, "u", None, 5), (6, "u", "", 5), (9, "http://a/9", BIG, 5), (9, "http://a/9", BIG, 5), (None, "n", BIG, 5), (10, "u", "y" * 999, 5), (11, "u", "y" * 999, 5), (12, "u", "z" * 1000 + "\r\n\r\nWARC/1.1\r\n", 5), (13, "u", "z" * 1000 + "\r\n\r\nWARC/1.1\r\n", 5)]


def plain(rows):
    top = {}
    for i, html in rows:
        b = (html or "").encode()
        if i is not None and len(b) >= 1000:
            top[b] = max(i, top.get(b, i))
    out = []
    for i, html in rows:
        b = (html or "").encode()
        again = i is not None and len(b) >= 1000 and i < top[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=repr)


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, frame int")


def test_round_trip(spark, pages):
    whole = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for frame in (pages, whole, pages.limit(0)):
        got = sorted((tuple(r)[:5] for r in warc.archive(frame, C.fresh_dir(spark, "warc")).collect()), key=repr)
        assert got == plain([(r.page_id, r.html) for r in frame.collect()])


def test_index_leads_to_records_and_files_are_plain_zstandard(spark, pages):
    folder = C.fresh_dir(spark, "warc")
    index = warc.write(pages.repartition(2), folder, frame_bytes=2000, bundle_bytes=300).collect()
    assert len(index) == len(PAGES) and len({r.bundle for r in index}) > 2
    for r in index:
        fields, block = warc.read_record(f"{folder}/{r.bundle}", r.frame, r.at)
        assert warc.page_of(fields["warc-record-id"]) == r.page_id
        if r.page_id == 4:
            assert "x" not in fields and block.endswith(b"small")
    for name in {r.bundle for r in index}:
        data = open(f"{folder}/{name}".removeprefix("file:"), "rb").read()
        text = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        at, n = 0, 0
        while at < len(text):
            _, _, at = warc.parse(text, at)
            n += 1
        assert n == sum(r.bundle == name for r in index)


def test_damage_is_found(spark, pages):
    folder = C.fresh_dir(spark, "warc")
    row = warc.write(pages.where("page_id = 1").coalesce(1), folder).first()
    path = f"{folder}/{row.bundle}".removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[-1] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError, match="seek table"):
        warc.read_record(path, row.frame, row.at)


def test_a_hot_payload(spark):
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.lit(BIG)).otherwise(F.concat(F.lit(BIG), F.col("id").cast("string"))).alias("html"))
    got = warc.archive(many, C.fresh_dir(spark, "warc"))
    assert got.where("record_type = 'revisit'").count() == 999 and got.where("refers_to <> 2997").count() == 0


def test_a_bundle_has_several_frames(spark, pages):
    index = warc.write(pages.coalesce(1), C.fresh_dir(spark, "warc"), frame_bytes=2000).collect()
    assert len({r.bundle for r in index}) == 1 and max(r.frame for r in index) > 1
    assert {r.at for r in index if r.frame == 2} >= {0}


def test_a_page_with_several_payloads(spark):
    a, b, c, d = (x * 1200 for x in "abcd")
    rows = [(3, a), (3, b), (5, a), (5, c), (5, c), (7, b), (3, a), (8, d), (8, "short"), (4, "short"), (None, a)]
    pages = spark.createDataFrame([(i, None, x) for i, x in rows], "page_id long, url string, html string")
    folder = C.fresh_dir(spark, "warc")
    got = warc.archive(pages, folder).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == plain(rows)
    # every payload is in some response, found in the index that lies beside the bundles
    index = warc.index_of(spark, folder)
    stored = warc.read(spark, folder, index.where("page_id = 5"), payload=True)
    assert sorted(bytes(r.payload)[:1] for r in stored.collect()) == [b"a", b"c", b"c"]
    every = warc.read(spark, folder, payload=True).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in every} == {x for _, x in rows}
    assert {r.page_id for r in every if r.payload[:1] == b"b"} == {7}
