import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from evigraph.llm import common as C
from evigraph.llm import tokenbin

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


BITS = [
    "a", "The", " ", "  ", "\n", "\t", "é", "'s", ".", "12", "\x1c", "\x85", "\xa0", "ß!", "-", "<|endoftext|>", "\r\n", "日本", "\U0001f600", "it's", " \n", "\n ",
    "\u180e", "\u200b", "\u2003", "\u2028", "\u3000", "Ωβ", "ǅ", "ʰ", "²", "½", "_", "don't,", "``", "(x)", "×", "÷", "a×b", "'", "''s", "9'", "é'll",
]


def test_encoder_gives_the_librarys_ids(library):
    encoder, draw = tokenbin.Encoder(PATH), random.Random(3)
    for _ in range(200):
        texts = [draw.choice(["", None, "".join(draw.choices(BITS, k=draw.randint(0, 14)))]) if k % 9 == 0 else "".join(draw.choices(BITS, k=draw.randint(0, 14))) for k in range(40)]
        ids, places = encoder.encode(pa.array(["skipped", *texts], pa.string()).slice(1))
        for k, text in enumerate(texts):
            assert ids[places[k] : places[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_other_tokenizers_are_encoded_whole():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, text = tokenbin.Encoder(path), "Some WORDS, and more\nof them"
    assert not encoder.cuts
    assert encoder.encode(pa.array([text]))[0].tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_memory_of_a_worker_is_bounded(library):
    draw, encoder = random.Random(5), tokenbin.Encoder(PATH, memory=200_000)
    for _ in range(20):
        texts = ["".join(draw.choices("abcdefghij", k=3000)), "".join(draw.choices("\x01\x02xyz", k=3000)), " ".join("".join(draw.choices("abcdefgh", k=7)) for _ in range(300))]
        ids, places = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(places, places[1:])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert sum(len(k) + len(v) + tokenbin.ENTRY_BYTES for k, v in encoder.known.items()) == encoder.held <= 200_000
        assert max(map(len, encoder.known)) <= tokenbin.LONGEST_PART


def test_slices_hold_whole_texts():
    texts = pa.array(["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 5])
    assert [*tokenbin.Encoder.slices(None, texts, 20)] == [(0, 2), (2, 3), (3, 6)]
    assert [*tokenbin.Encoder.slices(None, texts.slice(0, 0), 20)] == []


def test_round_trip(spark, sample, edge, empty, library):
    for docs in (sample, edge, empty):
        rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, at = [], 0
        for doc_id, text in rows:
            ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
            want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        got = tokenbin.encode_table(docs, C.fresh_dir(spark, "ids"), PATH).collect()
        assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want
        for r in got[:5]:
            doc_id, ids, _ = tokenbin.read_at(r.data_file, r.offset)
            assert doc_id == r.doc_id and zlib.crc32(ids.tobytes()) == r.ids_crc32


def test_records_are_read_through_the_index_in_any_order(spark, sample, library):
    folder = C.fresh_dir(spark, "ids")
    files = tokenbin.write(sample, folder, PATH).collect()
    texts = {r.doc_id: r.text for r in sample.collect()}
    places = [(f"{folder}/{f.data_file}", entry) for f in files for entry in tokenbin.read_index(f"{folder}/{f.index_file}")]
    assert len(places) == len(texts) == sum(f.docs for f in files)
    random.Random(1).shuffle(places)
    for path, entry in places:
        doc_id, ids, size = tokenbin.read_at(path, int(entry["offset"]))
        assert (doc_id, size, len(ids)) == (entry["doc_id"], entry["bytes"], entry["ids"])
        assert ids.tolist() == [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
    assert tokenbin.manifest(spark, folder).count() == len(files)


def test_a_wrong_index_is_found(spark, sample):
    folder = C.fresh_dir(spark, "ids")
    row = tokenbin.write(sample.limit(20).coalesce(1), folder, PATH).first()
    index = tokenbin.read_index(f"{folder}/{row.index_file}").copy()
    index["ids"][3] += 1
    with pytest.raises(ValueError, match="index"):
        [*tokenbin.read_blocks(f"{folder}/{row.data_file}", index)]


def test_a_hot_id_is_dealt_out(spark, library):
    """A null id and an id with a third of all rows each come in several files; the order holds."""
    rows = spark.range(6000).selectExpr("CASE id % 3 WHEN 0 THEN null WHEN 1 THEN 7 ELSE id - 3000 END AS doc_id", "concat('words of row ', id) AS text")
    got = sorted(tokenbin.encode_table(rows, C.fresh_dir(spark, "ids"), PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 2000 + sorted([7] * 2000 + [i - 3000 for i in range(2, 6000, 3)])
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    for hot in (None, 7):
        files = {r.data_file: 0 for r in got if r.doc_id == hot}
        assert len(files) > 1


def test_parts_keep_the_order():
    rng = np.random.default_rng(1)
    ids = [None if x < 20 else int(x) // 7 for x in rng.integers(0, 400, 3000)] + [13] * 3000
    hashes = rng.integers(-(2**63), 2**63 - 1, len(ids))
    for unknown, bounds in ((3, [5, 13, 13, 13, 40]), (1, []), (2, [13] * 6)):
        parts = tokenbin.part_of(pa.array(ids, pa.int64()), hashes, unknown, np.array(bounds, np.int64))
        rows = sorted(zip(((i is not None, i or 0) for i in ids), hashes.tolist(), parts.tolist()))
        assert all(a[2] <= b[2] for a, b in zip(rows, rows[1:]))
        assert parts.min() >= 0 and parts.max() <= unknown + len(bounds)


def test_damage_is_found(tmp_path):
    import io

    record = tokenbin.frame(5, np.array([1, 2, 3], "<u2").tobytes(), 2)
    doc_id, ids, _ = tokenbin.read_record(io.BytesIO(record))
    assert (doc_id, ids.tolist()) == (5, [1, 2, 3])
    for k in (0, 9, 20, len(record) - 1):
        with pytest.raises(ValueError):
            tokenbin.read_record(io.BytesIO(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :]))
