import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import shared, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows, end=2):
    t = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_match_the_tokenizer(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = token_files.op9_token_files(spark, sf).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_odd_rows(spark):
    rows = [(4, None), (2, ""), (None, "The end."), (9, "It's  <|endoftext|>. A,b ,c. d..  x!, <|ENDOFTEXT|>"), (-5, "Été ça\x1cÉ. ΣΑΣ. á"), (7, "word, " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as start")
    manifest = token_files.write_files(docs, PATH, shared.scratch_path(spark, "odd"), 2)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in token_files.read_files(spark, manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows)
    empty = token_files.write_files(docs.limit(0), PATH, shared.scratch_path(spark, "none"), 2)
    assert token_files.read_files(spark, empty).collect() == []


def test_repeated_ids_keep_one_order(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (1, "z"), (0, "q")], "doc_id long, text string").repartition(3)
    manifest = token_files.write_files(docs, PATH, shared.scratch_path(spark, "same"), 2)
    rows = sorted(token_files.read_files(spark, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [0, 1, 1, 1]
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]


class Watched(io.BytesIO):
    def __init__(self, raw):
        super().__init__(raw)
        self.taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        self.taken += n
        return super().read(n)


def test_reader_takes_only_the_frames_asked_for():
    rng = np.random.default_rng(0)
    out = io.BytesIO()
    writer = token_files.FileWriter(out, frame_bytes=4000)
    docs = [rng.integers(0, 49000, n).astype(np.uint32) for n in rng.integers(1, 900, 200)]
    for i, d in enumerate(docs):
        writer.add(i, d)
    writer.close()
    source = Watched(out.getvalue())
    reader = token_files.FileReader(source)
    before = source.taken
    assert np.array_equal(np.frombuffer(reader.document(120), "<u4"), docs[120])
    assert source.taken - before < 8000
    for i in (0, 199, 50):
        assert np.array_equal(np.frombuffer(reader.document(i), "<u4"), docs[i])
    damaged = bytearray(out.getvalue())
    damaged[reader.starts[3] + 30] ^= 1
    bad = token_files.FileReader(Watched(bytes(damaged)))
    where = int(np.flatnonzero(bad.index["frame"] == 3)[0])
    with pytest.raises(Exception):
        bad.document(where)


def test_any_zstandard_reader_gets_the_ids_in_order():
    import zstandard

    out = io.BytesIO()
    writer = token_files.FileWriter(out, frame_bytes=200)
    docs = [np.arange(n, dtype=np.uint32) for n in (3, 0, 90, 400, 1)]
    for i, d in enumerate(docs):
        writer.add(i, d)
    writer.close()
    assert out.getvalue()[-4:] == (0x8F92EAB1).to_bytes(4, "little")
    raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()
    assert raw == b"".join(d.tobytes() for d in docs)


def test_files_of_lost_attempts_are_removed(spark):
    import os

    docs = spark.createDataFrame([(1, "x y"), (2, "z")], "doc_id long, text string")
    folder = shared.scratch_path(spark, "lost")
    os.makedirs(folder)
    open(f"{folder}/{'0' * 32}.ids", "wb").write(b"half a file")
    manifest = token_files.write_files(docs, PATH, folder, 2)
    left = {n for n in os.listdir(folder) if n.endswith(".ids")}
    assert left == {r.uri.rpartition("/")[2] for r in manifest.collect()}


def test_a_forgetful_encoder_gives_the_same_ids(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_files, "KNOWN_RUNS", 3)
    own, plain = token_files.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["One, two; three!! four? fi've.", "six's seven-eight nine... İstanbul ǅ ﬁn áb", " ".join(f"w{i}x," for i in range(50)), "", "one, two"]
    for _ in range(3):
        got = [x.tolist() for x in own.encode(pa.array(texts))]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
