"""Token-ID output: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a run of zstandard frames that hold whole documents, each document its ids as little-endian
unsigned 32-bit integers. A skippable frame with the document index follows (compressed; for each
document its id, whether that is null, its frame, its place in the frame and its number of ids), and
then, at the very end, the seek table in the public seekable layout (compressed size, size and checksum
of each frame, then their number, a descriptor and a magic number). The index begins where the frames of
the seek table end. A reader loads the two tables and decompresses only the frames with the documents
asked for; any other zstandard reader gets the ids of the file in order. Frames also carry zstandard's
own content checksum.

Null texts are empty texts: they give the end id alone. Documents are in ascending doc_id order, null
ids first; rows that share an id follow the hash of their text, and repeated rows are repeated. Other
columns are ignored. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

FRAME_BYTES = 1 << 20
#: Bytes of input that a file takes at most, about.
FILE_BYTES = 64 << 20
_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_INDEX = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("frame", "<u4"), ("at", "<u4"), ("n", "<u4")])


class FileWriter:
    """Writes one file; add() takes documents in order."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES) -> None:
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.held: list[bytes] = []
        self.size = self.tokens = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, dtype="<u4").tobytes()
        if self.held and self.size + len(raw) > self.frame_bytes:
            self._flush()
        self.index.append((doc_id or 0, doc_id is None, len(self.frames), self.size, len(ids)))
        self.held.append(raw)
        self.size += len(raw)
        self.tokens += len(ids)

    def _flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        packed = self.packer.compress(np.array(self.index, dtype=_INDEX).tobytes())
        self.out.write(struct.pack("<II", _SKIPPABLE_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, _SEEK_MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE_SEEK, len(table) + len(footer)) + table + footer)


class FileReader:
    """Reads documents of one file by their place in it; holds one decompressed frame."""

    def __init__(self, source) -> None:
        self.source = source
        end = source.size()
        n, kind, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != _SEEK_MAGIC or kind != 0x80:
            raise ValueError("no seek table")
        self.frames = np.frombuffer(self._read(end - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.starts = [0, *accumulate(int(x) for x in self.frames[:, 0])]
        # The index frame lies between the last frame and the seek table.
        packed = self._read(self.starts[-1] + 8, end - 9 - 12 * n - 8 - self.starts[-1] - 8)
        self.unpacker = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.unpacker.decompress(packed), dtype=_INDEX)
        self.frame, self.raw = -1, b""

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def document(self, k: int) -> bytes:
        """The ids of the k-th document, as bytes."""
        row = self.index[k]
        frame = int(row["frame"])
        if frame != self.frame:
            packed, size, check = (int(x) for x in self.frames[frame])
            self.raw = self.unpacker.decompress(self._read(self.starts[frame], packed))
            if len(self.raw) != size or xxhash.xxh64_intdigest(self.raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {frame} is damaged")
            self.frame = frame
        at = int(row["at"])
        return self.raw[at : at + 4 * int(row["n"])]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


#: A run that ends in a letter a-z and ASCII punctuation (but the apostrophe): a token boundary parts them.
_POINTED = r"^(?P<word>.*[a-z])(?P<points>[!-&(-/:-@\[-`{-~]+)$"
#: Distinct runs an encoder keeps, and bytes of text it takes at once; either only bounds memory.
KNOWN_RUNS, TEXT_BYTES = 2_000_000, 12 << 20
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts for a tokenizers file whose pre-tokenizer drops white space and parts letters from the rest.

    Such a vocabulary never joins characters across white space, so the ids of a text are those of its runs
    between ASCII white space. Runs repeat, so each is encoded once and kept, up to a bound. Runs of letters
    alone are encoded many at a time, as one string, and parted again where a token ends a word; only if there
    are as many word ends as runs, else one by one. Texts that may hold a special token are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.word_end[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32)

    def _keep(self, runs: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Adds runs that aren't known, with their ids in turn; their places."""
        n, m = len(self.known), len(runs)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while n + m > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.sizes))
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + m] = sizes
        self.used += len(ids)
        self.known = pa.concat_arrays([self.known, runs])
        return np.arange(n, n + m)

    def _one_by_one(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.uint32), np.array([len(x) for x in found], np.int64)

    def _learn(self, runs: pa.Array) -> np.ndarray:
        """Encodes new runs; their places."""
        places = np.empty(len(runs), np.int64)
        letters = pc.utf8_is_alpha(runs).to_numpy(zero_copy_only=False)
        for which in (letters, ~letters):
            which = np.flatnonzero(which)
            for at in range(0, len(which), 5000):
                own = which[at : at + 5000]
                part = runs.take(pa.array(own))
                strings = part.to_pylist()
                ids = ends = np.empty(0, np.int64)
                if letters[own[0]]:
                    ids = np.array(self.tokenizer.encode(" ".join(strings), add_special_tokens=False).ids, np.uint32)
                    ends = np.flatnonzero(self.word_end[ids])
                sizes = np.diff(ends, prepend=-1)
                if len(ends) != len(own) or ends[-1] != len(ids) - 1:
                    ids, sizes = self._one_by_one(strings)
                places[own] = self._keep(part, ids, sizes)
        return places

    def _places(self, runs: pa.Array) -> np.ndarray:
        """Of different runs."""
        if len(self.known) > KNOWN_RUNS:
            self._forget()
        found = pc.index_in(runs, value_set=self.known)
        places = found.fill_null(-1).to_numpy().astype(np.int64)
        at = np.flatnonzero(places < 0)
        if not len(at):
            return places
        new = runs.take(pa.array(at))
        split = pc.extract_regex(new, _POINTED)
        pointed = split.is_valid().to_numpy(zero_copy_only=False)
        word, points = (split.filter(pa.array(pointed)).field(k) for k in (0, 1))
        parts = pa.concat_arrays([new.filter(pa.array(~pointed)), word, points]).dictionary_encode()
        own = pc.index_in(parts.dictionary, value_set=self.known).fill_null(-1).to_numpy().astype(np.int64)
        missing = np.flatnonzero(own < 0)
        own[missing] = self._learn(parts.dictionary.take(pa.array(missing)))
        own = own[parts.indices.to_numpy()]
        k, m = len(new) - int(pointed.sum()), int(pointed.sum())
        places[at[~pointed]] = own[:k]
        if m:
            a, b = own[k : k + m], own[k + m :]
            ids, _ = self._gather(np.column_stack([a, b]).ravel())
            places[at[pointed]] = self._keep(new.filter(pa.array(pointed)), ids, self.sizes[a].astype(np.int64) + self.sizes[b])
        return places

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs in turn, and where each ends."""
        sizes = self.sizes[slots]
        ends = np.cumsum(sizes, dtype=np.int32)  # TEXT_BYTES bound it, or one text
        places = np.repeat(self.starts[slots] - (ends - sizes), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return self.ids[places], ends

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; nulls are empty."""
        texts = texts.cast(pa.string()).fill_null("")
        special = pc.match_substring(texts, "<|")
        has = pc.any(special).as_py()
        plain = pc.if_else(special, "", texts) if has else texts
        runs = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        offsets = runs.offsets.to_numpy().astype(np.int64)
        words = runs.flatten().dictionary_encode()
        places = self._places(words.dictionary)
        ids, ends = self._gather(places[words.indices.to_numpy()])
        ends = np.concatenate([[0], ends])
        cuts = ends[offsets - offsets[0]]
        for i in range(len(texts)):
            if has and special[i].as_py():
                yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[cuts[i] : cuts[i + 1]]


def encoder(path: str) -> Encoder:
    """One for each process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _slices(batches: Iterable[pa.RecordBatch], column: int, most: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows with at most so many bytes of text, one row at least; small batches are put together."""
    held: list[pa.RecordBatch] = []
    size = 0

    def together() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(total[at - 1]) if at else 0
            end = int(np.searchsorted(total, before + most - size, side="right"))
            if end == at and held:  # no row fits any more
                yield together()
                held, size = [], 0
                continue
            end = max(at + 1, end)
            held.append(batch.slice(at, end - at))
            size += int(total[end - 1]) - before
            at = end
    if held:
        yield together()


def write_files(documents: DataFrame, tokenizer_path: str, folder: str, end_id: int) -> DataFrame:
    """Tokenise and write documents (doc_id, text) into folder; one row for each file, written already.

    Rows are dealt by ranges of (doc_id, hash of the text), so no range outgrows a task even if one id
    repeats; a range has about FILE_BYTES of input. Every attempt of a task writes a file of its own name;
    the returned manifest names the files of the attempts that succeeded, readers use no others, and those
    that other attempts left are removed.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    docs = docs.repartitionByRange(shared.partitions_for(documents, FILE_BYTES), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_path)
        end = np.uint32(end_id)
        writer = None
        for batch in _slices(batches, 1):
            ids = batch.column(0).to_pylist()
            if writer is None and ids:
                uri = f"{folder}/{uuid.uuid4().hex}.ids"
                fs, path = _open(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                stream, first = fs.open_output_stream(path), (ids[0], batch.column(2)[0].as_py())
                writer = FileWriter(stream)
            for doc_id, x in zip(ids, own.encode(batch.column(1))):
                writer.add(doc_id, np.append(x, end))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"uri": uri, "first_id": first[0], "first_h": first[1], "docs": len(writer.index), "tokens": writer.tokens}],
                schema=pa.schema([("uri", pa.string()), ("first_id", pa.int64()), ("first_h", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64())]),
            )

    manifest = shared.written(docs.mapInArrow(write, "uri string, first_id long, first_h long, docs long, tokens long"), "manifest")
    _remove_others(spark, folder, {r.uri.rpartition("/")[2] for r in manifest.select("uri").toLocalIterator()})
    return manifest


def _remove_others(spark: SparkSession, folder: str, keep: set[str]) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(path):
        for f in fs.listStatus(path):
            if f.getPath().getName() not in keep:
                fs.delete(f.getPath(), False)


def read_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files, from the files: doc_id, start, n_tokens, ids (as bytes).

    start counts the ids of all documents before; the driver adds up one number for each file.
    """
    files = sorted(manifest.collect(), key=lambda r: (r.first_id is not None, r.first_id or 0, r.first_h))
    starts = [0, *accumulate(r.tokens for r in files)]
    rows = [(r.uri, s) for r, s in zip(files, starts)]
    table = spark.createDataFrame(rows, "uri string, start long")
    if rows:
        table = table.repartition(len(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, path = _open(uri)
                with fs.open_input_file(path) as source:
                    reader = FileReader(source)
                    n = reader.index["n"].astype(np.int64)
                    begin = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                    for at in range(0, len(n), 1000):
                        part = reader.index[at : at + 1000]
                        yield pa.record_batch(
                            [
                                pa.array(part["doc_id"].astype(np.int64), mask=part["null"].astype(bool)),
                                pa.array(begin[at : at + 1000].astype(np.int64)),
                                pa.array(n[at : at + 1000]),
                                pa.array([reader.document(k) for k in range(at, at + len(part))], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.scratch_path(spark, "token-files")
    manifest = write_files(documents, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    rows = read_files(spark, manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc32_of(ids: Iterable[int]) -> int:
    return zlib.crc32(np.array(list(ids), dtype="<u4").tobytes())
