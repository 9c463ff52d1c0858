"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters and digits, lower-cased. Documents and benchmark items that share a run of
SEED tokens are compared: running Karp-Rabin hashes find common runs of at least a search length, the
longest non-overlapping ones are marked as tiles, and the length is lowered until no run of MIN_TILE
tokens is left. Tiles may lie in any order, so reordered passages are caught. An item's coverage is the
share of its tokens in tiles; a document with an item covered to THRESHOLD or more is contaminated.

The benchmark passes in blocks of BLOCK_TOKENS tokens at most (one item at least), files in the shared folder;
the driver and each task hold one block at a time, however large the benchmark is. Documents are never shuffled. Items shorter than SEED tokens
are one seed, if they have any. Null or empty items and texts match nothing. Repeated items give the
smallest item_id. Columns of any other name are kept as they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SEED = 5
MIN_TILE = 5
THRESHOLD = 0.6
BLOCK_TOKENS = 2_000_000
_OTHER = re.compile(r"[^\x00-\x7f\w]+")
_ASCII = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[bytes]:
    """The runs of letters and digits, lower-cased, in UTF-8."""
    low = (text or "").lower()
    if not low.isascii():
        low = _OTHER.sub(" ", low)
    return low.encode("utf-8", "surrogatepass").translate(_ASCII).split()


def _windows(x: list[int], free: bytearray, s: int) -> Iterator[tuple[int, int]]:
    """(hash, place) of each run of s free tokens, the hash rolled from one to the next."""
    top = pow(_BASE, s - 1, _MOD)
    h = run = 0
    for i, v in enumerate(x):
        if not free[i]:
            h = run = 0
            continue
        if run >= s:
            h = (h - x[i - s] * top) % _MOD
        h = (h * _BASE + v) % _MOD
        run += 1
        if run >= s:
            yield h, i - s + 1


def _free_runs(free: bytearray) -> list[int]:
    """How many free places follow each one, its own included."""
    out, run = [0] * len(free), 0
    for i in range(len(free) - 1, -1, -1):
        run = run + 1 if free[i] else 0
        out[i] = run
    return out


def _common(a: list[int], i: int, b: list[int], j: int, most: int) -> int:
    """The length, up to most, of the common prefix of a[i:] and b[j:]: by doubling, then by halves."""
    n, step = 0, 4
    while n + step <= most and a[i + n : i + n + step] == b[j + n : j + n + step]:
        n += step
        step *= 2
    low, high = n, min(most, n + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[i + low : i + middle] == b[j + low : j + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def tile(doc: list[int], item: list[int], least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (place in doc, place in item, length) of greedy string tiling by running Karp-Rabin.

    A match that can start a place earlier is found there, so an item's places are kept by the token before
    them, and those with the document's own one are passed over together: repeated tokens give no pairs.
    """
    free_d, free_i = bytearray(b"\1" * len(doc)), bytearray(b"\1" * len(item))
    tiles: list[tuple[int, int, int]] = []
    least = max(1, min(least, len(item)))
    s = max(least, min(len(item), 64))
    while True:
        table: dict[int, dict[int | None, list[int]]] = {}
        for h, p in _windows(item, free_i, s):
            before = item[p - 1] if p and free_i[p - 1] else None
            table.setdefault(h, {}).setdefault(before, []).append(p)
        found: list[tuple[int, int, int]] = []
        if table:
            run_d, run_i = _free_runs(free_d), _free_runs(free_i)
            for h, d in _windows(doc, free_d, s):
                places = table.get(h)
                if not places:
                    continue
                before = doc[d - 1] if d and free_d[d - 1] else None
                for token, ps in places.items():
                    if token is None or token != before:
                        for p in ps:
                            n = _common(doc, d, item, p, min(run_d[d], run_i[p]))
                            if n >= s:
                                found.append((-n, d, p))
        found.sort()
        again = False
        for n, d, p in found:
            n = -n
            if 0 not in free_i[p : p + n] and 0 not in free_d[d : d + n]:
                free_d[d : d + n] = bytes(n)
                free_i[p : p + n] = bytes(n)
                tiles.append((d, p, n))
            else:
                again = True  # a part of it may still be free
        if again:
            continue
        if s == least:
            return tiles
        s = max(least, s // 2)


class Index:
    """A block of the benchmark: its vocabulary, its seeds and its items."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[int, list[int]]] = []
        seeds: dict[tuple[int, ...], list[int]] = defaultdict(list)
        short = defaultdict(list)
        for item_id, text in items:
            x = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in tokens(text)]
            if not x:
                continue
            k = len(self.items)
            self.items.append((item_id, x))
            if len(x) < SEED:
                short[tuple(x)].append(k)
            for run in {tuple(x[i : i + SEED]) for i in range(len(x) - SEED + 1)}:
                seeds[run].append(k)
        self.seeds, self.short = dict(seeds), dict(short)
        # One byte for each of at least 32 times as many places as there are seeds; hits are looked up.
        self.shift = np.uint32(32 - min(28, max(10, (32 * len(self.seeds)).bit_length())))
        self.table = np.zeros(1 << (32 - int(self.shift)), bool)
        for run in self.seeds:
            self.table[self._hash(np.array(run, np.uint32)) >> self.shift] = True

    @staticmethod
    def _hash(x: np.ndarray) -> np.ndarray:
        """The Karp-Rabin hash of each run of SEED tokens, mixed."""
        n = len(x) - SEED + 1
        h = x[:n].copy()
        for j in range(1, SEED):
            h *= np.uint32(0x01000193)
            h += x[j : j + n]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x9E3779B1)
        return h

    def best(self, text: str | None) -> tuple[float, int | None, int]:
        """The highest coverage, its item and the tokens tiled of it."""
        words = tokens(text)
        x = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint32, len(words))
        near: dict[int, list[int]] = defaultdict(list)
        if len(x) >= SEED and self.seeds:
            for i in np.flatnonzero(self.table[self._hash(x) >> self.shift]).tolist():
                for k in self.seeds.get(tuple(x[i : i + SEED].tolist()), ()):
                    near[k].append(i)
        for run, ks in self.short.items():
            m = len(run)
            places = [i for i in np.flatnonzero(x == run[0]).tolist() if tuple(x[i : i + m].tolist()) == run]
            for k in ks if places else ():
                near[k] += places
        best: tuple[float, int | None, int] = (0.0, None, 0)
        doc = x.tolist() if near else []
        for k, places in sorted(near.items(), key=lambda kv: self.items[kv[0]][0]):
            item_id, item = self.items[k]
            # Only around seeds can there be tiles; unknown tokens part the pieces.
            piece: list[int] = []
            upto = -1
            for p in sorted(places):
                low, high = max(0, p - len(item)), min(len(doc), p + SEED + len(item))
                if low > upto and piece:
                    piece.append(0)
                piece += doc[max(low, upto, 0) : high]
                upto = max(upto, high)
            covered = sum(t[2] for t in tile(piece, item))
            if covered / len(item) > best[0]:
                best = (covered / len(item), item_id, covered)
        return best


def blocks(benchmark: DataFrame, block_tokens: int) -> Iterator[list[tuple[int, str]]]:
    held: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        n = 1 + r.text.count(" ")
        if held and size + n > block_tokens:
            yield held
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += n
    if held:
        yield held


def _against(uris: list[str]):
    held: dict[int, Index] = {}

    def index(k: int) -> Index:
        """One block at a time; the last one stays for the next batch, which begins with it."""
        if k not in held:
            held.clear()
            fs, path = pafs.FileSystem.from_uri(uris[k])
            with fs.open_input_file(path) as source:
                table = pa.ipc.open_file(source).read_all()
            held[k] = Index(list(zip(table.column(0).to_pylist(), table.column(1).to_pylist())))
        return held[k]

    @F.pandas_udf("coverage double, item_id long, n_tiled int")
    def run(texts: pd.Series) -> pd.DataFrame:
        best: list[tuple[float, int | None, int]] = [(0.0, None, 0)] * len(texts)
        for k in sorted(range(len(uris)), reverse=len(uris) - 1 in held):
            own = index(k)
            for i, t in enumerate(texts):
                x = own.best(t)
                # The highest coverage, and of equal ones the smaller item.
                if x[0] > best[i][0] or (x[1] is not None and x[0] == best[i][0] > 0 and (best[i][1] is None or x[1] < best[i][1])):
                    best[i] = x
        items = pd.array([b[1] for b in best], dtype="Int64")
        shared.trim()
        return pd.DataFrame({"coverage": [b[0] for b in best], "item_id": items, "n_tiled": np.array([b[2] for b in best], dtype=np.int32)})

    return run


def coverage(text: Column, spark: SparkSession, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> Column:
    """A struct: coverage of the item covered best, item_id, n_tiled."""
    folder = shared.scratch_path(spark, "benchmark")
    uris = []
    for block in blocks(benchmark, block_tokens):
        uris.append(f"{folder}/{len(uris)}.arrow")
        fs, path = pafs.FileSystem.from_uri(uris[-1])
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        table = pa.table({"item_id": pa.array([i for i, _ in block], pa.int64()), "text": pa.array([t for _, t in block], pa.string())})
        with fs.open_output_stream(path) as out, pa.ipc.new_file(out, table.schema) as writer:
            writer.write_table(table)
    if not uris:
        return F.struct(F.lit(0.0).alias("coverage"), F.lit(None).cast("long").alias("item_id"), F.lit(0).alias("n_tiled"))
    return _against(uris)(text)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text covers no item to THRESHOLD."""
    c = coverage(F.col("text"), docs.sparkSession, benchmark)
    (name,) = shared.fresh(docs, "_covered")
    return docs.withColumn(name, c).filter(F.col(name)["coverage"] < THRESHOLD).drop(name)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = documents.select("doc_id", coverage(F.col("text"), spark, benchmark).alias("c"))
    return rows.select("doc_id", "c.coverage", "c.item_id", "c.n_tiled", (F.col("c.coverage") >= THRESHOLD).alias("contaminated"))
