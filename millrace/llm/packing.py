"""Best-fit packing into sequences of several permitted lengths.

A document's tokens are its ids by a tokenizer and the end id, or, without a tokenizer, its words and one for
its end. Longer documents than the longest sequence are cut into full pieces and a rest. In descending order of
size each piece goes into the open bin with the least room that still takes it. If there is none, a bin opens,
of a length that depends on the piece's size class. At the end each bin shrinks to the least length that holds
its contents. The cost of a sequence is its length, a fixed part, and a part that grows with the square of the
length.

The lengths to open are optimised jointly over the sizes of all pieces: from the best single length, one
class after the other is moved to each other length for as long as the whole packing gets cheaper; the rule that
takes the least cost for each token stays if it is cheaper still. Packings are tried on the histogram of all
sizes (one row for each size), scaled down to TRIAL pieces.

Pieces are written once, and packed where they lie, without a shuffle: a task packs at most SHARD pieces or
SHARD_TOKENS tokens at a time, so memory is bounded and no key can gather rows. The numbers of bins of all tasks
are distinct. Null and empty texts are documents of size one. Repeated rows are packed each on its own. Ties in
size go by doc_id (null first). An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTHS = (256, 512, 1024, 2048, 4096)
FIXED_COST, SQUARE_COST = 24.0, 1 / 65536
SHARD, SHARD_TOKENS, TRIAL = 20_000, 4_000_000, 3000


def cost(length: int) -> float:
    return length + FIXED_COST + SQUARE_COST * length * length


def pack(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS, opening: dict[int, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, place in it and the bin's length for each of sizes, which descend and fit the longest length.

    opening names the length to open for each class (the least length that fits); without it, the permitted
    length whose cost for each token is least is opened, given what is left to fill it with.
    """
    permitted = sorted(lengths)
    left = int(sizes.sum())
    room: list[tuple[int, int]] = []  # (room, bin) of open bins, ascending
    used: list[int] = []
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(int(s) for s in sizes):
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            least = bisect_left(permitted, size)
            if opening is None:
                free = min(permitted[least:], key=lambda c: (cost(c) / min(c, left), -c))
            else:
                free = opening[permitted[least]]
            b = len(used)
            used.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += size
        left -= size
        if free > size:
            insort(room, (free - size, b))
    shrunk = np.array([permitted[bisect_left(permitted, u)] for u in used], dtype=np.int64)
    return bins, places, shrunk[bins] if len(used) else np.empty(0, np.int64)


def packing_cost(sizes: np.ndarray, lengths: tuple[int, ...], opening: dict[int, int] | None) -> float:
    bins, _, length = pack(sizes, lengths, opening)
    _, first = np.unique(bins, return_index=True)
    return float(sum(cost(int(c)) for c in length[first]))


def scaled(counts: dict[int, int], most: int = TRIAL) -> np.ndarray:
    """Sizes, descending, in the proportions of counts (size: number): all of them, or about most."""
    sizes = np.array(sorted(counts, reverse=True), dtype=np.int64)
    n = np.array([counts[s] for s in sizes.tolist()], dtype=np.int64)
    if n.sum() > most:  # shares of the running total, so that rare sizes count together
        edge = np.concatenate([[0.0], np.cumsum(n) / n.sum() * most])
        n = np.diff(np.round(edge).astype(np.int64))
    return np.repeat(sizes, n)


def best_opening(counts: dict[int, int], lengths: tuple[int, ...] = LENGTHS) -> dict[int, int] | None:
    """The length to open for each class, jointly best on the sizes counted; None for the rule of least cost."""
    permitted, sizes = sorted(lengths), scaled(counts)
    rule = packing_cost(sizes, lengths, None)
    # From the best of the single lengths (longer where a piece needs it).
    least, _, now = min((packing_cost(sizes, lengths, o), n, o) for n, o in enumerate({c: max(c, one) for c in permitted} for one in permitted))
    moved = True
    while moved:
        moved = False
        for c in permitted:
            for other in (x for x in permitted if x >= c and x != now[c]):
                tried = packing_cost(sizes, lengths, now | {c: other})
                if tried < least:
                    now, least, moved = now | {c: other}, tried, True
    return now if least < rule else None


_FIELDS = "doc_id long, piece long, first long, n_tokens long"


def _word_pieces(batch: pa.RecordBatch, longest: int) -> Iterator[tuple[int, int, int, bytes]]:
    for i, text in enumerate(batch.column(1)):
        words = (text.as_py() or "").split()
        for first in range(0, len(words) + 1, longest):
            own = words[first : first + longest]
            yield i, first, min(longest, len(words) + 1 - first), " ".join(own).encode("utf-8", "surrogatepass")


def _pieces(docs: DataFrame, longest: int, tokenizer_path: str | None, end_id: int) -> DataFrame:
    """doc_id, piece, first, n_tokens, content: words joined by a space, or ids as little-endian integers of two or four bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from .token_files import _slices, encoder

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = encoder(tokenizer_path) if tokenizer_path else None
        for batch in _slices(batches, 1):
            if own is None:
                found = list(_word_pieces(batch, longest))
            else:
                kind = "<u2" if max(len(own.word_end) - 1, end_id) < 1 << 16 else "<u4"
                found = []
                for i, ids in enumerate(own.encode(batch.column(1))):
                    ids = np.append(ids, np.uint32(end_id)).astype(kind)
                    found += [(i, at, min(longest, len(ids) - at), ids[at : at + longest].tobytes()) for at in range(0, len(ids), longest)]
            row, first, n, content = zip(*found)
            first = np.array(first, np.int64)
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(first // longest), pa.array(first), pa.array(n, pa.int64()), pa.array(content, pa.binary())], names=["doc_id", "piece", "first", "n_tokens", "content"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(shared.trimmed(run), f"{_FIELDS}, content binary")


def packed(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """doc_id, piece, first (of the document's tokens), n_tokens, bin, bin_length, place, and the tokens:
    ids (array of int) with a tokenizer, else text (the piece's words)."""
    pieces = shared.written(_pieces(docs, max(lengths), tokenizer_path, end_id), "pieces")
    counts = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # one row for each size
    opening = best_opening(counts, lengths)
    tokens = "ids array<int>" if tokenizer_path else "text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        opened = 0

        def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal opened
            table = pa.Table.from_batches(held)
            table = table.take(pc.sort_indices(table.drop(["content"]), sort_keys=[("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending")], null_placement="at_start"))
            bins, places, length = pack(table.column("n_tokens").to_numpy(), lengths, opening)
            number = (np.int64(shard) << np.int64(40)) + opened + bins
            opened += int(bins.max()) + 1
            for at in range(0, table.num_rows, 2000):
                part = table.slice(at, 2000).combine_chunks()
                content = part.column("content").combine_chunks()
                if tokenizer_path:
                    n = part.column("n_tokens").to_numpy()
                    raw = b"".join(content.to_pylist())
                    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * int(n.sum()) else "<u4").astype(np.int32)
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids))
                else:
                    last = content.cast(pa.string())
                own = [part.column(c).combine_chunks() for c in ("doc_id", "piece", "first", "n_tokens")]
                more = [pa.array(x[at : at + 2000]) for x in (number, length, places)]
                yield pa.RecordBatch.from_arrays([*own, *more, last], names=["doc_id", "piece", "first", "n_tokens", "bin", "bin_length", "place", tokens.split()[0]])

        held, size, total = [], 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                held.append(batch.slice(at, 1000))
                size += held[-1].num_rows
                total += pc.sum(held[-1].column(3)).as_py()
                if size >= SHARD or total >= SHARD_TOKENS:
                    yield from flush(held)
                    held, size, total = [], 0, 0
        if size:
            yield from flush(held)

    return pieces.mapInArrow(shared.trimmed(run), f"{_FIELDS}, bin long, bin_length long, place long, {tokens}")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return packed(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))
