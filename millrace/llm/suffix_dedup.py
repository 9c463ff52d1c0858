"""Suffix-array deduplication of repeated byte strings, sorted deep and shallow.

Every byte covered by a string of LENGTH bytes that also starts anywhere else is removed. Not all
suffixes need sorting. Of the GRAM-byte strings in each LENGTH-byte window the one with the least hash
(the leftmost of equal ones) is the window's anchor; equal windows have equal anchors at one offset, so
repeated windows are found among the suffixes that start at anchors with equal GRAM-byte strings.

1. A pass over the texts gives the anchors: hash of the string, the range of windows it stands for, and
   a 128-bit hash of all bytes of that range. Anchors that occur once are dropped.
2. Equal ranges of an anchor are one, with a weight; every window of a range of weight two or more is
   repeated. These hashes pick what is sorted and fold copies; they decide nothing between ranges that differ.
3. One representative of each different range is sorted, its text to the right of the anchor in one suffix
   array and its reversed text to the left in another. Multikey quicksort works to a shallow depth, eight
   bytes for a character; blind tries order the groups with longer common prefixes. A window that reaches o
   bytes left of its anchor is repeated if another suffix shares LENGTH - o bytes to the right and o to the
   left: classes of the two arrays at these depths, for all o at once.
4. A group of more than GROUP ranges is too large for one task and is parted by its next bytes: the offsets o
   are halved, and of either half the ranges that share the bytes which all its windows have are a group of
   their own. In a part, ranges alike in all bytes of its windows are one again. So each round doubles no more
   than the rows of groups still too large, and log2(LENGTH - GRAM) rounds do: a part of one offset has one
   range. The result doesn't depend on GROUP.
5. Repeated ranges go back to their documents, where they are merged and cut out.

Null texts are empty. Repeated rows are documents of their own, whatever their id. Texts shorter than LENGTH
lose nothing. Long texts pass whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

LENGTH, GRAM = 200, 100
#: Ranges that a task sorts as one group.
GROUP = 500
#: Multikey quicksort goes this many bytes deep, in characters of eight; blind tries do the rest.
SHALLOW = 32
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram-byte string, by doubling: h[a+b](i) = h[a](i) * B^b + h[b](i + a)."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = 0x2545F4914F6CDD1D | 1
    power, size = _TABLE[data], 1
    out, done = None, 0
    left = gram
    while left:
        if left & 1:
            if out is None:
                out, done = power.copy(), size
            else:
                m = min(len(out), len(power) - done)
                out = out[:m] * np.uint64(pow(base, size, 1 << 64)) + power[done : done + m]
                done += size
        left >>= 1
        if left:
            power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
            size *= 2
    h = out[:n]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _first_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each width successive hashes, of equal ones the first."""
    # The place within the run decides ties, and needs no second array.
    least, size = h, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    n = len(least)
    # A run's first minimum: windows share it until it leaves or a smaller one enters.
    place = np.full(n, -1, np.int64)
    change = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.concatenate([change[1:], [n]])
    for s, e in zip(change.tolist(), ends.tolist()):
        # All windows s .. e-1 have the same least value v; its places lie in h[s : e - 1 + width].
        at = s + int(np.argmax(h[s : s + width] == least[s]))
        place[s : min(e, at + 1)] = at
        while at + 1 < e:  # it left a window that still has an equal one
            s = at + 1
            at = s + int(np.argmax(h[s : s + width] == least[s]))
            place[s : min(e, at + 1)] = at
    return place


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, number of windows) of the anchors of one text."""
    if len(data) < length:
        e = np.empty(0, np.int64)
        return np.empty(0, np.uint64), e, e, e
    h = _gram_hashes(data, gram)
    place = _first_minimum(h, length - gram + 1)
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.concatenate([start, [len(place)]]))
    return h[place[start]], place[start], start, count


# --- Deep-shallow sorting ---------------------------------------------------------------------------


def _words(data: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes at depth of each suffix, as one big-endian character. data is padded."""
    return np.ascontiguousarray(data[starts[:, None] + np.arange(depth, depth + 8)]).view(">u8").ravel().astype(np.uint64)


def _blind_trie(strings: list[bytes]) -> list[int]:
    """The order of strings of one length by a blind trie: only branching depths and bytes are kept.

    Each string goes down by the bytes at the branching depths alone, is compared with the leaf it
    reaches, and is put in where they first differ. Equal strings share a leaf.
    """
    root: object = [0]  # a leaf is a list of indices, an inner node (depth, {byte: node})
    for i in range(1, len(strings)):
        s = strings[i]
        node = root
        while isinstance(node, tuple):
            depth, kids = node
            node = kids.get(s[depth]) or next(iter(kids.values()))
        other = strings[node[0]]
        if s == other:
            node.append(i)
            continue
        low, high = 0, len(s)  # the first byte that differs, by halves
        while high - low > 1:
            mid = (low + high) // 2
            if s[low:mid] == other[low:mid]:
                low = mid
            else:
                high = mid
        parent, node = None, root
        while isinstance(node, tuple) and node[0] < low:
            parent, key = node, s[node[0]]
            node = node[1][key]
        if isinstance(node, tuple) and node[0] == low:
            node[1][s[low]] = [i]
            continue
        new = (low, {s[low]: [i], other[low]: node})
        if parent is None:
            root = new
        else:
            parent[1][key] = new
    out: list[int] = []
    todo: list[object] = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(data: np.ndarray, starts: np.ndarray, depth: int, shallow: int = SHALLOW) -> np.ndarray:
    """The order of the suffixes at starts by their first depth bytes (a multiple of eight).

    Multikey quicksort over characters of eight bytes: each round parts every group of equal prefixes by
    its next character. Groups left at the shallow depth go to blind tries.
    """
    order = np.arange(len(starts))
    groups = [(0, len(starts))] if len(starts) > 1 else []
    at = 0
    while groups and at < min(shallow, depth):
        member = np.concatenate([np.arange(s, e) for s, e in groups])
        group = np.repeat(np.arange(len(groups)), [e - s for s, e in groups])
        word = _words(data, starts[order[member]], at)
        rank = np.lexsort((word, group))
        order[member] = order[member[rank]]
        word, group = word[rank], group[rank]
        same = (word[1:] == word[:-1]) & (group[1:] == group[:-1])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        groups = [(int(member[s]), int(member[s]) + int(e - s) + 1) for s, e in zip(edge[::2], edge[1::2])]
        at += 8
    if at < depth:
        for s, e in groups:
            part = order[s:e]
            order[s:e] = part[_blind_trie([data[x + at : x + depth].tobytes() for x in starts[part].tolist()])]
    return order


def common_prefixes(data: np.ndarray, starts: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The length of the common prefix, up to depth, of each suffix and the one before it in order."""
    lcp = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 4096):
        a, b = starts[order[at - 1 : at + 4095]], starts[order[at : at + 4096]]
        a = a[: len(b)]
        differ = data[a[:, None] + np.arange(depth)] != data[b[:, None] + np.arange(depth)]
        lcp[at : at + 4096] = np.where(differ.any(1), differ.argmax(1), depth)
    return lcp


def repeated_windows(texts: list[bytes], places: np.ndarray, counts: np.ndarray, weights: np.ndarray, group: np.ndarray, length: int, gram: int, shallow: int = SHALLOW, low: np.ndarray | int = 0, high: np.ndarray | int | None = None) -> np.ndarray:
    """For each range, which of its windows are repeated, as (n, length - gram + 1) by the window's number.

    texts are ranges of bytes, with the anchor at places and counts windows; weights are how often each
    occurs, group numbers its anchor. Only windows that reach low to high bytes left of it are looked at.
    """
    n, width = len(texts), length - gram + 1
    left, right = width - 1, length
    pad = lambda x: -(-x // 8) * 8
    l8, r8 = pad(left), pad(right)
    forward, back = np.zeros((n, r8 + 8), np.uint8), np.zeros((n, l8 + 8), np.uint8)
    has_left, has_right = places, np.array([len(t) for t in texts]) - places
    for i, (t, p) in enumerate(zip(texts, places.tolist())):
        x = np.frombuffer(t, np.uint8)
        forward[i, : len(x) - p] = x[p:]
        back[i, :p] = x[:p][::-1]
    starts_r, starts_l = np.arange(n) * (r8 + 8), np.arange(n) * (l8 + 8)
    ranks = []
    for data, starts, depth in ((forward.ravel(), starts_r, r8), (back.ravel(), starts_l, l8)):
        order = deep_shallow(data, starts, depth, shallow)
        lcp = common_prefixes(data, starts, order, depth)
        ranks.append((order, lcp))
    out = np.zeros((n, width), bool)
    for o in range(width):
        # The window o bytes left of the anchor is number places - o of its range.
        number = places - o
        has = np.flatnonzero((number >= 0) & (number < counts) & (has_left >= o) & (has_right >= length - o) & (low <= o) & (o <= (width - 1 if high is None else high)))
        if not len(has):
            continue
        classes = []
        for (order, lcp), depth in zip(ranks, (length - o, o)):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(lcp < depth) if depth else 0
            classes.append(c[has])
        key = np.lexsort((classes[1], classes[0], group[has]))
        k = np.stack([group[has][key], classes[0][key], classes[1][key]])
        new = np.concatenate([[True], (k[:, 1:] != k[:, :-1]).any(0)])
        total = np.add.reduceat(weights[has][key], np.flatnonzero(new))
        again = np.empty(len(has), bool)
        again[key] = (total > 1)[np.cumsum(new) - 1]
        out[has[again], number[has[again]]] = True
    return out


# --- The job ----------------------------------------------------------------------------------------


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            data, offsets = shared.utf8(part.column(1))
            for i, row in enumerate(part.column(0).to_pylist()):
                yield row, data[offsets[i] : offsets[i + 1]]


def removals(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, runs): runs (first, n) of n successive repeated windows, of rows (row long, unique, and text)."""
    spark = rows.sparkSession
    width = length - gram + 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [[], [], [], [], [], [], []]
        size = 0
        for row, data in _documents(batches):
            h, place, start, count = anchors(data, length, gram)
            if not len(h):
                continue
            raw = memoryview(np.ascontiguousarray(data))
            digest = xxhash.xxh3_128_digest
            whole = np.frombuffer(b"".join([digest(raw[s : s + c + length - 1]) for s, c in zip(start.tolist(), count.tolist())]), np.int64).reshape(-1, 2)
            for x, y in zip(held, (h.view(np.int64), whole[:, 0], whole[:, 1], np.full(len(h), row, np.int64), place.astype(np.int32), start.astype(np.int32), count.astype(np.int16))):
                x.append(y)
            size += len(h)
            if size > 100_000:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in held], names=names)
                held, size = [[], [], [], [], [], [], []], 0
        if size:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in held], names=names)

    names = ["h", "w1", "w2", "row", "place", "start", "n"]
    found = shared.written(rows.select("row", "text").mapInArrow(find, "h long, w1 long, w2 long, row long, place int, start int, n short"), "anchors")
    # Anchors that occur again, and whether all their ranges are the same.
    same = (F.min("w1") == F.max("w1")) & (F.min("w2") == F.max("w2"))
    again = found.groupBy("h").agg(F.count("*").alias("c"), same.alias("one")).filter("c > 1")
    again = shared.written(again.select("h", "one"), "again")
    own = shared.written(found.join(again, "h").select("h", "one", "w1", "w2", "row", "place", "start", "n"), "own")
    shared.discard(found)
    shared.discard(again)
    run = lambda first, n: F.array(F.struct(first.cast("int").alias("first"), n.cast("int").alias("n")))
    done = own.filter("one").select("row", run(F.col("start"), F.col("n")).alias("runs"))

    ranges = own.filter("not one").groupBy("h", "w1", "w2").agg(F.count("*").alias("weight"), F.min(F.struct("row", "start", "place", "n")).alias("x"))
    ranges = shared.written(ranges.select("h", "w1", "w2", "weight", "x.*"), "ranges")
    wanted = ranges.groupBy("row").agg(F.collect_list(F.struct("h", "w1", "w2", "weight", "start", "place", "n")).alias("x"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for text, xs in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    out += [(x["h"], x["w1"], x["w2"], x["weight"], x["place"] - x["start"], x["n"], x["h"], 0, width - 1, raw[x["start"] : x["start"] + x["n"] + length - 1]) for x in xs]
                columns = list(zip(*out)) or [[]] * 10
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names=_PIECE)

    pieces = rows.join(wanted, "row").select("text", "x").mapInArrow(cut, "h long, w1 long, w2 long, weight long, place int, n int, node long, low int, high int, bytes binary")
    level = shared.written(pieces, "pieces")
    key = ["h", "w1", "w2"]
    marks = [ranges.filter("weight > 1").select(*key, run(F.lit(0), F.col("n")).alias("runs"))]
    while True:
        crowded = shared.written(level.groupBy("node").count().filter(F.col("count") > GROUP).select("node"), "crowded")
        if crowded.isEmpty():
            marks.append(_sorted(level, length, gram))
            break
        marks.append(_sorted(level.join(crowded, "node", "left_anti").select(*_PIECE), length, gram))
        parts = shared.written(_halved(level.join(crowded, "node", "left_semi").select(*_PIECE), length), "parts")
        # Ranges alike in all bytes that a part's windows have are one; their windows there are repeated.
        classes = parts.groupBy("node", "alike").agg(F.count("*").alias("c"), F.sum("weight").alias("total"), F.min(F.struct(*key)).alias("first"))
        classes = shared.written(classes, "classes")
        of = F.struct(*key) == F.col("first")
        parts = parts.join(classes, ["node", "alike"])
        marks.append(parts.filter("c > 1").select(*key, run(F.col("place") - F.col("to"), F.col("to") - F.col("from") + 1).alias("runs")))
        level = shared.written(parts.filter(of).withColumn("weight", F.col("total")).select(*_PIECE), "pieces")
    both = marks[0]
    for m in marks[1:]:
        both = both.unionByName(m)
    marked = shared.written(both.groupBy(*key).agg(F.flatten(F.collect_list("runs")).alias("runs")), "marks")
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("start")).cast("int").alias("first"), r["n"].alias("n")))
    back = own.filter("not one").select(*key, "row", "start").join(marked, key).select("row", moved.alias("runs"))
    return done.unionByName(back)


_PIECE = ["h", "w1", "w2", "weight", "place", "n", "node", "low", "high", "bytes"]


def _halved(pieces: DataFrame, length: int) -> DataFrame:
    """Each piece in either half of its group's offsets, where it has windows.

    node is of the bytes that all windows of the half have, alike of those that any window of the piece has.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("low").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("high").alias("b"))))
    p = pieces.withColumn("half", half)
    p = p.withColumn("from", F.greatest("half.a", F.col("place") - F.col("n") + 1)).withColumn("to", F.least("half.b", "place")).filter(F.col("from") <= F.col("to"))
    # A window at offset o has the bytes from o left of the anchor to length - o right of it.
    common = F.substring("bytes", F.col("place") - F.col("half.a") + 1, F.col("half.a") + length - F.col("half.b"))
    whole = F.substring("bytes", F.col("place") - F.col("to") + 1, F.col("to") + length - F.col("from"))
    node = F.xxhash64("h", "half.a", "half.b", common)
    return p.select("h", "w1", "w2", "weight", "place", "n", node.alias("node"), F.col("half.a").alias("low"), F.col("half.b").alias("high"), "bytes", "from", "to", F.md5(F.concat(F.encode(F.concat_ws(",", "from", "to", F.lit("")), "utf-8"), whole)).alias("alike"))


def _sorted(pieces: DataFrame, length: int, gram: int) -> DataFrame:
    """The repeated windows of groups (node) that a task can hold, by deep-shallow sorting."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups lie together; as many as fit are sorted at once."""
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(part: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(part)
            column = lambda c: t.column(c).to_numpy()
            repeated = repeated_windows(t.column("bytes").to_pylist(), column("place").astype(np.int64), column("n").astype(np.int64), column("weight"), column("node"), length, gram, low=column("low"), high=column("high"))
            which, first, n = _runs(repeated)
            runs = pa.StructArray.from_arrays([pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], names=["first", "n"])
            return pa.record_batch([pa.array(column(c)[which]) for c in ("h", "w1", "w2")] + [pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32)), runs)], names=["h", "w1", "w2", "runs"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 40_000:
                table = pa.Table.from_batches(held).combine_chunks()
                node = table.column("node").to_numpy()
                last = np.flatnonzero(node != node[-1])  # the last group may go on
                stop = int(last[-1]) + 1 if len(last) else 0
                if stop:
                    yield flush(table.slice(0, stop).to_batches())
                held = table.slice(stop).to_batches()
                size = table.num_rows - stop
        if size:
            yield flush(held)

    groups = pieces.repartition(shared.shuffle_partitions(pieces.sparkSession), "node").sortWithinPartitions("node")
    return groups.mapInArrow(sort, "h long, w1 long, w2 long, runs array<struct<first:int,n:int>>")


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first column and length of each run of set entries."""
    edge = np.diff(np.pad(marks.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    which, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return which, first, end - first


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs (doc_id, text) with n_bytes, n_removed, n_spans, kept (the bytes that stay) and spans.

    Rows get a number from their place in the table, so that repeated rows and null ids are apart.
    """
    columns = [f.name for f in docs.schema]
    key = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "text")])
    same = docs.select(key.alias("k")).groupBy("k").count().filter("count > 1").select("k")
    numbered = docs.select("doc_id", "text", key.alias("row"))
    with shared.scope() as tables:
        if not same.isEmpty():  # repeated rows: equal texts remove each other whole, whichever is which
            place = F.monotonically_increasing_id()
            numbered = shared.written(docs.select("doc_id", "text", place.alias("row")), "numbered")
        spans = removals(numbered, length, gram)
        # Runs of one text, merged before they travel: a range of windows covers length - 1 bytes more.
        gathered = shared.written(spans.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("x")), "spans")
        tables.keep(numbered, gathered)
    out = numbered.join(gathered, "row", "left").select("doc_id", "text", "x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows: list[list] = [[], [], [], [], []]
                runs = part.column(2)
                for i, text in enumerate(part.column(1)):
                    t = text.as_py()
                    raw = t.encode("utf-8", "surrogatepass") if t else b""
                    kept, spans = raw, []
                    if runs[i].is_valid:
                        x = runs[i].values
                        first = x.field("first").to_numpy(zero_copy_only=False)[:]
                        n = x.field("n").to_numpy(zero_copy_only=False)
                        change = np.zeros(len(raw) + 1, np.int32)
                        np.add.at(change, first, 1)
                        np.add.at(change, first + n + length - 1, -1)
                        gone = np.cumsum(change[:-1]) > 0
                        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        _, begin, size = _runs(gone[None])
                        spans = [{"first": int(b), "n": int(s)} for b, s in zip(begin, size)]
                    for c, v in zip(rows, (len(raw), len(raw) - len(kept), len(spans), kept, spans)):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int64())]))]
                yield pa.record_batch([part.column(0), *(pa.array(c, t) for c, t in zip(rows, types))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    assert "doc_id" in columns
    return out.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<first:long,n:long>>")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def kept_digest(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()
