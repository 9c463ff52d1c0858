"""SimHash near-duplicates by tiled exact comparison: exclusive-or, bit counts, tiles ruled out early.

Texts are lower-cased (A-Z only) and split at ASCII white space; a shingle is a run of words joined by
one space, repeats included; a text of fewer words is one shingle, one without words has fingerprint
zero and is linked like any other. A fingerprint bit is set if it is set in over half of the hashes
(XXH64 of the UTF-8 bytes, seed 42). Null and empty texts have no words. Repeated rows are one
fingerprint; null ids keep their row and are never a component's id unless it has no other.

Two ways to find all pairs of distinct fingerprints within a radius, both exact:

* ``link_close`` for one 64-bit word and a small radius r. Of r + 1 bands of bits at least one is equal
  in any such pair, so only fingerprints that share a band are compared.
* ``link_wide`` for several words and a wide radius, where bands can't help. Fingerprints are dealt into
  size classes by their number of shingles; a similarity of at least s needs sizes within that ratio,
  so a class meets itself and its neighbour. All tiles of such classes are compared. ``keep_one`` takes
  these links as candidates only: fingerprints and sizes are then of distinct shingles, and
  ``link_similar`` links a pair once the similarity of its shingle sets is computed.
  Sets whose least hashes have too few in common with those of all other sets can't be similar to any
  (an exact bound, see ``start``) and are in no tile.

In both, a band or class with many fingerprints is dealt into tiles by population count, and pairs of tiles
whose counts differ beyond the radius are not made; within a pair, neither are strips of rows. Each pair of
tiles is a key of its own and gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

TILE = 512
WIDE_TILE = 8192


def _hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[:-1]]]
    ends = ends[k - 1 :] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends)], dtype=np.uint64)


def _spread(h: np.ndarray, words: int) -> np.ndarray:
    """h itself, and further words mixed from it, as (len(h), words)."""
    out = [h]
    for n in range(1, words):
        z = h + np.uint64((0x9E3779B97F4A7C15 * n) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(h: np.ndarray, words: int = 1) -> np.ndarray:
    if not len(h):
        return np.zeros(words, np.uint64)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 8192):
        part = np.ascontiguousarray(_spread(h[at : at + 8192], words))
        bits = np.unpackbits(part.view(np.uint8), axis=1, bitorder="little")
        for low in range(0, len(bits), 255):
            counts += np.add.reduce(bits[low : low + 255], axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)


#: Texts whose sets are held at once.
TEXTS = 256


#: One in so many of a set's hashes must be common to another set, among those that its start holds.
PART = 10


def start(h: np.ndarray, similarity: float) -> np.ndarray:
    """The least hashes of a sorted set, so many that two similar sets have common_least() of these in common.

    The two share similarity times the larger one's size at least. Of what they share, the k-th in order has
    all but k of that after it, in both sets, and so stands this early in both if k is at most len(h) // PART, or 1.
    """
    return h[: len(h) - math.ceil(similarity * len(h) - 1e-6) + max(1, len(h) // PART)]


def common_least(n, similarity: float):
    """How many hashes the starts of a set of n and of any similar set, which has similarity * n at least, share."""
    return F.greatest(F.lit(1), F.floor((similarity * n - 1e-6) / PART))


def fingerprints(docs: DataFrame, keep: list[str], shingle: int, words: int = 1, sets: str | None = None, similarity: float = 1.0) -> DataFrame:
    """The columns keep, f0 .. (the fingerprint's words, as longs), n (the number of shingles), and a set's columns.

    With sets, each shingle counts once: "s" gives the sorted hashes as bytes, "id" a hash of them and its start.
    """
    more = {None: "", "s": ", s binary", "id": ", id long, start array<long>"}[sets]
    fields = ", ".join([f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"f{i} long" for i in range(words)] + ["n long"]) + more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            found, n = np.zeros((batch.num_rows, words), np.uint64), np.zeros(batch.num_rows, np.int64)
            own = [b""] * batch.num_rows
            starts = [np.empty(0, np.int64)] * batch.num_rows
            for i, text in enumerate(batch.column(len(keep))):
                t = text.as_py()
                if t:
                    h = _hashes(t.encode("utf-8", "surrogatepass"), shingle)
                    if sets:
                        h = np.unique(h)
                        own[i] = h.tobytes() if sets == "s" else xxhash.xxh3_64_digest(h)
                        starts[i] = start(h, similarity).view(np.int64)
                    found[i], n[i] = fingerprint(h, words), len(h)
            columns = [batch.column(j) for j in range(len(keep))] + [pa.array(found[:, j].copy().view(np.int64)) for j in range(words)] + [pa.array(n)]
            if sets == "s":
                columns.append(pa.array(own, pa.binary()))
            elif sets:
                empty = xxhash.xxh3_64_digest(b"")
                columns.append(pa.array(np.frombuffer(b"".join(x or empty for x in own), np.int64)))
                ends = np.cumsum([0, *map(len, starts)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *starts]))))
            yield pa.record_batch(columns, names=[*keep, *[f"f{j}" for j in range(words)], "n", *{None: [], "s": ["s"], "id": ["id", "start"]}[sets]])

    return docs.select(*keep, "text").mapInArrow(shared.trimmed(run), fields)


#: Rows and columns whose distances are computed at once: few enough for a core's cache.
STRIP = (64, 2048)


def compare_tiles(a: np.ndarray, b: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within a tile (b None) or between two, as index pairs into a, or into a and b.

    a and b are (n, words). Rows go by population count in strips; strips whose counts differ by more
    than the radius aren't compared.
    """
    same = b is None
    b = a if same else b
    words = a.shape[1]
    pop_a, pop_b = np.bitwise_count(a).sum(1), np.bitwise_count(b).sum(1)
    oa, ob = np.argsort(pop_a, kind="stable"), np.argsort(pop_b, kind="stable")
    sa, pa_, pb_ = a[oa], pop_a[oa].astype(np.int64), pop_b[ob].astype(np.int64)
    sb = np.ascontiguousarray(b[ob].T)
    # Within a small radius, few pairs are left before the last word, which is computed for these alone.
    first = words - 1 if radius < 24 * (words - 1) else words
    block = (min(STRIP[0], len(a)), min(STRIP[1], len(b)))
    either, bits, apart = np.empty(block, np.uint64), np.empty(block, np.uint8), np.empty(block, np.uint8 if first <= 3 else np.uint16)
    for at in range(0, len(sa), STRIP[0]):
        rows = sa[at : at + STRIP[0]]
        low = int(np.searchsorted(pb_, pa_[at] - radius))
        high = int(np.searchsorted(pb_, pa_[at + len(rows) - 1] + radius, side="right"))
        if same:
            low = max(low, at)
        for to in range(low, high, STRIP[1]):
            columns = slice(to, min(to + STRIP[1], high))
            part = (slice(len(rows)), slice(columns.stop - to))
            x, n, d = either[part], bits[part], apart[part]
            for w in range(first):
                np.bitwise_xor(rows[:, w][:, None], sb[w, columns][None], out=x)
                np.bitwise_count(x, out=n if w else d)
                if w:
                    np.add(d, n, out=d)
            i, j = np.nonzero(d <= radius)
            if words > first and len(i):
                near = np.bitwise_count(rows[i] ^ sb[:, to + j].T).sum(1, dtype=np.int64) <= radius
                i, j = i[near], j[near]
            i, j = oa[at + i], ob[to + j]
            if same:
                i, j = i[i != j], j[i != j]
            if len(i):
                yield i, j


def _links(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray | None, b: np.ndarray | None, radius: int) -> shared.Forest:
    """A spanning forest of the links of a tile, or between two tiles."""
    forest = shared.Forest()
    both = ids_a if b is None else np.concatenate([ids_a, ids_b])
    label = np.arange(len(both))
    shift = 0 if b is None else len(ids_a)
    for i, j in compare_tiles(a, b, radius):
        j = j + shift
        while True:  # join the trees of all these pairs
            x, y = label[i], label[j]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (low == high).all():
                break
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    for k in np.flatnonzero(label != np.arange(len(label))):
        forest.join(int(both[k]), int(both[label[k]]))
    return forest


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(forests: list[shared.Forest]) -> pa.RecordBatch:
    a, b = [], []
    for f in forests:
        x, y = f.stars()
        a += x
        b += y
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGES)


def link_close(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between the fingerprints f0 of distinct within radius: a spanning forest for each tile."""
    width = [64 // (radius + 1) + (i < 64 % (radius + 1)) for i in range(radius + 1)]
    low = [sum(width[:i]) for i in range(radius + 1)]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.col("f0"), low[i]).bitwiseAND((1 << width[i]) - 1).alias("key")) for i in range(radius + 1)])
    rows = distinct.select("f0", F.bit_count("f0").alias("p"), F.explode(bands).alias("x")).select("f0", "p", "x.band", "x.key")
    # A key's tiles are of one population count each, unless one tile holds all: 65 counts at most for a key.
    counts = rows.groupBy("band", "key", "p").count()
    tiles = F.map_from_entries(F.collect_list(F.struct("p", F.ceil(F.col("count") / TILE).cast("int"))))
    keys = counts.groupBy("band", "key").agg(F.sum("count").alias("count"), tiles.alias("tiles")).filter("count > 1")
    rows = rows.join(shared.written(keys, "bands"), ["band", "key"])
    name = lambda p, t: p.cast("long") * (1 << 32) + t.cast("long")
    own = name(F.col("p"), F.pmod(F.xxhash64("f0"), F.element_at("tiles", F.col("p"))))
    # A tile meets itself and those whose counts are within the radius; other pairs are never made.
    near = F.filter(F.sequence(F.col("p") - radius, F.col("p") + radius), lambda q: F.map_contains_key("tiles", q))
    others = F.flatten(F.transform(near, lambda q: F.transform(F.sequence(F.lit(0), F.element_at("tiles", q) - 1), lambda u: name(q, u))))
    one = F.col("count") <= TILE
    rows = rows.withColumn("t", F.when(one, F.lit(0).cast("long")).otherwise(own))
    rows = rows.withColumn("o", F.explode(F.when(one, F.array(F.lit(0).cast("long"))).otherwise(others)))
    rows = rows.select("band", "key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") > F.col("o")).alias("second"), "f0")
    rows = rows.repartition(shared.shuffle_partitions(distinct.sparkSession), "band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, f, second in _groups(batches):
            one, two = f[~second], f[second]
            if key[2] == key[3]:
                yield _edge_batch([_links(f, f.view(np.uint64)[:, None], None, None, radius)])
            elif len(one) and len(two):
                yield _edge_batch([_links(one, one.view(np.uint64)[:, None], two, two.view(np.uint64)[:, None], radius)])

    return rows.mapInArrow(shared.trimmed(run), "a long, b long")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Groups of equal first four columns from sorted rows; f0 and second of each."""
    held: list = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(4)])
        second = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
        f = batch.column(5).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        for s, e in zip([0, *cuts], [*cuts, len(f)]):
            key = tuple(int(x) for x in k[s])
            if key != now and held:
                yield now, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                held = []
            now = key
            held.append((f[s:e], second[s:e]))
    if held:
        yield now, np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def link_wide(distinct: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) between the ids of distinct (id, f0 .., n) whose fingerprints are within radius."""
    spark = distinct.sparkSession
    base = math.log(1 / similarity)
    four = math.floor(math.log(4) / base + 1e-9)
    rows = distinct.withColumn("c", F.floor(F.log(F.greatest("n", F.lit(1))) / base + 1e-9).cast("int"))
    f = [f"f{i}" for i in range(words)]
    rows = rows.withColumn("p", reduce(lambda a, b: a + b, [F.bit_count(x) for x in f]))
    # Tiles by population count: those of a class in order of it, so many after those with lesser counts.
    counts = rows.groupBy("c", "p").count()
    before = F.sum("count").over(Window.partitionBy("c").orderBy("p")) - F.col("count")
    deal = counts.select("c", "p", F.floor(before / WIDE_TILE).alias("t0"), F.floor((before + F.col("count") - 1) / WIDE_TILE).alias("t1"))
    t = F.col("t0") + F.pmod(F.xxhash64(*f), F.col("t1") - F.col("t0") + 1)
    rows = rows.join(F.broadcast(deal), ["c", "p"]).select("c", t.cast("int").alias("t"), "p", "id", *f)  # 257 counts at most for a class

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, p = table.column("id").to_numpy(), table.column("p").to_numpy()
        a = np.column_stack([table.column(x).to_numpy() for x in f])
        names = {"c": pa.int32(), "t": pa.int32(), "low": pa.int32(), "high": pa.int32(), "ids": pa.binary(), "f": pa.binary()}
        return pa.table({"c": [key[0].as_py()], "t": [key[1].as_py()], "low": [int(p.min())], "high": [int(p.max())], "ids": [ids.tobytes()], "f": [a.tobytes()]}, schema=pa.schema(list(names.items())))

    packed = shared.written(rows.groupBy("c", "t").applyInArrow(pack, "c int, t int, low int, high int, ids binary, f binary"), "tiles")
    # Pairs of tiles are made where the tiles lie, from a row for each; those too far apart in counts are not.
    tile = packed.select("c", "t", "low", "high").withColumn("d", F.explode(F.array("c", F.col("c") + 1)))
    mate = packed.select(F.col("c").alias("d"), F.col("t").alias("u"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    reach = F.when((F.col("c") == four) & (F.col("d") == four + 1), F.lit(max(radius, FOUR_RADIUS))).otherwise(F.lit(radius))
    close = (F.col("low2") - F.col("high") <= reach) & (F.col("low") - F.col("high2") <= reach)
    plan = shared.written(tile.join(mate, "d").filter(close & ((F.col("d") > F.col("c")) | (F.col("u") >= F.col("t")))).select("c", "t", "d", "u"), "plan")
    n = max(shared.shuffle_partitions(spark), min(plan.count(), 4096))
    # Each pair takes one tile along to where the other is.
    other = packed.select(F.col("c").alias("d"), F.col("t").alias("u"), F.col("ids").alias("ids2"), F.col("f").alias("f2")).repartition(n, "d", "u")
    met = plan.join(packed.select("c", "t", "ids", "f"), ["c", "t"]).repartition(n, "d", "u").join(other, ["d", "u"]).select("c", "t", "d", "u", "ids", "f", "ids2", "f2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            for r in batch.to_pylist():
                ids, a = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["f"], np.uint64).reshape(-1, words)
                if (r["c"], r["t"]) == (r["d"], r["u"]):
                    yield _edge_batch([_links(ids, a, None, None, radius)])
                else:
                    ids2, b = np.frombuffer(r["ids2"], np.int64), np.frombuffer(r["f2"], np.uint64).reshape(-1, words)
                    # Sets of four and of five shingles of which four are common differ in 48 bits on average.
                    far = FOUR_RADIUS if (r["c"], r["d"]) == (four, four + 1) else radius
                    yield _edge_batch([_links(ids, a, ids2, b, far)])

    return met.mapInArrow(shared.trimmed(run), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id, n_links for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links reach, the row's own included.
    """
    with shared.scope() as tables:
        rows = shared.written(fingerprints(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], shingle), "fingerprints")
        distinct = shared.written(rows.groupBy("f0").agg(F.min("doc_id").alias("least")), "distinct")
        found = shared.components(link_close(distinct, radius))
        of = distinct.join(found, distinct.f0 == found.node, "left").select("f0", "least", F.coalesce("component", "f0").alias("c"))
        least = of.groupBy("c").agg(F.min("least").alias("component_id"))
        table = shared.written(of.join(least, "c").select("f0", "component_id"), "components")
        tables.keep(rows, table)
    out = rows.join(table, "f0")
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


#: Of 256 bits, large sets with a similarity of 0.8 differ in 38.8 on average, with a deviation of 5.7;
#: sets that share nothing in 128, with one of 8. Five of six shingles: 40 bits, deviation 5.8; four of
#: five: 48, 6.2, with a radius of its own. So each radius is 4.8 deviations or more above such pairs: a
#: candidate is found with a probability of over 0.99999 by the normal approximation.
WIDE_WORDS, WIDE_RADIUS, FOUR_RADIUS = 4, 68, 80
#: Rows, and shingles, of a tile whose sets are compared.
SET_TILE, SET_SHINGLES = 256, 1 << 19


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have at least that share of their union in common."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-6:
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both) >= similarity


def link_similar(members: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """Edges (a, b) between the ids of members (c, id, tiles, f0 .., n, s) of one c whose sets are similar.

    Only pairs within radius are computed, and of these only such as no links connect yet. The members
    of one c are dealt into tiles, each pair of tiles a key of its own.
    """
    f = [f"f{i}" for i in range(words)]
    rows = members
    rows = rows.withColumn("t", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("c", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), (F.col("t") > F.col("o")).alias("second"), "id", *f, "s")
    rows = rows.repartition(shared.shuffle_partitions(members.sparkSession), "c", "i", "j").sortWithinPartitions("c", "i", "j")

    def linked(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        forest = shared.Forest()
        parts = [[r for r in held if r[0] == second] for second in (False, True)]
        one, two = parts if key[1] != key[2] else (held, None)
        if one and (two is None or two):
            a = np.array([r[2] for r in one], np.int64).view(np.uint64)
            b = None if two is None else np.array([r[2] for r in two], np.int64).view(np.uint64)
            two = two or one
            for i, j in compare_tiles(a, b, radius):
                for x, y in zip(i.tolist(), j.tolist()):
                    p, q = one[x], two[y]
                    if forest.find(p[1]) != forest.find(q[1]) and similar(p[3], q[3], similarity):
                        forest.join(p[1], q[1])
        return _edge_batch([forest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, b.num_rows, TEXTS)):
            for r in batch.to_pylist():
                key = (r["c"], r["i"], r["j"])
                if key != now and held:
                    yield linked(now, held)
                    held = []
                now = key
                held.append((r["second"], r["id"], [r[x] for x in f], np.frombuffer(r["s"], np.uint64)))
        if held:
            yield linked(now, held)

    return rows.mapInArrow(shared.trimmed(run), "a long, b long")


def keep_one(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, one of each group of near-duplicates: the one with the smallest doc_id.

    Near-duplicates are texts whose sets of shingles have at least that similarity (common ones of all),
    or that such pairs connect. Fingerprints only find the candidates. Texts without words are one group.
    Of repeated rows with one doc_id a single one stays; a null doc_id comes last.
    """
    columns = docs.columns
    (row,) = shared.fresh(docs, "_row")
    rows = docs.withColumn(row, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    f = [f"f{i}" for i in range(WIDE_WORDS)]
    with shared.scope() as tables:
        prints = fingerprints(rows.select(F.col(row).alias("_row"), "doc_id", "text"), ["_row", "doc_id"], shingle, WIDE_WORDS, sets="id", similarity=similarity)
        prints = shared.written(prints, "fingerprints")
        order = F.struct(F.col("doc_id").isNull().alias("null"), F.col("doc_id").alias("doc_id"), F.col("_row").alias("_row"))
        distinct = shared.written(prints.groupBy("id", *f, "n").agg(F.min(order).alias("first")), "distinct")
        # A set whose start has too little in common with those of all others is similar to none and meets no tile.
        starts = prints.select("id", "n", F.explode("start").alias("hash"))
        common = starts.groupBy("hash").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low <> high").select("hash")
        common = shared.written(common, "common")
        shares = starts.join(common.hint("shuffle_hash"), "hash", "left_semi").groupBy("id", "n").count()
        able = shared.written(shares.filter(F.col("count") >= common_least(F.col("n"), similarity)).select("id"), "able")
        able = distinct.select("id", *f, "n").join(able, "id", "left_semi")
        near = shared.components(link_wide(able, WIDE_WORDS, WIDE_RADIUS, similarity))
        near = near.select(F.col("component").alias("c"), F.col("node").alias("id")).join(distinct.select("id", "n", F.col("first._row").alias("_row")), "id")
        near = shared.written(near, "near")
        sizes = near.groupBy("c").agg(F.count("*").alias("count"), F.sum("n").alias("total"))
        tiles = F.greatest(F.ceil(F.col("count") / SET_TILE), F.ceil(F.col("total") / SET_SHINGLES)).cast("int")
        near = shared.written(near.join(sizes.select("c", tiles.alias("tiles")), "c").select("c", "id", "tiles", "_row"), "near")
        # The sets of candidates alone are computed again, rather than all sets written.
        twice = shared.written(prints.groupBy("_row").count().filter("count > 1").select("_row"), "twice")
        again = not twice.isEmpty()
        texts = shared.join_narrow(rows.select(F.col(row).alias("_row"), "text"), near, "_row")
        texts = (texts.dropDuplicates(["id"]) if again else texts).select("c", "id", "tiles", "text")
        members = fingerprints(texts, ["c", "id", "tiles"], shingle, WIDE_WORDS, sets="s")
        found = shared.components(link_similar(members, WIDE_WORDS, FOUR_RADIUS, similarity))
        of = distinct.join(found, distinct.id == found.node, "left").select("id", F.coalesce("component", "id").alias("c"), "first")
        of = shared.written(of, "groups")
        stay = of.groupBy("c").agg(F.min("first").alias("stay")).select("c", F.col("stay._row").alias("stay"))
        of = of.join(stay, "c").select("id", "stay")
        gone = prints.select("id", "_row").join(of, "id").filter("_row <> stay").select(F.col("_row").alias(row)).distinct()
        gone = shared.written(gone, "gone")
        tables.keep(gone, twice)
    kept = shared.join_narrow(rows, gone, row, "left_anti")
    if again:  # rows with one id and one text share a number; one of them stays, and others aren't shuffled
        same = twice.withColumnRenamed("_row", row)
        kept = shared.join_narrow(kept, same, row, "left_anti").unionByName(shared.join_narrow(kept, same, row, "left_semi").dropDuplicates([row]))
    return kept.select(*columns)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
