"""Nearest neighbours, similarity joins and rank fusion over vectors (id, v)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, cosine_to
from . import shared

TILE = 4096
#: Rows of a tile that meet another tile at once: cosines take 8 MB however many rows a table has.
STRIP = 256


def knn(table: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k rows nearest by cosine; ties to the smaller id. A projection and a top-k, no shuffle of the table."""
    return table.select("id", cosine_to(F.col("v"), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def centred(table: DataFrame) -> tuple[DataFrame, list[float]]:
    """The table less its mean vector, and that mean: one number for each dimension."""
    rows = table.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    mean = [r.m for r in rows]
    return table.select("id", F.zip_with("v", F.array(*[F.lit(m) for m in mean]), lambda x, m: x - m).alias("v")), mean


def centred_knn(table: DataFrame, query: list[float], k: int, floor: float = 0.10) -> DataFrame:
    moved, mean = centred(table)
    return knn(moved, [q - m for q, m in zip(query, mean)], k).filter(F.col("score") >= floor)


#: Rows that tiles are laid out by; any choice gives the same results.
PIVOTS = 64


def _unit(rows) -> np.ndarray:
    x = np.array(list(rows), dtype=float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _tiles(table: DataFrame) -> DataFrame:
    """(tile, ids, x, centre, angle) of a table (id, v): TILE rows or so that lie near one pivot, packed once.

    angle is the largest from the centre to a row, pi where a row is zero; a cell with many rows is several tiles.
    """
    shared.bound_batches(table.sparkSession)
    table = table.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    pivots = _unit([r.v for r in table.limit(min(PIVOTS, -(-table.count() // TILE))).collect()])

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        return pd.Series((_unit(v) @ pivots.T).argmax(1).astype("int32")) if len(v) else pd.Series([], dtype="int32")

    rows = table.withColumn("cell", nearest("v"))
    sizes = {r.cell: r["count"] for r in rows.groupBy("cell").count().collect()}  # a row for each pivot
    parts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // TILE))]) if sizes else None
    part = F.pmod(F.xxhash64("id"), parts[F.col("cell")]) if sizes else F.lit(0)
    rows = rows.withColumn("tile", F.col("cell").cast("long") * (1 << 32) + part)

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(pdf.v)
        centre = x.mean(0)
        centre = centre / max(np.linalg.norm(centre), 1e-300)
        zero = (np.abs(x).sum(1) == 0).any() or not centre.any()
        angle = np.pi if zero else float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        return pd.DataFrame({"tile": [key[0]], "ids": [pdf.id.to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "centre": [centre.tolist()], "angle": [angle]})

    return shared.cut(rows.groupBy("tile").applyInPandas(pack, "tile long, ids binary, x binary, centre array<double>, angle double"))


def _bound(a: str, b: str):
    """The highest cosine that rows of two tiles can have, by the angles to and around their centres."""
    dot = F.aggregate(F.zip_with(f"{a}.centre", f"{b}.centre", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    apart = F.acos(F.greatest(F.least(dot, F.lit(1.0)), F.lit(-1.0))) - F.col(f"{a}.angle") - F.col(f"{b}.angle")
    return F.when(apart <= 0, 1.0).otherwise(F.cos(F.least(apart, F.lit(math.pi)))) + 1e-9


def _met(left: DataFrame, right: DataFrame | None, run, schema: str, keep) -> DataFrame:
    """run(a, b) over pairs of tiles (of one table, with itself too, if right is None) for which keep(bound) holds.

    Pairs are made from a row for each tile; of each pair one tile travels to the other.
    """
    names = ["tile", "centre", "angle", *([c for c in ("least",) if c in left.columns])]
    a = left.select(F.struct(*names).alias("a"))
    b = (left if right is None else right).select(F.struct(*names).alias("b"))
    pairs = a.join(b, F.col("b.tile") > F.col("a.tile")) if right is None else a.crossJoin(b)
    pairs = shared.cut(pairs.filter(keep(_bound("a", "b"))).select(F.col("a.tile").alias("t"), F.col("b.tile").alias("u")))
    n = max(1, min(pairs.count(), 4096))
    one = left.select(F.col("tile").alias("t"), "ids", "x")
    two = (left if right is None else right).select(F.col("tile").alias("u"), F.col("ids").alias("ids2"), F.col("x").alias("x2")).repartition(n, "u")
    met = pairs.join(one, "t").repartition(n, "u").join(two, "u").select("ids", "x", "ids2", "x2")

    def go(batches):
        for batch in batches:
            for ids, x, ids2, x2 in _buffers(batch):
                yield pa.RecordBatch.from_pandas(run(_opened(ids, x), _opened(ids2, x2)), preserve_index=False)

    return met.mapInArrow(go, schema)


def _alone(tiles: DataFrame, run, schema: str) -> DataFrame:
    """run(a, None) over each tile."""

    def go(batches):
        for batch in batches:
            for ids, x in _buffers(batch):
                yield pa.RecordBatch.from_pandas(run(_opened(ids, x), None), preserve_index=False)

    return tiles.select("ids", "x").mapInArrow(go, schema)


def _buffers(batch: pa.RecordBatch):
    """The binaries of each row, not copied."""
    for i in range(batch.num_rows):
        yield [c[i].as_buffer() for c in batch.columns]


def _strips(x: np.ndarray, y: np.ndarray):
    """(start, cosines to all of y) of STRIP rows of x at a time."""
    for start in range(0, len(x), STRIP):
        yield start, x[start : start + STRIP] @ y.T


def _opened(ids: bytes | pa.Buffer, x: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(x, float).reshape(len(i), -1)


def isolation(table: DataFrame) -> DataFrame:
    """id, distance: 1 less the highest cosine to any other row, between 0 and 2; 1 for a row alone.

    The best within each tile comes first; pairs of tiles whose bound is below what every row of both has are left out.
    """

    def run(a, b):
        ids, x = a
        own, other = np.empty(len(ids)), np.full(len(ids if b is None else b[0]), -np.inf)
        for start, s in _strips(x, x if b is None else b[1]):
            if b is None:
                np.fill_diagonal(s[:, start:], -np.inf)
            own[start : start + len(s)] = s.max(1)
            np.maximum(other, s.max(0), out=other)
        if b is None:
            return pd.DataFrame({"id": ids, "s": own})
        return pd.DataFrame({"id": np.concatenate([ids, b[0]]), "s": np.concatenate([own, other])})

    def least(batches):
        for pdf in batches:
            out = [float(run(_opened(r.ids, r.x), None).s.min()) for r in pdf.itertuples(index=False)]
            yield pdf.assign(least=out)

    tiles = _tiles(table)
    tiles = shared.cut(tiles.mapInPandas(least, "tile long, ids binary, x binary, centre array<double>, angle double, least double"))
    own = _alone(tiles, run, "id long, s double")
    others = _met(tiles, None, run, "id long, s double", lambda bound: bound > F.least("a.least", "b.least"))
    best = own.unionByName(others).groupBy("id").agg(F.max("s").alias("s"))
    return best.select("id", F.when(F.col("s") < -1 + 1e-9, 1.0).otherwise(F.least(F.greatest(1 - F.col("s"), F.lit(0.0)), F.lit(2.0))).alias("distance"))


def novelty(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, novelty of left: 1 less the highest cosine to right, 1 if right is empty."""

    def run(a, b):
        return pd.DataFrame({"id": a[0], "s": np.concatenate([s.max(1) for _, s in _strips(a[1], b[1])])})

    best = _met(_tiles(left), _tiles(right), run, "id long, s double", lambda bound: F.lit(True)).groupBy("id").agg(F.max("s").alias("s"))
    return left.select("id").join(best, "id", "left").select("id", F.coalesce(1 - F.col("s"), F.lit(1.0)).alias("novelty"))


def similar_groups(table: DataFrame, threshold: float) -> DataFrame:
    """id, group_id for rows that cosines of at least threshold connect; each tile and pair of tiles gives a forest.

    Pairs of tiles whose bound is below the threshold are never made.
    """

    def run(a, b):
        ids = a[0] if b is None else np.concatenate([a[0], b[0]])
        label = np.arange(len(ids))
        for start, s in _strips(a[1], a[1] if b is None else b[1]):
            i, j = np.nonzero(s >= threshold)
            i, j = i + start, j if b is None else j + len(a[0])
            while True:
                apart = label[i] != label[j]
                if not apart.any():
                    break
                i, j = i[apart], j[apart]
                np.minimum.at(label, np.maximum(label[i], label[j]), np.minimum(label[i], label[j]))
                while (label[label] != label).any():
                    label = label[label]
        own = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[own], "b": ids[label[own]]})

    tiles = _tiles(table)
    edges = _alone(tiles, run, "a long, b long").unionByName(_met(tiles, None, run, "a long, b long", lambda bound: bound >= threshold))
    found = shared.components(edges)
    return table.join(found, table.id == found.node, "left").select("id", F.coalesce("component", "id").alias("group_id"))


def text_groups(texts: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(id, group_id, representative) of texts (id, text, v): of each group the longest text in bytes, of equal ones the first."""
    of = texts.join(similar_groups(texts.select("id", "v"), threshold), "id")
    best = of.groupBy("group_id").agg(F.min(F.struct((-F.octet_length("text")).alias("n"), "text")).alias("x")).select("group_id", F.col("x.text").alias("representative"))
    return of.join(best, "group_id").select("id", "group_id", "representative")


def most_isolated(table: DataFrame, n: int, criterion: list[float] | None = None) -> DataFrame:
    """(id, distance) of the n rows farthest from all others or, with a criterion, from it; ties by id."""
    if criterion is None:
        far = isolation(table)
    else:
        far = table.select("id", (1 - cosine_to(F.col("v"), criterion)).alias("distance"))
    return far.orderBy(F.desc("distance"), "id").limit(n)


def fuse(dense: DataFrame, lexical: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two scored lists (id, score) of bounded length; ties by lexical score, then id."""
    ranked = lambda df, n: df.withColumnRenamed("score", f"s{n}").withColumn(f"r{n}", F.row_number().over(Window.orderBy(F.desc(f"s{n}"), "id")))
    both = ranked(dense, 1).join(ranked(lexical, 2), "id", "full")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    out = both.select("id", (part("r1") + part("r2")).alias("rrf"), F.coalesce("s2", F.lit(0.0)).alias("lexical"))
    return out.orderBy(F.desc("rrf"), F.desc("lexical"), "id").limit(k)


def boosted(found: DataFrame, touches: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Scores raised by use: score (1 + weight touches / most touches) over an over-fetched list."""
    used = found.join(touches, "id", "left").withColumn("touches", F.coalesce("touches", F.lit(0)))
    share = F.coalesce(F.try_divide("touches", F.max("touches").over(Window.partitionBy(F.lit(1)))), F.lit(0.0))
    return used.select("id", (F.col("score") * (1 + weight * share)).alias("boosted")).orderBy(F.desc("boosted"), "id").limit(k)


def topics(table: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """cluster_id, n, exemplar (the row nearest to its centre) by k-means; clusters are numbered by size."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, seed=seed, maxIter=20).fit(table.select("id", array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    rows = model.transform(table.withColumn("features", array_to_vector(F.col("v").cast("array<double>"))))
    near = rows.select("id", F.col("prediction").alias("p"), cosine(F.col("v"), F.element_at(centres, F.col("prediction") + 1)).alias("s"))
    out = near.groupBy("p").agg(F.count("*").alias("n"), F.min(F.struct((-F.col("s")).alias("s"), "id")).alias("best"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("n"), "best.id")
    return out.select((F.row_number().over(order) - 1).alias("cluster_id"), "n", F.col("best.id").alias("exemplar"))
