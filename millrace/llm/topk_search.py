"""Exact top-k inner-product search by pivot-table elimination.

Inner products become distances by one more coordinate: with R the largest norm, x' = (x, sqrt(R^2-|x|^2))
and q' = (q, 0) give |q'-x'|^2 = |q|^2 + R^2 - 2 q.x. Every task computes the table of distances from its
vectors to the pivots once. For a query, the largest |d(q,p) - d(x,p)| over all pivots is a lower bound
of the distance and so an upper bound of the score. Vectors lie by their nearest pivot, so that the least and
largest distances of such a group to all pivots bound it as a whole; groups come in the order of that bound,
and the vectors of groups not ruled out in the order of their own, in exact integers, until the bound falls
below the k-th best score: no result is lost.

Vectors that are null, empty or hold a null or non-finite component take no part, nor do null ids; a
query meets only vectors of its own length. Components are kept within 62 bits and scores within 63, where
larger ones end. Ties go to the smaller id. Rows with one id and one vector count once; the query's own id is
never its result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

QUERY_BLOCK = 8192
#: Vectors whose table of distances a task holds at once.
TABLE_ROWS = 16384
PIVOTS = 256
#: Pivots are chosen from at most this many vectors; any choice gives the same results.
PIVOT_SAMPLE = 2048
_MOST = float(1 << 62)


def quantised(table: DataFrame, scale: int = 256) -> DataFrame:
    """id, v: the usable vectors with each component turned into floor(scale * x)."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad
    return table.filter(ok).select(
        F.col("vec_id").cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, F.lit(-_MOST)), F.lit(_MOST))).cast("long")).alias("v"),
    )


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far apart: each next pivot is the vector farthest from all before."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample * sample).sum(1)))]
    best = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and best.max() > 0:
        chosen.append(int(np.argmax(best)))
        best = np.minimum(best, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Table:
    """Vectors of one task, grouped by their nearest pivot, and their distances to all pivots."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, radius2: float, pivots: np.ndarray) -> None:
        f = x.astype(np.float64)
        self.pivots, self.radius2 = pivots, radius2
        distance = self._to_pivots(f, np.sqrt(np.maximum(radius2 - (f * f).sum(1), 0)))
        near = distance.argmin(1) if len(pivots) else np.zeros(len(x), np.int64)
        order = np.argsort(near, kind="stable")
        self.ids, self.x, self.exact = ids[order], x[order], f[order]
        self.distance = distance[order].astype(np.float32)
        self.start = np.flatnonzero(np.concatenate([[True], np.diff(near[order]) != 0])) if len(x) else np.empty(0, np.int64)
        self.end = np.append(self.start[1:], len(x))
        self.low = np.minimum.reduceat(self.distance, self.start) if len(x) else self.distance
        self.high = np.maximum.reduceat(self.distance, self.start) if len(x) else self.distance
        self.largest = int(np.abs(x).max()) if x.size else 0
        #: Rows whose score was computed, of all that were asked for.
        self.evaluated = self.asked = 0

    def _to_pivots(self, a: np.ndarray, lift: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.sqrt(np.maximum(((a * a).sum(1) + lift**2)[:, None] + (p * p).sum(1)[None] - 2 * a @ p.T, 0))

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        most = self.largest * int(np.abs(q).max()) * len(q)
        if most < 1 << 53:  # sums of doubles are exact
            return (self.exact[rows] @ q.astype(np.float64)).astype(np.int64)
        if most < 1 << 63:
            return self.x[rows] @ q
        return np.array([sum(a * b for a, b in zip(v, q.tolist())) for v in self.x[rows].tolist()], dtype=object)

    def best(self, query_id: int, q: np.ndarray, k: int, found: list[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best rows, found (of other tables) included."""
        f = q.astype(np.float64)
        norm = float(f @ f)
        d = self._to_pivots(f[None], np.zeros(1))[0].astype(np.float32)
        # Rounding of the 32-bit table is far below this slack, which can only cost more evaluations.
        slack = 1e-4 * float(np.sqrt(norm + self.radius2)) + 1e-3
        above = lambda lower: (norm + self.radius2 - np.maximum(lower.astype(np.float64) - slack, 0) ** 2) / 2 * (1 + 1e-9) + 1
        groups = above(np.maximum(np.maximum(self.low - d, d - self.high).max(1, initial=0), 0))
        found = list(found or [])
        kth = found[-1][0] if len(found) == k else None
        self.asked += len(self.x)
        for g in np.argsort(-groups, kind="stable").tolist():
            if kth is not None and groups[g] < kth:
                break
            rows = np.arange(self.start[g], self.end[g])
            bound = above(np.abs(self.distance[rows] - d).max(1, initial=0))
            order = np.argsort(-bound, kind="stable")
            for at in range(0, len(order), 256):
                part = order[at : at + 256]
                if kth is not None:
                    part = part[bound[part] >= kth]
                    if not len(part):
                        break
                self.evaluated += len(part)
                own = rows[part]
                for s, i in zip(self.scores(own, q).tolist(), self.ids[own].tolist()):
                    if i != query_id and (kth is None or s >= kth):
                        found.append((s, i))
                found.sort(key=lambda r: (-r[0], r[1]))
                del found[k:]
                if len(found) == k:
                    kth = found[-1][0]
        return found


def _held(s: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, s))


def top_k(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (id, v) its k best candidates (id, v).

    Queries pass in blocks of QUERY_BLOCK. A block is broadcast, meets all candidates where these lie, without
    a shuffle, and its results are written before the next block is read, so neither the driver nor a task
    ever holds more than one. Each task gives k rows for a query at most.
    """
    spark = candidates.sparkSession
    path = shared.scratch_path(spark, "top-k")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    once = _once(candidates)
    dims = [r.d for r in queries.select(F.size("v").alias("d")).distinct().collect()]  # one row for each length
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for d in dims:
        own = once.filter(F.size("v") == d)
        norm = own.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))).first()[0]
        if norm is None:
            continue
        sample = np.array([r.v for r in own.select("v").limit(PIVOT_SAMPLE).collect()], dtype=np.float64)
        pivots = choose_pivots(sample, PIVOTS)
        for block in _blocks(queries.filter(F.size("v") == d).distinct()):
            sent = spark.sparkContext.broadcast((*block, float(norm), pivots))
            found = own.mapInArrow(_searcher(sent, d, k), "query_id long, vec_id long, score long")
            found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
            sent.destroy()
    return spark.read.schema(schema).parquet(path)


def _once(vectors: DataFrame) -> DataFrame:
    """vectors with rows of one id and one vector once; only rows whose id repeats are shuffled."""
    twice = shared.written(vectors.groupBy("id").count().filter("count > 1").select("id"), "twice")
    if twice.isEmpty():
        return vectors
    return vectors.join(twice, "id", "left_anti").unionByName(vectors.join(twice, "id", "left_semi").distinct())


def _searcher(sent, d: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q, radius2, pivots = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in q_ids]
        ids, rows = [], []
        held = 0

        def meet() -> None:
            table = Table(np.concatenate(ids), np.concatenate(rows), radius2, pivots)
            for n, (i, own) in enumerate(zip(q_ids.tolist(), q)):
                best[n] = table.best(i, own, k, best[n])

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
                rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d))
                held += batch.num_rows
            if held >= TABLE_ROWS:
                meet()
                ids.clear(), rows.clear()
                held = 0
        if held:
            meet()
        for at in range(0, len(q_ids), 1024):
            out = [(i, v, _held(s)) for i, own in zip(q_ids[at : at + 1024].tolist(), best[at : at + 1024]) for s, v in own]
            columns = list(zip(*out)) or [[], [], []]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids, rows = [], []
    for r in asked.orderBy("id").toLocalIterator(prefetchPartitions=True):
        ids.append(r.id)
        rows.append(r.v)
        if len(ids) == QUERY_BLOCK:
            yield np.array(ids, np.int64), np.array(rows, np.int64)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.int64)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return top_k(vectors, vectors.filter(F.col("id") % 50 == 0), k=5)


OP2_SQL = """
WITH v AS (
  SELECT DISTINCT CAST(vec_id AS BIGINT) AS id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.id AS query_id, c.id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
