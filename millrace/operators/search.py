"""Search over the distinct values of a text column: lexical ranks, cached embeddings, fused lists, a coarse index."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine_to
from . import shared

#: Weight of an unlabelled word in a cover.
WEIGHT = 0.1
_WORD = r"[^\p{L}\p{N}]+"


def words_of(query: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def cover_density(text: Column, words: list[str]) -> Column:
    """The sum over covers, the shortest runs that hold all words, of WEIGHT over one more than the words between.

    Words are compared as they are, lower-cased: there is no stemming and no stop list.
    """
    if len(words) == 1:
        hits = F.size(F.filter(F.split(F.lower(text), _WORD), lambda w: w == words[0]))
        return WEIGHT * F.coalesce(hits, F.lit(0))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_covers(t, words) for t in texts], dtype="float64")

    return run(text)


def _covers(text: str | None, words: list[str]) -> float:
    places = [(i, w) for i, w in enumerate(re.findall(r"[^\W_]+", (text or "").lower())) if w in words]
    score, at = 0.0, 0
    while True:
        seen: set[str] = set()
        end = next((k for k in range(at, len(places)) if not seen.add(places[k][1]) and len(seen) == len(words)), None)
        if end is None:
            return score
        seen.clear()
        begin = next(k for k in range(end, at - 1, -1) if not seen.add(places[k][1]) and len(seen) == len(words))
        noise = places[end][0] - places[begin][0] - (end - begin)
        score += WEIGHT / (1 + noise)
        at = begin + 1


def lexical_knn(table: DataFrame, column: str, query: str, k: int) -> DataFrame:
    """(value, score) of distinct values: 2 if the query stands in it as it is, and its cover density; ties by value."""
    query = query.strip()
    if not query:
        return table.sparkSession.createDataFrame([], "value string, score double")
    values = table.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct()
    hit = F.contains(F.lower("value"), F.lit(query.lower())).cast("double")
    words = words_of(query)
    density = cover_density(F.col("value"), words) if words else F.lit(0.0)
    return values.select("value", (2.0 * hit + density).alias("score")).filter("score > 0").orderBy(F.desc("score"), "value").limit(k)


class EmbeddingCache:
    """A table (specialist, key, text, v) in a folder; each distinct text of a specialist is embedded once."""

    SCHEMA = "specialist string, key string, text string, v array<double>"

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(folder)

    def table(self, specialist: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        return rows if specialist is None else rows.filter(F.col("specialist") == specialist)

    def materialize(self, table: DataFrame, column: str, embedder: Callable[[list[str]], list[list[float]]], specialist: str = "") -> int:
        """Embeds the distinct texts that the cache lacks, in batches; their number."""
        texts = table.select(F.col(column).alias("text")).filter("text is not null").distinct()
        texts = texts.withColumn("key", F.sha2(F.concat_ws("\x1f", F.lit(specialist), F.col("text")), 256))
        new = texts.join(self.table(specialist).select("key"), "key", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"specialist": specialist, "key": b.key, "text": b.text, "v": embedder(b.text.tolist())})

        made = shared.cut(new.select("text", "key").mapInPandas(run, self.SCHEMA))
        made.write.mode("append").parquet(self.folder)
        return made.count()

    def stats(self) -> DataFrame:
        return self.table().groupBy("specialist").agg(F.count("*").alias("entries"), F.sum(F.length("text")).alias("characters"), F.max(F.size("v")).alias("dimensions"))

    def purge(self, specialist: str) -> int:
        """Removes a specialist's entries; their number."""
        n = self.table(specialist).count()
        kept = shared.cut(self.table().filter(F.col("specialist") != specialist))
        kept.write.mode("overwrite").parquet(self.folder)
        return n


def knn_text(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(value, score) of the k distinct texts of vectors (text, v) nearest by cosine; ties by value."""
    one = vectors.groupBy("text").agg(F.min("v").alias("v"))
    return one.select(F.col("text").alias("value"), cosine_to(F.col("v"), query).alias("score")).orderBy(F.desc("score"), "value").limit(k)


def hybrid_search(dense: DataFrame, lexical: DataFrame, k: int, floor: float = 0.0, constant: int = 60) -> DataFrame:
    """(value, dense_score, lex_score, fused_score): reciprocal ranks of two lists (value, score) of max(4 k, 50) rows added up.

    A value that one list lacks has the score 0.0 there. Ties go by the lexical score, then by value.
    """
    pool = max(4 * k, 50)

    def ranked(df: DataFrame, score: str) -> DataFrame:
        rows = df.orderBy(F.desc("score"), "value").limit(pool)  # as bounded as the window over it
        return rows.select("value", F.col("score").alias(score), F.row_number().over(Window.orderBy(F.desc("score"), "value")).alias(f"r_{score}"))

    both = ranked(dense.filter(F.col("score") >= floor), "dense_score").join(ranked(lexical, "lex_score"), "value", "full")
    part = lambda c: F.coalesce(1.0 / (constant + F.col(f"r_{c}")), F.lit(0.0))
    fused = both.select("value", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("lex_score", F.lit(0.0)).alias("lex_score"), (part("dense_score") + part("lex_score")).alias("fused_score"))
    return fused.orderBy(F.desc("fused_score"), F.desc("lex_score"), "value").limit(k)


class CoarseIndex:
    """Vectors (id, v) by their nearest of n centres, written as folders of cells; a search reads the probed cells alone."""

    def __init__(self, vectors: DataFrame, folder: str, n: int | None = None, sample: int = 20_000, seed: int = 42) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.spark, self.folder = vectors.sparkSession, folder
        total = vectors.count()
        n = n or max(1, int(math.sqrt(total)))
        rows = vectors.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))
        # Centres are fitted on a bounded sample; every row is indexed.
        part = rows.sample(min(1.0, sample / max(total, 1)), seed) if total > sample else rows
        model = KMeans(k=n, seed=seed, maxIter=10).fit(part)
        self.centres = [[float(x) for x in c] for c in model.clusterCenters()]
        model.transform(rows).select("id", "v", F.col("prediction").alias("cell")).repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(folder)

    def search(self, query: list[float], k: int, probes: int = 8) -> DataFrame:
        """(id, score): the k nearest by cosine in the cells nearest to the query; all cells give the exact result."""
        near = sorted(range(len(self.centres)), key=lambda i: sum((a - b) ** 2 for a, b in zip(self.centres[i], query)))[:probes]
        rows = self.spark.read.parquet(self.folder).filter(F.col("cell").isin(near))
        return rows.select("id", cosine_to(F.col("v"), query).alias("score")).orderBy(F.desc("score"), "id").limit(k)
