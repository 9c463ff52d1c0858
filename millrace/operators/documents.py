"""Documents in chunks: folders kept in step by a manifest, search with context windows, answers with sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunks
from . import search, semantic


def manifest(files: DataFrame) -> DataFrame:
    """(path, digest, size) of files (path, text)."""
    return files.select("path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests: added, changed, removed or same."""
    both = old.select("path", F.col("digest").alias("_o")).join(new.select("path", F.col("digest").alias("_n")), "path", "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "changed").otherwise("same")
    return both.select("path", change.alias("change"))


def synced(documents: DataFrame, files: DataFrame) -> DataFrame:
    """documents (path, text) as files (path, text) are now: only added and changed files are taken from there."""
    todo = changes(manifest(documents), manifest(files))
    stay = documents.join(todo.filter("change = 'same'").select("path"), "path", "left_semi")
    return stay.unionByName(files.join(todo.filter("change in ('added', 'changed')").select("path"), "path", "left_semi").select(*stay.columns))


def chunked(documents: DataFrame, key: str, text: str, limit: int = 1200) -> DataFrame:
    """(key, chunk, text): the paragraphs of each document, packed."""
    return documents.select(key, F.posexplode(chunks(F.col(text), limit)).alias("chunk", "text"))


def find(pieces: DataFrame, key: str, query: str, k: int) -> DataFrame:
    """(key, chunk, score): the k chunks with the best lexical score, ties by document and chunk."""
    words = search.words_of(query)
    hit = F.contains(F.lower("text"), F.lit(query.strip().lower())).cast("double")
    density = search.cover_density(F.col("text"), words) if words else F.lit(0.0)
    rows = pieces.select(key, "chunk", (2.0 * hit + density).alias("score")).filter("score > 0")
    return rows.orderBy(F.desc("score"), key, "chunk").limit(k)


def windows(pieces: DataFrame, key: str, found: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """(key, first, last, score, text): the found chunks with their neighbours; windows that touch are one.

    found is a list of bounded length, so its windows are too.
    """
    w = Window.partitionBy(key).orderBy("first")
    spans = found.select(key, F.greatest(F.col("chunk") - before, F.lit(0)).alias("first"), (F.col("chunk") + after).alias("last"), "score")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.coalesce((F.col("first") > reach + 1).cast("int"), F.lit(0))).withColumn("g", F.sum("new").over(w))
    spans = spans.groupBy(key, "g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("score").alias("score"))
    rows = pieces.select(F.col(key).alias("_k"), "chunk", "text").join(F.broadcast(spans), (F.col("_k") == F.col(key)) & F.col("chunk").between(F.col("first"), F.col("last")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda c: c["text"]), "\n\n")
    return rows.groupBy(key, "first", "score").agg(F.max("chunk").alias("last"), text.alias("text"))


def answer(context: DataFrame, key: str, question: str, provider: semantic.Provider, most: int = 8) -> tuple[str, list]:
    """A provider's answer from the best windows, and the documents it was shown."""
    rows = context.orderBy(F.desc("score"), key, "first").limit(most).collect()
    shown = "\n\n".join(f"[{i}] {r.text}" for i, r in enumerate(rows, 1))
    return provider([f"Answer from the sources and name their numbers.\n{shown}\nQuestion: {question}"])[0], [r[key] for r in rows]
