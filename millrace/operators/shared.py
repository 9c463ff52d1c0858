"""Lineage cuts and connected components for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_own: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A folder of its own name in spark.checkpoint.dir; a temporary one only where that is unset and mode local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="millrace-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Large rows pass to Python in batches of 8 MB (one row at least), unless the session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8m")


def cut(df: DataFrame) -> DataFrame:
    """df, checkpointed in spark.checkpoint.dir; a folder of its own only where that is unset and mode local."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-"))
    return df.checkpoint()


def numbered(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """df with the row's number from 1 in an order, from counts of sorted ranges: no task sorts all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    ranged = cut(ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order))))
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}  # one row for each range
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None)
    number = (start[F.col("_p")] + F.col("_i")) if before else F.lit(None)
    return ranged.withColumn(name, number.cast("long")).drop("_p", "_i")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for edges (a, b): the smallest node reachable, by large-star and small-star rounds.

    A round that leaves the number and the sum of hashes of the stars as they were is the last.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
        seen = mark
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(low.select("a", F.col("m").alias("b"))).distinct())
