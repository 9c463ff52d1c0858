"""Tables of generations: as-of reads, tombstones, snapshots, timelines, retention, and hybrid reads.

rows carry a column generation (long); deletes are (key, generation). A generation has a time.
A read before the first generation is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def generation_at(generations: DataFrame, at: str) -> int:
    """The last generation not after a time, 0 if there is none."""
    found = generations.filter(F.col("time") <= F.lit(at).cast("timestamp")).agg(F.max("generation")).first()[0]
    return found or 0


def as_of(rows: DataFrame, deletes: DataFrame, key: str, generation: int) -> DataFrame:
    """What an appended table showed at a generation: rows till then, less those deleted till then and not written again."""
    gone = deletes.filter(F.col("generation") <= generation).groupBy(key).agg(F.max("generation").alias("_gone"))
    seen = rows.filter(F.col("generation") <= generation).join(gone, key, "left")
    return seen.filter(F.col("_gone").isNull() | (F.col("generation") > F.col("_gone"))).drop("_gone")


def snapshot(rows: DataFrame, generation: int | None = None) -> DataFrame:
    """Snapshot tables show one generation alone: the one asked for, or the newest."""
    if generation is None:
        generation = rows.agg(F.max("generation")).first()[0]
    return rows.filter(F.col("generation") == F.lit(generation))


def timeline(rows: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """For each generation: rows written, tombstones, and rows visible after it."""
    written = rows.groupBy("generation").agg(F.count("*").alias("written"))
    taken = rows.select(key, F.col("generation").alias("g")).join(deletes, key).filter(F.col("g") <= F.col("generation"))
    removed = taken.groupBy(key, "g").agg(F.min("generation").alias("generation")).groupBy("generation").agg(F.count("*").alias("tombstones"))
    both = written.join(removed, "generation", "full").na.fill(0, ["written", "tombstones"])
    order = Window.partitionBy(F.lit(1)).orderBy("generation")  # one row for each generation
    return both.withColumn("visible", F.sum(F.col("written") - F.col("tombstones")).over(order))


def reaped(rows: DataFrame, generations: DataFrame, cutoff: str) -> DataFrame:
    """What retention keeps of a snapshot table: the newest generation and those not older than cutoff."""
    newest = rows.agg(F.max("generation")).first()[0]
    old = generations.filter((F.col("time") < F.lit(cutoff).cast("timestamp")) & (F.col("generation") < F.lit(newest))).select("generation")
    return rows.join(old, "generation", "left_anti")


def hybrid(base: DataFrame, delta: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """Base and fresh rows, a fresh row instead of its base row, less deleted keys."""
    return base.join(delta.select(key), key, "left_anti").unionByName(delta).join(deletes.select(key), key, "left_anti")
