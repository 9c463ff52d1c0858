"""Incremental work as streams: available-now ingestion, views kept by key, windows, edge-triggered alerts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_new(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> None:
    """What is new since the last call, appended once; returns when all is in."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def keep_view(stream: DataFrame, target: str, key: str, project: Callable[[DataFrame], DataFrame], checkpoint: str) -> None:
    """A materialised view that gets rows whose key it lacks.

    Each batch writes a folder of its own number anew, so a batch that is tried again leaves no row twice; the keys
    that it compares with are those of the batches before it.
    """

    def add(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates([key])
        try:
            before = batch.sparkSession.read.parquet(target).filter(F.col("batch") < number).select(key)
            fresh = fresh.join(before, key, "left_anti")
        except Exception as e:  # no view yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        project(fresh).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_view(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def windowed(events: DataFrame, at: str, size: str, late: str, *keys: str) -> DataFrame:
    """Counts of each window and key; with a stream, windows close once the watermark has passed (an extension)."""
    return events.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def fires(states: DataFrame, consecutive: int, cooldown: int) -> DataFrame:
    """Edge-triggered alerts of a stream (rule, at long, failing): as metrics.alerts, with state kept for each rule."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, fired, last = state.get if state.exists else (0, False, -(1 << 62))
        out = []
        rows = pd.concat(list(batches)).sort_values("at")
        for at, failing in zip(rows["at"], rows["failing"]):
            run = run + 1 if failing else 0
            fired = fired and bool(failing)
            if failing and not fired and run >= consecutive:
                fired = True
                if at - last >= cooldown:
                    out.append((key[0], at))
                    last = at
        state.update((int(run), bool(fired), int(last)))
        yield pd.DataFrame(out, columns=["rule", "at"])

    return states.groupBy("rule").applyInPandasWithState(step, "rule string, at long", "run long, fired boolean, last long", "append", "NoTimeout")
