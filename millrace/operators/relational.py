"""Relational helpers that Spark has no word for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_on(table: DataFrame, keys: list[str], *order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return table.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, bucket=None) -> DataFrame:
    """Each left row with the values of the last right row of its key not after it; no pairs.

    Rows are sorted within buckets of time (months, or what bucket gives of the time column), so one key is many
    tasks; the last right row before a bucket comes from a table with a row for each key and bucket.
    """
    values = [c for c in right.columns if c not in (key, at)]
    kind = dict(left.dtypes)[at]
    of = bucket or ((lambda c: F.date_trunc("month", c)) if kind.startswith(("timestamp", "date")) else (lambda c: F.floor(c / 100_000)))
    last = F.struct(at, *values)
    l = left.withColumn("_r", F.lit(None).cast(right.select(last.alias("x")).schema["x"].dataType)).withColumn("_side", F.lit(1))
    r = right.select(key, at, last.alias("_r")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_b", of(F.col(at)))
    w = Window.partitionBy(key, "_b").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    ends = right.withColumn("_b", of(F.col(at))).groupBy(key, "_b").agg(F.max_by(last, F.col(at)).alias("_end"))
    ends = ends.unionByName(left.select(key, of(F.col(at)).alias("_b")).distinct(), allowMissingColumns=True).groupBy(key, "_b").agg(F.first("_end", ignorenulls=True).alias("_end"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    out = both.join(carry, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")), "left").withColumn("_last", F.coalesce("_last", "_carry"))
    return out.select(*left.columns, F.col(f"_last.{at}").alias(f"matched_{at}"), *[F.col(f"_last.{c}").alias(c) for c in values])


def visible(documents: DataFrame, roles: DataFrame, hidden: DataFrame, caller: str | None, key: str, group: str) -> DataFrame:
    """documents that a caller may see: of groups that roles (caller, group) give, less hidden (caller, key); for none, nothing."""
    if caller is None:
        return documents.limit(0)
    own = roles.filter(F.col("caller") == caller).select(group).distinct()
    return documents.join(own, group, "left_semi").join(hidden.filter(F.col("caller") == caller).select(key), key, "left_anti")


def any_groups(table: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Any k groups with their counts."""
    return table.groupBy(*keys).count().limit(k)


def stats(table: DataFrame, column: str) -> DataFrame:
    x = F.col(column)
    return table.agg(F.count("*").alias("n"), F.count(x).alias("n_nonnull"), F.min(x).alias("least"), F.max(x).alias("greatest"), F.sum(x.cast("double")).alias("total"), F.avg(x).alias("mean"))


def load_hot(table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns kept in memory, on disk where that is full, until unpersist()."""
    from pyspark import StorageLevel

    return table.select(*columns).persist(StorageLevel.MEMORY_AND_DISK)


def incremental_view(view: DataFrame, source: DataFrame, key: str, project) -> DataFrame:
    """Rows that a materialised view lacks, by key; changed rows aren't noticed."""
    return project(source.join(view.select(key), key, "left_anti"))
