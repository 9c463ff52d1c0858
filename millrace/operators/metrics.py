"""Versioned metrics: definitions as SQL templates, resolved as of a time, by dimension, as series, checked."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Metrics:
    """{p} puts in a quoted parameter, {p!} a raw one, {metric:name} another metric's definition.

    Every definition of a name is a new version; def_as_of picks the last not after a time.
    """

    def __init__(self) -> None:
        self.versions: dict[str, list[tuple[str, str]]] = {}

    def define(self, name: str, sql: str, at: str = "1970-01-01") -> int:
        self.versions.setdefault(name, []).append((at, sql))
        return len(self.versions[name])

    def resolve(self, name: str, def_as_of: str | None = None, _open: tuple[str, ...] = ()) -> str:
        if name in _open:
            raise ValueError(f"metrics refer to each other: {' > '.join([*_open, name])}")
        own = [s for at, s in self.versions.get(name, []) if def_as_of is None or at <= def_as_of]
        if not own:
            raise KeyError(name)
        return re.sub(r"\{metric:(\w+)\}", lambda m: f"({self.resolve(m[1], def_as_of, (*_open, name))})", own[-1])

    def sql(self, name: str, params: Mapping[str, object] | None = None, def_as_of: str | None = None) -> str:
        text = self.resolve(name, def_as_of)
        for k, v in (params or {}).items():
            quoted = str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
            text = text.replace(f"{{{k}!}}", str(v)).replace(f"{{{k}}}", quoted)
        return text

    def run(self, spark: SparkSession, name: str, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None, def_as_of: str | None = None) -> DataFrame:
        """Tables stand in the text as {table}."""
        return spark.sql(self.sql(name, params, def_as_of), **tables)


def by(table: DataFrame, dimensions: list[str], **measures: str) -> DataFrame:
    """The same aggregates for each combination of dimensions."""
    return table.groupBy(*dimensions).agg(*[F.expr(v).alias(k) for k, v in measures.items()])


def series(observations: DataFrame, bucket: str) -> DataFrame:
    """The last observation (metric, at, value) of each bucket of time."""
    b = F.date_trunc(bucket, "at")
    return observations.groupBy("metric", b.alias("bucket")).agg(F.max_by("value", F.struct("at", "value")).alias("value"))


class Observations:
    """Values of scalar metrics as they were measured: (metric, at, value, version), kept in a folder."""

    SCHEMA = "metric string, at timestamp, value double, version int"

    def __init__(self, spark: SparkSession, folder: str, metrics: Metrics) -> None:
        self.spark, self.folder, self.metrics = spark, folder, metrics
        spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(folder)

    def materialize(self, name: str, at: str, tables: Mapping[str, DataFrame], params: Mapping[str, object] | None = None) -> float | None:
        """Runs a metric of one row and one column, as it was defined at a time, and keeps the value."""
        value = self.metrics.run(self.spark, name, tables, params, at).first()[0]
        version = sum(a <= at for a, _ in self.metrics.versions[name])
        row = self.spark.createDataFrame([(name, at, None if value is None else float(value), version)], "metric string, at string, value double, version int")
        row.withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(self.folder)
        return value

    def history(self, name: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        return rows if name is None else rows.filter(F.col("metric") == name)

    def board(self) -> DataFrame:
        """(metric, at, value, before, change): the last value of each metric and the one before it."""
        w = Window.partitionBy("metric").orderBy("at")
        rows = self.history().withColumn("before", F.lag("value").over(w)).groupBy("metric").agg(F.max_by(F.struct("at", "value", "before"), "at").alias("x")).select("metric", "x.*")
        return rows.withColumn("change", F.col("value") - F.col("before"))

    def breaching(self, bounds: Mapping[str, tuple[str, float]]) -> DataFrame:
        """The board's rows whose value isn't as their bound (gte or lte, threshold) asks."""
        cases = [F.when(F.col("metric") == m, fails(F.col("value"), how, t)) for m, (how, t) in sorted(bounds.items())]
        return self.board().filter(F.coalesce(*cases, F.lit(False)))


def lineage(metrics: Metrics) -> list[tuple[str, str]]:
    """(metric, metric that it refers to), of the newest definitions."""
    return sorted({(n, m) for n, own in metrics.versions.items() for m in re.findall(r"\{metric:(\w+)\}", own[-1][1])})


def fails(value, how: str, threshold: float):
    """Whether a score breaks its threshold: gte asks for at least it, lte for at most it; null breaks neither."""
    return F.coalesce({"gte": value < threshold, "lte": value > threshold}[how], F.lit(False))


def states(rules: Mapping[str, tuple[str, object]], tables: Mapping[str, DataFrame], spark: SparkSession, at: int) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(rule, at, failing) of a sweep, and the errors of rules that couldn't run, which stop no other.

    A rule is (status, SQL giving pass or fail), (expr, SQL giving a boolean that is true when all is well) or
    (gte | lte, (SQL giving a score, threshold)).
    """
    rows, errors = [], []
    for name, (kind, body) in sorted(rules.items()):
        try:
            value = spark.sql(body[0] if kind in ("gte", "lte") else body, **tables).first()[0]
            if kind == "status":
                failing = value == "fail"
            elif kind == "expr":
                failing = value is False
            else:
                failing = value is not None and (value < body[1] if kind == "gte" else value > body[1])
            rows.append((name, at, bool(failing)))
        except Exception as e:  # one rule's error is reported, the sweep goes on
            errors.append((name, type(e).__name__))
    return spark.createDataFrame(rows, "rule string, at long, failing boolean"), errors


def means_in_order(table: DataFrame, key: str, value: str, place: str, outcomes: Callable[[Column], list[Column]]) -> DataFrame:
    """(key, mean): where an outcome hangs on a mean's last bits, the sum is the running one in the order of place.

    Sums of parts differ from it by how rows are dealt to tasks, by 2^-52 of the sum of magnitudes at most. Outcomes are
    steps of the mean that never turn back; only groups whose outcomes differ within twice that bound are read again.
    """
    means = table.groupBy(F.col(key).alias("_k")).agg(F.avg(value).alias("_mean"), (F.sum(F.abs(value)) * 2.0**-51).alias("_e"))
    low, high = (outcomes(F.col("_mean") + sign * F.col("_e")) for sign in (-1, 1))
    hang = functools.reduce(lambda a, b: a | b, [~a.eqNullSafe(b) for a, b in zip(low, high)])
    again = means.filter(hang).select("_k")
    rows = table.join(again, F.col(key).eqNullSafe(F.col("_k")), "left_semi").filter(F.col(value).isNotNull())
    w = Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.withColumn("_s", F.sum(value).over(w)).groupBy(F.col(key).alias("_k2")).agg((F.max_by("_s", place) / F.count("*")).alias("_ordered"))
    both = means.join(sums, F.col("_k").eqNullSafe(F.col("_k2")), "left")
    return both.select(F.col("_k").alias(key), F.coalesce("_ordered", "_mean").alias("mean"))


def checked(rows: DataFrame, ok: str) -> DataFrame:
    """breach is true only where the condition is false; status is fail wherever it isn't true."""
    c = F.expr(ok)
    return rows.withColumn("breach", F.coalesce(~c, F.lit(False))).withColumn("status", F.when(c, "pass").otherwise("fail"))


def freshness(tables: Mapping[str, tuple[DataFrame, str]], now: str) -> DataFrame:
    """Hours since the newest row of each table."""
    age = (F.lit(now).cast("timestamp").cast("double") - F.col("t").cast("timestamp").cast("double")) / 3600
    parts = [df.agg(F.max(c).alias("t")).select(F.lit(name).alias("table_name"), F.round(age, 2).alias("hours")) for name, (df, c) in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alerts(states: DataFrame, consecutive: int, cooldown: int) -> DataFrame:
    """Fires of states (rule, at long, failing): one in an episode, at its consecutive-th failure, cooldown apart.

    Episodes are gaps and islands; a fire within cooldown of the last one that fired is left out. A candidate
    at least cooldown after the candidate before it always fires, so each chain of closer ones is folded alone.
    """
    w = Window.partitionBy("rule").orderBy("at")
    run = states.withColumn("island", F.sum((~F.col("failing")).cast("int")).over(w)).filter("failing")
    run = run.withColumn("n", F.row_number().over(Window.partitionBy("rule", "island").orderBy("at"))).filter(F.col("n") == consecutive)
    gap = F.col("at") - F.lag("at").over(w)
    starts = F.coalesce(gap >= cooldown, F.lit(True))
    run = run.select("rule", F.col("at").cast("long").alias("at"), starts.alias("starts")).withColumn("chain", F.sum(F.col("starts").cast("int")).over(w))
    run = run.repartition("rule", "chain").sortWithinPartitions("rule", "chain", "at")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for at, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                keep.append(start or at - last >= cooldown)
                last = at if keep[-1] else last
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run.mapInArrow(fold, run.select("rule", "at").schema)
