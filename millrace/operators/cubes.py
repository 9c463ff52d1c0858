"""Cubes: named, versioned SELECTs that are materialised, refreshed, described and taken back."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Version:
    number: int
    sql: str
    note: str = ""


class Cubes:
    """Definitions are SQL over {tables}; each refresh writes a folder of its own, and readers get the newest one."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> None:
        self.spark, self.folder, self.tables = spark, folder, tables
        self.versions: dict[str, list[Version]] = {}
        self.written: dict[str, tuple[int, int]] = {}  # version and number of the refresh

    def define(self, name: str, sql: str, note: str = "") -> int:
        """A new version of a cube, refreshed at once; its number."""
        if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
            raise ValueError(f"a cube's name is a lower-case identifier, not {name!r}")
        sql = sql.strip().rstrip(";").strip()
        if not sql:
            raise ValueError("a cube needs SQL")
        own = self.versions.setdefault(name, [])
        own.append(Version(len(own) + 1, sql, note))
        try:
            self.refresh(name)
        except Exception:
            own.pop()  # a definition that can't run leaves the cube as it was
            if not own:
                del self.versions[name]
            raise
        return len(own)

    def refresh(self, name: str) -> int:
        version = self.versions[name][-1]
        n = self.written.get(name, (0, 0))[1] + 1
        self.spark.sql(version.sql, **self.tables).write.parquet(f"{self.folder}/{name}/{n}")
        self.written[name] = (version.number, n)
        return n

    def revert(self, name: str, number: int) -> int:
        """An earlier version's SQL as the next version."""
        return self.define(name, self.versions[name][number - 1].sql, f"as version {number}")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}/{self.written[name][1]}")

    def describe(self) -> DataFrame:
        rows = [(n, v[-1].number, self.written[n][1], v[-1].sql) for n, v in sorted(self.versions.items())]
        return self.spark.createDataFrame(rows, "name string, version int, refreshes int, sql string")

    def dimensions(self, name: str, few: int = 50) -> DataFrame:
        """(column_name, data_type, kind, groupable, n_distinct): dimensions, times and keys may be grouped by, measures not.

        A key's name ends in id or key; numbers of more than few values are measures.
        """
        table = self.table(name)
        counts = table.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in table.columns]).first()
        rows = []
        for c, t in table.dtypes:
            number = t in ("int", "bigint", "smallint", "tinyint", "double", "float") or t.startswith("decimal")
            kind = "dimension"
            if t in ("date", "timestamp", "timestamp_ntz"):
                kind = "time"
            elif re.search(r"(^|_|[a-z])(id|key)$", c.lower()):
                kind = "key"
            elif number and counts[c] > few:
                kind = "measure"
            rows.append((c, t, kind, kind != "measure", int(counts[c])))
        rows.sort(key=lambda r: (not r[3], r[0]))
        return self.spark.createDataFrame(rows, "column_name string, data_type string, kind string, groupable boolean, n_distinct long")

    def health(self) -> DataFrame:
        """(name, status): ok, stale where the newest version wasn't written yet, empty where it has no rows."""
        rows = []
        for name, own in sorted(self.versions.items()):
            stale = self.written.get(name, (0, 0))[0] != own[-1].number
            rows.append((name, "stale" if stale else "empty" if self.table(name).isEmpty() else "ok"))
        return self.spark.createDataFrame(rows, "name string, status string")

    def slice(self, name: str, by: list[str], **measures: str) -> DataFrame:
        """Aggregates of a cube by its groupable columns."""
        allowed = {r.column_name for r in self.dimensions(name).collect() if r.groupable}
        if not set(by) <= allowed:
            raise ValueError(f"not groupable: {sorted(set(by) - allowed)}")
        return self.table(name).groupBy(*by).agg(*[F.expr(v).alias(k) for k, v in measures.items()])
