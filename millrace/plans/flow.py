"""Flows: a SELECT and stages after THEN, parsed with an eye to strings, comments and nesting."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Stage = Callable[..., DataFrame]
_TOKEN = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|(\$\w*\$).*?\1|\w+|\s+|.", re.S)


def split(text: str) -> list[str]:
    """Parts between THENs that stand outside strings, comments, parentheses and CASE ... END."""
    parts, now, depth, cases = [], [], 0, 0
    for m in _TOKEN.finditer(text):
        t = m[0]
        word = t.upper() if t[0].isalpha() or t[0] == "_" else ""
        depth += (t == "(") - (t == ")")
        cases += (word == "CASE") - (word == "END" and cases > 0)
        if word == "THEN" and not depth and not cases:
            parts.append("".join(now).strip())
            now = []
        else:
            now.append(t)
    return [*parts, "".join(now).strip()]


def _sample(df: DataFrame, n: int = 10, order: str | None = None) -> DataFrame:
    """Rows at the places floor(i len / n) of an order."""
    total = df.count()
    if total <= n:
        return df
    keys = [order] if order else df.columns
    # Places come from counts of ranges, so no single task sorts all rows.
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id())
    ranged = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)))
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    before, at = {}, 0
    for p in sorted(counts):
        before[p], at = at, at + counts[p]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    place = start[F.col("_p")] + F.col("_i") - 1
    return ranged.filter(place.isin([i * total // n for i in range(n)])).drop("_p", "_i")


BUILTIN: dict[str, Stage] = {
    "pass": lambda df: df,
    "count": lambda df: df.agg(F.count("*").alias("n")),
    "limit": lambda df, n=10: df.limit(int(n)),
    "head": lambda df, n=10: df.limit(int(n)),
    "sample": _sample,
}


#: Rows that a chart or a kept step shows; the true number stands beside them.
SHOWN = 1000


def artifact(df: DataFrame, kind: str, **fields: object) -> DataFrame:
    """A chart or table as one row of JSON: the first SHOWN rows in their order, and how many there are."""
    rows = [json.loads(r) for r in df.limit(SHOWN).toJSON().collect()]
    total = len(rows) if len(rows) < SHOWN else df.count()
    return df.sparkSession.createDataFrame([(kind, json.dumps({"kind": kind, "rows": rows, "n_rows": total, **fields}))], "kind string, spec string")


for _kind in ("metric_card", "bar_chart", "line_chart", "scatter_plot", "table_view", "vega_lite", "filter_control", "action_button", "tile_name", "bind_filter", "layout_grid"):
    BUILTIN[_kind] = lambda df, *a, kind=_kind: artifact(df, kind, fields=list(a))


def run(spark: SparkSession, text: str, tables: dict[str, DataFrame], stages: dict[str, Stage] | None = None, pinned: dict[str, str] | None = None, log: list | None = None, kept: int = 20) -> DataFrame:
    """The first part is SQL over {tables}; a stage is name(arguments); pinned SQL reads {_input}.

    An error in any stage fails the flow. A log gets (step, rows, the first kept of them as JSON) of every step.
    """
    first, *rest = split(text)
    df = spark.sql(first, **tables)

    def note(step: str) -> None:
        if log is not None:
            log.append((step, df.count(), df.limit(kept).toJSON().collect()))

    note("select")
    for part in rest:
        m = re.fullmatch(r"(\w+)\s*(?:\((.*)\))?", part, re.S)
        if not m:
            raise ValueError(f"no stage: {part}")
        name = m[1].lower()
        arguments = [a[1:-1].replace("''", "'") if a.startswith("'") else a for a in re.findall(r"'(?:[^']|'')*'|[^,\s]+", m[2] or "")]
        if name in (pinned or {}):
            df = spark.sql(pinned[name], _input=df)
        else:
            own = {**BUILTIN, **(stages or {})}
            if name not in own:
                raise ValueError(f"no stage named {name}")
            df = own[name](df, *[int(a) if a.isdigit() else a for a in arguments])
        note(name)
    return df
