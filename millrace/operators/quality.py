"""Profiles, drift between two runs, rule sets, key inference, approximate distinct counts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
EPSILON = 1e-6


def profile(table: DataFrame) -> DataFrame:
    """One row for each column, from one pass: n, n_null, n_distinct, least, greatest and quantiles of numbers."""
    parts = []
    for i, (c, kind) in enumerate(table.dtypes):
        x = F.col(f"`{c}`")
        number = kind in ("int", "bigint", "double", "float", "smallint", "tinyint") or kind.startswith("decimal")
        q = F.percentile(x, F.array(*[F.lit(p) for p in QUANTILES])) if number else F.lit(None).cast("array<double>")
        parts.append(F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n"), F.count_if(x.isNull()).alias("n_null"), F.countDistinct(x).alias("n_distinct"), F.min(x).cast("string").alias("least"), F.max(x).cast("string").alias("greatest"), q.alias("q")).alias(f"c{i}"))
    one = table.agg(*parts)
    rows = one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(parts))])))
    return rows.select("column_name", "n", "n_null", "n_distinct", "least", "greatest", *[F.round(F.col("q")[i], 6).alias(f"p{int(p * 100):02d}") for i, p in enumerate(QUANTILES)])


def distribution(table: DataFrame, column: str, top: int = 256) -> DataFrame:
    counts = table.groupBy(F.col(column).cast("string").alias("value")).count()
    return counts.orderBy(F.desc("count"), "value").limit(top)


def drift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Each value's shares in both runs and its part of the population stability index; flags new and lost values."""
    share = lambda df, n: df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias(n))
    both = share(before, "n_before").join(share(after, "n_after"), "value", "full").na.fill(0, ["n_before", "n_after"])
    total = both.agg(F.sum("n_before").alias("b"), F.sum("n_after").alias("a")).first()
    p = F.greatest(F.try_divide("n_before", F.lit(total.b or 0)), F.lit(EPSILON))
    q = F.greatest(F.try_divide("n_after", F.lit(total.a or 0)), F.lit(EPSILON))
    flag = F.when(F.col("n_before") == 0, "new").when(F.col("n_after") == 0, "lost").otherwise("both")
    return both.select("value", "n_before", "n_after", ((q - p) * F.log(q / p)).alias("psi"), flag.alias("flag"))


def drift_summary(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, psi, n_new, n_lost, severity) of several columns; values are compared as strings."""
    parts = []
    for c in columns:
        one = drift(before.select(F.col(c).cast("string").alias("v")), after.select(F.col(c).cast("string").alias("v")), "v")
        parts.append(one.agg(F.lit(c).alias("column_name"), F.sum("psi").alias("psi"), F.count_if(F.col("flag") == "new").alias("n_new"), F.count_if(F.col("flag") == "lost").alias("n_lost")))
    out = reduce(DataFrame.unionByName, parts)
    level = F.when(F.coalesce("psi", F.lit(0.0)) < 0.1, "none").when(F.col("psi") < 0.25, "moderate").otherwise("major")
    return out.select("column_name", "psi", "n_new", "n_lost", level.alias("severity"))


def fingerprint(table: DataFrame, top: int = 256) -> DataFrame:
    """profile with null_frac, and the most frequent values of each column with their counts, top at most."""
    base = profile(table).withColumn("null_frac", F.try_divide(F.col("n_null"), F.col("n")))
    parts = [distribution(table, c, top).agg(F.lit(c).alias("column_name"), F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "value"))).alias("x")) for c in table.columns]
    values = reduce(DataFrame.unionByName, parts).select("column_name", F.transform("x", lambda v: F.struct(v["value"].alias("value"), (-v["n"]).alias("n"))).alias("top_values"))
    return base.join(values, "column_name")


def severity(psi: float | None) -> str:
    return "none" if psi is None or psi < 0.1 or math.isnan(psi) else "moderate" if psi < 0.25 else "major"


def first_rule(table: DataFrame, rules: list[tuple[str, int, str]]) -> DataFrame:
    """verdict: the id of the first rule (id, priority, condition) that holds; rows that none fits are left out."""
    ordered = sorted(rules, key=lambda r: (r[1], r[0]))
    verdict = reduce(lambda rest, r: F.when(F.expr(r[2]), r[0]).otherwise(rest), reversed(ordered), F.lit(None).cast("string"))
    return table.withColumn("verdict", verdict).filter(F.col("verdict").isNotNull())


def rule_verdicts(table: DataFrame, rules: list[tuple[str, int, str]]) -> DataFrame:
    """As first_rule, for rules that may fail on a row or at all: such a rule gives rule_error in its place."""
    ordered = sorted(rules, key=lambda r: (r[1], r[0]))

    def verdict(name: str, condition: str, rest):
        try:
            table.select(F.expr(condition).cast("boolean"))
        except Exception:  # it can't be resolved over this table
            return F.lit("rule_error")
        return F.when(F.expr(condition), name).otherwise(rest)

    found = reduce(lambda rest, r: verdict(r[0], r[2], rest), reversed(ordered), F.lit(None).cast("string"))
    return table.withColumn("verdict", found).filter(F.col("verdict").isNotNull())


def all_keys(columns: DataFrame, declared: DataFrame) -> DataFrame:
    """(table_name, column_name, to_table, source): declared keys, and inferred ones for columns that declare none."""
    own = declared.select("table_name", "column_name", "to_table", F.lit("declared").alias("source"))
    guess = inferred_keys(columns).join(declared.select("table_name", "column_name"), ["table_name", "column_name"], "left_anti")
    return own.unionByName(guess.withColumn("source", F.lit("inferred")))


def inferred_keys(columns: DataFrame) -> DataFrame:
    """Edges of columns (table_name, column_name): <base>_id or <base>id to a table <base> or <base>s with an id column."""
    stem = F.regexp_extract(F.lower("column_name"), "^(.+?)_?id$", 1)
    targets = columns.filter(F.lower("column_name") == "id").select(F.col("table_name").alias("to_table"))
    names = targets.select("to_table", F.explode(F.array(F.lower("to_table"), F.regexp_replace(F.lower("to_table"), "s$", ""))).alias("base")).distinct()
    return columns.withColumn("base", stem).filter("base <> ''").join(names, "base").filter("table_name <> to_table").select("table_name", "column_name", "to_table")


def approx_distinct(table: DataFrame, column: str, exact_below: int = 1024) -> DataFrame:
    """n: exact for few values, else from a HyperLogLog sketch of 2^12 places; null for columns that aren't text."""
    if dict(table.dtypes)[column] != "string":
        return table.sparkSession.createDataFrame([(None,)], "n long")
    sketched = table.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, 12)).alias("n")).first().n
    if sketched and sketched >= exact_below:
        return table.sparkSession.createDataFrame([(sketched,)], "n long")
    return table.agg(F.countDistinct(column).alias("n"))


def sketch_by(table: DataFrame, key: str, column: str) -> DataFrame:
    """Sketches for each key; union_sketches merges them, so parts need one pass alone."""
    return table.groupBy(key).agg(F.hll_sketch_agg(column, 12).alias("sketch"))


def union_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))


def predicate_bitmap(table: DataFrame, key: str, predicate: str, name: str, version: str) -> DataFrame:
    """A predicate's keys (name, version, bucket, bits), kept once and used by bitmap_keys."""
    k = F.col(key).cast("long")
    hit = table.filter(F.expr(predicate))
    return hit.groupBy(F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits")).select(F.lit(name).alias("name"), F.lit(version).alias("version"), "bucket", "bits")


def bitmap_size(bitmap: DataFrame) -> DataFrame:
    return bitmap.groupBy("name", "version").agg(F.sum(F.bitmap_count("bits")).alias("n"))


class PredicateBitmaps:
    """Named, versioned predicates over a table's keys, evaluated once and kept as bitmaps in a folder."""

    def __init__(self, spark, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.known: dict[tuple[str, str], str] = {}

    def populate(self, table: DataFrame, key: str, predicate: str, name: str, version: str) -> bool:
        """Whether it was evaluated now: a name's version is evaluated once only."""
        if (name, version) in self.known:
            return False
        path = f"{self.folder}/{name}-{version}"
        predicate_bitmap(table, key, predicate, name, version).write.mode("overwrite").parquet(path)
        self.known[name, version] = path
        return True

    def bitmap(self, name: str, version: str) -> DataFrame:
        return self.spark.read.parquet(self.known[name, version])

    def select(self, table: DataFrame, key: str, name: str, version: str) -> DataFrame:
        """The rows whose keys are set, without the predicate being evaluated again."""
        bits = self.bitmap(name, version).select("bucket", "bits")
        k = F.col(key).cast("long")
        at = F.bitmap_bit_position(k)
        held = table.withColumn("bucket", F.bitmap_bucket_number(k)).join(bits, "bucket")
        byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return held.filter(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1).select(*table.columns)

    def stats(self) -> DataFrame:
        parts = [bitmap_size(self.bitmap(*k)) for k in sorted(self.known)]
        return reduce(DataFrame.unionByName, parts)

    def drop(self, name: str, version: str) -> bool:
        return self.known.pop((name, version), None) is not None
