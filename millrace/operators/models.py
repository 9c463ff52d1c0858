"""Trained models, SQL written by a provider, and expressions kept for the shapes of values."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import value_shape


def feature_schema(table: DataFrame, target: str, few: int = 50) -> list[tuple[str, str]]:
    """(column, numeric | category | text) of the columns that a model of target may use."""
    counts = table.agg(*[F.approx_count_distinct(c).alias(c) for c in table.columns]).first()
    out = []
    for c, t in table.dtypes:
        if c == target or t.startswith(("array", "map", "struct", "binary", "timestamp", "date")):
            continue
        number = t in ("int", "bigint", "smallint", "double", "float") or t.startswith("decimal")
        out.append((c, "numeric" if number else "category" if counts[c] <= few else "text"))
    return out


def train(table: DataFrame, target: str, features: list[tuple[str, str]] | None = None, task: str | None = None):
    """A fitted pipeline: linear regression for numbers of many values, else logistic regression."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, OneHotEncoder, StringIndexer, Tokenizer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    features = features or feature_schema(table, target)
    stages, inputs = [], []
    for c, kind in features:
        if kind == "category":
            stages += [StringIndexer(inputCol=c, outputCol=f"{c}_i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_i", outputCol=f"{c}_v")]
            inputs.append(f"{c}_v")
        elif kind == "text":
            stages += [Tokenizer(inputCol=c, outputCol=f"{c}_t"), HashingTF(inputCol=f"{c}_t", outputCol=f"{c}_v", numFeatures=4096)]
            inputs.append(f"{c}_v")
        else:
            inputs.append(c)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="skip"))
    task = task or ("regression" if dict(table.dtypes)[target] in ("double", "float") or dict(table.dtypes)[target].startswith("decimal") else "classification")
    if task == "regression":
        stages.append(LinearRegression(labelCol=target, solver="normal"))
    else:
        stages += [StringIndexer(inputCol=target, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc"), LogisticRegression(labelCol="label", maxIter=30)]
    return Pipeline(stages=stages).fit(table.filter(F.col(target).isNotNull()))


def evaluate(scored: DataFrame, target: str, task: str) -> DataFrame:
    """Metrics of predictions: rmse, mae and r2, or accuracy and the macro mean of F1, from plain aggregates."""
    y, p = F.col(target), F.col("prediction")
    if task == "regression":
        e = y - p
        return scored.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"))
    cells = scored.groupBy(y.alias("y"), p.alias("p")).count()
    total = cells.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0)).alias("hit"))
    own = cells.groupBy("y").agg(F.sum("count").alias("of_y"), F.sum(F.when(F.col("y") == F.col("p"), F.col("count")).otherwise(0)).alias("hit_y"))
    said = cells.groupBy(F.col("p").alias("y")).agg(F.sum("count").alias("of_p"))
    f1 = own.join(said, "y", "left").agg(F.avg(2 * F.col("hit_y") / (F.col("of_y") + F.coalesce("of_p", F.lit(0)))).alias("f1"))
    return total.crossJoin(F.broadcast(f1)).select("n", (F.col("hit") / F.col("n")).alias("accuracy"), "f1")  # a row each


def distill(table: DataFrame, text: str, label: Callable[[DataFrame], DataFrame], rows: int = 500, seed: str = "distill"):
    """A model that stands in for an operator: it labels rows texts, the ones of least hash, and is fitted to them."""
    texts = table.select(text).filter(F.col(text).isNotNull()).distinct().orderBy(F.xxhash64(F.lit(seed), text), text).limit(rows)
    return train(label(texts), "label_text", [(text, "text")], "classification")


# --- SQL written by a provider -------------------------------------------------------------------------


def checked_select(spark: SparkSession, sql: str) -> str:
    """sql if it is one statement that only reads, else an error: the parsed plan may hold no command."""
    text = sql.strip().rstrip(";").strip()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getName()
        if re.search(r"Command|Statement$|InsertInto|MergeInto|CreateTable|CreateView|Drop|Alter|DeleteFrom|UpdateTable|SetCatalog|AddJar|Truncate", name):
            raise ValueError(f"not read-only: {name.rpartition('.')[2]}")
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return text


def ask_sql(spark: SparkSession, question: str, tables: dict[str, DataFrame], provider: Callable[[list[str]], list[str]], attempts: int = 2) -> DataFrame:
    """The rows of a SELECT over {tables} that a provider writes for a question; a bad one is asked again with the error."""
    schema = "\n".join(f"{n}({', '.join(f'{c} {t}' for c, t in df.dtypes)})" for n, df in sorted(tables.items()))
    prompt = f"Write one Spark SQL SELECT. Name tables as {{name}}.\n{schema}\nQuestion: {question}"
    error = None
    for _ in range(attempts):
        sql = provider([prompt if error is None else f"{prompt}\nIt failed: {error}"])[0]
        try:
            checked_select(spark, re.sub(r"\{(\w+)\}", r"\1", sql))
            return spark.sql(sql.strip().rstrip(";"), **tables)
        except Exception as e:
            error = str(e).split("\n")[0]
    raise ValueError(error)


# --- Expressions for shapes ----------------------------------------------------------------------------


class Shapes:
    """One expression for each value shape of a column, written once by a provider or pinned by hand."""

    def __init__(self) -> None:
        self.pinned: dict[str, str] = {}

    def pin(self, shape: str, expression: str) -> None:
        self.pinned[shape] = expression

    def learn(self, table: DataFrame, column: str, provider: Callable[[list[str]], list[str]], cap: int = 64) -> list[str]:
        """Asks for the shapes not known yet, each with one value of it; the new shapes."""
        rows = table.groupBy(value_shape(F.col(column), cap).alias("shape")).agg(F.min(column).alias("value")).filter("shape is not null").collect()  # a row for each shape
        new = sorted((r.shape, r.value) for r in rows if r.shape not in self.pinned)
        if new:
            for (shape, _), e in zip(new, provider([f"An expression over value for values like {v!r}" for _, v in new])):
                self.pinned[shape] = e
        return [s for s, _ in new]

    def column(self, column: str, cap: int = 64) -> Column:
        """The value of the expression of each row's shape, as a string; null for shapes without one."""
        shape = value_shape(F.col(column), cap)
        of = lambda e: F.expr(re.sub(r"\bvalue\b", f"`{column}`", e)).cast("string")
        return reduce(lambda rest, kv: F.when(shape == kv[0], of(kv[1])).otherwise(rest), sorted(self.pinned.items(), reverse=True), F.lit(None).cast("string"))
