"""Reading and writing tables: pruned Parquet scans, imports, exports, layouts, other formats."""

from __future__ import annotations

import re
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with place: rows count up in each file and from file to file by path, as one reader meets them."""
    df = load(spark, sf_dir, name)
    files = sorted(re.sub("^file:/+", "/", f) for f in df.inputFiles())  # paths of the two sides differ in slashes
    df = df.select("*", F.col("_metadata.row_index").alias("place"), F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("_file"))
    if len(files) > 1:
        numbers = spark.createDataFrame(list(zip(files, range(len(files)))), "_file string, _n long")
        df = df.join(F.broadcast(numbers), "_file", "left").withColumn("place", F.col("_n") * (1 << 40) + F.col("place")).drop("_n")
    return df.drop("_file")


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query over {table} fields; only the tables that it names are opened, and no view outlives it."""
    used = {f for _, f, _, _ in string.Formatter().parse(text) if f}
    return spark.sql(text, **{n: load(spark, sf_dir, n) for n in used})


def import_files(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Adopt Parquet files of one or of drifting schemas: columns by name, missing ones null, cast to schema."""
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    if schema is None:
        return df
    wanted = spark.createDataFrame([], schema).schema
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def export(df: DataFrame, path: str, partition_by: list[str] | None = None, cluster_by: list[str] | None = None, bloom: list[str] | None = None) -> None:
    """Write Parquet: hive-partitioned by columns, or ranges sorted by columns, with bloom filters if asked."""
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    for c in bloom or []:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def schema_fingerprint(df: DataFrame) -> str:
    """A digest of names and types in their order, to notice that a source has changed."""
    import hashlib

    return hashlib.md5(";".join(f"{n}:{t}" for n, t in df.dtypes).encode()).hexdigest()


def gated(df: DataFrame, fingerprint: str | None) -> DataFrame:
    """df, if its names and types are those of a fingerprint; a source seen for the first time has none."""
    if fingerprint is not None and schema_fingerprint(df) != fingerprint:
        raise ValueError(f"the source's schema has changed: {df.dtypes}")
    return df


def ingest_folder(spark: SparkSession, path: str) -> DataFrame:
    """Text files of a folder as documents: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def selected_rows(spark: SparkSession, path: str, ordinals: list[int], columns: list[str]) -> DataFrame:
    """Rows of a Parquet file by their place in it, from 0; only these columns are read."""
    row = F.col("_metadata.row_index")
    return spark.read.parquet(path).filter(row.isin(ordinals)).select(row.alias("ordinal"), *columns)


def file_statistics(df: DataFrame) -> DataFrame:
    """Rows of each file of a scanned table."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_rows"))
