"""Quality: a document classifier combined with its host and path by hierarchical empirical Bayes.

A logistic classifier, fitted on a bounded sample of labelled rows, gives each document evidence from
its whole text. Evidence is summed by host and by path with partial aggregation, so that a host with a
third of all rows is no hot key. The host's posterior is a beta mean shrunk towards the global mean, the
path's one shrunk towards its host; the strength of either prior comes from the variance between sites
beyond that of sampling (method of moments), so sparse sites keep close to what stands above them. A
document's score multiplies its odds by those of its path relative to the global ones. Labels count as evidence
of their site. For tables with URLs of_url gives both names. documents has none: there the source is the host,
and the language, which is the first level of the paths of the pages table, is the path.

Null hosts and paths are the empty name. Null and empty texts have the features of an empty text. Labels
without a document are ignored; without labels of both kinds all evidence is 1/2. Repeated rows count and
are scored alike. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: The sample of labelled rows is bounded by this many of each kind.
SAMPLE_ROWS = 4000
THRESHOLD = 0.5
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_MARKS = b"#$%&*+/<=>@\\^_`{}~"
_EPS = 1e-3


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, k = max(len(raw), 1), max(len(words), 1)
    share = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    lines = raw.split(b"\n")
    unique = len(set(words)) / k
    same = sum(a == b for a, b in zip(words, words[1:])) / k
    size = np.log1p(len(words))
    x = [size, np.log1p(n / k), share(_UPPER), share(_DIGIT), share(_MARKS), share(b"!"), share(b"|"), share(b".,;:"), unique, unique * size, same, len(set(lines)) / len(lines), raw.count(b"\n") / k]
    return [*x, *(min(v * 20, 1.0) for v in (x[2], x[4], x[5], x[6], x[10]))]


WIDTH = len(features(""))


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights (the constant, then those of the features) for documents (doc_id, text), labels (doc_id, quality)."""
    spark = documents.sparkSession
    shared.bound_batches(spark)
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = own.filter("y = 1").orderBy(*order).limit(SAMPLE_ROWS).union(own.filter("y = 0").orderBy(*order).limit(SAMPLE_ROWS))
    ids = spark.createDataFrame([tuple(r) for r in ids.distinct().collect()], "doc_id long, y int")
    sample = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    sample = sample.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("text", "y")  # repeated ids don't outgrow the bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    rows = sample.mapInArrow(shared.trimmed(run), "x array<double>, y int").collect()
    y = np.array([r.y for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return np.zeros(WIDTH + 1)
    x = np.array([r.x for r in rows])
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    theta, keep = np.zeros(z.shape[1]), 1e-3 * np.eye(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        h = (z * (p * (1 - p) / len(z))[:, None]).T @ z + keep
        theta = theta + np.linalg.solve(h, z.T @ (y - p) / len(z) - keep @ theta)
    w = theta[1:] / spread
    return np.concatenate([[theta[0] - w @ mean], w])


def evidence(text: Column, weights: np.ndarray) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts]).reshape(-1, WIDTH)
        shared.trim()
        return pd.Series(1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30))))

    return run(text)


def _strength(m: float | None, between: float | None) -> float:
    """Of a beta prior with mean m, in documents, from the variance between sites."""
    if not m or between is None or between <= 0:
        return 1e6
    return float(min(max(m * (1 - m) / between - 1, 1.0), 1e6))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1 - _EPS))
    return F.log(p / (1 - p))


def sites(scored: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, n, host_posterior, path_posterior) from scored (host, path, p), and the global mean."""
    paths = shared.written(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("s2")), "paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(f"h{c}") for c in ("n", "s", "s2")])
    # The sum over sites of n (mean - overall)^2 less what sampling gives, over n: moments of one-way layouts.
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum("hs2").alias("s2"), F.sum(F.col("hs") ** 2 / F.col("hn")).alias("m2"), F.sum(F.col("hn").cast("double") ** 2).alias("n2"), F.count("*").alias("k")).first()
    if not total.n:
        return paths.select("host", "path", "n", F.lit(0.5).alias("host_posterior"), F.lit(0.5).alias("path_posterior")), 0.5
    m = total.s / total.n

    def between(n, k, inside, across, n2):
        if k < 2 or n <= k or n - n2 / n <= 0:
            return None
        return (across - (k - 1) * inside / (n - k)) / (n - n2 / n)

    host_strength = _strength(m, between(total.n, total.k, total.s2 - total.m2, total.m2 - total.n * m * m, total.n2))
    hosts = hosts.withColumn("host_posterior", (F.col("hs") + host_strength * m) / (F.col("hn") + host_strength))
    both = paths.join(hosts, "host")
    t = both.agg(F.sum("n").alias("n"), F.sum("s2").alias("s2"), F.sum(F.col("s") ** 2 / F.col("n")).alias("m2"), F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2).alias("across"), F.sum(F.col("n").cast("double") ** 2 / F.col("hn")).alias("n2"), F.count("*").alias("k")).first()
    inside = (t.s2 - t.m2) / max(t.n - t.k, 1)
    path_between = (t.across - (t.k - total.k) * inside) / (t.n - t.n2) if t.k > total.k and t.n > t.n2 else None
    path_strength = _strength(m, path_between)
    post = (F.col("s") + path_strength * F.col("host_posterior")) / (F.col("n") + path_strength)
    return both.select("host", "path", "n", "host_posterior", post.alias("path_posterior")), m


def of_url(url: Column) -> tuple[Column, Column]:
    """The host of a URL and the first level of its path, in lower case; empty where there is none."""
    low = F.lower(url)
    return F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)", 1), F.regexp_extract(low, r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)


#: Parts that a site's rows are dealt to where the table of sites is too large to broadcast.
SALTS = 32


def score(documents: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """documents with p_document, host_posterior, path_posterior and quality_score in a struct _quality.

    The text is read twice: once for the sums by site, once for the scores. Labels of a site's documents count
    in its sums beside the classifier's evidence. The table of sites is broadcast if it is small; else each
    site's rows are dealt to SALTS parts. A column _quality (in any case of letters) is replaced.
    """
    weights = fit(documents, labels)
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    site, own, post, salt = shared.fresh(documents, "_site", "_p", "_post", "_salt")
    rows = documents.withColumn(site, F.struct(name(host).alias("host"), name(path).alias("path")))
    p = evidence(F.col("text"), weights)
    scored = rows.select(F.col(site)["host"].alias("host"), F.col(site)["path"].alias("path"), p.alias("p"))
    with shared.scope() as tables:
        table, mean = sites(scored.unionByName(_labelled(rows, labels, site)))
        table = shared.written(table.select(F.struct("host", "path").alias(site), F.struct("host_posterior", "path_posterior").alias(post)), "sites")
        tables.keep(table)
    if table.count() <= shared.BROADCAST_ROWS:
        out = rows.join(F.broadcast(table), site)
    else:
        dealt = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.withColumn(salt, F.pmod(F.xxhash64("doc_id", "text"), F.lit(SALTS)).cast("int")).join(dealt, [site, salt])
    out = out.withColumn(own, p)
    odds = _logit(F.col(own)) + _logit(F.col(post)["path_posterior"]) - _logit(F.lit(float(mean)))
    result = F.struct(F.col(own).alias("p_document"), F.col(post)["host_posterior"].alias("host_posterior"), F.col(post)["path_posterior"].alias("path_posterior"), (1 / (1 + F.exp(-odds))).alias("quality_score"))
    return out.select(*[F.col(c) for c in documents.columns if c.lower() != "_quality"], result.alias("_quality"))


def _labelled(rows: DataFrame, labels: DataFrame, site: str) -> DataFrame:
    """(host, path, p): the labels of documents as evidence of their sites, one for each pair of a label and a document."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("p")).filter("doc_id is not null and p in (0.0, 1.0)").distinct()
    of = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site)["host"].alias("host"), F.col(site)["path"].alias("path"))
    return of.join(own, "doc_id").select("host", "path", "p")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = score(documents, labels, F.col("source"), F.col("lang"))
    return rows.select("doc_id", "source", "lang", "_quality.*", (F.col("_quality.quality_score") >= THRESHOLD).alias("keep"))
