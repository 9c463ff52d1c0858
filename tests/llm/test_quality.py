import pytest
from pyspark.sql import functions as F

from millrace.llm import quality as q


def test_documents_split_as_labelled(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", "lang")
    learn = labels.filter("doc_id % 3 <> 0")
    rows = q.score(docs, learn, F.col("source"), F.col("lang")).join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    right = [(r._quality.quality_score >= q.THRESHOLD) == (r.quality == 1) for r in rows]
    assert len(rows) > 80 and sum(right) / len(right) > 0.97


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("good", "a", 0.95)] * 200 + [("good", "b", 0.9)] * 100 + [("bad", "a", 0.05)] * 200 + [("bad", "c", 0.1)] + [("once", "z", 0.05)]
    table, mean = q.sites(spark.createDataFrame(rows, "host string, path string, p double").repartition(4))
    at = {(r.host, r.path): r for r in table.collect()}
    assert mean == pytest.approx(sum(r[2] for r in rows) / len(rows))
    assert at["good", "a"].host_posterior == pytest.approx(0.93, abs=0.02)
    assert abs(at["once", "z"].host_posterior - mean) < abs(0.05 - mean)  # one document moves it part of the way
    assert at["bad", "c"].path_posterior == pytest.approx(at["bad", "a"].host_posterior, abs=0.06)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "h"), (2, "", "h"), (None, "x" * 300000, "h"), (3, "A b. " * 9, "k")], "doc_id long, text string, host string").selectExpr("*", "1 as _p", "2 as path", "3 as p")
    labels = spark.createDataFrame([(1, None), (7, 1), (None, 0)], "doc_id long, quality int")
    out = q.score(docs, labels, F.col("host"), F.lit(None).cast("string"))
    assert out.columns == [*docs.columns, "_quality"]
    assert [round(r._quality.quality_score, 6) for r in out.collect()] == [0.5] * 5
    assert q.score(docs.limit(0), labels, F.col("host"), F.col("host")).collect() == []


def test_query_matches_brute_force(spark):
    """Posteriors and scores from the query's own evidence, by the formulas written out over plain lists."""
    import math
    from collections import defaultdict

    sf = "/root/testdata/sf0.01"
    rows = q.op8_quality(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    by = defaultdict(lambda: defaultdict(list))
    for r in rows:
        by[r.source][r.lang].append(r.p_document)
        if r.doc_id in labels:
            by[r.source][r.lang].append(float(labels[r.doc_id]))
    every = [x for paths in by.values() for own in paths.values() for x in own]
    n, m = len(every), sum(every) / len(every)
    mean = lambda x: sum(x) / len(x)
    hosts = {h: [x for own in paths.values() for x in own] for h, paths in by.items()}
    inside = sum((x - mean(own)) ** 2 for own in hosts.values() for x in own)
    across = sum(len(own) * (mean(own) - m) ** 2 for own in hosts.values())
    k, n2 = len(hosts), sum(len(own) ** 2 for own in hosts.values())
    strength = lambda between: 1e6 if between <= 0 else min(max(m * (1 - m) / between - 1, 1.0), 1e6)
    a = strength((across - (k - 1) * inside / (n - k)) / (n - n2 / n))
    host = {h: (sum(own) + a * m) / (len(own) + a) for h, own in hosts.items()}
    cells = [(h, own) for h, paths in by.items() for own in paths.values()]
    inside = sum((x - mean(own)) ** 2 for _, own in cells for x in own) / (n - len(cells))
    across = sum(len(own) * (mean(own) - mean(hosts[h])) ** 2 for h, own in cells)
    b = strength((across - (len(cells) - k) * inside) / (n - sum(len(own) ** 2 / len(hosts[h]) for h, own in cells)))
    logit = lambda p: math.log(min(max(p, 1e-3), 1 - 1e-3) / (1 - min(max(p, 1e-3), 1 - 1e-3)))
    for r in rows:
        own = by[r.source][r.lang]
        post = (sum(own) + b * host[r.source]) / (len(own) + b)
        assert r.host_posterior == pytest.approx(host[r.source], abs=1e-6) and r.path_posterior == pytest.approx(post, abs=1e-6)
        assert r.quality_score == pytest.approx(1 / (1 + math.exp(-(logit(r.p_document) + logit(post) - logit(m)))), abs=1e-6)


def test_hosts_and_paths_of_urls(spark):
    urls = ["https://User@Blog.Example.com:8080/En/825?x=1#t", "http://a.b", "ftp://h/?q", "no url", None]
    host, path = q.of_url(F.col("u"))
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select(host, path).collect()
    assert [tuple(r) for r in rows] == [("blog.example.com", "en"), ("a.b", ""), ("h", ""), ("", ""), (None, None)]


def test_many_sites_are_salted(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "A b c. " * (i % 5), f"h{i % 3}") for i in range(50)] + [(None, None, None)], "doc_id long, text string, host string")
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    one = q.score(docs, labels, F.col("host"), F.col("host")).orderBy("doc_id").collect()
    monkeypatch.setattr(q.shared, "BROADCAST_ROWS", 0)
    assert q.score(docs, labels, F.col("host"), F.col("host")).orderBy("doc_id").collect() == one
