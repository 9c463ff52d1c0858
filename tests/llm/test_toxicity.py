import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import toxicity as tx


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = tx.op3_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    assert len(rows) > 80 and hit / len(rows) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_passes_match_enumeration():
    rng = np.random.default_rng(0)
    emit, moves, begin = rng.normal(size=(1, 5, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    z, marginal, pairs = 0.0, np.zeros((5, 2)), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=5):
        p = np.exp(begin[tags[0]] + sum(emit[0, t, y] for t, y in enumerate(tags)) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
        z += p
        for t, y in enumerate(tags):
            marginal[t, y] += p
        for a, b in zip(tags, tags[1:]):
            pairs[a, b] += p
    log_z, m, q = tx._passes(emit, moves, begin)
    assert log_z[0] == pytest.approx(np.log(z)) and np.allclose(m[0], marginal / z) and np.allclose(q, pairs / z)


def test_marginals_of_a_whole_text_match_the_plain_chain():
    model = tx.Model(words=["bad", "vile"], weights=np.array([2.0, 1.5, -1.0]), moves=np.array([[0.5, -0.5], [-0.3, 0.8]]), begin=np.array([0.2, -0.2]))
    text = "a bad thing and the vile bad end of it"
    tagger = tx.Tagger(model)
    hits = tagger.hits(text)
    ids = [{"bad": 0, "vile": 1}.get(w, 2) for w in text.split()]
    emit = np.zeros((1, len(ids), 2))
    emit[0, :, 1] = model.weights[ids]
    _, m, _ = tx._passes(emit, model.moves, model.begin)
    assert [text[h[2] : h[3]] for h in hits] == ["bad", "vile", "bad"]
    assert np.allclose(tagger.marginals(hits, text), [m[0, t, 1] for t, i in enumerate(ids) if i < 2])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x"), (3, "bad " * 50000)], "doc_id long, text string").selectExpr("*", "1 as toxic")
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 1), (None, 0)], "doc_id long, toxic int")
    model = tx.fit(docs.select("doc_id", "text"), labels)
    rows = docs.select(tx.tag(F.col("text"), model).alias("t")).select("t.score").collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert docs.limit(0).select(tx.tag(F.col("text"), model).alias("t")).collect() == []


def test_marginals_hold_for_any_gap_and_white_space():
    model = tx.Model(words=["bad"], weights=np.array([1.2, -0.02]), moves=np.array([[3.0, -3.0], [-3.0, 3.0]]), begin=np.array([0.0, 0.3]))
    tagger = tx.Tagger(model)
    seen = set()
    for gap in (1, 2, 399, 2000, 20000):
        for text in ("bad " + "word " * (gap - 1) + "bad end", "bad,\t" + "word  -\r\n" * (gap - 1) + "bad end"):
            hits = tagger.hits(text)
            ids = [0] + [1] * (gap - 1) + [0, 1]
            emit = np.zeros((1, len(ids), 2))
            emit[0, :, 1] = model.weights[ids]
            _, m, _ = tx._passes(emit, model.moves, model.begin)
            got = tagger.marginals(hits, text)
            assert np.allclose(got, m[0, [0, gap], 1])
        seen.add(round(got[0], 6))
    assert len(seen) > 3


def test_query_matches_brute_force(spark, sf):
    """The scores of the query are those of whole chains, token by token, under the fitted model."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    model = tx.fit(docs, labels.filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    rows = {r.doc_id: r for r in tx.op3_toxicity(spark, sf).collect()}
    number = {w: i for i, w in enumerate(model.words)}
    for d in docs.collect():
        words = [w.lower() for w in tx._WORD.findall(d.text or "")]
        ids = [next((number[w[:n]] for n in range(1, len(w) + 1) if w[:n] in number), len(number)) for w in words]
        p = np.empty(0)
        if ids:
            emit = np.zeros((1, len(ids), 2))
            emit[0, :, 1] = model.weights[ids]
            p = tx._passes(emit, model.moves, model.begin)[1][0, np.array(ids) < len(number), 1]
        a, b = tx._inputs(p.tolist())
        assert rows[d.doc_id].score == pytest.approx(1 / (1 + np.exp(-(model.score @ [1.0, a, b]))), abs=1e-9)
        assert rows[d.doc_id].n_spans == (p >= 0.5).sum() == len(rows[d.doc_id].spans)
