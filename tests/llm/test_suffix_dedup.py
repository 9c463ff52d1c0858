import hashlib
from collections import defaultdict

import numpy as np
import pytest

from millrace.llm import suffix_dedup as sd


def brute(rows, length):
    where = defaultdict(list)
    raws = [(t or "").encode() for _, t in rows]
    for k, raw in enumerate(raws):
        for i in range(len(raw) - length + 1):
            where[raw[i : i + length]].append((k, i))
    gone = [np.zeros(len(r), bool) for r in raws]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = True
    out = []
    for (d, _), raw, g in zip(rows, raws, gone):
        kept = np.frombuffer(raw, np.uint8)[~g].tobytes()
        spans = int(np.sum(np.diff(np.concatenate([[0], g.astype(int)])) == 1))
        out.append((d, len(raw), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(docs, length, gram):
    from pyspark.sql import functions as F

    out = sd.deduplicated(docs, length, gram).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("s"))
    return sorted(map(tuple, out.collect()), key=str)


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = sorted(map(tuple, sd.op1_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.collect()], 200)


@pytest.mark.parametrize("group", [500, 3])
def test_small_alphabet_and_odd_rows(spark, monkeypatch, group):
    monkeypatch.setattr(sd, "GROUP", group)
    rng = np.random.default_rng(4)
    make = lambda n: "".join(rng.choice(list("ab"), n))
    part = make(30)
    rows = [(i, make(int(rng.integers(0, 60))) + part[: int(rng.integers(0, 30))] + make(8)) for i in range(60)]
    rows += [(70, None), (71, ""), (None, part), (72, part), (72, part), (73, "a" * 3000), (74, "é" * 40), (75, "é" * 40 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as h").repartition(3)
    assert run(docs, 12, 6) == brute(rows, 12)
    assert run(docs.limit(0), 12, 6) == []


def test_deep_shallow_order():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 4000).astype(np.uint8)
    data[1000:1400] = data[:400]
    padded = np.concatenate([data, np.zeros(300, np.uint8)])
    starts = np.arange(0, 1500)
    order = sd.deep_shallow(padded, starts, 200, shallow=8)
    want = sorted(range(len(starts)), key=lambda i: padded[i : i + 200].tobytes())
    assert [padded[i : i + 200].tobytes() for i in order] == [padded[i : i + 200].tobytes() for i in want]
