import random

from millrace.llm import decontaminate as dc


def brute_coverage(doc, item):
    """Greedy string tiling as it is defined: the longest common run of free tokens, again and again."""
    d, p = dc.tokens(doc), dc.tokens(item)
    if not p:
        return 0.0
    free_d, free_p, covered, least = [True] * len(d), [True] * len(p), 0, min(dc.MIN_TILE, len(p))
    while True:
        best = (0, 0, 0)
        for i in range(len(d)):
            for j in range(len(p)):
                n = 0
                while i + n < len(d) and j + n < len(p) and free_d[i + n] and free_p[j + n] and d[i + n] == p[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered / len(p)
        free_d[i : i + n], free_p[j : j + n] = [False] * n, [False] * n
        covered += n


def make(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(12, 40)))) for i in range(12)] + [(90, "alpha beta"), (91, None), (92, ""), (3, "dup of id three with other words")]
    docs = []
    for i in range(40):
        words = rng.choices(vocab, k=rng.randint(0, 80))
        if i % 2:
            item = items[i % 12][1].split()
            cut = len(item) // 2
            words = words[:20] + item[cut:] + words[20:40] + item[:cut] + words[40:]  # reordered
        if i % 5 == 0:
            words += ["Alpha,", "BETA!"]
        docs.append((i, " ".join(words)))
    return docs + [(None, items[2][1].upper()), (41, None), (42, ""), (42, ""), (43, "x " * 100000 + items[5][1].replace(" ", " — "))], items


def test_documents_match_brute_force(spark):
    from pyspark.sql import functions as F

    docs, items = make(1)
    table = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as _covered", "2 as item_id").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (dc.BLOCK_TOKENS, 30):
        got = table.select("doc_id", dc.coverage(F.col("text"), spark, bench, block).alias("c")).select("doc_id", "c.coverage").collect()
        want = {d: max(brute_coverage(t, i) for _, i in items) for d, t in docs if d != 43}
        want[43] = 1.0
        assert {r.doc_id: round(r.coverage, 9) for r in got} == {d: round(c, 9) for d, c in want.items()}
    kept = dc.decontaminated(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([d for d, c in want.items() if c < dc.THRESHOLD] + [42])


def test_empty_tables(spark):
    docs, items = make(2)
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert dc.decontaminated(table.limit(0), bench).collect() == []
    assert dc.decontaminated(table, bench.limit(0)).count() == len(docs)


def test_planted_passages_are_found(spark, sf):
    rows = {r.doc_id: r for r in dc.op4_decontaminate(spark, sf).collect()}
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if any(b in (r.text or "") for b in bench):
            assert rows[r.doc_id].contaminated


def test_repeated_tokens_take_no_quadratic_time():
    import time

    began = time.perf_counter()
    assert sum(t[2] for t in dc.tile([1] * 200_000, [1] * 800)) == 800
    assert sum(t[2] for t in dc.tile([1, 2] * 20_000, [1] * 300 + [1, 2] * 100 + [2] * 300)) == 200
    assert time.perf_counter() - began < 5
    assert brute_coverage("a a a b a a " * 4, "a a b a a a a a b") == sum(t[2] for t in dc.tile([1, 1, 1, 2, 1, 1] * 4, [1, 1, 2, 1, 1, 1, 1, 1, 2])) / 9
