import itertools
from collections import Counter

import numpy as np
import xxhash

from millrace.llm import shared, simhash


def brute_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    counts = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute(rows, radius=2):
    prints = [brute_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, j in itertools.combinations(range(len(rows)), 2):
            if label[i] != label[j] and bin(prints[i] ^ prints[j]).count("1") <= radius:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    least = {}
    for (d, _), x in zip(rows, label):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return sorted(((d, f"{p:016x}", least.get(x)) for (d, _), p, x in zip(rows, prints, label)), key=str)


def test_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = simhash.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(spark):
    rows = [(5, None), (3, ""), (9, " \t\n"), (4, "One two"), (4, "one TWO"), (None, "one two"), (7, "a b c d"), (8, "word " * 30000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs.selectExpr("*", "1 as f0", "2 as n")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_close_links_between_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 5)
    prints = {int(b) for b in base}
    for b in base:
        for _ in range(60):
            i, j = rng.integers(0, 64, 2)
            prints.add(int((np.uint64(b) ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j))).astype(np.int64)))
    prints = sorted(prints)
    edges = simhash.link_close(spark.createDataFrame([(p,) for p in prints], "f0 long"), 2)
    comp = {r.node: r.component for r in shared.components(edges).collect()}
    forest = shared.Forest()
    u = np.array(prints, np.int64).view(np.uint64)
    for i, j in itertools.combinations(range(len(prints)), 2):
        if int(np.bitwise_count(u[i] ^ u[j])) <= 2:
            forest.join(prints[i], prints[j])
    assert comp == {p: forest.find(p) for p in forest.up}


def test_components_of_a_long_path(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long").repartition(7)
    comp = {r.node: r.component for r in shared.components(edges).collect()}
    assert comp == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert shared.components(edges.limit(0)).count() == 0


def test_keep_one_of_each_group(spark):
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(vocab, 300)) for _ in range(20)]
    near = texts[3].split()
    near[100] = "changed"
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(50, texts[7], "xx"), (51, " ".join(near), "yy"), (None, texts[9], "zz"), (60, None, None), (61, "", None), (0, texts[0], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _c string").repartition(3)
    got = simhash.keep_one(docs)
    assert got.columns == ["doc_id", "text", "_c"]
    assert sorted(r.doc_id for r in got.collect()) == [*range(20), 60]


def test_keep_one_links_by_the_similarity_of_shingle_sets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SET_TILE", 8)
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(5000)]
    texts = [" ".join(vocab[i : i + n]) for i, n in ((0, 8), (0, 9), (100, 9), (100, 10), (200, 12), (200, 14))]
    for size in (30, 60, 300):
        for at in range(24):
            base = list(rng.choice(vocab, size))
            texts.append(" ".join(base))
            for _ in range(3):  # changed at the end, for similarities from 0.6 to 0.9
                cut = int(rng.integers(size // 20, size // 4 + 1))
                texts.append(" ".join(base[:-cut] + list(rng.choice(vocab, cut))))
    texts += ["again and again it goes on " * 80 + t for t in texts[-2:]]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    near = 0
    for i, j in itertools.combinations(range(len(texts)), 2):
        s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        near += 0.6 <= s < 0.9
        if s >= 0.8:
            label = [label[i] if x == label[j] else x for x in label]
    least = sorted(min(i for i, x in enumerate(label) if x == c) for c in set(label))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert near > 50
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == least


def test_tiles_of_several_strips_match_brute_force():
    rng = np.random.default_rng(5)
    for words, radius in ((1, 2), (1, 20), (4, 68), (4, 80), (4, 110), (6, 150)):
        a = rng.integers(0, 2**64, (150, words), dtype=np.uint64)
        b = rng.integers(0, 2**64, (simhash.STRIP[1] + 300, words), dtype=np.uint64)
        b[-100:] = a[:100] ^ rng.integers(0, 16, (100, words), dtype=np.uint64)
        far = np.bitwise_count(a[:, None] ^ b[None]).sum(2, dtype=int)
        got = sorted((x, y) for i, j in simhash.compare_tiles(a, b, radius) for x, y in zip(i.tolist(), j.tolist()))
        assert got == [tuple(p) for p in np.argwhere(far <= radius).tolist()] and got
        own = np.argwhere(np.triu(np.bitwise_count(b[:, None] ^ b[None, -400:]).sum(2, dtype=int) <= radius, 1 - len(b) + 400)) if words == 1 else []
        within = {(min(x, y), max(x, y)) for i, j in simhash.compare_tiles(b, None, radius) for x, y in zip(i.tolist(), j.tolist())}
        assert {(x, y + len(b) - 400) for x, y in own if x < y + len(b) - 400} <= within


def test_starts_of_similar_sets_share_enough():
    rng = np.random.default_rng(6)
    for n in [*range(1, 60), 200, 333]:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for gone, new in itertools.product(range(0, n // 4 + 1), (0, 1, n // 8, n // 5)):
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
            if simhash.similar(a, b, 0.8):
                both = len(set(simhash.start(a, 0.8)) & set(simhash.start(b, 0.8)))
                assert both >= max(max(1, int((0.8 * len(x) - 1e-6) / simhash.PART)) for x in (a, b))
        assert len(simhash.start(a, 0.8)) <= 0.3 * n + 1


def test_only_texts_that_share_much_meet_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(7)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    passage, rows = words(20), []
    for i in range(300):
        own = words(200)
        own[50:70] = passage
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, rows[i][1] + " " + " ".join(words(5))) for i in range(10)]
    met = []
    wide = simhash.link_wide
    monkeypatch.setattr(simhash, "link_wide", lambda distinct, *more: (met.append(distinct.count()), wide(distinct, *more))[1])
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(300))
    assert met == [20]
