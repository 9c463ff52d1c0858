import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from millrace import catalog
from millrace.operators import graph


def walks_of_all_customers(sf, start, depth):
    """(node, depth, edge ids, confidence) of every simple path, in plain Python."""
    nation = pq.read_table(f"{sf}/nation.parquet").to_pylist()
    customer = pq.read_table(f"{sf}/customer.parquet").to_pylist()
    rows = [("in", 1000 + r["n_nationkey"], 2000 + r["n_regionkey"]) for r in nation]
    rows += [("lives", 10000 + r["c_custkey"], 1000 + r["c_nationkey"]) for r in customer]
    step = defaultdict(list)
    for i, (_, a, b) in enumerate(sorted(rows), 1):
        c = 0.5 + (a % 5) / 10.0
        step[a].append((b, i, c))
        step[b].append((a, i, c))
    found, now = [], [([start], [], 1.0)]
    for d in range(1, depth + 1):
        now = [([*nodes, n], [*ids, i], c * x) for nodes, ids, c in now for n, i, x in step[nodes[-1]] if n not in nodes]
        found += [(nodes[-1], d, ids, c) for nodes, ids, c in now]
    return found


def test_walks_are_of_the_whole_customer_table(spark, sf):
    found = walks_of_all_customers(sf, 1003, 3)
    near = defaultdict(list)
    for node, d, _, _ in found:
        near[node].append(d)
    got = {r.node: (r.depth, r.n_paths) for r in catalog.QUERIES["graph_neighbours"](spark, sf).collect()}
    assert got == {n: (min(ds), len(ds)) for n, ds in near.items()}
    best = {}
    for _, d, ids, c in found:
        s, e = best.get(ids[-1], (0, 9))
        best[ids[-1]] = (max(s, c * 0.85 ** (d - 1)), min(e, d))
    want = sorted((-round(s, 9), i, d) for i, (s, d) in best.items())[:25]
    rows = catalog.QUERIES["graph_context"](spark, sf).collect()
    assert [(r.edge_id, r.depth) for r in rows] == [(i, d) for _, i, d in want]
    assert [r.score for r in rows] == pytest.approx([-s for s, _, _ in want])
    paths = [(d, ",".join(map(str, ids))) for n, d, ids, _ in found if n == 1001 or n == 2001 and d == 1]
    assert sorted(tuple(r) for r in catalog.QUERIES["graph_paths"](spark, sf).collect()) == sorted(paths)


def similarity(a, b):
    x, y = (" ".join(re.findall(r"[^\W_]+", s.lower())) for s in (a, b))
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    u, v = set(x.split()), set(y.split())
    n = sum(any(p == q or min(len(p), len(q)) >= 4 and (p.startswith(q) or q.startswith(p)) for q in v) for p in u)
    return min(max(n / max(len(u), len(v)), 0.86 * (x in y or y in x)), 0.99)


def test_merges_match_all_pairs(spark):
    rng = random.Random(5)
    labels = ["Acme", "AcmeCorp", "The Acme", "a", "AC", "", "...", "Data Analytic", "Data Analytics Unit", "Datas Analytics", "corp of data", "p of d", "International Business", "national business", "A.c.m.e", "acme!"]
    labels += ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    rows = [(i % 2 if i >= 16 else 0, i, s) for i, s in enumerate(labels)]
    nodes = spark.createDataFrame(rows, "kind int, node_id long, label string")
    for least in (0.86, 0.5):
        want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and similarity(a[2], b[2]) >= least}
        got = [(r.node_id, r.other_id) for r in graph.suggest_merges(nodes, least).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (0, 1) in want
