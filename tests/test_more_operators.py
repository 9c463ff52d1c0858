import datetime
import json
import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import tokens
from millrace.operators import cubes, graph, lifecycle, metrics, models, relational, search, semantic, shared
from millrace.sources import remote


def brute_covers(words, query):
    """Every run of words that holds all of the query's and no shorter such run, scored."""
    places = [i for i, w in enumerate(words) if w in query]
    score = 0.0
    for a in places:
        for b in places:
            held = [i for i in places if a <= i <= b]
            if a > b or {words[i] for i in held} != set(query):
                continue
            if any({words[i] for i in held if x <= i <= y} == set(query) for x, y in ((held[0] + 1, b), (a, held[-1] - 1))):
                continue
            score += 0.1 / (1 + (b - a) - (len(held) - 1))
    return score


def test_cover_density_matches_brute_force(spark):
    texts = ["a b", "b x a y a b", "a a a", "b", "", "x a x x b a x b b a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", search.cover_density(F.col("t"), ["a", "b"]).alias("s")).collect()
    for r in rows:
        assert r.s == pytest.approx(brute_covers((r.t or "").split(), ["a", "b"]))
    table = spark.createDataFrame([("red bolt",), ("red bolt",), ("a RED x bolt",), ("bolt",), (None,)], "v string")
    got = [(r.value, round(r.score, 3)) for r in search.lexical_knn(table, "v", " red bolt ", 5).collect()]
    assert got == [("red bolt", 2.1), ("a RED x bolt", 0.05)]
    assert search.lexical_knn(table, "v", "  ", 5).collect() == []


def test_coarse_index_has_recall(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 8))
    x = centres[rng.integers(0, 20, 800)] + 0.1 * rng.normal(size=(800, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = search.CoarseIndex(table, shared.scratch(spark, "cells"), n=20)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 800, 200):
        want = set(np.argsort(-(u @ u[q]), kind="stable")[:10].tolist())
        hit += len(want & {r.id for r in index.search(x[q].tolist(), 10, probes=3).collect()})
    assert hit >= 36
    assert index.spark.read.parquet(index.folder).count() == 800


def test_asof_join_over_buckets(spark):
    at = lambda d, h=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d, hours=h)
    right = [("k", at(d), d) for d in (0, 3, 40, 200)] + [("j", at(1), 7)]
    left = [("k", at(d, h), i) for i, (d, h) in enumerate([(0, 0), (2, 5), (39, 0), (40, 1), (150, 0), (199, 0), (400, 0)])] + [("j", at(0), 90), ("j", at(300), 91), ("none", at(5), 92)]
    out = relational.asof_join(spark.createDataFrame(left, "k string, at timestamp, i int"), spark.createDataFrame(right, "k string, at timestamp, v int"), "k", "at").collect()
    for k, a, i in left:
        seen = [(t, v) for kk, t, v in right if kk == k and t <= a]
        assert [r.v for r in out if r.i == i] == [max(seen)[1] if seen else None]
    numbers = relational.asof_join(spark.createDataFrame([(1, 250_000, 1), (1, 5, 2)], "k int, at long, i int"), spark.createDataFrame([(1, 10, 5)], "k int, at long, v int"), "k", "at")
    assert {r.i: r.v for r in numbers.collect()} == {1: 5, 2: None}


def test_numbers_and_visibility(spark):
    rows = spark.range(500).select((F.col("id") * 7919 % 501).alias("x"))
    got = {r.x: r.n for r in shared.numbered(rows, "n", ["x"]).collect()}
    assert got == {x: i for i, x in enumerate(sorted(got), 1)}
    assert shared.numbered(rows.limit(0), "n", ["x"]).collect() == []
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, g string")
    roles, hidden = spark.createDataFrame([("u", "a")], "caller string, g string"), spark.createDataFrame([("u", 2), ("w", 1)], "caller string, id int")
    see = lambda c: sorted(r.id for r in relational.visible(docs, roles, hidden, c, "id", "g").collect())
    assert see("u") == [1] and see("w") == see(None) == []


def test_semantic_reduces_retries_and_steps(spark):
    asked = []

    def provider(prompts):
        asked.append(list(prompts))
        return [f"{len(asked)}:{p}" for p in prompts]

    op = semantic.Operator("o", "{{ text }}", takes=2, reduce="first_valid", valid=lambda s: s.startswith("2"))
    assert op.answers(provider, [{"text": "a"}, {"text": "b"}]) == ["2:a\n#1.0", "2:b\n#1.0"]
    assert [len(c) for c in asked] == [2, 2]
    judge = semantic.Operator("o", "{{ text }}", takes=3, reduce="evaluator", evaluator=lambda ps: ["take 2"])
    assert judge.answers(lambda ps: [p[-1] for p in ps], [{"text": "x"}]) == ["0"]
    both = semantic.Operator("o", "x", takes=3, reduce="consensus")
    assert json.loads(both.answers(lambda ps: ['[{"name": "n", "confidence": 0.5}]'] * len(ps), [{}])[0]) == [{"name": "n", "confidence": 0.5}]
    again = semantic.Operator("o", "say {{ text }}", attempts=2, valid=lambda s: "no" in s, feedback="not {{ output }}")
    assert again.answers(lambda ps: [p for p in ps], [{"text": "z"}]) == ["not say z"]
    steps = semantic.Steps("s", [("a", "llm", "{{ text }}!"), ("b", "specialist", ("echo", "{{ steps.a.output }}?")), ("c", "code", "strip")], providers={"echo": lambda ps: [f" {p} " for p in ps]})
    assert steps.answers(lambda ps: ps, [{"text": "q"}]) == ["q!?"]
    with pytest.raises(ValueError):
        semantic.Steps("s", [("a", "nothing", "")]).answers(lambda ps: ps, [{}])


def test_cache_knows_what_an_answer_depends_on(spark):
    stub, table = semantic.StubProvider(), spark.createDataFrame([("x",)], "t string")
    key = lambda op, **w: semantic.answered(table, "t", op, stub, **w).first().key
    one = semantic.Operator("o", "{{ text }}")
    other = semantic.StubProvider()
    other.model = "newer"
    keys = {key(one), key(semantic.Operator("o", "{{ text }}", takes=3)), key(semantic.Operator("o", "{{ text }}", attempts=2)), key(one, arguments={"a": "b"}), semantic.answered(table, "t", one, other).first().key}
    assert len(keys) == 5 and key(one) in keys


def test_answers_are_parsed_by_type():
    p = semantic.parsed
    assert p(" yes.", "boolean") is True and p("no", "boolean") is False and p(None, "boolean") is None
    assert p("about 0.7 of it", "double") == 0.7 and p("9", "double") == 1.0 and p("none", "double") is None
    assert p("a, b;a\n", "array<string>") == ["a", "b"] and p('["x", "y"]', "array<string>") == ["x", "y"]
    assert semantic.seeded("redact").answers(lambda ps: ["has 1"] * len(ps), [{"text": "t"}]) == [None]
    assert semantic.seeded("clean_year").answers(lambda ps: ["1999" if "#" in p else "?" for p in ps], [{"text": "t"}]) == ["1999"]


def test_a_handler_runs_apart_and_its_errors_fail_the_query(spark):
    semantic.register_handler(spark, "mr_env", "import os, sys\ndef f(x):\n    return str('pyspark' in sys.modules) + str(len(os.environ.get('HOME', '')))\n", "f")
    assert spark.sql("SELECT mr_env('a') AS x").first().x == "False0"
    semantic.register_handler(spark, "mr_bad", "def f(x):\n    return 1 / x\n", "f", "double")
    with pytest.raises(Exception):
        spark.sql("SELECT mr_bad(0)").collect()


def test_store_sync_and_tick(spark):
    rows = lambda *k: spark.createDataFrame([(i, str(i)) for i in k], "k long, v string")
    store = lifecycle.Store(spark, shared.scratch(spark, "s"), "k")
    assert store.newest() == 0 and lifecycle.sync_plan(rows(1), store) == [("k", "bigint", "add"), ("v", "string", "add")]
    stores = {"a": store}
    assert lifecycle.run_tick(stores, {"a": rows(1, 2, 3)}, {}) == [("a", "full")]
    assert lifecycle.run_tick(stores, {"a": rows(1, 2, 3)}, {}) == []
    assert lifecycle.run_tick(stores, {"a": rows(1, 2, 3, 4)}, {}, dry_run=True) == [("a", "delta")]
    stores["a"].delete(rows(2))
    assert lifecycle.run_tick(stores, {"a": rows(1, 3, 4)}, {"a": {"max_tombstones": 1}}) == [("a", "full")]
    assert sorted(r.k for r in stores["a"].table().collect()) == [1, 3, 4] and stores["a"].statistics()["tombstones"] == 0


def test_hot_tables_let_the_least_used_go(spark):
    df = spark.range(1000)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    hot = lifecycle.HotTables(2 * size)
    hot.load("a", df), hot.load("b", df)
    hot.get("a")
    hot.load("c", df)
    assert [n for n, _ in hot.status()] == ["a", "c"] and hot.get("b") is None
    assert hot.load("huge", spark.range(10**6)).count() == 10**6 and hot.get("huge") is None
    assert all(hot.evict(n) for n, _ in hot.status()) and not hot.evict("a")


def test_cubes_refuse_what_can_not_run(spark):
    c = cubes.Cubes(spark, shared.scratch(spark, "c"), {"t": spark.range(3)})
    for name, sql in (("Bad", "SELECT 1"), ("ok", " ; "), ("ok", "SELECT nothing FROM {t}")):
        with pytest.raises(Exception):
            c.define(name, sql)
    assert c.versions == {} or c.versions == {"ok": []}
    assert c.define("ok", "SELECT id FROM {t} WHERE id < 0") == 1
    assert c.health().first().status == "empty"
    with pytest.raises(Exception):
        c.define("ok", "SELECT nothing FROM {t}")
    assert c.define("ok", "SELECT id AS n_id, id % 2 AS p FROM {t}") == 2 and c.health().first().status == "ok"
    with pytest.raises(ValueError):
        c.slice("ok", ["nothing"])


def test_sql_of_a_provider_only_reads(spark):
    for bad in ("DROP TABLE x", "INSERT INTO t VALUES (1)", "CREATE VIEW v AS SELECT 1", "SET a=1"):
        with pytest.raises(ValueError):
            models.checked_select(spark, bad)
    with pytest.raises(Exception):
        models.checked_select(spark, "SELECT 1; SELECT 2")
    assert models.checked_select(spark, " SELECT 1; ") == "SELECT 1"
    with pytest.raises(ValueError):
        models.ask_sql(spark, "?", {"t": spark.range(1)}, lambda ps: ["DROP TABLE t"])


def test_evaluate_f1_and_graph_aliases(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 1.0)], "y double, prediction double")
    r = models.evaluate(rows, "y", "classification").first()
    assert (r.n, r.accuracy) == (5, 0.6) and r.f1 == pytest.approx((2 / 3 + 2 * 2 / (2 + 4) + 0) / 3)
    g = graph.Graph(spark)
    g.assert_nodes(spark.createDataFrame([("p", "Ann Lee"), ("p", "ann  lee"), ("p", "...")], "kind string, label string"))
    g.assert_aliases(spark.createDataFrame([("p", "A. L.", "Ann Lee")], "kind string, alias string, label string"))
    t = spark.createDataFrame([("p", "A L", "knows", "p", "Bo", 0.5, None, "d1"), ("p", "Ann Lee", "Knows", "p", "Bo", 0.8, "q", "d2")], "subject_kind string, subject string, predicate string, object_kind string, object string, confidence double, evidence string, source string")
    g.assert_triples(t)
    assert [(r.src, r.predicate, r.dst, r.confidence) for r in g.edges.collect()] == [("ann lee", "knows", "bo", 0.8)]
    assert g.evidence.count() == 1 and {r.key for r in g.resolve(spark.createDataFrame([("p", "a l"), ("p", "x")], "kind string, label string")).collect()} == {"ann lee", None}


def test_thresholds_and_tokens(spark):
    v = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double")
    assert [r.x for r in v.select(metrics.fails(F.col("v"), "gte", 2.0).alias("x")).collect()] == [True, False, False]
    t = spark.createDataFrame([("It's 3, ok",), ("",), (None,)], "t string")
    assert [r.n for r in t.select(tokens.token_count(F.col("t")).alias("n")).collect()][:2] == [6, 0]
    ids = t.select(tokens.content_id(F.col("t")).alias("i")).collect()
    assert len({r.i for r in ids}) == 3
    with pytest.raises(Exception):
        remote.rows(spark.createDataFrame([("{}",)], "a string"), "a", remote.StubServer(), "nothing").collect()
    assert math.isclose(search.WEIGHT, 0.1)


def test_token_ids_of_a_rank_file(spark, tmp_path):
    import base64

    ranks = [bytes([b]) for b in range(256)] + [b"th", b"the"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(r) + b" " + str(i).encode() + b"\n" for i, r in enumerate(ranks)))
    rows = spark.createDataFrame([("the th",), (None,)], "t string").select(tokens.tokenize(F.col("t"), str(path)).alias("ids"), tokens.token_count(F.col("t"), str(path)).alias("n")).collect()
    assert rows[0].ids == [257, 32, 256] and rows[0].n == 3 and rows[1].ids is None and rows[1].n is None


def test_vector_tiles_are_pruned_without_loss(spark, monkeypatch):
    import numpy as np

    from millrace.operators import vector

    monkeypatch.setattr(vector, "TILE", 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 5))[rng.integers(0, 6, 150)] + 0.02 * rng.normal(size=(150, 5))
    x[7] = 0
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {r.id: r.distance for r in vector.isolation(table).collect()}
    assert all(got[i] == pytest.approx(1 - s[i].max(), abs=1e-9) for i in range(150))
    made = []
    plain = vector._met
    monkeypatch.setattr(vector, "_met", lambda left, right, run, schema, keep: made.append((left.count(), plain(left, right, run, schema, keep))) or made[-1][1])
    groups = {r.id: r.group_id for r in vector.similar_groups(table, 0.99).collect()}
    label = list(range(150))
    for _ in range(20):
        for i, j in zip(*np.nonzero(s >= 0.99)):
            label[i] = label[j] = min(label[i], label[j])
    assert groups == dict(enumerate(label)) and made[0][0] >= 6
    assert vector.isolation(table.limit(0)).collect() == [] and vector.novelty(table.limit(2), table.limit(0)).count() == 2


def test_cosine_to_a_known_vector(spark):
    from millrace.functions import text as T

    rows = spark.createDataFrame([([1.0, 0.0],), ([2.0, 2.0],), ([0.0, 0.0],), ([1.0],), (None,)], "v array<double>")
    for q in ([1.0, 1.0], [0.0, 0.0]):
        both = rows.select(T.cosine_to(F.col("v"), q).alias("a"), T.cosine(F.col("v"), F.array(*[F.lit(x) for x in q])).alias("b")).collect()
        assert all(r.a == pytest.approx(r.b) if r.b is not None else r.a is None for r in both)
