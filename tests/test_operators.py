import datetime
import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import graph, metrics, quality, semantic, shared, timetravel, vector
from millrace.plans import flow
from millrace.streaming import incremental


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, "Bread is good.  The oven is hot. Bread in the oven! Rain", lambda t: T.text_evidence(t, "bread oven", 2)) == ["Bread is good.", "Bread in the oven!"]
    assert one(spark, "", lambda t: T.text_evidence(t, "bread")) == []
    assert one(spark, "one\n\ntwo\n\n" + "x" * 20, lambda t: T.chunks(t, 10)) == ["one\n\ntwo", "x" * 20]
    assert one(spark, "\n  \n a \nb", T.first_non_empty_line) == "a"
    assert one(spark, " yEs", lambda t: T.validate_one_of(t, ["Yes", "No"], "?")) == "Yes"
    assert one(spark, "maybe", lambda t: T.validate_one_of(t, ["Yes", "No"], "?")) == "?"
    rows = json.dumps([{"subject": "a", "predicate": "is", "object": "b", "confidence": 0.5}, {"subject": " ", "predicate": "is", "object": "c"}])
    assert [r.object for r in one(spark, rows, T.triples_of)] == ["b"]


def test_cosine_of_odd_vectors(spark):
    rows = [([1.0, 0.0], [1.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0]), ([1.0, 1.0], [2.0, 2.0])]
    got = [r.c for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[:3] == [0.0, 0.0, None] and got[3] == pytest.approx(1.0)


def test_vectors_over_many_tiles(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "TILE", 16)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(70, 4))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    np.fill_diagonal(s, -2)
    got = {r.id: r.distance for r in vector.isolation(table).collect()}
    assert all(got[i] == pytest.approx(1 - s[i].max()) for i in range(70))
    label = list(range(70))
    for _ in range(70):
        for i, j in zip(*np.nonzero(s >= 0.95)):
            label[i] = label[j] = min(label[i], label[j])
    assert {r.id: r.group_id for r in vector.similar_groups(table, 0.95).collect()} == dict(enumerate(label))
    assert [r.distance for r in vector.isolation(table.limit(1)).collect()] == [1.0]
    assert {r.novelty for r in vector.novelty(table, table.limit(0)).collect()} == {1.0}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(90, 80)], "a long, b long")
    assert {r.node: r.component for r in shared.components(edges).collect()} == {i: 0 for i in range(41)} | {90: 80, 80: 80}


def test_merge_and_upsert(spark):
    edges = spark.createDataFrame([(1, 1, "p", 5, 0.5), (2, 2, "p", 5, 0.9), (3, 1, "p", 2, 1.0)], "edge_id long, src long, predicate string, dst long, confidence double")
    got = graph.merged(edges, spark.createDataFrame([(2, 1)], "from_id long, to_id long")).collect()
    assert [(r.src, r.dst, r.confidence, r.edge_id) for r in got] == [(1, 5, 0.9, 1)]
    nodes = spark.createDataFrame([(1, "x", 1)], "node_id long, label string, at int")
    assert [r.label for r in graph.upsert(nodes, nodes.withColumns({"label": F.lit("y"), "at": F.lit(2)}), ["node_id"], "at").collect()] == ["y"]
    names = spark.createDataFrame([("X!",), ("none",)], "name string")
    aliases = spark.createDataFrame([], "alias string, node_id long")
    assert {r.name: r.node_id for r in graph.resolve(nodes, aliases, names).collect()} == {"X!": 1, "none": None}


def test_time_before_the_first_generation_is_empty(spark):
    t = datetime.datetime
    generations = spark.createDataFrame([(1, t(2024, 1, 1)), (2, t(2024, 2, 1))], "generation long, time timestamp")
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "k long, generation long")
    deletes = spark.createDataFrame([(1, 2)], "k long, generation long")
    at = lambda when: sorted(r.k for r in timetravel.as_of(rows, deletes, "k", timetravel.generation_at(generations, when)).collect())
    assert at("2023-01-01") == [] and at("2024-01-15") == [1, 2] and at("2025-01-01") == [2, 3]
    assert sorted(r.k for r in timetravel.reaped(rows, generations, "2024-06-01").collect()) == [3]


def test_metrics_refuse_cycles():
    m = metrics.Metrics()
    assert (m.define("a", "{metric:b}"), m.define("b", "{metric:a}"), m.define("b", "x")) == (1, 1, 2)
    assert m.sql("a") == "(x)"
    m.define("b", "{metric:a}")
    with pytest.raises(ValueError):
        m.sql("a")
    m.define("c", "{v} {v!}")
    assert m.sql("c", {"v": "it's"}) == "'it\\'s' it's"


def test_semantic_framework(spark):
    assert semantic.vote([" b", "a", "a ", "b"]) == "b"
    assert semantic.consensus([[{"name": "x", "confidence": 1}], [{"name": "x", "confidence": 0.5}], [{"name": "y"}]]) == [{"name": "x", "confidence": 0.75}]
    assert semantic.render('{{ inputs.a }} {{ steps.s.output.k }}', {"a": "1"}, {"s": {"output": '{"k": 2}'}}) == "1 2"
    asked = []

    def provider(prompts):
        asked.extend(prompts)
        return ["bad"] if len(asked) < 2 else ["good"]

    op = semantic.Operator("o", "{{ inputs.text }}", attempts=3, valid=lambda s: s == "good", after=[(lambda s: 1 / 0, True)])
    assert op.answer(provider, "q") == "good" and len(asked) == 2
    assert semantic.Operator("o", "x", before=[(lambda s: False, True)]).answer(provider, "q") is None
    table = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, t string")
    got = semantic.apply(table, "t", semantic.Operator("o", "{{ inputs.text }}"), semantic.StubProvider(), "x").collect()
    assert len(got) == 3 and len({r.x for r in got if r.t}) == 1 and [r.x for r in got if r.t is None] == [None]
    assert semantic.aggregate(table, "id", "t", semantic.Operator("o", "{{ inputs.text }}"), semantic.StubProvider()).count() == 2
    assert len(semantic.embed(table, "t").first().v) == 128


def test_flow_split():
    assert flow.split("SELECT CASE WHEN a THEN 'then' END -- then\n FROM (SELECT 1 THEN 2) THEN pass THEN count") == ["SELECT CASE WHEN a THEN 'then' END -- then\n FROM (SELECT 1 THEN 2)", "pass", "count"]


def test_flow_artifact_and_failure(spark):
    spec = flow.run(spark, "SELECT 1 AS a THEN bar_chart('a')", {}).first()
    assert spec.kind == "bar_chart" and json.loads(spec.spec)["rows"] == [{"a": 1}]
    with pytest.raises(ValueError):
        flow.run(spark, "SELECT 1 AS a THEN unknown", {})


def test_sketch_and_bitmap(spark):
    rows = spark.range(5000).select(F.col("id"), (F.col("id") % 3000).cast("string").alias("t"))
    assert abs(quality.approx_distinct(rows, "t").first().n - 3000) < 150
    assert quality.approx_distinct(rows, "id").first().n is None
    assert quality.severity(0.3) == "major"


def test_streams(spark, tmp_path):
    source, target, checks = (str(tmp_path / x) for x in ("in", "out", "checks"))
    states = [("r", i, f) for i, f in enumerate([1, 1, 1, 0, 1, 1, 0, 0, 1, 1])]
    df = spark.createDataFrame(states, "rule string, at long, f int").selectExpr("rule", "at", "f = 1 as failing")
    df.write.parquet(source)
    schema = "rule string, at long, failing boolean"
    for _ in range(2):  # the second call finds nothing new
        incremental.ingest(incremental.read_new(spark, source, schema), target, checks + "/a")
    assert spark.read.parquet(target).count() == 10
    view = str(tmp_path / "view")
    incremental.keep_view(incremental.read_new(spark, source, schema), view, "at", lambda d: d.selectExpr("at", "at * 2 as x"), checks + "/b")
    assert spark.read.parquet(view).count() == 10
    batch = sorted((r.rule, r.at) for r in metrics.alerts(df, 2, 4).collect())
    out = str(tmp_path / "fires")
    fires = incremental.fires(incremental.read_new(spark, source, schema), 2, 4)
    fires.writeStream.format("parquet").option("path", out).option("checkpointLocation", checks + "/c").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.rule, r.at) for r in spark.read.parquet(out).collect()) == batch == [("r", 1), ("r", 5), ("r", 9)]
