import pyarrow.parquet as pq

from millrace import catalog
from millrace.operators import metrics
from millrace.streaming import incremental


def brute(states, consecutive, cooldown):
    out, run, last = [], {}, {}
    for rule, at, failing in sorted(states):
        run[rule] = run.get(rule, 0) + 1 if failing else 0
        if run[rule] == consecutive and (rule not in last or at - last[rule] >= cooldown):
            last[rule] = at
            out.append((rule, at))
    return out


def test_cooldown_is_from_the_last_fire(spark, tmp_path):
    states = [("r", at, at % 20 == 0) for at in range(0, 130, 10)] + [("s", 0, True), ("s", 10, False), ("s", 29, True), ("s", 31, False), ("s", 32, True)]
    want = [("r", 0), ("r", 40), ("r", 80), ("r", 120), ("s", 0), ("s", 32)]
    df = spark.createDataFrame(states, "rule string, at long, failing boolean")
    assert sorted(tuple(r) for r in metrics.alerts(df, 1, 30).collect()) == brute(states, 1, 30) == want
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df.write.parquet(source)
    fires = incremental.fires(incremental.read_new(spark, source, "rule string, at long, failing boolean"), 1, 30)
    fires.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checks")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == want


def test_query_matches_brute_force(spark, sf):
    states = [(r["event_type"], r["event_id"], r["value"] > 40) for r in pq.read_table(f"{sf}/events.parquet").to_pylist()]
    assert sorted(tuple(r) for r in catalog.QUERIES["metric_alerts"](spark, sf).collect()) == brute(states, 2, 30)
