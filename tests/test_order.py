"""Results that may not hang on the order in which rows reach a task."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from millrace import catalog
from millrace.sources.tables import placed


def test_lateral_join_numbers_rows_in_a_window_that_sorts(spark, sf):
    plan = catalog.QUERIES["join_lateral"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    window = next(line for line in plan.splitlines() if "windowspecdefinition" in line)
    assert "o_totalprice" in window and "DESC" in window and "o_orderkey" in window.split("windowspecdefinition")[1]
    assert "Sort [o_totalprice" not in plan


def written(path, rows):
    columns = {c: pa.array(v, t) for c, v, t in zip(("event_id", "user_id", "value"), zip(*rows), (pa.int64(), pa.int64(), pa.float64()))}
    pq.write_table(pa.table(columns), path)


def test_of_a_users_highest_events_the_first_in_the_table_is_taken(spark, tmp_path):
    rows = [(7, 1, 5.0), (3, 1, 5.0), (9, 1, 5.0), (4, 2, None), (None, 2, 99.0), (6, 2, 1.0), (2, 3, -0.0), (5, 3, 0.0), (8, 4, None)]
    written(tmp_path / "events.parquet", rows)
    got = catalog.QUERIES["aggregate_bool"](spark, str(tmp_path))
    assert got.columns == ["user_id", "a", "o", "m"]
    want = [(1, True, False, 7), (2, True, True, 6), (3, False, False, 2), (4, None, None, None)]
    assert sorted(tuple(r) for r in got.collect()) == want
    text = catalog.ORACLE["aggregate_bool"].replace("events", f"'{tmp_path}/events.parquet'")
    assert duckdb.sql(f"SELECT * FROM ({text}) ORDER BY user_id").fetchall() == want


def test_rows_of_several_files_are_placed_by_path(spark, tmp_path):
    (tmp_path / "events.parquet").mkdir()
    for name, ids in (("b", [1, 8]), ("a b", [6, 5]), ("c", [4])):
        written(tmp_path / "events.parquet" / f"{name}.parquet", [(i, 1, 5.0) for i in ids])
    assert [r.event_id for r in placed(spark, str(tmp_path), "events").orderBy("place").collect()] == [6, 5, 1, 8, 4]
    assert catalog.QUERIES["aggregate_bool"](spark, str(tmp_path)).first().m == 6


def test_a_mean_at_its_threshold_is_summed_in_the_order_of_the_table(spark, tmp_path):
    (tmp_path / "lineitem.parquet").mkdir()
    parts = [(1, [0.05] * 5), (None, [0.05] * 5), (2, [0.01, None]), (3, [None]), (4, [float("nan")]), (5, [0.0499995])]
    for name in ("a", "b"):  # 0.05 is added up to less than 0.5 in one sum of ten, to 0.5 in two of five
        rows = [(k, x) for k, xs in parts for x in xs]
        table = pa.table({"l_suppkey": pa.array([k for k, _ in rows], pa.int64()), "l_discount": pa.array([x for _, x in rows], pa.float64())})
        pq.write_table(table, tmp_path / "lineitem.parquet" / f"{name}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute("SELECT l_suppkey, d, breach, status, x FROM (" + catalog.ORACLE["metric_check"] + ")").fetchall()
    got = [tuple(r) for r in catalog.QUERIES["metric_check"](spark, str(tmp_path)).select("l_suppkey", "d", "breach", "status", "x").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert (1, 0.05, True, "fail", False) in got and (None, 0.05, True, "fail", False) in got
