from collections import defaultdict

import pyarrow.parquet as pq

from millrace import catalog


def test_lateral_join_is_of_all_customers(spark, sf):
    orders = defaultdict(list)
    for r in pq.read_table(f"{sf}/orders.parquet").to_pylist():
        orders[r["o_custkey"]].append((-r["o_totalprice"], r["o_orderkey"]))
    keys = [r["c_custkey"] for r in pq.read_table(f"{sf}/customer.parquet").to_pylist()]
    want = sorted((k, o) for k in keys for _, o in sorted(orders[k])[:2])
    assert max(k for k, _ in want) > 100
    assert sorted(tuple(r) for r in catalog.QUERIES["join_lateral"](spark, sf).collect()) == want


def test_cross_join_is_of_all_nations(spark, sf):
    regions, nations = (pq.read_table(f"{sf}/{t}.parquet").column(c).to_pylist() for t, c in (("region", "r_name"), ("nation", "n_name")))
    assert sorted(tuple(r) for r in catalog.QUERIES["join_cross_small"](spark, sf).collect()) == sorted((r, n) for r in regions for n in nations)
