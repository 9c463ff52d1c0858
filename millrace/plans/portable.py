"""Queries whose text both engines understand: one text is plan and oracle, but for those in BETTER."""

from __future__ import annotations

REVENUE = "l_extendedprice * (1 - l_discount)"
SQL: dict[str, str] = {
    # scans, filters, metadata aggregates
    "scan_count": "SELECT count(*) AS n FROM {lineitem}",
    "scan_filtered_count": "SELECT count(*) AS n FROM {events} WHERE user_id <> 7",
    "agg_sum_count_avg": "SELECT round(sum(value), 2) AS s, count(*) AS n, round(avg(user_id), 6) AS a FROM {events}",
    "agg_avg": "SELECT round(avg(l_quantity), 6) AS a FROM {lineitem}",
    "agg_distinct_int": "SELECT count(DISTINCT user_id) AS n FROM {events}",
    "agg_distinct_text": "SELECT count(DISTINCT url) AS n FROM {pages}",
    "agg_min_max": "SELECT cast(min(o_orderdate) AS string) AS lo, cast(max(o_orderdate) AS string) AS hi FROM {orders}",
    "agg_group_lowcard": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 6) AS a FROM {lineitem} WHERE l_linestatus <> 'X' GROUP BY l_returnflag",
    "topk_distinct_users": "SELECT event_type, count(DISTINCT user_id) AS u FROM {events} GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "rollup_one_key": "SELECT user_id, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 6) AS a, count(DISTINCT event_type) AS d FROM {events} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "topk_filtered_distinct": "SELECT source, count(DISTINCT lang) AS u FROM {documents} WHERE source <> '' GROUP BY source ORDER BY u DESC, source LIMIT 10",
    "topk_two_keys_distinct": "SELECT source, lang, count(DISTINCT doc_id) AS u FROM {documents} WHERE lang <> '' GROUP BY source, lang ORDER BY u DESC, source, lang LIMIT 10",
    "topk_text_count": "SELECT url, count(*) AS n FROM {pages} WHERE url <> '' GROUP BY url ORDER BY n DESC, url LIMIT 10",
    "topk_int_text_count": "SELECT user_id, event_type, count(*) AS n FROM {events} GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10",
    "topk_int_count": "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "topk_int_minute_text": "SELECT user_id, cast(extract(minute FROM ts) AS int) AS m, event_type, count(*) AS n FROM {events} GROUP BY user_id, extract(minute FROM ts), event_type ORDER BY n DESC, user_id, m, event_type LIMIT 10",
    "point_lookup": "SELECT user_id, event_id FROM {events} WHERE user_id = 42",
    "like_count": "SELECT count(*) AS n FROM {pages} WHERE url LIKE '%example%'",
    "like_topk": "SELECT source, min(text) AS first_text, count(*) AS n FROM {documents} WHERE text LIKE '%the%' AND source <> '' GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "like_not_like_rollup": "SELECT source, min(lang) AS l, min(n_chars) AS c, count(*) AS n, count(DISTINCT lang) AS d FROM {documents} WHERE text LIKE '%the%' AND text NOT LIKE '%www%' GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "like_underscore": "SELECT count(*) AS n FROM {nation} WHERE n_name LIKE 'N_T%' OR lower(n_name) LIKE '%a_i%' OR n_name NOT LIKE '%A%'",
    "topk_late_materialised": "SELECT event_id, user_id, event_type, value, props FROM {events} WHERE event_type LIKE '%c%' ORDER BY ts, event_id LIMIT 10",
    "topn_by_time": "SELECT event_type FROM {events} WHERE event_type <> '' ORDER BY ts, event_id LIMIT 10",
    "topn_by_text": "SELECT url FROM {pages} WHERE url <> '' ORDER BY url LIMIT 10",
    "topn_time_text": "SELECT event_type, event_id FROM {events} WHERE event_type <> '' ORDER BY ts, event_type, event_id LIMIT 10",
    "having_avg_length": "SELECT source, round(avg(length(text)), 4) AS l, count(*) AS c FROM {documents} WHERE text <> '' GROUP BY source HAVING count(*) > 5 ORDER BY l DESC, source LIMIT 25",
    "group_text_prefix": "SELECT substring(url, 1, 8) AS k, round(avg(length(url)), 4) AS l, count(*) AS c, min(url) AS m FROM {pages} GROUP BY substring(url, 1, 8) HAVING count(*) > 1",
    "wide_sums": "SELECT " + ", ".join(f"cast(sum(l_linenumber + {k}) AS bigint) AS s{k}" for k in range(90)) + " FROM {lineitem}",
    "rollup_two_keys_filtered": "SELECT l_suppkey, l_linenumber, count(*) AS c, round(sum(l_tax), 4) AS t, round(avg(l_quantity), 6) AS a FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY l_suppkey, l_linenumber ORDER BY c DESC, l_suppkey, l_linenumber LIMIT 10",
    "rollup_high_cardinality": "SELECT l_orderkey, l_partkey, count(*) AS c, round(avg(l_quantity), 6) AS a FROM {lineitem} GROUP BY l_orderkey, l_partkey ORDER BY c DESC, l_orderkey, l_partkey LIMIT 10",
    "topk_literal_key": "SELECT 1 AS one, url, count(*) AS c FROM {pages} GROUP BY url ORDER BY c DESC, url LIMIT 10",
    "topk_derived_keys": "SELECT user_id, user_id - 1 AS k1, user_id - 2 AS k2, user_id - 3 AS k3, count(*) AS c FROM {events} GROUP BY user_id, user_id - 1, user_id - 2, user_id - 3 ORDER BY c DESC, user_id LIMIT 10",
    "topk_date_range": "SELECT event_type, count(*) AS v FROM {events} WHERE ts >= timestamp '2024-01-02 00:00:00' AND ts < timestamp '2024-02-01 00:00:00' AND user_id <> 0 GROUP BY event_type ORDER BY v DESC, event_type LIMIT 10",
    "topk_offset": "SELECT user_id, count(*) AS v FROM {events} WHERE value > 1 GROUP BY user_id ORDER BY v DESC, user_id LIMIT 10 OFFSET 20",
    "topk_case_key": "SELECT event_type, CASE WHEN user_id > 50 THEN 'high' ELSE 'low' END AS src, count(*) AS v FROM {events} GROUP BY event_type, CASE WHEN user_id > 50 THEN 'high' ELSE 'low' END ORDER BY v DESC, event_type, src LIMIT 10 OFFSET 2",
    "topk_in_filter": "SELECT l_suppkey, cast(l_shipdate AS string) AS d, count(*) AS v FROM {lineitem} WHERE l_linenumber IN (1, 3, 6) AND l_quantity BETWEEN 5 AND 40 GROUP BY l_suppkey, cast(l_shipdate AS string) ORDER BY v DESC, l_suppkey, d LIMIT 10",
    "group_minute": "SELECT cast(date_trunc('minute', ts) AS string) AS m, count(*) AS v FROM {events} GROUP BY date_trunc('minute', ts) ORDER BY m LIMIT 10 OFFSET 3",
    "predicate_forms": "SELECT count(*) AS n, count(CASE WHEN o_totalprice IS NOT NULL THEN 1 END) AS p, count(nullif(o_orderstatus, 'F')) AS q, cast(sum(greatest(1, o_custkey) - least(1, o_custkey)) AS bigint) AS g FROM {orders} WHERE (o_orderstatus = 'F' OR o_totalprice > 1000) AND coalesce(o_orderpriority, 'x') <> 'x' AND o_orderkey >= o_custkey - 100000 AND o_orderstatus IS DISTINCT FROM 'Z'",
    # joins
    "join_inner": "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT n_name, count(s_suppkey) AS n FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey GROUP BY n_name",
    "join_full": "SELECT coalesce(c.k, s.k) AS k, c.n AS nc, s.n AS ns FROM (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal < 500 GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 500 GROUP BY s_nationkey) s ON c.k = s.k",
    "join_cross_small": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    "join_theta": "SELECT a.n_name AS a, b.n_name AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_semi": "SELECT count(*) AS n FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)",
    "join_anti": "SELECT count(*) AS n FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "join_not_in": "SELECT count(*) AS n FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 100000)",
    "join_lateral": "SELECT c.c_custkey, t.o_orderkey FROM {customer} c, LATERAL (SELECT o_orderkey FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
    "join_dimension_key": "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE p_type LIKE '%A%'",
    "join_decorrelated": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} l WHERE l_quantity < (SELECT 0.5 * avg(x.l_quantity) FROM {lineitem} x WHERE x.l_partkey = l.l_partkey)",
    "join_exclusive_member": "WITH g AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS m, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS f FROM {lineitem} GROUP BY l_orderkey) SELECT l_orderkey, l_suppkey, count(*) AS n FROM {lineitem} JOIN g ON k = l_orderkey WHERE m > 1 AND f = 1 AND l_returnflag = 'R' GROUP BY l_orderkey, l_suppkey",
    "join_visibility": "SELECT d.doc_id FROM {documents} d WHERE d.source IN (SELECT source FROM {documents} WHERE lang = 'fr' AND n_chars > 200) AND NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = d.doc_id AND l.toxic = 1)",
    "having_sum_keys": "SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 150",
    # TPC-H shapes
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= timestamp '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": f"SELECT l_orderkey, round(sum({REVENUE}), 2) AS revenue, cast(o_orderdate AS string) AS d FROM {{customer}}, {{orders}}, {{lineitem}} WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < timestamp '1996-03-15 00:00:00' AND l_shipdate > timestamp '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q4": "SELECT o_orderpriority, count(*) AS n FROM {orders} o WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_shipdate > o.o_orderdate) GROUP BY o_orderpriority",
    "tpch_q5": f"SELECT n_name, round(sum({REVENUE}), 2) AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey IN (1, 2) GROUP BY n_name",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.02 AND 0.08 AND l_quantity < 24",
    "tpch_q7": f"SELECT a.n_name AS supp, b.n_name AS cust, cast(extract(year FROM l_shipdate) AS int) AS y, round(sum({REVENUE}), 2) AS revenue FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} a, {{nation}} b WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = a.n_nationkey AND c_nationkey = b.n_nationkey AND a.n_nationkey IN (3, 6) AND b.n_nationkey IN (3, 6) AND a.n_nationkey <> b.n_nationkey GROUP BY a.n_name, b.n_name, extract(year FROM l_shipdate)",
    "tpch_q8": f"SELECT cast(extract(year FROM o_orderdate) AS int) AS y, round(sum(CASE WHEN s_nationkey = 3 THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS share FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = 1 AND p_size < 25 GROUP BY extract(year FROM o_orderdate)",
    "tpch_q10": f"SELECT c_custkey, c_name, n_name, round(sum({REVENUE}), 2) AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q13": "SELECT n_orders, count(*) AS n FROM (SELECT c_custkey, count(o_orderkey) AS n_orders FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) t GROUP BY n_orders",
    "tpch_q14": f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey",
    "tpch_q15": f"WITH r AS (SELECT l_suppkey AS k, round(sum({REVENUE}), 2) AS total FROM {{lineitem}} GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM {{supplier}} JOIN r ON s_suppkey = k WHERE total = (SELECT max(total) FROM r)",
    "tpch_q17": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS y FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.4 * avg(x.l_quantity) FROM {lineitem} x WHERE x.l_partkey = p.p_partkey)",
    "tpch_q18": "SELECT c_name, c_custkey, o_orderkey, round(sum(l_quantity), 2) AS q FROM {customer}, {orders}, {lineitem} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey",
    "tpch_q19": f"SELECT round(sum({REVENUE}), 2) AS revenue FROM {{lineitem}}, {{part}} WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 11 AND 15 AND l_quantity BETWEEN 20 AND 30))",
    "tpch_q21": "WITH late AS (SELECT l_orderkey, l_suppkey FROM {lineitem} JOIN {orders} ON o_orderkey = l_orderkey WHERE l_shipdate > o_orderdate), g AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS m FROM {lineitem} GROUP BY l_orderkey), f AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS m FROM late GROUP BY l_orderkey) SELECT s_name, count(*) AS n FROM late JOIN g ON g.k = l_orderkey JOIN f ON f.k = l_orderkey JOIN {supplier} ON s_suppkey = l_suppkey WHERE g.m > 1 AND f.m = 1 GROUP BY s_name",
    "tpch_q22": "SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS s FROM {customer} c WHERE c_nationkey IN (1, 3, 5, 7) AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F' AND o_orderpriority LIKE '1%') GROUP BY c_nationkey",
    # windows, sets, grouping sets, recursion
    "window_row_number": "SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS int) AS rn FROM {orders}) t WHERE rn <= 3",
    "window_rank_sum": "SELECT event_id, cast(rank() OVER (PARTITION BY event_type ORDER BY value DESC) AS int) AS r, cast(dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS int) AS d, cast(sum(user_id) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS bigint) AS s FROM {events}",
    "window_lag_ntile": "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after, cast(ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS int) AS q FROM {events}",
    "window_max_over_all": "SELECT user_id, round(n / m, 6) AS share FROM (SELECT user_id, cast(n AS double) AS n, cast(max(n) OVER (PARTITION BY 1) AS double) AS m FROM (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) a) b",
    "distinct_on": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) t WHERE rn = 1",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey AS k FROM {supplier}",
    "set_union_all": "SELECT 'c' AS t, c_nationkey AS k FROM {customer} UNION ALL SELECT 's' AS t, s_nationkey AS k FROM {supplier}",
    "set_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'O'",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'P'",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(grouping(l_returnflag) AS int) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "grouping_cube": "SELECT event_type, user_id % 3 AS b, count(*) AS n FROM {events} GROUP BY CUBE (event_type, user_id % 3)",
    "grouping_rollup": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {customer} GROUP BY ROLLUP (c_mktsegment, c_nationkey)",
    "aggregate_filter": "SELECT source, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE n_chars > 1000) AS big FROM {documents} GROUP BY source",
    "aggregate_bool": "SELECT user_id, bool_and(value > 0) AS a, bool_or(value > 90) AS o, max_by(event_id, value) AS m FROM {events} GROUP BY user_id",
    "aggregate_percentile": "SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95, round(stddev_samp(value), 4) AS sd FROM {events} GROUP BY event_type",
    "recursive_counter": "WITH RECURSIVE t(n, f) AS (SELECT 1 AS n, cast(1 AS bigint) AS f UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t",
}
ORACLE: dict[str, str] = {k: v.replace("{", "").replace("}", "") for k, v in SQL.items()}
#: What the plans run where another form of the text above is less work: sums of shifted values from two aggregates, a
#: maximum as a scalar subquery instead of a window over all rows, and wide rows fetched after their keys are chosen.
#: Spark sorts a lateral subquery before it deals its rows to tasks and numbers them as they arrive; here the window sorts.
BETTER: dict[str, str] = {
    "wide_sums": "SELECT " + ", ".join(f"s + {k} * n AS s{k}" for k in range(90)) + " FROM (SELECT cast(sum(l_linenumber) AS bigint) AS s, count(l_linenumber) AS n FROM {lineitem}) t",
    "window_max_over_all": "WITH a AS (SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id) SELECT user_id, round(cast(n AS double) / (SELECT max(n) FROM a), 6) AS share FROM a",
    "topk_late_materialised": "WITH k AS (SELECT event_id AS i, ts AS t FROM {events} WHERE event_type LIKE '%c%' ORDER BY t, i LIMIT 10) SELECT /*+ BROADCAST(k) */ event_id, user_id, event_type, value, props FROM {events} JOIN k ON event_id = i",
    "join_lateral": "SELECT c_custkey, o_orderkey FROM {customer} JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS r FROM {orders}) o ON o_custkey = c_custkey WHERE r <= 2",
}
