"""Queries of stored tables, search, semantic functions, cubes, models, graphs and streams, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import tokens
from ..operators import cubes, documents, graph, lifecycle, metrics, models, quality, relational, search, semantic, shared, timetravel, vector
from ..sources import remote, tables
from ..sources.tables import load
from ..streaming import incremental
from . import flow
from .analytics import _COS, _EDGES, _FIRES, _YES, _edges, _one, _vectors

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: One text for both engines.
PORTABLE: dict[str, str] = {
    "agg_key_set": "SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_quantity > 49",
    "topk_nulls_first": "SELECT x, event_id FROM (SELECT nullif(event_type, 'click') AS x, event_id FROM {events}) t ORDER BY x NULLS FIRST, event_id LIMIT 15",
    "topk_nulls_last": "SELECT x, event_id FROM (SELECT nullif(event_type, 'view') AS x, event_id FROM {events}) t ORDER BY x DESC NULLS LAST, event_id DESC LIMIT 15",
    "predicate_distinct_from": "SELECT count(*) AS n FROM {orders} WHERE nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O' AND nullif(o_orderstatus, 'P') IS NOT DISTINCT FROM o_orderstatus",
    "group_key_text_cast": "SELECT cast(o_custkey AS string) AS k, count(*) AS n FROM {orders} GROUP BY cast(o_custkey AS string) HAVING count(*) > 12",
}
PORTABLE_ORACLE: dict[str, str] = {k: v.replace("{", "").replace("}", "") for k, v in PORTABLE.items()}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- Scans, sources, stored tables ---------------------------------------------------------------------


@query("SELECT count(*) AS n FROM pages WHERE regexp_matches(url, '^https://[a-z]+[.][a-z]+[.]example') AND NOT regexp_matches(url, '[?]')")
def predicate_regex(spark, sf):
    u = F.col("url")
    return load(spark, sf, "pages").filter(u.rlike("^https://[a-z]+[.][a-z]+[.]example") & ~u.rlike("[?]")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM pages WHERE url ILIKE '%EXAMPLE.COM%' AND url NOT ILIKE '%BLOG%'")
def predicate_ilike(spark, sf):
    return load(spark, sf, "pages").filter(F.col("url").ilike("%EXAMPLE.COM%") & ~F.col("url").ilike("%BLOG%")).agg(F.count("*").alias("n"))


@query("SELECT least(7, count(*)) AS n, true AS right_counts FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2)")
def any_groups(spark, sf):
    e = load(spark, sf, "events")
    some = relational.any_groups(e, ["user_id", "event_type"], 7).withColumnRenamed("count", "c")
    every = e.groupBy("user_id", "event_type").agg(F.count("*").alias("d"))
    return some.join(every, ["user_id", "event_type"]).agg(F.count("*").alias("n"), F.every(F.col("c") == F.col("d")).alias("right_counts"))


@query("SELECT true AS near_a_fifth")
def scan_sample(spark, sf):
    rows = load(spark, sf, "lineitem")
    return rows.sample(0.2, seed=7).agg((F.abs(F.count("*") / F.lit(rows.count()) - 0.2) < 0.05).alias("near_a_fifth"))


@query("SELECT count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS s, round(sum(p_retailprice), 2) AS r FROM part")
def source_full_export(spark, sf):
    path = shared.scratch(spark, "export")
    tables.export(load(spark, sf, "part"), path, bloom=["p_partkey"])
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("p_partkey").alias("s"), F.round(F.sum("p_retailprice"), 2).alias("r"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_orderstatus")
def source_partitioned(spark, sf):
    path = shared.scratch(spark, "partitioned")
    tables.export(load(spark, sf, "orders"), path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).filter("o_orderstatus <> 'P'").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '1995-09-01'")
def source_clustered(spark, sf):
    path = shared.scratch(spark, "clustered")
    tables.export(load(spark, sf, "lineitem"), path, cluster_by=["l_shipdate"])
    return spark.read.parquet(path).filter("l_shipdate >= timestamp '1995-06-01' and l_shipdate < timestamp '1995-09-01'").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS status, CAST(NULL AS BIGINT) AS later FROM orders")
def source_import(spark, sf):
    o, path = load(spark, sf, "orders").withColumnRenamed("o_orderkey", "k"), shared.scratch(spark, "import")
    o.filter("k % 2 = 0").selectExpr("k", "o_totalprice as price").write.parquet(f"{path}/a")
    o.filter("k % 2 = 1").selectExpr("k", "o_orderstatus as status").write.parquet(f"{path}/b")
    return tables.import_files(spark, [f"{path}/a", f"{path}/b"], "k long, price double, status string, later long")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def source_csv(spark, sf):
    path = shared.scratch(spark, "csv")
    load(spark, sf, "nation").write.csv(path, header=True)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT n_name || chr(10) AS text FROM nation")
def source_folder(spark, sf):
    path = shared.scratch(spark, "folder")
    load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("value")).write.partitionBy("k").text(path)
    return tables.ingest_folder(spark, f"{path}/*").select("text")


@query("SELECT count(*) AS n_rows, true AS sized FROM lineitem")
def source_layout(spark, sf):
    return lifecycle.file_layout(load(spark, sf, "lineitem")).agg(F.sum("n_rows").alias("n_rows"), (F.min("bytes") > 0).alias("sized"))


@query("SELECT n_nationkey AS ordinal, n_name FROM nation WHERE n_nationkey IN (2, 3, 17)")
def source_selected_rows(spark, sf):
    path = shared.scratch(spark, "ordered")
    load(spark, sf, "nation").orderBy("n_nationkey").coalesce(1).write.parquet(path)
    return tables.selected_rows(spark, path, [2, 3, 17, 99], ["n_name"])


@query("SELECT change, count(*) AS n FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN 'removed' WHEN n_nationkey % 5 = 1 THEN 'changed' WHEN n_nationkey % 5 = 2 THEN 'added' ELSE 'same' END AS change FROM nation) GROUP BY change")
def source_manifest(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("/"), "n_name").alias("path"), F.col("n_name").alias("text"))
    old = n.filter("k % 5 <> 2")
    new = n.filter("k % 5 <> 0").withColumn("text", F.when(F.col("k") % 5 == 1, F.upper(F.concat("text", F.lit("!")))).otherwise(F.col("text")))
    return documents.changes(documents.manifest(old), documents.manifest(new)).groupBy("change").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(length(CASE WHEN n_nationkey % 5 = 1 THEN n_name || '!' ELSE n_name END)) AS BIGINT) AS size FROM nation WHERE n_nationkey % 5 <> 0")
def source_folder_sync(spark, sf):
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("/"), "n_name").alias("path"), F.col("n_name").alias("text"))
    new = n.filter("k % 5 <> 0").withColumn("text", F.when(F.col("k") % 5 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return documents.synced(n.filter("k % 5 <> 2").select("path", "text"), new).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("size"))


@query("SELECT n_nationkey AS k, n_nationkey * 2 AS twice FROM nation UNION ALL SELECT n_nationkey, n_nationkey * 2 + 1 FROM nation")
def source_remote_rows(spark, sf):
    n = load(spark, sf, "nation").select(F.to_json(F.struct(F.col("n_nationkey").alias("k"))).alias("arguments"))
    rows = remote.rows(n, "arguments", remote.StubServer(), "pair")
    return rows.select(F.get_json_object("row", "$.k").cast("int").alias("k"), F.get_json_object("row", "$.twice").cast("int").alias("twice"))


@query("SELECT count(*) AS n, count(o_orderstatus) AS n_status, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderkey % 3 = 0")
def source_sync(spark, sf):
    o = load(spark, sf, "orders")
    store = lifecycle.Store(spark, shared.scratch(spark, "synced"), "o_orderkey")
    lifecycle.sync_table(o.select("o_orderkey", F.col("o_totalprice").alias("o_totalprice")), store)
    lifecycle.sync_table(o.filter("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus"), store)
    return store.snapshot().agg(F.count("*").alias("n"), F.count("o_orderstatus").alias("n_status"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query("SELECT * FROM (VALUES ('o_orderkey', 'keep'), ('o_totalprice', 'cast'), ('o_orderstatus', 'add'), ('o_custkey', 'null')) t(column_name, action)")
def source_sync_plan(spark, sf):
    o = load(spark, sf, "orders")
    store = lifecycle.Store(spark, shared.scratch(spark, "planned"), "o_orderkey")
    lifecycle.sync_table(o.select("o_orderkey", "o_totalprice", "o_custkey"), store)
    _, plan = lifecycle.sync_table(o.select("o_orderkey", F.col("o_totalprice").cast("string").alias("o_totalprice"), "o_orderstatus"), store, dry_run=True)
    return spark.createDataFrame([(c, a) for c, _, a in plan], "column_name string, action string")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, 1 AS generations, 0 AS tombstones FROM orders WHERE o_orderkey % 7 <> 0")
def table_rebuild(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    store = lifecycle.Store(spark, shared.scratch(spark, "store"), "o_orderkey")
    for i in range(3):
        store.append(o.filter(F.col("o_orderkey") % 3 == i))
    store.delete(o.filter("o_orderkey % 7 = 0"))
    new = store.rebuild()
    s = new.statistics()
    return new.table().agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), F.lit(s["generations"]).alias("generations"), F.lit(s["tombstones"]).alias("tombstones"))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders")
def table_refresh(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    store = lifecycle.Store(spark, shared.scratch(spark, "refreshed"), "o_orderkey")
    store.append(o.filter("o_orderkey % 4 <> 0"))
    stores = {"orders": store}
    done = lifecycle.run_tick(stores, {"orders": o}, {"orders": {"full_ratio": 0.9}}, budget=1)
    if done != [("orders", "delta")]:
        raise AssertionError(done)
    return stores["orders"].table().agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


_TICK = "SELECT o_orderpriority AS name, count(*) AS files, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS tombstones, bool_or(o_totalprice > 300000) AS dirty, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS drift_rows, count(*) AS n, max(o_custkey) % 5 AS scans FROM orders GROUP BY 1"


@query(f"WITH t AS ({_TICK}), a AS (SELECT name, CASE WHEN files >= 3050 OR tombstones >= 1e9 THEN 'full' WHEN NOT dirty THEN 'skip' WHEN drift_rows / n >= 0.34 THEN 'full' ELSE 'delta' END AS action, CASE WHEN files >= 3050 THEN 'file fanout' WHEN NOT dirty THEN 'clean' WHEN drift_rows / n >= 0.34 THEN 'drift' ELSE 'dirty' END AS reason, CAST(drift_rows * (1 + scans) AS BIGINT) AS priority FROM t), r AS (SELECT name, row_number() OVER (ORDER BY priority DESC, name) AS r FROM a WHERE action <> 'skip') SELECT a.*, coalesce(r <= 2, false) AS acts FROM a LEFT JOIN r USING (name)")
def table_tick(spark, sf):
    g = load(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name"))
    t = g.agg(F.count("*").alias("files"), F.count_if(F.col("o_orderstatus") == "P").alias("tombstones"), F.bool_or(F.col("o_totalprice") > 300000).alias("dirty"), F.count_if(F.col("o_orderstatus") == "F").alias("drift_rows"), F.count("*").alias("rows"), (F.max("o_custkey") % 5).alias("scans"))
    t = t.withColumns({"max_files": F.lit(3050), "max_tombstones": F.lit(10**9), "full_ratio": F.lit(0.34)})
    return lifecycle.actions(t, budget=2)


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s, 'orders' AS held FROM orders")
def table_hot(spark, sf):
    hot = lifecycle.HotTables(1 << 40)
    hot.load("lineitem", load(spark, sf, "lineitem"), ["l_orderkey"])
    df = hot.load("orders", load(spark, sf, "orders"), ["o_custkey"])
    hot.evict("lineitem")
    held = ",".join(n for n, _ in hot.status())
    out = spark.createDataFrame([df.agg(F.count("*"), F.sum("o_custkey")).first()], "n long, s long").withColumn("held", F.lit(held))
    hot.evict("orders")
    return out


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')")
def bitmap_values(spark, sf):
    maps = lifecycle.value_bitmaps(load(spark, sf, "orders"), "o_orderkey", "o_orderstatus")
    return lifecycle.bitmap_count(maps, F.col("value").isin("F", "P"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey % 4 IN (1, 2)")
def source_range_export(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    store, path = lifecycle.Store(spark, shared.scratch(spark, "ranges"), "o_orderkey"), shared.scratch(spark, "exported")
    for i in range(4):
        store.append(o.filter(F.col("o_orderkey") % 4 == i))
    tables.export(store.between(1, 3), path)
    return spark.read.parquet(path).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT true AS same_passes, false AS changed_passes")
def source_gate(spark, sf):
    n = load(spark, sf, "nation")
    seen = tables.schema_fingerprint(n)

    def passes(df):
        try:
            tables.gated(df, seen)
            return True
        except ValueError:
            return False

    return spark.createDataFrame([(passes(n.limit(3)), passes(n.withColumn("n_name", F.lit(1))))], "same_passes boolean, changed_passes boolean")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def bitmap_select(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    maps = quality.PredicateBitmaps(spark, shared.scratch(spark, "bitmaps"))
    done = [maps.populate(o, "o_orderkey", p, "large", v) for p, v in (("o_totalprice > 150000", "1"), ("o_totalprice > 1", "1"), ("o_totalprice > 1", "2"))]
    if done != [True, False, True] or not maps.drop("large", "2") or maps.drop("large", "2"):
        raise AssertionError(done)
    return maps.select(o, "o_orderkey", "large", "1")


@query("SELECT 'dear' AS name, '1' AS version, count(*) FILTER (WHERE o_totalprice > 200000) AS n FROM orders UNION ALL SELECT 'open', '1', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders")
def bitmap_stats(spark, sf):
    maps = quality.PredicateBitmaps(spark, shared.scratch(spark, "bitmaps"))
    for name, p in (("dear", "o_totalprice > 200000"), ("open", "o_orderstatus = 'O'")):
        maps.populate(load(spark, sf, "orders"), "o_orderkey", p, name, "1")
    return maps.stats()


@query("SELECT * FROM (VALUES ('documents', 'document_id', 'texts', 'declared'), ('labels', 'document_id', 'document', 'inferred'), ('pages', 'page_id', 'page', 'inferred')) t(table_name, column_name, to_table, source)")
def quality_all_keys(spark, sf):
    columns = spark.createDataFrame([("documents", "document_id"), ("labels", "document_id"), ("pages", "page_id"), ("document", "id"), ("page", "id")], "table_name string, column_name string")
    return quality.all_keys(columns, spark.createDataFrame([("documents", "document_id", "texts")], "table_name string, column_name string, to_table string"))


@query(f"SELECT CAST(b.vec_id AS VARCHAR) AS name, a.vec_id AS node_id, round({_COS}, 6) AS similarity FROM embeddings a, embeddings b WHERE b.vec_id IN (2, 9) AND {_COS} >= 0.25 QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COS} DESC, a.vec_id) <= 10")
def graph_resolve_near(spark, sf):
    v = _vectors(spark, sf)
    names = v.filter("id in (2, 9)").select(F.col("id").cast("string").alias("name"), "v")
    return graph.resolve_near(v.select(F.col("id").alias("node_id"), "v"), names, 0.25).withColumn("similarity", F.round("similarity", 6))


@query("SELECT g AS generation, count(*) AS n FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS g FROM orders) WHERE NOT (g < 1996) OR g = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY g")
def time_retention(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("generation"))
    generations = rows.select("generation").distinct().withColumn("time", F.make_timestamp("generation", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    return lifecycle.retained(rows, generations, "1997-01-01", 1996)[0].groupBy("generation").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, max(y) AS newest FROM (SELECT year(o_orderdate) AS y FROM orders WHERE year(o_orderdate) <= year(TIMESTAMP '1996-07-01'))")
def time_as_of_timestamp(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("generation"))
    generations = rows.select("generation").distinct().withColumn("time", F.make_timestamp("generation", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    g = timetravel.generation_at(generations, "1996-07-01")
    none = spark.createDataFrame([], "o_orderkey long, generation long")
    return timetravel.as_of(rows, none, "o_orderkey", g).agg(F.count("*").alias("n"), F.max("generation").alias("newest"))


@query("SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents WHERE lang = 'fr') AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def access_roles(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "lang")
    roles = d.filter("lang = 'fr'").select(F.lit("ann").alias("caller"), "source")
    hidden = load(spark, sf, "labels").filter("toxic = 1").select(F.lit("ann").alias("caller"), "doc_id")
    seen = relational.visible(d, roles, hidden, "ann", "doc_id", "source").select("doc_id")
    return seen.unionByName(relational.visible(d, roles, hidden, None, "doc_id", "source").select("doc_id"))


# --- Text, tokens, search ------------------------------------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(text, '\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]')) AS n FROM documents WHERE lang = 'en' AND regexp_matches(text, '^[A-Za-z0-9 .,]*$')")
def text_token_estimate(spark, sf):
    d = load(spark, sf, "documents").filter(F.col("lang") == "en").filter(F.col("text").rlike("^[A-Za-z0-9 .,]*$"))
    return d.select("doc_id", tokens.token_count(F.regexp_replace("text", "([.,])", "$1 ")).alias("n"))


@query("SELECT n_nationkey, sha256(length(n_name) || ':' || n_name || '|' || length(CAST(n_regionkey AS VARCHAR)) || ':' || n_regionkey || '|-') AS id FROM nation")
def text_content_id(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", tokens.content_id(F.col("n_name"), F.col("n_regionkey"), F.lit(None)).alias("id"))


@query("SELECT event_id, try_cast(nullif(regexp_extract(props, '-?[0-9]+', 0), '') AS BIGINT) AS number, least(greatest(try_cast(nullif(regexp_extract(props, '-?[0-9]+(?:\\.[0-9]+)?', 0), '') AS DOUBLE), 0.0), 1.0) AS score, regexp_matches(upper(ltrim(event_type)), '^(YES|TRUE|1)') AS yes FROM events")
def text_parsers_events(spark, sf):
    p = F.col("props")
    return load(spark, sf, "events").select("event_id", T.extract_int(p).alias("number"), T.score_0_1(p).alias("score"), T.yes_no(F.col("event_type")).alias("yes"))


@query("SELECT p_partkey, i - 1 AS place, w AS word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def array_ordinality(spark, sf):
    return load(spark, sf, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("place", "word"))


_SEARCH = "SELECT value, 2.0 * CAST(contains(lower(value), 'widget') AS INTEGER) + 0.1 * len(list_filter(regexp_split_to_array(lower(value), '[^\\p{L}\\p{N}]+'), lambda x: x = 'widget')) AS score FROM (SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL)"


@query(f"SELECT value, round(score, 6) AS score FROM ({_SEARCH}) WHERE score > 0 ORDER BY score DESC, value LIMIT 12")
def search_lexical_values(spark, sf):
    return search.lexical_knn(load(spark, sf, "part"), "p_name", "widget", 12).select("value", F.round("score", 6).alias("score"))


def _named_vectors(spark, sf):
    """(text, v): the names of parts with the vectors of equal number."""
    v = _vectors(spark, sf)
    return load(spark, sf, "part").join(v, F.col("p_partkey") == F.col("id")).select(F.concat("p_name", F.lit(" "), "p_brand").alias("text"), F.col("v").cast("array<double>").alias("v"))


_TEXTS = "SELECT p_name || ' ' || p_brand AS value, min(CAST(embedding AS DOUBLE[])) AS v FROM part JOIN embeddings ON p_partkey = vec_id GROUP BY 1"
_KNN = f"SELECT value, list_cosine_similarity(v, (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 3)) AS score FROM ({_TEXTS})"


@query(f"SELECT value, round(score, 6) AS score FROM ({_KNN}) k ORDER BY k.score DESC, value LIMIT 10")
def search_knn_text(spark, sf):
    return search.knn_text(_named_vectors(spark, sf), _one(spark, sf, 3), 10).select("value", F.round("score", 6).alias("score"))


_LEXICAL = f"SELECT value, 2.0 * CAST(contains(value, 'red') AS INTEGER) + 0.1 * len(list_filter(string_split(lower(value), ' '), lambda x: x = 'red')) AS score FROM ({_TEXTS}) WHERE contains(value, 'red')"


@query(f"WITH d AS (SELECT value, score, row_number() OVER (ORDER BY score DESC, value) AS r FROM ({_KNN}) ORDER BY r LIMIT 50), l AS (SELECT value, score, row_number() OVER (ORDER BY score DESC, value) AS r FROM ({_LEXICAL}) ORDER BY r LIMIT 50), f AS (SELECT coalesce(d.value, l.value) AS value, coalesce(d.score, 0) AS ds, coalesce(l.score, 0) AS ls, coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + l.r), 0) AS fused FROM (SELECT * FROM d WHERE score >= 0) d FULL JOIN l ON d.value = l.value) SELECT value, round(ds, 6) AS dense_score, round(ls, 6) AS lex_score, round(fused, 8) AS fused_score FROM f ORDER BY fused DESC, ls DESC, value LIMIT 10")
def search_hybrid_values(spark, sf):
    v = _named_vectors(spark, sf)
    dense = search.knn_text(v, _one(spark, sf, 3), 50)
    found = search.hybrid_search(dense, search.lexical_knn(v, "text", "red", 50), 10)
    return found.select("value", F.round("dense_score", 6).alias("dense_score"), F.round("lex_score", 6).alias("lex_score"), F.round("fused_score", 8).alias("fused_score"))


@query("SELECT 'stub' AS specialist, count(DISTINCT p_type) AS entries, CAST(sum(DISTINCT length(p_type)) * 0 + (SELECT sum(length(t)) FROM (SELECT DISTINCT p_type AS t FROM part)) AS BIGINT) AS characters, 128 AS dimensions, 0 AS again FROM part")
def search_embedding_cache(spark, sf):
    cache = search.EmbeddingCache(spark, shared.scratch(spark, "embeddings"))
    part = load(spark, sf, "part")
    cache.materialize(part, "p_type", semantic.embed_batch, "stub")
    again = cache.materialize(part, "p_type", semantic.embed_batch, "stub")
    cache.materialize(part, "p_brand", semantic.embed_batch, "other")
    cache.purge("other")
    return cache.stats().withColumn("again", F.lit(again))


_TURNS = "SELECT conv_id, CAST(turn AS BIGINT) AS chunk, text FROM conversations WHERE text IS NOT NULL"


@query(f"WITH p AS ({_TURNS}), f AS (SELECT conv_id, chunk, 0.1 * len(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x = 'that')) + 2.0 * CAST(contains(lower(text), 'that') AS INTEGER) AS score FROM p) SELECT conv_id, chunk, round(score, 6) AS score FROM f WHERE score > 0 ORDER BY f.score DESC, conv_id, chunk LIMIT 20")
def documents_find(spark, sf):
    pieces = load(spark, sf, "conversations").filter("text is not null").select("conv_id", F.col("turn").alias("chunk"), "text")
    return documents.find(pieces, "conv_id", "that", 20).withColumn("score", F.round("score", 6))


@query(f"WITH p AS ({_TURNS}), f AS (SELECT conv_id, chunk FROM p WHERE chunk % 4 = 1 AND contains(lower(text), 'that')), s AS (SELECT conv_id, greatest(chunk - 1, 0) AS a, chunk + 1 AS b FROM f), g AS (SELECT *, sum(CASE WHEN a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY a) AS g FROM (SELECT *, max(b) OVER (PARTITION BY conv_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s)), w AS (SELECT conv_id, min(a) AS a, max(b) AS b FROM g GROUP BY conv_id, g) SELECT w.conv_id, a AS first, max(p.chunk) AS last, CAST(sum(length(p.text) + 2) - 2 AS BIGINT) AS size FROM w JOIN p ON p.conv_id = w.conv_id AND p.chunk BETWEEN a AND b GROUP BY w.conv_id, a")
def documents_windows(spark, sf):
    pieces = load(spark, sf, "conversations").filter("text is not null").select("conv_id", F.col("turn").alias("chunk"), "text")
    found = pieces.filter("chunk % 4 = 1").filter(F.contains(F.lower("text"), F.lit("that"))).select("conv_id", "chunk", F.lit(1.0).alias("score"))
    return documents.windows(pieces, "conv_id", found).select("conv_id", "first", "last", F.length("text").cast("long").alias("size"))


@query(f"SELECT a.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 5 ORDER BY {_COS} DESC, a.vec_id LIMIT 10")
def search_coarse_index(spark, sf):
    index = search.CoarseIndex(_vectors(spark, sf), shared.scratch(spark, "cells"), n=8)
    return index.search(_one(spark, sf, 5), 10, probes=8).select("id", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.42), r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), g AS (SELECT n, min(c) AS g FROM r GROUP BY n), t AS (SELECT g, n, p_name || repeat('!', CAST(p_partkey % 7 AS INTEGER)) AS text FROM g JOIN part ON p_partkey = n) SELECT n AS id, g AS group_id, first_value(text) OVER (PARTITION BY g ORDER BY strlen(text) DESC, text) AS representative FROM t QUALIFY count(*) OVER (PARTITION BY g) > 1")
def vector_text_groups(spark, sf):
    v = _vectors(spark, sf).join(load(spark, sf, "part"), F.col("p_partkey") == F.col("id"))
    text = F.concat("p_name", F.repeat(F.lit("!"), (F.col("p_partkey") % 7).cast("int")))
    groups = vector.text_groups(v.select("id", text.alias("text"), "v"), 0.42)
    return groups.join(groups.groupBy("group_id").count().filter("count > 1").select("group_id"), "group_id", "left_semi").select("id", "group_id", "representative")


@query(f"SELECT a.vec_id AS id, round(1 - {_COS}, 6) AS distance FROM embeddings a, embeddings b WHERE b.vec_id = 4 ORDER BY 1 - {_COS} DESC, a.vec_id LIMIT 8")
def vector_outliers_from(spark, sf):
    return vector.most_isolated(_vectors(spark, sf), 8, _one(spark, sf, 4)).select("id", F.round("distance", 6).alias("distance"))


@query("SELECT true AS within_five_percent, count(DISTINCT o_orderkey) >= 1024 AS many FROM orders")
def sketch_many_values(spark, sf):
    rows = load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    n, exact = quality.approx_distinct(rows, "k").first().n, rows.distinct().count()
    return spark.createDataFrame([(abs(n - exact) <= 0.05 * exact, exact >= 1024)], "within_five_percent boolean, many boolean")


# --- Semantic functions --------------------------------------------------------------------------------

_MEANS = "'Does the text meet the criterion? Answer YES or NO.' || chr(10) || 'Criterion: trade' || chr(10) || 'Text: ' || p_type"


@query(f"SELECT p_partkey, ({_YES.format(_MEANS)}) = 1 AS answer FROM part")
def semantic_seeded(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", "p_type")
    out = semantic.apply(part, "p_type", semantic.seeded("means"), semantic.StubProvider(), "said", arguments={"criterion": "trade"})
    return out.select("p_partkey", T.yes_no(F.col("said")).alias("answer"))


@query(f"SELECT p_brand, count(*) AS n FROM part WHERE ({_YES.format(_MEANS)}) = 1 GROUP BY p_brand")
def semantic_sql_function(spark, sf):
    semantic.register_seeded(spark, semantic.StubProvider(), "mr_")
    return spark.sql("SELECT p_brand, count(*) AS n FROM {part} WHERE mr_means(p_type, 'trade') GROUP BY p_brand", part=load(spark, sf, "part"))


class _Echo:
    """A provider that gives the text of the prompt back, as a list of its words."""

    model = "echo"

    def __call__(self, prompts):
        return [p.rpartition("Text: ")[2].replace(" ", ", ") for p in prompts]


@query("SELECT p_partkey, w AS label, i - 1 AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)")
def semantic_table_function(spark, sf):
    semantic.register_rows(spark, "mr_tags_of", semantic.seeded("tags"), _Echo())
    return spark.sql("SELECT p.p_partkey, t.label, t.place FROM {part} p, LATERAL mr_tags_of(p.p_name) t", part=load(spark, sf, "part"))


class _Longest:
    """A provider that answers with the first of the longest strings of a JSON list."""

    model = "longest"

    def __call__(self, prompts):
        return [max(json.loads(p), key=lambda s: (len(s), [-ord(c) for c in s])) for p in prompts]


@query("SELECT p_brand, first(p_type ORDER BY length(p_type) DESC, p_type) AS answer FROM part GROUP BY p_brand")
def semantic_aggregate_function(spark, sf):
    semantic.register_aggregate(spark, "mr_longest", semantic.Operator("longest", "{{ text }}"), _Longest())
    return spark.sql("SELECT p_brand, mr_longest(p_type) AS answer FROM {part} GROUP BY p_brand", part=load(spark, sf, "part"))


class _Count:
    """A provider that adds up what a JSON list names: numbers after a colon count as themselves, others as one."""

    model = "count"

    def __call__(self, prompts):
        return [str(sum(int(s.rpartition(": ")[2]) if ": " in s else 1 for s in json.loads(p))) for p in prompts]


@query("SELECT o_orderstatus, CAST(count(DISTINCT o_orderkey) AS VARCHAR) AS answer FROM orders GROUP BY o_orderstatus")
def semantic_aggregate_large(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderstatus", F.col("o_orderkey").cast("string").alias("k"))
    return semantic.aggregate(rows, "o_orderstatus", "k", semantic.Operator("count", "{{ text }}"), _Count(), limit=100)


@query("SELECT n_nationkey, upper(n_name) || '/' || length(n_name) || '/' || (length(n_name) * 2) AS answer FROM nation")
def semantic_steps(spark, sf):
    steps = semantic.Steps("measure", [("big", "code", "upper"), ("size", "python", _size), ("twice", "tool", ("double", '{"n": {{ steps.size.output }}}')), ("all", "sql", "SELECT :big || '/' || :size || '/' || :twice")], tools={"double": _double})
    return semantic.apply(load(spark, sf, "nation").select("n_nationkey", "n_name"), "n_name", steps, semantic.StubProvider(), "answer").select("n_nationkey", "answer")


def _size(inputs, outputs):
    return str(len(outputs["big"]))


def _double(arguments):
    return str(2 * arguments["n"])


@query("SELECT 'headline' AS operator, 3 * count(*) AS calls, 3 * CAST(sum(length(t) + 37) AS BIGINT) AS characters, round(3 * sum(length(t) + 37) / 1000.0 * 0.5, 6) AS cost FROM (SELECT DISTINCT p_type AS t FROM part)")
def semantic_receipts(spark, sf):
    op = semantic.seeded("headline")
    return semantic.receipts(load(spark, sf, "part"), "p_type", op, semantic.StubProvider(), 0.5).withColumn("cost", F.round("cost", 6))


@query("SELECT * FROM (VALUES ('one', true), ('most', true), ('least', false), ('like', true), ('broken', false)) t(name, passed)")
def semantic_self_tests(spark, sf):
    return semantic.self_tests(spark, [("one", "SELECT 1 + 1", "exact", 2), ("most", "SELECT 0.5", "max", 1), ("least", "SELECT 0", "min", 1), ("like", "SELECT 'abc'", "regex", "^a"), ("broken", "SELECT nothing", "exact", 1)])


@query("SELECT n_nationkey, reverse(n_name) || ':' || n_regionkey AS x FROM nation")
def semantic_handler(spark, sf):
    semantic.register_handler(spark, "mr_back", "def back(name, region):\n    return name[::-1] + ':' + str(region)\n", "back")
    return spark.sql("SELECT n_nationkey, mr_back(n_name, n_regionkey) AS x FROM {nation}", nation=load(spark, sf, "nation"))


@query(f"SELECT p_type, CASE WHEN {_YES.format(_MEANS)} = 1 THEN 'yes' ELSE 'no' END AS answer FROM (SELECT DISTINCT p_type FROM part)")
def semantic_cache(spark, sf):
    part, op, where = load(spark, sf, "part"), semantic.seeded("means"), {"arguments": {"criterion": "trade"}}
    half = shared.cut(semantic.answered(part.filter("p_partkey % 2 = 0"), "p_type", op, semantic.StubProvider(), **where))
    return semantic.answered(part, "p_type", op, semantic.StubProvider(), cache=half, **where).select(F.col("text").alias("p_type"), "answer")


# --- Metrics, cubes, quality ---------------------------------------------------------------------------


def _observed(spark, sf):
    m = metrics.Metrics()
    m.define("orders", "SELECT count(*) FROM {orders} WHERE o_orderstatus = {status}", "2020-01-01")
    m.define("orders", "SELECT count(*) FROM {orders}", "2022-01-01")
    m.define("double", "SELECT 2 * x.* FROM {metric:orders} AS x", "2020-01-01")
    o = metrics.Observations(spark, shared.scratch(spark, "observed"), m)
    for name, at in (("orders", "2021-01-01"), ("orders", "2022-06-01"), ("orders", "2023-01-01")):
        o.materialize(name, at, {"orders": load(spark, sf, "orders")}, {"status": "F"})
    return o


@query("SELECT 'orders' AS metric, CAST(y AS VARCHAR) AS at_year, CASE WHEN y = 2021 THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') ELSE (SELECT count(*) FROM orders) END * 1.0 AS value, CASE WHEN y = 2021 THEN 1 ELSE 2 END AS version FROM (VALUES (2021), (2022), (2023)) t(y)")
def metric_history(spark, sf):
    return _observed(spark, sf).history("orders").select("metric", F.year("at").cast("string").alias("at_year"), "value", "version")


@query("SELECT 'orders' AS metric, n * 1.0 AS value, n * 1.0 AS before, 0.0 AS change, n > 10 AS breaching FROM (SELECT count(*) AS n FROM orders)")
def metric_board(spark, sf):
    o = _observed(spark, sf)
    bad = o.breaching({"orders": ("lte", 10)}).select("metric", F.lit(True).alias("b"))
    return o.board().join(bad, "metric", "left").select("metric", "value", "before", "change", F.coalesce("b", F.lit(False)).alias("breaching"))


@query("SELECT * FROM (VALUES ('share', 'big'), ('share', 'total')) t(metric, refers_to)")
def metric_lineage(spark, sf):
    m = metrics.Metrics()
    m.define("total", "SELECT count(*) AS n FROM {orders}")
    m.define("big", "SELECT count(*) AS n FROM {orders} WHERE o_totalprice > 1000")
    m.define("share", "SELECT b.n / t.n FROM {metric:big} b, {metric:total} t")
    return spark.createDataFrame(metrics.lineage(m), "metric string, refers_to string")


@query("SELECT 'a' AS rule, false AS failing UNION ALL SELECT 'b', count(*) < 1000000000 FROM orders UNION ALL SELECT 'c', avg(o_totalprice) > 1 FROM orders UNION ALL SELECT 'd', true")
def metric_sweep(spark, sf):
    rules = {"a": ("status", "SELECT 'pass'"), "b": ("gte", ("SELECT count(*) FROM {orders}", 10**9)), "c": ("expr", "SELECT avg(o_totalprice) <= 1 FROM {orders}"), "d": ("lte", ("SELECT 2.0", 1)), "e": ("status", "SELECT nothing")}
    rows, errors = metrics.states(rules, {"orders": load(spark, sf, "orders")}, spark, 1)
    if [e[0] for e in errors] != ["e"]:
        raise AssertionError(errors)
    return rows.select("rule", "failing")


@query("SELECT table_name, true AS old FROM (VALUES ('orders'), ('lineitem')) t(table_name)")
def metric_freshness(spark, sf):
    both = {"orders": (load(spark, sf, "orders"), "o_orderdate"), "lineitem": (load(spark, sf, "lineitem"), "l_shipdate")}
    return metrics.freshness(both, "2024-01-01").select("table_name", (F.col("hours") > 24).alias("old"))


def _cubes(spark, sf):
    c = cubes.Cubes(spark, shared.scratch(spark, "cubes"), {"orders": load(spark, sf, "orders"), "customer": load(spark, sf, "customer")})
    c.define("sales", "SELECT o_orderstatus, o_totalprice FROM {orders}")
    c.define("sales", "SELECT o_orderstatus, c_mktsegment, o_orderdate, o_custkey, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey;", "with segments")
    return c


@query("SELECT c_mktsegment, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def cube_slice(spark, sf):
    return _cubes(spark, sf).slice("sales", ["c_mktsegment", "o_orderstatus"], n="count(*)", s="round(sum(o_totalprice), 2)")


@query("SELECT * FROM (VALUES ('c_mktsegment', 'string', 'dimension', true), ('o_orderstatus', 'string', 'dimension', true), ('o_orderdate', 'timestamp', 'time', true), ('o_custkey', 'bigint', 'key', true), ('o_totalprice', 'double', 'measure', false)) t(column_name, data_type, kind, groupable)")
def cube_dimensions(spark, sf):
    out = _cubes(spark, sf).dimensions("sales")
    return out.select("column_name", F.regexp_replace("data_type", "_ntz", "").alias("data_type"), "kind", "groupable")


@query("SELECT 'sales' AS name, 3 AS version, 3 AS refreshes, 'ok' AS status, (SELECT count(*) FROM orders) AS n")
def cube_versions(spark, sf):
    c = _cubes(spark, sf)
    c.revert("sales", 1)
    n = c.table("sales").count() if c.table("sales").columns == ["o_orderstatus", "o_totalprice"] else -1
    return c.describe().join(c.health(), "name").select("name", "version", "refreshes", "status", F.lit(n).cast("long").alias("n"))


@query("SELECT 'p_brand' AS column_name, count(*) AS n, 0.0 AS null_frac, count(DISTINCT p_brand) AS n_distinct, (SELECT p_brand || ':' || n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT 1) AS top FROM part UNION ALL SELECT 'p_size', count(*), 0.0, count(DISTINCT p_size), (SELECT p_size || ':' || n FROM (SELECT CAST(p_size AS VARCHAR) AS p_size, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_size LIMIT 1) FROM part")
def quality_fingerprint(spark, sf):
    rows = quality.fingerprint(load(spark, sf, "part").select("p_brand", "p_size"))
    best = F.col("top_values")[0]
    return rows.select("column_name", "n", "null_frac", "n_distinct", F.concat(best["value"], F.lit(":"), best["n"].cast("string")).alias("top"))


def _psi(c: str) -> str:
    return f"SELECT '{c}' AS column_name, sum((q - p) * ln(q / p)) AS psi, sum(CASE WHEN b = 0 THEN 1 ELSE 0 END) AS n_new, sum(CASE WHEN a = 0 THEN 1 ELSE 0 END) AS n_lost FROM (SELECT a, b, greatest(b / nullif(sum(b) OVER (), 0), 1e-6) AS p, greatest(a / nullif(sum(a) OVER (), 0), 1e-6) AS q FROM (SELECT count(*) FILTER (WHERE event_id % 3 = 0) AS b, count(*) FILTER (WHERE event_id % 3 <> 0 AND user_id > 20) AS a FROM events WHERE event_id % 3 = 0 OR user_id > 20 GROUP BY {c}))"


@query(f"SELECT column_name, round(psi, 6) AS psi, CAST(n_new AS BIGINT) AS n_new, CAST(n_lost AS BIGINT) AS n_lost, CASE WHEN psi < 0.1 THEN 'none' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS severity FROM ({_psi('event_type')} UNION ALL {_psi('user_id')})")
def quality_drift_summary(spark, sf):
    e = load(spark, sf, "events")
    return quality.drift_summary(e.filter("event_id % 3 = 0"), e.filter("event_id % 3 <> 0 and user_id > 20"), ["event_type", "user_id"]).withColumn("psi", F.round("psi", 6))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 200000 THEN 'huge' ELSE 'rule_error' END AS verdict FROM orders) GROUP BY verdict")
def quality_rule_error(spark, sf):
    rules = [("huge", 1, "o_totalprice > 200000"), ("broken", 2, "no_such_column = 1"), ("done", 5, "o_orderstatus = 'F'")]
    return quality.rule_verdicts(load(spark, sf, "orders"), rules).groupBy("verdict").agg(F.count("*").alias("n"))


# --- Graphs --------------------------------------------------------------------------------------------


def _triples(spark, sf) -> DataFrame:
    """Triples as a provider gives them, a JSON list a row; two of them without an object."""
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    t = F.struct(F.lit("nation").alias("subject_kind"), F.col("n_name").alias("subject"), F.lit("lies in").alias("predicate"), F.lit("region").alias("object_kind"), F.col("r_name").alias("object"), F.lit(0.9).alias("confidence"), F.concat("n_name", F.lit(" is in "), "r_name").alias("evidence"))
    return n.select(F.to_json(F.array(t, t.withField("object", F.lit(" ")))).alias("output"), F.col("n_nationkey").alias("source"))


def _graph(spark, sf) -> graph.Graph:
    rows = _triples(spark, sf).select(F.explode(T.triples_of(F.col("output"))).alias("t"), "source").select("t.*", "source")
    g = graph.Graph(spark)
    g.assert_triples(rows)
    g.assert_triples(rows)  # a second time changes nothing
    return g


_NATIONS = "SELECT trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS s, trim(regexp_replace(lower(r_name), '[^a-z0-9]+', ' ', 'g')) AS o, n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(f"SELECT s AS src, 'lies_in' AS predicate, o AS dst, 0.9 AS confidence FROM ({_NATIONS})")
def graph_triples(spark, sf):
    return _graph(spark, sf).edges.select("src", "predicate", "dst", "confidence")


@query(f"SELECT s AS src, o AS dst, n_nationkey || '' AS source FROM ({_NATIONS}) WHERE o = (SELECT min(o) FROM ({_NATIONS}))")
def graph_evidence(spark, sf):
    g = _graph(spark, sf)
    least = g.nodes.filter("kind = 'region'").orderBy("label").first().label
    rows = g.neighbours("region", least)
    return rows.select("src", "dst", F.get_json_object("evidence", "$[0].source").alias("source"))


@query(f"SELECT CASE WHEN s IN (SELECT s FROM ({_NATIONS}) WHERE n_nationkey IN (1, 2)) THEN (SELECT min(s) FROM ({_NATIONS}) WHERE n_nationkey IN (1, 2)) ELSE s END AS src, count(DISTINCT o) AS n FROM ({_NATIONS}) GROUP BY 1")
def graph_accept_merge(spark, sf):
    g = _graph(spark, sf)
    n = load(spark, sf, "nation").filter("n_nationkey in (1, 2)").select(T.normalise_label(F.col("n_name")).alias("k"))
    g.accept(n.agg(F.lit("nation").alias("kind"), F.min("k").alias("key"), F.max("k").alias("other")))
    known = g.resolve(load(spark, sf, "nation").select(F.lit("nation").alias("kind"), F.col("n_name").alias("label")))
    return g.edges.join(known.select(F.col("key").alias("src")).distinct(), "src").groupBy("src").agg(F.countDistinct("dst").alias("n"))


@query("SELECT 2 AS before, 1 AS after")
def graph_reject_merge(spark, sf):
    g = graph.Graph(spark)
    g.assert_nodes(spark.createDataFrame([("firm", "Acme Corp"), ("firm", "Acme Corporation"), ("firm", "Other"), ("place", "Rome City"), ("place", "Rome")], "kind string, label string"))
    first = g.suggest().count()
    g.reject(g.suggest().filter("kind = 'firm'"))
    return spark.createDataFrame([(first, g.suggest().count())], "before long, after long")


@query("SELECT predicate, count(*) AS n FROM (SELECT DISTINCT 'of_brand' AS predicate, lower(p_name) AS a, lower(p_brand) AS b FROM part UNION SELECT DISTINCT 'of_type', lower(p_name), lower(p_type) FROM part) GROUP BY predicate")
def graph_crawl(spark, sf):
    g = graph.Graph(spark)
    part = load(spark, sf, "part")
    graph.crawl(part, [("part", "p_name", "of brand", "brand", "p_brand"), ("part", "p_name", "of type", "type", "p_type"), ("part", "p_name", "of size", "size", "p_size")], g)
    return g.edges.groupBy("predicate").agg(F.count("*").alias("n"))


_WALK_8 = f"WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT edge_id, src AS f, dst AS t FROM e UNION ALL SELECT edge_id, dst, src FROM e), w(node, nodes, ids, d) AS (SELECT CAST(1003 AS BIGINT), [CAST(1003 AS BIGINT)], CAST([] AS BIGINT[]), 0 UNION ALL SELECT s.t, list_append(w.nodes, s.t), list_append(w.ids, s.edge_id), d + 1 FROM w JOIN s ON s.f = w.node WHERE d < 3 AND NOT list_contains(w.nodes, s.t))"


@query(_WALK_8 + " SELECT d AS depth, ids[-1] AS edge_id, node FROM w WHERE d BETWEEN 1 AND 2")
def graph_neighbour_edges(spark, sf):
    return graph.neighbours(_edges(spark, sf), 1003, 2).select("depth", "edge_id", "node")


@query(_WALK_8 + " SELECT node, d AS depth, array_to_string(ids, ',') AS edges FROM w WHERE node IN (1008, 1013)")
def graph_paths_found(spark, sf):
    e = _edges(spark, sf)
    return graph.paths(e, 1003, 1008).select(F.lit(1008).cast("long").alias("node"), "depth", "edges").unionByName(graph.paths(e, 1003, 1013).select(F.lit(1013).cast("long").alias("node"), "depth", "edges"))


# --- Models, SQL by a provider, shapes -----------------------------------------------------------------


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem")
def model_regression(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice")
    fitted = models.train(rows, "l_extendedprice", [("l_quantity", "numeric")])
    line = fitted.stages[-1]
    out = models.evaluate(fitted.transform(rows), "l_extendedprice", "regression")
    return out.select(F.round(F.lit(float(line.coefficients[0])), 3).alias("slope"), F.round(F.lit(float(line.intercept)), 2).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


@query("SELECT count(*) AS n, round(avg(CASE WHEN (l_quantity > 25) = (l_returnflag = 'R') THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM lineitem")
def model_evaluate(spark, sf):
    said = load(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_quantity") > 25).cast("double").alias("prediction"))
    return models.evaluate(said, "y", "classification").select("n", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT p_type, p_type AS label FROM (SELECT DISTINCT p_type FROM part)")
def model_distill(spark, sf):
    """A model learns which word stands in a text, and finds it again in all of them."""
    part = load(spark, sf, "part").select(F.concat(F.lit("a part of kind "), "p_type").alias("text"), "p_type").distinct()
    label = lambda t: t.withColumn("label_text", F.element_at(F.split("text", " "), -1))
    fitted = models.distill(part, "text", label)
    names = fitted.stages[-2].labels
    named = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("prediction") + 1).cast("int"))
    return fitted.transform(part.withColumn("label_text", F.lit(names[0]))).select("p_type", named.alias("label"))


@query("SELECT * FROM (VALUES ('p_partkey', 'numeric'), ('p_name', 'text'), ('p_brand', 'category'), ('p_type', 'category')) t(column_name, kind)")
def model_features(spark, sf):
    part = load(spark, sf, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("p_name"), "p_brand", "p_type", "p_size")
    return spark.createDataFrame(models.feature_schema(part, "p_size"), "column_name string, kind string")


class _Writer:
    """A provider that first writes a statement that isn't read-only, then a SELECT."""

    def __call__(self, prompts):
        return ["SELECT o_orderstatus, count(*) AS n FROM {orders} GROUP BY o_orderstatus" if "failed" in p else "DROP TABLE orders" for p in prompts]


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def text_to_sql(spark, sf):
    return models.ask_sql(spark, "How many orders are there of each status?", {"orders": load(spark, sf, "orders")}, _Writer())


class _Shaper:
    def __call__(self, prompts):
        return ["upper(substring(value, 7))" for _ in prompts]


@query("SELECT p_partkey, CASE WHEN length(p_brand) = 7 THEN 'no ' || substring(p_brand, 7) ELSE upper(substring(p_brand, 7)) END AS x FROM part")
def shape_expressions(spark, sf):
    part, shapes = load(spark, sf, "part"), models.Shapes()
    shapes.pin("aaaaa#d", "concat('no ', substring(value, 7))")
    shapes.learn(part, "p_brand", _Shaper())
    return part.select("p_partkey", shapes.column("p_brand").alias("x"))


# --- Flows and streams ---------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT 0 AS step, 'select' AS stage, count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY 1) UNION ALL SELECT 1, 'often', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 9) UNION ALL SELECT 2, 'count', 1)")
def flow_steps(spark, sf):
    log: list = []
    flow.run(spark, "SELECT o_custkey, count(*) AS c FROM {orders} GROUP BY o_custkey THEN often THEN count", {"orders": load(spark, sf, "orders")}, pinned={"often": "SELECT * FROM {_input} WHERE c > 9"}, log=log)
    return spark.createDataFrame([(i, s, n) for i, (s, n, _) in enumerate(log)], "step int, stage string, n long")


@query("SELECT 'bar_chart' AS kind, count(*) AS n_rows, min(p_brand) AS first_brand FROM (SELECT p_brand FROM part GROUP BY 1)")
def flow_artifact(spark, sf):
    out = flow.run(spark, "SELECT p_brand, count(*) AS n FROM {part} GROUP BY p_brand ORDER BY p_brand THEN bar_chart('p_brand', 'n')", {"part": load(spark, sf, "part")})
    return out.select("kind", F.get_json_object("spec", "$.n_rows").cast("long").alias("n_rows"), F.get_json_object("spec", "$.rows[0].p_brand").alias("first_brand"))


def _stream(spark: SparkSession, df: DataFrame, label: str) -> tuple[DataFrame, str]:
    path = shared.scratch(spark, label)
    df.write.parquet(f"{path}/in")
    return incremental.read_new(spark, f"{path}/in", df.schema), path


@query("SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS s FROM events")
def stream_ingest(spark, sf):
    stream, path = _stream(spark, load(spark, sf, "events").select("event_id", "value"), "ingest")
    for _ in range(2):  # the second call finds nothing new
        incremental.ingest(stream, f"{path}/out", f"{path}/checks")
    return spark.read.parquet(f"{path}/out").agg(F.count("*").alias("n"), F.sum("event_id").alias("s"))


@query("SELECT user_id AS k, user_id * 2 AS twice FROM events GROUP BY user_id")
def stream_view(spark, sf):
    stream, path = _stream(spark, load(spark, sf, "events").select(F.col("user_id").alias("k")), "view")
    incremental.keep_view(stream, f"{path}/view", "k", lambda d: d.selectExpr("k", "k * 2 as twice"), f"{path}/checks")
    return incremental.read_view(spark, f"{path}/view").select("k", "twice")


@query(_FIRES)
def stream_fires(spark, sf):
    states = load(spark, sf, "events").select(F.col("event_type").alias("rule"), F.col("event_id").alias("at"), (F.col("value") > 40).alias("failing"))
    stream, path = _stream(spark, states, "fires")
    out = incremental.fires(stream, 2, 30)
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("rule string, at long").parquet(f"{path}/out")


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def stream_windowed(spark, sf):
    events = load(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    stream, path = _stream(spark, events, "windows")
    out = incremental.windowed(stream, "ts", "1 day", "1 second", "event_type")
    out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checks").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
