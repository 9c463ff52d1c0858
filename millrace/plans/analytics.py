"""Queries of the vector, text, time, metric, quality, graph and semantic operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, metrics, quality, relational, semantic, shared, timetravel, vector
from ..sources.tables import load, placed
from . import flow

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")).filter("id is not null and v is not null")


def _one(spark: SparkSession, sf: str, i: int) -> list[float]:
    return list(_vectors(spark, sf).filter(F.col("id") == i).first().v)


_COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


@query(f"SELECT a.vec_id AS id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3 ORDER BY {_COS} DESC, a.vec_id LIMIT 10")
def vector_knn(spark, sf):
    return vector.knn(_vectors(spark, sf), _one(spark, sf, 3), 10).select("id", F.round("score", 6).alias("score"))


_CENTRED = "WITH m AS (SELECT i, avg(x) AS m FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i), mean AS (SELECT list(m ORDER BY i) AS m FROM m), c AS (SELECT vec_id, list_transform(list_zip(CAST(embedding AS DOUBLE[]), m), lambda p: p[1] - p[2]) AS v FROM embeddings, mean)"


@query(_CENTRED + " SELECT * FROM (SELECT a.vec_id AS id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM c a, c b WHERE b.vec_id = 3 ORDER BY list_cosine_similarity(a.v, b.v) DESC, a.vec_id LIMIT 20) WHERE score >= 0.10")
def vector_centred_knn(spark, sf):
    return vector.centred_knn(_vectors(spark, sf), _one(spark, sf, 3), 20).select("id", F.round("score", 6).alias("score"))


_DISTANCE = f"SELECT a.vec_id AS id, round(1 - max({_COS}), 6) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id GROUP BY a.vec_id"


@query(_DISTANCE)
def vector_outliers(spark, sf):
    return vector.isolation(_vectors(spark, sf)).select("id", F.round("distance", 6).alias("distance"))


@query(f"SELECT a.vec_id AS id, round(1 - max({_COS}), 6) AS novelty FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 GROUP BY a.vec_id ORDER BY 1 - max({_COS}) DESC, a.vec_id LIMIT 20")
def vector_diff(spark, sf):
    v = _vectors(spark, sf)
    out = vector.novelty(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"))
    return out.orderBy(F.desc("novelty"), "id").limit(20).select("id", F.round("novelty", 6).alias("novelty"))


@query(f"WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {_COS} >= 0.7), r(n, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.n), g AS (SELECT n, min(c) AS g FROM r GROUP BY n) SELECT g AS group_id, count(*) AS size FROM g GROUP BY g HAVING count(*) > 1")
def vector_dedupe_groups(spark, sf):
    groups = vector.similar_groups(_vectors(spark, sf), 0.7)
    return groups.groupBy("group_id").agg(F.count("*").alias("size")).filter("size > 1")


_LEX = "SELECT doc_id AS id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 AS DOUBLE) / (1 + length(text)) AS score FROM documents WHERE lower(text) LIKE '%the%'"
_DENSE = f"SELECT a.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b WHERE b.vec_id = 3"


def _lexical(spark, sf):
    low = F.lower("text")
    hits = ((F.length(low) - F.length(F.replace(low, F.lit("the"), F.lit("")))) / 3).cast("double")
    return load(spark, sf, "documents").filter(low.contains("the")).select(F.col("doc_id").alias("id"), (hits / (1 + F.length("text"))).alias("score"))


@query(f"WITH d AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_DENSE}) ORDER BY r LIMIT 50), x AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM ({_LEX}) ORDER BY r LIMIT 50) SELECT coalesce(d.id, x.id) AS id, round(coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + x.r), 0), 8) AS rrf FROM d FULL JOIN x ON d.id = x.id ORDER BY coalesce(1.0 / (60 + d.r), 0) + coalesce(1.0 / (60 + x.r), 0) DESC, coalesce(x.score, 0) DESC, id LIMIT 10")
def search_hybrid(spark, sf):
    dense = vector.knn(_vectors(spark, sf), _one(spark, sf, 3), 50)
    lexical = _lexical(spark, sf).orderBy(F.desc("score"), "id").limit(50)
    return vector.fuse(dense, lexical, 10).select("id", F.round("rrf", 8).alias("rrf"))


@query(f"SELECT id, round(score, 9) AS score FROM ({_LEX}) ORDER BY score DESC, id LIMIT 10")
def search_lexical(spark, sf):
    return _lexical(spark, sf).orderBy(F.desc("score"), "id").limit(10).select("id", F.round("score", 9).alias("score"))


@query(f"WITH f AS (SELECT * FROM ({_DENSE}) ORDER BY score DESC, id LIMIT 20), t AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1), u AS (SELECT f.id, score, coalesce(n, 0) AS n FROM f LEFT JOIN t USING (id)) SELECT id, round(score * (1 + 0.5 * coalesce(n / nullif((SELECT max(n) FROM u), 0), 0)), 6) AS boosted FROM u ORDER BY score * (1 + 0.5 * coalesce(n / nullif((SELECT max(n) FROM u), 0), 0)) DESC, id LIMIT 10")
def search_weighted(spark, sf):
    found = vector.knn(_vectors(spark, sf), _one(spark, sf, 3), 20)
    touches = load(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("touches"))
    return vector.boosted(found, touches, 10).select("id", F.round("boosted", 6).alias("boosted"))


@query()
def vector_topics(spark, sf):
    return vector.topics(_vectors(spark, sf), 8)


@query(f"SELECT a.vec_id AS id, CASE WHEN greatest(max(CASE WHEN b.vec_id = 3 THEN {_COS} END), max(CASE WHEN b.vec_id = 5 THEN {_COS} END)) < 0.2 THEN 'other' WHEN max(CASE WHEN b.vec_id = 3 THEN {_COS} END) >= max(CASE WHEN b.vec_id = 5 THEN {_COS} END) THEN 'like three' ELSE 'like five' END AS result FROM embeddings a, embeddings b WHERE b.vec_id IN (3, 5) GROUP BY a.vec_id")
def semantic_case(spark, sf):
    return semantic.semantic_case(_vectors(spark, sf), [_one(spark, sf, 3), _one(spark, sf, 5)], ["like three", "like five"], "other", 0.2)


@query("WITH s AS (SELECT regexp_replace(regexp_replace(url, '[A-Za-z]', 'a', 'g'), '[0-9]', 'd', 'g') AS s FROM pages) SELECT CASE WHEN length(s) > 24 THEN left(s, 24) || '~' ELSE s END AS shape, count(*) AS n FROM s GROUP BY 1")
def text_value_shape(spark, sf):
    return load(spark, sf, "pages").groupBy(T.value_shape(F.col("url"), 24).alias("shape")).agg(F.count("*").alias("n"))


@query("SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/]+)/.*$', '\\1') AS host, round(avg(length(url)), 6) AS l, count(*) AS c, min(url) AS first_url FROM pages WHERE url <> '' GROUP BY 1 HAVING count(*) > 2 ORDER BY l DESC, host LIMIT 25")
def group_url_host(spark, sf):
    g = load(spark, sf, "pages").filter("url <> ''").groupBy(T.url_host(F.col("url")).alias("host"))
    out = g.agg(F.avg(F.length("url")).alias("l"), F.count("*").alias("c"), F.min("url").alias("first_url")).filter("c > 2")
    return out.withColumn("l", F.round("l", 6)).orderBy(F.desc("l"), "host").limit(25)


@query("SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS label, replace(trim(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ', '_') AS predicate FROM part")
def text_labels(spark, sf):
    return load(spark, sf, "part").select("p_partkey", T.normalise_label(F.col("p_type")).alias("label"), T.normalise_predicate(F.col("p_type")).alias("predicate"))


_LABELS = "WITH n AS (SELECT *, trim(regexp_replace(lower(n_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS l FROM nation), p AS (SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.l = b.l THEN 1.0 WHEN contains(a.l, b.l) OR contains(b.l, a.l) THEN 0.86 ELSE round(len(list_intersect(string_split(a.l, ' '), string_split(b.l, ' '))) / len(list_distinct(list_concat(string_split(a.l, ' '), string_split(b.l, ' ')))), 6) END AS s FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey)"


@query(_LABELS + " SELECT a, b, s FROM p")
def text_label_similarity(spark, sf):
    n = load(spark, sf, "nation")
    both = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey"))
    return both.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.round(T.label_similarity(F.col("a.n_name"), F.col("b.n_name")), 6).alias("s"))


_SENTENCES = "SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS s FROM documents)"
_HITS = "len(list_filter(regexp_split_to_array(lower(s), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t = '{0}'))"
_SCORE = " + ".join(f"CASE WHEN {_HITS.format(w)} > 0 THEN 10 + {_HITS.format(w)} ELSE 0 END" for w in ("the", "of", "and"))


@query(f"WITH x AS (SELECT doc_id, trim(s, ' ') AS s, i, {_SCORE} AS score FROM ({_SENTENCES})), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM x WHERE score > 0) SELECT doc_id, list(s ORDER BY i) AS evidence FROM r WHERE r <= 3 GROUP BY doc_id")
def text_evidence(spark, sf):
    return load(spark, sf, "documents").select("doc_id", T.text_evidence(F.col("text"), "the of and").alias("evidence")).filter(F.size("evidence") > 0)


_PACKED = "list_reduce(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda p: trim(p, ' ')), lambda p: p <> ''), lambda a, p: a || CASE WHEN length(string_split(a, chr(1))[-1]) + length(p) + 2 <= 1200 THEN chr(10) || chr(10) ELSE chr(1) END || p)"


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS chunk, c AS text FROM (SELECT doc_id, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, string_split({_PACKED}, chr(1)) AS c FROM documents WHERE trim(text, ' ' || chr(10)) <> ''))")
def text_chunks(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk", "text"))


@query("SELECT conv_id, turn, regexp_matches(upper(ltrim(text)), '^(YES|TRUE|1)') AS yes, try_cast(nullif(regexp_extract(text, '-?[0-9]+', 0), '') AS BIGINT) AS number, least(greatest(try_cast(nullif(regexp_extract(text, '-?[0-9]+(?:\\.[0-9]+)?', 0), '') AS DOUBLE), 0.0), 1.0) AS score FROM conversations WHERE text IS NOT NULL AND regexp_extract(text, '-?[0-9]+', 0) <> ''")
def text_parsers(spark, sf):
    rows = load(spark, sf, "conversations").filter("text is not null and regexp_extract(text, '-?[0-9]+', 0) <> ''")
    t = F.col("text")
    return rows.select("conv_id", "turn", T.yes_no(t).alias("yes"), T.extract_int(t).alias("number"), T.score_0_1(t).alias("score"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1")
def json_group(spark, sf):
    return load(spark, sf, "events").groupBy((F.get_json_object("props", "$.k").cast("bigint") % 10).alias("k")).agg(F.count("*").alias("n"))


_GEN = "CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT)"


def _orders(spark, sf):
    rows = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("bigint").alias("generation"))
    deletes = rows.filter("o_orderkey % 17 = 0").select("o_orderkey", (F.col("generation") + 3).alias("generation"))
    return rows, deletes


@query(f"WITH o AS (SELECT o_orderkey, o_totalprice, {_GEN} AS g FROM orders) SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM o WHERE g <= 23960 AND NOT (o_orderkey % 17 = 0 AND g + 3 <= 23960)")
def time_as_of(spark, sf):
    rows, deletes = _orders(spark, sf)
    return timetravel.as_of(rows, deletes, "o_orderkey", 23960).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))


@query(f"WITH o AS (SELECT o_orderkey, {_GEN} AS g FROM orders), w AS (SELECT g, count(*) AS written FROM o GROUP BY g), t AS (SELECT g + 3 AS g, count(*) AS tombstones FROM o WHERE o_orderkey % 17 = 0 GROUP BY 1), b AS (SELECT g, coalesce(written, 0) AS written, coalesce(tombstones, 0) AS tombstones FROM w FULL JOIN t USING (g)) SELECT g AS generation, written, tombstones, CAST(sum(written - tombstones) OVER (ORDER BY g) AS BIGINT) AS visible FROM b")
def time_timeline(spark, sf):
    rows, deletes = _orders(spark, sf)
    return timetravel.timeline(rows, deletes, "o_orderkey")


@query(f"SELECT count(*) AS n FROM orders WHERE {_GEN} = (SELECT max({_GEN}) FROM orders)")
def time_snapshot(spark, sf):
    return timetravel.snapshot(_orders(spark, sf)[0]).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders WHERE o_orderkey % 17 <> 0")
def time_hybrid(spark, sf):
    rows, deletes = _orders(spark, sf)
    base, delta = rows.filter("o_orderkey % 5 <> 0 or o_orderkey % 10 = 0"), rows.filter("o_orderkey % 5 = 0")
    return timetravel.hybrid(base, delta, deletes, "o_orderkey").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"))


@query("SELECT l_suppkey, l_orderkey, o.o_totalprice AS price FROM (SELECT l_orderkey, l_suppkey, l_shipdate, min(l_linenumber) FROM lineitem GROUP BY 1, 2, 3) l ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1, 2) o ON l.l_suppkey = o.o_custkey AND l.l_shipdate >= o.o_orderdate")
def join_asof(spark, sf):
    left = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("at")).distinct()
    right = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("at")).agg(F.max("o_totalprice").alias("price"))
    return relational.asof_join(left, right, "k", "at").select(F.col("k").alias("l_suppkey"), "l_orderkey", "price")


@query("SELECT count(*) AS n, count(o_totalprice) AS n_nonnull, min(o_totalprice) AS least, max(o_totalprice) AS greatest, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 6) AS mean FROM orders")
def agg_stats(spark, sf):
    return relational.stats(load(spark, sf, "orders"), "o_totalprice").withColumns({"total": F.round("total", 2), "mean": F.round("mean", 6)})


@query("SELECT count(DISTINCT source) AS n FROM documents")
def sketch_approx_distinct(spark, sf):
    return quality.approx_distinct(load(spark, sf, "documents"), "source")


@query("SELECT count(DISTINCT source) AS n FROM documents")
def sketch_union(spark, sf):
    return quality.union_sketches(quality.sketch_by(load(spark, sf, "documents"), "lang", "source"))


@query("SELECT 'large' AS name, '1' AS version, count(*) AS n FROM orders WHERE o_totalprice > 100000")
def bitmap_predicate(spark, sf):
    return quality.bitmap_size(quality.predicate_bitmap(load(spark, sf, "orders"), "o_orderkey", "o_totalprice > 100000", "large", "1"))


def _profile(c: str, cast: str = "VARCHAR") -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS p{int(p * 100):02d}" for p in quality.QUANTILES)
    return f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_null, count(DISTINCT {c}) AS n_distinct, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS greatest, {q} FROM part"


@query(_profile("p_partkey") + " UNION ALL " + _profile("p_size"))
def quality_profile(spark, sf):
    return quality.profile(load(spark, sf, "part").select("p_partkey", "p_size"))


_P = "greatest(coalesce(b.n, 0) / (SELECT sum(n) FROM b), 1e-6)"
_Q = "greatest(coalesce(a.n, 0) / (SELECT sum(n) FROM a), 1e-6)"


@query(f"WITH b AS (SELECT event_type AS v, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), a AS (SELECT event_type AS v, count(*) AS n FROM events WHERE event_id % 2 = 1 OR event_id % 3 = 0 GROUP BY 1) SELECT coalesce(a.v, b.v) AS value, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after, round(({_Q} - {_P}) * ln({_Q} / {_P}), 9) AS psi, CASE WHEN b.n IS NULL THEN 'new' WHEN a.n IS NULL THEN 'lost' ELSE 'both' END AS flag FROM a FULL JOIN b ON a.v = b.v")
def quality_drift(spark, sf):
    e = load(spark, sf, "events")
    return quality.drift(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1 or event_id % 3 = 0"), "event_type").withColumn("psi", F.round("psi", 9))


@query("SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN o_totalprice > 200000 THEN 'huge' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderkey % 2 = 0 THEN 'even' END AS verdict FROM orders) WHERE verdict IS NOT NULL GROUP BY verdict")
def quality_rules(spark, sf):
    rules = [("even", 9, "o_orderkey % 2 = 0"), ("huge", 1, "o_totalprice > 200000"), ("done", 5, "o_orderstatus = 'F'")]
    return quality.first_rule(load(spark, sf, "orders"), rules).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('documents', 'document_id', 'document'), ('labels', 'document_id', 'document'), ('labels', 'document_id', 'documents'), ('pages', 'page_id', 'page')) t(table_name, column_name, to_table)")
def quality_inferred_keys(spark, sf):
    names = ["documents", "labels", "pages"]
    rows = [(t, c) for t in names for c in load(spark, sf, t).columns] + [("document", "id"), ("page", "id"), ("documents", "id")]
    return quality.inferred_keys(spark.createDataFrame(rows, "table_name string, column_name string").replace({"doc_id": "document_id"}))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS balance FROM customer GROUP BY c_mktsegment")
def metric_by(spark, sf):
    return metrics.by(load(spark, sf, "customer"), ["c_mktsegment"], n="count(*)", balance="round(avg(c_acctbal), 6)")


@query("SELECT round(sum(o_totalprice) / count(*), 4) AS mean_price FROM orders WHERE o_orderstatus = 'F'")
def metric_versions(spark, sf):
    m = metrics.Metrics()
    m.define("filled", "SELECT * FROM {orders}", "2020-01-01")
    m.define("filled", "SELECT * FROM {orders} WHERE o_orderstatus = {status}", "2021-01-01")
    m.define("mean_price", "SELECT round(sum(o_totalprice) / count(*), 4) AS mean_price FROM {metric:filled}", "2020-06-01")
    return m.run(spark, "mean_price", {"orders": load(spark, sf, "orders")}, {"status": "F"}, "2022-01-01")


@query("SELECT metric, bucket, value FROM (SELECT event_type AS metric, CAST(date_trunc('day', ts) AS VARCHAR) AS bucket, value, row_number() OVER (PARTITION BY event_type, date_trunc('day', ts) ORDER BY ts DESC, value DESC) AS r FROM events) WHERE r = 1")
def metric_series(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_type").alias("metric"), F.col("ts").alias("at"), "value")
    return metrics.series(e, "day").select("metric", F.col("bucket").cast("string").alias("bucket"), "value")


@query()
def aggregate_bool(spark, sf):
    # Its text (portable.SQL) leaves open which of a user's highest events is m: the first in the table, as one reader has it.
    e = placed(spark, sf, "events")
    first = F.when(F.col("event_id").isNotNull() & F.col("value").isNotNull(), F.struct("value", -F.col("place")))
    return e.groupBy("user_id").agg(F.bool_and(F.col("value") > 0).alias("a"), F.bool_or(F.col("value") > 90).alias("o"), F.max_by("event_id", first).alias("m"))


@query("SELECT l_suppkey, round(avg(l_discount), 6) AS d, avg(l_discount) >= 0.05 AS x, coalesce(NOT avg(l_discount) >= 0.05, false) AS breach, CASE WHEN avg(l_discount) >= 0.05 THEN 'pass' ELSE 'fail' END AS status FROM lineitem GROUP BY l_suppkey")
def metric_check(spark, sf):
    lines = placed(spark, sf, "lineitem").select("l_suppkey", "l_discount", "place")
    rows = metrics.means_in_order(lines, "l_suppkey", "l_discount", "place", lambda d: [d >= 0.05, F.round(d, 6)]).withColumnRenamed("mean", "d")
    return metrics.checked(rows, "d >= 0.05").withColumn("x", F.expr("d >= 0.05")).withColumn("d", F.round("d", 6))


_STATES = 'SELECT event_type AS rule, event_id AS "at", value > 40 AS failing FROM events'


# Candidates are the second failures of episodes; from the first of a rule on, each fire is the first candidate at least 30 later.
_FIRES = f'WITH RECURSIVE s AS ({_STATES}), i AS (SELECT *, sum(CASE WHEN failing THEN 0 ELSE 1 END) OVER (PARTITION BY rule ORDER BY "at") AS island FROM s), f AS (SELECT rule, "at" FROM (SELECT *, row_number() OVER (PARTITION BY rule, island ORDER BY "at") AS n FROM i WHERE failing) WHERE n = 2), fire AS (SELECT rule, min("at") AS "at" FROM f GROUP BY rule UNION ALL SELECT fire.rule, (SELECT min(f."at") FROM f WHERE f.rule = fire.rule AND f."at" >= fire."at" + 30) FROM fire WHERE "at" IS NOT NULL) SELECT rule, "at" FROM fire WHERE "at" IS NOT NULL'


@query(_FIRES)
def metric_alerts(spark, sf):
    return metrics.alerts(load(spark, sf, "events").select(F.col("event_type").alias("rule"), F.col("event_id").alias("at"), (F.col("value") > 40).alias("failing")), 2, 30)


_EDGES = "SELECT row_number() OVER (ORDER BY t, a, b) AS edge_id, CAST(a AS BIGINT) AS src, CAST(b AS BIGINT) AS dst, t AS predicate, 0.5 + (a % 5) / 10.0 AS confidence FROM (SELECT 'in' AS t, 1000 + n_nationkey AS a, 2000 + n_regionkey AS b FROM nation UNION ALL SELECT 'lives' AS t, 10000 + c_custkey AS a, 1000 + c_nationkey AS b FROM customer)"


def _edges(spark, sf):
    n = load(spark, sf, "nation").select(F.lit("in").alias("t"), (1000 + F.col("n_nationkey")).cast("long").alias("a"), (2000 + F.col("n_regionkey")).cast("long").alias("b"))
    c = load(spark, sf, "customer").select(F.lit("lives").alias("t"), (10000 + F.col("c_custkey")).cast("long").alias("a"), (1000 + F.col("c_nationkey")).cast("long").alias("b"))
    rows = shared.numbered(n.union(c), "edge_id", ["t", "a", "b"])
    return rows.select("edge_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.col("t").alias("predicate"), (0.5 + (F.col("a") % 5) / 10.0).alias("confidence"))


_WALK = f"WITH RECURSIVE e AS ({_EDGES}), s AS (SELECT edge_id, src AS f, dst AS t, confidence FROM e UNION ALL SELECT edge_id, dst, src, confidence FROM e), w(node, nodes, ids, c, d) AS (SELECT CAST(1003 AS BIGINT), [CAST(1003 AS BIGINT)], CAST([] AS BIGINT[]), CAST(1.0 AS DOUBLE), 0 UNION ALL SELECT s.t, list_append(w.nodes, s.t), list_append(w.ids, s.edge_id), w.c * s.confidence, d + 1 FROM w JOIN s ON s.f = w.node WHERE d < 3 AND NOT list_contains(w.nodes, s.t))"


@query(_WALK + " SELECT node, min(d) AS depth, count(*) AS n_paths FROM w WHERE d > 0 GROUP BY node")
def graph_neighbours(spark, sf):
    return graph.walks(_edges(spark, sf), 1003, 3).groupBy("node").agg(F.min("depth").alias("depth"), F.count("*").alias("n_paths"))


@query(_WALK + " SELECT d AS depth, array_to_string(ids, ',') AS edges FROM w WHERE d > 0 AND node = 1001 OR d = 1 AND node = 2001 ORDER BY depth, edges LIMIT 100")
def graph_paths(spark, sf):
    e = _edges(spark, sf)
    return graph.paths(e, 1003, 1001).unionByName(graph.paths(e, 1003, 2001, 1))


@query(_WALK + " SELECT edge_id, round(score, 9) AS score, depth FROM (SELECT ids[-1] AS edge_id, max(c * power(0.85, d - 1)) AS score, min(d) AS depth FROM w WHERE d > 0 GROUP BY 1) ORDER BY score DESC, edge_id LIMIT 25")
def graph_context(spark, sf):
    return graph.context(_edges(spark, sf), 1003, 3).withColumn("score", F.round("score", 9))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS d, l_partkey % 50 AS t FROM lineitem), f AS (SELECT t, count(*) AS df FROM e GROUP BY t), n AS (SELECT count(DISTINCT d) AS n FROM e) SELECT b.d AS doc_id, round(sum(ln((n + 1) / (df + 0.5))), 6) AS score, count(*) AS n_shared FROM e a JOIN e b ON a.t = b.t AND b.d <> a.d JOIN f ON f.t = a.t, n WHERE a.d = 1 GROUP BY b.d ORDER BY score DESC, doc_id LIMIT 10")
def graph_related(spark, sf):
    rows = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("entity"))
    out = graph.related(rows, 1, 1 << 20).withColumn("score", F.round("score", 6))
    return out.orderBy(F.desc("score"), "doc_id").limit(10)


@query(_LABELS + " SELECT a, b FROM p WHERE s >= 0.86")
def graph_suggest_merges(spark, sf):
    nodes = load(spark, sf, "nation").select(F.col("n_regionkey").alias("kind"), F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("label"))
    return graph.suggest_merges(nodes).select(F.col("label").alias("a"), F.col("other").alias("b"))


@query("SELECT doc_id FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'fr') AND lang <> 'de'")
def access_visible(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", "lang")
    seen = d.join(d.filter("lang = 'fr'").select("source").distinct(), "source", "left_semi")
    return seen.join(d.filter("lang = 'de'").select("doc_id"), "doc_id", "left_anti").select("doc_id")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderkey % 3 <> 0")
def view_incremental(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return relational.incremental_view(o.filter("o_orderkey % 3 = 0"), o, "o_orderkey", lambda d: d.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice")))


@query("SELECT count(*) AS n FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> 'then' GROUP BY o_custkey HAVING count(*) > 2)")
def flow_stages(spark, sf):
    text = "SELECT o_custkey, count(*) AS c FROM {orders} WHERE o_orderstatus = 'F' AND o_orderpriority <> 'then' GROUP BY o_custkey THEN often THEN pass THEN count"
    return flow.run(spark, text, {"orders": load(spark, sf, "orders")}, pinned={"often": "SELECT * FROM {_input} WHERE c > 2"})


@query("SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) - 1 AS i, count(*) OVER () AS c FROM nation) WHERE i IN (SELECT k * 25 // 10 FROM range(10) t(k))")
def flow_sample(spark, sf):
    return flow.run(spark, "SELECT n_nationkey, n_name FROM {nation} THEN sample(10, n_nationkey)", {"nation": load(spark, sf, "nation")})


_YES = "CASE WHEN (strpos('0123456789abcdef', substr(sha256({}), 2, 1)) - 1) % 2 = 0 THEN 1 ELSE 0 END"  # the stub's answer to a prompt
_ABOUT = "'Is this about trade? ' || p_type"
_TAKES = " + ".join(_YES.format(_ABOUT + t) for t in ("", " || chr(10) || '#1.0'", " || chr(10) || '#2.0'"))


@query(f"SELECT p_partkey, p_type, CASE WHEN {_TAKES} >= 2 THEN 'yes' ELSE 'no' END AS answer FROM part")
def semantic_classify(spark, sf):
    op = semantic.Operator("about", "Is this about trade? {{ inputs.text }}", takes=3)
    return semantic.apply(load(spark, sf, "part").select("p_partkey", "p_type"), "p_type", op, semantic.StubProvider(), "answer")


@query("SELECT n_nationkey, unnest(['a', n_name, 'b']) AS label FROM nation")
def semantic_dimension(spark, sf):
    n = load(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("a, "), "n_name", F.lit(";b")).alias("x"))
    return semantic.dimension(n, "x", "label").select("n_nationkey", "label")
