"""A property graph: upserts, resolution, merges, traversal, context, related documents.

nodes (node_id, kind, label), edges (edge_id, src, predicate, dst, confidence). Traversals are bounded join
loops over paths that don't visit a node twice; each round joins on the node, so a hub is split by AQE.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, merge_similarity, normalise_label
from . import shared


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows, of each key the one with the greatest order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return old.unionByName(new).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def resolve(nodes: DataFrame, aliases: DataFrame, names: DataFrame) -> DataFrame:
    """(name, node_id): by label or alias, once normalised; the smallest node where several fit."""
    known = nodes.select(normalise_label(F.col("label")).alias("l"), "node_id").union(aliases.select(normalise_label(F.col("alias")).alias("l"), "node_id"))
    known = known.groupBy("l").agg(F.min("node_id").alias("node_id"))
    return names.withColumn("l", normalise_label(F.col("name"))).join(known, "l", "left").select("name", "node_id")


def resolve_near(nodes: DataFrame, names: DataFrame, least: float = 0.92, most: int = 10) -> DataFrame:
    """(name, node_id, similarity): for names (name, v) without an exact match, nodes (node_id, v) of at least that cosine.

    names are the few that were asked for; they are sent to the nodes, and each keeps its most best ones.
    """
    asked = names.select("name", F.col("v").alias("_v"))
    near = nodes.join(F.broadcast(asked), F.lit(True)).select("name", "node_id", cosine(F.col("v"), F.col("_v")).alias("similarity")).filter(F.col("similarity") >= least)
    w = Window.partitionBy("name").orderBy(F.desc("similarity"), "node_id")
    return near.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


#: Letters of a label, or fewer if it is shorter, by which labels that hold it are found.
GRAM = 8


def suggest_merges(nodes: DataFrame, least: float = 0.86) -> DataFrame:
    """Pairs of one kind whose labels have at least that similarity, which is over 0.

    Such labels match in a word or one holds the other. Words that match are equal or, from four letters on,
    begin alike. A label is held only where its first letters are, so these are met by all pieces as long.
    """
    l = normalise_label(F.col("label"))
    rows = nodes.select("kind", "node_id", "label", l.alias("l")).filter("l <> ''")
    words = rows.select("kind", "node_id", "label", F.explode(F.array_distinct(F.transform(F.split("l", " "), lambda w: F.substring(w, 1, 4)))).alias("w"))
    first = rows.select("kind", "node_id", "label", F.substring("l", 1, GRAM).alias("w"))
    starts = F.transform(F.sequence(F.lit(1), F.length("l")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("l") - i + 1)), lambda n: F.substring(F.col("l"), i, n)))
    pieces = rows.select("kind", "node_id", "label", F.explode(F.array_distinct(F.flatten(starts))).alias("w"))
    other = lambda t: t.select("kind", F.col("node_id").alias("other_id"), F.col("label").alias("other"), "w")
    met = [words.join(other(words), ["kind", "w"]), first.join(other(pieces), ["kind", "w"]), pieces.join(other(first), ["kind", "w"])]
    pairs = reduce(DataFrame.unionByName, [m.filter("node_id < other_id").select("kind", "node_id", "other_id", "label", "other") for m in met]).distinct()
    return pairs.withColumn("similarity", merge_similarity(F.col("label"), F.col("other"))).filter(F.col("similarity") >= least)


def merged(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges after merges (from_id, to_id), transitively; loops and repeats go, the greatest confidence stays."""
    of = shared.components(merges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b")))
    out = edges
    for c in ("src", "dst"):
        out = out.join(of.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
    return out.filter("src <> dst").groupBy("src", "predicate", "dst").agg(F.max("confidence").alias("confidence"), F.min("edge_id").alias("edge_id"))


class Graph:
    """Nodes, aliases, edges, evidence and merge candidates as tables; every write is an idempotent upsert.

    nodes (kind, key, label), key being the label normalised; edges (src_kind, src, predicate, dst_kind, dst,
    confidence) between keys; evidence (src_kind, src, predicate, dst_kind, dst, source, quote).
    """

    EDGE = ["src_kind", "src", "predicate", "dst_kind", "dst"]

    def __init__(self, spark) -> None:
        of = lambda s: spark.createDataFrame([], s)
        self.nodes = of("kind string, key string, label string")
        self.aliases = of("kind string, alias string, key string")
        self.edges = of("src_kind string, src string, predicate string, dst_kind string, dst string, confidence double")
        self.evidence = of("src_kind string, src string, predicate string, dst_kind string, dst string, source string, quote string")
        self.rejected = of("kind string, key string, other string")

    def assert_nodes(self, rows: DataFrame) -> None:
        """rows (kind, label): the least label of a key stays."""
        new = rows.select("kind", normalise_label(F.col("label")).alias("key"), "label").filter("key <> ''")
        self.nodes = shared.cut(self.nodes.unionByName(new).groupBy("kind", "key").agg(F.min("label").alias("label")))

    def assert_aliases(self, rows: DataFrame) -> None:
        """rows (kind, alias, label)."""
        new = rows.select("kind", normalise_label(F.col("alias")).alias("alias"), normalise_label(F.col("label")).alias("key"))
        self.aliases = shared.cut(self.aliases.unionByName(new).groupBy("kind", "alias").agg(F.min("key").alias("key")))

    def resolve(self, rows: DataFrame) -> DataFrame:
        """rows with key: of (kind, label) as it is named or by its alias, null if unknown."""
        named = self.nodes.select("kind", F.col("key").alias("_l"), "key").unionByName(self.aliases.select("kind", F.col("alias").alias("_l"), "key"))
        known = named.groupBy("kind", "_l").agg(F.min("key").alias("key"))
        return rows.withColumn("_l", normalise_label(F.col("label"))).join(known, ["kind", "_l"], "left").drop("_l")

    def assert_triples(self, triples: DataFrame, source: str = "source") -> None:
        """triples (subject_kind, subject, predicate, object_kind, object, confidence, evidence, and a source column)."""
        ends = triples.select(F.col("subject_kind").alias("kind"), F.col("subject").alias("label")).union(triples.select("object_kind", "object"))
        named = ends.withColumn("alias", normalise_label(F.col("label"))).join(self.aliases, ["kind", "alias"], "left_anti")
        self.assert_nodes(named.select("kind", "label"))
        alias = lambda end: self.aliases.select(F.col("kind").alias(f"{end}_kind"), F.col("alias").alias(end), F.col("key").alias(f"_{end}"))
        rows = triples.select(F.col("subject_kind").alias("src_kind"), normalise_label(F.col("subject")).alias("src"), F.regexp_replace(normalise_label(F.col("predicate")), " ", "_").alias("predicate"), F.col("object_kind").alias("dst_kind"), normalise_label(F.col("object")).alias("dst"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("evidence").alias("quote"), F.col(source).cast("string").alias("source"))
        for end in ("src", "dst"):
            rows = rows.join(alias(end), [f"{end}_kind", end], "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
        rows = shared.cut(rows)
        edges = self.edges.unionByName(rows.select(*self.EDGE, "confidence"))
        self.edges = shared.cut(edges.groupBy(*self.EDGE).agg(F.max("confidence").alias("confidence")))
        quotes = rows.filter("quote is not null").select(*self.EDGE, "source", "quote")
        self.evidence = shared.cut(self.evidence.unionByName(quotes).distinct())

    def suggest(self, least: float = 0.86) -> DataFrame:
        """(kind, key, other, similarity) of pairs that were not rejected."""
        rows = numbered_nodes(self.nodes)
        pairs = suggest_merges(rows, least).select("kind", F.least(normalise_label(F.col("label")), normalise_label(F.col("other"))).alias("key"), F.greatest(normalise_label(F.col("label")), normalise_label(F.col("other"))).alias("other"), "similarity")
        return pairs.join(self.rejected, ["kind", "key", "other"], "left_anti")

    def reject(self, pairs: DataFrame) -> None:
        new = pairs.select("kind", F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other"))
        self.rejected = shared.cut(self.rejected.unionByName(new).distinct())

    def accept(self, pairs: DataFrame) -> None:
        """Merges other into key, for pairs (kind, key, other): its label becomes an alias, its edges and evidence move."""
        to = pairs.groupBy("kind", "other").agg(F.min("key").alias("to"))
        gone = to.select("kind", F.col("other").alias("key"))
        moved = to.select("kind", F.col("other").alias("alias"), F.col("to").alias("key"))
        self.nodes = shared.cut(self.nodes.join(gone, ["kind", "key"], "left_anti"))
        self.aliases = shared.cut(self.aliases.unionByName(moved).groupBy("kind", "alias").agg(F.min("key").alias("key")))

        def at(rows: DataFrame) -> DataFrame:
            for end in ("src", "dst"):
                own = to.select(F.col("kind").alias(f"{end}_kind"), F.col("other").alias(end), "to")
                rows = rows.join(own, [f"{end}_kind", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
            return rows.filter(~((F.col("src_kind") == F.col("dst_kind")) & (F.col("src") == F.col("dst"))))

        self.edges = shared.cut(at(self.edges).groupBy(*self.EDGE).agg(F.max("confidence").alias("confidence")))
        self.evidence = shared.cut(at(self.evidence).distinct())

    def neighbours(self, kind: str, label: str) -> DataFrame:
        """The edges at a node with their evidence as JSON, most confident first."""
        own = self.evidence.groupBy(*self.EDGE).agg(F.to_json(F.sort_array(F.collect_list(F.struct("source", "quote")))).alias("evidence"))
        key = normalise_label(F.lit(label))
        at = lambda end: (F.col(f"{end}_kind") == kind) & (F.col(end) == key)
        return self.edges.filter(at("src") | at("dst")).join(own, self.EDGE, "left").orderBy(F.desc("confidence"), *self.EDGE)


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """nodes (kind, key, label) as suggest_merges takes them; a hash stands for a number."""
    return nodes.select("kind", F.xxhash64("kind", "key").alias("node_id"), "label")


def crawl(table: DataFrame, rules: list[tuple[str, str, str, str, str]], graph: Graph, stop: set[str] = frozenset({"", "null", "none", "unknown", "n/a"}), source: str | None = None) -> None:
    """Puts columns of a table into a graph: rules (subject_kind, subject column, predicate, object_kind, object column).

    Values of the stop list and plain numbers name nothing and are left out.
    """
    word = lambda c: (~F.lower(F.trim(F.col(c).cast("string"))).isin(*sorted(stop))) & (~F.col(c).cast("string").rlike(r"^\s*[-+0-9.,]+\s*$"))
    parts = [
        table.filter(word(s) & word(o)).select(F.lit(sk).alias("subject_kind"), F.col(s).cast("string").alias("subject"), F.lit(p).alias("predicate"), F.lit(ok).alias("object_kind"), F.col(o).cast("string").alias("object"), F.lit(1.0).alias("confidence"), F.lit(None).cast("string").alias("evidence"), (F.col(source) if source else F.lit(None)).cast("string").alias("source"))
        for sk, s, p, ok, o in rules
    ]
    graph.assert_triples(reduce(DataFrame.unionByName, parts).distinct())


def walks(edges: DataFrame, start: int, depth: int, direction: str = "both") -> DataFrame:
    """(node, depth, nodes, edge_ids, confidence, edge_id) of every simple path of up to depth edges from start."""
    out = edges.select("edge_id", "confidence", F.col("src").alias("from"), F.col("dst").alias("node"))
    back = edges.select("edge_id", "confidence", F.col("dst").alias("from"), F.col("src").alias("node"))
    step = {"out": out, "in": back, "both": out.union(back)}[direction]
    spark = edges.sparkSession
    now = spark.createDataFrame([(start, [start], [], 1.0)], "node long, nodes array<long>, edge_ids array<long>, confidence double")
    found = []
    for d in range(1, depth + 1):
        s = step.select("from", F.col("node").alias("next"), F.col("edge_id"), F.col("confidence").alias("c"))
        now = now.join(s, now["node"] == s["from"]).filter(~F.array_contains("nodes", F.col("next")))
        now = shared.cut(now.select(F.col("next").alias("node"), F.concat("nodes", F.array("next")).alias("nodes"), F.concat("edge_ids", F.array("edge_id")).alias("edge_ids"), (F.col("confidence") * F.col("c")).alias("confidence")))
        found.append(now.withColumn("depth", F.lit(d)).withColumn("edge_id", F.element_at("edge_ids", -1)))
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f)
    return rows


def paths(edges: DataFrame, start: int, end: int, depth: int = 3, limit: int = 100) -> DataFrame:
    """Simple paths between two nodes, shortest first, then by their edges."""
    key = F.array_join("edge_ids", ",")
    return walks(edges, start, depth).filter(F.col("node") == end).select("depth", key.alias("edges")).orderBy("depth", "edges").limit(limit)


def context(edges: DataFrame, start: int, depth: int = 2, most: int = 25, decay: float = 0.85) -> DataFrame:
    """The edges around a node, scored by the product of confidences, less for each hop; the best path of each."""
    w = walks(edges, start, depth).withColumn("score", F.col("confidence") * F.pow(F.lit(decay), F.col("depth") - 1))
    return w.groupBy("edge_id").agg(F.max("score").alias("score"), F.min("depth").alias("depth")).orderBy(F.desc("score"), "edge_id").limit(most)


def related(entities: DataFrame, doc: int, k: int) -> DataFrame:
    """Documents that share entities (doc_id, entity) with one: the sum of ln((N + 1) / (df + 0.5))."""
    rows = entities.distinct()
    n = rows.select("doc_id").distinct().count()
    df = rows.groupBy("entity").agg(F.count("*").alias("df"))
    own = rows.filter(F.col("doc_id") == doc).select("entity").join(df, "entity")
    met = rows.filter(F.col("doc_id") != doc).join(own, "entity")
    score = F.sum(F.log((n + 1) / (F.col("df") + 0.5)))
    return met.groupBy("doc_id").agg(score.alias("score"), F.count("*").alias("n_shared")).orderBy(F.desc("score"), "doc_id").limit(k)


def neighbours(edges: DataFrame, start: int, depth: int = 1, direction: str = "both") -> DataFrame:
    """(depth, edge_id, src, predicate, dst, node, confidence) of all simple paths' last edges, by depth, confidence and edge."""
    w = walks(edges, start, depth, direction).select("depth", "edge_id", "node", F.col("confidence").alias("path_confidence"))
    return w.join(edges, "edge_id").select("depth", "edge_id", "src", "predicate", "dst", "node", "confidence").orderBy("depth", F.desc("confidence"), "edge_id", "node")
