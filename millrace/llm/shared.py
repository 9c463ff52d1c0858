"""What several corpus operators need: the shared folder, written tables, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Unset, a temporary one serves local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="millrace-"))
    return _own_folder[0]


def bound_batches(spark: SparkSession) -> None:
    """Whole texts pass to Python in batches of 8 MB (one row at least), unless the session sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == "67108864b":
        spark.conf.set(key, "8m")


def trim() -> None:
    """In a worker: gives memory that is no longer used back to the system.

    Workers are kept for later tasks, and what one stage held would else count while the next ones run. Large
    blocks are mapped by themselves from the first call on, so that they go back at once.
    """
    global _libc
    if _libc is None:
        try:
            _libc = ctypes.CDLL(None)
            _libc.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD
            _libc.malloc_trim
        except (OSError, AttributeError):  # another C library
            _libc = False
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


_libc = None


def trimmed(run):
    """run, a function of batches, with trim() before and after."""

    def go(batches):
        trim()
        yield from run(batches)
        trim()

    return go


def scratch_path(spark: SparkSession, label: str) -> str:
    bound_batches(spark)
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read again: lineage ends, and executors may be lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


class scope:
    """Tables written within are removed at its end, but for those given to keep(), which what is returned reads."""

    def __enter__(self) -> scope:
        self.kept: set[int] = set()
        _scopes.append([])
        return self

    def keep(self, *tables: DataFrame) -> None:
        self.kept.update(map(id, tables))

    def __exit__(self, *_) -> None:
        tables = _scopes.pop()
        for t in tables:
            if id(t) in self.kept:
                if _scopes:  # the scope around may have no use for it
                    _scopes[-1].append(t)
            else:
                discard(t)


def discard(df: DataFrame) -> None:
    """Remove a table that written() made and nothing reads any more."""
    path = getattr(df, "_millrace_path", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


#: Rows of a few numbers each that are small enough to broadcast.
BROADCAST_ROWS = 1_000_000


def join_narrow(wide: DataFrame, narrow: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join with a written table of a few numbers a row: broadcast if it has BROADCAST_ROWS at most, else shuffled.

    So whole texts are only shuffled where the table is too large to go to each of them.
    """
    return wide.join(F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow, key, how)


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """Names like labels for helper columns that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for label in labels:
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        out.append(label)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def partitions_for(df: DataFrame, most: int) -> int:
    """As many partitions as the input's size, estimated from its files, needs for most bytes each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(shuffle_partitions(df.sparkSession), min(-(-size // most), 100_000))


class Forest:
    """Union-find over arbitrary 64-bit node ids; the smallest id of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def stars(self) -> tuple[list[int], list[int]]:
        pairs = [(x, r) for x in list(self.up) if (r := self.find(x)) != x]
        return [p[0] for p in pairs], [p[1] for p in pairs]


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(x, y)
    a, b = forest.stars()
    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a long, b long); a component is its smallest node.

    Each task first contracts the edges it holds into stars. Alternating large-star and small-star
    steps then need a number of rounds logarithmic in the longest remaining path. Every round is a
    written table, so a lost executor repeats one round at most. A node with very many neighbours is
    pre-aggregated before its minimum is joined back, and the two joins read written tables or plain
    exchanges, so adaptive execution can split it. Nodes without an edge don't appear.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    stars = written(edges.mapInArrow(_local_stars, "a long, b long").distinct(), "stars")
    seen = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                stars.select("b", "b").distinct()
            )
        seen = now
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        discard(stars)
        stars = after


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column as one array, and each row's offsets in it; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]
