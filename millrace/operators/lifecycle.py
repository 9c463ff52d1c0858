"""The life of stored tables: sync from a source, compaction, refresh, policies that a tick acts on, hot copies."""

from __future__ import annotations

from collections import OrderedDict

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import timetravel


class Store:
    """A table of generations in a folder: rows/generation=N and deletes/generation=N, Parquet.

    Writers add whole generations; readers ask for one or for the newest. A snapshot table shows one generation
    alone, an appended one all until then.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder, key

    def _read(self, part: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        fs = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{part}") if fs.exists(path) else None

    def rows(self) -> DataFrame | None:
        return self._read("rows")

    def newest(self) -> int:
        rows = self.rows()
        return 0 if rows is None else int(rows.agg(F.max("generation")).first()[0] or 0)

    def append(self, df: DataFrame) -> int:
        g = self.newest() + 1
        df.write.parquet(f"{self.folder}/rows/generation={g}")
        return g

    def delete(self, keys: DataFrame) -> None:
        keys.select(self.key).write.mode("append").parquet(f"{self.folder}/deletes/generation={self.newest()}")

    def table(self) -> DataFrame:
        """What an appended table shows now."""
        rows, deletes = self.rows(), self._read("deletes")
        if deletes is None:
            return rows.drop("generation")
        return timetravel.as_of(rows, deletes, self.key, self.newest()).drop("generation")

    def snapshot(self) -> DataFrame:
        return timetravel.snapshot(self.rows(), self.newest()).drop("generation")

    def between(self, low: int, high: int) -> DataFrame:
        """Rows written after generation low and up to high: what an export of a range holds."""
        return self.rows().filter((F.col("generation") > low) & (F.col("generation") <= high))

    def statistics(self) -> dict[str, int]:
        """Files, tombstones and generations, which pressure is measured by."""
        rows, deletes = self.rows(), self._read("deletes")
        files = rows.select("_metadata.file_path").distinct().count() if rows is not None else 0
        return {"files": files, "tombstones": deletes.count() if deletes is not None else 0, "generations": self.newest()}

    def rebuild(self, cluster_by: list[str] | None = None, rows_per_file: int = 5_000_000) -> "Store":
        """A store with the visible rows as one generation, in sorted ranges of about so many rows; this one stays as it is."""
        now = self.table()
        n = max(1, -(-now.count() // rows_per_file))
        order = cluster_by or [self.key]
        new = Store(self.spark, f"{self.folder}-rebuilt-{self.newest()}", self.key)
        new.append(now.repartitionByRange(n, *order).sortWithinPartitions(*order))
        return new


def sync_plan(source: DataFrame, store: Store) -> list[tuple[str, str, str]]:
    """(column, type, action): what sync would do to each column, add, keep, cast or null."""
    have = dict(store.rows().drop("generation").dtypes) if store.rows() is not None else {}
    out = [(c, have.get(c, t), "add" if c not in have else "keep" if have[c] == t else "cast") for c, t in source.dtypes]
    return out + [(c, t, "null") for c, t in have.items() if c not in dict(source.dtypes)]


def sync_table(source: DataFrame, store: Store, dry_run: bool = False) -> tuple[int, list[tuple[str, str, str]]]:
    """Loads a source as the next snapshot: new columns are added, known ones cast to their type, lost ones null."""
    plan = sync_plan(source, store)
    if dry_run:
        return store.newest(), plan
    columns = [(F.lit(None) if action == "null" else F.col(c)).cast(t).alias(c) for c, t, action in plan]
    return store.append(source.select(*columns)), plan


def actions(tables: DataFrame, budget: int | None = None) -> DataFrame:
    """tables with action and reason, most drift times demand first, and whether the budget lets it act.

    Of each table: name, files, tombstones, dirty, drift_rows, rows, scans, and of its policy max_files,
    max_tombstones, full_ratio (null: no bound). Too many files or tombstones ask for a rebuild, and so does drift
    of full_ratio or more, or no baseline; less drift is refreshed; clean tables are left alone.
    """
    ratio = F.try_divide("drift_rows", "rows")
    files = F.coalesce(F.col("files") >= F.col("max_files"), F.lit(False))
    stones = F.coalesce(F.col("tombstones") >= F.col("max_tombstones"), F.lit(False))
    far = F.coalesce(ratio >= F.col("full_ratio"), F.lit(False))
    action = F.when(files | stones, "full").when(~F.col("dirty"), "skip").when(ratio.isNull() | far, "full").otherwise("delta")
    reason = F.when(files, "file fanout").when(stones, "tombstones").when(~F.col("dirty"), "clean").when(ratio.isNull(), "no baseline").when(far, "drift").otherwise("dirty")
    rank = F.col("drift_rows") * (1 + F.col("scans"))
    out = tables.select("name", action.alias("action"), reason.alias("reason"), rank.cast("long").alias("priority"))
    acting = out.filter("action <> 'skip'").orderBy(F.desc("priority"), "name")
    chosen = (acting.limit(budget) if budget is not None else acting).select("name", F.lit(True).alias("acts"))
    return out.join(chosen, "name", "left").withColumn("acts", F.coalesce("acts", F.lit(False)))


def run_tick(stores: dict[str, Store], sources: dict[str, DataFrame], policies: dict[str, dict], scans: dict[str, int] | None = None, budget: int | None = None, dry_run: bool = False) -> list[tuple[str, str]]:
    """Measures each table, ranks them and acts within the budget: what was done (name, action)."""
    if not stores:
        return []
    rows = []
    for name, store in stores.items():
        p, s = policies.get(name, {}), store.statistics()
        n = store.table().count() if store.newest() else None
        fresh = sources[name].join(store.table().select(store.key), store.key, "left_anti").count() if n is not None else sources[name].count()
        rows.append((name, s["files"], s["tombstones"], fresh > 0, fresh, n, (scans or {}).get(name, 0), p.get("max_files"), p.get("max_tombstones"), p.get("full_ratio", 0.5)))
    spark = next(iter(stores.values())).spark
    table = spark.createDataFrame(rows, "name string, files long, tombstones long, dirty boolean, drift_rows long, rows long, scans long, max_files long, max_tombstones long, full_ratio double")
    done = []
    for r in actions(table, budget).filter("acts").orderBy(F.desc("priority"), "name").collect():  # a row for each table
        done.append((r.name, r.action))
        if dry_run:
            continue
        store = stores[r.name]
        fresh = sources[r.name].join(store.table().select(store.key), store.key, "left_anti") if store.newest() else sources[r.name]
        if not fresh.isEmpty():
            store.append(fresh)
        if r.action == "full":
            stores[r.name] = store.rebuild()
    return done


class HotTables:
    """Copies of tables in memory up to a number of bytes by the optimiser's estimate; the least used goes first."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.held: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    def load(self, name: str, table: DataFrame, columns: list[str] | None = None) -> DataFrame:
        self.evict(name)
        df = table.select(*columns) if columns else table
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        while self.held and sum(s for _, s in self.held.values()) + size > self.most:
            self.evict(next(iter(self.held)))
        if size <= self.most:
            self.held[name] = (df.persist(StorageLevel.MEMORY_AND_DISK), size)
        return df

    def get(self, name: str) -> DataFrame | None:
        if name not in self.held:
            return None
        self.held.move_to_end(name)
        return self.held[name][0]

    def evict(self, name: str) -> bool:
        if name not in self.held:
            return False
        self.held.pop(name)[0].unpersist()
        return True

    def status(self) -> list[tuple[str, int]]:
        return [(n, s) for n, (_, s) in self.held.items()]


def value_bitmaps(table: DataFrame, row: str, column: str) -> DataFrame:
    """(value, bucket, bits): which rows (row long) hold each value; filters are then answered from bits alone."""
    k = F.col(row).cast("long")
    return table.groupBy(F.col(column).alias("value"), F.bitmap_bucket_number(k).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"))


def bitmap_count(bitmaps: DataFrame, wanted: Column) -> DataFrame:
    """n: rows whose value fits, from the bitmaps of those values."""
    return bitmaps.filter(wanted).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits")).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def retained(rows: DataFrame, generations: DataFrame, cutoff: str, floor: int) -> tuple[DataFrame, DataFrame]:
    """(kept, reaped generations) of a snapshot table: those older than cutoff and below the floor go, the newest never."""
    newest = rows.agg(F.max("generation")).first()[0]
    gone = generations.filter((F.col("time") < F.lit(cutoff).cast("timestamp")) & (F.col("generation") < floor) & (F.col("generation") < F.lit(newest))).select("generation")
    return rows.join(gone, "generation", "left_anti"), gone


def file_layout(df: DataFrame) -> DataFrame:
    """file, n_rows, bytes of each file of a scanned table."""
    return df.select("_metadata.file_path", "_metadata.file_size").groupBy(F.col("file_path").alias("file")).agg(F.count("*").alias("n_rows"), F.first("file_size").alias("bytes"))


