"""Chapter store, positions, failures and retries.

chapter_store: book_id, url, content, cached_at. book_index: book_id, index_url, urls, last_updated,
last_accessed. positions: reader, url, percent, updated_at. Ages are in seconds.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T

DAY = 86_400
MOST_AGE = 30 * DAY
POSITIONS, CHAPTERS, FAILURES, EVENTS = 200, 500, 200, 50
#: What stored chapters are merged by, and into how many parts a bucket is dealt for it.
KEYS, PARTS = ["book_bucket", "part", "book_id", "url"], 16
RETRIED = [500, 502, 503, 504]
LONGEST_WAIT = 60.0


def _age(ts: Column, now: Column) -> Column:
    return (F.unix_micros(now) - F.unix_micros(ts)) / 1e6


class ChapterStore:
    """Chapters in a folder, one record per (book, url), updated by merging.

    A write reads the buckets that it touches, keeps the newest record of each (book, url), and writes
    these buckets anew under rows/generation=<id>. A manifest, one small file that lists the
    generation of each bucket, is then renamed into place under the next number; nobody's files are
    changed, so readers go on with the manifest they began with. Of two writers that began with the
    same manifest, the second fails and can be run again. ``vacuum`` deletes what no recent
    manifest lists.

    chapters: book_id string, url string, content string, cached_at timestamp. Of records with equal
    times the later write's is kept, within one write that of the greater content; one without a time
    is older than any. Rows without book_id or url are ignored.
    """

    SCHEMA = "book_id string, url string, content string, cached_at timestamp"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm.org.apache.hadoop.fs
        self._path, conf = jvm.Path, spark._jsc.hadoopConfiguration()
        self._files = jvm.Path(self.path).getFileSystem(conf)
        self._context = jvm.FileContext.getFileContext(self._files.getUri(), conf)
        self._no_options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)

    def _list(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(at)] if self._files.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._list("manifest") if n[:-5].isdigit() and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """(version, generation of each bucket); version 0 is the empty store."""
        version = version if version is not None else max(self.versions(), default=0)
        if not version:
            return 0, {}
        line = self.spark.read.text(f"{self.path}/manifest/{version}.json").first()[0]
        return version, {int(k): v for k, v in json.loads(line).items()}

    def _commit(self, version: int, generations: dict[int, str]) -> int:
        temporary = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self._files.create(temporary, False)
        out.write(bytearray(json.dumps(generations).encode()))
        out.close()
        try:  # fails if another writer has taken the number
            self._context.rename(temporary, self._path(f"{self.path}/manifest/{version + 1}.json"), self._no_options)
        except Py4JJavaError as e:
            self._files.delete(temporary, False)
            raise RuntimeError(f"another write became version {version + 1}; run this one again") from e
        return version + 1

    def _bucket(self, book_id: Column) -> Column:
        return F.pmod(F.xxhash64(book_id), F.lit(self.buckets)).cast("int")

    def _parted(self, rows: DataFrame) -> DataFrame:
        """Rows with their bucket and part, shuffled by them: merging, removing and writing need no
        further shuffle, and a bucket of any size is the work of PARTS tasks."""
        parts = {"book_bucket": self._bucket(F.col("book_id")), "part": F.pmod(F.xxhash64("url"), F.lit(PARTS)).cast("int")}
        return rows.withColumns(parts).repartition("book_bucket", "part")

    def _rows(self, generations: dict[int, str]) -> DataFrame:
        paths = [f"{self.path}/rows/generation={g}/book_bucket={b}" for b, g in sorted(generations.items()) if g]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("basePath", f"{self.path}/rows").parquet(*paths).select("book_id", "url", "content", "cached_at")

    def _replace(self, make, touched: list[int], version: int, generations: dict[int, str]) -> int:
        """Writes make(stored rows of the touched buckets), parted, as their new generation."""
        if not touched:
            return version
        generation = uuid.uuid4().hex
        rows = make(self._rows({b: generations.get(b, "") for b in touched}))
        rows.select("book_id", "url", "content", "cached_at", "book_bucket").write.partitionBy("book_bucket").parquet(f"{self.path}/rows/generation={generation}")
        written = {int(n.split("=")[1]) for n in self._list(f"rows/generation={generation}") if n.startswith("book_bucket=")}
        if not written <= set(touched):
            raise RuntimeError("the chapters changed while they were read; run this write again")
        return self._commit(version, {b: g for b, g in generations.items() if b not in touched} | dict.fromkeys(sorted(written), generation))

    def write(self, chapters: DataFrame) -> int:
        """Merges the chapters in; the new version. They are read twice: for their buckets and themselves."""
        version, generations = self.manifest()
        new = chapters.where("book_id is not null and url is not null and url <> ''").select(F.col("book_id").cast("string").alias("book_id"), "url", "content", F.col("cached_at").cast("timestamp").alias("cached_at"))
        touched = [r[0] for r in new.select(self._bucket(F.col("book_id"))).distinct().collect()]  # ``buckets`` rows at most

        def merged(old: DataFrame) -> DataFrame:
            both = old.withColumn("source", F.lit(0)).unionByName(new.withColumn("source", F.lit(1)))
            best = self._parted(both).groupBy(*KEYS).agg(F.max(F.struct("cached_at", "source", "content")).alias("x"))
            return best.select(*KEYS, "x.content", "x.cached_at")

        return self._replace(merged, touched, version, generations)

    def remove(self, chapters: DataFrame) -> int:
        """Takes the chapters (book_id, url) out; the new version."""
        version, generations = self.manifest()
        gone = chapters.select(F.col("book_id").cast("string").alias("book_id"), "url")
        touched = [r[0] for r in gone.select(self._bucket(F.col("book_id"))).distinct().collect() if r[0] in generations]
        return self._replace(lambda old: self._parted(old).join(self._parted(gone), KEYS, "left_anti"), touched, version, generations)

    def read(self, book_id: str | None = None, version: int | None = None) -> DataFrame:
        """Stored chapters of the newest or a given version; of one book, only its bucket is read."""
        _, generations = self.manifest(version)
        if book_id is None:
            return self._rows(generations)
        bucket = self.spark.range(1).select(self._bucket(F.lit(book_id))).first()[0]
        return self._rows({b: g for b, g in generations.items() if b == bucket}).where(F.col("book_id") == book_id)

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` manifests and the generations that those do not list."""
        versions = self.versions()
        used = {g for v in versions[-keep:] for g in self.manifest(v)[1].values()}
        for name in self._list("rows"):
            if name.removeprefix("generation=") not in used:
                self._files.delete(self._path(f"{self.path}/rows/{name}"), True)
        for v in versions[:-keep]:
            self._files.delete(self._path(f"{self.path}/manifest/{v}.json"), False)


def write_chapters(chapters: DataFrame, path: str, buckets: int = 64) -> int:
    """Merges chapters into the store at path; the new version."""
    return ChapterStore(chapters.sparkSession, path, buckets).write(chapters)


def read_chapters(spark: SparkSession, path: str, book_id: str | None = None, buckets: int = 64) -> DataFrame:
    """Stored chapters; for one book, only its bucket is read."""
    return ChapterStore(spark, path, buckets).read(book_id)


def build_book_index(store: DataFrame, now: Column) -> DataFrame:
    """Per book the sorted set of URLs; both times are now."""
    return store.where("url is not null").groupBy("book_id").agg(F.array_sort(F.collect_set("url")).alias("urls")).select("book_id", "urls", now.alias("last_updated"), now.alias("last_accessed"))


def trim_newest(rows: DataFrame, keys: list[str], ts: str, n: int, *ties: str) -> DataFrame:
    """The n newest rows of each key; ties by the columns given."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts), *(F.desc(t) for t in ties)))
    return rows.withColumn("k", k).where(F.col("k") <= n).drop("k")


def expired_books(index: DataFrame, protected: DataFrame, now: Column) -> DataFrame:
    """Books without a valid index row, or idle for over 30 days and not protected (book_id)."""
    idle = _age(F.coalesce("last_accessed", "last_updated"), now)
    bad = F.col("urls").isNull() | F.coalesce("last_accessed", "last_updated").isNull()
    return index.where(bad | (idle > MOST_AGE)).join(protected.select("book_id").distinct(), "book_id", "left_anti").select("book_id").distinct()


def expire_books(index: DataFrame, store: DataFrame, protected: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(index, store) without expired books and the chapters that they list."""
    gone = expired_books(index, protected, now)
    listed = index.join(gone, "book_id", "left_semi").select("book_id", F.explode("urls").alias("url")).distinct()
    return index.join(gone, "book_id", "left_anti"), store.join(listed, ["book_id", "url"], "left_anti")


def orphan_chapters(store: DataFrame, index: DataFrame, protected: DataFrame, now: Column) -> DataFrame:
    """Chapters that no index row lists, over 30 days old and not of a protected book; a record
    without content or time is always one."""
    listed = index.select("book_id", F.explode("urls").alias("url")).distinct()
    loose = store.join(listed, ["book_id", "url"], "left_anti")
    broken = F.col("content").isNull() | F.col("cached_at").isNull()
    safe = protected.select("book_id").distinct().withColumn("safe", F.lit(True))
    return loose.join(safe, "book_id", "left").where(broken | ((_age(F.col("cached_at"), now) > MOST_AGE) & F.col("safe").isNull())).drop("safe")


def touch_books(index: DataFrame, accesses: DataFrame) -> DataFrame:
    """last_accessed moves at most once a day. accesses: book_id, ts."""
    last = accesses.groupBy("book_id").agg(F.max("ts").alias("ts"))
    moved = F.col("ts").isNotNull() & F.coalesce(_age(F.col("last_accessed"), F.col("ts")) >= DAY, F.lit(True))
    return index.join(last, "book_id", "left").withColumn("last_accessed", F.when(moved, F.col("ts")).otherwise(F.col("last_accessed"))).drop("ts")


def delete_book(store: DataFrame, index: DataFrame, book: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C20: (store, index) without the books given: their listed chapters, or all of a book that has no index."""
    listed = index.join(book, "book_id", "left_semi").select("book_id", F.explode("urls").alias("url")).distinct()
    unlisted = book.join(index, "book_id", "left_anti").select("book_id").distinct()
    return store.join(listed, ["book_id", "url"], "left_anti").join(unlisted, "book_id", "left_anti"), index.join(book, "book_id", "left_anti")


def evict_locked(index: DataFrame, locked: DataFrame) -> DataFrame:
    """Index rows without URLs now locked (book_id, url); rows that become empty go."""
    per = locked.groupBy("book_id").agg(F.collect_set("url").alias("locked"))
    rows = index.join(per, "book_id", "left").withColumn("urls", F.when(F.col("locked").isNotNull(), F.array_except("urls", "locked")).otherwise(F.col("urls")))
    return rows.where(F.size("urls") > 0).drop("locked")


def merge_positions(*sources: DataFrame, keep: int = POSITIONS) -> DataFrame:
    """Per reader and URL the newest position, of equal times that of the later source,
    then the newest of each reader. Rows without a URL or a number are ignored."""
    rows = reduce(DataFrame.unionByName, (s.select("reader", "url", "percent", "updated_at", F.lit(k).alias("source")) for k, s in enumerate(sources)))
    rows = rows.withColumn("percent", T.percent(F.col("percent"))).where("url is not null and url <> '' and percent is not null and updated_at is not null")
    best = rows.groupBy("reader", "url").agg(F.max(F.struct("updated_at", "source", "percent")).alias("x"))
    return trim_newest(best.select("reader", "url", "x.percent", "x.updated_at"), ["reader"], "updated_at", keep, "url")


def navigation_failures(events: DataFrame) -> DataFrame:
    """Per key the failures since the last success: count, failed_at. events: key, ts, failed."""
    last = F.max(F.when(~F.col("failed"), F.col("ts")))
    since = events.groupBy("key").agg(last.alias("success"))
    rows = events.join(since, "key").where("failed and (success is null or ts > success)")
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("failed_at"))


def retry_plan(log: DataFrame) -> DataFrame:
    """What follows each attempt. log: url, ts, id, status, error, retry_after (seconds).

    Up to three attempts on network errors, timeouts and 500, 502, 503, 504, with 2 s * 2^n and up to
    a fifth more, derived from the URL and attempt; one recovery from 429; no wait over 60 s."""
    per = Window.partitionBy("url").orderBy("ts", "id")
    rows = log.withColumns({"attempt": F.row_number().over(per), "limited": F.count_if(F.col("status") == 429).over(per.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    part = F.pmod(F.crc32(F.concat_ws(":", "url", F.col("attempt").cast("string")).cast("binary")), F.lit(200)) / 1000
    wait = F.coalesce(F.col("retry_after"), 2 * F.pow(F.lit(2.0), F.col("attempt") - 1)) * (1 + part)
    again = (F.col("status").isin(RETRIED) | F.col("error").isin("network", "timeout")) & (F.col("attempt") < 3)
    recover = (F.col("status") == 429) & (F.col("limited") == 1)
    action = F.when(F.coalesce(F.col("status").between(200, 399), F.lit(False)), "done").when(F.coalesce(again | recover, F.lit(False)) & (wait <= LONGEST_WAIT), "retry").otherwise("stop")
    return rows.select("url", "attempt", action.alias("action"), F.when(action == "retry", wait).alias("wait"))


def cache_progress(plan: DataFrame, results: DataFrame) -> DataFrame:
    """Per catalog: total, done (locked pages too), failed. plan: toc_id, url; results: url, outcome."""
    rows = plan.join(results, "url", "left")
    return rows.groupBy("toc_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("outcome").isin("ok", "locked")).alias("done"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def failed_urls(plan: DataFrame, results: DataFrame) -> DataFrame:
    """What a second run tries again."""
    return plan.join(results.where("outcome = 'failed'").select("url").distinct(), "url", "left_semi")


def crawl_frontier(plan: DataFrame, edges: DataFrame, seen: DataFrame, stops: DataFrame) -> DataFrame:
    """C17: URLs to load next: planned ones, then next links of loaded pages, without seen and stop
    URLs. plan: url, ord; edges: src_url, dst_url; seen, stops: url."""
    queued = plan.select("url", F.lit(0).alias("rank"), "ord")
    parsed = edges.join(seen.select(F.col("url").alias("src_url")).distinct(), "src_url", "left_semi").select(F.col("dst_url").alias("url"), F.lit(1).alias("rank"), F.lit(0).cast("int").alias("ord"))
    rows = queued.unionByName(parsed).where("url is not null").groupBy("url").agg(F.min(F.struct("rank", "ord")).alias("x"))
    return rows.join(seen.select("url").distinct(), "url", "left_anti").join(stops.select("url").distinct(), "url", "left_anti").select("url", "x.rank", "x.ord")


def reciprocal_navigation(edges: DataFrame) -> DataFrame:
    """Previous links whose target's next link leads back, or which has no previous link and so
    cannot be told. edges: src_url, rel, dst_url."""
    back = edges.where("rel = 'next'").select(F.col("src_url").alias("dst_url"), F.col("dst_url").alias("src_url")).distinct().withColumn("back", F.lit(True))
    rows = edges.where("rel = 'prev'").join(back, ["src_url", "dst_url"], "left")
    forward = edges.where("rel = 'next'").select(F.col("src_url").alias("dst_url")).distinct().withColumn("has_next", F.lit(True))
    rows = rows.join(forward, "dst_url", "left")
    return rows.select("src_url", "dst_url", (F.col("back").isNotNull()).alias("reciprocal"), (F.col("back").isNotNull() | F.col("has_next").isNull()).alias("valid"))
