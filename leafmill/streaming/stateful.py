"""Keyed stream processors (R1, R4, R6) and stream plans.

Processors keep small values per key: a chapter's cursor and a map of its waiting pages (as many as
the page cap), an origin's cooldown, a target's failures. They need the RocksDB state store, which
``with_state_store`` sets for the session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.functions import text as T
from leafmill.functions import urls as U

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = StructType([StructField("json", StringType())])
SECTIONS_OUT = "key string, stage string, ord int, loaded int, total int, content string, truncated boolean"
COOLDOWNS_OUT = "origin string, status int, until double"
FAILURES_OUT = "reader string, target string, n int, failed_at double"
MOST_SECTIONS, MOST_FAILURES = 99, 200
SLOW_DOWN, SLOW_DOWN_AGAIN = 30.0, 60.0


def with_state_store(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark


class _JsonState(StatefulProcessor):
    """A processor whose state is one small JSON value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", STATE)

    def load(self, empty: dict) -> dict:
        found = self.value.get() if self.value.exists() else None
        return json.loads(found[0]) if found else empty

    def save(self, value: dict) -> None:
        self.value.update((json.dumps(value),))

    def close(self) -> None:
        pass


def _rows(rows: Iterator[pd.DataFrame], *by: str) -> list[dict]:
    frames = [f for f in rows if len(f)]
    return pd.concat(frames).sort_values(list(by), kind="stable").to_dict("records") if frames else []


class SectionAssembly(StatefulProcessor):
    """Pages of a chapter in any order -> first, then deltas in order, then complete.

    Input: key, section, content, marker_page, marker_total, last (no page follows), cancel, ts (the
    event time). A page before its turn waits as an entry of a map, of MOST_SECTIONS - 1 at most: one
    numbered outside 1..MOST_SECTIONS is refused, and so is a second of a number (the first to come
    stays). A mark that contradicts ends the chapter as truncated. So does quiet: when the watermark
    is ``quiet`` seconds behind the chapter's newest page, it is closed, and pages that still wait
    behind a gap are dropped. Nothing truncated comes out as whole. What a closed chapter still gets is
    ignored; its last trace is forgotten after another quiet time. A cancel counts after the pages
    that came with it.

    Stages: first, delta, complete (truncated or not), cancel, and refused (ord: the page's number)."""

    CURSOR = "next int, total int, done boolean, newest long"
    PAGE = "content string, mark int, total int, last boolean"

    def __init__(self, quiet: float = 600.0):
        self.quiet = int(quiet * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", self.CURSOR)
        self.waiting = handle.getMapState("waiting", "section int", self.PAGE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.cursor.exists()
        following, total, done, newest = self.cursor.get() if known else (1, None, False, 0)
        cancelled, out = False, []
        # each call of the state is a round trip, so what waits is read once and written once
        held = {k[0]: tuple(v) for k, v in self.waiting.iterator()} if known and not done else {}
        waiting = dict(held)

        def emit(stage: str, content: str = "", truncated: bool = False, place: int | None = None) -> None:
            out.append((key[0], stage, following - 1 if place is None else place, following - 1, total, content, truncated))

        for frame in rows:
            newest = max([newest, *(int(t.timestamp() * 1000) for t in frame["ts"] if t is not None and t == t)])
            for row in frame.to_dict("records"):
                section = _int(row["section"])
                cancelled = cancelled or bool(row["cancel"])
                if done or row["cancel"]:
                    continue
                if section is None or not 1 <= section <= MOST_SECTIONS:
                    emit("refused", place=section)
                elif section >= following and section not in waiting:
                    waiting[section] = (row["content"], _int(row["marker_page"]), _int(row["marker_total"]), bool(row["last"]))
                while not done and following in waiting:
                    content, mark, said, last = waiting.pop(following)
                    if (mark is not None and mark != following) or (said is not None and total is not None and said != total):
                        done = True
                        emit("complete", truncated=True)
                        break
                    total = total if said is None else said
                    following += 1
                    emit("first" if following == 2 else "delta", content)
                    if last or following - 1 == total:
                        done = True
                        emit("complete", truncated=total is not None and following - 1 < total)
                    elif following > MOST_SECTIONS:
                        done = True
                        emit("complete", truncated=True)
        if cancelled and not done:
            done = True
            emit("cancel")
        if done and held:
            self.waiting.clear()
        elif not done:
            for k in held.keys() - waiting.keys():
                self.waiting.removeKey((k,))
            for k in waiting.keys() - held.keys():
                self.waiting.updateValue((k,), waiting[k])
        self.cursor.update((following, total, done, newest))
        self._wake(max(newest, timerValues.getCurrentWatermarkInMs()) + self.quiet, known)
        if out:
            yield _sections_frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        following, total, done, newest = self.cursor.get()
        if done:
            self.cursor.clear()
            return
        self.waiting.clear()
        self.cursor.update((following, total, True, newest))
        self._wake(timerValues.getCurrentWatermarkInMs() + self.quiet)
        yield _sections_frame([(key[0], "complete", following - 1, following - 1, total, "", True)])

    def _wake(self, at: int, known: bool = True) -> None:
        """One timer for a chapter, moved on by each page; one that is not known has none yet."""
        for old in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)


def _sections_frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "stage", "ord", "loaded", "total", "content", "truncated"]).astype({"ord": "Int32", "loaded": "int32", "total": "Int32"})


def _int(x) -> int | None:
    return None if x is None or x != x else int(x)


class Cooldowns(_JsonState):
    """Responses of an origin -> until when it is left alone (seconds). 429 waits for what it says,
    or 30 s, and 60 s from the second on; 503 only for what it says; a wait is never shortened.

    Input: origin, status, retry_after (seconds or null), ts (seconds)."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s = self.load({"until": 0.0, "limited": 0})
        status = 0
        for row in _rows(rows, "ts"):
            ts, after = float(row["ts"]), row["retry_after"]
            after = None if after is None or after != after else float(after)
            if ts >= s["until"] and row["status"] == 200:
                s["limited"] = 0
            if row["status"] == 429:
                s["limited"] += 1
                after = after if after is not None else SLOW_DOWN if s["limited"] < 2 else SLOW_DOWN_AGAIN
            elif row["status"] != 503:
                after = None
            if after is not None:
                status = int(row["status"])
                s["until"] = max(s["until"], ts + after)
        self.save(s)
        if status:
            yield pd.DataFrame({"origin": [key[0]], "status": pd.array([status], "int32"), "until": [s["until"]]})


class NavigationFailures(_JsonState):
    """A reader's failed targets: failures of each since its last success, of MOST_FAILURES
    targets at most; the one whose last failure is oldest gives way (then the smaller name) and begins
    anew if it fails again. Input: reader, target, failed, ts (seconds).

    What comes out is what a batch has changed: n is 0 for a target that was cleared or gave way.
    A failure that is not newer than the target's last known event counts for nothing; so the order
    of rows matters only for rows that are late across batches."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, changed = self.load({}), {}
        # of equal times a success comes last: a failure that is not newer counts for nothing
        for row in _rows((f[["target", "failed", "ts"]].assign(ok=~f["failed"].astype(bool)) for f in rows), "ts", "target", "ok"):
            target, ts = row["target"], float(row["ts"])
            n, at = s.get(target, (0, float("-inf")))
            if n and ts < at:
                continue
            if row["failed"]:
                s[target] = (n + 1, ts)
                if len(s) > MOST_FAILURES:
                    oldest = min(s, key=lambda t: (s[t][1], t))
                    del s[oldest]
                    changed[oldest] = (0, 0.0)
            else:
                s.pop(target, None)
            changed[target] = s.get(target, (0, 0.0))
        self.save(s)
        if changed:
            yield pd.DataFrame({"reader": key[0], "target": list(changed), "n": pd.array([n for n, _ in changed.values()], "int32"), "failed_at": [at for _, at in changed.values()]})


class Generations(StatefulProcessor):
    """Results of a view that a newer one has replaced are dropped.

    Input: key, generation, ts (the event time) and any further columns, which come out unchanged.
    Rows of a batch go by time; one of a generation below the newest seen so far is stale. Rows later
    than the watermark are dropped by Spark, and a key that is quiet for ``quiet`` seconds is
    forgotten."""

    def __init__(self, quiet: float = 86_400.0):
        self.quiet = int(quiet * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "generation long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, last = self.newest.get()[0] if self.newest.exists() else None, timerValues.getCurrentWatermarkInMs()
        frames = [f for f in rows if len(f)]
        frame = pd.concat(frames).sort_values(["ts", "generation"], kind="stable")
        so_far = frame["generation"].cummax()
        so_far = so_far if newest is None else so_far.clip(lower=newest)
        self.newest.update((int(so_far.iloc[-1]),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(max(last, int(frame["ts"].iloc[-1].timestamp() * 1000)) + self.quiet)
        kept = frame[frame["generation"] >= so_far]
        if len(kept):
            yield kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        return iter(())


def stream_sections(pages: DataFrame, quiet: float = 600.0, lateness: str = "1 minute") -> DataFrame:
    """R1; pages with ts, the event time."""
    return pages.withWatermark("ts", lateness).groupBy("key").transformWithStateInPandas(SectionAssembly(quiet), SECTIONS_OUT, "Append", "EventTime")


def stream_cooldowns(log: DataFrame) -> DataFrame:
    return log.groupBy("origin").transformWithStateInPandas(Cooldowns(), COOLDOWNS_OUT, "Append", "None")


def stream_failures(events: DataFrame) -> DataFrame:
    """R6; events: reader, target, failed, ts (seconds)."""
    return events.groupBy("reader").transformWithStateInPandas(NavigationFailures(), FAILURES_OUT, "Append", "None")


def stream_positions(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """R2: one write per reader, URL and four seconds; events: reader, url, percent, ts, complete.

    Older updates lose; only complete chapters count. What comes out goes through
    operators.store.merge_positions for the last write and the newest of each reader."""
    rows = events.withColumn("percent", T.percent(F.col("percent"))).where("complete and percent is not null and url is not null and url <> ''")
    rows = rows.withColumn("url", U.without_fragment(F.col("url"))).withWatermark("ts", lateness)
    slots = rows.groupBy(F.window("ts", "4 seconds"), "reader", "url").agg(F.max(F.struct("ts", "percent")).alias("x"))
    return slots.select("reader", "url", "x.percent", F.unix_micros("x.ts").alias("updated_at"))


def debounce(events: DataFrame, gap: str = "300 milliseconds", lateness: str = "1 minute") -> DataFrame:
    """The last value of each burst of changes; events: key, value, ts."""
    rows = events.withWatermark("ts", lateness).groupBy("key", F.session_window("ts", gap)).agg(F.max(F.struct("ts", "value")).alias("x"))
    return rows.select("key", "x.value", "x.ts")


def dedupe_loads(chapters: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """A URL is loaded once per reader; chapters: reader, url, ts."""
    return chapters.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["reader", "url"])


def current_generation(events: DataFrame, lateness: str = "1 hour", quiet: float = 86_400.0) -> DataFrame:
    """A stream (key, generation, ts, ...) without results of views that are replaced. Rows without
    key, generation or ts belong to no view and are dropped."""
    rows = events.where("key is not null and generation is not null and ts is not null").withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithStateInPandas(Generations(quiet), events.schema, "Append", "EventTime")


def event_rows(events: DataFrame) -> DataFrame:
    """Events as JSON lines with sensitive values taken out; events: t, level, type, detail."""
    return events.select("t", "level", "type", F.to_json(F.struct(T.redact_text(F.col("detail")).alias("detail"))).alias("detail"))
