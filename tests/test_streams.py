"""Streams over files that arrive one by one: order, bounds, timers and late rows."""

import itertools
from datetime import datetime, timedelta

import pytest

from leafmill.streaming import stateful

PAGES = "key string, section int, content string, marker_page int, marker_total int, last boolean, cancel boolean, ts timestamp"
START = datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """feed(batches, schema, make) runs make(stream) over the batches, one micro-batch each, and gives its rows."""
    numbers = itertools.count()
    stateful.with_state_store(spark)

    def run(batches, schema, make):
        root = tmp_path / str(next(numbers))
        got = []
        stream = spark.readStream.schema(schema).parquet(f"{root}/in/*")
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/in/{k}")
            q = make(stream).writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        return got

    return run


def page(key, section, minute=0, last=False, mark=None, total=None, cancel=False):
    return (key, section, f"c{section}", mark, total, last, cancel, START + timedelta(minutes=minute))


def sections(feed, *batches):
    out = {}
    for r in feed(batches, PAGES, lambda s: stateful.stream_sections(s, quiet=300)):
        out.setdefault(r.key, []).append((r.stage, r.ord, r.content, r.truncated))
    return out


def test_gap_closes_as_truncated_when_the_watermark_passes(feed):
    got = sections(
        feed,
        [page("gap", 1), page("gap", 3, last=True), page("whole", 2, last=True), page("slow", 1)],
        [page("whole", 1, 1), page("slow", 2, 4)],  # slow goes on within its quiet time
        [page("other", 1, 8, last=True)],  # the watermark is behind gap's end now, not behind slow's
        [page("slow", 3, 8, last=True), page("gap", 2, 8)],  # gap is closed: nothing is taken up again
        [page("late", 1, 60, last=True)],
    )
    assert got["gap"] == [("first", 1, "c1", False), ("complete", 1, "", True)]
    assert got["whole"] == [("first", 1, "c1", False), ("delta", 2, "c2", False), ("complete", 2, "", False)]
    assert got["slow"] == [("first", 1, "c1", False), ("delta", 2, "c2", False), ("delta", 3, "c3", False), ("complete", 3, "", False)]


def test_pages_outside_the_cap_are_refused_and_the_cap_truncates(feed):
    many = [page("many", k) for k in range(120, 0, -1)]
    got = sections(feed, many + [page("none", 0), page("twice", 2), page("twice", 2, last=True), page("twice", 1)])
    stages = [s for s, *_ in got["many"]]
    assert stages.count("refused") == 21 and [o for s, o, *_ in got["many"] if s in ("first", "delta")] == list(range(1, 100))
    assert got["many"][-1][0] == "complete" and got["many"][-1][3]
    assert got["none"] == [("refused", 0, "", False)]
    assert [s for s, *_ in got["twice"]] == ["first", "delta"]  # the first page 2 stays, which is not the last


def test_marks_and_cancel(feed):
    got = sections(feed, [page("bad", 1, mark=1, total=5), page("bad", 2, mark=3, total=5), page("stop", 1), page("stop", 2, cancel=True), page("full", 2, total=2), page("full", 1, total=2)])
    assert got["bad"] == [("first", 1, "c1", False), ("complete", 1, "", True)]
    assert [s for s, *_ in got["stop"]] == ["first", "cancel"]
    assert [s for s, *_ in got["full"]] == ["first", "delta", "complete"] and not got["full"][-1][3]


FAILURES = "reader string, target string, failed boolean, ts double"


def test_failures_are_bounded_and_the_oldest_gives_way(feed):
    batches = [
        [("r", f"t{k:03}", True, float(k)) for k in range(200)] + [("q", "t000", True, 1.0)],
        [("r", "t001", True, 300.0), ("r", "new", True, 301.0), ("r", "t002", False, 302.0), ("r", "t003", True, 0.5)],
        [("r", "t000", True, 400.0), ("r", "new2", True, 401.0)],
    ]
    got, changes = {}, feed(batches, FAILURES, stateful.stream_failures)
    for r in changes:
        got[r.reader, r.target] = r.n
    assert got["q", "t000"] == 1 and got["r", "t001"] == 2
    assert got["r", "t000"] == 1  # it gave way to "new", and begins anew
    assert got["r", "t002"] == 0 and got["r", "t003"] == 0  # cleared; and the oldest when new2 came
    assert sum(n > 0 for (reader, _), n in got.items() if reader == "r") == 200


def test_results_of_replaced_views_and_late_rows_are_dropped(feed):
    at = lambda minute: START + timedelta(minutes=minute)
    batches = [
        [("k", 1, at(0), "a"), ("k", 2, at(2), "b"), ("k", 1, at(3), "stale"), ("k", 1, at(1), "before"), (None, 1, at(1), "no key"), ("j", 1, at(1), "other")],
        [("k", 1, at(4), "stale too"), ("k", 2, at(4), "c"), ("k", 3, at(200), "d")],
        [("k", 3, at(5), "late"), ("k", 3, at(201), "e"), ("j", 0, at(201), "stale other")],
        [("x", 1, at(900), "clock")],
        [("j", 0, at(901), "forgotten, so new")],
    ]
    got = feed(batches, "key string, generation long, ts timestamp, text string", lambda s: stateful.current_generation(s, "10 minutes", quiet=3600.0 * 4))
    assert sorted(r.text for r in got) == sorted(["a", "before", "b", "other", "c", "d", "e", "clock", "forgotten, so new"])
