"""The chapter store: merging writes, versions, removal and conflicts."""

from datetime import datetime

import pytest

from leafmill.operators import store

SCHEMA = "book_id string, url string, content string, cached_at timestamp, extra int"


def day(n: int) -> datetime:
    return datetime(2024, 1, n)


def rows_of(df) -> list:
    return sorted((r.book_id, r.url, r.content) for r in df.collect())


def frame(spark, *rows):
    return spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)


def test_two_writes_keep_both_chapters_and_the_newest_of_equal_keys(spark, tmp_path):
    held = store.ChapterStore(spark, f"file://{tmp_path}/s", buckets=1)  # all books share a bucket
    assert held.read().count() == 0
    assert held.write(frame(spark, ("b1", "u1", "one", day(1)), ("b2", "u1", "other", day(1)))) == 1
    assert held.write(frame(spark, ("b1", "u2", "two", day(2)), ("b1", "u1", "old", None))) == 2
    assert rows_of(held.read()) == [("b1", "u1", "one"), ("b1", "u2", "two"), ("b2", "u1", "other")]
    held.write(frame(spark, ("b1", "u1", "newer", day(3)), ("b1", "u2", "same day", day(2))))
    assert rows_of(held.read("b1")) == [("b1", "u1", "newer"), ("b1", "u2", "same day")]
    assert rows_of(held.read(version=2)) == [("b1", "u1", "one"), ("b1", "u2", "two"), ("b2", "u1", "other")]


def test_only_touched_buckets_are_written(spark, tmp_path):
    held = store.ChapterStore(spark, f"file://{tmp_path}/s", buckets=8)
    held.write(frame(spark, *((f"b{i}", "u", str(i), day(1)) for i in range(30))))
    before = held.manifest()[1]
    held.write(frame(spark, ("b7", "u", "new", day(2))))
    after = held.manifest()[1]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == len(after) > 4
    assert held.read().count() == 30 and rows_of(held.read("b7")) == [("b7", "u", "new")]


def test_running_reader_is_not_disturbed_and_vacuum_keeps_what_is_listed(spark, tmp_path):
    held = store.ChapterStore(spark, f"file://{tmp_path}/s", buckets=2)
    held.write(frame(spark, ("b1", "u1", "one", day(1))))
    reader = held.read()
    held.write(frame(spark, ("b1", "u1", "two", day(2))))
    assert rows_of(reader) == [("b1", "u1", "one")]
    held.write(frame(spark, ("b1", "u1", "three", day(3))))
    held.vacuum(keep=1)
    assert held.versions() == [3] and len(held._list("rows")) == 1
    assert rows_of(held.read()) == [("b1", "u1", "three")]


def test_second_of_two_writers_fails_and_can_run_again(spark, tmp_path):
    held = store.ChapterStore(spark, f"file://{tmp_path}/s", buckets=2)
    held.write(frame(spark, ("b1", "u1", "one", day(1))))
    version, generations = held.manifest()
    held._commit(version, generations)
    with pytest.raises(RuntimeError, match="version 2"):
        held._commit(version, generations)
    assert held.versions() == [1, 2]
    held.write(frame(spark, ("b1", "u2", "two", day(1))))
    assert held.read().count() == 2


def test_removal_and_rows_that_are_ignored(spark, tmp_path):
    held = store.ChapterStore(spark, f"file://{tmp_path}/s", buckets=2)
    assert held.write(frame(spark, (None, "u", "x", day(1)), ("b", None, "x", day(1)), ("b", "", "x", day(1)))) == 0
    held.write(frame(spark, ("b", "u1", None, day(1)), ("b", "u2", "x", day(1)), ("b", "u2", "y", day(1))))
    assert sorted((r.url, r.content) for r in held.read().collect()) == [("u1", None), ("u2", "y")]
    gone = spark.createDataFrame([("b", "u1", 1), ("b", "u2", 1), ("c", "u", 1)], "book_id string, url string, n int")
    held.remove(gone.where("url = 'u1'"))
    assert rows_of(held.read()) == [("b", "u2", "y")]
    held.remove(gone)
    assert held.read().count() == 0 and held.read("b").count() == 0
