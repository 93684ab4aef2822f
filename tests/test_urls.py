"""Golden cases of the URL functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.functions import urls as U

X = "https://x.example.com"


def values(spark, rows, *columns):
    names = ", ".join(f"c{k} string" for k in range(len(rows[0])))
    return [tuple(r) for r in spark.createDataFrame(rows, names).select(*columns).collect()]


NEXT = [
    (f"{X}/123.html", f"{X}/123_2.html", True),
    (f"{X}/123/1.html", f"{X}/123/2.html", True),
    (f"{X}/h/1088392/146537150/", f"{X}/h/1088392/146537150_2/", True),
    (f"{X}/h/1088392/146537150_3/", f"{X}/h/1088392/146537151/", False),
    (f"{X}/archive/2024-12/", f"{X}/archive/2024-13/", False),
    (f"{X}/archive/2024_12/", f"{X}/archive/2024_13/", False),
    (f"{X}/89812/1", f"{X}/89812/2", False),
    (f"{X}/a.html?page=9", f"{X}/a.html?page=11", False),
    (f"{X}/a.html?page=9", f"{X}/a.html?page=10", True),
    (f"{X}/a.html?cid=1", f"{X}/a.html?cid=2&page=2", False),
    (f"{X}/a.html", "?page=2", True),
    ("junk", "also junk", False),
]


def test_next_section(spark):
    got = values(spark, [(a, b) for a, b, _ in NEXT], "c0", "c1", U.is_next_section(F.col("c0"), F.col("c1")))
    assert {(a, b): v for a, b, v in got} == {(a, b): v for a, b, v in NEXT}


BASE = [
    (f"{X}/a?page=2", f"{X}/a?page=1"),
    (f"{X}/xs/89812/1358/2", f"{X}/xs/89812/1358/1"),
    (f"{X}/gb/94443/1/2", f"{X}/gb/94443/1"),
    (f"{X}/5/12345_0/", None),
    (f"{X}/5/12345_100/", None),
    (f"{X}/5/12345_3/", f"{X}/5/12345/"),
    (f"{X}/a?next=/1_2", None),
    (f"{X}/9_2.html", f"{X}/9.html"),
]


def test_section_base(spark):
    got = dict(values(spark, [(a,) for a, _ in BASE], "c0", U.section_base_url(F.col("c0"))))
    assert got == dict(BASE)


RESOLVED = [
    ("/a/b", f"{X}/a/b"),
    ("../b?q#f", f"{X}/p/b?q#f"),
    ("./b", f"{X}/p/q/b"),
    ("//y.example.com/z", "https://y.example.com/z"),
    ("?n=1", f"{X}/p/q/r?n=1"),
    ("#top", f"{X}/p/q/r#top"),
    ("", f"{X}/p/q/r"),
    ("http://z.example.com", "http://z.example.com"),
    ("../../../..", f"{X}/"),
]


def test_resolve(spark):
    got = dict(values(spark, [(a,) for a, _ in RESOLVED], "c0", U.resolve_url(F.col("c0"), F.lit(f"{X}/p/q/r"))))
    assert got == dict(RESOLVED)


@pytest.mark.parametrize(("url", "kind"), [(f"{X}/chapter/1", "chapter"), (f"{X}/book/1/toc/", "toc"), (f"{X}/book/1?toc=1", "toc"), (f"{X}/novel/chapters/x/index.html", "toc"), (f"{X}/novel/chapters/x/83.html", "chapter"), ("ftp://x/chapter/1", "other"), ("junk", "other")])
def test_page_kind(spark, url, kind):
    assert values(spark, [(url,)], U.page_kind_url(F.col("c0")))[0][0] == kind


def test_public(spark):
    rows = [("http://127.0.0.1/a",), ("http://10.2.3.4/",), ("http://100.64.0.1/",), ("http://172.16.0.1/",), ("http://8.8.8.8/x#y",), ("http://localhost./x",), ("https://e.example.com/#a",), ("file:///etc/x",), ("http://[::1]/",)]
    got = dict(values(spark, rows, "c0", U.public_http_url(F.col("c0"))))
    assert {k for k, v in got.items() if v} == {"http://8.8.8.8/x#y", "https://e.example.com/#a"}
    assert got["http://8.8.8.8/x#y"] == "http://8.8.8.8/x"


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=300, max_size=300))
def test_junk_never_fails(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts] + [(f"http://h/{t}",) for t in texts] + [(None,)], "u string")
    u = F.col("u")
    once = df.select(U.canonical_url(u).alias("u"))
    assert once.select(U.canonical_url(F.col("u")).alias("u")).exceptAll(once).count() == 0
    df.select(U.hostname(u), U.path(u), U.chapter_section(U.path(u)), U.section_base_url(u), U.book_key(u), U.redact_url(u), U.safe_url(u), U.public_http_url(u), U.is_invalid_chapter_url(u), U.resolve_url(u, F.lit(X))).collect()
