"""The page tokeniser: any text, linear time, places in the source."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.sources import pages

PIECES = ["<", ">", "/", "!", "-", "--", "[", "]", "a", "p", "b", "div", "li", '"', "'", "=", " ", "&", "amp;", "script", "style", "\n", "?", "é", "<p>", "</p>", "<![foo]>", "<![ foo [x]]>", "<!--", "-->", "\x00"]


def check(html: str) -> list:
    rows = pages._Builder().run(html)
    for i, (pos, end_pos, depth, parent, kind, tag, _, _, _, _, begin, end) in enumerate(rows):
        assert pos == i <= end_pos < len(rows) and 0 <= begin <= end <= len(html)
        assert (kind == "element") == bool(tag)
        if parent is not None:
            assert rows[parent][1] >= end_pos and rows[parent][2] == depth - 1
    texts = [(r[10], r[11]) for r in rows if r[4] == "text"]
    assert all(a[1] <= b[0] for a, b in zip(texts, texts[1:], strict=False))
    return rows


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_any_text_gives_nested_nodes(parts):
    check("".join(parts))


@pytest.mark.parametrize("piece", ["<b>", "<p>", "<p><b>", "<p><div>", "<table><td>", "<!--", "<a b='", "<![", "</", "</b>", "<a ", "<script>"])
def test_time_is_linear(piece):
    seconds = []
    for n in (10_000, 100_000):
        began = time.process_time()
        pages._Builder().run(piece * n)
        seconds.append(time.process_time() - began)
    assert seconds[1] < 25 * max(seconds[0], 0.02)


def test_odd_declarations_and_entities():
    html = "<p>a &amp; b<![foo]><![ foo [x]]>c<!-- <p> -->d</p>tail"
    rows = check(html)
    assert [r[9] for r in rows if r[4] == "text"] == ["a & b", "c", "d", "tail"]
    assert [html[r[10] : r[11]] for r in rows if r[4] == "text"] == ["a &amp; b", "c", "d", "tail"]


def test_attributes_and_raw_text():
    rows = check("<A HREF='x>y' id=k class=\"a b\" href=z disabled><script>if (a<b) '</p>'</script><br/><img src=a/b>")
    a, script, code, br, img = rows
    assert a[5] == "a" and a[6] == "k" and a[7] == ["a", "b"] and a[8] == {"href": "x>y", "id": "k", "class": "a b", "disabled": ""}
    assert code[9] == "if (a<b) '</p>'" and code[3] == script[0] and br[5] == "br" and img[8] == {"src": "a/b"}


def test_one_odd_page_does_not_stop_the_others(spark):
    rows = [(1, "u", "<p>x</p>"), (2, "u", "<![foo]>"), (3, "u", None), (4, "u", "<![ foo [x]]><b>y"), (5, "u", "<b>" * 20_000)]
    nodes = pages.html_nodes(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r["count"] for r in nodes.groupBy("page_id").count().collect()} == {1: 2, 4: 2, 5: 20_000}
