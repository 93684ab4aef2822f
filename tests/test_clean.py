"""Blocks of text of a page: loose text, line breaks, kept lists, poetry and indented prose."""

from leafmill.functions import text as T
from leafmill.operators import clean
from leafmill.sources.pages import html_nodes

IND = "　　"
CASES = {
    "loose text": ("<div>one<br>two<br><br>three</div>", [("p", "one"), ("p", "two"), ("p", "three")]),
    "no container": ("one<br>two <b>bold</b> more", [("p", "one"), ("p", "two bold more")]),
    "nested": ("<article>a<div>b<br>c</div>d</article>", [("p", "a"), ("p", "b"), ("p", "c"), ("p", "d")]),
    "poetry": ("<p>rose<br>red<br>violet</p>", [("p", "rose\nred\nviolet")]),
    "indented prose": (f"<p>first<br>{IND}second<br>{IND}third</p>", [("p", "first"), ("p", "second"), ("p", "third")]),
    "four of five": ("<p>a<br>" + "".join(f"{IND}b{k}<br>" for k in range(4)) + "c</p>", [("p", "a"), ("p", "b0"), ("p", "b1"), ("p", "b2"), ("p", "b3"), ("p", "c")]),
    "three of five": ("<p>a<br>" + "".join(f"{IND}b{k}<br>" for k in range(3)) + "c<br>d</p>", [("p", "a\nb0\nb1\nb2\nc\nd")]),
    "list": ("<div>x<ul><li>one<br>two</li><li>three</li></ul>y</div>", [("p", "x"), ("li", "one\ntwo"), ("li", "three"), ("p", "y")]),
    "table": ("<table><tr><td>a</td><td>b<br>c</td></tr></table>", [("td", "a"), ("td", "b\nc")]),
    "heading": ("<h1>T</h1>text", [("h1", "T"), ("p", "text")]),
    "break in an element of the line": ("<div>a<b>b<br>c</b>d</div>", [("p", "ab cd")]),
    "deep": ("<div>" * 300 + "x<br>y" + "</div>" * 300 + "z", [("p", "x"), ("p", "y"), ("p", "z")]),
    "after a paragraph": ("<div><p>a</p>b<p>c</p></div>", [("p", "a"), ("p", "b"), ("p", "c")]),
    "rule": ("a<hr>b", [("p", "a"), ("p", "b")]),
    "blank": ("<div> <br> <p> </p></div>", []),
}


def nodes_of(spark, html: list):
    return html_nodes(spark.createDataFrame(list(enumerate(html)), "page_id long, html string"))


def test_blocks(spark):
    got = {}
    for r in clean.br_to_paragraphs(nodes_of(spark, [h for h, _ in CASES.values()])).orderBy("page_id", "par").collect():
        got.setdefault(r.page_id, []).append((r.tag, r.text))
    assert {name: got.get(k, []) for k, name in enumerate(CASES)} == {name: blocks for name, (_, blocks) in CASES.items()}


def test_content_keeps_tags_and_escapes(spark):
    html = ["<h2>Title</h2><div>a &lt; b<br>c</div><ul><li>x<br>y</li></ul><p>one<br>two</p><script>no</script>", ""]
    nodes = nodes_of(spark, html)
    titles = spark.createDataFrame([(0, "Title")], "page_id long, title string")
    assert [tuple(r) for r in clean.clean_content(nodes, titles).collect()] == [(0, "<p>a &lt; b</p><p>c</p><li>x<br>y</li><p>one<br>two</p>")]


def test_long_page(spark):
    html = "<div>" + "line one<br>" * 30_000 + "</div>"
    assert clean.br_to_paragraphs(nodes_of(spark, [html])).count() == 30_000


def test_advertisement_of_any_case_goes(spark):
    df = spark.createDataFrame([("前【x】小说免费阅读，请收藏abc【1QXS.com】后",), ("前【x】小說免費閱讀,請收藏 abc【1qxs.com】后",)], "t string")
    assert [r[0] for r in df.select(T.remove_ads(df.t)).collect()] == ["前后", "前后"]
