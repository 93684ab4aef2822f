"""Chapters by a rule's selectors: content, titles, navigation, removal, and the ways back to detection."""

from leafmill.operators import parse

BODY = "<p>正文内容很长，说的是很久以前的事。</p>" * 60
RULES = [
    {
        "id": "a", "pattern": r"//a\.example/", "content": "#gone, div.text", "title": "h1.t", "book": ".crumb a:eq(1)", "next": 'a:contains("下一")', "prev": False, "index": ".missing",
        "remove": ".note, p:contains(广告)", "replace": [("旧", "新", "g")],
    },
    {"id": "b", "pattern": r"//b\.example/", "content": ".never", "next": "a.n", "title_pattern": "^(.*)_(.*)$", "book_index": 2},
    {"id": "c", "pattern": r"//c\.example/", "content": "article", "title_pattern": "^(.*?) - (.*?) - ", "title_index": 2, "book_index": 1, "title_replace": r"第\d+章"},
]
NAV = '<a href="/0">上一章</a><a href="2.html#x">下一页</a><a href="/list/">目录</a>'


def test_chapters(spark):
    html = {
        "rule": ("http://a.example/1/1.html", f"<div class=crumb><a>首页</a><a>书名</a></div><h1 class=t>第一章 起 </h1><div class=text><script>x</script><h1>第一章 起</h1>旧事<br>他说 &lt;b&gt;<div class=note>注</div><p>广告一则</p><ul><li>项</li></ul></div>{NAV}"),
        "falls back": ("http://b.example/1/1.html", f"<title>甲_乙</title><h1>第二章 来</h1><div id=content>{BODY}</div><a class=n href=/next>go</a>"),
        "pattern": ("http://c.example/1/3.html", f"<title>书 - 第3章 到了 - 站</title><article>短文</article>{NAV}"),
        "detected": ("http://d.example/1/1.html", f"<h1>第三章</h1><div id=content>{BODY}</div>{NAV}"),
        "nothing": ("http://d.example/1/2.html", "<p>短</p>"),
        "empty": ("http://a.example/1/9.html", None),
    }
    rows = [(k, url, h, 0) for k, (url, h) in enumerate(html.values())]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, title int")
    got = {list(html)[r.page_id]: r for r in parse.parse_chapters(pages.drop("title"), RULES).collect()}
    assert set(got) == {"rule", "falls back", "pattern", "detected"}
    r = got["rule"]
    assert (r.method, r.confidence, r.title, r.book_title) == ("rule", 1.0, "第一章 起", "书名")
    assert r.content == "<p>新事</p><p>他说 &lt;b&gt;</p><li>项</li>"
    # a selector that finds nothing and False both mean that there is none
    assert (r.next_url, r.prev_url, r.index_url) == ("http://a.example/1/2.html#x", None, None)
    r = got["falls back"]
    assert (r.method, r.title, r.next_url) == ("mixed", "第二章 来", "http://b.example/next") and r.content.startswith("<p>正文") and r.confidence < 1
    r = got["pattern"]
    assert (r.method, r.title, r.book_title, r.content) == ("rule", "到了", "书", "<p>短文</p>")
    assert r.prev_url == "http://c.example/0" and r.index_url == "http://c.example/list/"
    r = got["detected"]
    assert (r.method, r.rule_id, r.title) == ("detection", None, "第三章") and r.prev_url == "http://d.example/0"


def test_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://d.example/1/1.html", f"<div id=content>{BODY}</div>")], "page_id long, url string, html string")
    assert [(r.method, r.title) for r in parse.parse_chapters(pages, []).collect()] == [("detection", "Unknown Chapter")]
    assert parse.parse_chapters(pages.limit(0), RULES).count() == 0
