"""Golden cases of catalogs, sections, stores, rules, detection and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import clean, detect, rules, sections, store, toc
from leafmill.sources import pages as S

TOC = "toc_id string, page_no long, pos int, title string, url string, access string"


def entries(spark, titles, url="https://x.example.com/book/100/{}.html"):
    return spark.createDataFrame([("t", 0, k, t, url.format(k), None) for k, t in enumerate(titles)], TOC)


def test_dedupe_keeps_last_place_and_better_title(spark):
    rows = [("t", 0, 0, "第1章 开始", "u1", None), ("t", 0, 1, "第2章 路", "u2", None), ("t", 0, 2, "章节 1", "u1", None)]
    got = toc.dedupe(spark.createDataFrame(rows, TOC)).orderBy("pos").collect()
    assert [(r.pos, r.title, r.url) for r in got] == [(1, "第2章 路", "u2"), (2, "第1章 开始", "u1")]


@pytest.mark.parametrize(
    ("titles", "order"),
    [
        (["第198章", "第1章", "第200章"], ["第1章", "第198章", "第200章"]),
        (["第1章", "第3章", "第1章 又"], ["第1章", "第3章", "第1章 又"]),
        (["第5章", "第4章", "第3章", "第2章", "第1章", "序言 长"], ["序言 长", "第1章", "第2章", "第3章", "第4章", "第5章"]),
    ],
)
def test_sort(spark, titles, order):
    got = toc.sort_entries(entries(spark, titles)).orderBy("ord").collect()
    assert [r.title for r in got] == order


def test_foreign_book_goes(spark):
    rows = [("t", 0, k, f"第{k}章", f"https://x.example.com/book/100/{k}.html", None) for k in range(5)] + [("t", 0, 9, "第9章", "https://x.example.com/book/200/9.html", None)]
    got = toc.filter_entries(spark.createDataFrame(rows, TOC)).collect()
    assert sorted(r.pos for r in got) == [0, 1, 2, 3, 4]


SEC = "key string, section int, marker_page int, marker_total int, content string"


@pytest.mark.parametrize(
    ("pages", "cap", "expected"),
    [
        ([(1, 1, 3), (2, 2, 3), (3, 3, 3)], 10, (3, 3, False)),
        ([(1, 1, 5), (2, 3, 5)], 10, (1, 5, True)),
        ([(1, 1, 5), (2, 2, 4)], 10, (1, 5, True)),
        ([(1, None, None), (2, 3, 5)], 10, (1, None, True)),
        ([(1, 1, 3), (2, None, None), (3, 3, 3)], 10, (3, 3, False)),
        ([(1, 1, 4), (2, 2, 4), (4, 4, 4)], 10, (2, 4, True)),
        ([(k, k, 12) for k in range(1, 13)], 2, (2, 12, True)),
    ],
)
def test_contiguous_sections(spark, pages, cap, expected):
    rows = spark.createDataFrame([("k", *p, f"c{p[0]}") for p in pages], SEC)
    got = sections.completeness(rows, sections.contiguous(rows, cap)).first()
    assert (got.loaded, got.total, got.truncated) == expected


def test_chain_stops_in_a_circle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    got = sections.section_chain(edges, spark.createDataFrame([("a",)], "url string")).orderBy("ord").collect()
    assert [r.url for r in got] == ["a", "b", "c"]


def test_confidence(spark):
    row = spark.range(1).select(detect.navigation_score(F.lit(0.9), F.lit(0.8), F.lit(0.7)).alias("n"), detect.navigation_score(*[F.lit(None).cast("double")] * 3).alias("none")).first()
    assert row.n == pytest.approx(0.8333, abs=1e-4)
    assert row.none == 0.2


def test_positions(spark):
    cols = "reader string, url string, percent double, updated_at long"
    a = spark.createDataFrame([("r", "u", 120.0, 1), ("r", "v", 37.456, 1), ("r", "", 5.0, 1), ("r", "w", float("nan"), 1)], cols)
    b = spark.createDataFrame([("r", "u", 10.0, 1), ("r", "v", 1.0, 0)], cols)
    got = {r.url: r.percent for r in store.merge_positions(a, b).collect()}
    assert got == {"u": 10.0, "v": 37.5}
    many = spark.createDataFrame([("r", f"u{k}", 1.0, k) for k in range(205)], cols)
    assert store.merge_positions(many).count() == 200


def test_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([("b1", "u1", "old", 1), ("b1", "u1", "new", 2), ("b2", "u2", "x", 1), ("b2", None, "x", 1)], "book_id string, url string, content string, cached_at long")
    store.write_chapters(rows, path)
    assert [(r.url, r.content) for r in store.read_chapters(spark, path, "b1").collect()] == [("u1", "new")]
    assert store.read_chapters(spark, path).count() == 2


def test_retries(spark):
    log = spark.createDataFrame([("a", k, k, 502) for k in range(3)] + [("b", 0, 9, 404), ("c", 0, 1, 429), ("c", 1, 2, 429)], "url string, ts long, id long, status int").withColumns({"error": F.lit(None).cast("string"), "retry_after": F.lit(None).cast("double")})
    got = {(r.url, r.attempt): (r.action, r.wait) for r in store.retry_plan(log).collect()}
    assert [got["a", k][0] for k in (1, 2, 3)] == ["retry", "retry", "stop"]
    assert 2 <= got["a", 1][1] <= 2.4
    assert 4 <= got["a", 2][1] <= 4.8
    assert got["b", 1][0] == "stop"
    assert [got["c", k][0] for k in (1, 2)] == ["retry", "stop"]


def test_filters():
    found, errors = rules.compile_filters("广告\n\n@host=Site.example.com. promo\n(\n@host=bad/host x")
    assert [(f[0], f[1], f[2]) for f in found] == [("global", None, "广告"), ("host", "site.example.com", "promo")]
    assert [e[0] for e in errors] == [4, 5]


def test_rules_reject_doubles_and_bad_patterns():
    with pytest.raises(ValueError, match="without its own id"):
        rules.load_rules([{"id": "a", "pattern": "x"}, {"id": "a", "pattern": "y"}])
    assert rules.glob_pattern("*.a?c") == r"^.*\.a.c$"


HTML = '<html><head><title>T</title></head><body><div id="content" class="big main"><p>one<p>two <a href="/x">link</a><br>three</div><div hidden>no</div><div class="share"><p>gone</p></div><img src="loading.gif" data-src="/a.png" style="x"></body></html>'


def nodes_of(spark, html=HTML):
    return S.html_nodes(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))


def test_nodes_and_subtrees(spark):
    nodes = nodes_of(spark)
    tags = [r.tag for r in nodes.where("kind = 'element'").orderBy("pos").collect()]
    assert tags == ["html", "head", "title", "body", "div", "p", "p", "a", "br", "div", "div", "p", "img"]
    div = detect.subtree_totals(nodes).where("id = 'content'").first()
    assert (div.text_len, div.link_text, div.links, div.breaks) == (len("onetwo linkthree"), 4, 1, 3)


def test_selectors_and_cleaning(spark):
    nodes = nodes_of(spark)
    picked = clean.select_nodes(nodes, [".none,#content", "p:eq(1)", 'div[class*="sha"]']).orderBy("sel").collect()
    assert [(r.sel, r.alt, r.tag) for r in picked] == [(0, 1, "div"), (1, 0, "p"), (2, 0, "div")]
    with pytest.raises(ValueError, match="not supported"):
        clean.select_nodes(nodes, ["div + p"])
    left = clean.remove_elements(nodes)
    assert "gone" not in [r.text for r in left.collect()]
    img = clean.fix_images(clean.strip_inline_style(nodes)).where("tag = 'img'").first()
    assert img.attrs == {"src": "/a.png", "data-src": "/a.png"}
    pars = [r.text for r in clean.br_to_paragraphs(left.where("tag <> 'title'")).where("text <> 'T'").orderBy("par").collect()]
    assert pars == ["one", "two link\nthree", "no"]  # breaks in a paragraph without indentation stay


def test_removal_keeps_what_follows(spark):
    """The last node of a removed control may be gone already; paragraphs behind it stay."""
    html = '<p>first</p><a>加入书签</a><div class="share">s</div><p>real content one</p><div class="ad"><p>x</p></div><p>real content two</p>'
    nodes = nodes_of(spark, html)
    assert clean.clean_content(nodes).first().content == "<p>first</p><p>real content one</p><p>real content two</p>"
    outer = nodes.where("tag = 'div'").select("page_id", "pos", "end_pos")
    assert [r.text for r in clean.remove_subtrees(nodes, outer).where("kind = 'text'").orderBy("pos").collect()] == ["first", "加入书签", "real content one", "real content two"]


def test_parse_returns_all_of_the_content(spark):
    from leafmill.operators import parse

    body = "".join(f"<p>line {k} of a chapter that goes on</p>" for k in range(150))
    pages = spark.createDataFrame([(1, "https://x.example.org/1", f"<html><body><article class='content'>{body}</article></body></html>")], "page_id long, url string, html string")
    got = parse.parse_pages(pages, [], profile=detect.LATIN).first()
    assert got.method == "detection"
    assert got.content_text == "".join(f"line {k} of a chapter that goes on" for k in range(150))


ADVERTS = ["小说网 最新章节 更新快", "最*新章节更新-快", "幻想姬 免费阅读", "天天看小说 x ttks.tw", "阅|读模式 a 无法显示本章节全部内容 b", "【书】小说免费阅读，请收藏 站【1qxs.com】", "(第2/3页)", "WWW.abc.com", "HTTPS://a.b/c"]


@pytest.mark.parametrize("advert", ADVERTS)
def test_adverts_go(spark, advert):
    df = spark.createDataFrame([(f"one {advert}\ntwo",), ("plain text, no advert",)], "t string")
    got = [r.x for r in df.select(T.remove_ads(F.col("t")).alias("x"), T.remove_ads(F.col("t"), hint=None).alias("y")).where("x = y").collect()]
    assert [" ".join(x.split()) for x in got] == ["one two", "plain text, no advert"]


def test_clean_text(spark):
    df = spark.createDataFrame([("伱好（本章未完，请点击下一页继续阅读）　再见 https://a.b/c",)], "t string")
    assert df.select(T.clean_text(F.col("t"))).first()[0] == "你好 再见"


def test_simplified_variants(spark):
    df = spark.createDataFrame([("著名的看著",)], "t string")
    assert df.select(T.to_simplified_variants(F.col("t"))).first()[0] == "著名的看着"
    assert df.select(T.to_simplified_variants(F.col("t"), F.lit("hans"))).first()[0] == "著名的看著"


def test_fnv(spark):
    assert spark.createDataFrame([("abc",), ("",)], "t string").select(T.fnv1a_hex(F.col("t")).alias("h")).orderBy("h").collect()[0].h == "fnv1a:1a47e90b"


def test_catalog_json(spark):
    payload = '{"volumes":[{"name":"v","chapters":[{"name":"A","id":"1","sS":1},{"title":"B","url":"/u","sS":0},{"id":"1","name":"A2","sS":1}]}]}'
    got = S.catalog_json(spark.createDataFrame([("t", payload), ("bad", "{")], "toc_id string, payload string")).orderBy("ord").collect()
    assert [(r.title, r.url, r.access) for r in got] == [("B", "/u", "locked"), ("A2", "/chapter/1/", None)]


class _Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


def test_cooldowns():
    from leafmill.streaming.stateful import Cooldowns

    p = Cooldowns()
    p.value = _Value()
    step = lambda status, after, ts: [f["until"][0] for f in p.handleInputRows(("o",), iter([pd.DataFrame([{"status": status, "retry_after": after, "ts": ts}])]), None)]
    assert step(429, None, 100.0) == [130.0]
    assert step(429, 5.0, 101.0) == [130.0]
    assert step(429, None, 110.0) == [170.0]
    assert step(503, None, 120.0) == []
    assert step(503, 90.0, 120.0) == [210.0]


def test_content_is_a_known_container_or_else_the_best(spark):
    body, more = "<p>正文内容很长。</p>" * 100, "<p>别的内容更长。</p>" * 400
    rows = [
        ("known", f"<div class='box'>{more}</div><div id='content'>{body}</div>"),
        ("order", f"<div class='Text'>{more}</div><div id='content'>{body}</div><div id='chapter_content'>{body}x</div>"),
        ("class", f"<div class='a noveltext b'>{body}</div>"),
        ("short", f"<div id='content'>短</div><div class='reading'>{body}</div>"),
        ("hidden", f"<div style='display: none'><div id='content'>{body}</div></div><td class='text'>{body}</td>"),
        ("scored", f"<div class='comment'>{more}</div><div class='book-x'>{body}</div>"),
        ("structural", f"<div class='sidebar'>{more}</div><nav class='main'>{more}</nav>"),
        ("links", "<div id='content'>" + "<a href='/x'>正文内容很长。</a>" * 100 + "</div>"),
        ("script", "<div id='content'><script>" + "内容" * 600 + "</script></div>"),
        ("empty", ""),
        ("null", None),
    ]
    pages = spark.createDataFrame([(k, "http://a.b/", h) for k, (_, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {rows[r.page_id][0]: r for r in detect.detect_content(pages).collect()}
    text, longer = "正文内容很长。" * 100, "别的内容更长。" * 400
    assert {k: (r.method, r.tag, r.text) for k, r in got.items()} == {
        "known": ("known", "div", text),
        "order": ("known", "div", text + "x"),
        "class": ("known", "div", text),
        "short": ("scored", "div", text),
        "hidden": ("scored", "td", text),
        "scored": ("scored", "div", text),
    }
    assert (got["known"].confidence, got["known"].score, got["known"].text_len) == (0.9, None, len(text))
    # +25 name, +20 or 0 density, +10 paragraphs, +15 Han, +.7 length
    assert got["scored"].score == pytest.approx(25 + (20 if len(text) / len(f"<div class='book-x'>{body}</div>") > 0.5 else 0) + 10 + 15 + 0.7)
    assert detect.detect_content(pages.limit(0)).collect() == []
