"""Selectors against a plain walk over the tree, and texts of whole subtrees."""

import random

import pytest

from leafmill.operators import clean, select
from leafmill.sources import pages
from leafmill.sources.pages import _Builder, html_nodes

SELECTORS = [
    "#a", ".x", "p", "div.x", "p.x.y", "[data-k]", '[data-k="1"]', '[class*="x"]', '[id^="a"]', '[id$=b]', "[class~=y]", "*",
    "div p", "div > p", "#a .x", "div > span > a", ".x div p", "div > p a",
    'a:contains("next")', "p:contains(ne):contains(xt)", "div a:contains('go, on')", "p:first", "p:last", "a:eq(1)", "a:eq(-2)", "div p:eq(0)", "div > p:contains(next)",
    ".none, #a", "em, p.x, a", '.none:contains("q"), a:contains("next"), p',
]


def page(rng) -> str:
    out, open_tags = [], []
    for _ in range(rng.randint(5, 40)):
        if open_tags and rng.random() < 0.35:
            out.append(f"</{open_tags.pop()}>")
        elif rng.random() < 0.4:
            out.append(rng.choice(["next", "go, on", "ne", "xt", " ", "q&amp;"]))
        else:
            tag = rng.choice(["div", "p", "span", "a"])
            attrs = rng.choice(["", " id=a", " id=ab", " class='x'", " class='x y'", " data-k=1", " data-k"])
            out.append(f"<{tag}{attrs}>")
            open_tags.append(tag)
    return "".join(out)


def plain(html: str, text: str, every: bool) -> list[int]:
    rows = _Builder().run(html)
    text_of = lambda r: "".join(x[9] for x in rows[r[0] : r[1] + 1] if x[4] == "text")

    def fits(r, compound) -> bool:
        _, tag, own_id, classes, attrs = compound
        if r[4] != "element" or (tag and r[5] != tag) or (own_id and r[6] != own_id) or not set(classes) <= set(r[7]):
            return False
        for name, op, value in attrs:
            have = r[8].get(name)
            tests = {"": lambda h, v: True, "=": lambda h, v: h == v, "*=": lambda h, v: v and v in h, "^=": lambda h, v: v and h.startswith(v), "$=": lambda h, v: v and h.endswith(v), "~=": lambda h, v: v in h.split()}
            if have is None or not tests[op](have, value):
                return False
        return True

    def chain(r, compounds) -> bool:
        if not fits(r, compounds[-1]):
            return False
        if len(compounds) == 1:
            return True
        up = r[3]
        while up is not None:
            if chain(rows[up], compounds[:-1]):
                return True
            if compounds[-1][0] == ">":
                return False
            up = rows[up][3]
        return False

    out = []
    for one in select.split_list(text):
        compounds, needles, place = select.compile_alternative(one)
        found = [r for r in rows if chain(r, compounds) and all(n in text_of(r) for n in needles)]
        if place is not None:
            found = [found[place]] if -len(found) <= place < len(found) else []
        out += [r[0] for r in found]
        if out and not every:
            break
    return sorted(out)


@pytest.mark.parametrize("every", [False, True])
def test_equals_plain_walk(spark, every):
    rng = random.Random(11)
    html = [page(rng) for _ in range(150)] + ["", "text only"]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {}
    for r in select.select_nodes(html_nodes(df), SELECTORS, every).select("page_id", "sel", "pos").collect():
        got.setdefault((r.page_id, r.sel), []).append(r.pos)
    for i, h in enumerate(html):
        for s, text in enumerate(SELECTORS):
            assert sorted(got.get((i, s), [])) == plain(h, text, every), (h, text)


def test_rules_look_at_their_own_pages_only(spark):
    df = html_nodes(spark.createDataFrame([(1, "<p>a</p>"), (2, "<p>b</p>")], "page_id long, html string")).selectExpr("*", "case page_id when 1 then 'r' else 's' end as rule_id")
    got = select.select_nodes(df, [("r", "p"), ("s", "a, p"), (None, "p")]).select("page_id", "sel").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 2), (2, 1), (2, 2)]


def test_what_is_not_supported_is_refused():
    for text in ["div + p", "p:hover", "a:not(.x)", "#a#b", "p ~ q"]:
        with pytest.raises(ValueError, match="not supported"):
            select.compile_selectors([(None, text)])
    assert select.split_list('a[title="x,y"], b:contains(p,q) ,c') == ['a[title="x,y"]', "b:contains(p,q)", "c"]


def test_subtree_texts_after_removal(spark):
    html = "<div>a<p>b<script>no</script></p><i>c</i></div>d<div></div>"
    nodes = clean.remove_elements(html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")), ["script, em"])
    got = {r.tag: r.subtree_text for r in select.subtree_texts(nodes, nodes.where("kind = 'element'")).join(nodes.select("pos", "tag"), "pos").orderBy("pos").collect()}
    assert got == {"div": "", "p": "b", "i": "c"}  # the second div wins over the first in the dict


def test_ui_noise_of_any_number_of_nodes(spark):
    bar = "<div>" + "<b></b>" * 200 + "上一章 目录 下一章" + "</div>"
    cases = {
        "bar": (f"<article>正文{bar}</article>", "正文"),
        "label": ("<article>正文<a href=x>加入 书签</a><a>上一章节选</a></article>", "正文上一章节选"),
        "pattern": ("<article>正文<button>『加入书签，方便阅读』</button></article>", "正文"),
        "tip": ("<p>温馨提示：按 Enter 返回</p><p>温馨提示：天气</p>", "温馨提示：天气"),
        "tools": ("<span>关灯 字体：大</span><span>投票推荐 加入书签</span><span>投票推荐</span>", "投票推荐"),
        "long": ("<div>上一章目录下一章" + "正" * 130 + "</div>", "上一章目录下一章" + "正" * 130),
        "prose": ("<p>他翻到上一章，又看了下一章。</p>", "他翻到上一章，又看了下一章。"),
        "label in a block": ("<div><a>目录</a>上一章下一章，目</div>", "上一章下一章，目"),
    }
    df = spark.createDataFrame([(k, h) for k, (_, (h, _)) in enumerate(cases.items())], "page_id long, html string")
    got = {r.page_id: r.page_text for r in select.page_texts(clean.remove_ui_noise(html_nodes(df))).collect()}
    assert {name: got.get(k) for k, name in enumerate(cases)} == {name: t for name, (_, t) in cases.items()}
    assert pages.NODES.startswith("page_id long")
