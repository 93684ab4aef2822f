"""Content, title and navigation detection, and confidence."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators import classify
from leafmill.sources.pages import attribute, decoded, html_nodes, page_links, page_metas, without_code

# Names of content containers, in order of preference, and label families.
KNOWN_IDS = [
    "pagecontent", "contentbox", "bmsy_content", "bookpartinfo", "htmlContent", "text_area", "chapter_content", "chapterContent", "chaptercontent",
    "partbody", "BookContent", "read-content", "article_content", "article-content", "BookTextRead", "booktext", "book_text", "BookText", "BookTextt",
    "readtext", "readcon", "read", "TextContent", "txtContent", "text_c", "txt_td", "TXT", "txt", "zjneirong", "contentTxt", "oldtext", "a_content",
    "contents", "content2", "contentts", "content1", "content", "booktxt", "nr", "rtext", "articlecontent", "novelcontent", "text-content",
    "articlebody", "ChapterContents", "acontent", "chapterinfo", "read_content", "chapter-content", "readerFt", "partContent", "ChapterBody",
    "showcontent", "luf_news_contents", "tt_text", "J_BookRead", "zjny", "cont-body", "Lab_Contents", "auto-chapter", "readpage_leftntxt",
]
KNOWN_CLASSES = [
    "novel_content", "readmain_inner", "noveltext", "booktext", "yd_text2", "articlecontent", "readcontent", "txtnav", "content", "art_con",
    "article", "read-content", "bookreadercontent", "novelbody", "chapter-item", "noveContent", "con", "Text", "TxtContent", "article-content",
    "nvl-content", "box_box", "txt_tcontent", "story_content", "chapter_content", "chapter-box",
]
KNOWN_TAGS = ["article"]
POSITIVE = r"(?i)^(content|chapter|article|text|body|main|read|book|novel)|内容|正文|章节|小说|阅读"
NEGATIVE = r"(?i)^(nav|header|footer|sidebar|menu|ad|comment|discuss|recommend)|(广告|评论|推荐|相关|热门|排行|导航|页眉|页脚)"
AD_LIKE, COMMENT_LIKE = r"(?i)ad|sponsor|banner|promo", r"(?i)comment|discuss|reply"
NAV_TEXTS = {
    "next": [r"下一[页頁章节節篇话話]", r"下[页頁章节節话話]", r"(?i)next", r"^\s*>\s*$", r"翻下[页頁]", r"[后後]一章", r"[继繼][续續][阅閱][读讀]", r"下篇", r"[后後]篇"],
    "prev": [r"上一[页頁章节節篇话話]", r"上[页頁章节節话話]", r"(?i)prev", r"^\s*<\s*$", r"翻上[页頁]", r"前一章", r"上篇", r"前篇"],
    "index": [r"^目[录錄]$", r"章[节節]目[录錄]", r"章[节節]列表", r"返回目[录錄]", r"回目[录錄]", r"回[书書]目", r"[书書]目", r"[书書][页頁]", r"(?i)index", r"(?i)catalog"],
}
RELS = {"next": ["next"], "prev": ["prev", "previous"], "index": ["index", "contents", "up"]}
SELECTOR_TAGS = ["h1"]
CONTAINERS = ["div", "article", "section", "main", "td"]


@dataclass(frozen=True)
class Profile:
    """Thresholds of a language: the least share of Han characters, and the least text."""

    han_share: float = 0.3
    han_bonus: bool = True
    least_text: int = 500


ZH, LATIN = Profile(), Profile(0.0, False)


def container_features(pages: DataFrame, tag: str = "article") -> DataFrame:
    """A1 for the first container of a tag, cut out by pattern: page_id, id_class, tag, text, text_len,
    text_density, han, link_density, breaks."""
    cut = F.regexp_extract(without_code(F.col("html")), rf"(?is)(<{tag}\b.*)</{tag}>", 1)
    rows = pages.select("page_id", cut.alias("cut")).where("cut <> ''")
    start = F.regexp_extract("cut", rf"(?is)^(<{tag}\b[^>]*>)", 1)
    links = F.array_join(F.regexp_extract_all("cut", F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), "")
    rows = rows.select("page_id", F.concat_ws(" ", attribute(start, "id"), attribute(start, "class")).alias("id_class"), F.length("cut").alias("html_len"), decoded(F.col("cut")).alias("text"), F.length(decoded(links)).alias("link_len"), F.regexp_count("cut", F.lit(r"(?i)<(p|br)[\s/>]")).alias("breaks"))
    n = F.length("text")
    return rows.select("page_id", F.trim("id_class").alias("id_class"), F.lit(tag).alias("tag"), "text", n.alias("text_len"), T.density(n, F.col("html_len")).alias("text_density"), T.cjk_ratio(F.col("text")).alias("han"), T.density(F.col("link_len"), n).alias("link_density"), "breaks")


def content_score(profile: Profile = ZH) -> Column:
    """A2 over container_features columns."""
    points = [
        (F.rlike("id_class", F.lit(POSITIVE)), 25),
        (F.col("tag").isin("article", "main"), 15),
        (F.col("text_density") > 0.5, 20),
        (F.col("breaks") > 3, 10),
        (F.col("han") > 0.7 if profile.han_bonus else F.lit(False), 15),
        (F.rlike("id_class", F.lit(NEGATIVE)), -25),
        (F.rlike("id_class", F.lit(AD_LIKE)), -30),
        (F.rlike("id_class", F.lit(COMMENT_LIKE)), -20),
        (F.col("link_density") > 0.3, -20),
    ]
    return reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0), points, F.lit(0)) + F.least(F.col("text_len") / 1000, F.lit(20.0))


def valid_content(profile: Profile = ZH) -> Column:
    """P12"""
    return (F.col("text_len") >= profile.least_text) & (F.col("han") >= profile.han_share) & (F.col("link_density") <= 0.5)


def confidence_of(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / 100))


def _known_order() -> Column:
    """The place of an element among the known containers; null for others."""
    known = [("id", n) for n in KNOWN_IDS] + [("class", n) for n in KNOWN_CLASSES] + [("tag", n) for n in KNOWN_TAGS]
    places = F.create_map(*(F.lit(x) for k, (by, n) in enumerate(known) for x in (f"{by}:{n}", k)))
    at = lambda by, c: F.try_element_at(places, F.concat(F.lit(f"{by}:"), c))
    return F.array_min(F.concat(F.array(at("id", F.col("id")), at("tag", F.col("tag"))), F.transform("classes", lambda c: at("class", c))))


def content_elements(nodes: DataFrame, profile: Profile = ZH) -> DataFrame:
    """C1's choice of a page's content: page_id, pos, end_pos, known, tag, score, confidence, src_off,
    src_end. The first known container that is visible and valid (J3, confidence .9, no score), or
    else the visible, valid, not structural one of CONTAINERS with the best score (A1, A2, W1)."""
    solid, n = F.greatest("solid", F.lit(1)), F.greatest("text_len", F.lit(1))
    shares = {"han": F.col("han") / solid, "link_density": F.col("link_text") / n, "text_density": T.density(F.col("text_len"), F.col("html_len"))}
    valid = subtree_totals(nodes).withColumns(shares).where(valid_content(profile)).withColumn("known", _known_order())
    valid = valid.where(F.col("known").isNotNull() | F.col("tag").isin(CONTAINERS))
    valid = valid.withColumn("id_class", F.trim(F.concat_ws(" ", "id", F.array_join("classes", " ")))).withColumn("score", F.when(F.col("known").isNull(), content_score(profile)))
    free = F.col("known").isNotNull() | ((F.col("score") >= 10) & ~F.col("tag").isin("nav", "header", "footer", "aside") & ~F.rlike("id_class", F.lit(classify.STRUCTURAL)))
    shown = valid.where(free & F.col("shown"))
    best = F.row_number().over(Window.partitionBy("page_id").orderBy(F.asc_nulls_last("known"), F.desc("score"), "pos"))
    sure = F.when(F.col("known").isNotNull(), F.lit(0.9)).otherwise(confidence_of(F.col("score")))
    return shown.withColumn("k", best).where("k = 1").select("page_id", "pos", "end_pos", "known", "tag", "score", sure.alias("confidence"), "src_off", "src_end")


def detect_content(pages: DataFrame, profile: Profile = ZH) -> DataFrame:
    """page_id, method, tag, score, confidence, text_len, text (all of it), preview; the text is
    cut out of the page by the chosen element's place in its source."""
    stripped = pages.select("page_id", without_code(F.col("html")).alias("html"))
    kept = content_elements(html_nodes(stripped), profile)
    cut = kept.join(stripped, "page_id").withColumn("text", decoded(F.substr("html", F.col("src_off") + 1, F.col("src_end") - F.col("src_off"))))
    method = F.when(F.col("known").isNotNull(), "known").otherwise("scored")
    return cut.select("page_id", method.alias("method"), "tag", "score", "confidence", F.length("text").alias("text_len"), "text", T.preview(F.col("text")).alias("preview"))


def subtree_totals(nodes: DataFrame) -> DataFrame:
    """For each element, totals of its subtree, from running sums: no join on ranges.

    page_id, pos, end_pos, tag, id, classes, src_off, src_end, text_len, han, solid, link_text, links,
    breaks, html_len, shown (it is not hidden, nor inside an element that is).

    Each node stands at its place and each element again at its end, so one pass over a page's rows
    gives both sums, and the nodes are read once. Texts are measured before the rows are shuffled."""
    element = F.col("kind") == "element"
    text = F.coalesce("text", F.lit(""))
    solid = F.regexp_replace(text, rf"{T.WHITE}+", "")
    own = {"text_len": F.length(text), "han": F.regexp_count(text, F.lit(T.HAN)), "solid": F.length(solid), "links": (F.col("tag") == "a").cast("int"), "breaks": F.col("tag").isin("p", "br").cast("int")}
    kept = ["page_id", "pos", "end_pos", "tag", "id", "classes", "src_off", "src_end"]
    rows = nodes.select(*kept, element.alias("element"), F.when(F.col("tag") == "a", F.col("end_pos")).alias("link_end"), F.when(classify.hidden(), F.col("end_pos")).alias("hidden_end"), *(c.alias(f"o_{k}") for k, c in own.items()))
    places = F.array(F.struct(F.col("pos").alias("at"), F.lit(0).alias("what")), F.struct(F.col("end_pos").alias("at"), F.lit(1).alias("what")))
    rows = rows.select("*", F.explode(F.when(F.col("element"), places).otherwise(F.slice(places, 1, 1))).alias("p")).select("*", "p.at", "p.what").drop("p")
    w = Window.partitionBy("page_id").orderBy("at", "what", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.col("what") == 0
    inside = lambda end: F.coalesce(F.max(F.when(first, F.col(end))).over(w) >= F.col("at"), F.lit(False))
    rows = rows.withColumns({"inside": inside("link_end"), "shown": ~inside("hidden_end")}).withColumn("o_link_text", F.when(F.col("inside"), F.col("o_text_len")).otherwise(0))
    measures = ["text_len", "han", "solid", "link_text", "links", "breaks"]
    rows = rows.withColumns({f"r_{k}": F.sum(F.when(first, F.col(f"o_{k}")).otherwise(0)).over(w) for k in measures}).where("element")
    # what is summed up to the end, without what is summed up to the element, which counts itself
    total = lambda k: F.sum(F.when(first, F.col(f"o_{k}") - F.col(f"r_{k}")).otherwise(F.col(f"r_{k}")))
    same = [F.any_value(c).alias(c) for c in kept[2:]]
    out = rows.groupBy("page_id", "pos").agg(*same, *(total(k).alias(k) for k in measures), F.bool_and(F.when(first, F.col("shown"))).alias("shown"))
    return out.select(*kept, (F.col("src_end") - F.col("src_off")).alias("html_len"), *measures, "shown")


def known_content(nodes: DataFrame, profile: Profile = ZH) -> DataFrame:
    """The first known container, by order of preference, that is visible and valid: page_id, pos, name, confidence."""
    spark = nodes.sparkSession
    known = [("id", n) for n in KNOWN_IDS] + [("class", n) for n in KNOWN_CLASSES] + [("tag", n) for n in KNOWN_TAGS]
    dim = F.broadcast(spark.createDataFrame([(k, n, i) for i, (k, n) in enumerate(known)], "by string, name string, ord int"))
    totals = subtree_totals(nodes)
    keys = F.filter(F.concat(F.array(F.struct(F.lit("id").alias("by"), F.col("id").alias("name")), F.struct(F.lit("tag").alias("by"), F.col("tag").alias("name"))), F.transform("classes", lambda c: F.struct(F.lit("class").alias("by"), c.alias("name")))), lambda x: x["name"] != "")
    found = totals.select("*", F.explode(keys).alias("key")).select("*", "key.*").join(dim, ["by", "name"])
    han, density = F.col("han") / F.greatest("solid", F.lit(1)), F.col("link_text") / F.greatest("text_len", F.lit(1))
    ok = found.where(F.col("shown") & (F.col("text_len") >= profile.least_text) & (han >= profile.han_share) & (density <= 0.5))
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("ord", "pos"))
    return ok.withColumn("k", first).where("k = 1").select("page_id", "pos", "by", "name", F.lit(0.9).alias("confidence"))


def detect_title(pages: DataFrame) -> DataFrame:
    """C4: page_id, title, method, confidence: the first h1, else the document title."""
    heading = T.clean_title(decoded(F.regexp_extract(without_code(F.col("html")), r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)))
    document = classify.title_of(F.col("html"))
    first_part = T.clean_title(F.regexp_extract(document, r"^([^|_-]*)", 1))
    ok = lambda c: F.length(c).between(2, 100)
    rows = pages.select("page_id", heading.alias("h"), document.alias("d"), first_part.alias("f"))
    pick = lambda c, m, p: F.struct(c.alias("title"), F.lit(m).alias("method"), F.lit(p).alias("confidence"))
    chosen = F.when(ok(F.col("h")), pick(F.col("h"), "selector", 0.9)).when(T.is_chapter_title(F.col("d")) & ok(F.col("f")), pick(F.col("f"), "document-title", 0.7)).when(ok(F.col("f")), pick(F.col("f"), "document-title", 0.5))
    return rows.withColumn("x", chosen).select("page_id", F.coalesce("x.title", F.lit("")).alias("title"), F.coalesce("x.method", F.lit("none")).alias("method"), F.coalesce("x.confidence", F.lit(0.0)).alias("confidence"))


def book_title_vote(pages: DataFrame) -> DataFrame:
    """A3: page_id, book_title, score: weighted votes of cleaned candidates; the longer, then the
    earlier of equals. Directory links count only for pages without a strong candidate."""
    metas = page_metas(pages)
    weight = F.when(F.col("key").isin("og:novel:book_name", "og:title:book", "book_name"), 4).when(F.col("key").isin("og:title", "title", "application-name"), 2).when(F.col("key") == "keywords", 3)
    from_meta = metas.where(weight.isNotNull()).select("page_id", F.col("content").alias("raw"), weight.alias("w"), F.lit(0).alias("p"))
    parts = pages.select("page_id", F.posexplode(F.split(classify.title_of(F.col("html")), r"[_|-]")).alias("p", "raw")).select("page_id", "raw", F.lit(1).alias("w"), (F.col("p") + 1).alias("p"))
    votes = lambda rows: rows.select("page_id", T.clean_book_title(F.col("raw")).alias("t"), "w", "p").where(T.valid_book_title(F.col("t"))).groupBy("page_id", "t").agg(F.sum("w").alias("score"), F.min("p").alias("p"))
    first = votes(from_meta.unionByName(parts))
    strong = first.where("score >= 3").select("page_id").distinct()
    weak = pages.join(strong, "page_id", "left_anti")
    links = page_links(weak).where("pos < 200")
    folder = F.rlike(U.path(F.col("abs_url")), F.lit(r"(?i)/(book|novel|info|xiaoshuo)/"))
    from_links = links.where("text <> ''").select("page_id", F.col("text").alias("raw"), F.when(folder, 2).otherwise(1).alias("w"), (F.col("pos") + 100).alias("p"))
    merged = first.unionByName(votes(from_links)).groupBy("page_id", "t").agg(F.sum("score").alias("score"), F.min("p").alias("p"))
    best = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), F.desc(F.length("t")), "p"))
    return merged.withColumn("k", best).where("k = 1").select("page_id", F.col("t").alias("book_title"), "score")


def navigation_score(next_: Column, prev: Column, index: Column) -> Column:
    """.2 without a next link, else the weighted mean of what there is."""
    parts = [(next_, 1.5), (prev, 1.0), (index, 0.5)]
    total = reduce(lambda a, x: a + F.coalesce(x[0], F.lit(0.0)) * x[1], parts, F.lit(0.0))
    weight = reduce(lambda a, x: a + F.when(x[0].isNotNull(), x[1]).otherwise(0.0), parts, F.lit(0.0))
    return F.when(next_.isNull(), F.lit(0.2)).otherwise(total / weight)


def overall_score(content: Column, navigation: Column, title: Column) -> Column:
    """A6"""
    return 0.5 * content + 0.3 * navigation + 0.2 * title


def confidence_reasons(content: Column, next_: Column, prev: Column, index: Column, title: Column, book: Column) -> Column:
    """Ordered reasons."""
    return F.array_compact(
        F.array(
            F.when(content > 0.8, "content: strong").when(content > 0.5, "content: fair").when(content > 0, "content: weak").otherwise("content: none"),
            F.when(next_.isNotNull(), "next link").otherwise("no next link"),
            F.when(prev.isNotNull(), "previous link"),
            F.when(index.isNotNull(), "index link"),
            F.when(title > 0.7, "title: strong").when(title > 0.4, "title: fair").otherwise("title: weak"),
            F.when(book.isNotNull() & (book != ""), "book title"),
        )
    )


def navigation_candidates(pages: DataFrame) -> DataFrame:
    """Scored links: page_id, purpose, pos, abs_url, text, score, method. Links in the first or
    last tenth of a page's links get the position bonus that layout gives elsewhere. The links are read
    once for all purposes."""
    links = page_links(pages).join(pages.select("page_id", F.col("url").alias("current")), "page_id")
    count = F.count(F.lit(1)).over(Window.partitionBy("page_id"))
    links = links.withColumn("edge", (F.col("pos") < count * 0.1) | (F.col("pos") >= count * 0.9))
    each = []
    for purpose, patterns in NAV_TEXTS.items():
        matched = reduce(lambda a, b: a | b, (F.rlike("text", F.lit(p)) for p in patterns))
        n = F.length("text")
        points = [(matched, 10), (matched & (n <= 5), 5), (F.rlike("text", F.lit("|".join(T.CHAPTER_LABELS))), 3), (F.rlike("text", F.lit("|".join(T.SECTION_LABELS))), -2), (F.rlike("title", F.lit("|".join(p for p in patterns if not p.startswith("(?i)")))), 5), (n > 20, -5), (F.col("edge"), 2)]
        if purpose == "index":
            points += [(F.rlike("text", F.lit("《[^》]+》")), 8), (F.rlike(U.path(F.col("abs_url")), F.lit(U.TOC_PATH)), 3)]
        score = reduce(lambda a, x: a + F.when(x[0], x[1]).otherwise(0), points, F.lit(0))
        by_rel = F.col("rel").isin(RELS[purpose])
        verdict = F.struct(F.lit(purpose).alias("purpose"), F.when(by_rel, 1000).otherwise(score).alias("score"), F.when(by_rel, "rel-attribute").otherwise("text-matching").alias("method"), (matched | by_rel).alias("hit"))
        each.append(F.when(classify.valid_nav_link(F.col("abs_url"), F.col("text"), F.lit(purpose), F.col("current")), verdict))
    rows = links.select("page_id", "pos", "abs_url", "text", "current", F.explode(F.array(*each)).alias("x"))
    return rows.where("x.hit or x.score >= 8").select("page_id", "x.purpose", "pos", "abs_url", "text", "current", "x.score", "x.method")


def detect_navigation(pages: DataFrame) -> DataFrame:
    """The best link of each purpose: page_id, purpose, url, text, method, confidence. A next
    link with a smaller chapter number, or a previous one with a larger, counts .7."""
    best = F.row_number().over(Window.partitionBy("page_id", "purpose").orderBy(F.desc("score"), "pos"))
    rows = navigation_candidates(pages).withColumn("k", best).where("k = 1")
    base = F.when(F.col("method") == "rel-attribute", 0.95).otherwise(F.least(F.col("score") / 15, F.lit(0.9)))
    here, there = U.url_chapter_number(F.col("current")), U.url_chapter_number(F.col("abs_url"))
    odd = ((F.col("purpose") == "next") & (there < here)) | ((F.col("purpose") == "prev") & (there > here))
    return rows.select("page_id", "purpose", F.col("abs_url").alias("url"), "text", "method", F.when(F.coalesce(odd, F.lit(False)), base * 0.7).otherwise(base).alias("confidence"))


def detect_pages(pages: DataFrame, profile: Profile = ZH) -> DataFrame:
    """One row per page with content, navigation, title, book title and confidence."""
    content = detect_content(pages, profile).select("page_id", F.col("confidence").alias("content"), "text_len", "preview")
    nav = detect_navigation(pages).groupBy("page_id").agg(*(F.max(F.when(F.col("purpose") == p, F.col("confidence"))).alias(p) for p in NAV_TEXTS), *(F.max(F.when(F.col("purpose") == p, F.col("url"))).alias(f"{p}_url") for p in NAV_TEXTS))
    title = detect_title(pages).select("page_id", "title", F.col("confidence").alias("title_conf"))
    book = book_title_vote(pages).select("page_id", "book_title")
    rows = pages.select("page_id", "url").join(content, "page_id", "left").join(nav, "page_id", "left").join(title, "page_id", "left").join(book, "page_id", "left")
    c = F.coalesce("content", F.lit(0.0))
    navigation = navigation_score(F.col("next"), F.col("prev"), F.col("index"))
    rows = rows.withColumns({"navigation": navigation, "overall": overall_score(c, navigation, F.coalesce("title_conf", F.lit(0.0)))})
    return rows.select("page_id", "url", U.hostname(F.col("url")).alias("host"), U.canonical_url(F.col("url")).alias("canonical_url"), "title", "book_title", c.alias("content"), "navigation", F.col("title_conf"), "overall", (F.col("overall") >= 0.6).alias("is_reliable"), "text_len", "next_url", "prev_url", "index_url", confidence_reasons(c, F.col("next"), F.col("prev"), F.col("index"), F.col("title_conf"), F.col("book_title")).alias("reasons"))
