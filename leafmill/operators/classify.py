"""Page classes and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.sources.pages import attribute, decoded, page_links, without_code

# Wording of catalogs, chapters, challenges and paywalls.
TOC_TITLE = r"(?i)章节目录|章節目錄|章节列表|章節列表|目录|目錄|书目|書目|toc|catalog|contents?"
CHAPTER_LINK = r"(?i)第\s*[一二两三四五六七八九十○零百千万亿0-9]{1,9}\s*[章回卷节折篇幕集话話]|chapter\s*[0-9]+"
NAV_LINK = r"(?i)下一[章页]|上一[章页]|next|prev"
NEXT_LINK = r"下一[章页节篇回]|下页"
NOVEL_TITLE = r"(?i)第.{1,10}章|chapter|小说|阅读"
KNOWN_IDS = ["content", "chapter_content", "BookText"]
CHALLENGE_MARKS = r"(?i)_cf_chl_opt|cf_chl_|challenges\.cloudflare\.com"
CHALLENGE_TITLES = ["just a moment...", "attention required! | cloudflare"]
CHALLENGE_SENTENCE = r"(?i)enable javascript and cookies to continue"
LOCKED = [
    r"本章(为|是)?vip章节",
    r"(vip|付费|收费)(章节|内容)",
    r"(未订阅|未购买|未解锁).{0,10}(本章|本章节|章节|内容)",
    r"(本章|本章节|章节|内容).{0,12}已?锁定",
    r"(本章|本章节|章节|内容).{0,12}(需|需要).{0,6}(订阅|购买|付费|解锁)",
    r"(订阅|购买|付费|解锁).{0,12}(后|即可|才能|方可|才可).{0,12}(阅读|查看|继续阅读|继续查看)",
    r"(请|需).{0,6}(订阅|购买|付费|解锁).{0,12}(阅读|查看|继续阅读|继续查看)",
    r"立即(订阅|购买|解锁|充值)",
    r"(订阅|购买|解锁)本章",
]
LOCKED_MARKS = r"[\s，。！？、“”‘’（）()【】\[\]<>《》:：;；·~…—-]+"
TOC_PAGES = [r"(?i)/book/[0-9]+\.html?$", r"(?i)/book/[0-9]+/?$", r"(?i)/novel/[0-9]+/?$", r"(?i)/xiaoshuo/[0-9]+/?$", r"(?i)/info/[0-9]+\.html?$", r"(?i)/[0-9]+/index\.html?$", r"(?i)/booklist", r"(?i)/catalog", r"(?i)/contents?\.html?$", r"(?i)/list\.html?$", r"(?i)/toc\.html?$"]
TOC_WORDS = ["目录", "章节列表", "章节目录", "全部章节", "最新章节", "小说目录", r"(?i)\btable of contents\b", r"(?i)\btoc\b", r"(?i)\bcatalog\b", r"(?i)\bindex\b"]
CHAPTER_HREF = r"(?i)/(chapter|txt|read|book|novel|article)/|[0-9]+\.html?$|/xs_[^/]+/[0-9]+/[0-9]+(/[0-9]+)?"
CHAPTER_NAME = r"^第.{1,10}[章节回话篇集卷]"
LOADING = r"(?i)加载中|载入中|loading|请稍候|请稍等|正在加载"
NAV_INVALID = r"(?i)/(login|register|search|user|author|forum|comment|download|rank)(/|\.|$)"
STRUCTURAL = r"(?i)nav|menu|sidebar|footer|header"


def title_of(html: Column) -> Column:
    return T.trim(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def body_text(html: Column) -> Column:
    """Text of the body without scripts and styles."""
    return decoded(without_code(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1)))


def page_features(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, title, text_len, paragraphs, links, chapter_links, nav_links, link_text."""
    html = F.col("html")
    own = pages.select("page_id", "url", title_of(html).alias("title"), F.length(body_text(html)).alias("text_len"), F.regexp_count(without_code(html), F.lit(r"(?i)<p[\s>]")).alias("paragraphs"))
    raw = pages.select("page_id", F.explode(F.regexp_extract_all(without_code(html), F.lit(r"(?is)(<a\b[^>]*>.*?)</a>"), F.lit(1))).alias("raw"))
    start = F.regexp_extract("raw", r"(?is)^(<a\b[^>]*>)", 1)
    each = raw.where(attribute(start, "href") != "").select("page_id", T.trim(decoded(F.substr("raw", F.length(start) + 1))).alias("text"))
    links = each.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("links"),
        F.sum(F.length("text")).alias("link_text"),
        F.count_if(F.rlike("text", F.lit(CHAPTER_LINK))).alias("chapter_links"),
        F.count_if(F.rlike("text", F.lit(NAV_LINK))).alias("nav_links"),
        F.count_if(F.rlike("text", F.lit(NEXT_LINK))).alias("next_links"),
    )
    return own.join(links, "page_id", "left").na.fill(0, ["links", "link_text", "chapter_links", "nav_links", "next_links"])


def dom_kind() -> Column:
    """P2 over page_features columns."""
    density = F.col("link_text") / F.greatest(F.col("text_len"), F.lit(1))
    few = (F.col("chapter_links") <= 12) & (density < 0.25)
    return (
        F.when(F.rlike("title", F.lit(TOC_TITLE)), "toc")
        .when((F.col("chapter_links") >= 25) & (density >= 0.12), "toc")
        .when((F.col("links") >= 120) & (F.col("chapter_links") >= 15) & (density >= 0.08), "toc")
        .when((F.col("nav_links") > 0) & (F.col("text_len") >= 2000) & few, "chapter")
        .when((F.col("text_len") >= 8000) & few, "chapter")
        .when((F.col("paragraphs") >= 8) & (F.col("text_len") >= 4000) & few, "chapter")
        .otherwise("other")
    )


def page_kind() -> Column:
    """The URL's verdict, or else the page's."""
    return F.coalesce(F.nullif(U.page_kind_url(F.col("url")), F.lit("other")), dom_kind())


def page_kinds(pages: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """P2, P3; features: page_features of the pages, where they are at hand."""
    return (page_features(pages) if features is None else features).select("page_id", U.page_kind_url(F.col("url")).alias("url_kind"), dom_kind().alias("dom_kind"), page_kind().alias("kind"))


def quick_checks(pages: DataFrame, features: DataFrame | None = None) -> DataFrame:
    """At least two of five signs of a chapter; features as in page_kinds."""
    ids = F.rlike("html", F.lit(rf"(?i)\sid\s*=\s*[\"']({'|'.join(KNOWN_IDS)})[\"']|\sclass\s*=\s*[\"'][^\"']*\bnoveltext\b"))
    features = (page_features(pages) if features is None else features).join(pages.select("page_id", ids.alias("known")), "page_id")
    signs = [F.rlike("title", F.lit(NOVEL_TITLE)), F.col("known"), F.col("next_links") > 0, F.col("text_len") > 3000, F.rlike("url", F.lit(r"(?i)/chapters?/")) & (F.col("text_len") > 1200)]
    total = reduce(lambda a, b: a + b, (F.coalesce(s.cast("int"), F.lit(0)) for s in signs))
    return features.select("page_id", total.alias("signs"), (total >= 2).alias("looks_like_chapter"))


def is_challenge() -> Column:
    """P5 over url and html."""
    html = F.col("html")
    resource = F.rlike(html, F.lit(r"(?i)(src|href)\s*=\s*[\"'][^\"']*/cdn-cgi/challenge-platform/"))
    background = F.rlike(html, F.lit(r"(?i)/cdn-cgi/challenge-platform/scripts/(jsd|precursor)/"))
    widget = F.regexp_replace(html, r"(?i)src\s*=\s*[\"'](https?:)?//challenges\.cloudflare\.com/turnstile/v0/api\.js[^\"']*[\"']", "")
    scripts = F.array_join(F.regexp_extract_all(widget, F.lit(r"(?is)(<script\b.*?</script>)"), F.lit(1)), "\n")
    return F.coalesce(
        F.startswith(U.path(F.col("url")), F.lit("/cdn-cgi/"))
        | F.rlike(html, F.lit(r"(?i)\s(id|class)\s*=\s*[\"'][^\"']*cf-chl|<form[^>]+action\s*=\s*[\"'][^\"']*/cdn-cgi/|<iframe[^>]+src\s*=\s*[\"'][^\"']*(challenges|captcha)\.cloudflare\.com"))
        | (resource & ~background)
        | F.lower(title_of(html)).isin(CHALLENGE_TITLES)
        | F.rlike(scripts, F.lit(CHALLENGE_MARKS))
        | F.rlike(F.regexp_replace(body_text(html), r"\s+", " "), F.lit(CHALLENGE_SENTENCE)),
        F.lit(False),
    )


def is_locked() -> Column:
    """P6 over html."""
    squeeze = lambda c: F.lower(F.regexp_replace(c, LOCKED_MARKS, ""))
    text = squeeze(body_text(F.col("html")))
    calls = squeeze(F.array_join(F.regexp_extract_all("html", F.lit(r"(?is)<(?:a|button)\b[^>]*>(.*?)</(?:a|button)>"), F.lit(1)), " "))
    worded = F.rlike(text, F.lit("|".join(LOCKED)))  # one search, or else the text is made anew for each
    return F.coalesce(worded | (F.rlike(calls, F.lit("立即(订阅|购买|解锁|充值)")) & F.rlike(text, F.lit("vip|付费|订阅|购买|解锁|锁定"))), F.lit(False))


def block_reasons(pages: DataFrame) -> DataFrame:
    """Challenge before locked, else null."""
    return pages.select("page_id", F.when(is_challenge(), "challenge").when(is_locked(), "locked").alias("reason"))


def toc_pages(pages: DataFrame, current: Column) -> DataFrame:
    """P10: (page_id, is_toc); current is the URL of the chapter that led to each page."""
    html = F.col("html")
    text = F.col("text")
    own = pages.select("page_id", "url", current.alias("current"), body_text(html).alias("text"))
    links = page_links(pages).join(own.select("page_id", "current"), "page_id")
    bare = lambda c: F.regexp_replace(U.path(c), "/$", "")
    counted = links.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length("text")).alias("link_text"),
        F.count_if(F.rlike("href", F.lit(CHAPTER_HREF))).alias("chapter_hrefs"),
        F.coalesce(F.bool_or(bare(F.col("abs_url")) == bare(F.col("current"))), F.lit(False)).alias("to_current"),
        F.count_if(F.rlike("text", F.lit(CHAPTER_NAME))).alias("names"),
    )
    size = F.length(text)
    by_url = reduce(lambda a, b: a | b, (F.rlike("url", F.lit(p)) for p in TOC_PAGES))
    by_shape = F.rlike(U.path(F.col("current")), F.lit(r"(?i)/(txt|read|chapter|article)/[0-9]+/[0-9]+")) & F.rlike(U.path(F.col("url")), F.lit(r"(?i)/(book|novel|info|xiaoshuo)/[0-9]+"))
    words = reduce(lambda a, b: a + b, (F.rlike(text, F.lit(w)).cast("int") for w in TOC_WORDS))
    n = F.col("n")
    out = by_url | F.coalesce(by_shape, F.lit(False)) | ((size < 500) & (n > 10)) | ((F.col("link_text") > 0.6 * size) & (size > 0) & (n > 8)) | (F.col("chapter_hrefs") > 10) | (F.col("to_current") & (n > 5)) | (words >= 2) | ((words >= 1) & (n > 15)) | (F.col("names") > 5)
    return own.join(counted, "page_id", "left").na.fill(0, ["n", "link_text", "chapter_hrefs", "names"]).na.fill(False, ["to_current"]).select("page_id", F.coalesce(out, F.lit(False)).alias("is_toc"))


def valid_nav_link(url: Column, text: Column, purpose: Column, current: Column) -> Column:
    """P11"""
    p = U.path(url)
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    indexed = (purpose == "index") & (F.rlike(text, F.lit("目[录錄]|index|catalog|《[^》]+》")))
    same = (U.without_fragment(url) == U.without_fragment(current)) & ~F.rlike(url, F.lit("#chapter"))
    labelled = F.rlike(text, F.lit(r"(?i)[上下]一?[页頁章节節篇话話]|next|prev"))
    short = (F.size(parts) == 0) | ((F.size(parts) == 1) & ~F.rlike(p, F.lit("[0-9]")) & ~labelled & ~indexed)
    trailing = (purpose != "index") & F.endswith(p, F.lit("/")) & (F.size(parts) < 2)
    return F.coalesce(U.is_http(url) & (~F.rlike(p, F.lit(NAV_INVALID)) | indexed) & ~same & ~short & ~trailing, F.lit(False))


def hidden() -> Column:
    """By attribute or inline style."""
    return F.map_contains_key("attrs", "hidden") | F.rlike(F.coalesce(F.col("attrs")["style"], F.lit("")), F.lit(r"(?i)display\s*:\s*none|visibility\s*:\s*(hidden|collapse)"))


def visible(nodes: DataFrame, ancestors: bool = True) -> DataFrame:
    """Nodes that are not hidden, nor inside one that is."""
    if not ancestors:
        return nodes.where(~hidden())
    gone = nodes.where(hidden()).select(F.col("page_id").alias("p"), F.col("pos").alias("a"), F.col("end_pos").alias("b"))
    return nodes.join(gone, (F.col("page_id") == F.col("p")) & F.col("pos").between(F.col("a"), F.col("b")), "left_anti")


def not_structural(nodes: DataFrame) -> DataFrame:
    """No navigation, header, footer or side parts."""
    named = F.concat_ws(" ", "id", F.array_join("classes", " "))
    return nodes.where(~F.col("tag").isin("nav", "header", "footer", "aside") & ~F.rlike(named, F.lit(STRUCTURAL)))


def insufficient_content(text: Column) -> Column:
    """Empty, under 80 solid characters, or a loading notice."""
    solid = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), rf"{T.WHITE}+", ""))
    return (solid < 80) | (F.rlike(text, F.lit(LOADING)) & (solid < 200))


def leads_out_of_book(target: Column, index: Column, current: Column, cached: Column) -> Column:
    """The book's index, or what is neither cached nor a chapter."""
    return F.coalesce(U.block_key(target) == U.block_key(index), F.lit(False)) | (~cached & U.is_invalid_chapter_url(target, current))


def load_gate(edges: DataFrame) -> DataFrame:
    """P25: adds verdict to rows of target, index_url, current, cached, locked, blocked, loaded, incomplete."""
    out = leads_out_of_book(F.col("target"), F.col("index_url"), F.col("current"), F.col("cached"))
    verdict = (
        F.when(F.col("target").isNull(), F.when(F.col("incomplete"), "incomplete").otherwise("end"))
        .when(out, "out_of_book")
        .when(F.col("locked"), "locked")
        .when(F.col("blocked"), "blocked")
        .when(F.col("loaded"), "loaded")
        .otherwise("load")
    )
    return edges.withColumn("verdict", verdict)


def auto_enable(pages: DataFrame) -> DataFrame:
    """The ordered ladder over page_id, url, reason, url_kind, dom_kind, preference (boolean or
    null), rule_id, quick and confidence."""
    manual = lambda m: F.struct(F.lit(False).alias("enabled"), F.lit(m).alias("method"), F.lit(True).alias("manual"))
    yes = lambda m: F.struct(F.lit(True).alias("enabled"), F.lit(m).alias("method"), F.lit(False).alias("manual"))
    no = lambda m: F.struct(F.lit(False).alias("enabled"), F.lit(m).alias("method"), F.lit(False).alias("manual"))
    pref = F.col("preference")
    off = F.coalesce(~pref, F.lit(False))
    decision = (
        F.when(F.col("reason") == "challenge", no("challenge"))
        .when(F.col("reason") == "locked", no("locked"))
        .when(U.skip_url(F.col("url")), no("skip"))
        .when(F.col("url_kind") == "toc", no("toc"))
        .when(F.coalesce(pref, F.lit(False)) & (F.col("url_kind") == "chapter"), yes("preference"))
        .when(F.col("rule_id").isNotNull() & ~off, yes("rule"))
        .when(F.col("dom_kind") == "toc", no("toc"))
        .when(F.coalesce(pref, F.lit(False)), yes("preference"))
        .when((F.col("url_kind") == "other") & (F.col("dom_kind") == "other") & ~F.col("quick"), no("not_chapter"))
        .when(~F.col("quick"), no("quick_check"))
        .when((F.col("confidence") >= 0.6) & ~off, manual("detection"))
        .otherwise(no("confidence"))
    )
    out = pages.withColumn("d", decision)
    return out.select("page_id", "d.enabled", "d.method", "d.manual", (F.col("d.enabled") & ((F.col("d.method") == "rule") | (F.col("confidence") >= 0.9))).alias("auto_launch"))
