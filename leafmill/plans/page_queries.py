"""Queries over pages: links, classes, gates, content, titles, confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.operators import classify, detect
from leafmill.plans.url_queries import ex, sql_bare, sql_http, sql_kind, sql_path
from leafmill.sources import pages as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''") + "'"


def rx(c: str, p: str) -> str:
    return f"regexp_matches({c}, {q(p)})"


_CODE = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"


def s_code(h: str) -> str:
    return f"regexp_replace({h}, {q(_CODE)}, '', 'g')"


def s_decoded(t: str) -> str:
    return reduce(lambda a, e: f"replace({a}, {q(e[0])}, {q(e[1])})", S.ENTITIES, f"regexp_replace({t}, '<[^>]*>', '', 'g')")


def s_attr(t: str, name: str) -> str:
    pattern = r"(?i)\s" + name + r"\s*=\s*[\"'']([^\"'']*)[\"'']"
    return f"regexp_extract({t}, '{pattern}', 1)"


def s_trim(t: str) -> str:
    return f"regexp_replace({t}, {q(f'^{T.SPACE}+|{T.SPACE}+$')}, '', 'g')"


def s_title(h: str) -> str:
    return s_trim(s_decoded(f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)"))


def s_body(h: str) -> str:
    cut = f"regexp_extract({h}, '(?is)<body[^>]*>(.*)', 1)"
    return s_decoded(s_code(cut))


_RAW_LINKS = f"""raw as (select page_id, url, i - 1 as pos, l[i] as raw from (select page_id, url, l, unnest(range(1, len(l) + 1)) as i from (select page_id, url, regexp_extract_all({s_code('html')}, '(?is)(<a\\b[^>]*>.*?)</a>', 1) as l from pages)))"""
_START = "regexp_extract(raw, '(?is)^(<a\\b[^>]*>)', 1)"
_INNER = f"substr(raw, length({_START}) + 1)"
_ROOT = ex("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)")
LINKS = f"""{_RAW_LINKS},
l1 as (select page_id, url, pos, {s_attr(_START, 'href')} as href, {s_trim(s_decoded(_INNER))} as text, {s_attr(_START, 'title')} as title, lower({s_attr(_START, 'rel')}) as rel, {s_attr(_START, 'class')} as cls from raw),
l2 as (select *, case when regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') then trim(href) when href like '//%' then {ex('url', '^([A-Za-z][A-Za-z0-9+.-]*:)')} || trim(href) when href like '/%' then {_ROOT} || trim(href) when href like '#%' then {sql_bare('url')} || trim(href) else {_ROOT} || regexp_extract({sql_path('url')}, '^(.*/)', 1) || trim(href) end as abs_url from l1 where href <> ''),
links as (select page_id, cast(pos as int) as pos, href, abs_url, text, regexp_replace(text, {q(T.SPACE + '+')}, '', 'g') as norm_text, title, rel, cls from l2 where {sql_http('abs_url')})"""


@query(f"with {LINKS} select * from links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_links(S.read_pages(spark, sf_dir))


@query(f"with {LINKS} select page_id, count(*) as n, count(distinct abs_url) as n_distinct, min(abs_url) as first from links group by 1")
def page_link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = S.page_links(S.read_pages(spark, sf_dir))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("abs_url").alias("n_distinct"), F.min("abs_url").alias("first"))


@query(f"""with m as (select page_id, i, t[i] as tag from (select page_id, t, unnest(range(1, len(t) + 1)) as i from (select page_id, regexp_extract_all(html, '(?is)(<meta\\b[^>]*>)', 1) as t from pages))),
k as (select page_id, i, lower(coalesce(nullif({s_attr('tag', 'name')}, ''), nullif({s_attr('tag', 'property')}, ''), case when {s_attr('tag', 'charset')} <> '' then 'charset' end)) as key, coalesce(nullif({s_attr('tag', 'content')}, ''), {s_attr('tag', 'charset')}) as content from m)
select page_id, key, arg_min(content, i) as content from k where key is not null group by 1, 2""")
def page_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_metas(S.read_pages(spark, sf_dir))


@query(f"""with m as (select page_id, cast(i - 1 as int) as pos, t[i] as raw from (select page_id, t, unnest(range(1, len(t) + 1)) as i from (select page_id, regexp_extract_all(html, '(?is)(<script\\b.*?)</script>', 1) as t from pages)))
select page_id, pos, {s_attr("regexp_extract(raw, '(?is)^(<script\\b[^>]*>)', 1)", 'src')} as src, {s_attr("regexp_extract(raw, '(?is)^(<script\\b[^>]*>)', 1)", 'type')} as type, substr(raw, length(regexp_extract(raw, '(?is)^(<script\\b[^>]*>)', 1)) + 1) as body from m""")
def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_scripts(S.read_pages(spark, sf_dir))


@query()
def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible, non-structural nodes by tag."""
    nodes = classify.visible(classify.not_structural(S.html_nodes(S.read_pages(spark, sf_dir))))
    return nodes.groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("text_len"))


@query()
def node_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtree totals of every element."""
    return detect.subtree_totals(S.html_nodes(S.read_pages(spark, sf_dir))).drop("classes", "end_pos", "shown")


@query()
def known_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.known_content(S.html_nodes(S.read_pages(spark, sf_dir)), detect.LATIN)


FEATURES = f"""{_RAW_LINKS},
lt as (select page_id, {s_trim(s_decoded(_INNER))} as text from raw where {s_attr(_START, 'href')} <> ''),
lc as (select page_id, count(*) as links, sum(length(text)) as link_text, count(*) filter ({rx('text', classify.CHAPTER_LINK)}) as chapter_links, count(*) filter ({rx('text', classify.NAV_LINK)}) as nav_links, count(*) filter ({rx('text', classify.NEXT_LINK)}) as next_links from lt group by 1),
f as (select page_id, url, html, {s_title('html')} as title, length({s_body('html')}) as text_len, len(regexp_extract_all({s_code('html')}, '(?i)<p[\\s>]')) as paragraphs, coalesce(links, 0) as links, coalesce(link_text, 0) as link_text, coalesce(chapter_links, 0) as chapter_links, coalesce(nav_links, 0) as nav_links, coalesce(next_links, 0) as next_links from pages left join lc using (page_id))"""
_D = "link_text / greatest(text_len, 1)"
_FEW = f"chapter_links <= 12 and {_D} < 0.25"
_DOM = f"""case when {rx('title', classify.TOC_TITLE)} then 'toc' when chapter_links >= 25 and {_D} >= 0.12 then 'toc' when links >= 120 and chapter_links >= 15 and {_D} >= 0.08 then 'toc'
 when nav_links > 0 and text_len >= 2000 and {_FEW} then 'chapter' when text_len >= 8000 and {_FEW} then 'chapter' when paragraphs >= 8 and text_len >= 4000 and {_FEW} then 'chapter' else 'other' end"""


@query(f"with {FEATURES} select page_id, {sql_kind('url')} as url_kind, {_DOM} as dom_kind, coalesce(nullif({sql_kind('url')}, 'other'), {_DOM}) as kind from f")
def page_kind_dom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.page_kinds(S.read_pages(spark, sf_dir))


_KNOWN = r"(?i)\sid\s*=\s*[\"'](content|chapter_content|BookText)[\"']|\sclass\s*=\s*[\"'][^\"']*\bnoveltext\b"
_SIGNS = f"cast({rx('title', classify.NOVEL_TITLE)} as int) + cast(regexp_matches(html, {q(_KNOWN)}) as int) + cast(next_links > 0 as int) + cast(text_len > 3000 as int) + cast({rx('url', '(?i)/chapters?/')} and text_len > 1200 as int)"


@query(f"with {FEATURES} select page_id, {_SIGNS} as signs, {_SIGNS} >= 2 as looks_like_chapter from f")
def page_quick_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.quick_checks(S.read_pages(spark, sf_dir))


@query(f"""with t as (select page_id, url, html, {s_body('html')} as body from pages),
x as (select page_id, case when {sql_path('url')} like '/cdn-cgi/%' or {rx('html', '(?i)cf-chl')} or lower({s_title('html')}) in ({', '.join(map(q, classify.CHALLENGE_TITLES))}) or {rx('html', classify.CHALLENGE_MARKS)} or {rx("regexp_replace(body, '[ \\n\\r\\t\\f]+', ' ', 'g')", classify.CHALLENGE_SENTENCE)} then 'challenge'
 when {' or '.join(rx(f"lower(regexp_replace(body, {q(classify.LOCKED_MARKS)}, '', 'g'))", p) for p in classify.LOCKED)} then 'locked' end as reason from t)
select * from x""")
def page_block_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.block_reasons(S.read_pages(spark, sf_dir))


_CUT = f"regexp_extract({s_code('html')}, '(?is)(<article\\b.*)</article>', 1)"
CONTENT = f"""c1 as (select page_id, {_CUT} as cut from pages),
c2 as (select page_id, trim({s_attr("regexp_extract(cut, '(?is)^(<article\\b[^>]*>)', 1)", 'id')} || ' ' || {s_attr("regexp_extract(cut, '(?is)^(<article\\b[^>]*>)', 1)", 'class')}) as id_class, length(cut) as html_len, {s_decoded('cut')} as text,
  length({s_decoded("array_to_string(regexp_extract_all(cut, '(?is)<a\\b[^>]*>(.*?)</a>', 1), '')")}) as link_len, len(regexp_extract_all(cut, '(?i)<(p|br)[\\s/>]')) as breaks from c1 where cut <> ''),
c3 as (select page_id, id_class, text, length(text) as text_len, length(text) / greatest(html_len, 1) as text_density, case when length(regexp_replace(text, {q(T.SPACE + '+')}, '', 'g')) > 0 then len(regexp_extract_all(text, {q(T.HAN)})) / length(regexp_replace(text, {q(T.SPACE + '+')}, '', 'g')) else 0.0 end as han, link_len / greatest(length(text), 1) as link_density, breaks from c2),
c4 as (select *, (case when {rx('id_class', detect.POSITIVE)} then 25 else 0 end) + 15 + (case when text_density > 0.5 then 20 else 0 end) + (case when breaks > 3 then 10 else 0 end) - (case when {rx('id_class', detect.NEGATIVE)} then 25 else 0 end) - (case when {rx('id_class', detect.AD_LIKE)} then 30 else 0 end) - (case when {rx('id_class', detect.COMMENT_LIKE)} then 20 else 0 end) - (case when link_density > 0.3 then 20 else 0 end) + least(text_len / 1000, 20.0) as score from c3)"""


@query(f"with {CONTENT} select page_id, text_len, round(text_density, 6) as text_density, round(han, 6) as han, round(link_density, 6) as link_density, breaks, round(score, 6) as score from c4")
def content_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.container_features(S.read_pages(spark, sf_dir)).withColumn("score", detect.content_score(detect.LATIN))
    return rows.select("page_id", "text_len", *(F.round(c, 6).alias(c) for c in ("text_density", "han", "link_density")), "breaks", F.round("score", 6).alias("score"))


_PREVIEW = f"case when length({s_trim('text')}) > 200 then substr({s_trim('text')}, 1, 200) || '...' else {s_trim('text')} end"


# an article is a known container, and these pages have no other that is long enough
@query(f"with {CONTENT} select page_id, 'known' as method, 'article' as tag, cast(null as double) as score, cast(0.9 as double) as confidence, text_len, {_PREVIEW} as preview from c4 where text_len >= 500 and link_density <= 0.5")
def content_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.detect_content(S.read_pages(spark, sf_dir), detect.LATIN)
    return rows.select("page_id", "method", "tag", F.round("score", 6).alias("score"), F.round("confidence", 8).alias("confidence"), "text_len", "preview")


def s_chain(c: str, patterns: list[str], to: str = "") -> str:
    return reduce(lambda a, p: f"regexp_replace({a}, {q(p)}, {q(to)}, 'g')", patterns, c)


def s_clean_title(c: str) -> str:
    return f"trim(regexp_replace({s_chain(f'trim({c})', T.TITLE_REMOVALS)}, '[ \\n\\r\\t\\f\\v]+', ' ', 'g'))"


_H1 = s_clean_title(s_decoded(f"regexp_extract({s_code('html')}, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)"))
TITLES = f"""t1 as (select page_id, {_H1} as h, {s_title('html')} as d from pages),
t2 as (select page_id, h, d, {s_clean_title("regexp_extract(d, '^([^|_-]*)', 1)")} as f from t1),
titles as (select page_id, case when length(h) between 2 and 100 then h when length(f) between 2 and 100 then f else '' end as title, case when length(h) between 2 and 100 then 'selector' when length(f) between 2 and 100 then 'document-title' else 'none' end as method,
  case when length(h) between 2 and 100 then 0.9 when length(f) between 2 and 100 then case when {rx('d', T.CHAPTER_TITLE)} then 0.7 else 0.5 end else 0.0 end as confidence from t2)"""


@query(f"with {TITLES} select page_id, title, method, cast(confidence as double) as confidence from titles")
def title_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_title(S.read_pages(spark, sf_dir))


def s_book(c: str) -> str:
    t = f"trim({c})"
    t = f"(case when regexp_matches({t}, '《[^》]+》') then regexp_extract({t}, '《([^》]+)》', 1) else {t} end)"
    t = f"regexp_replace({t}, {q(r'^[\s\-_|,，:：·]+|[\s\-_|,，:：·]+$')}, '', 'g')"
    t = s_chain(t, [rf"\s*第[{T.NUMERALS}]+[章回卷节].*$", r"(最新章节|全文阅读|全文免费阅读|无弹窗|小说)+$", rf"[\s\-_|]+({'|'.join(sorted(T.SITE_WORDS, key=len, reverse=True))})$"])
    return f"trim({t})"


def s_valid_book(c: str) -> str:
    return f"(length({c}) between 2 and 100 and not {rx(c, T.GENERIC_BOOK)} and {c} not in ({', '.join(map(q, T.SITE_WORDS))}))"


@query(f"""with {LINKS},
parts as (select page_id, p[i] as raw, 1 as w, i as p from (select page_id, p, unnest(range(1, len(p) + 1)) as i from (select page_id, regexp_split_to_array({s_title('html')}, '[_|-]') as p from pages))),
v1 as (select page_id, t, sum(w) as score, min(p) as p from (select page_id, {s_book('raw')} as t, w, p from parts) where {s_valid_book('t')} group by 1, 2),
v2 as (select page_id, t, sum(w) as score, min(p) as p from (select page_id, {s_book('text')} as t, case when {rx(sql_path('abs_url'), '(?i)/(book|novel|info|xiaoshuo)/')} then 2 else 1 end as w, pos + 100 as p from links where pos < 200 and text <> '' and page_id not in (select page_id from v1 where score >= 3)) where {s_valid_book('t')} group by 1, 2),
v as (select page_id, t, sum(score) as score, min(p) as p from (select * from v1 union all select * from v2) group by 1, 2)
select page_id, t as book_title, cast(score as bigint) as score from v qualify row_number() over (partition by page_id order by score desc, length(t) desc, p) = 1""")
def book_title_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.book_title_vote(S.read_pages(spark, sf_dir))


@query()
def navigation_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.detect_navigation(S.read_pages(spark, sf_dir))


@query(f"""with {CONTENT}, {TITLES}, x as (select p.page_id, case when text_len >= 500 and link_density <= 0.5 then cast(0.9 as double) else 0.0 end as content, titles.confidence as title from pages p left join c4 using (page_id) left join titles using (page_id))
select page_id, round(content, 8) as content, cast(0.2 as double) as navigation, cast(title as double) as title, round(0.5 * content + 0.06 + 0.2 * title, 8) as overall, 0.5 * content + 0.06 + 0.2 * title >= 0.6 as is_reliable,
 (case when content > 0.8 then 'content: strong' when content > 0.5 then 'content: fair' when content > 0 then 'content: weak' else 'content: none' end) || '; no next link; ' || (case when title > 0.7 then 'title: strong' when title > 0.4 then 'title: fair' else 'title: weak' end) as reasons from x""")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6-A8 for pages whose links are no chapter navigation."""
    pages = S.read_pages(spark, sf_dir)
    content = detect.detect_content(pages, detect.LATIN).select("page_id", F.col("confidence").alias("content"))
    rows = pages.select("page_id").join(content, "page_id", "left").join(detect.detect_title(pages).select("page_id", F.col("confidence").alias("title")), "page_id", "left")
    none = F.lit(None).cast("double")
    c, nav = F.coalesce("content", F.lit(0.0)), detect.navigation_score(none, none, none)
    overall = detect.overall_score(c, nav, F.col("title"))
    reasons = detect.confidence_reasons(c, none, none, none, F.col("title"), F.lit(None).cast("string"))
    return rows.select("page_id", F.round(c, 8).alias("content"), nav.alias("navigation"), "title", F.round(overall, 8).alias("overall"), (overall >= 0.6).alias("is_reliable"), F.array_join(reasons, "; ").alias("reasons"))


@query()
def parse_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that is detected, one row per page."""
    return detect.detect_pages(S.read_pages(spark, sf_dir), detect.LATIN)

