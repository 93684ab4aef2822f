"""Queries of page parsing, link graphs and frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators import detect, parse, rules, sections, store
from leafmill.plans.page_queries import CONTENT, LINKS, s_decoded
from leafmill.plans.text_queries import RULES
from leafmill.plans.url_queries import _CANONICAL, sql_host, sql_path, sql_section
from leafmill.sources import pages as S
from leafmill.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""with {CONTENT}, m as (select page_id, case when regexp_matches(url, '(?i)(casino|pills|bets)') and not regexp_matches(url, '(?i)/fr/') then 'shop' when regexp_matches(url, '(?i)^http.*://blog\\..*$') and not regexp_matches(url, '(?i)page=2') then 'blog' when regexp_matches(url, '(?i)\\.example\\.org/') then 'org' when regexp_matches(url, '(?i)/en/[0-9]+') and not regexp_matches(url, '(?i)^https://m\\.') then 'english' end as rule_id from pages)
select page_id, rule_id, case when rule_id is not null then 'rule' else 'detection' end as method, md5(text) as content from m join c4 using (page_id) where rule_id is not null or (text_len >= 500 and link_density <= 0.5)""")
def parse_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.parse_pages(S.read_pages(spark, sf_dir), RULES, profile=detect.LATIN)
    return rows.select("page_id", "rule_id", "method", F.md5(F.col("content_text").cast("binary")).alias("content"))


#: Rules of the pages by selectors: one whose content is always there, one whose second alternative
#: is, and one whose content never is, so that it is detected.
SELECTOR_RULES = [
    {**RULES[0], "content": "body > article", "title": "div.ad", "next": "nav li a:eq(1)", "prev": False, "index": "nav a:first", "remove": "h1"},
    {**RULES[2], "content": "#none, article:contains(e)", "title": ".none, .ad", "next": "footer a", "prev": "ul > li > a:last", "replace": [("[0-9]+", "#", "g")]},
    {**RULES[3], "content": ".chapter-text", "next": "li a:eq(-2)"},
]


@query(f"""with {LINKS}, {CONTENT}, m as (select page_id, url, case when regexp_matches(url, '(?i)(casino|pills|bets)') and not regexp_matches(url, '(?i)/fr/') then 'shop' when regexp_matches(url, '(?i)\\.example\\.org/') then 'org' when regexp_matches(url, '(?i)/en/[0-9]+') and not regexp_matches(url, '(?i)^https://m\\.') then 'english' end as rule_id, regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1) as ad from pages),
n as (select page_id, count(*) as n from links group by 1),
l as (select page_id, max(abs_url) filter (pos = 0) as l0, max(abs_url) filter (pos = 1) as l1, max(abs_url) filter (pos = n - 2) as l4, max(abs_url) filter (pos = n - 1) as l5 from links join n using (page_id) group by 1)
select m.page_id, coalesce(m.rule_id, '') as rule_id, case when ruled then 'rule' when m.rule_id is null then 'detection' else 'mixed' end as method,
       case when ruled then trim({s_decoded('ad')}) end as title,
       case m.rule_id when 'shop' then l1 when 'english' then l4 end as next_url, case m.rule_id when 'org' then l5 end as prev_url, case m.rule_id when 'shop' then l0 end as index_url
from (select *, coalesce(rule_id = 'shop' or (rule_id = 'org' and contains(text, 'e')), false) as ruled from m join c4 using (page_id)) m left join l using (page_id) where ruled or (text_len >= 500 and link_density <= 0.5)""")
def parse_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C6 by selectors; the detected titles of other pages are those of title_detect."""
    rows = parse.parse_chapters(S.read_pages(spark, sf_dir), SELECTOR_RULES, profile=detect.LATIN)
    return rows.select("page_id", F.coalesce("rule_id", F.lit("")).alias("rule_id"), "method", F.when(F.col("method") == "rule", F.col("title")).alias("title"), "next_url", "prev_url", "index_url")


_K = sql_section(sql_path("url"))


@query(f"select page_id, coalesce({_K[1]} > 1, false) as is_section, {_K[1]} as section from pages")
def sections_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links are no section links, so what is found comes from their URLs."""
    return parse.detect_sections(S.read_pages(spark, sf_dir)).select("page_id", "is_section", "section")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page leads to the page of the next number, by a URL with a fragment."""
    p = S.read_pages(spark, sf_dir).select("page_id", "url")
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.concat(U.without_fragment(F.col("url")), F.lit("#x")).alias("dst_url"))
    return p.join(nxt, "page_id").select(F.col("url").alias("src_url"), F.lit("next").alias("rel"), "dst_url")


_GRAPH = f"k as (select page_id, {_CANONICAL} as key from pages), f as (select key, min(page_id) as page_id from k group by 1)"


@query(f"with {_GRAPH} select a.page_id as src_id, 'next' as rel, b.page_id as dst_id from k x join k y on y.page_id = x.page_id + 1 join f a on a.key = x.key join f b on b.key = y.key")
def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.link_graph(S.read_pages(spark, sf_dir), _edges(spark, sf_dir))


@query(f"""with {LINKS}, seen as (select url from pages where page_id % 2 = 0), stops as (select distinct abs_url as url from links where page_id % 9 = 0),
plan as (select abs_url as url, min(page_id) as ord from links where page_id % 4 = 1 group by 1), nxt as (select x.url as src, regexp_replace(y.url, '#.*$', '') || '#x' as dst from pages x join pages y on y.page_id = x.page_id + 1),
c as (select url, 0 as rank, ord from plan union all select dst, 1, 0 from nxt where src in (select url from seen))
select url, min(rank) as rank, cast(arg_min(ord, rank * 1000000 + ord) as int) as ord from c where url not in (select url from seen) and url not in (select url from stops) group by 1""")
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.read_pages(spark, sf_dir)
    links = S.page_links(pages)
    plan = links.where("page_id % 4 = 1").groupBy(F.col("abs_url").alias("url")).agg(F.min("page_id").cast("int").alias("ord"))
    seen = pages.where("page_id % 2 = 0").select("url")
    return store.crawl_frontier(plan, _edges(spark, sf_dir), seen, links.where("page_id % 9 = 0").select(F.col("abs_url").alias("url")))


_PURPOSES = "(values ('next'), ('prev'), ('index')) t(purpose)"


@query(f"with d as (select page_id, purpose, purpose || '/' || page_id as found from pages, {_PURPOSES} where page_id % 3 > 0) select p.page_id, p.purpose, case when page_id_ % 2 = 0 and p.purpose <> 'index' then case when page_id_ % 4 = 0 then 'rule/' || p.purpose end else d.found end as url from (select page_id, page_id as page_id_, purpose from pages, {_PURPOSES}) p left join d on d.page_id = p.page_id and d.purpose = p.purpose where (page_id_ % 2 = 0 and p.purpose <> 'index') or d.found is not null")
def coalesce_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even pages have rules for next and previous; of these every other says there is none."""
    p = S.read_pages(spark, sf_dir).select("page_id", F.explode(F.array(*map(F.lit, ("next", "prev", "index")))).alias("purpose"))
    found = p.where("page_id % 3 > 0").select("page_id", "purpose", F.concat("purpose", F.lit("/"), F.col("page_id").cast("string")).alias("url"))
    ruled = p.where("page_id % 2 = 0 and purpose <> 'index'").select("page_id", "purpose", F.lit(True).alias("defined"), F.when(F.pmod("page_id", F.lit(4)) == 0, F.concat(F.lit("rule/"), "purpose")).alias("url"))
    return rules.coalesce_navigation(ruled, found)


@query("""with j as (select event_id, case event_id % 4 when 0 then '{"data":{"bookName":"T' || user_id || '"},"k":' || event_id || '}' when 1 then '{"@type":"Book","name":" N ' || user_id || ' "}' when 2 then props else '{"book":{"novel":{"book_title":"D"}},"isPartOf":{"@type":"Novel","name":"P"}}' end as j from events)
select event_id, case event_id % 4 when 0 then json_extract_string(j, '$.data.bookName') when 1 then trim(json_extract_string(j, '$.name')) when 3 then json_extract_string(j, '$.isPartOf.name') end as title from j""")
def json_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F24 over JSON made from events."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr("""case event_id % 4 when 0 then '{"data":{"bookName":"T' || user_id || '"},"k":' || event_id || '}' when 1 then '{"@type":"Book","name":" N ' || user_id || ' "}' when 2 then props else '{"book":{"novel":{"book_title":"D"}},"isPartOf":{"@type":"Novel","name":"P"}}' end""").alias("j"))
    return e.select("event_id", parse.json_find_title(F.col("j")).alias("title"))


@query("select event_id, floor(least(greatest(value - 20, 0.0), 100.0) * 10 + 0.5) / 10 as percent from events where value is not null and not isnan(value)")
def percent_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1"""
    return table(spark, sf_dir, "events").where("value is not null and not isnan(value)").select("event_id", T.percent(F.col("value") - 20).alias("percent"))


@query(f"with {LINKS} select l.page_id, l.pos, coalesce({sql_host('abs_url')} = {sql_host('url')} and regexp_extract(abs_url, '^([a-z]+://)', 1) = regexp_extract(url, '^([a-z]+://)', 1) and (regexp_extract({sql_path('url')}, '/([0-9]{{3,}})(?:/|$)', 1) = '' or contains({sql_path('abs_url')}, regexp_extract({sql_path('url')}, '/([0-9]{{3,}})(?:/|$)', 1))), false) as ok from links l join pages using (page_id)")
def toc_pagination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23 of every link against its own page."""
    pages = S.read_pages(spark, sf_dir)
    rows = S.page_links(pages).join(pages.select("page_id", "url"), "page_id")
    return rows.select("page_id", "pos", U.toc_pagination_link(F.col("abs_url"), F.col("url")).alias("ok"))
