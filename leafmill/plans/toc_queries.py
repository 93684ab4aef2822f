"""Queries of tables of contents: the links of all pages of a host are its catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators import toc
from leafmill.plans.page_queries import LINKS, q, rx
from leafmill.plans.url_queries import _BOOK, _PATTERN, sql_bare, sql_host
from leafmill.sources.pages import read_pages

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.collect_candidates(read_pages(spark, sf_dir), U.hostname(F.col("url")), every_link=True)


_LIKELY = lambda c: "(" + " or ".join(rx(f"trim({c})", p) for p in T.LIKELY_TITLES) + ")"
_OTHER = lambda c: f"(length(trim({c})) < 2 or " + " or ".join(rx(f"trim({c})", p) for p in T.OTHER_TITLES) + ")"
_HOLDER = lambda c: rx(f"trim({c})", r"^章节\s*[0-9]+$")


def _better(a: str, b: str) -> str:
    return f"case when {_LIKELY(b)} and not {_LIKELY(a)} then true when {_LIKELY(a)} and not {_LIKELY(b)} then false when not {_HOLDER(a)} and {_HOLDER(b)} then false when {_HOLDER(a)} and not {_HOLDER(b)} then true else length({b}) > length({a}) end"


_NUM = lambda c: "coalesce(" + ", ".join(f"try_cast(case when {rx(c, p)} then regexp_extract({c}, {q(p)}, 1) end as bigint)" for p in T.TITLE_NUMBERS) + ")"

CAND = f"""{LINKS},
host as (select page_id, {sql_host('url')} as toc_id from pages),
cand as (select toc_id, page_id as page_no, pos, case when text = '' then '章节 ' || (pos + 1) else text end as title, abs_url as url, cast(null as varchar) as access from links join host using (page_id)),
dd as (select toc_id, url, list({{'page_no': page_no, 'pos': pos, 'title': title}} order by page_no desc, pos desc) as a from cand group by 1, 2),
ded as (select toc_id, a[1].page_no as page_no, a[1].pos as pos, list_reduce(list_transform(a, lambda x: x.title), lambda x, y: case when {_better('x', 'y')} then y else x end) as title, url from dd)"""
FILT = f"""{CAND},
sized as (select *, count(*) over (partition by toc_id) as size from ded),
bk as (select *, {_BOOK} as book from sized where size >= 5),
bc as (select toc_id, book, count(*) as n, min(page_no * 100000 + pos) as f from bk where book is not null group by 1, 2),
main as (select toc_id, book as main from bc qualify row_number() over (partition by toc_id order by n desc, f) = 1 and n >= 5),
lg as (select bk.*, {_PATTERN} as pattern from bk left join main using (toc_id) where main is null or book is null or book = main),
pc as (select toc_id, pattern, count(*) as n, min(page_no * 100000 + pos) as f from lg group by 1, 2),
pr as (select *, sum(n) over (partition by toc_id) as total, row_number() over (partition by toc_id order by n desc, f) as k from pc),
pf as (select *, n >= 5 or n / total > 0.3 as fit from pr),
pb as (select *, coalesce(sum(case when fit then n else 0 end) over (partition by toc_id order by k rows between unbounded preceding and 1 preceding), 0) as before, bool_or(fit) over (partition by toc_id) as anyfit from pf),
pats as (select toc_id, pattern from pb where (fit and before <= 0.9 * total) or (not anyfit and k = 1)),
sc as (select lg.*, (case when p.pattern is not null then 2 else 0 end) + (case when {_LIKELY('title')} then 1 else 0 end) - (case when not {_LIKELY('title')} and {_OTHER('title')} then 2 else 0 end) >= 1 as strict, not {_OTHER('title')} as lenient from lg left join pats p on p.toc_id is not distinct from lg.toc_id and p.pattern = lg.pattern),
ct as (select *, count(*) over w as n, count(*) filter (strict) over w as ns, count(*) filter (lenient) over w as nl from sc window w as (partition by toc_id)),
filt as (select toc_id, page_no, pos, title, url from sized where size < 5 union all
  select toc_id, page_no, pos, title, url from ct where case when (ns < 0.3 * n or ns < 10) and nl >= ns then lenient else strict end)"""
SORT = f"""{FILT},
s1 as (select *, {_NUM('title')} as num from filt),
s2 as (select *, count(*) over w as n, count(num) over w as nn, count(distinct num) over w as nd from s1 window w as (partition by toc_id)),
s3 as (select toc_id, num, lag(num) over (partition by toc_id order by page_no, pos) as before from s1 where num is not null),
s4 as (select toc_id, count(*) filter (num < before) as down, count(*) filter (num > before) as up from s3 group by 1),
s5 as (select s2.*, nn = n and nd = n as bynum, coalesce(down, 0) as down, coalesce(up, 0) as up, row_number() over (partition by s2.toc_id order by page_no, pos) as place from s2 left join s4 on s2.toc_id = s4.toc_id),
s6 as (select *, case when bynum then num when n >= 5 and nn >= 3 and nn >= 0.3 * n and down > 0.6 * (down + up) then -place else place end as key from s5),
toc as (select toc_id, row_number() over (partition by toc_id order by key, page_no, pos) as ord, title, url from s6)"""


@query(f"with {CAND} select toc_id, page_no, pos, title, url from ded")
def toc_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.dedupe(candidates(spark, sf_dir)).drop("access")


@query(f"with {FILT} select toc_id, pattern from pats")
def toc_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toc.dedupe(candidates(spark, sf_dir))
    large = rows.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("toc_id"))).where("size >= 5")
    return toc.dominant_patterns(toc.dominant_book(large))


@query(f"with {FILT} select * from filt")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.filter_entries(toc.dedupe(candidates(spark, sf_dir))).drop("access")


@query(f"with {SORT} select toc_id, cast(ord as int) as ord, title, url from toc")
def toc_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.build_toc(read_pages(spark, sf_dir), U.hostname(F.col("url")), every_link=True).drop("access")


@query(f"with {CAND} select toc_id, title, url from ded where contains(lower(title), 'the')")
def toc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.search(toc.dedupe(candidates(spark, sf_dir)), " The ").select("toc_id", "title", "url")


_STATUS = f"""{CAND}, keyed as (select ded.*, {sql_bare('url')} as k from ded),
cached as (select distinct {sql_bare('abs_url')} as k from links where page_id % 3 = 0), persisted as (select distinct {sql_bare('abs_url')} as k from links where page_id % 5 = 0), cur as (select distinct {sql_bare('abs_url')} as k from links where page_id % 7 = 0)"""


def _loaded(links: DataFrame, n: int) -> DataFrame:
    return links.where(F.pmod("page_no", F.lit(n)) == 0).select("url")


@query(f"with {_STATUS} select toc_id, url, k in (select k from cached) as is_cached, k in (select k from persisted) as is_persisted, k in (select k from cur) as is_current from keyed")
def toc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    return toc.toc_status(toc.dedupe(rows), _loaded(rows, 3), _loaded(rows, 5), _loaded(rows, 7)).select("toc_id", "url", "is_cached", "is_persisted", "is_current")


@query(f"""with {_STATUS}, o as (select keyed.*, row_number() over (partition by toc_id order by page_no, pos) as ord from keyed), i as (select toc_id, {sql_bare("'https://' || toc_id || '/the'")} as k from host)
select toc_id, cast(min(ord) as int) as ord, k as url from o where ord <= 10000 and k not in (select k from cached) and k not in (select k from persisted) and (toc_id, k) not in (select toc_id, k from i) group by toc_id, k""")
def cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(spark, sf_dir)
    ordered = toc.dedupe(rows).withColumn("ord", F.row_number().over(Window.partitionBy("toc_id").orderBy("page_no", "pos")))
    index = read_pages(spark, sf_dir).select(U.hostname(F.col("url")).alias("toc_id")).distinct().withColumn("url", F.concat(F.lit("https://"), "toc_id", F.lit("/the")))
    return toc.cache_plan(ordered, _loaded(rows, 3), _loaded(rows, 5), index)


@query(f"""with {CAND}, f as (select *, min(page_no) over (partition by toc_id, url) as first from cand),
per as (select toc_id, page_no, count(*) as entries, count(*) filter (first = page_no) as fresh from f group by 1, 2),
k as (select *, row_number() over (partition by toc_id order by page_no) > 1 and fresh = 0 as stops from per)
select toc_id, count(*) as pages, cast(sum(fresh) as bigint) as entries, case when count(*) > 120 then 'too_many_pages' when count(*) filter (stops) > 0 then 'no_new_entries' else 'complete' end as outcome from k group by 1""")
def toc_load_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toc.load_report(candidates(spark, sf_dir))


@query()
def toc_next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leafmill.sources.pages import page_links

    pages = read_pages(spark, sf_dir)
    return toc.next_toc_page(page_links(pages), pages)
