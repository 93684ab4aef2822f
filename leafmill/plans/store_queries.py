"""Queries of stores, positions, failures and sections, over events, orders, lineitem and conversations.

A user reads (reader), an event type stands for a URL, an event's value for a percentage; an order
is a book or chapter, its lines are chapters or pages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.operators import rules, sections, store
from leafmill.tables import delete_at_exit, shared_folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: The moment that the store queries take for now.
NOW = "1999-01-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("reader"), F.col("event_type").alias("url"), F.col("value").alias("percent"), micros("ts").alias("updated_at"))


_POS = "p as (select user_id as reader, event_type as url, value as percent, epoch_us(ts) as updated_at, event_id from events), pc as (select *, floor(least(greatest(percent, 0.0), 100.0) * 10 + 0.5) / 10 as pct from p where percent is not null and not isnan(percent))"


@query(f"with {_POS} select reader, url, arg_max(pct, {{'u': updated_at, 'p': pct}}) as percent, max(updated_at) as updated_at from pc group by 1, 2")
def positions_lww(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.merge_positions(positions(spark, sf_dir))


@query(f"with {_POS}, b as (select reader, url || ':' || (event_id % 500) as url, arg_max(pct, {{'u': updated_at, 'p': pct}}) as percent, max(updated_at) as updated_at from pc group by 1, 2) select * from b qualify row_number() over (partition by reader order by updated_at desc, url desc) <= 20")
def positions_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("reader"), F.concat_ws(":", "event_type", F.pmod("event_id", F.lit(500)).cast("string")).alias("url"), F.col("value").alias("percent"), micros("ts").alias("updated_at"))
    return store.merge_positions(rows, keep=20)


@query(f"with {_POS}, s as (select *, case when event_id % 2 = 0 then 0 else 1 end as src, updated_at // 3600000000 as h from pc) select reader, url, arg_max(pct, {{'u': h, 's': src, 'p': pct}}) as percent, max(h) as updated_at from s group by 1, 2")
def positions_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X2 of two writers whose clocks tick hourly: of equal times the later source wins."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("user_id").alias("reader"), F.col("event_type").alias("url"), F.col("value").alias("percent"), F.floor(micros("ts") / 3_600_000_000).cast("long").alias("updated_at"))
    return store.merge_positions(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"))


@query(f"with {_POS} select reader, url, updated_at // 4000000 * 4000000 as slot, arg_max(pct, {{'u': updated_at, 'p': pct}}) as percent, count(*) as events from pc group by 1, 2, 3")
def positions_4s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2's batch twin: at most one write in four seconds."""
    from leafmill.functions.text import percent

    rows = positions(spark, sf_dir).withColumn("percent", percent(F.col("percent"))).where("percent is not null")
    slot = (F.floor(F.col("updated_at") / 4_000_000) * 4_000_000).cast("long")
    return rows.groupBy("reader", "url", slot.alias("slot")).agg(F.max(F.struct("updated_at", "percent")).alias("x"), F.count(F.lit(1)).alias("events")).select("reader", "url", "slot", "x.percent", "events")


@query("""with e as (select user_id, event_id, epoch_us(ts) as t from events), g as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) < 3600000000 then 0 else 1 end as new from e),
s as (select *, sum(new) over (partition by user_id order by t, event_id rows unbounded preceding) as k from g)
select user_id, min(t) as started, max(t) as last, count(*) as events from s group by user_id, k""")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of changes, closed by a quiet hour; one write each."""
    e = table(spark, sf_dir, "events").withColumn("t", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("t", "1 hour").alias("w")).agg(F.min(micros("t")).alias("started"), F.max(micros("t")).alias("last"), F.count(F.lit(1)).alias("events")).select("user_id", "started", "last", "events")


@query("""with e as (select user_id, event_type, event_id, epoch_us(ts) as t from events), g as (select *, case when event_type = lag(event_type) over w and t - lag(t) over w <= 18000000000 then 0 else 1 end as new from e window w as (partition by user_id order by t, event_id)),
s as (select *, sum(new) over (partition by user_id order by t, event_id rows unbounded preceding) as k from g) select user_id, event_type, min(t) as started, max(t) as last, count(*) as events from s group by user_id, k, event_type""")
def reading_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session ends when the reader turns to another chapter or pauses for five hours."""
    e = table(spark, sf_dir, "events").withColumn("t", micros("ts"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    same = (F.col("event_type") == F.lag("event_type").over(w)) & (F.col("t") - F.lag("t").over(w) <= 18_000_000_000)
    rows = e.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "k", "event_type").agg(F.min("t").alias("started"), F.max("t").alias("last"), F.count(F.lit(1)).alias("events")).drop("k")


@query("""with e as (select user_id as key, epoch_us(ts) as t, event_type = 'error' as failed from events), s as (select key, max(t) filter (not failed) as ok from e group by 1)
select e.key, count(*) as n, max(t) as failed_at from e join s on e.key = s.key where failed and (ok is null or t > ok) group by 1""")
def nav_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), micros("ts").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    return store.navigation_failures(e)


_STATUS = "case event_type when 'view' then 200 when 'click' then 502 when 'purchase' then 429 when 'signup' then 404 else 503 end"


@query(f"""with l as (select user_id || '/' || (event_id % 997) as url, epoch_us(ts) as ts, event_id as id, {_STATUS} as status from events),
r as (select *, row_number() over w as attempt, count(*) filter (status = 429) over w as limited from l window w as (partition by url order by ts, id rows between unbounded preceding and current row)),
a as (select url, attempt, case when status between 200 and 399 then 'done' when ((status in (500, 502, 503, 504) and attempt < 3) or (status = 429 and limited = 1)) and 2 * power(2, attempt - 1) * 1.2 <= 60 then 'retry' else 'stop' end as action from r)
select url, cast(attempt as int) as attempt, action from a""")
def retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    status = F.expr(_STATUS)
    log = e.select(F.concat_ws("/", F.col("user_id").cast("string"), F.pmod("event_id", F.lit(997)).cast("string")).alias("url"), micros("ts").alias("ts"), F.col("event_id").alias("id"), status.alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("double").alias("retry_after"))
    return store.retry_plan(log).select("url", "attempt", "action")


@query("select user_id, event_id, epoch_us(ts) as t from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 50")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.trim_newest(table(spark, sf_dir, "events"), ["user_id"], "ts", store.EVENTS, "event_id")
    return rows.select("user_id", "event_id", micros("ts").alias("t"))


@query("select event_type, event_id from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 500")
def lru_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.trim_newest(table(spark, sf_dir, "events"), ["event_type"], "ts", store.CHAPTERS, "event_id").select("event_type", "event_id")


@query("with a as (select user_id, case when event_type = 'error' then null else event_type in ('view', 'click') end as enabled, event_id as ts from events) select cast(user_id as varchar) as hostname, arg_max(cast(enabled as int), ts) filter (true) as enabled from (select user_id, coalesce(cast(enabled as int), -1) as enabled, ts from a) group by 1 having arg_max(enabled, ts) >= 0")
def site_prefs_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    act = e.select(F.col("user_id").cast("string").alias("hostname"), F.when(F.col("event_type") != "error", F.col("event_type").isin("view", "click")).alias("enabled"), F.col("event_id").alias("ts"), "event_id")
    out = rules.upsert_preferences(act.where("event_id % 2 = 0").drop("event_id"), act.where("event_id % 2 = 1").drop("event_id"))
    return out.select("hostname", F.col("enabled").cast("int").alias("enabled"))


def _store(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chapter store, book index, protected books): customers are books, their orders chapters."""
    o = table(spark, sf_dir, "orders")
    chapters = o.select(F.col("o_custkey").alias("book_id"), F.col("o_orderkey").cast("string").alias("url"), F.when(F.pmod("o_orderkey", F.lit(97)) > 0, F.col("o_orderstatus")).alias("content"), F.col("o_orderdate").cast("timestamp").alias("cached_at"))
    listed = o.where("o_orderkey % 5 <> 0").groupBy(F.col("o_custkey").alias("book_id")).agg(F.array_sort(F.collect_set(F.col("o_orderkey").cast("string"))).alias("urls"), F.min(F.col("o_orderdate").cast("timestamp")).alias("last_updated"), F.max(F.col("o_orderdate").cast("timestamp")).alias("last_accessed"))
    return chapters, listed.withColumn("index_url", F.lit("")), table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("book_id"))


_BOOKS = f"""st as (select o_custkey as book_id, cast(o_orderkey as varchar) as url, o_orderkey as k, case when o_orderkey % 97 > 0 then o_orderstatus end as content, epoch_us(o_orderdate) as t from orders),
ix as (select book_id, max(t) as acc from st where k % 5 <> 0 group by 1), prot as (select c_custkey as book_id from customer where c_custkey % 10 = 0),
gone as (select book_id from ix where epoch_us(timestamp '{NOW}') - acc > 30 * 86400000000 and book_id not in (select book_id from prot))"""


@query(f"with {_BOOKS} select book_id, url from st where k % 5 = 0 and (content is null or (epoch_us(timestamp '{NOW}') - t > 30 * 86400000000 and book_id not in (select book_id from prot)))")
def orphan_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, index, protected = _store(spark, sf_dir)
    return store.orphan_chapters(chapters, index, protected, F.lit(NOW).cast("timestamp")).select("book_id", "url")


@query(f"with {_BOOKS} select book_id, url from st where not (k % 5 <> 0 and book_id in (select book_id from gone))")
def expire_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, index, protected = _store(spark, sf_dir)
    return store.expire_books(index, chapters, protected, F.lit(NOW).cast("timestamp"))[1].select("book_id", "url")


@query(f"with {_BOOKS}, del as (select c_custkey as book_id from customer where c_custkey % 4 = 1) select book_id, url from st where not (book_id in (select book_id from del) and (k % 5 <> 0 or book_id not in (select book_id from ix)))")
def delete_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, index, _ = _store(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").where("c_custkey % 4 = 1").select(F.col("c_custkey").alias("book_id"))
    return store.delete_book(chapters, index, gone)[0].select("book_id", "url")


def _line_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are books, parts their chapters, written again with each line that sells them."""
    rows = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber"))
    return rows.select(F.col("l_suppkey").cast("string").alias("book_id"), F.col("l_partkey").cast("string").alias("url"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("content"), F.when(F.pmod("l_orderkey", F.lit(11)) > 0, F.col("l_shipdate").cast("timestamp")).alias("cached_at"), "line")


def _stored(spark: SparkSession, sf_dir: str) -> store.ChapterStore:
    """A store after three writes: lines 1 and 4, 2 and 5, and 3, 6 and 7 of the orders."""
    out = store.ChapterStore(spark, f"{shared_folder(spark).rstrip('/')}/leafmill-store-{uuid.uuid4().hex}", buckets=16)
    rows = _line_chapters(spark, sf_dir)
    for lines in ((1, 4), (2, 5), (3, 6, 7)):
        out.write(rows.where(F.col("line").isin(*lines)).drop("line"))
        out.vacuum()
    delete_at_exit(spark, out.path)
    return out


_LINES = """l as (select cast(l_suppkey as varchar) as book_id, cast(l_partkey as varchar) as url, l_orderkey || ':' || l_linenumber as content, case when l_orderkey % 11 > 0 then epoch_us(l_shipdate) end as t, case when l_linenumber in (3, 6, 7) then 3 else l_linenumber % 3 end as w from lineitem),
last as (select * from l qualify row_number() over (partition by book_id, url order by t desc nulls last, w desc, content desc) = 1)"""


@query(f"with {_LINES} select book_id, url, content, t as cached_at from last")
def chapter_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that overlap keep the newest record of each book and URL, and all others."""
    return _stored(spark, sf_dir).read().select("book_id", "url", "content", F.unix_micros("cached_at").alias("cached_at"))


@query(f"with {_LINES} select book_id, url, content from last where cast(url as bigint) % 7 <> 0 and book_id in ('3', '7')")
def chapter_store_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters that became locked are taken out of the store; two books are read."""
    held = _stored(spark, sf_dir)
    held.remove(_line_chapters(spark, sf_dir).where("cast(url as long) % 7 = 0").select("book_id", "url"))
    return held.read("3").unionByName(held.read("7")).select("book_id", "url", "content")


@query("select o_custkey as book_id, list_sort(list(distinct cast(o_orderkey as varchar))) as urls from orders group by 1")
def book_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.build_book_index(_store(spark, sf_dir)[0], F.lit(NOW).cast("timestamp")).select("book_id", "urls")


@query(f"with {_BOOKS}, l as (select book_id, list(url) as bad from st where k % 3 = 0 group by 1), i as (select book_id, list_sort(list(distinct url)) as urls from st where k % 5 <> 0 group by 1), x as (select i.book_id, case when bad is null then urls else list_filter(urls, lambda u: not list_contains(bad, u)) end as urls from i left join l on i.book_id = l.book_id) select * from x where len(urls) > 0")
def evict_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters, index, _ = _store(spark, sf_dir)
    return store.evict_locked(index, chapters.where("cast(url as long) % 3 = 0").select("book_id", "url")).select("book_id", "urls")


@query("""with ev as (select user_id as book_id, epoch_us(ts) as t, event_id from events), b as (select book_id, min(t) as acc from ev group by 1), a as (select book_id, max(t) as t from ev where event_id % 3 = 0 group by 1)
select b.book_id, case when a.t is not null and a.t - acc >= 86400000000 then a.t else acc end as last_accessed from b left join a on b.book_id = a.book_id""")
def index_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("book_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    index = e.groupBy("book_id").agg(F.min("ts").alias("last_accessed"))
    return store.touch_books(index, e.where("event_id % 3 = 0")).select("book_id", micros("last_accessed").alias("last_accessed"))


@query("with r as (select cast(o_orderkey as varchar) as url, case o_orderstatus when 'F' then 'failed' when 'O' then 'ok' else 'locked' end as outcome from orders where o_orderkey % 2 = 0) select o_custkey as toc_id, count(*) as total, count(*) filter (outcome in ('ok', 'locked')) as done, count(*) filter (outcome = 'failed') as failed from orders left join r on cast(o_orderkey as varchar) = r.url group by 1")
def cache_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    plan = o.select(F.col("o_custkey").alias("toc_id"), F.col("o_orderkey").cast("string").alias("url"))
    results = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("url"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ok").otherwise("locked").alias("outcome"))
    return store.cache_progress(plan, results)


@query("""with e as (select o_orderkey as k, o_orderkey + 1 + case when o_orderkey % 7 = 0 then 1 else 0 end as n, o_orderkey - 1 as p from orders)
select cast(a.k as varchar) as src_url, cast(a.p as varchar) as dst_url, coalesce(b.n = a.k, false) as reciprocal, coalesce(b.n = a.k, true) as valid from e a left join e b on b.k = a.p""")
def reciprocal_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    nxt = o.select(F.col("k").cast("string").alias("src_url"), F.lit("next").alias("rel"), (F.col("k") + 1 + F.when(F.pmod("k", F.lit(7)) == 0, 1).otherwise(0)).cast("string").alias("dst_url"))
    prev = o.select(F.col("k").cast("string").alias("src_url"), F.lit("prev").alias("rel"), (F.col("k") - 1).cast("string").alias("dst_url"))
    return store.reciprocal_navigation(nxt.unionByName(prev))


_SEC = "s as (select l_orderkey as key, l_linenumber + case when l_suppkey % 13 = 1 then 50 else 0 end as section, case when l_partkey % 9 = 0 then l_linenumber + 1 when l_partkey % 3 = 0 then l_linenumber end as mp, case when l_partkey % 3 = 0 then 5 + case when l_suppkey % 11 = 0 then 1 else 0 end end as mt, l_shipmode_ as content, l_returnflag as title, l_suppkey as sk from (select *, l_returnflag || l_linestatus || l_partkey as l_shipmode_ from lineitem))"
_ACC = f"""{_SEC}, o as (select *, row_number() over (partition by key order by section, content, sk) as ord, first_value(mt ignore nulls) over (partition by key order by section, content, sk rows between unbounded preceding and current row) as kt from s where section <= 10),
b as (select *, min(case when section <> ord or coalesce(mp <> ord, false) or coalesce(mt <> kt, false) then ord end) over (partition by key) as bad from o), acc as (select * from b where bad is null or ord < bad)"""


_TIES = ("content", "next_url")


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as pages of an order; some marks are wrong, and lines of some suppliers far off."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.selectExpr(
        "l_orderkey as key", "l_linenumber + case when l_suppkey % 13 = 1 then 50 else 0 end as section", "case when l_partkey % 9 = 0 then l_linenumber + 1 when l_partkey % 3 = 0 then l_linenumber end as marker_page",
        "case when l_partkey % 3 = 0 then 5 + case when l_suppkey % 11 = 0 then 1 else 0 end end as marker_total",
        "concat(l_returnflag, l_linestatus, l_partkey) as content", "l_returnflag as title", "l_suppkey as next_url", "case when l_linestatus = 'F' then 'hans' when l_returnflag = 'N' then 'hant' else 'unknown' end as script",
    )


@query(f"with {_ACC} select key, section, cast(ord as int) as ord, kt as known_total from acc")
def sections_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.contiguous(_sections(spark, sf_dir), ties=_TIES).select("key", "section", "ord", "known_total")


@query(f"with {_ACC} select key, string_agg(content, '<p></p>' order by ord) as content, arg_min(title, ord) as title from acc group by 1")
def sections_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.merge_sections(sections.contiguous(_sections(spark, sf_dir), ties=_TIES)).select("key", "content", "title")


@query(f"with {_ACC}, a as (select key, count(*) as loaded, max(kt) as total from acc group by 1), p as (select key, count(*) as pages from s group by 1) select p.key, coalesce(loaded, 0) as loaded, total, coalesce(loaded, 0) < pages or coalesce(loaded < total, false) as truncated from p left join a on p.key = a.key")
def section_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sections(spark, sf_dir)
    return sections.completeness(rows, sections.contiguous(rows, ties=_TIES))


@query("""with recursive n as (select distinct conv_id, turn from conversations), e as (select a.conv_id || '/' || a.turn as src, a.conv_id || '/' || (case when a.turn % 5 = 4 then 0 else a.turn + 1 end) as dst from n a where exists (select 1 from n b where b.conv_id = a.conv_id and b.turn = case when a.turn % 5 = 4 then 0 else a.turn + 1 end)),
c(start, url, ord, seen) as (select conv_id || '/0', conv_id || '/0', 1, [conv_id || '/0'] from n where turn = 0 union all select c.start, e.dst, c.ord + 1, list_append(c.seen, e.dst) from c join e on c.url = e.src where c.ord < 99 and not list_contains(c.seen, e.dst)) select start, url, ord from c""")
def section_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C12 over turns; every fifth turn leads back to the first, so chains must stop by themselves."""
    n = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    to = F.when(F.pmod("turn", F.lit(5)) == 4, 0).otherwise(F.col("turn") + 1)
    name = lambda t: F.concat_ws("/", F.col("conv_id").cast("string"), t.cast("string"))
    edges = n.withColumn("to", to).join(n.select("conv_id", F.col("turn").alias("to")), ["conv_id", "to"], "left_semi").select(name(F.col("turn")).alias("src"), name(F.col("to")).alias("dst"))
    return sections.section_chain(edges, n.where("turn = 0").select(name(F.col("turn")).alias("url")))


@query("select conv_id as key, string_agg(trim(text), '<p></p>' order by turn) filter (trim(text) <> '') as content from conversations group by 1")
def conversation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9 over conversations."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("ord"), F.col("text").alias("content"), F.col("role").alias("title"), F.lit("").alias("next_url"), F.lit("unknown").alias("script"))
    return sections.merge_sections(c).select("key", "content")


@query("""with c as (select l_orderkey as book, l_linenumber as ord, 'https://x.example.com/b/' || l_orderkey || '/' || l_linenumber as url, case l_partkey % 3 when 0 then null when 1 then 'https://x.example.com/b/' || l_orderkey || '/' || l_linenumber || '/' else 'https://x.example.com/b/' || l_orderkey || '/?' || l_linenumber end as ix from lineitem),
o as (select *, case when regexp_replace(ix, '/$', '') <> url then ix end as own from c), k as (select book, arg_min(own, ord) as known from o where own is not null group by 1) select o.book, ord, url, coalesce(own, known) as index_url from o left join k on o.book = k.book""")
def index_url_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey as book", "l_linenumber as ord", "concat('https://x.example.com/b/', l_orderkey, '/', l_linenumber) as url", "case l_partkey % 3 when 0 then null when 1 then concat('https://x.example.com/b/', l_orderkey, '/', l_linenumber, '/') else concat('https://x.example.com/b/', l_orderkey, '/?', l_linenumber) end as index_url")
    return sections.fill_index_url(rows)
