"""Tables of contents.

Entries are rows of toc_id, page_no, pos, title, url, access; the order of a catalog is
(page_no, pos). Dominance counts, directions and flags are aggregates and windows over toc_id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators.classify import CHAPTER_HREF
from leafmill.sources.pages import page_links

MOST_PAGES, MOST_PLANNED = 120, 10_000
_ORDER = ("page_no", "pos")


def collect_candidates(pages: DataFrame, toc_id, every_link: bool = False) -> DataFrame:
    """Links whose text or target looks like a chapter, one catalog per toc_id."""
    links = page_links(pages).join(pages.select("page_id", toc_id.alias("toc_id")), "page_id")
    like = T.is_likely_chapter_title(F.col("text")) | F.rlike("href", F.lit(CHAPTER_HREF))
    rows = links if every_link else links.where(like)
    title = F.when(F.col("text") == "", F.concat(F.lit("章节 "), (F.col("pos") + 1).cast("string"))).otherwise(F.col("text"))
    return rows.select("toc_id", F.col("page_id").alias("page_no"), "pos", title.alias("title"), F.col("abs_url").alias("url"), F.lit(None).cast("string").alias("access"))


def exclude_ancestors(links: DataFrame, excluded: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """Links (page_id, pos) outside all excluded nodes (page_id, pos, end_pos), and inside a
    kept one if such are given."""
    span = lambda d: d.select(F.col("page_id").alias("p"), F.col("pos").alias("a"), F.col("end_pos").alias("b"))
    inside = (F.col("page_id") == F.col("p")) & F.col("pos").between(F.col("a"), F.col("b"))
    out = links.join(span(excluded), inside, "left_anti")
    return out if kept is None else out.join(span(kept), inside, "left_semi")


def union_pages(*pages: DataFrame) -> DataFrame:
    """The candidates of all catalog pages."""
    return reduce(DataFrame.unionByName, pages)


def dedupe(entries: DataFrame) -> DataFrame:
    """One row per URL at its last position; its title is the better one, tried from last to first."""
    each = F.array_sort(F.collect_list(F.struct("page_no", "pos", "title", "access")))
    grouped = entries.groupBy("toc_id", "url").agg(each.alias("all"))
    last = F.element_at("all", -1)
    title = F.aggregate(F.reverse("all"), last["title"], lambda best, x: F.when(T.better_title(best, x["title"]), x["title"]).otherwise(best))
    return grouped.select("toc_id", last["page_no"].alias("page_no"), last["pos"].alias("pos"), title.alias("title"), "url", last["access"].alias("access"))


def dominant_book(entries: DataFrame) -> DataFrame:
    """A4: without entries of other books, where one book has five entries or more."""
    rows = entries.withColumn("book", U.book_id_from_url(F.col("url")))
    counts = rows.where("book is not null").groupBy("toc_id", "book").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_ORDER)).alias("first"))
    top = F.row_number().over(Window.partitionBy("toc_id").orderBy(F.desc("n"), "first"))
    main = counts.withColumn("k", top).where("k = 1 and n >= 5").select("toc_id", F.col("book").alias("main"))
    return rows.join(main, "toc_id", "left").where("main is null or book is null or book = main").drop("book", "main")


def dominant_patterns(entries: DataFrame) -> DataFrame:
    """A5: (toc_id, pattern): by count, those of five or of three tenths, until nine tenths are
    covered; the most frequent if there is none."""
    counts = entries.groupBy("toc_id", U.url_pattern(F.col("url")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*_ORDER)).alias("first"))
    every = Window.partitionBy("toc_id")
    ranked = counts.withColumns({"total": F.sum("n").over(every), "k": F.row_number().over(every.orderBy(F.desc("n"), "first"))})
    ranked = ranked.withColumn("fit", (F.col("n") >= 5) | (F.col("n") / F.col("total") > 0.3))
    before = F.sum(F.when(F.col("fit"), F.col("n")).otherwise(0)).over(every.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumns({"before": F.coalesce(before, F.lit(0)), "any": F.max("fit").over(every)})
    return ranked.where("(fit and before <= 0.9 * total) or (not any and k = 1)").select("toc_id", "pattern")


def filter_entries(entries: DataFrame) -> DataFrame:
    """O2: small catalogs as they are; others by pattern and title, or leniently when that would
    leave too little."""
    size = F.count(F.lit(1)).over(Window.partitionBy("toc_id"))
    sized = entries.withColumn("size", size)
    large = dominant_book(sized.where("size >= 5"))
    main = dominant_patterns(large).withColumn("main", F.lit(2))
    rows = large.withColumn("pattern", U.url_pattern(F.col("url"))).join(main, ["toc_id", "pattern"], "left")
    likely, other = T.is_likely_chapter_title(F.col("title")), T.is_non_chapter_title(F.col("title"))
    score = F.coalesce("main", F.lit(0)) + F.when(likely, 1).otherwise(0) - F.when(~likely & other, 2).otherwise(0)
    rows = rows.withColumns({"strict": score >= 1, "lenient": ~other})
    w = Window.partitionBy("toc_id")
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(w), "n_strict": F.count_if("strict").over(w), "n_lenient": F.count_if("lenient").over(w)})
    use_lenient = ((F.col("n_strict") < 0.3 * F.col("n")) | (F.col("n_strict") < 10)) & (F.col("n_lenient") >= F.col("n_strict"))
    kept = rows.where((use_lenient & F.col("lenient")) | (~use_lenient & F.col("strict")))
    return sized.where("size < 5").select(entries.columns).unionByName(kept.select(entries.columns))


def sort_entries(entries: DataFrame) -> DataFrame:
    """Adds ord: by number if all are numbered differently; reversed if most neighbouring
    numbers descend; else as they came."""
    every = Window.partitionBy("toc_id")
    rows = entries.withColumn("num", T.title_chapter_number(F.col("title")))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(every), "n_num": F.count("num").over(every), "n_diff": F.size(F.collect_set("num").over(every))})
    numbered = rows.where("num is not null").withColumn("before", F.lag("num").over(every.orderBy(*_ORDER)))
    pairs = numbered.groupBy("toc_id").agg(F.count_if(F.col("num") < F.col("before")).alias("down"), F.count_if(F.col("num") > F.col("before")).alias("up"))
    rows = rows.join(pairs, "toc_id", "left").na.fill(0, ["down", "up"])
    by_number = (F.col("n_num") == F.col("n")) & (F.col("n_diff") == F.col("n"))
    reverse = ~by_number & (F.col("n") >= 5) & (F.col("n_num") >= 3) & (F.col("n_num") >= 0.3 * F.col("n")) & (F.col("down") > 0.6 * (F.col("down") + F.col("up")))
    place = F.row_number().over(every.orderBy(*_ORDER))
    rows = rows.withColumn("place", F.when(reverse, -place).otherwise(place))
    key = F.when(by_number, F.col("num")).otherwise(F.col("place"))
    return rows.withColumn("ord", F.row_number().over(every.orderBy(key, *_ORDER))).select("toc_id", "ord", "title", "url", "access")


def build_toc(pages: DataFrame, toc_id, every_link: bool = False) -> DataFrame:
    """Candidates of all pages of each catalog, deduplicated, filtered and ordered."""
    return sort_entries(filter_entries(dedupe(collect_candidates(pages, toc_id, every_link))))


def search(toc: DataFrame, needle: str) -> DataFrame:
    """P19"""
    n = needle.strip().lower()
    return toc.where(F.contains(F.lower("title"), F.lit(n))) if n else toc


def toc_status(toc: DataFrame, cached: DataFrame, persisted: DataFrame, current: DataFrame) -> DataFrame:
    """Adds is_cached, is_persisted, is_current; each table has a url column."""
    for name, other in (("is_cached", cached), ("is_persisted", persisted), ("is_current", current)):
        urls = other.select(U.compare_url(F.col("url")).alias("key")).distinct().withColumn(name, F.lit(True))
        toc = toc.withColumn("key", U.compare_url(F.col("url"))).join(urls, "key", "left").drop("key").na.fill(False, [name])
    return toc


def cache_plan(toc: DataFrame, cached: DataFrame, persisted: DataFrame, index: DataFrame) -> DataFrame:
    """What is left to load of a catalog's first entries, in order: not locked, not the index,
    each URL once, neither cached nor persisted. index: toc_id, url."""
    key = F.col("key")
    rows = toc.where(F.col("ord") <= MOST_PLANNED).where("access is null or access <> 'locked'").withColumn("key", U.compare_url(F.col("url")))
    rows = rows.groupBy("toc_id", "key").agg(F.min("ord").alias("ord"))
    for other, on in ((index, ["toc_id", "key"]), (cached, ["key"]), (persisted, ["key"])):
        rows = rows.join(other.withColumn("key", U.compare_url(F.col("url"))).select(on).distinct(), on, "left_anti")
    return rows.select("toc_id", "ord", key.alias("url"))


def new_pages(candidates: DataFrame) -> DataFrame:
    """Per catalog page: entries, URLs first seen there, and whether paging stops."""
    first = candidates.withColumn("first", F.min("page_no").over(Window.partitionBy("toc_id", "url")))
    per = first.groupBy("toc_id", "page_no").agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("first") == F.col("page_no")).alias("fresh"))
    k = F.row_number().over(Window.partitionBy("toc_id").orderBy("page_no"))
    return per.withColumn("k", k).select("toc_id", "page_no", "entries", "fresh", ((F.col("k") > 1) & (F.col("fresh") == 0)).alias("stops"))


def load_report(candidates: DataFrame) -> DataFrame:
    """Per catalog: pages, entries, outcome; reaching the page limit is an error."""
    per = new_pages(candidates)
    stop = F.min(F.when(F.col("stops"), F.col("page_no")))
    out = per.groupBy("toc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("fresh").alias("entries"), stop.alias("stop_page"))
    outcome = F.when(F.col("pages") > MOST_PAGES, "too_many_pages").when(F.col("stop_page").isNotNull(), "no_new_entries").otherwise("complete")
    return out.select("toc_id", "pages", "entries", outcome.alias("outcome"))


def next_toc_page(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, url): the best pager link of each catalog page."""
    rows = links.join(pages.select("page_id", F.col("url").alias("index")), "page_id")
    t = F.lower("norm_text")
    pager = F.rlike(t, F.lit("下一?[页頁]")) | ((t == "next") | (F.contains(t, F.lit("next")) & F.contains(t, F.lit("page")) & ~F.contains(t, F.lit("chapter"))))
    by_rel = F.rlike("rel", F.lit(r"(^|\s)next(\s|$)"))
    score = F.when(by_rel, 90).when(pager, 50 + F.when(F.rlike("cls", F.lit("(?i)next|page")), 3).otherwise(0)).otherwise(0)
    rows = rows.withColumn("score", score).where("score > 0").where(U.toc_pagination_link(F.col("abs_url"), F.col("index")) & (U.compare_url(F.col("abs_url")) != U.compare_url(F.col("index"))))
    best = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return rows.withColumn("k", best).where("k = 1").select("page_id", F.col("abs_url").alias("url"), "score")
