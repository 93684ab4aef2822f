"""Chapters in several pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U

MOST_SECTIONS = 10


def contiguous(sections: DataFrame, cap: int = MOST_SECTIONS, ties: tuple[str, ...] = ()) -> DataFrame:
    """The pages of each chapter that follow each other from the first.

    sections: key, section, marker_page, marker_total (both may be null). A repeated or missing page,
    a mark that names another page or total, and the cap end the chapter. Of repeated pages the first by the ties counts. Adds ord and known_total."""
    w = Window.partitionBy("key").orderBy("section", *ties)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sections.where(F.col("section") <= cap).withColumn("ord", F.row_number().over(w))
    rows = rows.withColumn("known_total", F.first("marker_total", ignorenulls=True).over(so_far))
    odd = (F.col("section") != F.col("ord")) | F.coalesce(F.col("marker_page") != F.col("ord"), F.lit(False)) | F.coalesce(F.col("marker_total") != F.col("known_total"), F.lit(False))
    bad = F.min(F.when(odd, F.col("ord"))).over(Window.partitionBy("key"))
    return rows.withColumn("bad", bad).where("bad is null or ord < bad").drop("bad")


def merge_sections(accepted: DataFrame, separator: str = "<p></p>") -> DataFrame:
    """Per key the contents in order, blanks skipped; the first page's title, the last
    page's next link, and the script (mixed where pages differ). A chapter has at most as many
    pages as the cap, so its group is small."""
    one = F.struct("ord", F.trim("content").alias("content"))
    kept = F.filter(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["content"]), lambda c: c != "")
    known = F.collect_set(F.when(F.col("script") != "unknown", F.col("script")))
    rows = accepted.groupBy("key").agg(F.array_join(kept, separator).alias("content"), F.min_by("title", "ord").alias("title"), F.max_by("next_url", "ord").alias("next_url"), known.alias("scripts"))
    script = F.when(F.size("scripts") == 0, "unknown").when(F.size("scripts") == 1, F.get("scripts", F.lit(0))).otherwise("mixed")
    return rows.select("key", "content", "title", "next_url", script.alias("script"))


def completeness(sections: DataFrame, accepted: DataFrame) -> DataFrame:
    """Per key: loaded, total, truncated (pages left over, or fewer than the total)."""
    have = accepted.groupBy("key").agg(F.count(F.lit(1)).alias("loaded"), F.max("known_total").alias("total"))
    every = sections.groupBy("key").agg(F.count(F.lit(1)).alias("pages"))
    rows = every.join(have, "key", "left").na.fill(0, ["loaded"])
    return rows.select("key", "loaded", "total", ((F.col("loaded") < F.col("pages")) | F.coalesce(F.col("loaded") < F.col("total"), F.lit(False))).alias("truncated"))


def section_chain(edges: DataFrame, starts: DataFrame, cap: int = 99) -> DataFrame:
    """(start, url, ord) along next-section pointers, without running in circles.

    edges: src, dst (one dst per src); starts: url."""
    spark = edges.sparkSession
    return spark.sql(
        f"""with recursive chain(start, url, ord, seen) as (
              select url, url, 1, array(url) from {{starts}}
              union all
              select c.start, e.dst, c.ord + 1, concat(c.seen, array(e.dst)) from chain c join {{edges}} e on c.url = e.src
              where c.ord < {int(cap)} and not array_contains(c.seen, e.dst))
            select start, url, ord from chain""",
        starts=starts.select("url"),
        edges=edges.select("src", "dst"),
    )


def section_keys(pages: DataFrame) -> DataFrame:
    """Adds key (host and chapter path), section and the first page's URL."""
    part = U.chapter_section(U.path(F.col("url")))
    rows = pages.withColumn("part", part)
    return rows.select(*pages.columns, F.concat(U.hostname(F.col("url")), F.col("part.chapter_key")).alias("key"), F.col("part.section").alias("section"), F.coalesce(U.section_base_url(F.col("url")), F.col("url")).alias("start_url"))


def chapter_identity(start: Column, following: Column) -> Column:
    """The URL a chapter is known by; a sole x=1 query is dropped when the next page's is x=2."""
    base = F.coalesce(U.section_base_url(start), start)
    one = r"^([^?#]*)\?([^=&#]+)=1$"
    two = F.concat(F.regexp_extract(start, one, 1), F.lit("?"), F.regexp_extract(start, one, 2), F.lit("=2"))
    return U.canonical_url(F.when(F.rlike(start, F.lit(one)) & (following == two), F.regexp_extract(start, one, 1)).otherwise(base))


def next_chapter_links(links: DataFrame) -> DataFrame:
    """C14: the best forward link of each page that is no section link: page_id, url, score."""
    text = F.col("text")
    forward = T.link_direction(text) == "forward"
    score = F.when(F.rlike(text, F.lit("下一?[章节節回话話]")), 50).otherwise(0) + F.when(F.rlike(text, F.lit(r"(?i)next\s*chapter")), 45).otherwise(0) + F.when(forward, 10).otherwise(0) + F.when(F.rlike("rel", F.lit(r"(^|\s)next(\s|$)")), 2).otherwise(0)
    rows = links.withColumn("score", score).where((F.col("score") > 0) & (F.coalesce(T.link_text_kind(text), F.lit("")) != "section"))
    best = F.row_number().over(Window.partitionBy("page_id").orderBy(F.desc("score"), "pos"))
    return rows.withColumn("k", best).where("k = 1").select("page_id", F.col("abs_url").alias("url"), "score")


def section_decision() -> Column:
    """C18 over no_section, check_section, section_conf, next_is_section, next_chapter_url."""
    return (
        F.when(F.coalesce("no_section", F.lit(False)), "single")
        .when(F.coalesce("check_section", F.lit(False)) | (F.col("section_conf") >= 0.8), "merge")
        .when(F.col("next_is_section") & F.col("next_chapter_url").isNotNull(), "replace_next")
        .otherwise("single")
    )


def link_graph(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between known pages: src_id, rel, dst_id, by canonical URL. edges: src_url, rel, dst_url."""
    known = pages.select("page_id", U.canonical_url(F.col("url")).alias("key")).groupBy("key").agg(F.min("page_id").alias("page_id"))
    rows = edges.select(U.canonical_url(F.col("src_url")).alias("s"), "rel", U.canonical_url(F.col("dst_url")).alias("d"))
    src = known.select(F.col("key").alias("s"), F.col("page_id").alias("src_id"))
    dst = known.select(F.col("key").alias("d"), F.col("page_id").alias("dst_id"))
    return rows.join(src, "s").join(dst, "d").select("src_id", "rel", "dst_id")


def fill_index_url(chapters: DataFrame) -> DataFrame:
    """A missing index URL, or one that is the chapter itself, is taken from the book's first
    chapter that has one. chapters: book, ord, url, index_url."""
    own = F.when(U.block_key(F.col("index_url")) != U.block_key(F.col("url")), F.col("index_url"))
    rows = chapters.withColumn("own", own)
    known = rows.where("own is not null").groupBy("book").agg(F.min_by("own", "ord").alias("known"))
    return rows.join(known, "book", "left").select("book", "ord", "url", F.coalesce("own", "known").alias("index_url"))
