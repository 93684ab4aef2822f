"""Sections of pages, JSON titles, and the parse of pages by rule or detection (C3, C6, F24, J14, J-2, J-7)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators import classify, clean, detect, rules
from leafmill.operators.sections import next_chapter_links
from leafmill.operators.select import select_nodes, subtree_texts
from leafmill.sources.pages import html_nodes, page_links, page_scripts, without_code
from leafmill.tables import materialize

# Keys under which JSON holds a book's title, and the objects to look into first.
TITLE_KEYS = ["bookName", "book_name", "bookTitle", "book_title", "novelName", "novel_name", "articleName", "articlename"]
CONTAINERS = ["isPartOf", "book", "bookInfo", "novel", "data", "props", "pageProps"]
BOOK_TYPES = ["Book", "Novel", "BookSeries"]


def _object_type(depth: int, keys: list[str]) -> str:
    """The type of a JSON object with keys, ``@type``, ``name`` and, with a depth over 1, containers."""
    inner = f", {{}}: {_object_type(depth - 1, keys)}" if depth > 1 else ""
    below = "".join(inner.format(f"`{c}`") for c in CONTAINERS) if inner else ""
    return "struct<" + ", ".join(f"`{k}`: string" for k in (*keys, "@type", "name")) + below + ">"


def json_find_title(json: Column, depth: int = 3) -> Column:
    """a title by its keys, or the name of a typed book, at most ``depth`` objects down; what
    stands higher, and earlier in the lists, wins. A text is parsed once, whatever the number of keys;
    of a name that an object repeats the last counts, as in JSON.parse."""
    names = [f"k{i}" for i in range(len(TITLE_KEYS))]  # two keys differ by case alone
    parsed = F.when(F.rlike(json, F.lit(r"^\s*\{")), F.from_json(json, _object_type(depth, TITLE_KEYS))).cast(_object_type(depth, names))
    held = lambda o: F.array(*(o[n] for n in names), F.when(o["@type"].isin(BOOK_TYPES), o["name"]))

    def titles(root: Column) -> Column:
        objects, found = F.array(root), []
        for level in range(depth):
            found.append(F.flatten(F.transform(objects, held)))
            if level + 1 < depth:
                objects = F.filter(F.flatten(F.transform(objects, lambda o: F.array(*(o[c] for c in CONTAINERS)))), lambda o: o.isNotNull())
        return F.filter(F.concat(*found), lambda t: t.isNotNull() & (F.trim(t) != "") & ~F.rlike(t, F.lit(r"^\s*[\[{]")))

    return F.trim(F.get(F.get(F.transform(F.array(parsed), titles), F.lit(0)), F.lit(0)))


def script_links(scripts: DataFrame, pattern: str, rel: str, base: DataFrame) -> DataFrame:
    """J-7: links that a pattern finds in scripts, as page_id, rel, url. base: page_id, url."""
    rows = scripts.where(F.rlike("body", F.lit(pattern))).select("page_id", F.regexp_extract("body", pattern, 1).alias("href"))
    return rows.join(base, "page_id").select("page_id", F.lit(rel).alias("rel"), U.resolve_url(F.col("href"), F.col("url")).alias("url"))


def entry_redirect(pages: DataFrame, key: str = "chapterUrl") -> DataFrame:
    """page_id, url, target: the chapter that a landing page stands for, from JSON in its
    scripts; null where there is none."""
    first = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    found = F.get_json_object(F.regexp_extract("body", r"(?s)(\{.*\})", 1), f"$.{key}")
    rows = page_scripts(pages).withColumn("t", found).where("t is not null").withColumn("k", first).where("k = 1").select("page_id", "t")
    return pages.select("page_id", "url").join(rows, "page_id", "left").select("page_id", "url", U.resolve_url(F.col("t"), F.col("url")).alias("target"))


def detect_sections(pages: DataFrame) -> DataFrame:
    """page_id, is_section, section, next_section_url, next_chapter_url, confidence, method.

    In order: the page's own URL is a later page; a next-labelled link is the URL's next page; any
    link is; a next-page label alone; else no section."""
    links = page_links(pages).join(pages.select("page_id", F.col("url").alias("current")), "page_id")
    follows = U.is_next_section(F.col("current"), F.col("abs_url"))
    label = T.link_text_kind(F.col("text")) == "section"
    forward = T.link_direction(F.col("text")) == "forward"
    rank = F.when(follows & forward, 1).when(follows, 2).when(F.coalesce(label & forward, F.lit(False)), 3)
    best = F.row_number().over(Window.partitionBy("page_id").orderBy("rank", "pos"))
    chosen = links.withColumn("rank", rank).where("rank is not null").withColumn("k", best).where("k = 1").select("page_id", "rank", F.col("abs_url").alias("next_section_url"))
    chapters = next_chapter_links(page_links(pages)).select("page_id", F.col("url").alias("next_chapter_url"))
    own = U.chapter_section(U.path(F.col("url")))["section"]
    rows = pages.select("page_id", own.alias("section")).join(chosen, "page_id", "left").join(chapters, "page_id", "left")
    pick = lambda c, m: F.struct(F.lit(c).alias("confidence"), F.lit(m).alias("method"))
    verdict = F.when(F.col("rank") == 1, pick(0.9, "link-text")).when(F.col("section") > 1, pick(0.8, "url-pattern")).when(F.col("rank") == 2, pick(0.85, "url-comparison")).when(F.col("rank") == 3, pick(0.9, "link-text")).otherwise(pick(0.0, "none"))
    rows = rows.withColumn("v", verdict)
    return rows.select("page_id", (F.col("v.confidence") > 0).alias("is_section"), "section", "next_section_url", "next_chapter_url", "v.confidence", "v.method")


def parse_pages(pages: DataFrame, site_rules: list[dict], before: dict[str, Callable[[DataFrame], DataFrame]] | None = None, profile: detect.Profile = detect.ZH) -> DataFrame:
    """page_id, rule_id, method, title, content_text, confidence.

    A page with a rule is cut by the rule's content tag (rule, confidence 1); pages without one, or
    where the cut gives nothing, go by detection, with all of the text that it finds. Pages without content are dropped; a missing
    title is "Unknown Chapter". ``before`` maps rule ids to transforms of the rule's pages (J-2)."""
    matched = rules.match_rule(pages, site_rules)
    for rule_id, transform in (before or {}).items():
        own = transform(matched.where(F.col("rule_id") == rule_id))
        matched = matched.where(F.coalesce(F.col("rule_id") != rule_id, F.lit(True))).unionByName(own.select(matched.columns))
    tags = {r["id"]: r.get("content_tag", "article") for r in site_rules}
    parts = [detect.container_features(matched.where(F.col("rule_id") == i), t).where("text_len > 0").select("page_id", F.col("text").alias("content_text")) for i, t in tags.items()]
    ruled = reduce(DataFrame.unionByName, parts) if parts else None
    titles = detect.detect_title(pages).select("page_id", F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown Chapter")).alias("title"))
    found = detect.detect_content(pages, profile).select("page_id", F.col("text").alias("detected"), F.col("confidence").alias("found"))
    rows = matched.select("page_id", "rule_id").join(titles, "page_id").join(found, "page_id", "left")
    rows = rows.join(ruled, "page_id", "left") if ruled is not None else rows.withColumn("content_text", F.lit(None).cast("string"))
    by_rule = F.col("content_text").isNotNull()
    method = F.when(by_rule, "rule").when(F.col("rule_id").isNotNull(), "mixed").otherwise("detection")
    out = rows.select("page_id", "rule_id", method.alias("method"), "title", F.coalesce("content_text", "detected").alias("content_text"), F.when(by_rule, F.lit(1.0)).otherwise(F.col("found")).alias("confidence"))
    return out.where("content_text is not null")


PURPOSES = ("next", "prev", "index")


def parse_chapters(pages: DataFrame, site_rules: list[dict], before: dict[str, Callable[[DataFrame], DataFrame]] | None = None, profile: detect.Profile = detect.ZH) -> DataFrame:
    """C6 by selectors: page_id, url, rule_id, method, title, book_title, content, prev_url, next_url,
    index_url, confidence.

    A rule (J-1) may further hold: ``content``, ``title``, ``book`` and ``next``, ``prev``, ``index``
    (selector lists, of which the first alternative that hits counts; navigation may also be False:
    there is none, do not detect one), ``remove`` (selectors), ``replace`` (pattern, replacement,
    flags), ``title_pattern`` with ``title_index`` (1) and ``book_index`` on the document's title, and
    ``title_replace`` (a pattern that goes). Where a rule's content selector hits, the method is
    ``rule`` with confidence 1, and navigation that the rule does not name is detected. Else content
    is detected; with a rule, the method is ``mixed``, and what the rule finds overrides. Content is
    cleaned (C10). Pages without content are dropped.

    The pages are taken apart once, into a table in the shared folder."""
    matched = rules.match_rule(pages, site_rules)
    for rule_id, transform in (before or {}).items():
        own = transform(matched.where(F.col("rule_id") == rule_id))
        matched = matched.where(F.coalesce(F.col("rule_id") != rule_id, F.lit(True))).unionByName(own.select(matched.columns))
    of_page = matched.select("page_id", "rule_id")
    nodes = html_nodes(matched.select("page_id", without_code(F.col("html")).alias("html")))
    nodes = materialize(nodes.join(of_page, "page_id"), "nodes")
    fields = [(r["id"], f, r[f]) for r in site_rules for f in ("content", "title", "book", *PURPOSES) if r.get(f)]
    names = F.array(*(F.lit(f) for _, f, _ in fields)) if fields else F.array(F.lit(""))
    hits = select_nodes(nodes, [(rule, text) for rule, _, text in fields]).withColumn("field", F.get(names, F.col("sel")))
    first = F.row_number().over(Window.partitionBy("page_id", "field").orderBy("pos"))
    hits = hits.withColumn("k", first).where("k = 1").select("page_id", "field", "pos", "end_pos", "tag", "attrs")
    texts = subtree_texts(nodes, hits.where("field in ('title', 'book')").select("page_id", "pos", "end_pos"))
    named = hits.join(texts, ["page_id", "pos"], "left")
    value = lambda f, c: F.max(F.when(F.col("field") == f, c))
    href = F.when((F.col("tag") == "a") & (F.col("attrs")["href"] != ""), F.col("attrs")["href"])
    per = materialize(named.groupBy("page_id").agg(value("title", T.trim(F.col("subtree_text"))).alias("rule_title"), value("book", T.trim(F.col("subtree_text"))).alias("rule_book"), *(value(p, href).alias(f"rule_{p}") for p in PURPOSES), value("content", F.col("pos")).alias("rule_pos"), value("content", F.col("end_pos")).alias("rule_end")), "fields")
    found = detect.content_elements(nodes.drop("rule_id"), profile).select("page_id", F.col("pos").alias("found_pos"), F.col("end_pos").alias("found_end"), F.col("confidence").alias("found"))
    found = materialize(found, "found")
    titles = detect.detect_title(matched).select("page_id", F.col("title").alias("found_title"), F.col("confidence").alias("title_conf"))
    books = detect.book_title_vote(matched).select("page_id", F.col("book_title").alias("found_book"))
    nav = detect.detect_navigation(matched).groupBy("page_id").agg(*(F.max(F.when(F.col("purpose") == p, F.col(c))).alias(f"{n}_{p}") for p in PURPOSES for c, n in (("url", "found"), ("confidence", "sure"))))
    rows = matched.select("page_id", "url", "rule_id", classify.title_of(F.col("html")).alias("document"))
    for more in (per, found, titles, books, nav):
        rows = rows.join(more, "page_id", "left")
    by_rule = F.col("rule_pos").isNotNull()

    def of_rule(make, default: Column) -> Column:
        """The value that make(rule) gives for a page's rule; default where it gives None."""
        out = default
        for r in site_rules:
            c = make(r)
            out = out if c is None else F.when(F.col("rule_id") == r["id"], c).otherwise(out)
        return out

    none = F.lit(None).cast("string")
    group = lambda r, k: F.nullif(F.regexp_extract("document", r["title_pattern"], k), F.lit(""))
    pattern_title = of_rule(lambda r: group(r, r.get("title_index", 1)) if r.get("title_pattern") else None, none)
    pattern_book = of_rule(lambda r: F.when(F.coalesce("rule_title", F.lit("")) == "", group(r, r["book_index"])) if r.get("title_pattern") and r.get("book_index") else None, none)
    title = F.coalesce(F.nullif("rule_title", F.lit("")), pattern_title, F.nullif("found_title", F.lit("")))
    title = of_rule(lambda r: T.trim(F.regexp_replace(title, r["title_replace"], "")) if r.get("title_replace") else None, title)
    title = F.when(by_rule, F.coalesce(title, F.lit(""))).otherwise(F.coalesce(F.nullif("found_title", F.lit("")), F.lit("Unknown Chapter")))
    book = F.when(by_rule, F.coalesce(pattern_book, F.nullif("rule_book", F.lit("")), "found_book")).otherwise(F.col("found_book"))

    def link(p: str) -> Column:
        own = U.resolve_url(F.col(f"rule_{p}"), F.col("url"))
        defined = of_rule(lambda r: F.lit(True) if r.get(p) is not None else None, F.lit(False))
        return F.when(by_rule & defined, own).otherwise(F.coalesce(F.when(~by_rule, own), F.col(f"found_{p}")))

    overall = detect.overall_score(F.coalesce("found", F.lit(0.0)), detect.navigation_score(*(F.col(f"sure_{p}") for p in PURPOSES)), F.coalesce("title_conf", F.lit(0.0)))
    method = F.when(by_rule, "rule").when(F.col("rule_id").isNotNull(), "mixed").otherwise("detection")
    rows = rows.where(by_rule | F.col("found_pos").isNotNull())
    rows = materialize(rows.select("page_id", "url", "rule_id", method.alias("method"), title.alias("title"), book.alias("book_title"), *(link(p).alias(f"{p}_url") for p in PURPOSES), F.when(by_rule, F.lit(1.0)).otherwise(overall).alias("confidence"), F.coalesce("rule_pos", "found_pos").alias("a"), F.coalesce("rule_end", "found_end").alias("b")), "chapters")
    inside = nodes.join(rows.select("page_id", "a", "b"), "page_id").where("pos > a and pos <= b").drop("a", "b")
    unwanted = [(None, s) for s in clean.REMOVED] + [(r["id"], s) for r in site_rules for s in ([r["remove"]] if r.get("remove") else [])]
    roots = select_nodes(inside, unwanted, every=True).select("page_id", "pos", "end_pos").distinct()
    blocks = materialize(clean.content_blocks(clean.remove_subtrees(inside.drop("rule_id"), roots)).join(of_page, "page_id"), "blocks")
    replacing = {r["id"]: r["replace"] for r in site_rules if r.get("replace")}
    plain = blocks.where(~F.coalesce(F.col("rule_id").isin(*replacing), F.lit(False))) if replacing else blocks
    parts = [plain.withColumn("text", clean.clean_text(F.col("text")))]
    parts += [blocks.where(F.col("rule_id") == i).withColumn("text", clean.clean_text(F.col("text"), r)) for i, r in replacing.items()]
    content = clean.blocks_to_html(materialize(reduce(DataFrame.unionByName, parts), "cleaned"), rows.select("page_id", "title"))
    return rows.drop("a", "b").join(content, "page_id", "left").withColumn("content", F.coalesce("content", F.lit("")))
