"""Cleaning of text lines and of node trees (C10, C11, F14, F15, F27, J2, P20-P22, W5, W6, J-8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators.select import select_nodes, subtree_texts
from leafmill.tables import materialize

# What is removed from content, and labels of reader controls.
REMOVED = ["script", "style", "iframe", "noscript", ".ad", ".ads", ".advertisement", '[class*="ad-"]', '[id*="ad-"]', ".sponsor", ".recommend", ".related", ".comment", ".share", '[class*="share"]', '[id*="share"]', ".div_feedback", '[class*="feedback"]', '[id*="feedback"]', ".anchor_bookmark", '[class*="bookmark"]', '[id*="bookmark"]', ".social_share_frame", ".social_share_inner_frame", ".page-separator", ".page_separator_first", ".page_separator_last", ".prev_page", ".next_page", ".more_recommend", '[class*="recommend"]', '[id*="recommend"]', ".txtcenter", ".mobadsq", "amp-social-share", "ins.adsbygoogle"]
UI_LABELS = [
    "投票推荐", "投票推薦", "加入书签", "加入書籤", "添加书签", "添加書籤", "小说报错", "小說報錯", "章节报错", "章節報錯", "关灯", "關燈", "字体-", "字体+", "字體-", "字體+", "上一章", "下一章", "上一页",
    "下一页", "上一頁", "下一頁", "目录", "目錄", "章节目录", "章節目錄", "章节列表", "章節列表", "返回书目", "返回書目", "返回目录", "返回目錄", "加入收藏", "加入收藏夹",
]
UI_LABEL_PATTERNS = [
    r"^[『「【]?(?:加入|添加)[书書][签籤][，,]方便[阅閱][读讀][』」】]?$",
    r"^字体[+-]$",
    r"^字體[+-]$",
    r"^(?:上一|下一)(?:章|页|頁)$",
    r"^(?:章?节|章節)?(?:目录|目錄|列表)$",
]
UI_BLOCKS = ["div", "p", "span", "li", "section", "nav", "header", "footer"]
LAZY = ["data-original", "data-src", "data-lazy-src", "data-lazy", "data-url", "data-echo", "data-srcset", "srcset"]
PLACEHOLDER = r"(?i)(^|/)(loading|blank|placeholder|lazy|spacer|grey)[^/]*\.(gif|png|jpe?g|svg)|^data:image/gif"
# Elements that end a line of text, those of them whose loose text becomes paragraphs,
# and how a source indents a paragraph.
LINE_BLOCKS = [
    "address", "article", "aside", "blockquote", "caption", "colgroup", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]
PARAGRAPH_CONTAINERS = ["article", "aside", "blockquote", "div", "figcaption", "main", "section"]
SOURCE_INDENT = r"^[\t\r\n ]*[\u00a0\u2000-\u200b\u202f\u205f\u3000]{2,}"
#: The share of a paragraph's later lines that must be indented for its line breaks to part paragraphs.
INDENTED = 0.8


def remove_subtrees(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes outside all roots (page_id, pos, end_pos).

    A root reaches to its end_pos, and subtrees nest, so what stands behind the farthest end so far
    is outside: a running maximum over document order. No join on ranges, and the end's own node
    may have been removed before."""
    ends = roots.groupBy("page_id", "pos").agg(F.max("end_pos").alias("root_end"))
    farthest = F.max("root_end").over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    rows = nodes.join(ends, ["page_id", "pos"], "left").withColumn("root_end", farthest)
    return rows.where("root_end is null or pos > root_end").drop("root_end")


def remove_elements(nodes: DataFrame, selectors: list[str] = REMOVED) -> DataFrame:
    """P20: without what any alternative of the selectors picks."""
    return remove_subtrees(nodes, select_nodes(nodes, selectors, every=True).select("page_id", "pos", "end_pos").distinct())


def remove_ui_noise(nodes: DataFrame) -> DataFrame:
    """Without controls that bear a reader's label, and then without small blocks that are
    keyboard tips, navigation or tool bars. White space does not count; texts are those of whole
    subtrees, whatever their number of nodes.

    Labelled controls, and the text beside them, are read several times and so written to the shared
    folder."""
    solid = nodes.select("page_id", "pos", "end_pos", "kind", "tag", F.regexp_replace("text", rf"{T.WHITE}+", "").alias("text"))
    t = F.col("subtree_text")
    controls = solid.where(F.col("tag").isin("a", "button", "label")).select("page_id", "pos", "end_pos")
    labels = subtree_texts(solid, controls, 12).where(t.isin(UI_LABELS) | F.rlike(t, F.lit("|".join(UI_LABEL_PATTERNS))))
    labelled = materialize(labels.join(controls, ["page_id", "pos"]).select("page_id", "pos", "end_pos"), "labelled")
    kept = materialize(remove_subtrees(solid, labelled), "kept")
    blocks = kept.where(F.col("tag").isin(UI_BLOCKS)).select("page_id", "pos", "end_pos")
    has = lambda *words: F.rlike(t, F.lit("|".join(words)))
    tips = has("温馨提示", "溫馨提示") & F.rlike(t, F.lit("(?i)enter|回车|回車|←|→|按"))
    bar = has("上一章", "上一頁", "上一页") & has("下一章", "下一頁", "下一页") & has("目录", "目錄") & (F.length(t) <= 120)
    marks = has("书签", "書籤")
    tools = ((has("投票推荐", "投票推薦") | has("报错", "報錯")) & marks) | (has("关灯", "關燈") & has("字体", "字體"))
    noise = subtree_texts(kept, blocks, 240).where((t != "") & (tips | bar | (tools & (F.length(t) <= 160))))
    roots = noise.join(blocks, ["page_id", "pos"]).select("page_id", "pos", "end_pos").unionByName(labelled)
    return remove_subtrees(nodes, roots)


def strip_inline_style(nodes: DataFrame) -> DataFrame:
    """P22"""
    return nodes.withColumn("attrs", F.map_filter("attrs", lambda k, v: ~k.isin("style", "bgcolor")))


def fix_images(nodes: DataFrame) -> DataFrame:
    """a placeholder source gives way to the first safe lazy attribute."""
    src = F.col("attrs")["src"]
    lazy = F.coalesce(*(U.safe_url(F.regexp_extract(F.col("attrs")[a], r"^\s*([^\s,]+)", 1), data_images=True) for a in LAZY))
    better = F.when((F.col("tag") == "img") & (src.isNull() | (src == "") | F.rlike(src, F.lit(PLACEHOLDER))), lazy)
    return nodes.withColumn("attrs", F.when(better.isNotNull(), F.map_concat(F.map_filter("attrs", lambda k, v: k != "src"), F.create_map(F.lit("src"), better))).otherwise(F.col("attrs")))


def block_homes(nodes: DataFrame) -> DataFrame:
    """Nodes that are text, line breaks, or other elements in a line, with home_pos and home_tag (the
    innermost LINE_BLOCKS element around them; null at the top) and run (a number that grows with
    each block that begins or ends before them).

    The block depth is a running sum; a node's home is the last block of its depth that began before
    it. Two windows, no join on ranges."""
    block = (F.col("kind") == "element") & F.col("tag").isin(LINE_BLOCKS)
    begins = nodes.select("*", F.col("pos").alias("at"), F.when(block, 0).otherwise(1).alias("what"))
    ends = nodes.where(block).withColumns({"at": F.col("end_pos"), "what": F.lit(2)})
    page = Window.partitionBy("page_id").orderBy("at", "what", F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    rows = begins.unionByName(ends).withColumn("level", F.sum(F.when(F.col("what") == 0, 1).when(F.col("what") == 2, -1).otherwise(0)).over(page))
    rows = rows.withColumn("run", F.sum((F.col("what") != 1).cast("int")).over(page)).where("what < 2")
    level = Window.partitionBy("page_id", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    home = F.last(F.when(F.col("what") == 0, F.struct("pos", "tag")), ignorenulls=True).over(level)
    rows = rows.withColumn("home", F.when(F.col("level") > 0, home)).where("what = 1")
    return rows.select(*nodes.columns, "run", F.col("home.pos").alias("home_pos"), F.col("home.tag").alias("home_tag"))


def br_to_paragraphs(nodes: DataFrame) -> DataFrame:
    """(page_id, par, tag, text): the blocks of text of a page in document order.

    Loose text in containers, or in none, becomes paragraphs, which line breaks part. A paragraph's
    own breaks part it only if INDENTED of its later lines begin with the source's indentation; else,
    as in poetry and addresses, its lines stay together, one a line of ``text``. Headings, list
    items, table cells and the like are kept as they are under their own tag. Breaks within further
    elements of a line do not part anything. White space is collapsed; blocks without text go."""
    rows = block_homes(nodes)
    top = F.col("home_pos").isNull() & F.col("tag").isin("br")
    straight = (F.col("tag") == "br") & (F.col("parent_pos") == F.col("home_pos"))
    page = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("break", F.coalesce(straight, F.lit(False)) | top).withColumn("line", F.sum(F.col("break").cast("int")).over(page)).where("not break")
    raw = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "text", F.struct("pos", "text")).when(F.col("tag") == "br", F.struct("pos", F.lit(" ").alias("text"))))), lambda x: x["text"]), "")
    lines = rows.groupBy("page_id", "run", "line", "home_pos", "home_tag").agg(F.min("pos").alias("first"), raw.alias("raw"), F.max((F.col("kind") == "element").cast("int")).alias("holds"))
    lines = lines.withColumn("visible", ~T.blank(F.col("raw")) | (F.col("holds") == 1)).where("visible")
    own = Window.partitionBy("page_id", "home_pos", "run")
    later = F.row_number().over(own.orderBy("first")) > 1
    lines = lines.withColumn("later", later).withColumn("share", F.count_if(F.col("later") & F.rlike("raw", F.lit(SOURCE_INDENT))).over(own) >= F.ceil(INDENTED * F.count_if("later").over(own)))
    free = F.col("home_tag").isNull() | F.col("home_tag").isin(PARAGRAPH_CONTAINERS)
    parted = free | ((F.col("home_tag") == "p") & F.col("share"))
    lines = lines.withColumns({"text": T.collapse(F.col("raw")), "tag": F.when(free, "p").otherwise(F.col("home_tag")), "part": F.when(parted, F.col("line"))}).where(~T.blank(F.col("raw")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), "\n")
    out = lines.groupBy("page_id", "run", "home_pos", "tag", "part").agg(F.min("first").alias("par"), whole.alias("text"))
    return out.select("page_id", "par", "tag", "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line) of texts."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def trim_leading(lines: DataFrame, titles: DataFrame, most: int = 3) -> DataFrame:
    """From the top, blank lines go, and up to three lines that look like the title, until the
    first other line. titles: doc_id, title.

    The first ``most`` + 1 lines with text hold that line, so only they are compared with the title,
    after the lines are spread by document."""
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("blank", T.blank(F.col("line"))).withColumn("solid", F.sum((~F.col("blank")).cast("int")).over(so_far))
    near = ~F.col("blank") & (F.col("solid") <= most + 1)
    rows = rows.join(titles, "doc_id", "left").withColumn("like", F.when(near, T.looks_like_title_line(F.col("line"), F.coalesce("title", F.lit("")))).otherwise(False))
    rows = rows.withColumn("liked", F.sum(F.col("like").cast("int")).over(so_far))
    stop = F.min(F.when(~F.col("blank") & (~F.col("like") | (F.col("liked") > most)), F.col("pos"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("stop", stop).where("pos >= stop").select(*lines.columns)


def trim_trailing(lines: DataFrame, most: int = 3, marks: str = r"^\s*>\s*$|^\s*[(（]?(本章完|未完待续)[)）]?\s*$") -> DataFrame:
    """W6, J-8: from the end, up to three blank or mark lines go."""
    rows = lines.withColumn("noise", T.blank(F.col("line")) | F.rlike("line", F.lit(marks)))
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos"))
    rows = rows.withColumn("k", F.row_number().over(back))
    stop = F.min(F.when(~F.col("noise") | (F.col("k") > most), F.col("k"))).over(Window.partitionBy("doc_id"))
    return rows.withColumn("stop", stop).where("k >= stop").select(*lines.columns)


def clean_content(nodes: DataFrame, titles: DataFrame | None = None, replacements: list[tuple[str, str, str]] = (), selectors: list[str] = REMOVED) -> DataFrame:
    """(page_id, content): elements and controls removed, text repaired, advertisements and
    replacement rules applied, blocks built (F14), title lines trimmed from the top. content is HTML
    of flat blocks, each under its own tag. Pages are taken apart once, into a table in the shared folder."""
    pars = content_blocks(remove_elements(materialize(nodes, "nodes"), selectors))
    return blocks_to_html(materialize(pars.withColumn("text", clean_text(F.col("text"), replacements)), "cleaned"), titles)


def content_blocks(nodes: DataFrame) -> DataFrame:
    """The blocks (page_id, par, tag, text) of nodes whose unwanted elements are gone already; these
    are read several times and so written to the shared folder."""
    nodes = materialize(nodes, "content")
    return br_to_paragraphs(fix_images(strip_inline_style(remove_ui_noise(nodes))))


def clean_text(text: Column, replacements: list[tuple[str, str, str]] = ()) -> Column:
    """Glyphs repaired, advertisements removed, again after replacement rules."""
    text = T.remove_ads(T.repair_glyphs(text))
    return T.remove_ads(T.apply_replacements(text, list(replacements))) if replacements else text


def blocks_to_html(pars: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """(page_id, content) of blocks; lines that repeat the title go from the top, marks from the end."""
    tidy = F.array_join(F.filter(F.transform(F.split("text", "\n"), T.collapse), lambda x: x != ""), "\n")
    lines = pars.where(~T.blank(F.col("text"))).select(F.col("page_id").alias("doc_id"), F.col("par").cast("int").alias("pos"), tidy.alias("line"), "tag")
    if titles is not None:
        lines = trim_leading(lines, titles.select(F.col("page_id").alias("doc_id"), "title"))
    lines = trim_trailing(lines)
    escaped = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("\n"), F.lit("<br>"))
    html = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag", "line"))), lambda x: F.concat(F.lit("<"), x["tag"], F.lit(">"), escaped(x["line"]), F.lit("</"), x["tag"], F.lit(">")))
    return lines.groupBy("doc_id").agg(F.array_join(html, "").alias("content")).select(F.col("doc_id").alias("page_id"), "content")


def selector_counts(nodes: DataFrame, winners: DataFrame, host: Column) -> DataFrame:
    """how often each id or class names the winning content node of a host's pages.

    winners: page_id, pos, url."""
    rows = winners.join(nodes.select("page_id", "pos", "tag", "id", "classes"), ["page_id", "pos"])
    name = F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).when(F.size("classes") > 0, F.concat(F.lit("."), F.array_join("classes", "."))).otherwise(F.col("tag"))
    return rows.groupBy(host.alias("host"), name.alias("selector")).agg(F.count(F.lit(1)).alias("n"))
