"""Pages and what is derived from them: links, metas, scripts and nodes."""

from __future__ import annotations

import re
from functools import reduce
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.tables import table

# Named entities that are decoded, tags without content, and tags that end others.
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
BOUNDS = {"table", "ul", "ol", "div", "article", "section", "body"}
#: Nodes, and characters of HTML, after which a batch goes back to Spark.
NODE_BATCH, NODE_BYTES = 4096, 4 << 20
NODES = "page_id long, pos int, end_pos int, depth int, parent_pos int, kind string, tag string, id string, classes array<string>, attrs map<string,string>, text string, src_off int, src_end int"


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with an http(s) URL, spread by page_id: a Parquet file of few row groups would be the
    work of as few tasks, and joins on page_id need no further shuffle."""
    return table(spark, sf_dir, "pages").where(U.is_http(F.col("url"))).repartition("page_id")


def decode_pages(pages: DataFrame, fallback: str = "utf-8") -> DataFrame:
    """(page_id, url, html) from binary content and content_type.

    The charset is taken from the content type, then from a meta tag in the first 4,096 bytes,
    then from fallback; the gbk family reads as gb18030 and what is unknown as utf-8. Needs
    spark.sql.legacy.javaCharsets for the gb18030 branch."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    named = F.coalesce(
        F.nullif(F.regexp_extract("content_type", r"(?i)charset\s*=\s*[\"']?([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([A-Za-z0-9_-]+)", 1), F.lit("")),
        F.lit(fallback),
    )
    name = F.lower(named)
    text = F.when(name.isin("gbk", "gb2312", "gb18030"), F.decode("content", "gb18030")).when(name.isin("iso-8859-1", "latin1", "windows-1252"), F.decode("content", "ISO-8859-1")).when(name.isin("utf-16", "utf-16le"), F.decode("content", "UTF-16LE")).otherwise(F.decode("content", "UTF-8"))
    return pages.select("page_id", "url", text.alias("html"))


def without_code(html: Column) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")


def decoded(text: Column) -> Column:
    """Text without tags and with entities decoded."""
    plain = F.regexp_replace(text, r"<[^>]*>", "")
    return reduce(lambda acc, e: F.replace(acc, F.lit(e[0]), F.lit(e[1])), ENTITIES, plain)


def attribute(tag: Column, name: str) -> Column:
    """The value of a quoted attribute in a start tag, or ''."""
    return F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def page_links(pages: DataFrame) -> DataFrame:
    """Links of all pages in document order: page_id, pos, href, abs_url, text, norm_text, title, rel, cls."""
    found = F.regexp_extract_all(without_code(F.col("html")), F.lit(r"(?is)(<a\b[^>]*>.*?)</a>"), F.lit(1))
    each = pages.select("page_id", "url", F.posexplode(found).alias("pos", "raw"))
    start = F.regexp_extract("raw", r"(?is)^(<a\b[^>]*>)", 1)
    each = each.select("page_id", "url", "pos", start.alias("start"), decoded(F.substr("raw", F.length(start) + 1)).alias("inner"))
    each = each.select("page_id", "url", "pos", attribute(F.col("start"), "href").alias("href"), T.trim(F.col("inner")).alias("text"), attribute(F.col("start"), "title").alias("title"), F.lower(attribute(F.col("start"), "rel")).alias("rel"), attribute(F.col("start"), "class").alias("cls"))
    each = each.where("href <> ''").withColumn("abs_url", U.resolve_url(F.col("href"), F.col("url"))).where(U.is_http(F.col("abs_url")))
    return each.select("page_id", "pos", "href", "abs_url", "text", F.regexp_replace("text", rf"{T.WHITE}+", "").alias("norm_text"), "title", "rel", "cls")


def page_metas(pages: DataFrame) -> DataFrame:
    """page_id, key (name or property, lower-cased), content; the first of a key wins."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<meta\b[^>]*>)"), F.lit(1))
    each = pages.select("page_id", F.posexplode(found).alias("pos", "tag"))
    key = F.lower(F.coalesce(F.nullif(attribute(F.col("tag"), "name"), F.lit("")), F.nullif(attribute(F.col("tag"), "property"), F.lit("")), F.when(attribute(F.col("tag"), "charset") != "", "charset")))
    content = F.coalesce(F.nullif(attribute(F.col("tag"), "content"), F.lit("")), attribute(F.col("tag"), "charset"))
    return each.select("page_id", "pos", key.alias("key"), content.alias("content")).where("key is not null").groupBy("page_id", "key").agg(F.min_by("content", "pos").alias("content"))


def page_scripts(pages: DataFrame) -> DataFrame:
    """page_id, pos, src, type, body of the scripts."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)(<script\b.*?)</script>"), F.lit(1))
    each = pages.select("page_id", F.posexplode(found).alias("pos", "raw")).withColumn("start", F.regexp_extract("raw", r"(?is)^(<script\b[^>]*>)", 1))
    return each.select("page_id", "pos", attribute(F.col("start"), "src").alias("src"), attribute(F.col("start"), "type").alias("type"), F.substr("raw", F.length("start") + 1).alias("body"))


_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?(?:\s*=\s*(?:([\"'])|([^\s>]*)))?")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in ("script", "style")}


class _Builder:
    """Nodes in document order; unclosed tags end where their parent or a sibling ends them.

    Takes any text, in time linear in it: every search either moves on or ends at the text's end, and
    the open elements that a tag may end are kept apart from those it cannot."""

    def __init__(self):
        self.html = ""
        self.rows: list[list] = []
        self.open: list[int] = []
        self.depth_of: dict[str, int] = {}  # open elements by tag
        self.edges: list[int] = []  # places in ``open`` of what ends by itself or bounds what does

    def run(self, html: str) -> list[list]:
        self.html, end = html, len(html)
        at = text = 0  # text: where the text begins that is not a node yet
        while at < end:
            at = html.find("<", at)
            if at < 0:
                break
            ahead = html[at + 1 : at + 3]
            if ahead[:1] == "!" or ahead[:1] == "?":
                self._text(text, at)
                stop = html.find("-->", at + 4) + 2 if html.startswith("<!--", at) and html[at + 4 : at + 5] != ">" else html.find(">", at)
                text = at = stop + 1 if stop > 1 else end
            elif ahead[:1] == "/" and ahead[1:].isalpha() and ahead[1:].isascii():
                self._text(text, at)
                stop = html.find(">", at)
                stop = stop + 1 if stop >= 0 else end
                self._end(_NAME.match(html, at + 2)[0].lower(), stop)
                text = at = stop
            elif ahead[:1].isalpha() and ahead[:1].isascii():
                self._text(text, at)
                text = at = self._start(at)
            else:
                at += 1
        self._text(text, end)
        self._end_until(0, end)
        return self.rows

    def _text(self, begin: int, end: int) -> None:
        if end > begin:
            self._add("text", "", {}, unescape(self.html[begin:end]), begin, end)

    def _add(self, kind: str, tag: str, attrs: dict, text: str, at: int, end: int) -> None:
        parent = self.open[-1] if self.open else None
        pos = len(self.rows)
        self.rows.append([pos, pos, len(self.open), parent, kind, tag, attrs.get("id", ""), attrs.get("class", "").split(), attrs, text, at, end])

    def _end_until(self, keep: int, at: int) -> None:
        while len(self.open) > keep:
            row = self.rows[self.open.pop()]
            row[1], row[11] = len(self.rows) - 1, at
            self.depth_of[row[5]] -= 1
            if self.edges and self.edges[-1] == len(self.open):
                self.edges.pop()

    def _end(self, tag: str, at: int) -> None:
        if self.depth_of.get(tag):
            k = len(self.open) - 1
            while self.rows[self.open[k]][5] != tag:
                k -= 1
            self._end_until(k, at)

    def _attributes(self, at: int) -> tuple[dict, int, bool]:
        """Attributes, the first of a name, from ``at`` on; where the tag ends; whether by itself."""
        html, out = self.html, {}
        while True:
            m = _ATTRIBUTE.match(html, at)
            name, quote, value = m.groups()
            stop = m.end()
            if quote:
                close = html.find(quote, stop)
                if close < 0:
                    return out, len(html), False
                value, stop = html[stop:close], close + 1
            if name:
                out.setdefault(name.lower(), unescape(value or ""))
            if stop >= len(html):
                return out, len(html), False
            if html[stop] == ">":
                return out, stop + 1, html[stop - 1] == "/" and not quote and not value
            at = stop if stop > at else at + 1

    def _start(self, at: int) -> int:
        name = _NAME.match(self.html, at + 1)
        tag = name[0].lower()
        attrs, stop, closed = self._attributes(name.end())
        for k in reversed(self.edges):
            own = self.rows[self.open[k]][5]
            if tag in ENDS.get(own, ()):
                self._end_until(k, at)
                break
            if own in BOUNDS:
                break
        self._add("element", tag, attrs, "", at, stop)
        if tag in VOID or closed:
            return stop
        self.open.append(len(self.rows) - 1)
        self.depth_of[tag] = self.depth_of.get(tag, 0) + 1
        if tag in ENDS or tag in BOUNDS:
            self.edges.append(len(self.open) - 1)
        if tag in _RAW:
            found = _RAW[tag].search(self.html, stop)
            close = found.start() if found else len(self.html)
            if close > stop:
                self._add("text", "", {}, self.html[stop:close], stop, close)
            return close
        return stop


def html_nodes(pages: DataFrame) -> DataFrame:
    """S3: all element and text nodes, numbered in document order, with the last descendant's number.

    The only step that takes a page apart in Python; everything after it works on rows. The nodes of
    small pages go back together, in batches of about NODE_BATCH."""

    def packed(ids: list, found: list) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True))
        attrs = pa.array([list(a.items()) for a in columns[8]], pa.map_(pa.string(), pa.string()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), None, pa.string(), pa.int32(), pa.int32())
        own = [attrs if k is None else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *own], names=["page_id", "pos", "end_pos", "depth", "parent_pos", "kind", "tag", "id", "classes", "attrs", "text", "src_off", "src_end"])

    def rows(batches):
        for batch in batches:
            ids, found, size = [], [], 0
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = _Builder().run(html or "")
                ids += [page_id] * len(own)
                found += own
                size += len(html or "")
                if found and (len(found) >= NODE_BATCH or size >= NODE_BYTES):
                    yield packed(ids, found)
                    ids, found, size = [], [], 0
            if found:
                yield packed(ids, found)

    return pages.select("page_id", "html").mapInArrow(rows, NODES)


def catalog_json(df: DataFrame) -> DataFrame:
    """(toc_id, payload) -> (toc_id, ord, title, url, access) of nested volumes and chapters.

    Anonymous readers (sS = 0) find a chapter locked; of equal URLs the last is kept."""
    schema = "struct<volumes: array<struct<name: string, chapters: array<struct<name: string, title: string, id: string, url: string, sS: int>>>>>"
    volumes = df.select("toc_id", F.posexplode(F.from_json("payload", schema)["volumes"]).alias("v", "volume"))
    each = volumes.select("toc_id", "v", F.posexplode("volume.chapters").alias("c", "x"))
    url = F.coalesce("x.url", F.concat(F.lit("/chapter/"), "x.id", F.lit("/")))
    rows = each.select("toc_id", "v", "c", F.coalesce("x.name", "x.title", F.concat(F.lit("Chapter "), (F.col("c") + 1).cast("string"))).alias("title"), url.alias("url"), F.when(F.col("x.sS") == 0, "locked").alias("access")).where("url is not null")
    last = F.row_number().over(Window.partitionBy("toc_id", "url").orderBy(F.desc("v"), F.desc("c")))
    kept = rows.withColumn("k", last).where("k = 1")
    return kept.select("toc_id", F.row_number().over(Window.partitionBy("toc_id").orderBy("v", "c")).alias("ord"), "title", "url", "access")


def catalog_flat(df: DataFrame) -> DataFrame:
    """Flat rows with ctype = 0 and a positive ordernum; of equal numbers the first is kept."""
    schema = "array<struct<ctype: int, ordernum: int, title: string, url: string>>"
    each = df.select("toc_id", F.posexplode(F.from_json("payload", schema)).alias("pos", "x")).where("x.ctype = 0 and x.ordernum > 0")
    first = F.row_number().over(Window.partitionBy("toc_id", "x.ordernum").orderBy("pos"))
    return each.withColumn("k", first).where("k = 1").select("toc_id", F.col("x.ordernum").alias("ord"), "x.title", "x.url")


def catalog_fragment(pages: DataFrame, host: str, path: str) -> DataFrame:
    """Links of an HTML fragment whose host and path fit; the first of a URL, titles numbered
    where they are missing."""
    links = page_links(pages).where(F.rlike(U.hostname(F.col("abs_url")), F.lit(host)) & F.rlike(U.path(F.col("abs_url")), F.lit(path)))
    first = F.row_number().over(Window.partitionBy("page_id", "abs_url").orderBy("pos"))
    kept = links.withColumn("k", first).where("k = 1")
    kept = kept.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("pos")))
    return kept.select("page_id", "ord", F.when(F.col("text") == "", F.concat(F.lit("章节 "), F.col("ord").cast("string"))).otherwise(F.col("text")).alias("title"), F.col("abs_url").alias("url"))
