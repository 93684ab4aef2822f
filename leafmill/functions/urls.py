"""URL functions (U1-U13, P1, P4, P9, P24, P26) as Column expressions.

A URL is taken apart with anchored regular expressions, so junk gives empty parts or null and
never an error. Paths keep their case unless a function says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of page-number parameters, and patterns of page families.
PAGE_KEYS = ["page", "p", "pg", "pageno", "page_no", "pagenum", "pageindex", "pn"]
TOC_PATH = r"(^|/)(catalog|toc|contents?|mulu|dir(ectory)?|chapterlist|chapters)(/|$)"
TOC_QUERY = r"[?&](catalog|toc|contents?|mulu|dir)="
CHAPTER_PATH = r"/(chapter|chapters|read|txt|article|novel/chapters)/[^?#]*[0-9]"
CHAPTER_END = r"/(chapter|chapters|read|txt|article|novel/chapters)/([^/?#]+/)*[0-9]+(\.html?)?/?$"
SKIPPED = ["login|register|auth|account", "search|find", "cart|checkout|pay", "user|profile|setting", "forum|comment|review", "download|upload"]
NOT_READING = r"login|register|signup|search|rank|category|tag|author|help|about|contact"
NOT_READING_FILES = r"(index|list|catalog|toc|contents?)\.html?$"
NOT_CHAPTER_PATHS = [
    r"(?i)/(book|novel|xiaoshuo|info)/?[0-9]*/?$",
    r"(?i)/(list|catalog|toc|contents?)\.?(html?)?$",
    r"(?i)/(index|list|last|lastpage|end)\.(html?|php|aspx)",
    r"(?i)/(user|login|register|search|rank|category|tag|author|help|about|contact|faq)(\.(html?|php|aspx)$|/|$)",
    r"(?i)/chapter/(get_par_tsu_list|ajax_get_session_code|get_book_chapter_detail_info)($|/)",
]
CHAPTER_NUMBERS = [r"(?i)/([0-9]+)\.html?$", r"(?i)/chapter/([0-9]+)", r"(?i)/([0-9]+)_[0-9]+\.html?$", r"(?i)_([0-9]+)\.html?$"]
BOOK_IDS = [r"/book/([0-9]+)", r"/chapter/([0-9]+)/", r"/([0-9]+)/[0-9]+(?:\.html?)?$", r"/([0-9]+)_[0-9]+(?:\.html?)?$", r"(?i)[?&](?:book_?id|bid|id)=([0-9]+)"]
RELAXED_SCHEMES = r"(?i)^(mailto|tel|blob|ftp):"
RASTER = r"(?i)^data:image/(apng|avif|bmp|gif|jpeg|jpg|png|webp)[^,]*;base64[^,]*,"
SENSITIVE_WORDS = "token|auth|session|sid|key|sign|signature|ticket|password|passwd|pwd|jwt|credential|access|refresh|challenge|chl"
SENSITIVE = rf"(?i)([?&](?:(?:[^=&#]*[_-])?(?:{SENSITIVE_WORDS})(?:[_-][^=&#]*)?|__cf_[^=&#]*|_csrftoken)=)[^&#]*"
REDACTED = "__redacted__"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _group(c: Column, pattern: str, n: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, n))


def is_http(url: Column) -> Column:
    return F.coalesce(F.rlike(url, F.lit(r"(?i)^https?://[^/?#\s]")), F.lit(False))


def scheme(url: Column) -> Column:
    return lower_ascii(_group(url, r"^([A-Za-z][A-Za-z0-9+.-]*):"))


def authority(url: Column) -> Column:
    return _group(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")


def origin(url: Column) -> Column:
    return lower_ascii(_group(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"))


def path(url: Column) -> Column:
    """The path, '/' where it is empty, null for what is no URL with a host."""
    found = _group(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")
    return F.when(found == "", "/").otherwise(found)


def query(url: Column) -> Column:
    """The query with its question mark, or ''."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def hostname(url: Column) -> Column:
    """Lower-cased host without port, user and trailing dot; null where there is none."""
    host = F.regexp_replace(lower_ascii(authority(url)), r"^[^@]*@|:[0-9]*$", "")
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host.rlike(r"^[^\s\\/?#@]+$"), host)


def plain_hostname(text: Column) -> Column:
    """U11 for a bare host name: null if it holds a user, port, path or space."""
    host = F.regexp_replace(lower_ascii(F.trim(text)), r"\.$", "")
    return F.when(host.rlike(r"^[^\s\\/?#@:]+$"), host)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def resolve_url(href: Column, base: Column) -> Column:
    """Href as an absolute URL; null where it or the base cannot be read."""
    href = F.trim(href)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path(base), r"^(.*/)", 1)
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    own = F.regexp_extract(href, r"^([^?#]*)", 1)
    joined = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(folder, own))
    parts = F.split(F.substr(joined, F.lit(2)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    ends_in_dots = F.rlike(joined, F.lit(r"/\.{1,2}$"))
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_in_dots & (F.size(kept) > 0), "/").otherwise(""))
    relative = (
        F.when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href == "", without_fragment(base))
        .when(F.startswith(href, F.lit("#")), F.concat(without_fragment(base), href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path(base), href))
        .otherwise(F.concat(root, clean, tail))
    )
    return F.when(F.rlike(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href).when(root != "", relative)


def canonical_url(url: Column) -> Column:
    """Without fragment, and without a sole first-page parameter on an .html path."""
    bare = without_fragment(url)
    sole = rf"(?i)^([^?#]*\.html?)\?({'|'.join(PAGE_KEYS)})=1$"
    return F.when(F.rlike(bare, F.lit(sole)), F.regexp_extract(bare, sole, 1)).otherwise(bare)


def compare_url(url: Column) -> Column:
    """For catalogs: without fragment."""
    return without_fragment(url)


def block_key(url: Column) -> Column:
    """Without fragment, a trailing slash and an index page."""
    return F.regexp_replace(F.regexp_replace(without_fragment(url), r"/$", ""), r"/index\.html?$", "")


def chapter_section(p: Column) -> Column:
    """U4: struct(chapter_key, section) of a path, or null; eight shapes, in order."""
    rooted = F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))
    split = lambda x: F.struct(x.alias("p"), F.filter(F.split(x, "/"), lambda y: y != "").alias("parts"))
    return let(let(rooted, split), lambda x: _section_of(x["p"], x["parts"]))


def _section_of(p: Column, parts: Column) -> Column:
    n = F.size(parts)
    last, before = F.get(parts, n - 1), F.get(parts, n - 2)
    big = lambda a: F.exists(a, lambda x: x.rlike("^[0-9]{3,}$"))
    n_big = lambda a: F.size(F.filter(a, lambda x: x.rlike("^[0-9]{3,}$")))
    head = lambda k: F.slice(parts, F.lit(1), F.greatest(n - k, F.lit(0)))
    number = lambda c: c.try_cast("int")

    def shape(pattern: str, with_page: bool) -> Column:
        page = F.regexp_extract(p, pattern, 2).try_cast("int") if with_page else F.lit(1)
        return F.when(F.rlike(p, F.lit(pattern)) & page.between(1, 99), F.struct(F.regexp_extract(p, pattern, 1).alias("chapter_key"), page.alias("section")))

    paged = F.struct(F.concat(F.lit("/"), F.array_join(head(1), "/")).alias("chapter_key"), number(last).alias("section"))
    whole = F.struct(F.concat(F.lit("/"), F.array_join(parts, "/")).alias("chapter_key"), F.lit(1).alias("section"))
    in_range = number(last).between(1, 99)
    two = last.rlike("^[0-9]{1,2}$")
    return F.coalesce(
        shape(r"(?i)^(.*/[0-9]+)[_-]([0-9]+)\.html?$", True),
        shape(r"^(.*/[0-9]{5,})_([0-9]{1,2})/?$", True),
        shape(r"(?i)^(.*/[0-9]+)/([0-9]+)\.html?$", True),
        shape(r"(?i)^(.*/[0-9]+)\.html?$", False),
        F.when((n >= 4) & two & before.rlike("^[0-9]{1,6}$") & big(head(2)) & in_range, paged),
        F.when((n >= 3) & two & before.rlike("^[0-9]{3,}$") & (n_big(head(1)) >= 2) & in_range, paged),
        F.when((n >= 3) & last.rlike("^[0-9]{1,6}$") & big(head(1)), whole),
        shape(r"^(.*/[0-9]{3,})/?$", False),
    )


def section_base_url(url: Column) -> Column:
    """The first page's URL of a later page of a chapter; null for what is no later page."""
    view = lambda p: F.struct(p.alias("p"), F.filter(F.split(p, "/"), lambda x: x != "").alias("parts"))
    return let(let(path(url), view), lambda x: _base_of(url, x["p"], x["parts"]))


def _base_of(url: Column, p: Column, parts: Column) -> Column:
    file = r"(?i)^(.*/[0-9]+)[_-][0-9]+(\.html?)$"
    q = F.regexp_extract(url, r"^[^?#]*(.*)$", 1)
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = r"^(.*/[0-9]{5,})_([0-9]{1,2})(/?)$"
    n = F.size(parts)
    last, before = F.get(parts, n - 1), F.get(parts, n - 2)
    slash = F.when(F.endswith(p, F.lit("/")), "/").otherwise("")
    front = F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), "/")
    n_big = F.size(F.filter(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x: x.rlike("^[0-9]{3,}$")))
    stable = F.exists(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: x.rlike("^[0-9]{3,}$"))
    numbered = rf"(?i)^([^?#]*\?(?:[^#]*&)?(?:{'|'.join(PAGE_KEYS)})=)0*([1-9][0-9]*)((?:&[^#]*)?(?:#.*)?)$"
    return (
        F.when(F.rlike(url, F.lit(file)), F.concat(F.regexp_extract(url, file, 1), F.regexp_extract(url, file, 2)))
        .when(F.rlike(p, F.lit(folder)) & (F.regexp_extract(p, folder, 2).try_cast("int") >= 1), F.concat(root, F.regexp_extract(p, folder, 1), F.regexp_extract(p, folder, 3), q))
        .when((n >= 3) & last.rlike("^[0-9]{1,2}$") & before.rlike("^[0-9]{3,}$") & (n_big >= 2), F.concat(root, F.lit("/"), front, F.lit("/1"), slash, q))
        .when((n >= 4) & last.rlike("^[0-9]{1,2}$") & before.rlike("^[0-9]{1,6}$") & stable & (last.try_cast("int") > 1), F.concat(root, F.lit("/"), front, slash, q))
        .when(F.rlike(url, F.lit(numbered)) & (F.regexp_extract(url, numbered, 2).try_cast("int") > 1), F.concat(F.regexp_extract(url, numbered, 1), F.lit("1"), F.regexp_extract(url, numbered, 3)))
    )


def _parameters(url: Column) -> Column:
    """The query as sorted 'name=value' strings, names lower-cased."""
    pairs = F.filter(F.split(F.substr(query(url), F.lit(2)), "&"), lambda x: x != "")
    return F.transform(pairs, lambda x: F.concat(lower_ascii(F.regexp_extract(x, "^([^=]*)", 1)), F.lit("="), F.regexp_extract(x, "^[^=]*=?(.*)$", 1)))


def is_next_section(current: Column, following: Column) -> Column:
    """Whether the second URL is the page after the first one of the same chapter."""
    seen = lambda c, f: F.struct(c.alias("c"), f.alias("f"), chapter_section(path(c)).alias("a"), chapter_section(path(f)).alias("b"), _parameters(c).alias("have"), _parameters(f).alias("want"))
    return let(let(resolve_url(following, current), lambda f: seen(current, f)), _follows)


def _follows(x: Column) -> Column:
    current, following, a, b, have, want = (x[k] for k in ("c", "f", "a", "b", "have", "want"))
    by_path = (a["chapter_key"] == b["chapter_key"]) & (b["section"] == a["section"] + 1) & (b["section"] > 1)
    page_of = rf"^({'|'.join(PAGE_KEYS)})="
    numbered = rf"^({'|'.join(PAGE_KEYS)})=([0-9]+)$"
    # keys are tried in their fixed order
    numbered_by = lambda k: lambda x: x.rlike(f"^{k}=0*[1-9][0-9]?$")
    found = F.coalesce(*(F.get(F.filter(want, numbered_by(k)), F.lit(0)) for k in PAGE_KEYS))

    def by_page(y: Column) -> Column:
        key = F.regexp_extract(y, page_of, 1)
        to = F.regexp_extract(y, numbered, 2).try_cast("int")
        own = lambda z: F.startswith(z, F.concat(key, F.lit("=")))
        at = F.coalesce(F.regexp_extract(F.get(F.filter(have, own), F.lit(0)), numbered, 2).try_cast("int"), F.lit(1))
        rest = lambda c: F.array_sort(F.filter(c, lambda z: ~own(z)))
        return y.isNotNull() & (rest(have) == rest(want)) & (to == at + 1) & (to > 1)

    by_query = (path(current) == path(following)) & let(found, by_page)
    same_host = lower_ascii(authority(current)) == lower_ascii(authority(following))
    return F.coalesce(same_host & (F.coalesce(by_path, F.lit(False)) | F.coalesce(by_query, F.lit(False))), F.lit(False))


def url_chapter_number(url: Column) -> Column:
    """The chapter number that a URL shows, by four patterns in order."""
    return F.coalesce(*(_group(url, p).try_cast("long") for p in CHAPTER_NUMBERS))


def url_pattern(url: Column) -> Column:
    """U8: the path, with {N} for each number."""
    return F.regexp_replace(F.coalesce(path(url), url), "[0-9]+", "{N}")


def book_id_from_url(url: Column) -> Column:
    """The book's id, by five patterns in order, the path before the query."""
    p, q = path(url), query(url)
    return F.coalesce(*(F.coalesce(_group(p, x), _group(q, x)) for x in BOOK_IDS))


def book_key(index_url: Column) -> Column:
    """Host and path with '_' for '/', then the query in URL-safe base64; for what is no URL,
    32 characters of its base64."""
    q = query(index_url)
    safe = F.translate(F.base64(q.cast("binary")), "+/=", "-_")
    key = F.concat(hostname(index_url), F.translate(path(index_url), "/", "_"), F.when(q.isin("", "?"), "").otherwise(F.concat(F.lit("~q~"), safe)))
    return F.coalesce(key, F.substring(F.base64(index_url.cast("binary")), 1, 32))


def safe_url(url: Column, relaxed: bool = False, data_images: bool = False) -> Column:
    """The trimmed URL if it may be kept: http(s), or relative; mail, phone, blob and ftp
    links if relaxed; base64 raster images if wished. Null otherwise."""
    u = F.trim(url)
    kept = F.when(F.rlike(u, F.lit(r"(?i)^(https?:)?//")), u)
    if data_images:
        kept = kept.when(F.rlike(u, F.lit(RASTER)), u)
    if relaxed:
        kept = kept.when(F.rlike(u, F.lit(RELAXED_SCHEMES)), u)
    return kept.when((u != "") & ~F.rlike(u, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), u)


def redact_url(url: Column) -> Column:
    """User names, passwords and sensitive query values replaced."""
    named = F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@", f"$1{REDACTED}@")
    return F.regexp_replace(named, SENSITIVE, f"$1{REDACTED}")


def page_kind_url(url: Column) -> Column:
    """Chapter, toc or other, by URL alone."""
    p, q = lower_ascii(path(url)), lower_ascii(query(url))
    kind = F.when(F.rlike(p, F.lit(CHAPTER_END)), "chapter").when(F.rlike(p, F.lit(TOC_PATH)) | F.rlike(q, F.lit(TOC_QUERY)), "toc").when(F.rlike(p, F.lit(CHAPTER_PATH)), "chapter")
    return F.when(is_http(url), F.coalesce(kind, F.lit("other"))).otherwise("other")


def skip_url(url: Column) -> Column:
    """Login, search, shop, user, forum and download families."""
    return F.coalesce(reduce(lambda a, b: a | b, (F.rlike(url, F.lit(f"(?i)/({x})")) for x in SKIPPED)), F.lit(False))


def is_invalid_chapter_url(url: Column, current: Column | None = None) -> Column:
    """URLs that cannot be chapters, seen from the current chapter if given."""
    p = path(url)
    parts = F.filter(F.split(p, "/"), lambda x: x != "")
    bad = (F.size(parts) == 0) | ((F.size(parts) == 1) & ~F.rlike(p, F.lit("[0-9]")))
    bad = reduce(lambda a, x: a | F.rlike(p, F.lit(x)), NOT_CHAPTER_PATHS, bad)
    if current is not None:
        depth = F.size(F.filter(F.split(path(current), "/"), lambda x: x != ""))
        bad = bad | F.coalesce((depth >= 3) & (F.size(parts) < depth - 1), F.lit(False)) | F.coalesce(lower_ascii(authority(url)) != lower_ascii(authority(current)), F.lit(False))
    return F.coalesce(bad, F.lit(False))


def public_http_url(url: Column, base: Column | None = None) -> Column:
    """The URL without fragment if it is http(s) on a public host, or on the base's host."""
    host = hostname(url)
    octets = F.transform(F.split(host, r"\."), lambda x: x.try_cast("int"))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    numeric = host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
    private = numeric & (a.isin(0, 10, 127) | F.exists(octets, lambda x: x > 255) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)))
    named = host.rlike(r"(^|\.)localhost$") | host.rlike(r"^\[(::1?\]|fe[89ab]|f[cd])")
    ok = ~(private | named)
    if base is not None:
        ok = ok | F.coalesce(host == hostname(base), F.lit(False))
    return F.when(is_http(url) & F.coalesce(ok, F.lit(False)), without_fragment(url))


def chapter_candidate_url(url: Column) -> Column:
    """Cheap test before any HTML work."""
    p = lower_ascii(path(url))
    out = F.rlike(p, F.lit(NOT_READING)) | F.rlike(p, F.lit(NOT_READING_FILES)) | F.rlike(p, F.lit("/(catalog|toc)/"))
    digit = F.rlike(p, F.lit("[0-9]"))
    like = (F.rlike(p, F.lit("/(chapter|txt|read|article)/")) & digit) | (F.rlike(p, F.lit("/(book|novel|xiaoshuo)/")) & digit & F.rlike(p, F.lit(r"\.html?$"))) | F.rlike(p, F.lit(r"[0-9]{3,}[^/]*\.html?$"))
    return F.coalesce(is_http(url) & ~out & like, F.lit(False))


def toc_pagination_link(link: Column, index: Column) -> Column:
    """http(s), of the index's origin, and with the index's number of three digits or more."""
    seed = F.regexp_extract(path(index), r"/([0-9]{3,})(?:/|$)", 1)
    same = is_http(link) & (origin(link) == origin(index))
    return F.coalesce(same & ((seed == "") | F.contains(path(link), seed)), F.lit(False))
