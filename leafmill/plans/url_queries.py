"""Queries of the URL functions over all page URLs, and variants derived from each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import urls as U
from leafmill.tables import table

#: Shapes of URLs that the pages themselves do not have, made from each page's number.
#: The same text is valid in Spark SQL and in DuckDB.
VARIANTS = """
select page_id, 0 as k, url from pages
union all select page_id, 1, 'https://Novel.example.com:8080/book/' || page_id || '/' || (page_id % 120) || '.html?page=1' from pages
union all select page_id, 2, 'https://a.example.com/html/10' || page_id || '/1465' || (10000 + page_id) || '_' || (page_id % 12) || '/' from pages
union all select page_id, 3, 'http://b.example.org/xs/898' || page_id || '/1358/' || (page_id % 40) from pages
union all select page_id, 4, 'http://b.example.org/gb_1/94443/' || (page_id % 9) || '/' || (page_id % 15) || '/?x=1' from pages
union all select page_id, 5, 'https://c.example.net/read/' || page_id || '-' || (page_id % 5) || '.html?bid=77' from pages
union all select page_id, 6, 'https://user:pw@c.example.net/chapter.html?token=abc' || page_id || '&PAGE=' || (page_id % 4) || '&api_key=z#frag' from pages
union all select page_id, 7, 'http://' || (page_id % 256) || '.' || (page_id % 40) || '.0.1/novel/chapters/x/' || page_id || '.html' from pages
union all select page_id, 8, case page_id % 8 when 0 then 'ftp://x.example.com/a/1' when 1 then 'not a url' when 2 then 'https://toc.example.com/catalog/' when 3 then 'https://x.example.com/login/' when 4 then 'https://x.example.com/' when 5 then 'https://localhost./book/12/3.html' when 6 then 'HTTPS://Q.Example.com/a/index.html' else 'https://x.example.com/list/?toc=1' end from pages
"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(VARIANTS.replace("from pages", "from {pages}"), pages=table(spark, sf_dir, "pages"))


def _columns(**columns):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        url = F.col("url")
        return variants(spark, sf_dir).select("page_id", F.col("k").alias("k"), *(f(url).alias(n) for n, f in columns.items()))

    return run


# --- DuckDB twins of the pieces -------------------------------------------------------------

_AUTH = "[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def ex(c: str, p: str, n: int = 1) -> str:
    return f"regexp_extract({c}, '{p}', {n})"


def has(c: str, p: str) -> str:
    return f"regexp_matches({c}, '{p}')"


def grp(c: str, p: str, n: int = 1) -> str:
    return f"case when {has(c, p)} then {ex(c, p, n)} end"


def sql_lower(c: str) -> str:
    return f"translate({c}, '{U.UPPER}', '{U.UPPER.lower()}')"


def sql_path(u: str) -> str:
    return f"(case when {has(u, '^' + _AUTH)} then coalesce(nullif({ex(u, f'^{_AUTH}([^?#]*)')}, ''), '/') end)"


def sql_query(u: str) -> str:
    return ex(u, r"^[^?#]*(\?[^#]*)")


def sql_host(u: str) -> str:
    auth = grp(u, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")
    bare = f"regexp_replace(regexp_replace({sql_lower(auth)}, '^[^@]*@|:[0-9]*$', '', 'g'), '\\.$', '')"
    return f"(case when regexp_matches({bare}, '^[^\\s\\\\/?#@]+$') then {bare} end)"


def sql_bare(u: str) -> str:
    return f"regexp_replace({u}, '#.*$', '')"


def sql_http(u: str) -> str:
    return f"coalesce(regexp_matches({u}, '(?i)^https?://[^/?#\\s]'), false)"


_P, _Q, _H, _B = sql_path("url"), sql_query("url"), sql_host("url"), sql_bare("url")
_KEYS = "|".join(U.PAGE_KEYS)
_SOLE = rf"(?i)^([^?#]*\.html?)\?({_KEYS})=1$"


def sql_section(p: str) -> tuple[str, str]:
    """(chapter_key, section) of a path."""
    p = f"(case when {p} like '/%' then {p} else '/' || {p} end)"
    parts = f"list_filter(string_split({p}, '/'), lambda x: x <> '')"
    n = f"len({parts})"
    last, before = f"{parts}[{n}]", f"{parts}[{n} - 1]"
    head = lambda k: f"{parts}[1:{n} - {k}]"
    bigs = lambda a: f"len(list_filter({a}, lambda x: regexp_matches(x, '^[0-9]{{3,}}$')))"
    files = [(r"(?i)^(.*/[0-9]+)[_-]([0-9]+)\.html?$", True), (r"^(.*/[0-9]{5,})_([0-9]{1,2})/?$", True), (r"(?i)^(.*/[0-9]+)/([0-9]+)\.html?$", True), (r"(?i)^(.*/[0-9]+)\.html?$", False)]
    cases = []
    for pattern, paged in files:
        page = f"try_cast({ex(p, pattern, 2)} as int)" if paged else "1"
        cases.append((f"{has(p, pattern)} and {page} between 1 and 99", ex(p, pattern, 1), page))
    front = f"'/' || array_to_string({head(1)}, '/')"
    number = f"try_cast({last} as int)"
    two, tail = has(last, "^[0-9]{1,2}$"), f"{number} between 1 and 99"
    cases.append((f"{n} >= 4 and {two} and {has(before, '^[0-9]{1,6}$')} and {bigs(head(2))} > 0 and {tail}", front, number))
    cases.append((f"{n} >= 3 and {two} and {has(before, '^[0-9]{3,}$')} and {bigs(head(1))} >= 2 and {tail}", front, number))
    cases.append((f"{n} >= 3 and {has(last, '^[0-9]{1,6}$')} and {bigs(head(1))} > 0", f"'/' || array_to_string({parts}, '/')", "1"))
    cases.append((has(p, r"^(.*/[0-9]{3,})/?$"), ex(p, r"^(.*/[0-9]{3,})/?$", 1), "1"))
    return tuple(f"case {' '.join(f'when {c[0]} then {c[i]}' for c in cases)} end" for i in (1, 2))


def _base() -> str:
    file, folder = r"(?i)^(.*/[0-9]+)[_-][0-9]+(\.html?)$", r"^(.*/[0-9]{5,})_([0-9]{1,2})(/?)$"
    rest, root = ex("url", "^[^?#]*(.*)$"), ex("url", f"^({_AUTH})")
    parts = f"list_filter(string_split({_P}, '/'), lambda x: x <> '')"
    n = f"len({parts})"
    last, before, front = f"{parts}[{n}]", f"{parts}[{n} - 1]", f"array_to_string({parts}[1:{n} - 1], '/')"
    bigs = lambda k: f"len(list_filter({parts}[1:{n} - {k}], lambda x: regexp_matches(x, '^[0-9]{{3,}}$')))"
    slash = f"case when {_P} like '%/' then '/' else '' end"
    numbered = rf"(?i)^([^?#]*\?(?:[^#]*&)?(?:{_KEYS})=)0*([1-9][0-9]*)((?:&[^#]*)?(?:#.*)?)$"
    two = has(last, "^[0-9]{1,2}$")
    return f"""case when {has('url', file)} then {ex('url', file, 1)} || {ex('url', file, 2)}
      when {has(_P, folder)} and try_cast({ex(_P, folder, 2)} as int) >= 1 then {root} || {ex(_P, folder, 1)} || {ex(_P, folder, 3)} || {rest}
      when {n} >= 3 and {two} and {has(before, '^[0-9]{3,}$')} and {bigs(1)} >= 2 then {root} || '/' || {front} || '/1' || {slash} || {rest}
      when {n} >= 4 and {two} and {has(before, '^[0-9]{1,6}$')} and {bigs(2)} > 0 and try_cast({last} as int) > 1 then {root} || '/' || {front} || {slash} || {rest}
      when {has('url', numbered)} and try_cast({ex('url', numbered, 2)} as bigint) > 1 then {ex('url', numbered, 1)} || '1' || {ex('url', numbered, 3)} end"""


def sql_kind(u: str) -> str:
    p, q = sql_lower(sql_path(u)), sql_lower(sql_query(u))
    return f"case when not {sql_http(u)} then 'other' when {has(p, U.CHAPTER_END)} then 'chapter' when {has(p, U.TOC_PATH)} or {has(q, U.TOC_QUERY)} then 'toc' when {has(p, U.CHAPTER_PATH)} then 'chapter' else 'other' end"


def _invalid() -> str:
    parts = f"list_filter(string_split({_P}, '/'), lambda x: x <> '')"
    return f"coalesce(len({parts}) = 0 or (len({parts}) = 1 and not {has(_P, '[0-9]')}) or {' or '.join(has(_P, x) for x in U.NOT_CHAPTER_PATHS)}, false)"


def _public() -> str:
    o = lambda i: f"try_cast(string_split({_H}, '.')[{i}] as int)"
    private = f"regexp_matches({_H}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') and ({o(1)} in (0, 10, 127) or greatest({o(1)}, {o(2)}, {o(3)}, {o(4)}) > 255 or ({o(1)} = 100 and {o(2)} between 64 and 127) or ({o(1)} = 169 and {o(2)} = 254) or ({o(1)} = 172 and {o(2)} between 16 and 31) or ({o(1)} = 192 and {o(2)} = 168))"
    return f"case when {sql_http('url')} and coalesce(not (({private}) or {has(_H, r'(^|\.)localhost$')}), false) then {_B} end"


def _candidate() -> str:
    p = sql_lower(_P)
    return f"coalesce({sql_http('url')} and not ({has(p, U.NOT_READING)} or {has(p, U.NOT_READING_FILES)} or {has(p, '/(catalog|toc)/')}) and (({has(p, '/(chapter|txt|read|article)/')} and {has(p, '[0-9]')}) or ({has(p, '/(book|novel|xiaoshuo)/')} and {has(p, '[0-9]')} and {has(p, r'\.html?$')}) or {has(p, r'[0-9]{3,}[^/]*\.html?$')}), false)"


_CANONICAL = f"case when {has(_B, _SOLE)} then {ex(_B, _SOLE)} else {_B} end"
_BLOCK = f"regexp_replace(regexp_replace({_B}, '/$', ''), '/index\\.html?$', '')"
_PATTERN = f"regexp_replace(coalesce({_P}, url), '[0-9]+', '{{N}}', 'g')"
_BOOK = "coalesce(" + ", ".join(f"{grp(_P, x)}, {grp(_Q, x)}" for x in U.BOOK_IDS) + ")"
_NUMBER = "coalesce(" + ", ".join(f"try_cast({grp('url', x)} as bigint)" for x in U.CHAPTER_NUMBERS) + ")"
_KEY = f"coalesce({_H} || replace({_P}, '/', '_') || case when {_Q} in ('', '?') then '' else '~q~' || replace(replace(replace(base64(encode({_Q})), '+', '-'), '/', '_'), '=', '') end, substr(base64(encode(url)), 1, 32))"
_SAFE = "case when regexp_matches(trim(url), '(?i)^(https?:)?//') then trim(url) when trim(url) <> '' and not regexp_matches(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*:') then trim(url) end"
_REDACT = f"regexp_replace(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*://)[^/?#@]*@', '\\1{U.REDACTED}@'), '{U.SENSITIVE}', '\\1{U.REDACTED}', 'g')"
_SKIP = "coalesce(" + " or ".join(has("url", f"(?i)/({x})") for x in U.SKIPPED) + ", false)"

_PAIRS = {
    "url_canonical": ({"canonical": U.canonical_url}, {"canonical": _CANONICAL}),
    "url_compare_key": ({"compare_key": U.compare_url, "block_key": U.block_key}, {"compare_key": _B, "block_key": _BLOCK}),
    "url_hostname": ({"host": U.hostname}, {"host": _H}),
    "url_public": ({"public": U.public_http_url}, {"public": _public()}),
    "url_book_id": ({"book_id": U.book_id_from_url}, {"book_id": _BOOK}),
    "url_chapter_number": ({"number": U.url_chapter_number}, {"number": _NUMBER}),
    "url_section_base": ({"base": U.section_base_url}, {"base": _base()}),
    "url_chapter_section": (
        {"chapter_key": lambda u: U.chapter_section(U.path(u))["chapter_key"], "section": lambda u: U.chapter_section(U.path(u))["section"]},
        dict(zip(("chapter_key", "section"), sql_section(_P), strict=True)),
    ),
    "url_redact": ({"redacted": U.redact_url}, {"redacted": _REDACT}),
    "url_safe": ({"safe": U.safe_url}, {"safe": _SAFE}),
    "url_book_key": ({"book_key": U.book_key}, {"book_key": _KEY}),
    "page_kind_by_url": ({"kind": U.page_kind_url}, {"kind": sql_kind("url")}),
    "page_skip": ({"skip": U.skip_url}, {"skip": _SKIP}),
    "page_candidate": ({"candidate": U.chapter_candidate_url}, {"candidate": _candidate()}),
    "url_invalid_chapter": ({"invalid": U.is_invalid_chapter_url}, {"invalid": _invalid()}),
}

QUERIES = {name: _columns(**own) for name, (own, _) in _PAIRS.items()}
ORACLES = {name: f"with v as ({VARIANTS}) select page_id, k, {', '.join(f'{e} as {n}' for n, e in own.items())} from v" for name, (_, own) in _PAIRS.items()}


def url_pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL shapes by host."""
    v = variants(spark, sf_dir).select(U.hostname(F.col("url")).alias("host"), U.url_pattern(F.col("url")).alias("pattern"))
    return v.groupBy("host", "pattern").agg(F.count(F.lit(1)).alias("n"))


def url_next_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a page's URL with the next page number follow it?"""
    v = variants(spark, sf_dir)
    base = F.col("url")
    number = F.coalesce(U.chapter_section(U.path(base))["section"], F.lit(1))
    following = F.when(F.col("k") == 2, F.regexp_replace(base, "_[0-9]+/$", "_")).otherwise(F.regexp_replace(base, r"[0-9]+$", ""))
    candidate = F.concat(following, (number + F.pmod("page_id", F.lit(3)).cast("int")).cast("string"), F.when(F.col("k") == 2, "/").otherwise(""))
    return v.where("k in (2, 3)").select("page_id", "k", U.is_next_section(base, candidate).alias("is_next"))


QUERIES |= {"url_pattern_counts": url_pattern_counts, "url_next_section": url_next_section}
ORACLES["url_pattern_counts"] = f"with v as ({VARIANTS}) select {_H} as host, {_PATTERN} as pattern, count(*) as n from v group by all"
_KEY_N = sql_section(_P)
_KEY_F = sql_section(sql_path("f"))
ORACLES["url_next_section"] = f"""with v as (select page_id, k, url, {_KEY_N[0]} as ck, {_KEY_N[1]} as cs from ({VARIANTS}) where k in (2, 3)),
w as (select *, case when k = 2 then regexp_replace(url, '_[0-9]+/$', '_') else regexp_replace(url, '[0-9]+$', '') end || (coalesce(cs, 1) + page_id % 3) || case when k = 2 then '/' else '' end as f from v),
x as (select *, {_KEY_F[0]} as fk, {_KEY_F[1]} as fs from w)
select page_id, k, coalesce(ck = fk and fs = cs + 1 and fs > 1, false) as is_next from x"""
