"""Queries of text functions and line operators over documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U
from leafmill.operators import classify, clean, detect, rules
from leafmill.plans.page_queries import q, rx, s_chain, s_trim
from leafmill.plans.url_queries import sql_host, sql_kind, sql_path
from leafmill.sources import pages as S
from leafmill.tables import materialize, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SP = q(T.SPACE + "+")
#: Texts with the wording that the functions look for; valid in both engines.
NOISY = "case doc_id % 8 when 0 then '第' || (doc_id % 30) || '章 （本章未完，请点击下一页继续阅读）' || text when 1 then text || ' www.example.com (2/' || (doc_id % 7) || ')' when 2 then '伱好 ' || text when 3 then '正文卷 ' || text || '_site' when 4 then 'Chapter ' || doc_id || ' ' || text when 5 then '著名 看著 気 ' || text when 6 then '公告 ' || text else text end"


def noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread first: a Parquet file of few row groups would be the work of as few tasks."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", F.expr(NOISY).alias("text"))


def docs_query(name: str, columns: dict, sql: dict) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return noisy(spark, sf_dir).select("doc_id", *(f(F.col("text")).alias(n) for n, f in columns.items()))

    QUERIES[name] = run
    ORACLES[name] = f"with d as (select doc_id, {NOISY} as text from documents) select doc_id, {', '.join(f'{e} as {n}' for n, e in sql.items())} from d"


_SOLID = f"length(regexp_replace(text, {_SP}, '', 'g'))"
_ADS = s_chain("translate(text, '伱', '你')", T.ADS)
_COLLAPSED = lambda c: f"trim(regexp_replace({c}, {_SP}, ' ', 'g'))"
_LIKELY = lambda c: "(" + " or ".join(rx(f"trim({c})", p) for p in T.LIKELY_TITLES) + ")"
_NON = lambda c: f"(length(trim({c})) < 2 or " + " or ".join(rx(f"trim({c})", p) for p in T.OTHER_TITLES) + ")"
_TITLE = f"trim(regexp_replace({s_chain('trim(text)', T.TITLE_REMOVALS)}, '[ \\n\\r\\t\\f\\v]+', ' ', 'g'))"
_NUMBER = "coalesce(" + ", ".join(f"try_cast(case when {rx('text', p)} then regexp_extract(text, {q(p)}, 1) end as bigint)" for p in T.TITLE_NUMBERS) + ")"
_M1, _M2 = r"[（(]\s*([0-9]{1,3})\s*[/／]\s*([0-9]{1,3})\s*[）)]", r"第\s*([0-9]{1,3})\s*[/／]\s*([0-9]{1,3})\s*页"
_MARK = lambda i: f"case when {rx('text', _M1)} then try_cast(regexp_extract(text, {q(_M1)}, {i}) as int) when {rx('text', _M2)} then try_cast(regexp_extract(text, {q(_M2)}, {i}) as int) end"
_VALID = f"({_MARK(1)}) >= 1 and ({_MARK(1)}) <= ({_MARK(2)})"
_COUNT = lambda k: f"len(regexp_extract_all(substr(text, 1, {T.SCRIPT_SAMPLE}), '[{T.MARKERS[k]}]'))"
_TOP = "greatest(" + ", ".join(_COUNT(k) for k in T.MARKERS) + ")"
_FOUND = "list_filter([" + ", ".join(f"case when {_COUNT(k)} > 0 and {_COUNT(k)} * 2 >= {_TOP} then '{k}' end" for k in T.MARKERS) + "], lambda x: x is not null)"
_GUARD = reduce(lambda a, w: f"replace({a}, '{w}', '{w.replace('著', chr(0xE000))}')", T.KEPT_ZHU, "text")
_PREVIEW = f"case when length({s_trim('text')}) > 200 then substr({s_trim('text')}, 1, 200) || '...' else {s_trim('text')} end"
_RULES = [(r"[0-9]+", "#", "g"), (r"the", "THE", "gi"), (r"(", "x", "g"), (r"THE (\w+)", "$1", "g")]

docs_query("cjk_ratio", {"han": lambda c: F.round(T.cjk_ratio(c), 9)}, {"han": f"round(case when {_SOLID} > 0 then len(regexp_extract_all(text, {q(T.HAN)})) / {_SOLID} else 0.0 end, 9)"})
docs_query("ad_removal", {"text": lambda c: F.md5(T.remove_ads(T.repair_glyphs(c)).cast("binary"))}, {"text": f"md5({_ADS})"})
docs_query("clean_text", {"text": T.clean_text}, {"text": _COLLAPSED(_ADS)})
docs_query("collapse_ws", {"text": T.collapse}, {"text": _COLLAPSED("text")})
docs_query("replace_rules", {"text": lambda c: T.apply_replacements(c, _RULES)}, {"text": "regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', '#', 'g'), '(?i)the', 'THE', 'g'), 'THE (\\w+)', '\\1', 'g')"})
docs_query("title_kinds", {"likely": T.is_likely_chapter_title, "other": T.is_non_chapter_title, "chapter": T.is_chapter_title, "placeholder": T.is_placeholder_title}, {"likely": _LIKELY("text"), "other": _NON("text"), "chapter": rx("text", T.CHAPTER_TITLE), "placeholder": rx("trim(text)", r"^章节\s*[0-9]+$")})
docs_query("title_clean", {"title": T.clean_title, "number": T.title_chapter_number}, {"title": _TITLE, "number": _NUMBER})
docs_query("section_marks", {"page": lambda c: T.section_marker(c)["page"], "total": lambda c: T.section_marker(c)["total"]}, {"page": f"case when {_VALID} then {_MARK(1)} end", "total": f"case when {_VALID} then {_MARK(2)} end"})
docs_query("link_labels", {"kind": T.link_text_kind, "direction": T.link_direction}, {"kind": "case when " + " or ".join(rx("text", p) for p in T.SECTION_LABELS) + " then 'section' when " + " or ".join(rx("text", p) for p in T.CHAPTER_LABELS) + " then 'chapter' end", "direction": f"case when {rx('text', r'(?i)下一?|后一|後一|next|继续|繼續')} then 'forward' when {rx('text', r'(?i)上一?|前一|prev|previous')} then 'backward' end"})
docs_query("script_counts", {"hans": lambda c: T.script_counts(c)["hans"], "hant": lambda c: T.script_counts(c)["hant"], "script": T.chinese_script}, {"hans": f"cast({_COUNT('hans')} as int)", "hant": f"cast({_COUNT('hant')} as int)", "script": f"case when len({_FOUND}) = 0 then 'unknown' when len({_FOUND}) = 1 then ({_FOUND})[1] else 'mixed' end"})
docs_query("simplified_variants", {"text": T.to_simplified_variants}, {"text": f"translate({_GUARD}, '{''.join(T.VARIANTS)}著{chr(0xE000)}', '{''.join(T.VARIANTS.values())}着著')"})
docs_query("text_preview", {"preview": T.preview}, {"preview": _PREVIEW})
docs_query("text_truncate", {"text": T.truncate}, {"text": "case when length(text) > 500 then substr(text, 1, 500) || '...<truncated:' || (length(text) - 500) || '>' else text end"})
docs_query("insufficient", {"insufficient": classify.insufficient_content}, {"insufficient": f"{_SOLID} < 80 or ({rx('text', classify.LOADING)} and {_SOLID} < 200)"})


@query("with recursive h(page_id, t, i, v) as (select page_id, url, 0, cast(2166136261 as ubigint) from pages union all select page_id, t, i + 1, (xor(v, cast(unicode(substr(t, i + 1, 1)) as ubigint)) * 16777619) & 4294967295 from h where i < length(t)) select page_id, 'fnv1a:' || lpad(lower(to_hex(v)), 8, '0') as hash from h where i = length(t)")
def fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F21 of all URLs."""
    return S.read_pages(spark, sf_dir).select("page_id", T.fnv1a_hex(F.col("url")).alias("hash"))


_STRIPPED = f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', '', 'g'), '(?i)&nbsp;|&#160;', ' ', 'g')"


@query(f"select page_id, length({s_trim(_STRIPPED)}) as n from pages")
def html_text_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_pages(spark, sf_dir).select("page_id", T.html_text_length(F.col("html")).alias("n"))


_FZ = lambda c: f"lower(regexp_replace({c}, {_SP}, '', 'g'))"


@query(f"""with d as (select doc_id, string_split(text, chr(10))[1] as a, coalesce(string_split(text, chr(10))[2], '') as b from documents), z as (select doc_id, {_FZ('a')} as x, {_FZ('b')} as y from d)
select doc_id, x <> '' and y <> '' and (x = y or contains(x, y) or contains(y, x) or (length(y) >= 3 and len(list_filter(string_split(y, ''), lambda ch: ch <> '' and contains(x, ch))) >= 0.7 * length(y))) as fuzzy from z""")
def fuzzy_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16 of each document's first two lines."""
    lines = F.split("text", "\n", 3)
    return table(spark, sf_dir, "documents").select("doc_id", T.fuzzy_match(F.get(lines, F.lit(0)), F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).alias("fuzzy"))


@query()
def lead_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5, F17 with each document's first line as its title."""
    docs = table(spark, sf_dir, "documents")
    titles = docs.select("doc_id", F.get(F.split("text", "\n", 2), F.lit(0)).alias("title"))
    return clean.trim_leading(clean.lines_of(docs), titles)


_TAILS = r"^\s*>\s*$|^\s*[(（]?(本章完|未完待续)[)）]?\s*$"


@query(f"""with d as (select doc_id, text || case doc_id % 3 when 0 then chr(10) || '>' || chr(10) || chr(10) when 1 then chr(10) || '（本章完）' else '' end as text from documents),
l as (select doc_id, i - 1 as pos, p[i] as line, len(p) - i + 1 as k from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, string_split(text, chr(10)) as p from d))),
n as (select *, {s_trim('line')} = '' or {rx('line', _TAILS)} as noise from l), s as (select *, min(case when not noise or k > 3 then k end) over (partition by doc_id) as stop from n)
select doc_id, cast(pos as int) as pos, line from s where k >= stop""")
def tail_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text || case doc_id % 3 when 0 then '\n>\n\n' when 1 then '\n（本章完）' else '' end as text")
    return clean.trim_trailing(clean.lines_of(docs))


FILTERS = "\n".join(["^the and", "[0-9]{4}", "", "@host=src3 tion", "(", "@host=bad/host x"])


@query(f"""with l as (select doc_id, source as host, i - 1 as pos, p[i] as line from (select doc_id, source, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, source, string_split(text, chr(10)) as p from documents)))
select doc_id, cast(pos as int) as pos from l where not (regexp_matches({_COLLAPSED('line')}, '(?i)^the and') or regexp_matches({_COLLAPSED('line')}, '[0-9]{{4}}') or (host = 'src3' and regexp_matches({_COLLAPSED('line')}, '(?i)tion')))""")
def paragraph_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J-9, J7, P18: lines as paragraphs, sources as hosts."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.col("source").alias("host"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return rules.filter_paragraphs(lines, rules.compile_filters(FILTERS)[0]).select("doc_id", "pos")


RULES = [
    {"id": "shop", "pattern": r"(casino|pills|bets)", "exclude": [r"/fr/"]},
    {"id": "blog", "pattern": "http*://blog.*", "type": "glob", "exclude": [r"page=2"]},
    {"id": "org", "pattern": r"\.example\.org/", "exclude": []},
    {"id": "english", "pattern": r"/en/[0-9]+", "exclude": [r"^https://m\."]},
]


@query(f"""with m as (select page_id, url, case when regexp_matches(url, '(?i)(casino|pills|bets)') and not regexp_matches(url, '(?i)/fr/') then 'shop' when regexp_matches(url, '(?i)^http.*://blog\\..*$') and not regexp_matches(url, '(?i)page=2') then 'blog' when regexp_matches(url, '(?i)\\.example\\.org/') then 'org' when regexp_matches(url, '(?i)/en/[0-9]+') and not regexp_matches(url, '(?i)^https://m\\.') then 'english' end as rule_id from pages) select page_id, rule_id from m""")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.match_rule(S.read_pages(spark, sf_dir), RULES).select("page_id", "rule_id")


@query(f"with p as (select {sql_host('url')} as h, max(page_id % 2 = 0) as e from pages where page_id % 3 = 0 group by 1) select page_id, cast(e as varchar) as preference from pages left join p on {sql_host('url')} = h")
def site_pref_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.read_pages(spark, sf_dir)
    prefs = pages.where("page_id % 3 = 0").groupBy(U.hostname(F.col("url")).alias("hostname")).agg(F.max(F.col("page_id") % 2 == 0).alias("enabled"))
    return rules.with_site_preference(pages, prefs).select("page_id", F.col("preference").cast("string").alias("preference"))


def _decision_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = S.read_pages(spark, sf_dir)
    rows = rules.match_rule(pages.select("page_id", "url"), RULES)
    prefs = pages.where("page_id % 3 = 0").groupBy(U.hostname(F.col("url")).alias("hostname")).agg(F.max(F.col("page_id") % 2 == 0).alias("enabled"))
    rows = rules.with_site_preference(rows, prefs)
    features = materialize(classify.page_features(pages), "features")
    for more in (classify.block_reasons(pages), classify.page_kinds(pages, features).select("page_id", "url_kind", "dom_kind"), classify.quick_checks(pages, features).select("page_id", F.col("looks_like_chapter").alias("quick")), detect.detect_pages(pages, detect.LATIN).select("page_id", F.col("overall").alias("confidence"))):
        rows = rows.join(more, "page_id")
    return rows


@query()
def auto_enable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 over all pages."""
    return classify.auto_enable(_decision_inputs(spark, sf_dir))


@query()
def toc_page_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P10: is a page a catalog, seen from a chapter of its host?"""
    current = F.concat(F.lit("https://"), U.hostname(F.col("url")), F.lit("/read/1/"), F.col("page_id").cast("string"))
    return classify.toc_pages(S.read_pages(spark, sf_dir), current)


@query()
def load_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17, P25 over page URLs as targets."""
    host = U.hostname(F.col("url"))
    rows = S.read_pages(spark, sf_dir).select("page_id", F.when(F.pmod("page_id", F.lit(11)) > 0, F.col("url")).alias("target"), F.concat(F.lit("https://"), host, F.lit("/en/"), F.col("page_id").cast("string")).alias("index_url"), F.concat(F.lit("https://"), host, F.lit("/en/1/2/3")).alias("current"), *(((F.col("page_id") % n) == 0).alias(c) for c, n in (("cached", 4), ("locked", 5), ("blocked", 7), ("loaded", 3), ("incomplete", 22))))
    return classify.load_gate(rows).select("page_id", "verdict")


@query()
def clean_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 over all pages: removal, repair, paragraphs, trimming."""
    pages = S.read_pages(spark, sf_dir)
    nodes = S.html_nodes(pages).where("tag <> 'title'")
    return clean.clean_content(nodes, detect.detect_title(pages).select("page_id", "title"))


@query(f"select page_id, {sql_kind('url')} as kind, {sql_path('url')} as path from pages")
def page_kind_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_pages(spark, sf_dir).select("page_id", U.page_kind_url(F.col("url")).alias("kind"), U.path(F.col("url")).alias("path"))


@query()
def selector_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which id, class or tag names the content of each host's pages."""
    pages = S.read_pages(spark, sf_dir)
    nodes = S.html_nodes(pages)
    winners = detect.known_content(nodes, detect.LATIN).select("page_id", "pos").join(pages.select("page_id", "url"), "page_id")
    return clean.selector_counts(nodes, winners, U.hostname(F.col("url")))
