"""Text functions (F1-F13, F16-F22, F26, A14, N1, N3) as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as browsers see it, and families of titles and link labels.
SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same characters by their category, which Java tests in one step instead of eleven; SQL keeps SPACE.
WHITE = r"[\s\p{Z}\x{FEFF}]"
HAN = r"[\x{4E00}-\x{9FFF}]"
NUMERALS = "一二两三四五六七八九十百千万零〇0-9"
CHAPTER_TITLE = r"(?i)第?\s*[一二两三四五六七八九十○零百千万亿0-9１２３４５６７８９０〇]{1,6}\s*[章回卷节折篇幕集话話]|序章|楔子|番外|后记|尾声|前言|引子|chapter\s*[0-9]+"
LIKELY_TITLES = [r"^.{0,10}第.{1,10}[章节回话篇集卷]", r"^[0-9]{1,4}[.、\s]", r"^(序章|序幕|楔子|引子|终章|尾声|番外|后记|前言)", r"(?i)^chapter\s*[0-9]+", r"(?i)^(prologue|epilogue|preface)"]
OTHER_TITLES = [
    r"^(公告|通知|声明|说明|必读|注意|警告|温馨提示)",
    r"上架感言|完本感言|请假|推迟|停更|断更|更新|爆更|上架通知|卷末感言",
    r"必看|必读|请务必阅读|读者必看",
    r"^(作者|关于作者|作品相关|设定|世界观|人物介绍|角色)",
    r"求.*票|求.*收藏|求.*订阅|求.*打赏|求.*推荐|求.*支持",
    r"新书|推荐|安利|宣传|书单|书评",
    r"^(目录|封面|简介|内容简介|书籍信息|作品信息)",
    r"(?i)^(VIP|付费|锁定|未解锁|需订阅|加入书架)$",
    r"官网|公众号|微信|QQ群|粉丝群|书友群|交流群|读者群",
    r"登[录陆]|注册|充值|书架|书城|排行|分类|搜索|设置",
    r"首页|返回|上一页|下一页|翻页",
    r"^(章节|分卷|卷|部|篇)\s*[0-9一二三四五六七八九十百千]+\s*$",
    r"^(正文|番外|VIP卷?|免费章节?)\s*$",
]
TITLE_REMOVALS = [r"^章节目录", r"^文章正文", r"^正文卷?", r"全文免费阅读$", r"最新章节$", r"[（(]\s*[0-9]+\s*[/／]\s*[0-9]+\s*[）)]\s*$", r"\(文\)$", r"_.*$", r"(?i)-.*小说.*$"]
TITLE_NUMBERS = [r"第\s*([0-9]+)\s*[章节回话篇集卷]", r"^([0-9]+)[.、\s]", r"(?i)Chapter\s*([0-9]+)"]
SECTION_LABELS = [r"[下上]一?页", r"[下上]一?頁", r"第[0-9]+页", r"\([0-9]+/[0-9]+\)"]
CHAPTER_LABELS = [r"[下上]一?章", r"[下上]一?[节節]", r"第.+[章节節]"]
SITE_WORDS = ["起点中文网", "起点中文網", "顶点小说", "頂點小說", "笔趣阁", "筆趣閣", "小说网", "小說網", "小说阅读网", "小說閱讀網", "小说阅读", "小說閱讀", "阅读网", "閱讀網", "书吧", "書吧", "69书吧", "69書吧"]
GENERIC_BOOK = r"(?i)^(首页|主页|home|index|返回|返回目录|目录|章节目录|章節目錄|章节列表|章節列表|章节|章節|最新章节|最新章節|正文|内容|內容|简介|簡介|作品信息|书籍信息|書籍信息|小说|小說|阅读|閱讀|catalog|toc|contents?)$"
# Confirmed glyph substitutions, and what was meant.
GLYPHS = {"伱": "你"}
# Advertisement patterns, in order.
ADS = [
    r"(?i)[（(]本章未完[，,]?请?点击下一页继续阅读[）)]",
    r"(?i)本章未完[，,]?请?点击下一页继续.*",
    r"(?i)请点击下一页继续阅读",
    r"(?i)点击下一页继续阅读",
    r"[（(]第[0-9]+[/／][0-9]+页[）)]",
    r"第[0-9]+[/／][0-9]+页",
    r"[（(]\s*[）)]",
    r"(?m)[（(]\s*$",
    r"(?m)^\s*[）)]",
    r"手机用户请到.*阅读",
    r"请记住本书.*网址",
    r"(?i)【[^】\r\n]{1,120}】(?:小说|小說)(?:免费|免費)(?:阅读|閱讀)[，,][ \t\x{3000}]*(?:请|請)收藏[ \t\x{3000}]*[^【】\r\n]{1,32}【1qxs\.com】",
    r"([请請]?[记記]住首[发發][网網]站(域名)?|[请請][记記]住[网網]址)[^<\n]*",
    r"百度搜索.*最新章节",
    r"一秒记住.*为您提供",
    r"天才一秒记住",
    r"(?i)笔趣阁.*www\.[a-z]+\.(com|net|org)",
    r"添加书签\s*返回目录\s*章节报错\s*分享给朋友[:：]?\s*",
    r"添加書籤\s*返回目錄\s*章節報錯\s*分享給朋友[:：]?\s*",
    r"由於[緩缓存]原因[^<\n]{0,120}(更新|網站|网站|站)",
    r"[请請][用戶用户]直接[瀏覽浏览]器[訪访]問[^<\n]{0,120}",
    r"(阅[|｜\s]*读[|｜\s]*模[|｜\s]*式|畅[|｜\s]*读[|｜\s]*模[|｜\s]*式)[^<\n]{0,60}无[|｜\s]*法[|｜\s]*显[|｜\s]*示[|｜\s]*本[|｜\s]*章[|｜\s]*节[|｜\s]*全[|｜\s]*部[|｜\s]*内[|｜\s]*容[^<\n]{0,120}",
    r"请[|｜\s]*返[|｜\s]*回[|｜\s]*原[|｜\s]*网[|｜\s]*页[|｜\s]*阅[|｜\s]*读",
    r"加[|｜\s]*载[|｜\s]*更[|｜\s]*多",
    r"小[^\x{4e00}-\x{9fff}]{0,3}说[^\x{4e00}-\x{9fff}]{0,3}网[^\x{4e00}-\x{9fff}]{0,6}最[^\x{4e00}-\x{9fff}]{0,3}新[^\x{4e00}-\x{9fff}]{0,3}章[^\x{4e00}-\x{9fff}]{0,3}节[^\x{4e00}-\x{9fff}]{0,6}更[^\x{4e00}-\x{9fff}]{0,3}新[^\x{4e00}-\x{9fff}]{0,3}快",
    r"最[^\x{4e00}-\x{9fff}]{0,3}新[^\x{4e00}-\x{9fff}]{0,3}章[^\x{4e00}-\x{9fff}]{0,3}节[^\x{4e00}-\x{9fff}]{0,6}更[^\x{4e00}-\x{9fff}]{0,3}新[^\x{4e00}-\x{9fff}]{0,3}快",
    r"幻[^\x{4e00}-\x{9fff}]{0,3}想[^\x{4e00}-\x{9fff}]{0,3}姬[^\x{4e00}-\x{9fff}]{0,6}免[^\x{4e00}-\x{9fff}]{0,3}费[^\x{4e00}-\x{9fff}]{0,3}(阅|讀)[^\x{4e00}-\x{9fff}]{0,3}(读|讀)",
    r"萝[^\x{4e00}-\x{9fff}]{0,3}拉[^\x{4e00}-\x{9fff}]{0,3}小[^\x{4e00}-\x{9fff}]{0,3}说[^\x{4e00}-\x{9fff}]{0,3}[0-9]{1,3}[^\x{4e00}-\x{9fff}]{0,3}最[^\x{4e00}-\x{9fff}]{0,3}新[^\x{4e00}-\x{9fff}]{0,3}章[^\x{4e00}-\x{9fff}]{0,3}节[^\x{4e00}-\x{9fff}]{0,6}更[^\x{4e00}-\x{9fff}]{0,3}新[^\x{4e00}-\x{9fff}]{0,3}快",
    r"(?i)(天天看小说|天天看小說)[^<\n]*ttks\.tw",
    r"⚡?\s*天天看[小小說]{2}[^<\n]*",
    r"(?i)https?://[^\s<>\"]+",
    r"(?i)www\.[a-z0-9]+\.(com|net|org|cc)",
]
#: What any of ADS holds: brackets, a Han character, or the begin of an address.
AD_HINT = r"[()（）\x{4E00}-\x{9FFF}]|(?i:https?://|www\.)"
# Characters that only one script uses.
MARKERS = {"hans": "这为来时们个过还说对", "hant": "這為來時們個過還說對", "jpan": "のはをがにでとたし"}
SCRIPT_SAMPLE = 12000
# Japanese and traditional variants with one simplified form, and words that keep 著.
VARIANTS = {"気": "气", "対": "对", "悪": "恶", "帰": "归", "戦": "战", "発": "发", "読": "读", "図": "图", "関": "关", "経": "经"}
KEPT_ZHU = ["著名", "著作", "著者", "著称", "显著", "名著", "原著", "编著", "专著", "论著", "土著", "巨著", "译著", "昭著", "卓著", "遗著"]


def _any(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (F.rlike(c, F.lit(p)) for p in patterns)), F.lit(False))


def _chain(c: Column, patterns: list[str], to: str = "") -> Column:
    return reduce(lambda acc, p: F.regexp_replace(acc, p, to), patterns, c)


def trim(c: Column) -> Column:
    """Without white space of any kind at either end. A run within the text is tried once, from its
    begin: not from each of its places, which takes the square of its length."""
    return F.regexp_replace(c, rf"^{WHITE}++|(?<!{WHITE}){WHITE}++$", "")


def blank(c: Column) -> Column:
    """Whether there is nothing but white space; the search ends at the first other character."""
    return ~F.rlike(c, F.lit(rf"[^{WHITE[1:-1]}]"))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"{WHITE}+", " "))


def cjk_ratio(text: Column) -> Column:
    """Han characters among those that are no white space; 0 for a blank text."""
    solid = F.length(F.regexp_replace(text, rf"{WHITE}+", ""))
    return F.when(solid > 0, F.regexp_count(text, F.lit(HAN)) / solid).otherwise(F.lit(0.0))


def density(part: Column, whole: Column) -> Column:
    """part of whole, whole being 1 at least."""
    return part / F.greatest(whole, F.lit(1))


def is_chapter_title(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(CHAPTER_TITLE)), F.lit(False))


def is_likely_chapter_title(text: Column) -> Column:
    return _any(F.trim(text), LIKELY_TITLES)


def is_non_chapter_title(text: Column) -> Column:
    t = F.trim(text)
    return F.coalesce(F.length(t) < 2, F.lit(True)) | _any(t, OTHER_TITLES)


def is_placeholder_title(text: Column) -> Column:
    return F.coalesce(F.rlike(F.trim(text), F.lit(r"^章节\s*[0-9]+$")), F.lit(False))


def better_title(old: Column, new: Column) -> Column:
    """whether new is the better title."""
    a, b = is_likely_chapter_title(old), is_likely_chapter_title(new)
    p, q = is_placeholder_title(old), is_placeholder_title(new)
    return F.when(b & ~a, True).when(a & ~b, False).when(~p & q, False).when(p & ~q, True).otherwise(F.length(new) > F.length(old))


def clean_title(text: Column) -> Column:
    """nine removals in order, then single spaces."""
    return F.trim(F.regexp_replace(_chain(F.trim(text), TITLE_REMOVALS), r"\s+", " "))


def clean_book_title(text: Column) -> Column:
    """inside of book brackets, without edge punctuation, chapter part and site name."""
    t = F.trim(text)
    t = F.when(F.rlike(t, F.lit("《[^》]+》")), F.regexp_extract(t, "《([^》]+)》", 1)).otherwise(t)
    t = F.regexp_replace(t, r"^[\s\-_|,，:：·]+|[\s\-_|,，:：·]+$", "")
    t = F.regexp_replace(t, rf"\s*第[{NUMERALS}]+[章回卷节].*$", "")
    t = F.regexp_replace(t, r"(最新章节|全文阅读|全文免费阅读|无弹窗|小说)+$", "")
    t = F.regexp_replace(t, rf"[\s\-_|]+({'|'.join(sorted(SITE_WORDS, key=len, reverse=True))})$", "")
    return F.trim(t)


def valid_book_title(text: Column) -> Column:
    n = F.length(text)
    return F.coalesce(n.between(2, 100) & ~F.rlike(text, F.lit(GENERIC_BOOK)) & ~text.isin(SITE_WORDS), F.lit(False))


def title_chapter_number(title: Column) -> Column:
    """the chapter number in a title, by three patterns in order."""
    return F.coalesce(*(F.when(F.rlike(title, F.lit(p)), F.regexp_extract(title, p, 1).try_cast("long")) for p in TITLE_NUMBERS))


def section_marker(text: Column) -> Column:
    """F8: struct(page, total) of a mark such as (2/5), with 1 <= page <= total; else null."""
    forms = [r"[（(]\s*([0-9]{1,3})\s*[/／]\s*([0-9]{1,3})\s*[）)]", r"第\s*([0-9]{1,3})\s*[/／]\s*([0-9]{1,3})\s*页"]
    one = lambda p: F.when(F.rlike(text, F.lit(p)), F.struct(F.regexp_extract(text, p, 1).try_cast("int").alias("page"), F.regexp_extract(text, p, 2).try_cast("int").alias("total")))
    found = F.coalesce(*(one(p) for p in forms))
    return F.when((found["page"] >= 1) & (found["page"] <= found["total"]), found)


def link_text_kind(text: Column) -> Column:
    """section or chapter label, else null; both show as section."""
    return F.when(_any(text, SECTION_LABELS), "section").when(_any(text, CHAPTER_LABELS), "chapter")


def link_direction(text: Column) -> Column:
    return F.when(F.rlike(text, F.lit(r"(?i)下一?|后一|後一|next|继续|繼續")), "forward").when(F.rlike(text, F.lit(r"(?i)上一?|前一|prev|previous")), "backward")


def repair_glyphs(text: Column, glyphs: dict[str, str] = GLYPHS) -> Column:
    """F10"""
    return F.translate(text, "".join(glyphs), "".join(glyphs.values()))


def remove_ads(text: Column, patterns: list[str] = ADS, hint: str | None = AD_HINT) -> Column:
    """F11. Texts without a hint of any pattern are left as they are, unsearched."""
    return F.when(F.rlike(text, F.lit(hint)), _chain(text, patterns)).otherwise(text) if hint else _chain(text, patterns)


def normalize_ws(html: Column) -> Column:
    """no empty paragraphs, single spaces, two line breaks at most, paragraph edges trimmed."""
    t = F.regexp_replace(html, r"(?i)<p>\s*</p>", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)<p>\s+", "<p>"), r"(?i)\s+</p>", "</p>")


def apply_replacements(text: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(pattern, replacement, flags) in order; rules that do not compile are skipped."""
    for pattern, to, flags in rules:
        try:
            re.compile(pattern)
        except re.error:
            continue
        own = "".join(sorted(set(flags) & set("imsu")))
        text = F.regexp_replace(text, f"(?{own}){pattern}" if own else pattern, to)
    return text


def clean_text(text: Column) -> Column:
    """C11: repair, ads, and white space on plain text."""
    return collapse(remove_ads(repair_glyphs(text)))


def fuzzy_match(a: Column, b: Column) -> Column:
    """F16: equal, one in the other, or 70 % of b's characters (3 at least) in a."""
    x, y = (F.lower(F.regexp_replace(c, rf"{WHITE}+", "")) for c in (a, b))
    return F.coalesce(_once(F.struct(x.alias("x"), y.alias("y")), lambda s: _fuzzy(s["x"], s["y"])), F.lit(False))


def _once(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _fuzzy(x: Column, y: Column) -> Column:
    # y without the characters of x, in one pass over each
    shared = F.length(y) - F.length(F.call_function("translate", y, x, F.lit("")))
    enough = (F.length(y) >= 3) & (shared >= 0.7 * F.length(y))
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x) | enough)


def looks_like_title_line(line: Column, title: Column, book: Column | None = None) -> Column:
    """a line that repeats the title, the book's name or the author."""
    strip = lambda c: F.lower(F.regexp_replace(c, r"[\s\p{Punct}，。！？、：；“”‘’《》【】（）…—]+", ""))
    x, t = strip(line), strip(title)
    author = F.rlike(F.trim(line), F.lit(r"^(作者|author)\s*[:：]"))

    def same(s: Column) -> Column:
        x, t = s["x"], s["t"]
        core = F.regexp_replace(t, rf"^第[{NUMERALS}]+[章回卷节]", "")
        out = (x != "") & ((x == t) | ((t != "") & F.contains(x, t) & (F.length(x) <= F.length(t) + 10)) | ((F.length(core) >= 3) & (F.length(x) <= 2 * F.length(t)) & fuzzy_match(x, core)))
        if book is not None:
            b = s["b"]
            out = out | ((b != "") & ((x == b) | (x == F.concat(b, t)) | (x == F.concat(t, b))))
        return out

    parts = [x.alias("x"), t.alias("t")] + ([] if book is None else [strip(book).alias("b")])
    # only short lines are compared, and each is stripped once
    return F.coalesce(F.when(F.length(F.trim(line)) <= 100, author | _once(F.struct(*parts), same)), F.lit(False))


def script_counts(text: Column) -> Column:
    """struct(hans, hant, jpan): marker characters in the first 12,000."""
    head = F.substring(text, 1, SCRIPT_SAMPLE)
    return F.struct(*(F.regexp_count(head, F.lit(f"[{v}]")).alias(k) for k, v in MARKERS.items()))


def chinese_script(text: Column, *hints: Column) -> Column:
    """hans, hant, jpan, mixed or unknown; language tags first, then marker counts."""
    tag = lambda h: F.when(F.rlike(h, F.lit(r"(?i)^(zh-(hans|cn|sg)|zh_cn)")), "hans").when(F.rlike(h, F.lit(r"(?i)^(zh-(hant|tw|hk|mo)|zh_tw)")), "hant").when(F.rlike(h, F.lit(r"(?i)^ja(-|_|$)")), "jpan")
    counts = script_counts(text)
    top = F.greatest(*(counts[k] for k in MARKERS))
    found = F.array_compact(F.array(*(F.when((counts[k] > 0) & (counts[k] * 2 >= top), F.lit(k)) for k in MARKERS)))
    guess = F.when(F.size(found) == 0, "unknown").when(F.size(found) == 1, F.get(found, F.lit(0))).otherwise("mixed")
    return F.coalesce(*(tag(h) for h in hints), guess)


def to_simplified_variants(text: Column, source: Column | None = None, table: dict[str, str] = VARIANTS) -> Column:
    """variants by table, and 著 as 着 outside protected words; known simplified text is kept."""
    guard = reduce(lambda acc, w: F.replace(acc, F.lit(w), F.lit(w.replace("著", "\ue000"))), KEPT_ZHU, text)
    out = F.translate(guard, "".join(table) + "著\ue000", "".join(table.values()) + "着著")
    return out if source is None else F.when(F.coalesce(source, F.lit("")) == "hans", text).otherwise(out)


def truncate(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("...<truncated:"), (F.length(text) - limit).cast("string"), F.lit(">"))).otherwise(text)


def redact_text(text: Column, limit: int = 500) -> Column:
    """sensitive values of embedded URLs replaced, then cut with a count."""
    from leafmill.functions.urls import REDACTED, SENSITIVE

    named = F.regexp_replace(text, r"(https?://)[^/?#@\s]*@", f"$1{REDACTED}@")
    return truncate(F.regexp_replace(named, SENSITIVE.replace("[^&#]*", r"[^&#\s]*").replace("[^=&#]*", r"[^=&#\s]*"), f"$1{REDACTED}"), limit)


def fnv1a_hex(text: Column) -> Column:
    """32-bit FNV-1a over the code points, as fnv1a:%08x."""
    points = F.transform(F.filter(F.split(text, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF))
    value = F.aggregate(points, F.lit(0x811C9DC5).cast("long"), step)
    return F.concat(F.lit("fnv1a:"), F.lpad(F.lower(F.hex(value)), 8, "0"))


def html_text_length(html: Column) -> Column:
    """F22"""
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", ""), r"(?is)<style.*?</style>", "")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", ""), r"(?i)&nbsp;|&#160;", " ")
    return F.length(trim(t))


def preview(text: Column, n: int = 200) -> Column:
    """F26"""
    t = trim(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def percent(value: Column) -> Column:
    """Between 0 and 100, to one decimal; null for what is no number."""
    return F.when(F.isnan(value) | value.isNull(), None).otherwise(F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)) * 10 + 0.5) / 10)


def scroll_percent(top: Column, height: Column, viewport: Column) -> Column:
    """How far a block of a height has been scrolled past the viewport's lower edge."""
    room = height - viewport
    return percent(F.when(room <= 0, F.when(top <= 0, 100.0).otherwise(0.0)).otherwise(-top / room * 100))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """Seconds, or an HTTP date, as seconds from now; null for anything else."""
    plain = F.when(F.rlike(F.trim(value), F.lit("^[0-9]+$")), F.trim(value).try_cast("double"))
    stamp = F.try_to_timestamp(F.regexp_replace(value, r"^[A-Za-z]{3}, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))
    return F.coalesce(plain, F.greatest(F.lit(0.0), (F.unix_micros(stamp) - F.unix_micros(now)) / 1e6))
