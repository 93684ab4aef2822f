"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from leafmill.llm import pfair_mix, quality_rules, url_terms

SQL: dict[str, str] = {}


def _terms(terms: list[str]) -> str:
    """One 0/1 per term that stands in t between characters other than letters and digits."""
    return " + ".join(f"cast(regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}]){x}($|[^\\p{{L}}\\p{{N}}])') as int)" for x in terms)


_CASES = sorted(url_terms.RULES, key=lambda r: -len(r[0] + r[1]))
_FITS = [(f"(host = '{h}' or suffix(host, '.{h}')) and prefix(path, '{p}')", h + p, v) for h, p, v in _CASES]

SQL["op3_url_filter"] = f"""
with a as (select page_id, regexp_replace(coalesce(url, ''), '(?s)^.*?://', '') as whole, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, whole, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{url_terms.UPPER}', '{url_terms.UPPER.lower()}') as host,
             regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) as path from a),
c as (select *, translate(coalesce(try(url_decode(whole)), whole), '{url_terms.UPPER}', '{url_terms.UPPER.lower()}') as t from b),
d as (select *, {_terms(url_terms.STRICT)} as n_strict, {_terms(url_terms.SOFT)} as n_soft from c)
select page_id, host, path,
       case {' '.join(f"when {f} then '{r}'" for f, r, _ in _FITS)} end as rule,
       case {' '.join(f"when {f} then '{v}'" for f, _, v in _FITS)} when n_strict > 0 or n_soft >= {url_terms.MIN_SOFT} then 'block' else 'allow' end as verdict,
       cast(n_strict as int) as n_strict, cast(n_soft as int) as n_soft
from d"""

SQL["op9_decontaminate"] = r"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
p as (select distinct item_id, least(10, len(w)) as n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') as pat
      from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
lens as (select distinct n from p),
dw as (select r, i, n, array_to_string(w[i : i + n - 1], ' ') as pat
       from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d, lens where len(w) >= n)),
m as (select dw.r, dw.i, dw.n, p.item_id from dw join p on dw.n = p.n and dw.pat = p.pat),
hit as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from m) group by r),
its as (select r, count(*) as n_items, sha256(string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar))) as h
        from (select distinct r, item_id from m) group by r)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, coalesce(its.h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on d.r = hit.r left join its on d.r = its.r"""

SQL["op4_minhash"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (
        select doc_id, unnest(case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) when len(w) = 1 then [w[1]] else [] end) as g from w)),
n as (select doc_id, count(*) as n from s group by 1),
h as (select doc_id, n, hash(list_sort(list(g))) as k from s join n using (doc_id) group by 1, 2),
c as (select k, n, min(doc_id) as rep from h group by 1, 2),
cs as (select s.doc_id, s.g from s where doc_id in (select rep from c)),
p as (select a.doc_id as u, b.doc_id as v, count(*) as x from cs a join cs b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select u, v from p join n nu on nu.doc_id = u join n nv on nv.doc_id = v where 100 * x >= 80 * (nu.n + nv.n - x)),
sym as (select u, v from e union all select v, u from e),
r(a, b) as (select rep, rep from c union select r.a, sym.v from r join sym on r.b = sym.u),
m as (select a, min(b) as low from r group by 1)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.low, w.doc_id) as component_id, w.doc_id = coalesce(m.low, w.doc_id) as kept
from w left join h using (doc_id) left join n using (doc_id) left join c on c.k = h.k and c.n = h.n left join m on m.a = c.rep"""

_SHARES = {"symbols": ("n_symbols", "word_chars"), "exclaims": ("n_exclaims", "word_chars"), "capitals": ("n_capitals", "word_chars"), "copied_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
_CUTS = ", ".join(map(str, quality_rules.CUTOFFS))
_RATE = quality_rules.ALPHA

SQL["op2_quality_rules"] = rf"""
with t as (select row_number() over () as r, doc_id, coalesce(lang, '') as lang, coalesce(text, '') as text from documents),
a as (select r, doc_id, lang, md5(text) as same, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
        length(text) - length(replace(text, '!', '')) as n_exclaims,
        length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_capitals,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars from t),
win as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from a)),
dup as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
rep as (select r, count(distinct j) as n from (select r, unnest([i, i + 1, i + 2]) as j from dup) group by r),
m as (select a.r, doc_id, lang, same, len(w) as n_words, word_chars, n_symbols, n_exclaims, n_capitals, len(lines) as n_lines, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words from a left join rep on a.r = rep.r),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, greatest({', '.join(f'(case when {of} > 0 then least({x} / {of}, 1.0) else 0 end) / {quality_rules.WORST[r]}' for r, (x, of) in _SHARES.items())}) as s from m),
clean as (select doc_id from labels group by doc_id having min(quality) = 1 and max(toxic) = 0),
held as (select distinct on (lang, same) * from f where not base_failed and doc_id in (select doc_id from clean)),
tests as (select lang, cutoff, n, k from (select lang, c.cutoff, count(*) as n, count(*) filter (s > c.cutoff) as k from held, (select unnest([{_CUTS}]) as cutoff) c group by all)),
p as (select lang, cutoff, n, case when k > {_RATE} * n then 1 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE})))) end as p from tests),
cuts as (select lang, min(cutoff) as cut from p where p <= {quality_rules.DELTA} / (select count(distinct lang) from tests) group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not coalesce(s > cut, false) as kept
from f left join cuts using (lang)"""


def mixed(rows: str, period: int = pfair_mix.PERIOD, block: int = pfair_mix.BLOCK, temperature: float = pfair_mix.TEMPERATURE) -> str:
    """CTEs that end in ``mixed`` (r, source, block, slot, place); rows: a relation with r, doc_id and source."""
    return rf"""
named as (select r, doc_id, coalesce(source, '') as source from {rows}),
cnt as (select source, count(*) as n from named group by 1),
x as (select source, round(({period} - count(*) over ()) * pow(cast(n as double), {temperature}) / sum(pow(cast(n as double), {temperature})) over (), 6) as exact from cnt),
y as (select *, floor(exact) as whole from x),
z as (select source, 1 + whole + case when row_number() over (order by whole - exact, source) <= {period} - count(*) over () - sum(whole) over () then 1 else 0 end as w from y),
src as (select list(source order by source) as names, list(cast(w as int) order by source) as ws from z),
plan(slot, done, c) as (
  select -1, list_transform(ws, lambda q: 0), {{'d': 0, 'i': 0, 'turn': 0}} from src where len(names) > 0
  union all
  select slot + 1, list_transform(done, lambda q, i: q + case when i = c.i then 1 else 0 end), c from (
    select slot, done, list_sort(list_filter(list_transform(done, lambda q, i: case when floor(q * {period} / ws[i]) <= slot + 1 then {{'d': cast(ceil((q + 1) * {period} / ws[i]) as int), 'i': cast(i as int), 'turn': q}} end), lambda e: e is not null))[1] as c
    from plan, src where slot < {period} - 1)),
slots as (select slot, names[c.i] as source, c.turn as turn from plan, src where slot >= 0),
ranked as (select r, source, row_number() over (partition by source order by cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint), doc_id) - 1 as k from named),
blocks as (select r, ranked.source, k // {block} as block, k % {block} as place, cast(z.w as bigint) as w from ranked join z using (source)),
mixed as (select r, blocks.source, block, (block // w) * {period} + slots.slot as slot, cast(place as int) as place from blocks join slots on slots.source = blocks.source and slots.turn = block % w)"""


SQL["op6_pfair_mix"] = f"""
with recursive t as (select row_number() over () as r, doc_id, source from documents), {mixed("t")}
select doc_id, t.source, block, cast(slot as bigint) as slot, place from mixed join t using (r)"""

_CRC = "xor(list_reduce(list_transform(range(1, length(s) + 1), lambda i: cast(ascii(s[i]) as bigint)), lambda crc, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, b)), 4294967295), 4294967295)"

SQL["op12_prefix_trie"] = f"""
with t as (select conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as x, row_number() over (partition by conv_id order by turn nulls first) as pos from conversations where conv_id is not null),
own as (select conv_id, list(x order by pos) as xs from t group by 1),
h as (select conv_id, xs, conv_id - conv_id % 5 as base, {_CRC} % 9 as h from (select *, cast(conv_id as varchar) as s from own)),
r as (select h.conv_id, list_concat(coalesce(b.xs, [])[1:h.h], h.xs[h.h + 1:]) as path from h left join own b on b.conv_id = h.base),
n as (select conv_id, path[1:d] as path, cast(d as bigint) as depth, d = len(path) as ends from (select conv_id, path, unnest(range(0, len(path) + 1)) as d from r)),
nodes as (select path, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (ends), '')) as ends_sha256 from n group by path, depth),
kids as (select path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1),
own_sums as (select nodes.path, depth, case when n_children is null then 1 else 0 end as leaf, case when depth > 0 then (n_convs - 1) * strlen(nodes.path[depth].text) else 0 end as saved from nodes left join kids on kids.path = nodes.path),
subs as (select path, sum(leaf) as n_leaves, sum(saved) as saved from (select path[1:d] as path, leaf, saved from (select path, leaf, saved, unnest(range(0, depth + 1)) as d from own_sums)) group by 1)
select nodes.conv_id, nodes.depth, up.conv_id as parent_conv_id, nodes.n_convs, coalesce(n_children, 0) as n_children, cast(n_leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, nodes.ends_sha256
from nodes join subs on subs.path = nodes.path left join kids on kids.path = nodes.path left join nodes up on nodes.depth > 0 and up.path = nodes.path[1:nodes.depth - 1]"""

SQL["op13_phrases"] = r"""
with p as (select row_number() over () as r, lang, w from (
         select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') as w from documents) where len(w) > 0),
n as (select lang, sum(len(w)) as n from p group by 1),
f as (select lang, k, phrase, count(*) as f from (
        select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (select unnest([1, 2, 3, 4]) as k) where len(w) >= k)) group by all having count(*) >= 30),
c as (select lang, k as size, phrase, string_split(phrase, ' ') as w, f as a from f where k > 1),
cut as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, cast(2000000 * cast(c.a as hugeint) // (x.f + y.f) as bigint) as score
        from (select lang, phrase, w, a, unnest(range(1, size)) as k from c) c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[:c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (select lang, array_to_string(w[i : i + m - 1], ' ') as phrase, max(a) as longer from (select *, unnest(range(1, size - m + 2)) as i from (select *, unnest(range(2, size)) as m from c)) group by all),
kept as (select best.* from best left join inner_ using (lang, phrase) where longer is null or 100 * cast(longer as hugeint) < 80 * cast(a as hugeint)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked join n using (lang) where rank <= 2000"""
