"""Selectors as a table (J2), and the text of whole subtrees by offsets.

A selector list is compiled to rows, one for each compound of each alternative, and joined to the
nodes on one key of the compound (its id, class, attribute or tag). What else the compound asks for
is a residual condition, ancestors are found by running maxima over document order, and ``:contains``
looks into a slice of the page's text: nothing is joined on ranges. Where compounds are chained or
texts are asked for, the nodes that fit a compound are written to the shared folder first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.tables import materialize

#: Rows of the selector table, which is broadcast.
MOST_COMPOUNDS = 100_000
COMPOUNDS = "rule string, sel int, alt int, step int, steps int, link string, key string, tag string, id string, classes array<string>, attrs array<struct<name: string, op: string, value: string>>, needles array<string>, place int"
_COMPOUND = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)?(?P<rest>(?:\#[\w-]+|\.[\w-]+|\[\s*[\w:-]+\s*(?:[*^$~|]?=\s*(?:"[^"]*"|'[^']*'|[^\]"']*))?\s*\])*)""")
_PART = re.compile(r"""\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<raw>[^\]"']*?)))?\s*\]""")
_CONTAINS = re.compile(r"""(?s)^(.*):contains\((['"]?)(.*?)\2\)$""")
_PLACE = re.compile(r"^(.*):(?:(first|last)(?:\(\))?|eq\((-?\d+)\))$")


def split_list(selector: str) -> list[str]:
    """Alternatives of a selector list: commas in quotes, brackets or parentheses do not split."""
    out, depth, quote, now = [], 0, "", ""
    for c in selector:
        quote = "" if quote == c else quote or (c if c in "\"'" else "")
        depth += 0 if quote else (c in "([") - (c in ")]")
        if c == "," and not quote and depth == 0:
            out.append(now)
            now = ""
        else:
            now += c
    return [s.strip() for s in [*out, now] if s.strip()]


def compile_alternative(selector: str) -> tuple[list[tuple], list[str], int | None]:
    """(compounds, needles, place) of one alternative.

    compounds: (link to the one before: "" | " " | ">", tag, id, classes, attrs). needles: the texts
    of :contains. place: n for :eq(n) (from the end if negative), 0 for :first, -1 for :last."""
    rest, place, needles = selector.strip(), None, []
    if m := _PLACE.match(rest):
        rest, place = m[1], {"first": 0, "last": -1}[m[2]] if m[2] else int(m[3])
    while m := _CONTAINS.match(rest):
        needles.insert(0, m[3])
        rest = m[1]
    rest = rest.strip() or "*"
    compounds, at, link = [], 0, ""
    while at < len(rest):
        m = _COMPOUND.match(rest, at)
        if m.end() == at:
            raise ValueError(f"selector is not supported: {selector!r}")
        parts = list(_PART.finditer(m["rest"]))
        ids = {p["id"] for p in parts if p["id"]}
        attrs = [(p["attr"].lower(), p["op"] or "", next((x for x in (p["dq"], p["sq"], p["raw"]) if x is not None), "")) for p in parts if p["attr"]]
        if len(ids) > 1:
            raise ValueError(f"selector is not supported: {selector!r}")
        compounds.append((link, None if m["tag"] in (None, "*") else m["tag"].lower(), next(iter(ids), None), sorted({p["cls"] for p in parts if p["cls"]}), attrs))
        at = m.end()
        gap = re.compile(r"\s*>\s*|\s+").match(rest, at)
        link = "" if not gap else ">" if ">" in gap[0] else " "
        if at < len(rest) and not gap:
            raise ValueError(f"selector is not supported: {selector!r}")
        at = gap.end() if gap else at
    return compounds, needles, place


def compile_selectors(selectors: list[tuple[str | None, str]]) -> list[tuple]:
    """Rows of COMPOUNDS for (rule, selector list); rule None fits every page."""
    out = []
    for sel, (rule, text) in enumerate(selectors):
        for alt, one in enumerate(split_list(text)):
            compounds, needles, place = compile_alternative(one)
            for step, (link, tag, own_id, classes, attrs) in enumerate(compounds):
                key = f"id:{own_id}" if own_id else f"class:{classes[0]}" if classes else f"attr:{attrs[0][0]}" if attrs else f"tag:{tag}" if tag else "*"
                last = step + 1 == len(compounds)
                out.append((rule, sel, alt, step, len(compounds), link, key, tag, own_id, classes, attrs, needles if last else [], place if last else None))
    if len(out) > MOST_COMPOUNDS:
        raise ValueError(f"more than {MOST_COMPOUNDS} compounds")
    return out


def _fits(attrs: Column, wanted: Column) -> Column:
    def one(c: Column) -> Column:
        have = F.try_element_at(attrs, c["name"])
        tests = {"": F.lit(True), "=": have == c["value"], "*=": F.contains(have, c["value"]), "^=": F.startswith(have, c["value"]), "$=": F.endswith(have, c["value"]), "~=": F.array_contains(F.split(have, r"\s+"), c["value"]), "|=": (have == c["value"]) | F.startswith(have, F.concat(c["value"], F.lit("-")))}
        test = F.lit(None).cast("boolean")
        for op, t in tests.items():
            test = F.when(c["op"] == op, t).otherwise(test)
        # an empty value fits nothing where a part is asked for
        return have.isNotNull() & test & ~(c["op"].isin("*=", "^=", "$=") & (c["value"] == ""))

    return F.forall(wanted, lambda c: F.coalesce(one(c), F.lit(False)))


def select_nodes(nodes: DataFrame, selectors: list[str] | list[tuple[str | None, str]], every: bool = False) -> DataFrame:
    """Nodes that a selector picks, with sel (its number) and alt (the alternative's).

    selectors: lists as text, or (rule, text) where nodes have a column ``rule_id`` and only pages of
    that rule are looked at. Of a list, the first alternative that hits in a page counts, or with
    ``every`` all of them."""
    pairs = [s if isinstance(s, tuple) else (None, s) for s in selectors]
    rows = compile_selectors(pairs)
    if not rows:
        return nodes.withColumns({"sel": F.lit(0), "alt": F.lit(0)}).limit(0)
    of = F.broadcast(nodes.sparkSession.createDataFrame(rows, COMPOUNDS))
    table = of.select(*(F.col(c).alias(f"s_{c}") for c in of.columns))
    keys = F.concat(F.array(F.lit("*"), F.concat(F.lit("tag:"), "tag"), F.concat(F.lit("id:"), "id")), F.transform("classes", lambda c: F.concat(F.lit("class:"), c)), F.transform(F.map_keys("attrs"), lambda k: F.concat(F.lit("attr:"), k)))
    wanted = sorted({r[6] for r in rows})
    keys = F.array_intersect(keys, F.array(*map(F.lit, wanted))) if len(wanted) <= 500 else F.array_distinct(keys)
    each = nodes.where("kind = 'element'").withColumn("s_key", F.explode(keys))
    hits = each.join(table, "s_key")
    fits = [F.col("s_tag").isNull() | (F.col("tag") == F.col("s_tag")), F.col("s_id").isNull() | (F.col("id") == F.col("s_id")), F.size(F.array_except("s_classes", "classes")) == 0, _fits(F.col("attrs"), F.col("s_attrs"))]
    if any(r is not None for r, _ in pairs):
        fits.append(F.col("s_rule").isNull() | (F.col("s_rule") == F.col("rule_id")))
    for f in fits:
        hits = hits.where(f)
    hits = hits.select(*nodes.columns, F.col("s_sel").alias("sel"), F.col("s_alt").alias("alt"), *(f"s_{c}" for c in ("step", "steps", "link", "needles", "place")))
    longest = max(r[4] for r in rows)
    if longest > 1 or any(r[11] for r in rows):  # what is read several times from here on
        hits = materialize(hits, "hits")
    found = hits.where("s_steps = 1")
    if longest > 1:
        above = hits.where("s_step = 0 and s_steps > 1")
        for step in range(1, longest):
            below = _below(above, hits.where(F.col("s_step") == step))
            found = found.unionByName(below.where("s_step = s_steps - 1"))
            above = below
    if any(r[11] for r in rows):
        with_text = subtree_texts(nodes, found.where("size(s_needles) > 0").select("page_id", "pos", "end_pos").distinct())
        found = found.join(with_text, ["page_id", "pos"], "left").where(F.forall("s_needles", lambda n: F.contains(F.coalesce("subtree_text", F.lit("")), n))).drop("subtree_text")
    if any(r[12] is not None for r in rows):
        w = Window.partitionBy("page_id", "sel", "alt")
        found = found.withColumns({"k": F.row_number().over(w.orderBy("pos")) - 1, "n": F.count(F.lit(1)).over(w)})
        found = found.where("s_place is null or k = s_place or (s_place < 0 and k = n + s_place)").drop("k", "n")
    found = found.drop(*(f"s_{c}" for c in ("step", "steps", "link", "needles", "place")))
    if every or all(r[2] == 0 for r in rows):
        return found
    first = F.min("alt").over(Window.partitionBy("page_id", "sel"))
    return found.withColumn("first", first).where("alt = first").drop("first")


def _below(above: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates inside (link " ") or right below (link ">") what is matched so far.

    Elements nest, so a node is inside one of those before it if the farthest of their ends is not
    before the node."""
    same = ["page_id", "sel", "alt"]
    children = candidates.where("s_link = '>'").join(above.select(*same, F.col("pos").alias("parent_pos")).distinct(), [*same, "parent_pos"], "left_semi")
    both = candidates.where("s_link = ' '").withColumn("end", F.lit(None).cast("int")).unionByName(above.withColumn("end", F.col("end_pos")))
    before = Window.partitionBy(*same).orderBy("pos", F.asc_nulls_first("end")).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("farthest", F.max("end").over(before)).where("end is null and farthest >= pos").drop("end", "farthest")
    return children.unionByName(inside)


def subtree_spans(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, pos, text_off, text_len) of elements (page_id, pos, end_pos): where the texts of
    their subtrees stand in the page's text (page_texts).

    One running sum over the beginnings, ends and texts of a page; nodes may have been removed."""
    texts = nodes.where("kind = 'text'").select("page_id", F.col("pos").alias("at"), F.lit(1).alias("what"), F.length("text").alias("size"), F.lit(None).cast("int").alias("pos"))
    begins = elements.select("page_id", F.col("pos").alias("at"), F.lit(0).alias("what"), F.lit(0).alias("size"), "pos")
    ends = elements.select("page_id", F.col("end_pos").alias("at"), F.lit(2).alias("what"), F.lit(0).alias("size"), "pos")
    w = Window.partitionBy("page_id").orderBy("at", "what").rowsBetween(Window.unboundedPreceding, 0)
    rows = texts.unionByName(begins).unionByName(ends).withColumn("so_far", F.sum("size").over(w)).where("pos is not null")
    return rows.groupBy("page_id", "pos").agg(F.min("so_far").alias("text_off"), (F.max("so_far") - F.min("so_far")).alias("text_len"))


def page_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, page_text): all text of a page in document order."""
    found = nodes.where("kind = 'text'").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("x"))
    return found.select("page_id", F.array_join(F.col("x.text"), "").alias("page_text"))


def subtree_texts(nodes: DataFrame, elements: DataFrame, most: int | None = None) -> DataFrame:
    """(page_id, pos, subtree_text) of elements (page_id, pos, end_pos), of ``most`` characters at
    most if that is given: a page's text is cut once for all of its elements."""
    spans = subtree_spans(nodes, elements)
    spans = spans if most is None else spans.where(F.col("text_len") <= most)
    per = spans.groupBy("page_id").agg(F.collect_list(F.struct("pos", "text_off", "text_len")).alias("spans"))
    cut = F.explode(F.transform("spans", lambda s: F.struct(s["pos"].alias("pos"), F.substr(F.coalesce("page_text", F.lit("")), (s["text_off"] + 1).cast("int"), s["text_len"].cast("int")).alias("subtree_text"))))
    return per.join(page_texts(nodes), "page_id", "left").select("page_id", cut.alias("x")).select("page_id", "x.*")
