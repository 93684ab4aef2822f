"""Site rules, preferences and paragraph filters (J-1, J-9, J1, J6, J7, J12, P18, X5)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions import text as T
from leafmill.functions import urls as U

MOST_LINES, MOST_GLOBAL, MOST_SCOPED, LONGEST = 1000, 20, 80, 256


def glob_pattern(glob: str) -> str:
    """A glob as an anchored pattern: * is any run of characters, ? any one."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def load_rules(rules: list[dict]) -> list[dict]:
    """J-1: rules with compiled patterns, in order; raises on doubled ids and on patterns that do not compile."""
    seen, out = set(), []
    for rule in rules:
        if not rule.get("id") or rule["id"] in seen:
            raise ValueError(f"rule without its own id: {rule}")
        seen.add(rule["id"])
        pattern = glob_pattern(rule["pattern"]) if rule.get("type") == "glob" else rule["pattern"]
        for p in (pattern, *rule.get("exclude", [])):
            re.compile(p)
        out.append({**rule, "pattern": pattern, "exclude": list(rule.get("exclude", []))})
    return out


def match_rule(pages: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds rule_id, the first rule whose pattern fits the url and none of whose excludes does.

    Rules are a few dozen, known on the driver; as literal patterns each is compiled once a task
    and evaluated in one pass, without a join."""
    fits = lambda p: F.rlike("url", F.lit(f"(?i){p}"))
    out = F.lit(None).cast("string")
    for rule in reversed(load_rules(rules)):
        hit = reduce(lambda a, x: a & ~fits(x), rule["exclude"], fits(rule["pattern"]))
        out = F.when(hit, F.lit(rule["id"])).otherwise(out)
    return pages.withColumn("rule_id", out)


def with_site_preference(pages: DataFrame, prefs: DataFrame) -> DataFrame:
    """Adds preference (boolean or null) by host name; prefs: hostname, enabled."""
    known = prefs.select(F.col("hostname").alias("host"), F.col("enabled").alias("preference"))
    return pages.withColumn("host", U.hostname(F.col("url"))).join(known, "host", "left").drop("host")


def upsert_preferences(prefs: DataFrame, actions: DataFrame) -> DataFrame:
    """The latest choice of each host; a deletion (enabled is null) removes it. Both: hostname, enabled, ts."""
    rows = prefs.unionByName(actions).groupBy("hostname").agg(F.max_by(F.struct("enabled", "ts"), "ts").alias("x"))
    return rows.select("hostname", "x.enabled", "x.ts").where("enabled is not null")


def compile_filters(text: str) -> tuple[list[tuple], list[tuple]]:
    """J-9: (scope, hostname, pattern, line) and (line, message) of the filters, one a line; a line
    that begins with ``@host=name `` holds for that host only."""
    filters, errors, per_scope = [], [], {}
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.strip()
        if not line:
            continue
        host = None
        if line.startswith("@host="):
            name, _, line = line[6:].partition(" ")
            host = name.strip().lower().removesuffix(".")
            if not host or re.search(r"[\s\\/?#@:]", host):
                errors.append((number, "host"))
                continue
        if number > MOST_LINES:
            errors.append((number, "too many lines"))
        elif not line.strip() or len(line) > LONGEST:
            errors.append((number, "length"))
        elif per_scope.get(host, 0) >= (MOST_SCOPED if host else MOST_GLOBAL):
            errors.append((number, "too many filters"))
        else:
            try:
                re.compile(line)
            except re.error:
                errors.append((number, "pattern"))
                continue
            per_scope[host] = per_scope.get(host, 0) + 1
            filters.append(("host" if host else "global", host, line.strip(), number))
    return filters, errors


def filter_paragraphs(paragraphs: DataFrame, filters: list[tuple]) -> DataFrame:
    """Paragraphs (host, text, …) that no global filter and none of their host fits.

    A thousand filters at most come from one settings text, so they are literal patterns."""
    text = T.collapse(F.col("text"))
    hit = F.lit(False)
    for scope, host, pattern, _ in filters:
        own = F.rlike(text, F.lit(f"(?iu){pattern}"))
        hit = hit | (own if scope == "global" else (F.col("host") == host) & own)
    return paragraphs.where(~F.coalesce(hit, F.lit(False)))


def coalesce_navigation(ruled: DataFrame, detected: DataFrame) -> DataFrame:
    """page_id, purpose, url: the rule's value where the rule defines the purpose (null: none),
    else what was detected. ruled: page_id, purpose, defined, url; detected: page_id, purpose, url."""
    rows = detected.withColumnRenamed("url", "found").join(ruled, ["page_id", "purpose"], "full")
    return rows.select("page_id", "purpose", F.when(F.coalesce("defined", F.lit(False)), F.col("url")).otherwise(F.col("found")).alias("url"))
