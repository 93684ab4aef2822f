"""URL filters: rules by host and path, then a weighted vocabulary counted by Aho-Corasick.

The most specific rule that fits decides. Where none fits, one automaton finds all terms of the
vocabulary in the whole url but its scheme: host, path, query and fragment, with percent escapes
decoded. A term counts only where no letter or digit, of any script, stands on either side. One
strict term blocks, as do two or more distinct soft terms.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; a
null url is allowed, the other is searched from its start; escapes that are no hexadecimal number
stay as they are, as do all escapes of a url that do not decode to UTF-8; only A-Z are lower-cased;
repeated rows give repeated results; further columns stay out of the result.
"""

from __future__ import annotations

from urllib.parse import unquote_to_bytes

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed rules (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
STRICT = ["adult", "casino", "escort", "hentai", "porn", "spam-farm", "xxx"]
SOFT = ["ads", "bet", "bets", "bonus", "cheap", "farm", "free", "pills", "poker", "sex", "spam", "track", "viagra", "win"]
MIN_SOFT = 2

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (then up to ``?`` or ``#``)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


_LOWER = str.maketrans(UPPER, UPPER.lower())


def _searched(rest: str) -> str:
    try:
        return unquote_to_bytes(rest).decode().translate(_LOWER)
    except UnicodeDecodeError:
        return rest.translate(_LOWER)


def _count(automaton, text: str) -> tuple[int, int]:
    """(strict terms, distinct soft terms) with a boundary on both sides."""
    strict, soft = 0, set()
    for end, (term, is_strict) in automaton.iter(text):
        begin = end - len(term) + 1
        if (begin == 0 or not text[begin - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
            if is_strict:
                strict += 1
            else:
                soft.add(term)
    return strict, len(soft)


def term_counts(urls: DataFrame, strict: list[str], soft: list[str]) -> DataFrame:
    """urls (…, rest: the url without its scheme) with n_strict and n_soft."""
    terms = [(t.lower(), True) for t in strict] + [(t.lower(), False) for t in soft if t not in strict]

    def count(batches):
        automaton = ahocorasick.Automaton()
        for term, is_strict in terms:
            automaton.add_word(term, (term, is_strict))
        automaton.make_automaton()
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [_count(automaton, _searched(u)) for u in batch.column("rest").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32())], names=[*batch.schema.names, "n_strict", "n_soft"])

    from pyspark.sql.types import IntegerType, StructType

    schema = StructType([*urls.schema.fields]).add("n_strict", IntegerType()).add("n_soft", IntegerType())
    return urls.mapInArrow(count, schema) if terms else urls.withColumns({"n_strict": F.lit(0), "n_soft": F.lit(0)})


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, strict: list[str] = STRICT, soft: list[str] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, n_strict, n_soft."""
    host, path = host_and_path(F.col("url"))
    rest = F.regexp_replace(F.coalesce("url", F.lit("")), r"(?s)^.*?://", "")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    counted = term_counts(parts, strict, soft)
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # a longer rule overrides
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    method = F.when((F.col("n_strict") > 0) | (F.col("n_soft") >= min_soft), "block").otherwise("allow")
    return counted.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "n_strict", "n_soft")
