"""Quality rules whose cutoffs are chosen with a risk guarantee, in DataFrame operations only.

Each rule scores a document by a share between 0 (clean) and 1; the shares are put on one scale by
the share that is as bad as can be (WORST). Labelled clean documents are the holdout. Rules are
certified together, along a fixed sequence of joint cutoffs: at the cutoff c, all rules of a
stratum (language) turn away what scores over c * WORST. A joint cutoff is certified when the exact
binomial test rejects that it turns away more than ALPHA of the clean documents of the stratum:
P(Bin(n, ALPHA) <= k) must be at most DELTA / strata. That is Bonferroni's correction over strata;
the cutoffs of a stratum are tested from the highest down to the first that fails (what a lower one
turns away contains what a higher one does), which needs no further share of DELTA, and as rules
share their cutoff, neither does their number. With probability 1 - DELTA, at most ALPHA of the
clean documents of each stratum are turned away. The lowest certified cutoff is used; without one
the rules are silent. Four strata need 174 clean labels each, or more, to certify any cutoff.

Defined cases: a null text has no words and fails; a null language is a stratum of its own; strata
without labels have no cutoffs; a document with several labels counts as clean only if all say so;
copies are no independent trials, so each text counts once in a stratum's holdout, however often it
is repeated; further columns are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.tables import materialize

ALPHA, DELTA = 0.025, 0.05
#: Rules, and the shares at which a document is as bad as it can be.
WORST = {"symbols": 0.25, "exclaims": 0.25, "capitals": 1.0, "copied_lines": 1.0, "repeats": 1.0}
#: The fixed sequence of joint cutoffs, in shares of WORST.
CUTOFFS = [0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.22, 0.26, 0.3, 0.35, 0.4, 0.5, 0.6, 0.8]
SPACE = r"[\x20\x09-\x0D]+"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _without(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated_words(hashes: Column, order: Column) -> Column:
    """Words inside 3-word windows that occur twice or more.

    hashes: of the windows, in order; order: the same as (hash, position), sorted."""
    twice = F.filter(order, lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"]))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda a, i: F.struct((a["total"] + i + 3 - F.greatest(i, a["end"])).alias("total"), (i + 3).alias("end")),
        lambda a: a["total"].cast("long"),
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, same (a hash of the text), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and
    badness: the worst of the rules' scores."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), text.alias("text"))
    words = F.array_remove(F.split("text", SPACE), "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    rows = rows.select(
        "doc_id",
        "lang",
        F.xxhash64("text").alias("same"),
        words.alias("words"),
        lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _without(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("text"), "!").alias("n_exclaims"),
        _without(F.col("text"), CAPITALS).alias("n_capitals"),
    )
    n = F.size("words")
    windows = F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select("doc_id", "lang", "same", "word_chars", "n_symbols", "n_exclaims", "n_capitals", n.cast("long").alias("n_words"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("hashes"))
    order = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.array_sort(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("order", order)
    rows = rows.withColumn("n_repeat_words", _repeated_words(F.col("hashes"), F.col("order"))).drop("hashes", "order")
    share = lambda x, of: F.when(F.col(of) > 0, F.least(F.col(x) / F.col(of), F.lit(1.0))).otherwise(F.lit(0.0))
    scores = {"symbols": share("n_symbols", "word_chars"), "exclaims": share("n_exclaims", "word_chars"), "capitals": share("n_capitals", "word_chars"), "copied_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words")}
    badness = F.greatest(*(scores[r] / worst for r, worst in WORST.items()))
    return rows.select("doc_id", "lang", "same", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", badness.alias("badness"))


def binomial_tail(n: Column, k: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), exactly, term by term in logarithms; 1 where k > rate * n."""
    odds = math.log(rate / (1 - rate))
    total = F.aggregate(
        F.sequence(F.lit(0), k.cast("int")),
        F.struct((n * math.log(1 - rate)).alias("log"), F.lit(0.0).alias("sum")),
        lambda a, i: F.struct((a["log"] + F.log(n - i) - F.log(i + F.lit(1.0)) + odds).alias("log"), (a["sum"] + F.exp(a["log"])).alias("sum")),
        lambda a: a["sum"],
    )
    return F.when(k > rate * n, F.lit(1.0)).otherwise(total)


def certified_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """lang, n (different clean texts) and cutoff: the lowest certified joint cutoff or null."""
    clean = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality = 1 and toxic = 0").select("doc_id")
    held = measured.where(~base_failed()).join(clean, "doc_id", "left_semi").dropDuplicates(["lang", "same"])
    passed = sum((F.col("badness") > c).cast("int") for c in CUTOFFS)
    counts = held.groupBy("lang", passed.alias("passed")).agg(F.count(F.lit(1)).alias("rows"))
    turned = [F.struct(F.lit(c).alias("cutoff"), F.sum(F.when(F.col("passed") > g, F.col("rows")).otherwise(0)).alias("k")) for g, c in enumerate(CUTOFFS)]
    strata = materialize(counts.groupBy("lang").agg(F.sum("rows").alias("n"), F.array(*turned).alias("tests")), "tests")  # a row for each stratum
    most = delta / max(1, strata.count())
    tests = strata.select("lang", "n", F.explode("tests").alias("x")).select("lang", "n", "x.*")
    fits = binomial_tail(F.col("n"), F.col("k"), alpha) <= most
    return tests.withColumn("fits", fits).groupBy("lang", "n").agg(F.min(F.when(F.col("fits"), F.col("cutoff"))).alias("cutoff"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept."""
    measured = materialize(measures(docs), "measures")
    cutoffs = certified_cutoffs(measured, labels, alpha, delta)
    turned = F.coalesce(F.col("badness") > F.col("cutoff"), F.lit(False))
    out = measured.join(cutoffs, "lang", "left").withColumn("base_failed", base_failed())
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~turned).alias("kept"))
