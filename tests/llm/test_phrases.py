"""Phrase mining against plain counting, with failures of the sample, and odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import phrases

SCHEMA = "doc_id long, text string, lang string, rank int, a int"


def plain(rows, support: int, top: int) -> list:
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    cands = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= support}
    out = {}
    for (lang, w), a in cands.items():
        if any(100 * b >= 80 * a for (l2, v), b in cands.items() if l2 == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))):
            continue
        s, k = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for lang, c in out.items() for i, (s, a, p, left, r) in enumerate(sorted(c)[:top]))


def corpus(seed: int) -> list:
    rng = random.Random(seed)
    words = ["the", "a", "Über", "x1", "new", "york", "city", "hall", "of", "b"]
    rows = []
    for i in range(120):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        w = [x + rng.choice(["", "", "", "", ",", ".", "\n", "\t"]) for x in w]
        rows.append((i, " ".join(w), rng.choice(["en", "EN", None, ""]), 0, 0))
    # a phrase of four words whose parts are rare: the sample misses it, or finds it only in parts
    rows += [(1000 + i, "quite rarely seen words", "en", 0, 0) for i in range(9)]
    return rows + [(None, None, "en", 0, 0), (None, "", None, 0, 0), (None, "new york city hall " * 40, None, 0, 0), (7, "new york city hall", "en", 0, 0), (7, "new york city hall", "en", 0, 0)]


def found(df, **options) -> list:
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


@pytest.mark.parametrize(("seed", "share"), [(1, 4), (2, 50)])
def test_equals_plain_counting(spark, seed, share):
    """With share 50 hardly a document is in the sample, so further passes must close the set."""
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(df, support=8, top=25, share=share) == plain(rows, 8, 25)


def test_failures_are_closed_in_further_passes(spark):
    df = spark.createDataFrame(corpus(3), SCHEMA)
    texts = df.selectExpr("text", "coalesce(lang, 'und') as lang", "cast(1 as long) as dealt")  # none in the sample
    counts, passes = phrases.frequent(texts, 8, 7)
    assert passes > 1
    every, _ = phrases.frequent(texts.withColumn("dealt", texts.dealt * 0), 8, 7)
    assert sorted((r.key, r.n) for r in counts.collect()) == sorted((r.key, r.n) for r in every.collect())


def test_small_filter_gives_equal_results(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 64)
    monkeypatch.setattr(phrases, "FILTER_BYTES", 8)
    monkeypatch.setattr(phrases, "FLUSH", 50)
    rows = corpus(4)
    assert found(spark.createDataFrame(rows, SCHEMA), support=8, top=2000) == plain(rows, 8, 2000)


def test_filter_holds_all_keys(spark):
    keys = spark.range(20000).selectExpr("xxhash64(id) as key")
    held = phrases.make_filter(keys)
    mine = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    assert held.contains(mine).all()
    assert held.contains(mine + np.uint64(1)).mean() < 0.02


def test_long_texts_are_cut_behind_marks():
    text = "one two three. four five\n" * 30 + "six " * 200
    batch = pa.record_batch({"text": [text, "Ü"], "lang": ["en", "en"], "dealt": [1, 2]})
    parts = list(phrases._parts(batch, 40))
    assert "".join(x for p in parts for x in p.column("text").to_pylist()) == text + "Ü"
    assert len(parts) > 10 and all(p.column("text")[0].as_py()[-1] in ".\n Ü" for p in parts)


def test_empty_table_and_no_frequent_phrase(spark):
    df = spark.createDataFrame([(1, "alone here", "en", 0, 0)], SCHEMA)
    assert found(df) == [] and found(df.limit(0)) == []
