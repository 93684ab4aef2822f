import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from leafmill.llm import bloom_lm


def brute(rows):
    """Base score and the model with exact membership in place of the filter."""

    def split(t):
        return [*((t or "").encode().lower().split()), b"\n"]

    out_of = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    train = [split(t) for (_, t), h in zip(rows, out_of, strict=True) if not h]
    uni = Counter(w for t in train for w in t)
    bi = Counter(p for t in train for p in zip([b"\n", *t], t, strict=False))
    n, v = sum(uni.values()), len(uni)
    mean = lambda c: 0.0 if not c else ((lo := 2 ** int(math.log2(c))) + 2 * lo - 1) / 2
    c2 = {k: mean(c) for k, c in bi.items()}
    c1 = {k: mean(c) for k, c in uni.items()}

    def likelihood(t, k, apart):
        total = 0.0
        for a, b in zip([b"\n", *t], t, strict=False):
            pair, here = c2.get((a, b), 0.0), c1.get(b, 0.0)
            ahead = max(c1.get(a, 0.0), pair, 1)
            if apart:
                total += math.log10(k * max(pair - 1, 0) / max(ahead - 1, 1) + (1 - k) * max(here, 1) / (n + v))
            else:
                total += math.log10(k * pair / ahead + (1 - k) * (here + 1) / (n + v + 1))
        return total

    best = max(bloom_lm.WEIGHTS.tolist(), key=lambda k: sum(likelihood(t, k, True) for t in train))
    out = []
    for (i, text), h in zip(rows, out_of, strict=True):
        t = split(text)
        base = sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t)
        out.append((i, h, len(t), sum(uni[w] > 0 for w in t), n, base, likelihood(t, best, False)))
    return sorted(out, key=str)


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{k}é" for k in range(200)]
    base = [" ".join(r.choice(words[: r.choice([5, 50, 200])]) for _ in range(r.randint(0, 60))) for _ in range(n)]
    return [(i, r.choice(base) if r.random() < 0.3 else t + r.choice(["", " Rare%d" % i])) for i, t in enumerate(base)]


ROWS = [*texts(1, 120), (500, None), (None, "a w1é"), (3, "W1É w2é"), (3, "W1É w2é"), (501, "long w3é text " * 20_000)]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "'a' as row", "2 as piece")
    return sorted((tuple(r) for r in bloom_lm.score_documents(df, **how).collect()), key=str)


@pytest.mark.parametrize(("head", "shard_bytes", "filter_bytes"), [(1 << 20, 1 << 20, 1 << 30), (7, 500, 1 << 30), (0, 3000, 0), (1 << 20, 1 << 30, 0)])
def test_equals_brute_force(spark, head, shard_bytes, filter_bytes):
    got = run(spark, ROWS, bits_per_entry=256, head=head, shard_bytes=shard_bytes, filter_bytes=filter_bytes)
    want = brute(ROWS)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_scores_do_not_depend_on_how_the_filter_is_asked(spark):
    broadcast = run(spark, ROWS, shard_bytes=2000)
    shuffled = run(spark, ROWS, shard_bytes=2000, filter_bytes=0, piece=500)
    assert [g[:5] for g in shuffled] == [w[:5] for w in broadcast]
    np.testing.assert_allclose([g[5:] for g in shuffled], [w[5:] for w in broadcast], rtol=1e-9)


@pytest.mark.parametrize("filter_bytes", [1 << 30, 0])
def test_empty_table(spark, filter_bytes):
    assert run(spark, [], filter_bytes=filter_bytes) == []


def test_all_ngrams_are_entered(spark):
    """The filter grows with the text, and holds what occurs once."""
    once = spark.createDataFrame([(k, " ".join(f"u{k}x{i}" for i in range(50))) for k in range(40)], "doc_id long, text string")
    counted = bloom_lm.count_ngrams(once, 2)
    n = {r.kind: r.n for r in bloom_lm._histogram(counted).collect() if r.level == 1}
    assert n == {bloom_lm.WORD: 2000, bloom_lm.PAIR: 51 * 40}
    part = bloom_lm.LevelFilter(np.zeros((4, 4000), np.uint8), 2)
    keys = np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64) << np.uint64(1)
    counts = np.random.default_rng(2).integers(1, 9, 3000)
    part.add(keys, bloom_lm.levels(counts))
    found = part.levels(keys)
    assert (found >= bloom_lm.levels(counts)).all()
    assert (found == bloom_lm.levels(counts)).mean() > 0.9
    assert part.levels(keys + np.uint64(1)).mean() < 0.1


def test_pieces_of_several_batches(spark, monkeypatch):
    """A piece of more rows than a batch is asked and scored as one (round 4, F1)."""
    want = run(spark, ROWS, shard_bytes=2000)
    whole = bloom_lm.materialize

    def narrow(df, name):
        out = whole(df, name)
        if name == "pieces":  # dealt from batches of many rows, read in batches of few
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        return out

    monkeypatch.setattr(bloom_lm, "materialize", narrow)
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    try:
        got = sorted((tuple(r) for r in bloom_lm.score_documents(docs, shard_bytes=2000, filter_bytes=0).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [g[:5] for g in got] == [w[:5] for w in want]
    np.testing.assert_allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_requests_are_fewer_than_shards(spark, monkeypatch):
    """What a piece or a batch sends does not dwindle to a row for each n-gram as shards grow in number (round 4, F1)."""
    text = " ".join(f"w{k}" for k in range(6000))
    docs = spark.createDataFrame([(2, text)], "doc_id long, text string")
    shard_bytes = len(text) // 3000  # 2^12 shards
    want = bloom_lm.score_documents(docs, shard_bytes=shard_bytes).collect()
    rows = {}
    whole = bloom_lm.materialize

    def counting(df, name):
        out = whole(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(bloom_lm, "materialize", counting)
    assert bloom_lm.score_documents(docs, shard_bytes=shard_bytes, filter_bytes=0).collect() == want
    assert rows["answers"] <= 2 << 10
    assert rows["ngrams"] <= 2 << 10
