import hashlib
import random
import re
from collections import Counter

import pytest

from leafmill.llm import suffix_repeats


def repeated(texts, size):
    """For each text, a byte for each of its bytes: whether a repeated string covers it."""
    times = Counter(t[p : p + size] for _, t in texts for p in range(len(t) - size + 1))
    for _, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - size + 1):
            if times[t[p : p + size]] > 1:
                gone[p : p + size] = b"\1" * size
        yield gone


def brute(rows, size, passage=300, words=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, t), gone, shared in zip(texts, repeated(texts, size), repeated(texts, passage), strict=True):
        cuts = [m.span() for m in re.finditer(b"\1+", bytes(shared))]
        passages = sum(len(t[a:b].split()) > words for a, b in cuts)
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest(), passages))
    return sorted(out, key=str)


def run(spark, rows, size=400):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as site", "1 as n")
    return sorted((tuple(r) for r in suffix_repeats.remove_repeats(df, size).collect()), key=str)


def corpus(seed, n=40):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    prose = lambda k: " ".join(r.choice(words) for _ in range(k))
    shared = [prose(r.randint(60, 200)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(r.randint(0, 120)) for _ in range(3)]
        for _ in range(r.randint(0, 3)):
            s = r.choice(shared)
            a = r.randint(0, len(s) // 3)
            s = s[a : len(s) - r.randint(0, len(s) // 3)]
            if r.random() < 0.3:
                k = r.randint(0, len(s))
                s = s[:k] + "#" + s[k:]
            parts.insert(r.randint(0, len(parts)), s)
        rows.append((i, r.choice(["", " "]).join(parts)))
    return rows


@pytest.mark.parametrize("most", [256, 2])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(suffix_repeats, "MOST_SITES", most)
    rows = corpus(most)
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "a" * 1500), (104, "ab " * 400), (105, rows[3][1][:300])]
    rows += [(None, rows[5][1]), (7, rows[7][1]), (7, "other text " * 60), (106, rows[8][1] * 2)]
    assert run(spark, rows) == brute(rows, 400)


def test_slices_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_repeats, "SLICE", 700)
    rows = corpus(9, 12)
    assert run(spark, rows) == brute(rows, 400)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_maximal_repeats_lists_all_occurrences():
    texts = sorted([(b"KEYabcdX", b"zz1"), (b"KEYabcdY", b"zz2"), (b"KEYabceQ", b"zz3")])
    found = list(suffix_repeats.maximal_repeats([t for t, _ in texts], [p[::-1] for _, p in texts], 6))
    assert (0, 7, [0, 1]) in [(left, right, sorted(m)) for left, right, m in found]
    assert (0, 6, [0, 1, 2]) in [(left, right, sorted(m)) for left, right, m in found]


def test_passages_shorter_than_the_removed_strings(spark):
    r = random.Random(3)
    prose = lambda n: " ".join("".join(r.choice("abcde") for _ in range(5)) for _ in range(n))
    passage, shorter = prose(56), prose(50)  # 335 and 299 bytes
    rows = [(k, prose(80)) for k in range(20)]
    rows += [(100 + k, " ".join([prose(30), passage, prose(30)])) for k in range(3)]
    rows += [(200 + k, " ".join([prose(30), shorter, prose(30)])) for k in range(3)]
    got = {x[0]: x for x in run(spark, rows)}
    assert {i for i, x in got.items() if x[5]} == {100, 101, 102}
    assert not any(x[2] for x in got.values())
