"""The semi-Markov model against enumeration of all segmentations, and very long texts."""

import math
import random
import time

import pytest

from leafmill.llm import span_crf as crf

TEXTS = ["tel +1 (454) 555", "a.b@c.de 1234", "key 12 34 56 78", "1.2.3.4 and 4539148803436468"]


def segmentations(lattice, j=None):
    """Every list of (first token, last token, kind, features) that a stretch's tokens allow."""
    j = len(lattice.segments) if j is None else j
    if not j:
        yield []
        return
    yield from segmentations(lattice, j - 1)
    for i, kind, seen in lattice.segments[j - 1]:
        for left in segmentations(lattice, i):
            yield [*left, (i, j - 1, kind, seen)]


def some_weights(lattice, r):
    return {(kind, f): r.uniform(-0.6, 0.6) for ends in lattice.segments for _, kind, seen in ends for f in seen}


@pytest.mark.parametrize("text", TEXTS)
def test_best_and_expected_equal_enumeration(text):
    r = random.Random(len(text))
    lattice = crf.Lattice(text, 0, len(text))
    weights = some_weights(lattice, r)
    worth = lambda parts: sum(weights.get((k, f), 0.0) for _, _, k, seen in parts for f in seen)
    every = list(segmentations(lattice))
    assert len(every) > 5
    best = max(every, key=worth)
    got = crf.best_segments(text, 0, len(text), weights)
    assert got == [(k, lattice.tokens[i][0], lattice.tokens[j][1]) for i, j, k, _ in best]
    total = sum(math.exp(worth(x)) for x in every)
    want = {}
    for x in every:
        for i, j, k, _ in x:
            want[i, j, k] = want.get((i, j, k), 0.0) + math.exp(worth(x)) / total
    keys = [(i, j, k) for j, ends in enumerate(lattice.segments) for i, k, _ in ends]
    found = dict(zip(keys, (p for p, _, _ in lattice.expected(weights)), strict=True))
    assert found == pytest.approx(want)


def test_segments_hold_no_more_digits_than_any_number():
    text = " ".join(str(100_000 + k) for k in range(40))
    lattice = crf.Lattice(text, 0, len(text))
    assert all(len(ends) <= 3 * len(crf.KINDS) for ends in lattice.segments)
    assert crf.Lattice("x " + "1" * 50, 0, 52).segments[1]


@pytest.mark.parametrize("kind", ["ips", "numbers", "lines", "digits", "parens", "one word"])
def test_a_megabyte_takes_seconds(kind):
    r = random.Random(3)
    number = lambda n: str(r.randrange(10**n))
    text = {
        "ips": lambda: "\n".join(".".join(str(r.randrange(256)) for _ in range(4)) for _ in range(70_000)),
        "numbers": lambda: " ".join(number(6) for _ in range(150_000)),
        "lines": lambda: "\n".join(number(9) for _ in range(100_000)),
        "digits": lambda: "1" * 1_000_000,
        "parens": lambda: "+1" + "((" * 500_000,
        "one word": lambda: "x" * 1_000_000 + "@a.b",
    }[kind]()
    weights = crf.fit([])
    began = time.process_time()
    base, _ = crf.find_spans(text, weights, {})
    assert time.process_time() - began < 40
    assert len(base) == {"ips": 70_000, "one word": 1}.get(kind, 0)


def test_model_looks_between_base_spans():
    weights = crf.fit([])
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1c"
    text = f"10.0.0.1 10.0.0.2 token {secret} 10.0.0.3 call 212-555-0133 please"
    base, spans = crf.find_spans(text, weights)
    assert [k for k, _, _ in base] == ["ip"] * 3
    found = {(k, text[a:b]) for k, a, b in spans}
    assert {("secret", secret), ("phone", "212-555-0133")} <= found


def test_training_reads_the_stretches_that_it_says(spark):
    text = " x ".join(f"call 212-555-{1000 + k} or mail m{k}@x.org" for k in range(60))
    docs = spark.createDataFrame([(k, text) for k in range(5)] + [(None, None)], "doc_id long, text string")
    assert crf.train(docs, sample=2, most_stretches=3)
