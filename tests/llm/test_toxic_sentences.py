"""Multiple-instance toxicity: planted sentences, the noisy-or by hand, and odd rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from leafmill.llm import toxic_sentences

WORDS = [a + b for a in ("lan", "mer", "tov", "sil", "pra", "nok", "dul", "fis") for b in ("ta", "ren", "mo", "gil", "su", "bek")]
BAD = ["grobnik", "vermoft", "schlunz"]


def corpus(n: int, seed: int):
    """(texts, toxic): a toxic text holds one bad word, sometimes with another ending."""
    rng = random.Random(seed)
    texts, toxic = [], []
    for k in range(n):
        sentences = [" ".join(rng.choices(WORDS, k=rng.randint(3, 12))).capitalize() + "." for _ in range(rng.randint(1, 12))]
        if k % 4 == 0:
            at = rng.randrange(len(sentences))
            sentences[at] = sentences[at].replace(" ", f" {rng.choice(BAD)}{rng.choice(['', '', 'en'])} ", 1)
        texts.append(" ".join(sentences))
        toxic.append(k % 4 == 0)
    return texts, toxic


def test_held_out_accuracy_and_places():
    weights = toxic_sentences.fit(*corpus(800, 1))
    texts, toxic = corpus(400, 2)
    score, doc, begin, end, each = toxic_sentences.judge(pa.array(texts), weights)
    predicted = score >= toxic_sentences.CUTOFF
    assert (predicted == np.array(toxic)).mean() >= 0.99
    data = "".join(texts).encode()
    hits = [(d, data[b:e].decode()) for d, b, e, p in zip(doc, begin, end, each, strict=True) if p >= toxic_sentences.OFFENDING]
    assert all(toxic[d] and any(w in s for w in BAD) for d, s in hits)
    assert len({d for d, _ in hits}) >= 0.95 * sum(toxic)


def test_noisy_or_equals_plain_product():
    weights = toxic_sentences.fit(*corpus(400, 3))
    texts, _ = corpus(60, 4)
    texts += ["", None, "... !!", "grobnik " * 5000, "Ä" * 70000]
    score, doc, _, _, _ = toxic_sentences.judge(pa.array(texts, pa.string()), weights)
    for k, text in enumerate(texts):
        clean = 1.0
        _, own, _, _, each = toxic_sentences.judge(pa.array([text], pa.string()), weights)
        for p in each:
            clean *= 1 - p
        assert math.isclose(score[k], 1 - clean, abs_tol=1e-9)
        assert (doc == k).sum() == len(own)
    assert score[-5] == score[-4] == score[-3] == 0 and score[-2] > 0.99


def test_evidence_is_zero_for_words_of_clean_texts():
    g = toxic_sentences.evidence(np.array([2, 0, 1]), np.array([0, 2, 1]), 2, 2)
    assert g[0] == pytest.approx(2 * 4 * math.log(2)) and g[1] == g[2] == 0


def test_documents_of_every_kind(spark):
    texts, toxic = corpus(600, 5)
    odd = [(None, "grobnik vermoft", 0), (7000, None, 0), (7001, "", 0), (7002, "grobnik schlunz vermoft.", 0), (7002, "grobnik schlunz vermoft.", 0), (7003, "mermo " * 200000, 0)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + odd, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(t), 1) for i, t in enumerate(toxic)] + [(None, 1, 1), (5, None, 0), (99999, 1, 1), (1, 0, 0)], "doc_id long, toxic int, held_out int")
    rows = toxic_sentences.score_documents(docs, labels).collect()
    assert len(rows) == len(texts) + len(odd)
    assert set(rows[0].asDict()) == {"doc_id", "held_out", "score", "predicted", "n_sentences", "n_offending"}
    by = {}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        by.setdefault(r.doc_id, []).append(r)
    held = [by[i][0].predicted == int(t) for i, t in enumerate(toxic) if by[i][0].held_out]
    assert sum(held) >= 0.98 * len(held)
    assert by[7000][0].score == by[7001][0].score == 0 and by[7003][0].predicted == 0 and by[7003][0].n_sentences == 6250
    assert len(by[7002]) == 2 and by[7002][0].predicted == by[7002][1].predicted == 1 and by[None][0].predicted == 1
    found = toxic_sentences.locate(docs.where("doc_id < 600"), labels).collect()
    for r in found:
        assert texts[r.doc_id][r.begin : r.begin + r.length] == r.sentence and any(w in r.sentence.lower() for w in BAD)


def test_held_out_labels_teach_nothing(spark):
    texts, toxic = corpus(300, 6)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = list(enumerate(map(int, toxic)))
    turned = [(i, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, t in rows]
    a, b = (toxic_sentences.train(docs, spark.createDataFrame(r, "doc_id long, toxic int")) for r in (rows, turned))
    assert np.array_equal(a, b)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "grobnik lanta")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxic_sentences.score_documents(docs, none).collect()] == [(0.0, 0)]
    assert toxic_sentences.score_documents(docs.limit(0), none).count() == 0
