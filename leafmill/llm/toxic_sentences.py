"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag is labelled. A sentence (at most LONGEST words of
one) is described by the hashed words that stand in it and by their hashed stems; a linear score
gives its probability of being toxic, and a noisy-or joins the sentences: a document is clean if all
of its sentences are. The weights maximise the likelihood of the document labels, so the sentences
that make a document toxic are found by the model itself and can be shown (``locate``).

Training takes a bounded sample of the labelled documents (``sample`` = SAMPLE toxic and twice as
many others, of at most SAMPLE_BYTES bytes each, by hash); every whole text is scored.

Defined cases: a null or empty text, or one without words, has no sentence and scores 0; a document
with several labels is toxic if one of them says so, labels without a document are left out, and a
missing or null label teaches nothing; without toxic or without clean labels every score is 0;
repeated rows are scored as often as they occur and teach once; a null doc_id is not held out and
has no label; further columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import bytewords
from leafmill.tables import materialize

SAMPLE, SAMPLE_BYTES = 2000, 1 << 14
CUTOFF = 0.3
BINS = 1 << 20
#: Words of a sentence that count as one instance, and lengths in bytes of the stems of longer words.
LONGEST = 32
STEMS = range(3, 10)
#: Score of a sentence in which nothing speaks for or against: 6e-6, so that long texts stay clean.
FLOOR = -12.0
#: How surely a feature must stand in toxic documents more often than in others (likelihood ratio, chi
#: square with one degree of freedom: by chance, one word of fifty thousand does).
EVIDENCE = 18.0
ENDS = b".!?\n"
OFFENDING = 0.5


def sentences(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each word or stem, its instance), document of each instance, and where instances
    begin and end in the column's bytes."""
    data, offsets = bytewords.column_bytes(column)
    words = bytewords.split_words(column, bytewords.NON_ALNUM)
    begin, end = bytewords.word_places(data, offsets, bytewords.NON_ALNUM)
    owner = words.documents()
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none.astype(np.int32), none, none, none, none
    table = np.zeros(256, bool)
    table[list(ENDS)] = True
    sentence = np.searchsorted(np.flatnonzero(table[data]), begin)
    new = np.ones(len(begin), bool)
    new[1:] = (sentence[1:] != sentence[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    within = np.arange(len(begin)) - np.repeat(first, np.diff(np.append(first, len(begin))))
    new |= within % LONGEST == 0
    instance = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    features, at = [words.hashes], [instance]
    hashes = bytewords.stem_hashes(data, begin, end, STEMS)
    for length, h in zip(STEMS, hashes, strict=True):
        longer = end - begin > length
        features.append(h[longer] + np.uint64(length))
        at.append(instance[longer])
    feature = (bytewords.mix(np.concatenate(features)) >> np.uint64(44)).astype(np.int32)
    return feature, np.concatenate(at), owner[starts], begin[starts], end[np.append(starts[1:], len(begin)) - 1]


def _distinct(feature: np.ndarray, instance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once in an instance, by instance."""
    both = np.unique(instance.astype(np.uint64) << np.uint64(20) | feature.astype(np.uint64))
    return (both & np.uint64(BINS - 1)).astype(np.int32), (both >> np.uint64(20)).astype(np.int64)


def hazards(logits: np.ndarray) -> np.ndarray:
    """-log(1 - p) of each instance."""
    return np.logaddexp(0.0, logits)


def evidence(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Of each feature, in bad of n_bad toxic and good of n_good other documents, the likelihood
    ratio statistic of being more frequent in toxic ones; 0 if it is not."""
    rate = (bad + good) / (n_bad + n_good)

    def part(k, n, p):
        return k * np.log(np.where(k > 0, k, 1) / np.maximum(n * p, 1e-300))

    g = part(bad, n_bad, rate) + part(n_bad - bad, n_bad, 1 - rate) + part(good, n_good, rate) + part(n_good - good, n_good, 1 - rate)
    return np.where(bad * n_good > good * n_bad, 2 * g, 0.0)


def fit(texts: list[str], toxic: list[bool], rounds: int = 400, decay: float = 2e-4, rate: float = 0.1) -> np.ndarray | None:
    """Weights of the features; None if the labels are all of one kind.

    Minimises the mean of -log P(label), both kinds with half of the weight, plus decay times the
    weights' squares, by gradient steps with momentum scaled to each feature (Adam)."""
    y = np.array(toxic, bool)
    if not y.any() or y.all():
        return None

    def parts():
        for lo in range(0, len(texts), 128):
            feature, instance, doc, _, _ = sentences(pa.array(texts[lo : lo + 128], pa.string()))
            yield lo, *_distinct(feature, instance), doc

    counts = np.zeros((2, BINS), np.int64)
    for lo, feature, instance, doc in parts():
        name, owner = _distinct(feature, doc[instance])
        for side in (0, 1):
            counts[side] += np.bincount(name[y[lo + owner] == side], minlength=BINS)
    chosen = evidence(counts[1], counts[0], y.sum(), (~y).sum()) >= EVIDENCE
    columns, places, docs, n_sentences, seen = [], [], [], [], 0
    for lo, feature, instance, doc in parts():
        held = chosen[feature]
        some, place = np.unique(instance[held], return_inverse=True)
        columns.append(feature[held])
        places.append(place + seen)
        docs.append(doc[some] + lo)
        n_sentences.append(np.bincount(doc, minlength=min(128, len(texts) - lo)))
        seen += len(some)
    names, column = np.unique(np.concatenate(columns), return_inverse=True)
    place, doc, n_docs, n = np.concatenate(places), np.concatenate(docs), len(y), len(names)
    empty = np.concatenate(n_sentences) - np.bincount(doc, minlength=n_docs)
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    w, m, v = np.full(n, -FLOOR / 2), np.zeros(n), np.zeros(n)
    for step in range(1, rounds + 1):
        z = np.bincount(place, w[column], minlength=len(doc)) + FLOOR
        total = np.bincount(doc, hazards(z), minlength=n_docs) + empty * hazards(np.array(FLOOR))
        pull = np.where(y, -1 / np.expm1(np.clip(total, 1e-12, 500)), 1.0) * share
        slope = pull[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.bincount(column, slope[place], minlength=n) + 2 * decay * w / n_docs
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = np.zeros(BINS, np.float32)
    weights[names] = w
    return weights


def judge(column: pa.Array, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Score of each document, then document, begin, end and probability of each sentence."""
    feature, instance, doc, begin, end = sentences(column)
    if weights is None or not len(doc):
        return np.zeros(len(column)), doc, begin, end, np.zeros(len(doc))
    feature, instance = _distinct(feature, instance)
    z = np.bincount(instance, weights[feature], minlength=len(doc)) + FLOOR
    total = np.bincount(doc, hazards(z), minlength=len(column))
    return -np.expm1(-total), doc, begin, end, 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> np.ndarray | None:
    """Weights from labelled documents that are not held out."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")).where(~held_out(F.col("doc_id")))
    rows = docs.where(F.octet_length("text").between(1, sample_bytes)).select("doc_id", F.xxhash64("doc_id", "text").alias("k"))
    rows = materialize(rows.join(marked, "doc_id").select("k", "toxic").distinct(), "labelled")
    chosen = [rows.where(side).orderBy("k").limit(most) for side, most in ((F.col("toxic"), sample), (~F.col("toxic"), 2 * sample))]
    chosen = {r.k: r.toxic for part in chosen for r in part.collect()}  # 3 * sample rows at most
    keys = docs.sparkSession.createDataFrame([(k,) for k in chosen], "k long")
    texts = docs.where(F.octet_length("text").between(1, sample_bytes)).select(F.xxhash64("doc_id", "text").alias("k"), "text").join(F.broadcast(keys), "k").dropDuplicates(["k"]).orderBy("k").limit(3 * sample).collect()
    return fit([r.text for r in texts], [chosen[r.k] for r in texts])


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_sentences, n_offending."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))  # 4 MB

    def score(batches):
        for whole in batches:
            for batch in bytewords.rows_of(whole, 1 << 20):
                p, doc, _, _, each = judge(batch.column("text"), model.value)
                counts = [np.bincount(d, minlength=batch.num_rows) for d in (doc, doc[each >= OFFENDING])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= CUTOFF).astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in counts)], names=["doc_id", "score", "predicted", "n_sentences", "n_offending"])

    out = docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double, predicted int, n_sentences long, n_offending long")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "n_offending")


def locate(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, at_least: float = OFFENDING) -> DataFrame:
    """The offending sentences: doc_id, begin and length (in code points), sentence, score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))

    def find(batches):
        for whole in batches:
            for batch in bytewords.rows_of(whole, 1 << 20):
                column = batch.column("text")
                data, offsets = bytewords.column_bytes(column)
                _, doc, begin, end, each = judge(column, model.value)
                bad = np.flatnonzero(each >= at_least)
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                texts = [data[b:e].tobytes().decode() for b, e in zip(begin[bad].tolist(), end[bad].tolist(), strict=True)]
                start = points[begin[bad]] - points[offsets[doc[bad]]]
                size = points[end[bad]] - points[begin[bad]]
                ids = batch.column("doc_id").take(pa.array(doc[bad]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(size), pa.array(texts, pa.string()), pa.array(each[bad])], names=["doc_id", "begin", "length", "sentence", "score"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, begin long, length long, sentence string, score double")
