"""Quality classifier from weak labels.

Seven heuristic labellers vote good, bad or nothing on each document's form. Expectation-maximisation
over the counts of their vote patterns (3^7 at most, whatever the number of documents) estimates how
each labeller votes on good and on bad documents, and so the probability that the form is good. An
eighth labeller votes on abusive words. Abuse is a fault apart from form, with no other labeller to
weigh it against, so its bad vote is taken at its word (DOUBT is left of the probability). A linear scorer over hashed byte pairs, word
repetition and abusive words learns these probabilities from a bounded sample (by hashed id,
``sample`` documents each that are good, bad by abuse, and bad by form alone) and judges every document.

Defined cases: a text without words (null, empty) gets no votes, no score and is not kept; a
one-sided or empty sample gives a scorer that keeps everything else; repeated rows count as often
as they occur; ties in the sample's order go to the smaller id; further columns are left alone.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import bytewords
from leafmill.tables import materialize

#: Labellers: (measure, good up to, bad from); votes between the two are withheld.
LABELLERS = [
    ("symbols", 0.05, 0.3),
    ("exclaims", 0.05, 0.3),
    ("capitals", 0.2, 0.5),
    ("bars", 0.03, 0.12),
    ("punctuation", 0.08, 0.15),
    ("repeats", 0.1, 0.3),
    ("echoes", 0.15, 0.35),
]
#: The labeller of abusive words, by their share, and what its bad vote leaves of the probability.
ABUSE, DOUBT = ("abuse", 0.002, 0.005), 0.02
GOOD, BAD, NONE = 0, 1, 2
SAMPLE = 1000
BINS = 1 << 10
FEATURES = BINS + 3
FACTOR = np.uint32(0x9E3779B1)
#: What a labeller is taken to do before any votes are seen: the share of its votes that are bad on
#: good and on bad documents, and how many votes, in shares of all, that belief is worth.
BELIEF, STRENGTH = (0.01, 0.5), 0.1
#: Abusive words of English, German, French and Spanish (A-Z are lower-cased). INSULTS count in full;
#: WORDS_OF_SCORN, which have harmless uses too, by half.
INSULTS = """
idiot idiots idiotic moron morons moronic imbecile imbeciles scum scumbag scumbags dumbass dumbasses dimwit dimwits halfwit
nitwit numbskull bastard bastards bitch bitches asshole assholes arsehole arseholes dickhead dickheads douchebag shithead
shitheads fuck fucks fucked fucker fuckers fucking motherfucker motherfuckers bullshit cunt cunts twat twats wanker wankers
slut sluts whore whores retard retards retarded jackass lowlife lowlifes degenerate degenerates vermin subhuman
dummkopf vollidiot idioten idiotin idiotisch trottel schwachkopf arschloch arschlöcher wichser hurensohn hurensöhne missgeburt
schlampe schlampen abschaum drecksau drecksack dreckskerl scheisskerl scheißkerl fotze fotzen spast vollpfosten untermensch
idiote idiotes imbécile imbéciles crétin crétine crétins connard connards connasse connasses salaud salauds salope salopes
enculé enculés ordure ordures abruti abrutie abrutis débile débiles bouffon putain pute putes bâtard bâtards
idiotas imbécil imbéciles estúpido estúpida estúpidos estúpidas gilipollas cabrón cabrones hijoputa puta putas mierda
pendejo pendejos capullo escoria subnormal subnormales tarado tarada malnacido zorra
""".split()
WORDS_OF_SCORN = """
stupid stupidity dumb loser losers pathetic worthless disgusting clown clowns trash garbage filth filthy creep creeps crap
shit shitty coward cowards fool fools foolish useless ugly hideous freak freaks pig pigs rat parasite parasites
dumm blöd blöde blöder versager feigling erbärmlich wertlos widerlich ekelhaft müll scheisse scheiße schwein
stupide minable pitoyable dégoûtant dégoûtante lâche clochard merde nul nulle raté ratée
patético patética asqueroso asquerosa inútil inútiles payaso payasos basura fracasado fracasada cobarde cobardes idiota
""".split()
_CLASSES = [b"#*$%&", b"!", bytes(range(0x41, 0x5B)), b"|", bytes(set(range(0x21, 0x80)) - set(range(0x30, 0x3A)) - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B))), b" \n"]


def _class_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each of _CLASSES, how many of a row's bytes are in it; two classes a pass."""
    out = []
    for x, y in zip(_CLASSES[::2], _CLASSES[1::2], strict=True):
        table = np.zeros(256, np.uint64)
        table[list(x)] += np.uint64(1)
        table[list(y)] += np.uint64(1 << 32)
        both = bytewords.sums_by_row(table[data], offsets)
        out += [(both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype(np.int64)]
    return out


def _hashes(terms: list[str]) -> np.ndarray:
    return np.unique(bytewords.split_words(pa.array(terms), bytewords.NON_ALNUM).hashes)


def abuse(column: pa.Array) -> np.ndarray:
    """The share of abusive words of each document; 0 if they weigh less than one insult."""
    words = bytewords.split_words(column, bytewords.NON_ALNUM)
    weight = np.zeros(len(words.hashes))
    for terms, worth in ((_hashes(WORDS_OF_SCORN), 0.5), (_hashes(INSULTS), 1.0)):
        at = np.minimum(np.searchsorted(terms, words.hashes), len(terms) - 1)
        weight[terms[at] == words.hashes] = worth
    total = bytewords.sums_by_row(weight, words.offsets)
    return np.where(total >= 1, total, 0) / np.maximum(words.counts, 1)


def measures(column: pa.Array) -> tuple[np.ndarray, np.ndarray, bytewords.Words]:
    """Labellers (that of abuse last) x documents, the numbers of words, and the words."""
    data, offsets = bytewords.column_bytes(column)
    words = bytewords.split_words(column)
    symbols, exclaims, capitals, bars, punctuation, spaces = _class_counts(data, offsets)
    h, owner = words.hashes, words.documents()

    def equal_to(back: int) -> np.ndarray:
        same = np.zeros(len(h), np.int64)
        same[back:] = (h[back:] == h[:-back]) & (owner[back:] == owner[:-back])
        return bytewords.sums_by_row(same, words.offsets)

    n = words.counts
    w, letters = np.maximum(n, 1), np.maximum(np.diff(offsets) - spaces, 1)
    return np.array([symbols / w / 3, exclaims / w / 2, capitals / letters, bars / w, punctuation / letters, equal_to(1) / w, equal_to(2) / w, abuse(column)]), n, words


def patterns(values: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """All votes of a document as one number in base 3, that on abuse last."""
    out = np.zeros(values.shape[1], np.int64)
    for (_, good, bad), x in zip([*LABELLERS, ABUSE], values, strict=True):
        vote = np.where(n_words == 0, NONE, np.where(x >= bad, BAD, np.where(x <= good, GOOD, NONE)))
        out = out * 3 + vote
    return out


def votes_of(pattern: int) -> list[int]:
    """The votes on form, without the one on abuse."""
    out = []
    for _ in LABELLERS:
        pattern, vote = divmod(pattern, 3)
        out.append(vote)
    return out[::-1]


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """P(good) of each pattern; labellers x (good, bad): share of bad votes; share of good documents."""
    keys = sorted(counts)
    believed = np.tile(BELIEF, (len(LABELLERS), 1))
    if not keys:
        return {}, believed, 0.5
    votes = np.array([votes_of(k) for k in keys])
    n = np.array([counts[k] for k in keys], float)
    good = np.where((votes == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        worth = STRENGTH * n.sum()
        bad_share = np.empty((len(LABELLERS), 2))
        for m in range(len(LABELLERS)):
            for c, p in ((0, good), (1, 1 - good)):
                bad, voted = (n * p)[votes[:, m] == BAD].sum(), (n * p)[votes[:, m] != NONE].sum()
                bad_share[m, c] = (bad + worth * believed[m, c]) / (voted + worth)
        prior = ((n * good).sum() + 1) / (n.sum() + 2)
        log_odds = np.full(len(keys), np.log(prior) - np.log1p(-prior))
        for m in range(len(LABELLERS)):
            log_odds += np.where(votes[:, m] == BAD, np.log(bad_share[m, 0] / bad_share[m, 1]), np.where(votes[:, m] == GOOD, np.log((1 - bad_share[m, 0]) / (1 - bad_share[m, 1])), 0.0))
        now = 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))
        moved = np.abs(now - good).max()
        good = now
        if moved < 1e-9:
            break
    return dict(zip(keys, good.tolist(), strict=True)), bad_share, float(prior)


def features(column: pa.Array, words: bytewords.Words, abusive: np.ndarray) -> np.ndarray:
    """Documents x FEATURES: roots of the shares of hashed byte pairs, and of repeated words, and how
    near the share of abusive words is to a bad vote, which a few words among many decide.

    Short texts say little about their quality, so all but the last are scaled down in them."""
    data, offsets = bytewords.column_bytes(column)
    pairs = ((data[:-1].astype(np.uint32) << np.uint32(8) | data[1:]) * FACTOR) >> np.uint32(22)
    out = np.zeros((len(offsets) - 1, FEATURES), np.float32)
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a > 1:
            out[k, :BINS] = np.sqrt(np.bincount(pairs[a : b - 1], minlength=BINS) / (b - a - 1))
    h = words.hashes
    for k, (a, b) in enumerate(zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist(), strict=True)):
        if b - a > 1:
            same = float((h[a + 1 : b] == h[a : b - 1]).mean())
            out[k, BINS : BINS + 2] = np.sqrt(same), np.sqrt(1 - same)
    size = np.diff(offsets)
    out *= (size / (size + 100)).astype(np.float32)[:, None]
    out[:, -1] = np.minimum(abusive / ABUSE[2], 1)
    return out


def fit(x: np.ndarray, good: np.ndarray, weight: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent."""
    if not len(x) or not (good > 0.5).any() or not (good < 0.5).any():
        return np.zeros(FEATURES, np.float32), 1.0
    weight = weight / weight.sum()
    x, good, weight = (a.astype(np.float32) for a in (x, good, weight))
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    speed_w, speed_b = np.zeros_like(w), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -50, 50)))
        error = (p - good) * weight
        speed_w = 0.9 * speed_w - np.float32(2.0) * (x.T @ error + np.float32(decay) * w)
        speed_b = 0.9 * speed_b - 2.0 * error.sum()
        w, b = w + speed_w, b + speed_b
    return w.astype(np.float32), float(b)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[int, float], np.ndarray, float]:
    """(P(good) by vote pattern, weights, intercept)."""

    def vote(batches):
        for whole in batches:
            for batch in bytewords.rows_of(whole):
                values, n, _ = measures(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(patterns(values, n)), pa.array(n > 0)], names=["doc_id", "pattern", "words"])

    votes = materialize(docs.select("doc_id", "text").mapInArrow(vote, "doc_id long, pattern long, words boolean"), "votes").where("words")
    counts = {r.pattern: r.n for r in votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # 3^8 rows at most
    forms: dict[int, int] = {}
    for k, n in counts.items():
        forms[k // 3] = forms.get(k // 3, 0) + n
    form, _, _ = estimate(forms)
    posterior = {k: form[k // 3] * (DOUBT if k % 3 == BAD else 1) for k in counts}
    good = sorted(k for k, p in posterior.items() if p >= 0.5)
    ids: dict[int, int] = {}
    groups = [set(good), {k for k in posterior if k % 3 == BAD}]
    groups.append(set(posterior) - groups[0] - groups[1])
    for side in (F.col("pattern").isin(sorted(g)) for g in groups):
        ids |= {r.doc_id: r.pattern for r in votes.where(side & F.col("doc_id").isNotNull()).select("doc_id", "pattern").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()}
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(i,) for i in ids], "doc_id long"))  # 3 * sample rows at most

    def describe(batches):
        for whole in batches:
            for batch in bytewords.rows_of(whole):
                values, n, words = measures(batch.column("text"))
                x = features(batch.column("text"), words, values[-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(patterns(values, n)), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "pattern", "x"])

    rows = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi").mapInArrow(describe, "doc_id long, pattern long, x binary").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(3 * sample).collect()
    rows = [r for r in rows if r.pattern in posterior]
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, FEATURES)
    p = np.array([posterior[r.pattern] for r in rows])
    share = {}
    for g in groups:
        share |= dict.fromkeys(g, sum(counts[k] for k in g) / max(1, sum(r.pattern in g for r in rows)))
    shares = np.array([share[r.pattern] for r in rows])
    w, b = fit(x, p, np.sqrt(shares)) if rows else fit(x, p, p)
    return posterior, w, b


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, posterior (of the labellers), score (log odds), kept."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def judge(batches):
        posterior, w, b = model.value
        for whole in batches:
            for batch in bytewords.rows_of(whole, 2 << 20):
                values, n, words = measures(batch.column("text"))
                score = (features(batch.column("text"), words, values[-1]) @ w + b).astype(np.float64)
                p = np.array([posterior.get(k, 0.5) for k in patterns(values, n).tolist()])
                none = n == 0
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, mask=none), pa.array(score, mask=none), pa.array(~none & (score >= 0))], names=["doc_id", "posterior", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, posterior double, score double, kept boolean")


def drop_poor(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents, with all their columns, that the classifier keeps."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, sample))

    def keep(batches):
        _, w, b = model.value
        for whole in batches:
            for batch in bytewords.rows_of(whole, 2 << 20):
                words = bytewords.split_words(batch.column("text"))
                score = features(batch.column("text"), words, abuse(batch.column("text"))) @ w + b
                yield batch.filter(pa.array((words.counts > 0) & (score >= 0)))

    return docs.mapInArrow(keep, docs.schema)
