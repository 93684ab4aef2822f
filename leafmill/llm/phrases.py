"""Phrase collocations by Toivonen's sampling method.

A sample of the documents (one in SHARE, by hash) proposes phrases: those that are frequent in it at
a lowered threshold, found length by length. One pass over all documents counts, exactly, the
proposed phrases and their negative border: every phrase of which both parts one word shorter are
proposed, and every single word. Border phrases that turn out frequent are failures of the sample:
they are proposed too, and a further pass counts what that adds to the border, until nothing fails.
As a phrase is never more frequent than its parts, no frequent phrase is missed then.

What is proposed is sent to the tasks as a blocked Bloom filter of FILTER_BYTES at most. Its false
positives only let more phrases be counted, never fewer, so results are exact whatever the filter's
size. Tasks count by 64-bit keys of (language, words) and send each key once for every FLUSH keys;
texts of phrases are looked up for frequent ones only.

Defined cases: a null or empty text has no words; a null language is ``und``; phrases do not cross
documents, lines or the marks ``.,;:!?``; repeated rows count as often as they occur; texts of any
length are counted whole; no documents, no phrases; further columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm import bytewords
from leafmill.tables import materialize

LENGTH = 4
SUPPORT, TOP = 30, 2000
#: One document in SHARE is in the sample; a phrase is proposed from EAGER of its due count on.
SHARE, EAGER = 8, 0.6
BREAKS = b".,;:!?\n\x0b\x0c\r"
SPACES = b" \t"
#: Keys that a task holds before it sends them.
FLUSH = 1 << 21
FILTER_BYTES = 1 << 27
#: A block of the filter, in bits, and the bits a key sets in it.
BLOCK, PROBES = 1 << 15, 4
SCALE = 2000000
_STEP = np.uint64(0x9FB21C651E98DF25)


class Filter:
    """A blocked Bloom filter: a key's bits all lie in one block."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits  # blocks x BLOCK / 8 bytes

    def contains(self, keys: np.ndarray) -> np.ndarray:
        block, g = _spread(keys, len(self.bits))
        flat, alive = self.bits.reshape(-1), np.arange(len(keys))
        for i in range(PROBES):
            p = _place(g, i)
            hit = (flat[block * (BLOCK // 8) + (p >> 3)] >> (p & 7).astype(np.uint8)) & 1 == 1
            alive, block, g = alive[hit], block[hit], g[hit]
        out = np.zeros(len(keys), bool)
        out[alive] = True
        return out


def _spread(keys: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key, and a number that its places in the block come from."""
    h = bytewords.mix(keys + _STEP)
    return (h & np.uint64(blocks - 1)).astype(np.int64), bytewords.mix(h)


def _place(g: np.ndarray, i: int) -> np.ndarray:
    return ((g >> np.uint64(15 * i)) & np.uint64(BLOCK - 1)).astype(np.int64)


def make_filter(keys: DataFrame, most_bytes: int = FILTER_BYTES) -> Filter:
    """A filter of the column ``key``, of most_bytes at most: its blocks are made by tasks."""
    n = keys.count()
    blocks = 1
    while blocks * BLOCK < 16 * n and 2 * blocks * BLOCK // 8 <= most_bytes:
        blocks *= 2

    def place(batches):
        for batch in batches:
            block, _ = _spread(batch.column("key").to_numpy().view(np.uint64), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("key")], names=["block", "key"])

    def build(batches):
        """Rows come sorted by block."""
        held, now = None, -1
        for batch in batches:
            for b, k in _groups(batch):
                if b != now:
                    if held is not None:
                        yield _block_row(now, held)
                    held, now = np.zeros(BLOCK, bool), b
                _, g = _spread(k, blocks)
                for i in range(PROBES):
                    held[_place(g, i)] = True
        if held is not None:
            yield _block_row(now, held)

    placed = keys.select("key").mapInArrow(place, "block long, key long").repartition("block").sortWithinPartitions("block")
    rows = placed.mapInArrow(build, "block long, bits binary").collect()  # FILTER_BYTES at most
    bits = np.zeros((blocks, BLOCK // 8), np.uint8)
    for r in rows:
        bits[r.block] = np.frombuffer(r.bits, np.uint8)
    return Filter(bits)


def _groups(batch: pa.RecordBatch):
    block, key = batch.column("block").to_numpy(), batch.column("key").to_numpy().view(np.uint64)
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
    for a, b in zip(cuts, np.append(cuts[1:], len(block)), strict=True):
        yield int(block[a]), key[a:b]


def _block_row(block: int, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])


def _sized(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys of phrases of n words say so in their last three bits."""
    return (keys & ~np.uint64(7)) | np.uint64(n)


def _parts(batch: pa.RecordBatch, most_bytes: int = 1 << 20):
    """Batches of about most_bytes of text; longer texts are cut behind marks, which end phrases."""
    for rows in bytewords.rows_of(batch, most_bytes):
        data, _ = bytewords.column_bytes(rows.column("text"))
        if rows.num_rows > 1 or len(data) <= 2 * most_bytes:
            yield rows
            continue
        marks = np.zeros(256, bool)
        marks[list(BREAKS)] = True
        ends = np.flatnonzero(marks[data]) + 1
        begin = 0
        while begin < len(data):
            k = np.searchsorted(ends, begin + most_bytes)
            end = int(ends[k]) if k < len(ends) else len(data)
            yield pa.RecordBatch.from_arrays([pa.array([data[begin:end].tobytes().decode()]) if c == "text" else rows.column(c) for c in rows.schema.names], names=rows.schema.names)
            begin = end


class Text:
    """Keys of all phrases of a batch. keys[n][i]: of the n words from word i on (of the language
    alone for n = 0); whole[n][i]: whether they stand in one piece."""

    def __init__(self, batch: pa.RecordBatch):
        self.data, offsets = bytewords.column_bytes(batch.column("text"))
        separators = SPACES + BREAKS
        words = bytewords.split_words(batch.column("text"), separators)
        self.begin, self.end = bytewords.word_places(self.data, offsets, separators)
        self.owner = words.documents()
        marks = np.zeros(256, bool)
        marks[list(BREAKS)] = True
        piece = np.searchsorted(np.flatnonzero(marks[self.data]), self.begin)
        names = batch.column("lang").dictionary_encode()
        base = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest()) for x in names.dictionary.to_pylist()], np.uint64)
        base = _sized(base, 0)[names.indices.to_numpy(zero_copy_only=False)]
        self.dealt = batch.column("dealt").to_numpy()
        m = len(self.begin)
        self.keys, self.whole = [base[self.owner]], [np.ones(m, bool)]
        for n in range(1, LENGTH + 1):
            size = max(0, m - n + 1)
            self.keys.append(_sized(bytewords.mix(self.keys[-1][:size] * np.uint64(bytewords.MULTIPLIER) + words.hashes[n - 1 :][:size]), n))
            last = slice(n - 1, n - 1 + size)
            self.whole.append((piece[:size] == piece[last]) & (self.owner[:size] == self.owner[last]))

    def border(self, n: int, proposed: Filter | None, fresh: Filter | None = None) -> np.ndarray:
        """Where phrases of n words start whose parts one word shorter are both proposed, and one of
        them fresh, if that is given."""
        if n < 2 or proposed is None:
            return np.flatnonzero(self.whole[n])
        if fresh is None:
            inside = self._inside(n - 1, proposed)
            return np.flatnonzero(inside[:-1] & inside[1:] & self.whole[n]) if len(self.whole[n]) else np.zeros(0, np.int64)
        new = self._inside(n - 1, fresh)
        at = np.flatnonzero((new[:-1] | new[1:]) & self.whole[n]) if len(self.whole[n]) else np.zeros(0, np.int64)
        return at[self.counted(n, at, proposed, None)]

    def counted(self, n: int, at: np.ndarray, proposed: Filter, fresh: Filter | None) -> np.ndarray:
        """border() for the places given only."""
        first, second = self.keys[n - 1][at], self.keys[n - 1][at + 1]
        out = proposed.contains(first) & proposed.contains(second)
        return out & (fresh.contains(first) | fresh.contains(second)) if fresh is not None else out

    def _inside(self, n: int, some: Filter) -> np.ndarray:
        out, at = np.zeros(len(self.whole[n]), bool), np.flatnonzero(self.whole[n])
        out[at] = some.contains(self.keys[n][at])
        return out

    def places(self) -> np.ndarray:
        """16 bits that tell the document of each word from most others."""
        return (bytewords.mix(self.dealt.view(np.uint64)) >> np.uint64(48))[self.owner]

    def phrase(self, at: np.ndarray, n: int) -> pa.Array:
        """Texts of the phrases, A-Z lower-cased, words joined by one space."""
        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 0x20
        out = [b" ".join(self.data[self.begin[i + k] : self.end[i + k]].tobytes() for k in range(n)) for i in at.tolist()]
        return pa.array([lower[np.frombuffer(x, np.uint8)].tobytes().decode() for x in out], pa.string())


class Counter:
    """Counts keys and gives them out, each once, when more than FLUSH have come together.

    With a count goes the place of one of the key's occurrences: value = count << 16 | place."""

    def __init__(self):
        self.new, self.n_new = [], 0
        self.keys, self.counts, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def add(self, keys: np.ndarray, places: np.ndarray):
        self.new.append((keys, places.astype(np.uint16)))
        self.n_new += len(keys)
        if self.n_new > FLUSH:
            self._merge()
            if len(self.keys) > FLUSH:
                yield from self.flush()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        at = np.concatenate([self.at, *(p for _, p in self.new)])
        counts = np.ones(len(keys), np.int64)
        counts[: len(self.counts)] = self.counts
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.keys, self.counts, self.at = keys[first], np.add.reduceat(counts[order], first), at[order][first]
        self.new, self.n_new = [], 0

    def flush(self):
        if self.n_new:
            self._merge()
        if len(self.keys):
            yield pa.RecordBatch.from_arrays([pa.array(self.keys.view(np.int64)), pa.array(self.counts << 16 | self.at)], names=["key", "value"])
        self.__init__()


def count(docs: DataFrame, lengths: list[int], proposed: Filter | None = None, fresh: Filter | None = None, done: tuple = ()) -> DataFrame:
    """(key, n, place): exact counts of all phrases of these lengths on the border of ``proposed``
    (with a fresh part, if ``fresh`` is given) that no pass of ``done`` (proposed, fresh) counted;
    place: where one of the occurrences is (Text.places)."""
    bits = [[None if x is None else x.bits for x in pair] for pair in ((proposed, fresh), *done)]
    filters = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BYTES each

    def part(batches):
        (now, new), *earlier = ([None if x is None else Filter(x) for x in pair] for pair in filters.value)
        held = Counter()
        for whole in batches:
            for batch in _parts(whole):
                text = Text(batch)
                places = text.places()
                for n in lengths:
                    at = text.border(n, now, new)
                    for old in earlier:
                        at = at[~text.counted(n, at, *old)]
                    for lo in range(0, len(at), FLUSH):
                        some = at[lo : lo + FLUSH]
                        yield from held.add(text.keys[n][some], places[some])
        yield from held.flush()

    # keys come once or twice from a task, so there is nothing to combine before the shuffle
    rows = docs.mapInArrow(part, "key long, value long").repartition("key").groupBy("key")
    return rows.agg(F.sum(F.shiftright("value", 16)).alias("n"), F.max("value").bitwiseAND(0xFFFF).alias("place"))


def propose(docs: DataFrame, support: int = SUPPORT, share: int = SHARE) -> DataFrame:
    """(key) of the phrases of up to LENGTH - 1 words that are frequent in the sample."""
    sample = docs.where(F.pmod("dealt", F.lit(share)) == 0)
    least = max(2, int(EAGER * support / share))
    found = materialize(count(sample, [1]).where(F.col("n") >= least).select("key"), "proposed")
    for n in range(2, LENGTH):
        more = materialize(count(sample, [n], make_filter(found)).where(F.col("n") >= least).select("key"), "proposed")
        found = found.unionByName(more)
    return found


def frequent(docs: DataFrame, support: int = SUPPORT, share: int = SHARE) -> tuple[DataFrame, int]:
    """(key, n, place) of every phrase of up to LENGTH words with n >= support, and of the words of each
    language together (the language's key); and how many passes over all documents it took."""
    proposed = propose(docs, support, share)
    now, fresh, counted, done = make_filter(proposed), None, None, []
    while True:
        lengths = [*range(0 if counted is None else 2, LENGTH + 1)]
        more = materialize(count(docs, lengths, now, fresh, tuple(done)).where(F.col("n") >= support), "frequent")
        counted = more if counted is None else counted.unionByName(more)
        done.append((now, fresh))
        failures = materialize(more.select("key").where(f"key & 7 between 1 and {LENGTH - 1}").join(proposed, "key", "left_anti"), "failures")
        if failures.isEmpty():
            return counted, len(done)
        proposed = proposed.unionByName(failures)
        now, fresh = make_filter(proposed), make_filter(failures)


def _described(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """key, lang, size (words), phrase, firsts and rests (keys of the parts before and behind each
    cut), inner (keys of the shorter phrases of two words or more inside) of the keys in counts. A key
    is described where its place says that it occurs, so its rows do not grow with the tasks."""
    spots = counts.select(F.col("key").bitwiseXOR(F.shiftleft("place", 40)).alias("key"))
    wanted = docs.sparkSession.sparkContext.broadcast(make_filter(spots).bits)
    keys = pa.list_(pa.int64())
    schema = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("firsts", keys), ("rests", keys), ("inner", keys)])

    def sub(text: Text, at: np.ndarray, places: list[tuple[int, int]]) -> pa.Array:
        """Keys of the words (from, how many) of each phrase."""
        each = np.array([text.keys[n][at + i] for i, n in places], np.uint64).T.reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(places)), pa.array(each.view(np.int64)))

    def part(batches):
        seen, frequents = np.zeros(0, np.uint64), Filter(wanted.value)
        for whole in batches:
            for batch in _parts(whole):
                text = Text(batch)
                new, spot = [], text.places() << np.uint64(40)
                for n in (0, *range(2, LENGTH + 1)):
                    at = np.flatnonzero(text.whole[n])
                    at = at[frequents.contains(text.keys[n][at] ^ spot[at])]
                    at = at[np.unique(text.keys[n][at], return_index=True)[1]]
                    at = at[~np.isin(text.keys[n][at], seen)]
                    inner = [(i, m) for m in range(2, n) for i in range(n - m + 1)]
                    subs = [sub(text, at, x) for x in ([(0, k) for k in range(1, n)], [(k, n - k) for k in range(1, n)], inner)]
                    new.append(text.keys[n][at])
                    yield pa.RecordBatch.from_arrays([pa.array(new[-1].view(np.int64)), batch.column("lang").take(pa.array(text.owner[at])), pa.array(np.full(len(at), n, np.int32)), text.phrase(at, n), *subs], schema=schema)
                seen = np.sort(np.concatenate([seen, *new])) if len(seen) < FLUSH else np.concatenate(new)

    rows = docs.mapInArrow(part, "key long, lang string, size int, phrase string, firsts array<long>, rests array<long>, inner array<long>")
    return rows.dropDuplicates(["key"]).join(counts.drop("place"), "key")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP, share: int = SHARE) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"), F.xxhash64("doc_id", "text").alias("dealt"))
    counts, _ = frequent(texts, support, share)
    rows = materialize(_described(texts, counts), "phrases")
    candidates = rows.where("size > 1").withColumnRenamed("n", "a")
    cuts = candidates.select("key", "a", F.posexplode(F.arrays_zip("firsts", "rests")).alias("k", "cut")).select("key", "a", "k", "cut.firsts", "cut.rests")
    cuts = cuts.join(counts.select(F.col("key").alias("firsts"), F.col("n").alias("l")), "firsts").join(counts.select(F.col("key").alias("rests"), F.col("n").alias("r")), "rests")
    score = F.expr(f"cast({SCALE} as decimal(20,0)) * cast(a as decimal(18,0)) div cast(l + r as decimal(19,0))")
    best = cuts.select("key", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("key").agg(F.min("cut").alias("cut"))
    longer = candidates.select(F.explode("inner").alias("key"), F.col("a").alias("longer")).groupBy("key").agg(F.max("longer").alias("longer"))
    held = candidates.join(longer, "key", "left").where(F.expr("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80"))
    totals = rows.where("size = 0").select("lang", F.col("n").alias("total"))
    out = held.join(best, "key").select("key", "lang", "phrase", "a", "cut.score", "cut.l", "cut.r")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lots = Window.partitionBy("lang", F.pmod("key", F.lit(64))).orderBy(*order)
    first = out.withColumn("place", F.row_number().over(lots)).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
