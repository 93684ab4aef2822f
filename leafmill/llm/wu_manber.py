"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of 10 consecutive item words (an item of fewer words is one window).
Symbols are words, blocks are two words. A shift table says how far the search may jump; where it
says 0, the hash of the window's last block (and, as in the method's prefix table, of its first)
selects a bucket of patterns, with which the window is compared word by word.

Defined cases: null or empty texts have no words and no hits; an item without words has no
window; equal items keep all their ids; a null item_id is ignored; repeated rows give repeated
results; other columns of the documents are left alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import bytewords
from leafmill.tables import materialize

WINDOW = 10
#: Search tables are made and broadcast for this many bytes of benchmark text at most; a larger
#: benchmark is searched for in several passes. A word has two bytes or more with its separator, and
#: takes 8 bytes as a word and 36 at most as a pattern, so tables take 22 * PASS_BYTES at most, and
#: 2^MOST_BITS more for each length of patterns.
PASS_BYTES = 4 << 20
MOST_BITS = 24
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


class Machine:
    """Search tables for the patterns of one length, all of them flat arrays.

    words: the words of all items, one after the other; a pattern is the ``length`` words from its
    start. keys: the sorted hashes of (last block, first block), which is what selects a bucket;
    starts: the patterns' starts, in the order of keys; pattern k belongs to
    owners[cuts[k] : cuts[k + 1]], numbers of items."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, owners: np.ndarray):
        """words; the start in words, and the item, of each pattern; equal patterns are merged."""
        self.length, self.block, self.words = length, min(2, length), words
        every = bytewords.chain(*(words[starts + k] for k in range(length)))
        keys = self._keys(words, starts)
        order = np.lexsort((owners, every, keys))
        keys, every, starts, owners = keys[order], every[order], starts[order], owners[order]
        new = np.append(True, (keys[1:] != keys[:-1]) | (every[1:] != every[:-1]))
        more = np.append(True, owners[1:] != owners[:-1]) | new
        self.keys, self.starts = keys[new], starts[new]
        self.owners = owners[more]
        self.cuts = np.append(np.flatnonzero(new[more]), len(self.owners))
        per = length - self.block + 1
        bits = max(12, min(MOST_BITS, int(len(self.starts) * per * 16).bit_length()))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, per, np.uint8 if per < 256 else np.uint16)
        for k in range(per):
            slots = self._slots(self.blocks(words, self.starts + k))
            self.shift[slots] = np.minimum(self.shift[slots], per - 1 - k)

    def _slots(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> self.drop).astype(np.int64)

    def blocks(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The blocks that start at the given words."""
        return words[at] if self.block == 1 else bytewords.chain(words[at], words[at + 1])

    def _keys(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return bytewords.chain(self.blocks(words, starts + self.length - self.block), self.blocks(words, starts))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.starts, self.owners, self.cuts, self.shift))

    def search(self, words: np.ndarray, first_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, pattern) of each occurrence inside one document, in order.

        first_word: for each word, the first word of its document."""
        none = np.zeros(0, np.int64)
        if len(words) < self.length or not len(self.keys):
            return none, none
        blocks = self.blocks(words, np.arange(len(words) - self.block + 1))
        shifts = self.shift[self._slots(blocks)].tolist()
        at, n, back, found = self.length - self.block, len(shifts), self.length - self.block, []
        while at < n:
            jump = shifts[at]
            if jump:
                at += jump
            else:
                found.append(at - back)
                at += 1
        begins = np.array(found, np.int64)
        begins = begins[first_word[begins + self.length - 1] <= begins]
        keys = self._keys(words, begins)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        hits = [(none, none)]
        while len(begins):  # as often as patterns share a bucket
            left = low < high
            begins, low, high = begins[left], low[left], high[left]
            equal = np.ones(len(begins), bool)
            for k in range(self.length):
                equal &= self.words[self.starts[low] + k] == words[begins + k]
            hits.append((begins[equal], low[equal]))
            low = low + 1
        begins, patterns = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((patterns, begins))
        return begins[order], patterns[order]


class Tables:
    """The machines of a slice of the benchmark, one for each pattern length, and its item ids."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        items = [(i, t) for i, t in items if i is not None]
        split = bytewords.split_words(pa.array([t for _, t in items], pa.string()), bytewords.NON_ALNUM)
        self.ids = sorted({str(i) for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        item = np.array([number[str(i)] for i, _ in items], np.int32)
        counts = split.counts
        self.machines = []
        for length in sorted({min(window, n) for n in counts.tolist() if n}):
            rows = np.flatnonzero(counts >= window if length == window else counts == length)
            each = counts[rows] - length + 1
            ahead = np.cumsum(each) - each
            starts = np.repeat(split.offsets[rows] - ahead, each) + np.arange(each.sum())
            self.machines.append(Machine(length, split.hashes, starts, np.repeat(item[rows], each)))

    @property
    def nbytes(self) -> int:
        return sum(m.nbytes for m in self.machines) + max((m.words.nbytes for m in self.machines), default=0)

    def parts(self) -> tuple:
        """Plain arrays, which a process unpacks once and keeps."""
        return self.ids, [vars(m) for m in self.machines]

    @classmethod
    def of(cls, parts: tuple) -> Tables:
        out = cls.__new__(cls)
        out.ids, out.machines = parts[0], []
        for own in parts[1]:
            machine = Machine.__new__(Machine)
            vars(machine).update(own)
            out.machines.append(machine)
        return out


def _broadcast(items: DataFrame, window: int) -> Broadcast:
    """The search tables of a slice of the benchmark (PASS_BYTES of text at most)."""
    tables = Tables([tuple(r) for r in items.select("item_id", "text").collect()], window)
    return items.sparkSession.sparkContext.broadcast(tables.parts())


def _scan(tables: Tables, batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[tuple[int, int]], set[str]]]:
    """For each row of a batch: its number, its words, hit intervals and items."""
    words = bytewords.split_words(batch.column("text"), bytewords.NON_ALNUM)
    first = np.repeat(words.offsets[:-1], words.counts)
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    items: dict[int, set[str]] = defaultdict(set)
    for machine in tables.machines:
        begins, patterns = machine.search(words.hashes, first)
        rows = np.searchsorted(words.offsets, begins, "right") - 1
        for row, begin, k in zip(rows.tolist(), (begins - words.offsets[rows]).tolist(), patterns.tolist(), strict=True):
            hits[row].append((begin, machine.length))
            items[row].update(tables.ids[i] for i in machine.owners[machine.cuts[k] : machine.cuts[k + 1]])
    for row, n in enumerate(words.counts.tolist()):
        yield row, n, hits.get(row, []), items.get(row, set())


def _covered(hits: list[tuple[int, int]]) -> int:
    total = end = 0
    for begin, length in sorted(hits):
        total += max(0, begin + length - max(end, begin))
        end = max(end, begin + length)
    return total


def _items_digest(ids: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def _pieces(benchmark: DataFrame, window: int, most_bytes: int) -> DataFrame:
    """(item_id, text) with items of more than most_bytes cut into pieces, which overlap by
    window - 1 words, so that they hold the item's windows."""
    word = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")

    def cut(batches):
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans = [m.span() for m in word.finditer(text)]
                begin = 0
                while begin + window <= len(spans) or not begin:
                    end = min(len(spans), begin + window)
                    while end < len(spans) and 4 * (spans[end][1] - spans[begin][0]) <= most_bytes:
                        end += 1
                    out.append((item, text[spans[begin][0] : spans[end - 1][1]] if spans else ""))
                    begin = end - window + 1 if end < len(spans) else len(spans) + 1
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], batch.schema.field("item_id").type), pa.array([t for _, t in out], pa.string())], names=["item_id", "text"])

    benchmark = benchmark.select("item_id", "text")
    long = F.coalesce(F.octet_length("text") > most_bytes, F.lit(False))
    return benchmark.where(~long).unionByName(benchmark.where(long).mapInArrow(cut, benchmark.schema))


def _passes(benchmark: DataFrame, window: int, pass_bytes: int) -> list[DataFrame]:
    """Slices of the benchmark of pass_bytes at most. (One window that is longer is a slice.)"""
    total, longest = benchmark.agg(F.sum(F.octet_length("text")), F.max(F.octet_length("text"))).first()
    if (total or 0) <= pass_bytes:
        return [benchmark]
    pieces = materialize(_pieces(benchmark, window, pass_bytes // 4), "benchmark")
    n = -(-2 * total // pass_bytes)
    for _ in range(20):
        slice_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        size = F.sum(F.octet_length("text"))
        largest, pieces_in = pieces.groupBy(slice_of.alias("k")).agg(size.alias("n"), F.countDistinct("text").alias("pieces")).agg(F.max(F.struct("n", "pieces"))).first()[0]
        if largest <= pass_bytes or pieces_in == 1:
            break
        n *= 2
    return [pieces.where(slice_of == k) for k in range(n)]


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    The search reads each document once and shuffles nothing. A benchmark of more than
    pass_bytes is searched for slice by slice and the hits of the slices are put together.
    """
    slices = _passes(benchmark.select("item_id", "text"), window, pass_bytes)
    texts = docs.select("doc_id", "text")
    if len(slices) == 1:
        machines = _broadcast(slices[0], window)

        def search(batches):
            tables = Tables.of(machines.value)
            for whole in batches:
                for batch in bytewords.rows_of(whole):
                    rows = [(n, _covered(hits), len(ids), _items_digest(ids), bool(hits)) for _, n, hits, ids in _scan(tables, batch)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

        return texts.mapInArrow(search, RESULT)
    rows = texts.withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "decontaminate")
    found = None
    for part in slices:
        machines = _broadcast(part, window)
        more = rows.mapInArrow(_hits_with(machines), "row long, n_words long, hits array<struct<begin: int, length: int>>, items array<string>")
        found = more if found is None else found.unionByName(more)
    merged = found.groupBy("row").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = F.array_sort("hits")
    folded = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("end")),
        lambda acc, x: F.struct((acc["total"] + F.greatest(F.lit(0), x["begin"] + x["length"] - F.greatest(acc["end"], x["begin"]))).alias("total"), F.greatest(acc["end"], x["begin"] + x["length"]).alias("end")),
        lambda acc: acc["total"].cast("long"),
    )
    out = merged.select("row", "n_words", folded.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))
    return rows.select("row", "doc_id").join(out, "row").drop("row")


def _hits_with(machines):
    def search(batches):
        tables = Tables.of(machines.value)
        for whole in batches:
            for batch in bytewords.rows_of(whole):
                rows = [(n, [{"begin": b, "length": k} for b, k in hits], sorted(ids)) for _, n, hits, ids in _scan(tables, batch)]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("begin", pa.int32()), ("length", pa.int32())]))), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["row", "n_words", "hits", "items"])

    return search


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    slices = _passes(benchmark.select("item_id", "text"), window, pass_bytes)
    for part in slices:
        machines = _broadcast(part, window)

        def keep(batches, machines=machines):
            tables = Tables.of(machines.value)
            for whole in batches:
                for batch in bytewords.rows_of(whole):
                    yield batch.filter(pa.array([not hits for _, _, hits, _ in _scan(tables, batch)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
