"""Removal of long byte strings that occur more than once, by enhanced suffix arrays.

A string of ``size`` bytes that starts at two places contains the same anchor at both: the start
of the smallest of its k-gram hashes. Suffixes are therefore sorted at anchors only, about one in
180 bytes, without losing any repeat. All window starts that share an anchor are one *site*: the
anchor, the first and the last start, and a hash of the bytes that its windows span.

1. Sites with equal hashes repeat as a whole: every string of theirs occurs again.
2. Sites that share an anchor's k-gram but not all bytes are compared exactly. Spark deals their
   bytes out by k-gram and sorts them by the suffix from the anchor, which is an enhanced suffix
   array; a stack scan over its common prefixes visits the intervals of the tree. In each interval
   members are ordered by what stands left of the anchor; members whose left extensions differ
   and which come from different child intervals form a maximal repeat, with all occurrences.
3. A k-gram with more different sites than one task should hold is split by the strings
   themselves: first by the bytes that 16 neighbouring strings have in common, then by string.
   These are the leaves of the same tree; counting them combines on the map side.

Several sizes are looked for in one run: a site carries its size, and k-gram hashes of one size
never equal those of another, so texts are shuffled once for all. A document is known by one hash
of its id and text. A shorter size than SIZE finds
passages: PASSAGE bytes are what some 50 words take, and a run of such strings that holds more than
PASSAGE_WORDS words is counted as a passage.

Defined cases: null text is empty; texts shorter than ``size`` keep all bytes; repeated rows are
copies of each other, so all their strings repeat; repeated doc_ids are told apart by their text;
overlapping occurrences in one text count; further columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm import bytewords
from leafmill.tables import materialize

SIZE = 400
PASSAGE, PASSAGE_WORDS = 300, 50
GRAM = 48
#: Different sites of one k-gram that are compared in one task; k-grams with more are split.
MOST_SITES = 1024
#: Neighbouring window starts that are split off together.
STRIDE = 16
SLICE = 1 << 19
SITE = "key long, size int, gram long, bytes_hash long, site long"

_values = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_factors = [np.uint64(x | 1) for x in np.random.default_rng(6).integers(1, 1 << 63, 8, dtype=np.uint64).tolist()]
_POSITION = np.uint64((1 << 20) - 1)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    h, width = _values[data], 1
    for f in _factors[:4]:
        h = h[:-width] * f + h[width:]
        width *= 2
    h32 = h[:-16] * _factors[4] + h[16:]
    return bytewords.mix(h32[:-16] * _factors[5] + h[32:])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _sites(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first start, last start, anchor, k-gram hash), positions in data, of slices of it."""
    lengths = np.diff(offsets)
    row = 0
    while row < len(lengths):
        if lengths[row] < size:
            row += 1
            continue
        last = row  # rows row..last make a slice; a longer row has slices of its own
        while last + 1 < len(lengths) and offsets[last + 2] - offsets[row] <= SLICE:
            last += 1
        begin, end = int(offsets[row]), int(offsets[last + 1])
        for at in range(begin, end - size + 1, SLICE):
            stop = min(end, at + SLICE + size - 1)
            grams = _grams(data[at:stop])
            keys = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
            anchors = (_sliding_min(keys, size - GRAM + 1) & _POSITION).astype(np.int64)
            valid = np.zeros(len(anchors), bool)
            owner = np.zeros(len(anchors), np.int32)
            for r in range(row, last + 1):
                a, b = max(int(offsets[r]) - at, 0), min(int(offsets[r + 1]) - size + 1 - at, len(anchors))
                if a < b:
                    valid[a:b] = True
                    owner[a:b] = r
            starts = np.flatnonzero(valid)
            if len(starts):
                new = np.ones(len(starts), bool)
                new[1:] = (np.diff(anchors[starts]) != 0) | (np.diff(starts) != 1) | (np.diff(owner[starts]) != 0)
                first = starts[new]
                final = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
                yield owner[first], first + at, final + at, anchors[first] + at, grams[anchors[first]]
        row = last + 1


def _pack(start, more, anchor):
    """first start, last start and anchor of a site, relative to its text, in one long."""
    return (start << 20) | (more << 10) | anchor


def sites(docs: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """SITE rows of documents (key, text)."""

    def rows(batches):
        for batch in batches:
            data, offsets = bytewords.column_bytes(batch.column("text"))
            view = memoryview(data)
            for size in sizes:
                for owner, first, final, anchor, gram in _sites(data, offsets, size):
                    spans = zip(first.tolist(), (final + size).tolist(), strict=True)
                    hashes = np.array([xxhash.xxh3_64_intdigest(view[a:b]) for a, b in spans], np.uint64)
                    at = pa.array(owner)
                    packed = _pack(first - offsets[owner], final - first, anchor - first)
                    own = bytewords.mix(gram + np.uint64(size))
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(at), pa.array(np.full(len(own), size, np.int32)), pa.array(own.view(np.int64)), pa.array(hashes.view(np.int64)), pa.array(packed)], names=["key", "size", "gram", "bytes_hash", "site"])

    return docs.mapInArrow(rows, SITE)


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n
    while high - low > 16:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    while x[low] == y[low]:
        low += 1
    return low


def maximal_repeats(rights: list[bytes], lefts: list[bytes], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left of the anchor, bytes from it, members) of each maximal repeat of size or more.

    rights: suffixes from the anchor, sorted; lefts: what stands left of it, reversed."""
    n = len(rights)
    lcp = [_common(rights[i], rights[i + 1]) for i in range(n - 1)] + [-1]
    longest = max(map(len, lefts))
    stack: list[list] = [[0, 0, []]]  # common prefix, first member, first members of its children
    for i in range(n):
        first = i
        while stack and lcp[i] < stack[-1][0]:
            height, first, children = stack.pop()
            if height + longest >= size and i > first:
                yield from _diverse(rights, lefts, height, first, i, children, size)
            if stack and lcp[i] <= stack[-1][0]:
                stack[-1][2].append((first, i))
        if lcp[i] >= 0 and (not stack or lcp[i] > stack[-1][0]):
            stack.append([lcp[i], first, [(first, i)] if first < i else []])


def _diverse(rights, lefts, height: int, first: int, last: int, children: list[tuple[int, int]], size: int):
    """The maximal repeats among members first..last, whose suffixes share height bytes."""
    child = {m: m for m in range(first, last + 1)}
    for a, b in children:
        child |= dict.fromkeys(range(a, b + 1), -1 - a)
    order = sorted(range(first, last + 1), key=lambda m: lefts[m])
    shared = [_common(lefts[a], lefts[b]) for a, b in zip(order, order[1:], strict=False)] + [-1]
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate(shared):
        begin = i
        while stack and depth < stack[-1][0]:
            left, begin = stack.pop()
            members = order[begin : i + 1]
            if left + height >= size and len({child[m] for m in members}) > 1:
                yield left, height, members
        if depth >= 0 and (not stack or depth > stack[-1][0]):
            stack.append((depth, begin))


def _scan(batches):
    """Rows sorted by gram and suffix -> (key, size, span) of sites that are alone in their bytes."""

    def result(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["key", "size", "span"])

    def group(rows):
        if len(rows) < 2:
            return
        size = rows[0][5]
        reach: dict[int, list[int]] = {}
        for left, right, members in maximal_repeats([r[2] for r in rows], [r[3] for r in rows], size):
            for m in members:
                most = reach.setdefault(m, [0, 0])
                most[0], most[1] = max(most[0], left), max(most[1], right)
        for m, (left, right) in reach.items():
            key, site, _, _, n, _ = rows[m]
            if n == 1:
                anchor = (site >> 20) + (site & 1023)
                yield key, size, ((anchor - left) << 11) | (left + right)

    gram, rows, out = None, [], []
    for batch in batches:
        grams = batch.column("gram").to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("key", "site", "suffix", "prefix", "n", "size")]
        for g, key, site, suffix, prefix, n, size in zip(grams, *columns, strict=True):
            if g != gram:
                out += group(rows)
                gram, rows = g, []
            rows.append((key, site, suffix, prefix[::-1], n, size))
        if out:
            yield result(out)
            out = []
    out += group(rows)
    if out:
        yield result(out)


def _leaves(contexts: DataFrame) -> DataFrame:
    """(key, size, span) of the strings of contexts alone in their bytes that occur in others, too.

    Every string of a context is a leaf. STRIDE neighbouring strings travel in one row, with hashes
    of the bytes that all of them share (core) and that they span together (whole). Wholes that
    occur twice need no look at their strings; of others, one row for each whole is taken apart,
    where its core occurs in another whole."""

    def rows(batches):
        for batch in batches:
            out = []
            for key, site, text, n, size in zip(*(batch.column(c).to_pylist() for c in ("key", "site", "bytes", "n", "size")), strict=True):
                start, starts = site >> 20, len(text) - size + 1
                # strides are counted from the anchor, so that they agree in all sites of the gram
                anchor = site & 1023
                for k in range((anchor - starts + 1) // STRIDE, anchor // STRIDE + 1):
                    a, b = max(0, anchor - (k + 1) * STRIDE + 1), min(starts, anchor - k * STRIDE + 1)
                    if a < b:
                        core = text[anchor - k * STRIDE : anchor - (k + 1) * STRIDE + 1 + size]
                        windows = [xxhash.xxh3_64_intdigest(text[p : p + size]) for p in range(a, b)]
                        whole = xxhash.xxh3_64_intdigest(text[a : b - 1 + size])
                        out.append((key, start + a, n, size, whole, k, core, windows))
            if out:
                core = [xxhash.xxh3_64_intdigest(c, seed=(size << 16) | (k & 0xFFFF)) for _, _, _, size, _, k, c, _ in out]
                lists = pa.array([np.array(w, np.uint64).view(np.int64) for *_, w in out], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(4)), pa.array(np.array([r[4] for r in out], np.uint64).view(np.int64)), pa.array(np.array(core, np.uint64).view(np.int64)), lists], names=["key", "start", "n", "size", "whole", "core", "windows"])

    strides = contexts.select("key", "size", "site", "bytes", "n").mapInArrow(rows, "key long, start long, n long, size long, whole long, core long, windows array<long>")
    strides = materialize(strides, "strides")
    whole = strides.groupBy("core", "whole").agg(F.sum("n").alias("times"), F.first("key").alias("key"), F.first("start").alias("start"), F.first("size").alias("size"), F.first("windows").alias("windows"))
    whole = materialize(whole, "wholes")
    several = strides.where("n = 1").join(whole.where("times > 1").select("core", "whole"), ["core", "whole"], "left_semi")
    several = several.select("key", "size", (F.shiftleft("start", 11) + F.col("size") + F.size("windows") - 1).alias("span"))
    open_cores = whole.groupBy("core").agg(F.count(F.lit(1)).alias("wholes")).where("wholes > 1").select("core")
    each = whole.join(open_cores, "core", "left_semi").select("core", "times", "key", "size", "start", F.posexplode("windows").alias("k", "window"))
    counts = each.groupBy("core", "window").agg(F.sum("times").alias("all")).where("all > 1")
    alone = each.where("times = 1").join(counts, ["core", "window"], "left_semi")
    return several.unionByName(alone.select("key", "size", (F.shiftleft(F.col("start") + F.col("k"), 11) + F.col("size")).alias("span")))


def repeated_spans(docs: DataFrame, sizes: tuple[int, ...] = (SIZE,)) -> DataFrame:
    """(key, size, span): bytes that strings of size bytes cover which start elsewhere, too.

    docs: key, text; span is the first byte * 2048 + the number of bytes. Spans overlap."""
    found = sites(docs, sizes)  # read twice rather than written: it is as large as the texts
    same = found.groupBy("gram", "bytes_hash").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"), F.first("site").alias("site"), F.first("size").alias("size"))
    same = materialize(same, "same")
    start, more = F.expr("shiftright(site, 20)"), F.expr("shiftright(site, 10) & 1023")
    span = (F.shiftleft(start, 11) + more + F.col("size")).alias("span")
    copies = found.join(same.where("n > 1").select("gram", "bytes_hash"), ["gram", "bytes_hash"], "left_semi").select("key", F.col("size").cast("long").alias("size"), span)

    mixed = same.groupBy("gram").agg(F.count(F.lit(1)).alias("sites")).where("sites > 1")
    needed = same.join(mixed, "gram")
    needed = materialize(needed, "needed")
    cut = F.substring(F.col("text").cast("binary"), start.cast("int") + 1, (more + F.col("size")).cast("int"))
    contexts = needed.join(docs, "key").select("key", "size", "gram", "site", "n", "sites", cut.alias("bytes"))
    contexts = materialize(contexts, "contexts")

    few = contexts.where(f"sites <= {MOST_SITES}").select("gram", "key", "size", "site", "n", F.expr("substring(bytes, int(site & 1023) + 1)").alias("suffix"), F.expr("substring(bytes, 1, int(site & 1023))").alias("prefix"))
    spans = copies.unionByName(few.repartition("gram").sortWithinPartitions("gram", "suffix").mapInArrow(_scan, "key long, size long, span long"))

    many = contexts.where(f"sites > {MOST_SITES}")
    if not many.isEmpty():
        spans = spans.unionByName(_leaves(many))
    return spans


def _merged(spans) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of what the spans cover."""
    out: list[list[int]] = []
    for s in sorted(spans or ()):
        a, b = s >> 11, (s >> 11) + (s & 2047)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, size: int = SIZE, with_text: bool = False, passage: int = PASSAGE, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages (runs of
    repeated strings of ``passage`` bytes with more than ``passage_words`` words; they are counted,
    not removed), and, with_text, kept (the bytes left)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("key", F.xxhash64("doc_id", "text"))
    found = repeated_spans(texts.select("key", "text"), tuple(sorted({size, passage})))
    own = lambda n: F.collect_set(F.when(F.col("size") == n, F.col("span")))
    spans = found.groupBy("key").agg(own(size).alias("spans"), own(passage).alias("passages"))

    def cut(batches):
        for batch in batches:
            data, offsets = bytewords.column_bytes(batch.column("text"))
            view, out, texts_left = memoryview(data), [], []
            for k, (own, longer) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("passages").to_pylist(), strict=True)):
                text = view[int(offsets[k]) : int(offsets[k + 1])]
                runs, left, at = _merged(own), [], 0
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                digest, kept = hashlib.sha256(), sum(map(len, left))
                for piece in left:
                    digest.update(piece)
                many = sum(len(bytes(text[a:b]).split()) > passage_words for a, b in _merged(longer))
                out.append((len(text), len(text) - kept, len(runs), digest.hexdigest(), many))
                texts_left.append(b"".join(left) if with_text else b"")
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns, *[pa.array(texts_left, pa.binary())] * with_text], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", *["kept"] * with_text])

    joined = texts.join(spans, "key", "left")
    return joined.select("doc_id", "text", "spans", "passages").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", kept binary" * with_text)
