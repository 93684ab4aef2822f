"""Language-model scoring with a log-frequency Bloom filter.

Counting: each batch of training text sends its distinct n-grams (words and word pairs) with
their counts to the cells of the hash space, packed; a cell adds them up. The number of cells
grows with the text, so a cell's size does not, up to 2^10 cells; beyond, a cell and the number of
cells grow with the root of the text, so that what is sent to a cell at once does not dwindle to a
few n-grams. All n-grams are kept, those that occur once, too.

Filter: an n-gram of count c is entered at levels 1..q, q = 1 + floor(log2(c)). Each cell fills
segments for words and for pairs, one for each of its shards; an entry takes ``bits_per_entry``
bits, at any size.

Scoring: probing levels upwards until one is absent gives back a count to within its level. Up to
``filter_bytes`` the segments are broadcast, all together. Beyond that no worker can hold them, so
the probes travel instead: each piece of text sends its distinct n-grams to the tasks that hold
their segments, which look up those of many pieces at once, and gets the levels back. Both ways ask
the same segments, and the shards do not depend on the cells, so scores do not depend on the way.

p(w | v) = k c(v w) / c(v) + (1 - k) (c(w) + 1) / (N + V + 1), where the weight k is the one of
WEIGHTS under which the training text is likeliest with each token's own occurrence taken out.

Exact counts of single tokens, for the base score, come from a broadcast table of the most
frequent ones, of bounded size, and for all others from a join.

Defined cases: null is the empty text, which is one end token; a null doc_id counts as training;
repeated rows count as often as they occur; texts are read whole, a long one as a piece of its own;
an empty table gives no rows; further columns are left alone.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm import bytewords
from leafmill.tables import materialize

WEIGHTS = np.array([0.02, 0.1, 0.25, 0.5, 0.75])
#: Of a filter that is broadcast.
FILTER_BYTES = 128 << 20
BITS_PER_ENTRY = 7
PROBES = 4
#: Tokens in the broadcast table of exact counts.
HEAD = 1 << 19
SHARD_BYTES = 4 << 20
#: Shards in a cell, as a power of two, unless cells are few or many.
CELL = 2
#: Text whose n-grams are counted at once before they are sent.
COUNTED = 2 << 20
#: Text that is scored at once, and where probes travel.
PIECE = 1 << 18
ASKED = 4 << 20
#: N-grams that are added up at once, and that are looked up at once.
ADDED = 1 << 16
LOOKED_UP = 1 << 19
BASE = 2.0
END = np.uint64(0x5851F42D4C957F2D)
WORD, PAIR = 0, 1
PACKED = "cell int, kind int, keys binary, counts binary"
PIECES = "piece long, row array<long>, doc_id array<long>, held_out array<boolean>, text array<string>"
U64 = np.uint64


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences."""
    return np.ascontiguousarray(np.diff(keys, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes with an end after each text, hashes of the tokens before, offsets)."""
    words = bytewords.split_words(column)
    offsets = words.offsets + np.arange(len(words.offsets))
    out = np.full(offsets[-1], END, np.uint64)
    inside = np.ones(len(out), bool)
    inside[offsets[1:] - 1] = False
    out[inside] = words.hashes
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[offsets[:-1]] = END
    return out, before, offsets


def _merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, counts
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[at], np.add.reduceat(counts, at)


def cell_bits(bits: int) -> int:
    """The top bits of a key that name its cell; bits: those that name its shard."""
    cells = min(bits, max(8, bits - CELL))
    return cells if cells <= 10 else 10 + (cells - 9) // 2


def _cut_by_cell(keys: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """The cells of sorted keys, and where each begins, with the end."""
    cells = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    cuts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(keys) else np.zeros(0, np.int64)
    return cells[cuts].tolist(), [*cuts.tolist(), len(keys)]


def count_ngrams(training: DataFrame, bits: int) -> DataFrame:
    """PACKED rows, one per cell and kind, of the n-grams of the training texts; of pairs, counts
    holds the levels. bits: those of a key that name its cell."""

    def partial(batches):
        for whole in batches:
            for batch in bytewords.rows_of(whole, COUNTED):
                out, before, _ = tokens(batch.column("text"))
                rows = []
                for kind, grams in ((WORD, out), (PAIR, bytewords.chain(before, out))):
                    keys, counts = np.unique(grams, return_counts=True)
                    cells, cuts = _cut_by_cell(keys, bits)
                    for cell, a, b in zip(cells, cuts, cuts[1:], strict=False):
                        rows.append((cell, kind, pack(keys[a:b]), counts[a:b].astype(np.uint32).tobytes()))
                yield _packed(rows)

    def total(table: pa.Table) -> pa.Table:
        rows = []
        for kind in (WORD, PAIR):
            own = table.filter(pa.compute.equal(table.column("kind"), kind))
            if own.num_rows:
                keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                waiting = 0
                for x, times in zip(own.column("keys"), own.column("counts"), strict=True):
                    keys.append(unpack(x.as_py()))
                    counts.append(np.frombuffer(times.as_py(), np.uint32).astype(np.int64))
                    waiting += len(keys[-1])
                    if waiting > max(ADDED, len(keys[0])):  # as many as are added up, so that each is added a few times at most
                        keys, counts = ([x] for x in _merge(np.concatenate(keys), np.concatenate(counts)))
                        waiting = 0
                keys, counts = _merge(np.concatenate(keys), np.concatenate(counts))
                rows.append((table.column("cell")[0].as_py(), kind, pack(keys), (counts if kind == WORD else levels(counts)).tobytes()))
        return pa.Table.from_batches([_packed(rows)])

    return training.select("text").mapInArrow(partial, PACKED).groupBy("cell").applyInArrow(total, PACKED)


def _packed(rows) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["cell", "kind", "keys", "counts"])


def levels(counts: np.ndarray) -> np.ndarray:
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)).astype(np.uint8)


def levels_of(kind: int, counts: bytes) -> np.ndarray:
    """The levels in a row of counted n-grams."""
    return levels(np.frombuffer(counts, np.int64)) if kind == WORD else np.frombuffer(counts, np.uint8)


#: The count that stands for each level: the middle of the whole numbers in it.
_EDGES = np.ceil(BASE ** np.arange(0, 62) - 1e-9)
MEANS = np.append(0.0, (_EDGES[:-1] + np.maximum(_EDGES[:-1], _EDGES[1:] - 1)) / 2)


#: What tells the entries of a key's levels apart.
_LEVEL_KEYS = np.arange(len(MEANS), dtype=np.uint64) * U64(bytewords.MULTIPLIER)


class LevelFilter:
    """Segments of one Bloom filter; a key's top bits choose the segment."""

    def __init__(self, data: np.ndarray, shard_bits: int, above: int = 0):
        """data: a row of bytes for each of the 2^shard_bits segments at hand. above: the bits of a key
        before those that choose, which all keys share."""
        self.data, self.shard_bits, self.above = data, shard_bits, above
        self.flat, self.width = data.reshape(-1), data.shape[1]

    def slot(self, keys: np.ndarray, h: np.ndarray, probe: int) -> np.ndarray:
        """Bit numbers of one probe. h: hashes of keys and level."""
        low = (h + U64(probe) * ((h >> U64(32)) | U64(1))) & U64(0xFFFFFFFF)
        at = (low * U64(8 * self.width)) >> U64(32)
        return at + ((keys << U64(self.above)) >> U64(64 - self.shard_bits)) * U64(8 * self.width) if self.shard_bits else at

    def add(self, keys: np.ndarray, most: np.ndarray) -> None:
        """Enters keys at all levels up to their highest."""
        for level in range(1, int(most.max(initial=0)) + 1):
            own = keys[most >= level]
            h = bytewords.mix(own + _LEVEL_KEYS[level])
            for k in range(PROBES):
                slot = self.slot(own, h, k)
                np.bitwise_or.at(self.flat, (slot >> U64(3)).astype(np.int64), (1 << (slot & U64(7)).astype(np.uint8)).astype(np.uint8))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level up to which all are present, of each key."""
        out = np.zeros(len(keys), np.uint8)
        left = np.arange(len(keys))
        level = 1
        while len(left) and level < len(MEANS):
            h = bytewords.mix(keys[left] + _LEVEL_KEYS[level])
            for k in range(PROBES):
                slot = self.slot(keys[left], h, k)
                there = (self.flat[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 > 0
                left, h = left[there], h[there]
            out[left] = level
            level += 1
        return out


def _histogram(counted: DataFrame) -> DataFrame:
    """(kind, level, n, least, total): n-grams by level; total: of words, their occurrences."""

    def rows(batches):
        for batch in batches:
            for kind, counts in zip(batch.column("kind").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                own, at = np.unique(levels_of(kind, counts), return_inverse=True)
                own = own.astype(np.int64)
                total = np.bincount(at, np.frombuffer(counts, np.int64) if kind == WORD else None, len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own), pa.int32()), pa.array(own), pa.array(np.bincount(at, minlength=len(own)).astype(np.int64)), pa.array(np.ceil(BASE ** (own - 1) - 1e-9).astype(np.int64)), pa.array(total)], names=["kind", "level", "n", "least", "total"])

    each = counted.mapInArrow(rows, "kind int, level long, n long, least long, total long")
    return each.groupBy("kind", "level").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("total").alias("total"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def _segments(counted: DataFrame, widths: dict[int, int], bits: int, cells: int) -> DataFrame:
    """(kind, cell, bits): the filter's segments, of widths[kind] bytes, cell by cell. bits, cells: those
    of a key that name its shard, and its cell."""

    def rows(batches):
        for batch in batches:
            for cell, kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("cell", "kind", "keys", "counts")), strict=True):
                part = LevelFilter(np.zeros((1 << (bits - cells), widths[kind]), np.uint8), bits - cells, cells)
                part.add(unpack(keys), levels_of(kind, counts))
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([cell], pa.int32()), pa.array([part.data.tobytes()], pa.binary())], names=["kind", "cell", "bits"])

    return counted.mapInArrow(rows, "kind int, cell int, bits binary")


def _cell_filter(data: bytes, bits: int, cells: int) -> LevelFilter:
    return LevelFilter(np.frombuffer(data, np.uint8).reshape(1 << (bits - cells), -1), bits - cells, cells)


def _grams(texts: pa.Array):
    """(tokens, offsets, distinct words, their places, distinct pairs, their places) of a piece."""
    out, before, offsets = tokens(texts)
    return out, offsets, *np.unique(out, return_inverse=True), *np.unique(bytewords.chain(before, out), return_inverse=True)


def _answered(pieces: DataFrame, segments: DataFrame, bits: int, cells: int) -> DataFrame:
    """(piece, kind, cell, levels) of the distinct n-grams of the pieces, in the keys' order.

    Requests meet the segments of their cell in a sorted partition, segments first; those that follow
    one another are looked up together, each n-gram once."""

    def ask(batches):
        for batch in batches:
            for piece, texts in zip(batch.column("piece").to_pylist(), batch.column("text"), strict=True):
                out, before, _ = tokens(texts.values)
                rows = []
                for kind, grams in ((WORD, out), (PAIR, bytewords.chain(before, out))):
                    keys, _ = np.unique(grams, return_counts=True)  # with counts, by sorting; without them by a slower hash table
                    named, cuts = _cut_by_cell(keys, cells)
                    rows += [(kind, cell, pack(keys[a:b])) for cell, a, b in zip(named, cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([piece] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "cell", "piece", "data"])

    def look_up(at: tuple[int, int], segments: LevelFilter | None, asked: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        keys, places = np.unique(np.concatenate([k for _, k in asked]), return_inverse=True)
        found = segments.levels(keys)[places] if segments else np.zeros(len(places), np.uint8)
        cuts = np.cumsum([0, *(len(k) for _, k in asked)]).tolist()
        columns = ([p for p, _ in asked], [at[0]] * len(asked), [at[1]] * len(asked), [found[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)])
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["piece", "kind", "cell", "levels"])

    def answer(batches):
        at, segments, asked, n = None, None, [], 0
        for batch in batches:
            for kind, cell, piece, data in zip(*(batch.column(c).to_pylist() for c in ("kind", "cell", "piece", "data")), strict=True):
                if asked and ((kind, cell) != at or n > LOOKED_UP):
                    yield look_up(at, segments, asked)
                    asked, n = [], 0
                if (kind, cell) != at:
                    at, segments = (kind, cell), None
                if piece is None:
                    segments = _cell_filter(data, bits, cells)
                else:
                    asked.append((piece, unpack(data)))
                    n += len(asked[-1][1])
        if asked:
            yield look_up(at, segments, asked)

    requests = pieces.select("piece", "text").mapInArrow(ask, "kind int, cell int, piece long, data binary")
    both = segments.select("kind", "cell", F.lit(None).cast("long").alias("piece"), F.col("bits").alias("data")).unionByName(requests)
    return both.repartition("kind", "cell").sortWithinPartitions("kind", "cell", F.asc_nulls_first("piece")).mapInArrow(answer, "piece long, kind int, cell int, levels binary")


def score_documents(docs: DataFrame, filter_bytes: int = FILTER_BYTES, bits_per_entry: int = BITS_PER_ENTRY, head: int = HEAD, shard_bytes: int = SHARD_BYTES, piece: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    piece: by default PIECE, or ASKED where the filter is asked by shuffle."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    training = texts.where("not held_out")
    size = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, (size // shard_bytes).bit_length())
    cells = cell_bits(bits)
    counted = materialize(count_ngrams(training, cells), "ngrams")
    histogram = _histogram(counted).collect()  # a row for each kind and level
    words = [r for r in histogram if r.kind == WORD]
    n_tokens, n_types = sum(r.total for r in words), sum(r.n for r in words)
    entries = {kind: sum(r.n * r.level for r in histogram if r.kind == kind) for kind in (WORD, PAIR)}
    widths = {kind: 64 + entries[kind] * bits_per_entry // (8 << bits) for kind in (WORD, PAIR)}
    segments = _segments(counted, widths, bits, cells)

    from_count, n_head = 1 << 62, 0
    for r in sorted(words, key=lambda r: -r.level):
        n_head += r.n
        if n_head > head:
            break
        from_count = r.least

    def exact(batches, above: bool):
        for batch in batches:
            for kind, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "keys", "counts")), strict=True):
                if kind == WORD:
                    k, c = unpack(keys), np.frombuffer(counts, np.int64)
                    own = (c >= from_count) == above
                    yield pa.RecordBatch.from_arrays([pa.array(k[own].view(np.int64)), pa.array(c[own])], names=["key", "c"])

    frequent = counted.mapInArrow(lambda it: exact(it, True), "key long, c long").toArrow()  # head rows at most
    head_keys = frequent.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(head_keys)
    table = spark.sparkContext.broadcast((head_keys[order], frequent.column("c").to_numpy()[order]))
    end = np.array([END])

    def scored_piece(batch: pa.RecordBatch, grams, one: np.ndarray, two: np.ndarray, ends: int) -> pa.RecordBatch:
        """one, two: levels of the distinct words and pairs; ends: that of END."""
        keys, exact_counts = table.value
        log_total = np.log10(n_tokens + n_types + 1)
        out, offsets, types, which, _, which_pair = grams
        at = np.minimum(np.searchsorted(keys, types), max(0, len(keys) - 1))
        in_head = keys[at] == types if len(keys) else np.zeros(len(types), bool)
        c = np.where(in_head, exact_counts[at], 0) if len(keys) else np.zeros(len(types), np.int64)
        base = np.where(in_head, np.log10(c + 1.0), 0.0)[which]
        known = in_head[which]
        sizes = np.diff(offsets)

        # tokens of the same three levels have the same probability
        here = one[which].astype(np.int32)
        before = np.append(here[:1], here[:-1])
        before[offsets[:-1]] = ends
        code = (here << 12) + (before << 6) + two[which_pair]
        place = np.zeros(1 << 18, np.int32)
        place[code] = 1
        codes = np.flatnonzero(place)
        place[codes] = np.arange(len(codes))
        place = place[code]
        c_here, c_before, pairs = MEANS[codes >> 12], MEANS[codes >> 6 & 63], MEANS[codes & 63]
        ahead = np.maximum(c_before, np.maximum(pairs, 1))
        training_row = ~batch.column("held_out").to_numpy(zero_copy_only=False)
        single = (c_here + 1) / (n_tokens + n_types + 1)
        ratio = pairs / ahead
        one_out = np.maximum(pairs - 1, 0) / np.maximum(ahead - 1, 1)
        single_out = np.maximum(c_here, 1) / (n_tokens + n_types)
        scores, apart = [], []
        for k in WEIGHTS:
            scores.append(np.add.reduceat(np.log10(k * ratio + (1 - k) * single)[place], offsets[:-1]))
            apart.append(np.add.reduceat(np.log10(k * one_out + (1 - k) * single_out)[place], offsets[:-1]) * training_row)
        tail = np.flatnonzero(~known)
        owner = np.searchsorted(offsets, tail, "right") - 1
        tail_offsets = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = np.arange(0, len(WEIGHTS) * (batch.num_rows + 1), len(WEIGHTS), dtype=np.int32)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("row"),
                batch.column("doc_id"),
                batch.column("held_out"),
                pa.array(sizes),
                pa.array(np.add.reduceat(known.astype(np.int64), offsets[:-1])),
                pa.array(np.add.reduceat(base, offsets[:-1]) - sizes * log_total),
                pa.ListArray.from_arrays(lists, pa.array(np.array(scores).T.ravel())),
                pa.ListArray.from_arrays(lists, pa.array(np.array(apart).T.ravel())),
                pa.ListArray.from_arrays(tail_offsets, pa.array(out[tail].view(np.int64))),
            ],
            names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "scores", "apart", "tail"],
        )

    rows = texts.withColumn("row", F.monotonically_increasing_id())
    result = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, scores array<double>, apart array<double>, tail array<long>"
    if sum(w << bits for w in widths.values()) <= filter_bytes:
        whole = {kind: np.zeros((1 << cells, w << (bits - cells)), np.uint8) for kind, w in widths.items()}
        for r in segments.toLocalIterator():  # filter_bytes in all, or less
            whole[r.kind][r.cell] = np.frombuffer(r.bits, np.uint8)
        model = spark.sparkContext.broadcast(tuple(whole[kind].reshape(1 << bits, -1) for kind in (WORD, PAIR)))

        def score(batches):
            one, two = (LevelFilter(x, bits) for x in model.value)
            ends = one.levels(end)[0]
            for batch in batches:
                for part in bytewords.rows_of(batch, piece or PIECE):
                    grams = _grams(part.column("text"))
                    yield scored_piece(part, grams, one.levels(grams[2]), two.levels(grams[4]), ends)

        scored = rows.mapInArrow(score, result)
    else:
        segments = materialize(segments, "segments")
        own = int(END) >> (64 - cells) if cells else 0
        ending = segments.where((F.col("kind") == WORD) & (F.col("cell") == own)).first()
        ends = _cell_filter(ending.bits, bits, cells).levels(end)[0] if ending else 0

        def deal(batches):
            for batch in batches:
                for part in bytewords.rows_of(batch, piece or ASKED):
                    lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(c)) for c in ("row", "doc_id", "held_out", "text")]
                    yield pa.RecordBatch.from_arrays([part.column("row")[:1], *lists], names=["piece", "row", "doc_id", "held_out", "text"])

        def score_group(part: pa.Table, levels_of: pa.Table) -> pa.Table:
            columns = {c: part.column(c)[0].values for c in ("row", "doc_id", "held_out", "text")}  # a piece is one row
            grams = _grams(columns["text"])
            found = {(k, c): x for k, c, x in zip(*(levels_of.column(c).to_pylist() for c in ("kind", "cell", "levels")), strict=True)}
            own = [np.frombuffer(b"".join(found[kind, c] for c in _cut_by_cell(keys, cells)[0]), np.uint8) for kind, keys in ((WORD, grams[2]), (PAIR, grams[4]))]
            return pa.Table.from_batches([scored_piece(pa.RecordBatch.from_pydict(columns), grams, *own, ends)])

        # each piece is one row, so that no batch or file ends within it
        pieces = materialize(rows.mapInArrow(deal, PIECES), "pieces")
        answers = materialize(_answered(pieces, segments, bits, cells), "answers")
        scored = pieces.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(score_group, result)

    scored = materialize(scored, "scores")
    sums = scored.agg(*(F.sum(F.element_at("apart", i + 1)).alias(f"w{i}") for i in range(len(WEIGHTS)))).first()
    best = max(range(len(WEIGHTS)), key=lambda i: sums[i] or 0.0) if sums[0] is not None else 0

    rare = counted.mapInArrow(lambda it: exact(it, False), "key long, c long")
    tail = scored.select("row", F.explode("tail").alias("key")).join(rare, "key")
    extra = tail.groupBy("row").agg(F.count(F.lit(1)).alias("known_too"), F.sum(F.log10(F.col("c") + 1.0)).alias("more"))
    out = scored.select("row", "doc_id", "held_out", "n_tokens", "known", "base", F.element_at("scores", best + 1).alias("score")).join(extra, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_too", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
