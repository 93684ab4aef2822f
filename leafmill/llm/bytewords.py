"""Splitting Arrow string columns into hashed words, a whole batch at a time.

All functions work on the UTF-8 bytes of an Arrow column, because the separators of every word
definition used here are ASCII: a byte of 0x80 or more is always part of a word. Nothing is
truncated; long columns are cut into pieces at word boundaries to bound memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)

#: Separator bytes of the two word definitions (fixed by the contracts).
SPACES = bytes([*range(0x09, 0x0E), 0x20])
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


@dataclass
class Words:
    """hashes of all words in order; word i of document d is at offsets[d] + i."""

    hashes: np.ndarray
    offsets: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def documents(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its len + 1 offsets into them; null is empty."""
    column = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    every = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return every[at[0] : at[-1]], at - at[0]


class _Kept(dict):
    """Tables that a process makes once; they do not travel with tasks."""

    def __reduce__(self):
        return _Kept, ()


_kept = _Kept()


def _tables(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: whether it belongs to words, and its random value, with A-Z lower-cased."""
    if separators in _kept:
        return _kept[separators]
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 0x20
    word = np.ones(256, bool)
    word[list(separators)] = False
    value = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    folded = value[lower]
    is_word = word[lower]
    _kept[separators] = is_word, np.where(is_word, folded, np.uint64(0))
    return _kept[separators]


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size in _kept:
        return _kept[size]
    out = []
    for base in (MULTIPLIER, INVERSE):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    _kept[size] = out[0], out[1]
    return _kept[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def chain(*columns: np.ndarray) -> np.ndarray:
    """Hashes of tuples of hashes, in order."""
    out = mix(columns[0] + np.uint64(len(columns)))
    for x in columns[1:]:
        out = mix(out * np.uint64(MULTIPLIER) + x)
    return out


def split_words(column: pa.Array, separators: bytes = SPACES) -> Words:
    """The words of each string, with A-Z lower-cased, as 64-bit hashes."""
    data, offsets = column_bytes(column)
    is_word, values = _tables(separators)
    hashes, ends = [], np.zeros(len(offsets), np.int64)
    begin, seen, n = 0, 0, len(data)
    first_doc = 0
    while begin < n:
        end = min(n, begin + PIECE)
        if end < n:  # cut behind a separator, or else at the end of the document or of the word
            back = np.flatnonzero(~is_word[data[begin:end]])
            if len(back):
                end = begin + int(back[-1]) + 1
            else:
                stop = int(offsets[np.searchsorted(offsets, begin, "right")])
                while end < stop and is_word[data[end]]:
                    more = np.flatnonzero(~is_word[data[end : min(stop, end + PIECE)]])
                    end = end + int(more[0]) if len(more) else min(stop, end + PIECE)
                    if len(more):
                        break
                end = min(end, stop) if stop > begin else end
        piece = data[begin:end]
        inside = is_word[piece]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        last_doc = int(np.searchsorted(offsets, end, "right"))
        cuts = offsets[first_doc:last_doc]
        cuts = cuts[(cuts >= begin) & (cuts < end)] - begin
        start[cuts] = inside[cuts]
        at = np.flatnonzero(start)
        if len(at):
            power, inverse = _powers(max(PIECE, 1 << int(len(piece) - 1).bit_length()) if len(piece) > 1 else PIECE)
            total = np.add.reduceat(values[piece] * power[: len(piece)], at)
            hashes.append(mix(total * inverse[at]))
        marks = offsets[first_doc:last_doc]
        inside_marks = (marks >= begin) & (marks <= end)
        ends[first_doc:last_doc][inside_marks] = seen + np.searchsorted(at, marks[inside_marks] - begin, "left")
        seen += len(at)
        first_doc = int(np.searchsorted(offsets, end, "left"))
        begin = end
    ends[offsets >= n] = seen
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), ends)


def sums_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of each row's values; 0 for rows without any."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    full = np.diff(offsets) > 0
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full])
    return out


def rows_of(batch: pa.RecordBatch, most_bytes: int = 8 << 20, column: str = "text"):
    """Slices of a batch with at most ``most_bytes`` of text each, or one longer row."""
    _, offsets = column_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most_bytes, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def word_places(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of split_words begin and end in the column's bytes."""
    is_word, _ = _tables(separators)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = is_word[data]
    edge = inside[1:] & ~inside[:-1]
    stop = ~inside[1:] & inside[:-1]
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[inside[cuts + 1] & inside[cuts]]
    edge[cuts] = True
    stop[cuts] = True
    return np.flatnonzero(edge), np.flatnonzero(stop)


def stem_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lengths: range) -> list[np.ndarray]:
    """Hashes of the first ``length`` bytes of each word, for each length, A-Z lower-cased; what a
    shorter word gets has no meaning."""
    _, values = _tables(b"")
    at = np.zeros(len(begin), np.uint64)
    out = []
    power, _ = _powers(PIECE)
    for k in range(lengths.stop - 1):
        at = at + values[data[np.minimum(begin + k, len(data) - 1)]] * power[k]
        if k + 1 in lengths:
            out.append(mix(at))
    return out
