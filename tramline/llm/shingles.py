"""Sets of word shingles as 64-bit hashes, computed for whole Arrow columns at once.

Texts are lower-cased in A-Z only; words are runs of anything but ASCII white space. A text
of fewer words than a shingle has its whole word sequence as one. Equal hashes count as equal
shingles. Bytes are hashed in blocks that end at white space, so the memory for a long text
is a few times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
BLOCK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
EXACT = np.arange(256, dtype=np.uint64) + np.uint64(1)
LOWER = EXACT.copy()
LOWER[65:91] += np.uint64(32)
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = np.array([0xBF58476D1CE4E5B9 + 2 * k * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
                   for k in range(64)], dtype=np.uint64) | np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (the splitmix64 finish)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, null as empty, and the offsets of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, values = column.buffers()
    places = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, np.uint8), places


def word_hashes(values: np.ndarray, offsets: np.ndarray, block: int = BLOCK,
                letters: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the row it is in, in order."""
    hashes, starts = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + block)
        while stop < end:
            row_start = offsets[np.searchsorted(offsets, stop, side="right") - 1]
            spaces = np.flatnonzero(SPACE[values[max(at, row_start):stop]])
            if row_start > at:
                stop = int(row_start)
                break
            if len(spaces):
                stop = max(at, int(row_start)) + int(spaces[-1]) + 1
                break
            stop = min(end, stop + block)
        data = values[at:stop]
        space = SPACE[data]
        begin = ~space
        begin[1:] &= space[:-1] | row_begins(offsets, at, stop)[1:]
        first = np.flatnonzero(begin)
        if len(first):
            body = np.flatnonzero(~space)
            run = np.cumsum(begin[body]) - 1
            place = body - first[run]
            powers = np.multiply.accumulate(np.full(int(place.max()) + 1, BASE, dtype=np.uint64))
            hashes.append(mixed(np.add.reduceat(
                letters[data[body]] * powers[place], np.flatnonzero(begin[body]))))
            starts.append(first + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = np.searchsorted(offsets, np.concatenate(starts), side="right") - 1
    return np.concatenate(hashes), rows


def row_begins(offsets: np.ndarray, at: int, stop: int) -> np.ndarray:
    marks = np.zeros(stop - at, dtype=bool)
    inside = offsets[(offsets >= at) & (offsets < stop)]
    marks[inside - at] = True
    return marks


def sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each row, and where each row's begin."""
    values, offsets = buffers(column)
    hashed, row = word_hashes(values, offsets)
    many = np.bincount(row, minlength=len(column)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(many)])
    sizes = np.where(many >= words, many - words + 1, (many > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(begin[-1]), dtype=np.uint64)
    if len(hashed) >= words:
        count = len(hashed) - words + 1
        total = np.zeros(count, dtype=np.uint64)
        for k in range(words):
            total += hashed[k:k + count] * PLACES[k]
        whole = row[:count] == row[words - 1:]
        own = row[:count][whole]
        out[begin[own] + np.flatnonzero(whole) - first[own]] = mixed(total[whole])
    short = np.flatnonzero((many > 0) & (many < words))
    for i in short:
        own = hashed[first[i]:first[i + 1]]
        padded = np.append(own * PLACES[:len(own)], PLACES[32 + len(own)])
        out[begin[i]] = mixed(np.add.reduce(padded, keepdims=True))[0]
    for i in np.flatnonzero(sizes > 1):
        out[begin[i]:begin[i + 1]].sort()
    of = np.repeat(np.arange(len(column)), sizes)
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (of[1:] != of[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(of[new], minlength=len(column)))]).astype(np.int64)


def slices(batch: pa.RecordBatch, place: int, size: int = 1 << 22):
    """Parts of a batch whose texts have about ``size`` bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if total + n > size and i > start:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < len(lengths):
        yield batch.slice(start)
