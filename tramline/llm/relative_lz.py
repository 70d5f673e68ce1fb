"""Repeated windows of words by relative Lempel-Ziv parsing.

The whole corpus is the reference. In every window of ``WINDOW`` words the ``SEED`` words with
the least hash (the first of equals) are its seed: equal windows have the same seed in the
same place. The windows of one seed are a phrase. Like phrases of a part of the texts are one
record with all their places, so a very common passage is a few records of each task. Phrases
are dealt by their seed to reference blocks, and only those whose seed stands twice or more in
the corpus meet there.

A phrase that stands twice is one factor. In its block each other phrase is parsed greedily from the left. The index of a block is the sorted
order of all phrases from each place on, so the longest match of a phrase at a place is with a
neighbour in that order. A match of ``WINDOW`` words or more is a factor and becomes a
duplicate span. The parse then goes on at the window that crosses the factor's end: a copy that
begins inside one factor and goes on past it is found in another source. A place without a
factor is stepped over by one word.

A block knows how often each seed stands in the corpus. Seeds of more than ``HOT`` records,
and seeds whose phrases lie in more than one task, are left to a second way that holds no
group together: like phrases are counted, combined before the shuffle, and those counted twice
are duplicate spans; of the unlike ones the windows are counted alike. Both ways are exact but for 64-bit hashes of
seeds and 48-bit hashes of windows within one seed.

Defined cases: null, empty and short texts lose nothing; rows that share an id are documents of
their own, equal rows copies of each other; null ids are kept; an empty table gives no rows;
other columns are not looked at. Texts count whole; a task needs memory of some ten times its
longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import shingles
from tramline.llm.common import WORD, kept, table

WINDOW, SEED = 35, 8
PLACES = WINDOW - SEED + 1       # places a seed can have in a window
HOT = 4096
ROWS_A_BLOCK = 1 << 16
HASH_BYTES = 6

BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

PLACE = "struct<row:bigint,ats:array<bigint>>"
SEEDS = "seed bigint, n bigint, records bigint"
PHRASES = f"seed bigint, ahead int, windows binary, times bigint, held array<{PLACE}>"
FOUND = f"row bigint, ats array<bigint>, size bigint, seed bigint, windows binary, times bigint, held array<{PLACE}>"
CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
HELD = pa.list_(pa.struct([("row", pa.int64()), ("ats", pa.list_(pa.int64()))]))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each ``width`` neighbouring values, the first of equals."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    least, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        a, b = least[:-step], least[step:]
        least, reach = np.where(values[a] <= values[b], a, b), reach + step
    return least


def phrases_of(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per phrase: seed, hash, row, first window, seed's distance from it, number of windows; all windows' hashes.

    ``words`` are hashes of the words of several texts, ``row`` the text of each.
    """
    count = len(words) - WINDOW + 1
    if count < 1:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, *[np.int64] * 4, np.uint64))
    powers = np.multiply.accumulate(np.full(len(words), BASE))
    back = np.multiply.accumulate(np.full(len(words), INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    seeds = shingles.mixed((sums[SEED:] - sums[:-SEED]) * back[:len(words) - SEED + 1])
    least = first_least(seeds, PLACES)
    inside = np.flatnonzero(row[:count] == row[WINDOW - 1:])
    place = least[inside]
    first = np.flatnonzero(np.diff(place, prepend=-1))
    at, sizes = inside[first], np.diff(first, append=len(inside))
    windows = shingles.mixed((sums[WINDOW:][inside] - sums[:-WINDOW][inside]) * back[inside])
    whole = shingles.mixed((sums[at + sizes + WINDOW - 1] - sums[at]) * back[at] + sizes.astype(np.uint64))
    return seeds[place[first]], whole, row[at], at, place[first] - at, sizes, windows


def parts_of(batches: Iterator[pa.RecordBatch]):
    """Parts of the batches (row, text) with the words' hashes, their rows and each row's first word."""
    for batch in batches:
        for part in shingles.slices(batch, 1, 1 << 21):
            values, offsets = shingles.buffers(part.column(1))
            words, row = shingles.word_hashes(values, offsets, letters=shingles.EXACT)
            yield part, words, row, np.searchsorted(row, np.arange(len(part)))


def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each seed stands in a part of the texts, and in how many unlike phrases."""
    for _, words, row, _ in parts_of(batches):
        seeds, whole, *_ = phrases_of(words, row)
        unlike, first, n = np.unique(whole, return_index=True, return_counts=True)
        named, of, records = np.unique(seeds[first], return_inverse=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([
            pa.array(named.view(np.int64)), pa.array(np.bincount(of, n, len(named)).astype(np.int64)),
            pa.array(records.astype(np.int64))], names=["seed", "n", "records"])


def listed(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)


def phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each unlike phrase of a part of the texts, with all its places."""
    for part, words, row, begin in parts_of(batches):
        seeds, whole, of, at, ahead, sizes, windows = phrases_of(words, row)
        order = np.lexsort((at, of, whole))
        new = np.diff(whole[order].view(np.int64), prepend=0) != 0
        new[:1] = True
        other = new | (np.diff(of[order], prepend=-1) != 0)
        records, places = np.flatnonzero(new), np.flatnonzero(other)
        ats = listed(pa.array((at - begin[of])[order]), np.append(places, len(order)))
        held = listed(pa.StructArray.from_arrays(
            [part.column(0).take(pa.array(of[order][places])), ats], names=["row", "ats"]),
            np.searchsorted(places, np.append(records, len(order))))
        first = order[records]
        n, starts = sizes[first], (np.cumsum(sizes) - sizes)[first]
        ends = np.concatenate([[0], np.cumsum(n)])
        own = windows[np.arange(ends[-1]) - np.repeat(ends[:-1] - starts, n)]
        short = np.ascontiguousarray(own.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
        packed = pa.Array.from_buffers(pa.large_binary(), len(n), [
            None, pa.py_buffer((ends * HASH_BYTES).astype(np.int64)), pa.py_buffer(short)])
        yield pa.RecordBatch.from_arrays([
            pa.array(seeds[first].view(np.int64)), pa.array(ahead[first].astype(np.int32)), packed.cast(pa.binary()),
            pa.array(np.diff(np.append(records, len(order)))), held], names=["seed", "ahead", "windows", "times", "held"])


def longest_matches(grid: np.ndarray) -> np.ndarray:
    """For each row and place, how many places on from there some other row agrees (0: absent).

    Rows are sorted by what stands from the place on; the longest match is with a neighbour.
    """
    longest = np.zeros(grid.shape, np.int8)
    rank = np.zeros(len(grid), np.int64)
    for c in range(grid.shape[1] - 1, -1, -1):
        order = np.lexsort((rank, grid[:, c]))
        a, b = order[:-1], order[1:]
        equal = (grid[a, c] == grid[b, c]) & (grid[a, c] != 0)
        rank = rank.copy()
        rank[order] = np.cumsum(np.concatenate([[True], (grid[a, c] != grid[b, c]) | (rank[a] != rank[b])]))
        pair = np.flatnonzero(equal)
        run = np.zeros(len(a), np.int8)
        for k in range(c, grid.shape[1]):
            pair = pair[(grid[a[pair], k] == grid[b[pair], k]) & (grid[a[pair], k] != 0)]
            if not len(pair):
                break
            run[pair] += 1
        longest[a, c] = run
        longest[b, c] = np.maximum(longest[b, c], run)
    return longest


def factors(grid: np.ndarray, first: np.ndarray, sizes: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, ...]:
    """The greedy parse of each row: (row, place, windows) of its factors; rows that stand ``twice`` are one."""
    longest = longest_matches(grid)
    rows, place, end = np.arange(len(grid)), first.copy(), first + sizes
    out: list[tuple] = []
    while len(rows):
        n = np.where(twice[rows], sizes[rows], longest[rows, place].astype(np.int64))
        hit = n > 0
        out.append((rows[hit], place[hit], n[hit]))
        place = place + np.maximum(n, 1)
        on = place < end[rows]
        rows, place = rows[on], place[on]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def parse_block(block: pa.RecordBatch, whole: np.ndarray) -> pa.RecordBatch:
    """Spans of the phrases in ``whole``; the other phrases as they are, for the second way."""
    own, rest = block.filter(pa.array(whole)), block.filter(pa.array(~whole))
    packed = own.column("windows").cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    ends = np.frombuffer(offsets, np.int64)[packed.offset:packed.offset + len(packed) + 1]
    hashes = np.zeros(((ends[-1] - ends[0]) // HASH_BYTES, 8), np.uint8)
    hashes[:, :HASH_BYTES] = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]].reshape(-1, HASH_BYTES)
    sizes = np.diff(ends) // HASH_BYTES
    first = PLACES - 1 - own.column("ahead").to_numpy().astype(np.int64)
    # The upper bits number the seed from 1 (a block has fewer seeds than these count); 0 is no window.
    seeds = np.unique(own.column("seed").to_numpy(), return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(len(own)), sizes)
    grid = np.zeros((len(own), PLACES), np.uint64)
    grid[of, np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes - first, sizes)] = (
        hashes.view(np.uint64)[:, 0] | seeds[of] << np.uint64(8 * HASH_BYTES))
    record, place, n = factors(grid, first, sizes, own.column("times").to_numpy() > 1)
    # A factor is a span in every row of its record.
    held = own.column("held").take(pa.array(record))
    places = held.flatten()
    many = np.diff(held.offsets.to_numpy())
    ats = places.field("ats")
    moved = np.repeat(np.repeat(place - first[record], many), np.diff(ats.offsets.to_numpy()))
    spans = len(places)
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([places.field("row"), pa.nulls(len(rest), pa.int64())]),
        pa.concat_arrays([listed(pa.array(ats.flatten().to_numpy() + moved), ats.offsets.to_numpy() - ats.offsets[0].as_py()),
                          pa.nulls(len(rest), pa.list_(pa.int64()))]),
        pa.concat_arrays([pa.array(np.repeat(n + WINDOW - 1, many)), pa.nulls(len(rest), pa.int64())]),
        *[pa.concat_arrays([pa.nulls(spans, c.type), c]) for c in (rest.column(x) for x in ("seed", "windows", "times", "held"))]],
        names=["row", "ats", "size", "seed", "windows", "times", "held"])


def parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parses phrases (PHRASES, n, records) in blocks of whole seeds, as they come sorted by seed."""
    held: list[pa.RecordBatch] = []

    def done(block: pa.RecordBatch) -> pa.RecordBatch:
        seeds, of = np.unique(block.column("seed").to_numpy(), return_inverse=True)
        there = np.bincount(of, block.column("times").to_numpy(), len(seeds)).astype(np.int64)
        return parse_block(block, there[of] == block.column("n").to_numpy())

    for batch in batches:
        hot = batch.column("records").to_numpy() > HOT
        if hot.any():
            yield parse_block(batch.filter(pa.array(hot)), np.zeros(int(hot.sum()), bool))
            batch = batch.filter(pa.array(~hot))
        held.append(batch)
        if sum(map(len, held)) >= ROWS_A_BLOCK:
            block = pa.concat_batches(held)
            seeds = block.column("seed").to_numpy()
            cut = int(np.flatnonzero(seeds != seeds[-1])[-1]) + 1 if (seeds != seeds[-1]).any() else 0
            held = [block.slice(cut)]
            if cut:
                yield done(block.slice(0, cut))
    if sum(map(len, held)):
        yield done(pa.concat_batches(held))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(row, ats, size): spans of repeated windows in rows (row, text), of one size at some places; they may overlap."""
    twice = rows.mapInArrow(seed_rows, SEEDS).groupBy("seed").agg(
        F.sum("n").alias("n"), F.sum("records").alias("records")).filter("n > 1")
    # A merge join brings each seed's phrases sorted into one task; skewed ones may be split.
    found = kept(
        rows.mapInArrow(phrase_rows, PHRASES).join(twice.hint("shuffle_merge"), "seed").mapInArrow(parse_blocks, FOUND),
        "factors")
    rest = found.filter("windows is not null").select("seed", "windows", "times", "held")
    return found.filter("windows is null").select("row", "ats", "size").unionByName(counted_spans(rest))


def counted_spans(rest: DataFrame) -> DataFrame:
    """The second way, for phrases (seed, windows, times, held): their spans from counts.

    Phrases that stand twice are spans whole. Each unlike phrase brings its windows once.
    """
    size = F.expr(f"cast(octet_length(windows) div {HASH_BYTES} as int)")
    # The only place of a phrase that stands once goes along.
    unlike = rest.groupBy("seed", "windows").agg(
        F.sum("times").alias("n"), F.min(F.col("held")[0]["row"]).alias("row"), F.min(F.col("held")[0]["ats"][0]).alias("at"))
    whole = rest.join(unlike.filter("n > 1").select("seed", "windows"), ["seed", "windows"], "left_semi").select(
        (size + WINDOW - 1).cast("bigint").alias("size"), F.explode("held").alias("place")).select(
        "place.row", "place.ats", "size")
    windows = unlike.select("row", "at", "seed", "n", F.posexplode(F.transform(
        F.sequence(F.lit(0), size - 1), lambda i: F.substring("windows", i * HASH_BYTES + 1, HASH_BYTES))).alias("on", "window"))
    often = windows.groupBy("seed", "window").agg(F.count(F.lit(1)).alias("phrases")).filter("phrases > 1").select("seed", "window")
    single = windows.filter("n = 1").join(often, ["seed", "window"], "left_semi").select(
        "row", F.array(F.col("at") + F.col("on")).alias("ats"), F.lit(WINDOW).cast("bigint").alias("size"))
    return whole.unionByName(single)


def cleaned_rows(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    """Texts without the words in their spans."""
    for batch in batches:
        out: list[tuple] = []
        for i in range(len(batch)):
            words = (batch.column(1)[i].as_py() or "").encode().split()
            spans, gone = batch.column(2)[i], np.zeros(len(words) + 1, np.int64)
            if spans.is_valid and len(spans.values):
                ats = spans.values.field("ats")
                at = ats.flatten().to_numpy()
                np.add.at(gone, at, 1)
                np.add.at(gone, at + np.repeat(spans.values.field("size").to_numpy(), np.diff(ats.offsets.to_numpy())), -1)
                stay = np.cumsum(gone)[:-1] == 0
                left = [w for w, s in zip(words, stay.tolist()) if s]
            else:
                left = words
            text = b" ".join(left)
            out.append((batch.column(0)[i].as_py(), len(words), len(words) - len(left),
                        hashlib.sha256(text).hexdigest(), *([text.decode()] if texts else [])))
        columns = list(zip(*out)) or [[]] * (5 if texts else 4)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 3, *[pa.string()] * 2])],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][:len(columns)])


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", texts: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, the words kept, joined by one space."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).withColumn(
        "row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.select("row", "text")).groupBy("row").agg(
        F.collect_set(F.struct("ats", "size")).alias("spans"))
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(
        lambda b: cleaned_rows(b, texts), CLEANED + (", kept_text string" if texts else ""))


def op11_relative_lz(spark, folder: str) -> DataFrame:
    return without_repeats(table(spark, folder, "documents"))


SQL = rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents
), singles AS (
  SELECT doc, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts
), windows AS (
  SELECT doc, place, md5(string_agg(word, ' ') OVER following) AS held, count(*) OVER following AS n
  FROM singles WINDOW following AS (PARTITION BY doc ORDER BY place ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)
), repeated AS (
  SELECT doc, place FROM windows WHERE n = {WINDOW}
    AND held IN (SELECT held FROM windows WHERE n = {WINDOW} GROUP BY held HAVING count(*) > 1)
), marked AS (
  SELECT s.doc, s.place, s.word, count(r.place) OVER (
    PARTITION BY s.doc ORDER BY s.place ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) > 0 AS gone
  FROM singles s LEFT JOIN repeated r ON s.doc = r.doc AND s.place = r.place
), left_over AS (
  SELECT doc, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS kept
  FROM marked GROUP BY doc
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN left_over USING (doc)
"""
