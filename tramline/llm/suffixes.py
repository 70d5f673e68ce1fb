"""Repeated passages by sparse suffix arrays.

Texts are words, lower-cased in A-Z. In every stretch (window) of ``LEAST`` words the ``GRAM``
words with the least hash are kept (minimisers, the first of equals): the choice follows the
content, so equal windows keep the same suffix in the same place. A kept suffix carries the
hashes of the windows it was kept for, so its context on both sides as far as it matters. Like
suffixes of one document are one entry with all their places and take up one place among the
neighbours. Suffixes whose first gram stands in one document only are dropped.

A task gets whole grams, sorted. There the suffixes of a gram are extended to the left word by
word, from no context to all of it, and at each step sorted by what stands from there to the
right; each is compared with its neighbours, the nearest ones before and after it that are of
other documents, and extended to the right as far as the better one agrees. In that order no
other document can agree further, so no match is missed. Windows that match are joined into
passages where they overlap or touch.

Grams with more than ``MOST`` entries, and grams whose entries lie in more than one task, are
left to a second way that is as exact and holds no group together: their windows' hashes are
grouped over all documents, combined before the shuffle.

Grams are 64-bit hashes and windows 48-bit ones within a gram; equal hashes count as equal words.

Defined cases: null, empty and shorter texts have no passages; documents without an id take
no part; rows that share an id are no partners of each other, and show the union of their
passages; an empty table gives no rows; other columns are not looked at; texts of any length
count whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm import shingles
from tramline.llm.common import WORD, kept, table
from tramline.llm.relative_lz import listed
from tramline.llm.shingles import PLACES, mixed

LEAST, GRAM = 50, 10
CHUNK = 1 << 18

SHARED = LEAST - GRAM + 1       # places a gram can have in a window
MOST = 4096
ROWS_A_BLOCK = 1 << 16
HASH_BYTES = 6
NOBODY = np.iinfo(np.int64).max

GRAMS = "gram bigint, doc_id bigint, n bigint, entries bigint"
SUFFIXES = "gram bigint, doc_id bigint, ahead int, windows binary, times bigint, ats array<bigint>"
FOUND = "doc_id bigint, ats array<bigint>, size bigint, partner bigint, gram bigint, windows binary"


def minimisers(grams: np.ndarray) -> np.ndarray:
    """Place of the least gram of each window of LEAST words, the first of equals."""
    width = LEAST - GRAM + 1
    if len(grams) < width:
        return np.zeros(0, np.int64)
    picked = []
    for at in range(0, len(grams) - width + 1, CHUNK):
        part = grams[at:at + CHUNK + width - 1]
        windows = np.lib.stride_tricks.sliding_window_view(part, width)
        picked.append(windows.argmin(axis=1) + np.arange(at, at + len(windows)))
    return np.concatenate(picked)


def summed(hashes: np.ndarray, n: int, step: int = 1) -> np.ndarray:
    """Hash of each n values that stand ``step`` apart."""
    count = max(0, len(hashes) - (n - 1) * step)
    total = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        total += hashes[k * step:k * step + count] * PLACES[k]
    return mixed(total)


def suffixes_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram, place and first window of one text's kept suffixes, and hashes of all windows."""
    grams = summed(hashes, GRAM)
    places, starts = np.unique(minimisers(grams), return_index=True)
    return grams[places], places, starts, summed(grams, LEAST // GRAM, GRAM)


def entries_of(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unlike suffixes of one text: gram, places, number of windows, first window's place in ``held``
    and all its places (sorted by suffix, with their ends); and the windows' hashes."""
    grams, places, starts, held = suffixes_of(hashes)
    sizes = np.diff(starts, append=len(held))
    step = np.arange(len(held)) - np.repeat(starts, sizes)
    whole = np.add.reduceat(mixed(held + step.astype(np.uint64) * shingles.BASE), starts)
    order = np.lexsort((starts, whole))
    new = np.flatnonzero(np.concatenate([[True], np.diff(whole[order].view(np.int64)) != 0]))
    first = order[new]
    return grams[first], places[first] - starts[first], sizes[first], starts[first], starts[order], np.append(new, len(order)), held


def suffix_rows(batches: Iterator[pa.RecordBatch], windows: bool) -> Iterator[pa.RecordBatch]:
    """A document's unlike suffixes (SUFFIXES) or, without ``windows``, how often its grams head one (GRAMS)."""
    for batch in batches:
        for part in shingles.slices(batch, 1, 1 << 21):
            values, offsets = shingles.buffers(part.column(1))
            hashed, row = shingles.word_hashes(values, offsets)
            first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(part)))])
            out: list[tuple] = []
            for i, key in enumerate(part.column(0).to_pylist()):
                if key is None or first[i + 1] - first[i] < LEAST:
                    continue
                grams, ahead, sizes, at, ats, ends, held = entries_of(hashed[first[i]:first[i + 1]])
                times = np.diff(ends)
                if windows:
                    packed = held[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes - at, sizes)]
                    out.append((grams, np.full(len(grams), key), ahead, sizes, packed, times, ats))
                else:
                    named, of, entries = np.unique(grams, return_inverse=True, return_counts=True)
                    out.append((named, np.full(len(named), key), np.bincount(of, times).astype(np.int64), entries))
            if not out:
                continue
            columns = [np.concatenate(c) for c in zip(*out)]
            if not windows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0].view(np.int64)), *[pa.array(c.astype(np.int64)) for c in columns[1:]]],
                    names=["gram", "doc_id", "n", "entries"])
                continue
            grams, docs, ahead, sizes, packed, times, ats = columns
            short = np.ascontiguousarray(packed.view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
            ends = np.concatenate([[0], np.cumsum(sizes)]) * HASH_BYTES
            held = pa.Array.from_buffers(pa.large_binary(), len(sizes), [
                None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(short)])
            yield pa.RecordBatch.from_arrays([
                pa.array(grams.view(np.int64)), pa.array(docs.astype(np.int64)), pa.array(ahead.astype(np.int32)),
                held.cast(pa.binary()), pa.array(times.astype(np.int64)),
                listed(pa.array(ats.astype(np.int64)), np.concatenate([[0], np.cumsum(times)]))],
                names=["gram", "doc_id", "ahead", "windows", "times", "ats"])


def agreed(grid: np.ndarray, a: np.ndarray, b: np.ndarray, place: int) -> np.ndarray:
    """How many places on from ``place`` rows a and b have the same windows."""
    run, pair = np.zeros(len(a), np.int8), np.arange(len(a))
    for k in range(place, grid.shape[1]):
        pair = pair[(grid[a[pair], k] == grid[b[pair], k]) & (grid[a[pair], k] != 0)]
        if not len(pair):
            break
        run[pair] += 1
    return run


def longest_elsewhere(grid: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row and place, how many places on from there a row of another document agrees.

    Rows are sorted by what stands from the place on. The further two rows are apart in that
    order the less they agree, so the nearest rows of other documents on both sides decide.
    """
    longest = np.zeros(grid.shape, np.int8)
    rank = np.zeros(len(grid), np.int64)
    for c in range(grid.shape[1] - 1, -1, -1):
        order = np.lexsort((docs, rank, grid[:, c]))
        a, b = order[:-1], order[1:]
        new = np.concatenate([[True], (grid[a, c] != grid[b, c]) | (rank[a] != rank[b])])
        rank = rank.copy()
        rank[order] = np.cumsum(new)
        # Neighbours of the same document are a run; the rows beside the run are of others.
        runs = np.flatnonzero(np.concatenate([[True], docs[a] != docs[b]]))
        sizes = np.diff(runs, append=len(order))
        before, after = np.repeat(runs - 1, sizes), np.repeat(runs + sizes, sizes)
        for beside in (before, after):
            there = np.flatnonzero((beside >= 0) & (beside < len(order)))
            own = order[there]
            longest[own, c] = np.maximum(longest[own, c], agreed(grid, own, order[beside[there]], c))
    return longest


def partners(windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each window the least other document that has it; NOBODY if none has."""
    _, of = np.unique(windows, return_inverse=True)
    least, second = (np.full(int(of.max(initial=-1)) + 1, NOBODY) for _ in range(2))
    np.minimum.at(least, of, docs)
    other = docs != least[of]
    np.minimum.at(second, of[other], docs[other])
    return np.where(other, least[of], second[of])


def match_block(block: pa.RecordBatch, whole: np.ndarray) -> pa.RecordBatch:
    """Spans of the suffixes in ``whole``; the other suffixes as they are, for the second way."""
    own, rest = block.filter(pa.array(whole)), block.filter(pa.array(~whole))
    packed = own.column("windows").cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    ends = np.frombuffer(offsets, np.int64)[packed.offset:packed.offset + len(packed) + 1]
    hashes = np.zeros(((ends[-1] - ends[0]) // HASH_BYTES, 8), np.uint8)
    hashes[:, :HASH_BYTES] = np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]].reshape(-1, HASH_BYTES)
    sizes = np.diff(ends) // HASH_BYTES
    begin = np.cumsum(sizes) - sizes
    # The gram stands in one column: left context grows with the places before it.
    first = SHARED - 1 - own.column("ahead").to_numpy().astype(np.int64)
    docs = own.column("doc_id").to_numpy()
    # The upper bits number the gram from 1 (a block has fewer grams than these count); 0 is no window.
    grams = np.unique(own.column("gram").to_numpy(), return_inverse=True)[1].astype(np.uint64) + np.uint64(1)
    of = np.repeat(np.arange(len(own)), sizes)
    ids = hashes.view(np.uint64)[:, 0] | grams[of] << np.uint64(8 * HASH_BYTES)
    grid = np.zeros((len(own), SHARED), np.uint64)
    grid[of, np.arange(len(ids)) - np.repeat(begin - first, sizes)] = ids
    longest = longest_elsewhere(grid, docs)
    partner = partners(ids, docs[of])
    rows, place, end = np.arange(len(own)), first.copy(), first + sizes
    out: list[tuple] = []
    while len(rows):
        n = longest[rows, place].astype(np.int64)
        out.append((rows[n > 0], place[n > 0], n[n > 0]))
        place = place + np.maximum(n, 1)
        on = place < end[rows]
        rows, place = rows[on], place[on]
    row, place, n = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    at = begin[row] + place - first[row]
    bounds = np.stack([at, at + n], axis=1).ravel()
    least = np.minimum.reduceat(np.append(partner, NOBODY), bounds)[::2] if len(row) else np.zeros(0, np.int64)
    ats = own.column("ats").take(pa.array(row))
    moved = ats.flatten().to_numpy() + np.repeat(place - first[row], np.diff(ats.offsets.to_numpy()))
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array(docs[row]), rest.column("doc_id")]),
        pa.concat_arrays([listed(pa.array(moved), ats.offsets.to_numpy() - ats.offsets[0].as_py()), rest.column("ats")]),
        pa.concat_arrays([pa.array(n + LEAST - 1), pa.nulls(len(rest), pa.int64())]),
        pa.concat_arrays([pa.array(least), pa.nulls(len(rest), pa.int64())]),
        *[pa.concat_arrays([pa.nulls(len(row), c.type), c]) for c in (rest.column("gram"), rest.column("windows"))]],
        names=["doc_id", "ats", "size", "partner", "gram", "windows"])


def match_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares suffixes (SUFFIXES, n, entries) in blocks of whole grams, as they come sorted by gram."""
    held: list[pa.RecordBatch] = []

    def done(block: pa.RecordBatch) -> pa.RecordBatch:
        grams, of = np.unique(block.column("gram").to_numpy(), return_inverse=True)
        there = np.bincount(of, block.column("times").to_numpy(), len(grams)).astype(np.int64)
        return match_block(block, there[of] == block.column("n").to_numpy())

    for batch in batches:
        many = batch.column("entries").to_numpy() > MOST
        if many.any():
            yield match_block(batch.filter(pa.array(many)), np.zeros(int(many.sum()), bool))
            batch = batch.filter(pa.array(~many))
        held.append(batch)
        if sum(map(len, held)) >= ROWS_A_BLOCK:
            block = pa.concat_batches(held)
            grams = block.column("gram").to_numpy()
            cut = int(np.flatnonzero(grams != grams[-1])[-1]) + 1 if (grams != grams[-1]).any() else 0
            held = [block.slice(cut)]
            if cut:
                yield done(block.slice(0, cut))
    if sum(map(len, held)):
        yield done(pa.concat_batches(held))


def counted_spans(rest: DataFrame) -> DataFrame:
    """The second way, for suffixes (doc_id, ats, gram, windows): windows that two documents hold.

    Each unlike suffix brings its windows once, with its least two documents; the stretches of
    it that are shared then meet its entries.
    """
    like = ["gram", "windows"]
    least = rest.groupBy(*like).agg(F.min("doc_id").alias("least"))
    unlike = rest.join(least, like).groupBy(*like, "least").agg(
        F.min(F.when(F.col("doc_id") != F.col("least"), F.col("doc_id"))).alias("next"))
    held = kept(unlike.select(*like, "least", "next", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.expr(f"cast(octet_length(windows) div {HASH_BYTES} as int) - 1")),
        lambda i: F.substring("windows", i * HASH_BYTES + 1, HASH_BYTES))).alias("on", "window")), "windows")
    by = ["gram", "window"]
    first = held.groupBy(*by).agg(F.min("least").alias("first"))
    shared = held.join(first, by).groupBy(*by, "first").agg(F.min(
        F.when(F.col("least") != F.col("first"), F.col("least")).otherwise(F.col("next"))).alias("second")).filter("second is not null")
    # Windows that follow one another are a stretch; its least document, and the least one beside that.
    place = W.partitionBy(*like).orderBy("on")
    stretches = (
        held.select(*like, "on", "window").join(shared, by)
        .withColumn("stretch", F.col("on") - F.row_number().over(place)).groupBy(*like, "stretch")
        .agg(F.min("on").alias("on"), F.count(F.lit(1)).alias("n"), F.min("first").alias("least"),
             F.collect_list(F.struct("first", "second")).alias("both"))
        .withColumn("other", F.array_min(F.transform("both", lambda w: F.when(
            w["first"] == F.col("least"), F.least(w["second"], F.lit(NOBODY))).otherwise(w["first"]))))
    )
    return rest.join(stretches, like).select(
        "doc_id", F.transform("ats", lambda at: at + F.col("on")).alias("ats"), (F.col("n") + LEAST - 1).alias("size"),
        F.when(F.col("doc_id") == F.col("least"), F.col("other")).otherwise(F.col("least")).alias("partner"))


def passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, stop, n_words, partner): repeated stretches of words (from 0, end
    exclusive), not overlapping, and the least other document that holds a part of each."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    shared = rows.mapInArrow(lambda b: suffix_rows(b, False), GRAMS).groupBy("gram").agg(
        F.sum("n").alias("n"), F.sum("entries").alias("entries"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
    ).filter("least < most").select("gram", "n", "entries")
    # A merge join brings each gram's suffixes sorted into one task; skewed ones may be split.
    found = kept(
        rows.mapInArrow(lambda b: suffix_rows(b, True), SUFFIXES).join(shared.hint("shuffle_merge"), "gram")
        .mapInArrow(match_blocks, FOUND), "matches")
    spans = found.filter("windows is null").select("doc_id", "ats", "size", "partner").unionByName(
        counted_spans(found.filter("windows is not null").select("doc_id", "ats", "gram", "windows")))
    matches = spans.select("doc_id", F.explode("ats").alias("start"), "size", "partner").select(
        "doc_id", "start", (F.col("start") + F.col("size")).alias("stop"), "partner")
    order = W.partitionBy("doc_id").orderBy("start", "stop")
    new = F.coalesce(F.col("start") > F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    return (
        matches.withColumn("new", new.cast("int"))
        .withColumn("passage", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy("doc_id", "passage")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("partner").alias("partner"))
        .select("doc_id", "start", "stop", (F.col("stop") - F.col("start")).alias("n_words"), "partner")
    )


def op4_suffix_passages(spark, folder: str) -> DataFrame:
    return passages(table(spark, folder, "documents"))


SQL = rf"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(
    coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents WHERE doc_id IS NOT NULL
), singles AS (
  SELECT doc, doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS place FROM texts
), windows AS (
  SELECT doc_id, place, md5(string_agg(word, ' ') OVER following) AS held, count(*) OVER following AS n
  FROM singles WINDOW following AS (PARTITION BY doc ORDER BY place ROWS BETWEEN CURRENT ROW AND {LEAST - 1} FOLLOWING)
), whole AS MATERIALIZED (
  SELECT doc_id, place, held FROM windows WHERE n = {LEAST}
), shared AS (
  SELECT held, min(doc_id) AS least FROM whole GROUP BY held HAVING min(doc_id) < max(doc_id)
), seconds AS (
  SELECT held, min(doc_id) AS second FROM whole JOIN shared USING (held) WHERE doc_id <> least GROUP BY held
), hits AS (
  SELECT doc_id, place, min(CASE WHEN doc_id = least THEN second ELSE least END) AS partner
  FROM whole JOIN shared USING (held) JOIN seconds USING (held) GROUP BY doc_id, place
), marked AS (
  SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + {LEAST} THEN 0 ELSE 1 END AS fresh FROM hits
), passages AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY place) AS passage FROM marked
)
SELECT doc_id, min(place) AS start, max(place) + {LEAST} AS stop, max(place) + {LEAST} - min(place) AS n_words, min(partner) AS partner
FROM passages GROUP BY doc_id, passage
"""
