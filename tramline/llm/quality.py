r"""Quality rules: plain counts of a text, and a perplexity band for its language.

The language model is a modified Kneser-Ney model of character 4-grams for each language.
Characters fall into 64 classes (letters, digits and marks apart, capitals in 8, letters beyond
ASCII in 13), so a language has 2**24 grams at most: that bounds the model whatever the size
of the corpus. Spark counts the grams of all documents that pass the plain rules and simple
character rules over their whole texts; estimates are kept as sorted arrays of gram codes with
their values, looked up by binary search.

Each document gets its perplexity per character. For each language, quartiles over all
documents that pass the plain rules give a middle and a spread (of the logarithm); a document
is rejected when it is more than ``WIDTH`` spreads above or below the middle. The spread is
widened for short texts, by sqrt(1 + SHORT / characters).

Defined cases: null and empty texts have no words and fail; a null language is a language of
its own; languages with fewer than ``LEAST_DOCUMENTS`` passing documents have the band of all
languages together (none, if those have fewer either); texts of any length are counted whole; repeated rows count
each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm import shingles
from tramline.llm.common import kept, table, text_of
from tramline.llm.shingles import mixed

LEAST_WORDS, MOST_REPEATED = 50, (50, 100)
ORDER, BITS = 4, 6
CLASSES = 1 << BITS
DIGIT, CAPITAL, OTHER, BEYOND = 27, 37, 50, 51   # first class of each kind
WIDTH, SHORT, LEAST_DOCUMENTS = 8.0, 2000, 30
SYMBOLS, CAPITALS = 0.05, 0.3      # largest shares of characters in texts that are learned from
SYMBOL_BYTES = b"#*$%&|<>"
SLICE = 1 << 21
TABLES = 8

COUNTS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, base_failed boolean")
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


# --- plain counts ---------------------------------------------------------------------


def repeated_words(hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per row, words that stand in a window of three words found twice or more in it."""
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= 3:
        window = mixed(hashes[:-2] * shingles.PLACES[0] + hashes[1:-1] * shingles.PLACES[1]
                       + hashes[2:] * shingles.PLACES[2])
        window = window ^ mixed(row[:-2].astype(np.uint64) + np.uint64(77))
        whole = row[:-2] == row[2:]
        window[~whole] = np.flatnonzero(~whole).astype(np.uint64)
        order = np.argsort(window)
        ranked = window[order]
        same = np.zeros(len(ranked), dtype=bool)
        same[1:] = ranked[1:] == ranked[:-1]
        same[:-1] |= ranked[1:] == ranked[:-1]
        twice = np.zeros(len(window), dtype=bool)
        twice[order] = same
        twice &= whole
        for k in range(3):
            covered[k:len(window) + k] |= twice
    return np.bincount(row[covered], minlength=rows)


def duplicate_lines(text: str | None) -> int:
    if not text or "\n" not in text:
        return 0
    lines = [line for line in text.split("\n") if line.strip(" \t\n\r\v\f")]
    return len(lines) - len(set(lines))


def plain_counts(column: pa.Array) -> dict[str, np.ndarray]:
    values, offsets = shingles.buffers(column)
    rows = len(column)
    hashes, row = shingles.word_hashes(values, offsets, letters=shingles.EXACT)
    n_words = np.bincount(row, minlength=rows)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets - offsets[0]])
    data = values[offsets[0]:offsets[-1]]
    table_ = np.zeros(256, dtype=bool)
    table_[list(SYMBOL_BYTES)] = True
    repeats = repeated_words(hashes, row, rows)
    return {
        "n_words": n_words,
        "word_chars": total(~shingles.SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": total(table_[data]),
        "n_dup_lines": np.array([duplicate_lines(t) for t in column.to_pylist()], dtype=np.int64),
        "n_repeat_words": repeats,
        "base_failed": (n_words < LEAST_WORDS) | (MOST_REPEATED[1] * repeats > MOST_REPEATED[0] * n_words),
    }


# --- grams ----------------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each character below 2**16; larger ones are looked up by their low half."""
    out = np.full(1 << 16, OTHER, dtype=np.int32)
    for c in range(128, 1 << 16):
        if chr(c).isalpha():
            out[c] = BEYOND + (c * 2654435761 >> 7) % (CLASSES - BEYOND)
        elif chr(c).isspace():
            out[c] = 0
    for i in range(26):
        out[97 + i], out[65 + i] = 1 + i, CAPITAL + i % 8
    out[48:58] = DIGIT + np.arange(10)
    for text, code in ((" \t\n\r\v\f", 0), (".", 45), (",", 46), ("!?", 47), (";:'\"-()", 48), ("#*$%&|<>", 49)):
        for c in text:
            out[ord(c)] = code
    return out


@functools.lru_cache(maxsize=1)
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of characters below 2**16: capitals, and letters or white space."""
    shown = [chr(c) for c in range(1 << 16)]
    return np.array([c.isupper() for c in shown]), np.array([c.isalpha() or c.isspace() for c in shown])


def grams(text: str) -> Iterator[np.ndarray]:
    """Codes of the 4-grams of a text (runs of white space as one), slice by slice."""
    carry = np.zeros(ORDER - 1, dtype=np.int32)
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        found = classes()[codes & 0xFFFF]
        found = np.concatenate([carry, found])
        new = np.ones(len(found), dtype=bool)
        new[ORDER - 1:] = (found[ORDER - 1:] != 0) | (found[ORDER - 2:-1] != 0)
        found = found[new]
        carry = found[-(ORDER - 1):]
        n = len(found) - ORDER + 1
        if n > 0:
            code = found[:n].copy()
            for k in range(1, ORDER):
                code = (code << BITS) | found[k:n + k]
            yield code


def learned_from(text: str | None, failed: bool) -> bool:
    if failed or not text:
        return False
    capitals = plain = 0
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at:at + SLICE].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        low = codes[codes < 1 << 16]
        capitals += int(kinds()[0][low].sum())
        plain += int(kinds()[1][low].sum()) + len(codes) - len(low)
    return capitals <= CAPITALS * len(text) and plain >= (1 - SYMBOLS - 0.05) * len(text)


def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the documents that are learned from; one row per gram and task."""
    seen: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def settle(lang: str) -> None:
        codes, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
        if lang in seen:
            old, m = seen[lang]
            both, place = np.unique(np.concatenate([old, codes]), return_inverse=True)
            seen[lang] = both, np.bincount(place, np.concatenate([m, n])).astype(np.int64)
        else:
            seen[lang] = codes, n

    for batch in batches:
        for part in shingles.slices(batch, 1):
            failed = plain_counts(part.column(1))["base_failed"]
            for lang, text, bad in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), failed):
                if learned_from(text, bad):
                    for codes in grams(text):
                        waiting.setdefault(lang, []).append(codes)
                        if sum(map(len, waiting[lang][-8:])) > SLICE or len(waiting[lang]) >= 512:
                            settle(lang)
    for lang in list(waiting):
        settle(lang)
    for lang, (codes, n) in seen.items():
        for at in range(0, len(codes), 1 << 17):
            part = codes[at:at + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int64)),
                 pa.array(n[at:at + (1 << 17)].astype(np.int64))], names=["lang", "gram", "n"])


# --- the model ------------------------------------------------------------------------


def discounts(counts: np.ndarray) -> np.ndarray:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more."""
    n = np.bincount(np.minimum(counts, 5), minlength=6).astype(float)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    out = [0.0]
    for k in (1, 2, 3):
        out.append(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k + 1] / n[k])) if n[k] else 0.75 * min(k, 1))
    return np.array(out)


@dataclasses.dataclass
class Model:
    """Sorted gram codes per order with discounted shares, sorted contexts with back-off weights."""

    keys: list[np.ndarray]
    shares: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]

    def chance(self, codes: np.ndarray) -> np.ndarray:
        """Probability of the last character of each full-order gram after the others."""
        out = np.full(len(codes), 1.0 / CLASSES)
        for k in range(1, ORDER + 1):
            own = codes & ((1 << BITS * k) - 1)
            weight = found(self.contexts[k - 1], self.weights[k - 1], own >> BITS, 1.0)
            out = found(self.keys[k - 1], self.shares[k - 1], own, 0.0) + weight * out
        return out


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other) if len(keys) else np.full(len(wanted), other)


def estimated(codes: np.ndarray, counts: np.ndarray) -> Model:
    """The model of a language from its gram counts."""
    order = np.argsort(codes)
    codes, counts = codes[order].astype(np.int64), counts[order]
    levels = [(codes, counts)]
    for k in range(ORDER - 1, 0, -1):   # lower orders count distinct characters before
        levels.insert(0, np.unique(levels[0][0] & ((1 << BITS * k) - 1), return_counts=True))
    model = Model([], [], [], [])
    for keys, n in levels:
        d = discounts(n)
        contexts, place = np.unique(keys >> BITS, return_inverse=True)
        total = np.bincount(place, n)
        off = d[np.minimum(n, 3)]
        model.keys.append(keys)
        model.shares.append((n - off) / total[place])
        model.contexts.append(contexts)
        model.weights.append(np.bincount(place, off) / total)
    return model


def trained(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Model]:
    """A model per language (null as an empty name), counted over all documents."""
    rows = docs.select(text_of(lang).alias("lang"), F.col(text).alias("text"))
    counted = rows.mapInArrow(gram_rows, "lang string, gram bigint, n bigint").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.toArrow().combine_chunks()
    names = np.array(got.column("lang").to_pylist(), dtype=object)
    codes, n = got.column("gram").to_numpy(), got.column("n").to_numpy()
    return {name: estimated(codes[names == name], n[names == name]) for name in sorted(set(names))}


def scored(docs: DataFrame, models: dict[str, Model], text: str = "text", lang: str = "lang",
           key: str = "doc_id") -> DataFrame:
    """Per row: the key, lang, plain counts, scored characters, and mean log perplexity."""
    rows = docs.select(F.col(key).alias("doc_id"), text_of(lang).alias("lang"), F.col(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in shingles.slices(batch, 2):
                plain = plain_counts(part.column(2))
                chars, level = [], []
                for name, value in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    n, total = 0, 0.0
                    if value and name in shared.value:
                        if name not in tables:
                            while len(tables) >= TABLES:
                                tables.pop(next(iter(tables)))
                            tables[name] = np.full(1 << BITS * ORDER, np.nan, dtype=np.float32)
                        known = tables[name]
                        for codes in grams(value):
                            logs = known[codes]
                            new = np.isnan(logs)
                            if new.any():
                                fresh = np.unique(codes[new])
                                known[fresh] = np.log(shared.value[name].chance(fresh.astype(np.int64)))
                                logs = known[codes]
                            n += len(codes)
                            total -= float(logs.sum(dtype=np.float64))
                    chars.append(n)
                    level.append(total / n if n else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(plain[c]) for c in NAMES],
                     pa.array(chars, pa.int64()), pa.array(level, pa.float64())],
                    names=["doc_id", "lang", *NAMES, "chars", "log_perplexity"])

    id_type = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {id_type}, lang string, {COUNTS}, chars bigint, log_perplexity double")


def judged(scores: DataFrame) -> DataFrame:
    """Adds each language's band and ``kept``."""
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.5, 0.75], 10_000)
    known = scores.filter(~F.col("base_failed") & F.col("log_perplexity").isNotNull())

    def band(rows: DataFrame, *names: str) -> DataFrame:
        middle, spread = names[-2:]
        return rows.filter(F.col("known") >= LEAST_DOCUMENTS).select(
            *names[:-2], F.col("q")[1].alias(middle), F.greatest((F.col("q")[2] - F.col("q")[0]) / 1.349, F.lit(1e-3)).alias(spread))

    own = band(known.groupBy("lang").agg(quartiles.alias("q"), F.count(F.lit(1)).alias("known")), "lang", "middle", "spread")
    every = band(known.agg(quartiles.alias("q"), F.count(F.lit(1)).alias("known")), "all_middle", "all_spread").first()
    pooled = [F.lit(x).cast("double") for x in (every or (None, None))]
    rows = scores.join(own, "lang", "left").withColumns({
        "middle": F.coalesce("middle", pooled[0]), "spread": F.coalesce("spread", pooled[1])})
    room = F.lit(WIDTH) * F.col("spread") * F.sqrt(1 + F.lit(SHORT) / F.greatest("chars", F.lit(1)))
    inside = F.col("log_perplexity").between(F.col("middle") - room, F.col("middle") + room)
    return rows.withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def op7_quality(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    scores = kept(scored(docs, trained(docs)), "quality")
    return judged(scores).select("doc_id", *NAMES[:5], "base_failed", "kept", F.exp("log_perplexity").alias("perplexity"))
