"""Language ID by nearest centroid over TF-IDF vectors of letter n-grams.

Texts become lower-cased letters with single spaces between, their n-grams of one to three
letters are hashed into ``BINS`` places, counted, damped (log), weighed by inverse document
frequency and scaled to length one. Each language has several centroids (spherical k-means).
A text takes the language of the centroid with the largest cosine, and is rejected when that
cosine is under the limit for the language and the text's length.

Limits come from a quarter of the sample that the centroids are not fitted on. Its texts are cut
to lengths that double (``CUTS``). For each length, a cosine that all but one in a hundred
texts stay under at the centroids of languages they are not in (``OTHERS``) tells nothing of
a language and is the limit, unless more than ``OWN_LOST`` of the language's own cuts would
be under it, as among a few letters. So languages that were not learned and random letters
go, and own texts stay.

Document frequencies count every training document. The centroids are fitted on a bounded
sample: at most ``SAMPLE`` documents in all and ``PER_LANGUAGE`` of one language, chosen by a
hash of the id (each language at a rate from its count, so a handful more may come); of more
than ``SAMPLE`` languages the largest are learned.

Defined cases: null texts and texts without a letter are ``und``, score 0, and rejected; if
nothing is labelled, every text is; null labels are not learned from; repeated rows count
each; equal cosines go to the language first in order; texts of any length are counted whole
(in slices, so memory stays bounded); an empty table gives no rows; columns named like the
result are replaced and all others stay.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.common import hash_key, table

BINS = 1 << 13
GRAMS = (1, 2, 3)
MULTIPLIERS = (2654435761, 2246822519, 3266489917)
SLICE = 1 << 20
CENTROIDS, ROUNDS, LEAST_SHARE = 3, 12, 0.02   # smaller clusters are strays
SAMPLE, PER_LANGUAGE, SEED = 4000, 400, 9
OTHERS, OWN_LOST = 0.99, 0.02
CUTS = tuple(2 ** k for k in range(3, 13))   # characters
LENGTHS = 24   # limits by the power of two of the number of n-grams
ALONE = 0.5    # of the own cosine, where only one language is learned
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def counts(text: str | None) -> np.ndarray:
    """How often each n-gram bin occurs in the text."""
    found = np.zeros(BINS, dtype=np.int64)
    if not text:
        return found
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at:at + SLICE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = letters()[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
        if not letter.any():
            continue
        codes = np.where(letter, codes, 32).astype(np.uint32)
        keep = letter | np.concatenate([[True], letter[:-1]])
        codes = np.concatenate([[32], codes[keep], [32]]).astype(np.uint32)
        for n in GRAMS:
            if len(codes) < n:
                continue
            code = np.full(len(codes) - n + 1, n, dtype=np.uint32)
            for i in range(n):
                code = (code ^ codes[i:len(codes) - n + 1 + i]) * np.uint32(MULTIPLIERS[i])
                code ^= code >> np.uint32(15)
            if n == 1:
                code = code[codes != 32]
            found += np.bincount((code >> np.uint32(7)) & np.uint32(BINS - 1), minlength=BINS)
    return found


@dataclasses.dataclass
class Model:
    idf: np.ndarray
    languages: list[str]          # of each centroid
    centroids: np.ndarray
    limits: np.ndarray            # least cosine of each centroid's language, by length

    def measured(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the texts and the powers of two of their lengths."""
        found = np.stack([counts(t) for t in texts])
        power = np.log2(np.maximum(found.sum(axis=1), 1)).astype(np.int64)
        return unit(np.log1p(found).astype(np.float32) * self.idf), np.minimum(power, LENGTHS - 1)

    def vectors(self, texts: list[str | None]) -> np.ndarray:
        return self.measured(texts)[0]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it is rejected, for each text."""
        names, scores, out = [], np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        for at in range(0, len(texts), 256):
            vectors, length = self.measured(texts[at:at + 256])
            some = vectors.any(axis=1)
            if not len(self.languages):
                names += [UNKNOWN] * len(vectors)
                continue
            cosines = vectors @ self.centroids.T
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(best)), best], 0, 1)
            names += [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
            scores[at:at + 256] = np.where(some, score, 0)
            out[at:at + 256] = ~some | (score < self.limits[best, length])
        return names, scores, out


def unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length == 0, 1, length)


def clustered(rows: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from starting points far apart."""
    centres = [unit(rows.sum(axis=0, keepdims=True))[0]]
    while len(centres) < min(k, len(rows)):
        centres.append(rows[np.max(rows @ np.stack(centres).T, axis=1).argmin()])
    centres = np.stack(centres)
    for _ in range(rounds):
        mine = (rows @ centres.T).argmax(axis=1)
        centres = np.stack([
            unit(rows[mine == i].sum(axis=0, keepdims=True))[0] if (mine == i).any() else centres[i]
            for i in range(len(centres))])
    share = np.bincount((rows @ centres.T).argmax(axis=1), minlength=len(centres)) / len(rows)
    return centres[share >= min(LEAST_SHARE, share.max())]


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BINS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += counts(text) > 0
                rows += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*some, -1], pa.int64()), pa.array([*total[some], rows], pa.int64())], names=["bin", "n"])

    sums = texts.mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BINS)
    for row in sums:
        if row["bin"] >= 0:
            found[row["bin"]] = row["n"]
    return found, sum(row["n"] for row in sums if row["bin"] == -1)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
        sample: int = SAMPLE, per_language: int = PER_LANGUAGE) -> Model:
    """A model of the labelled rows that are not held out."""
    rows = docs.filter(~held_out(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(text).alias("text"), F.col(lang).alias("lang"), hash_key(key, SEED).alias("draw"))
    frequency, n = document_frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + frequency)) + 1).astype(np.float32)
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample)
    most = min(per_language, max(1, sample // max(1, sizes.count())))
    drawn = (
        rows.join(F.broadcast(sizes), "lang")   # `sample` rows at most
        .filter(F.col("draw") < F.least(F.lit(1.0), F.lit(float(most)) / F.col("count")) * F.lit(float(1 << 60)))
        .select("lang", "text", (F.pmod("draw", F.lit(4)) == 0).alias("apart"))
    )
    empty = Model(idf, [], np.zeros((0, BINS), np.float32), np.zeros((0, LENGTHS)))

    def vectorized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([v.astype("<f4").tobytes() for v in empty.vectors(texts)]), batch.column(2)],
                    names=["lang", "vector", "apart"])

    got: dict[str, dict[bool, list[bytes]]] = {}
    for row in drawn.mapInArrow(vectorized, "lang string, vector binary, apart boolean").collect():
        got.setdefault(row["lang"], {False: [], True: []})[row["apart"]].append(bytes(row["vector"]))
    languages, centres = [], []
    for name in sorted(got):
        for held in (got[name][False], got[name][True]):   # a language of a few texts has only others
            points = np.array([np.frombuffer(v, dtype="<f4") for v in sorted(held)]).reshape(-1, BINS)
            points = points[points.any(axis=1)]
            if len(points):
                own = clustered(points)
                languages += [name] * len(own)
                centres.append(own)
                break
    if not centres:
        return empty
    model = Model(idf, languages, np.concatenate(centres).astype(np.float32), np.zeros((len(languages), LENGTHS)))
    model.limits = limits(model, drawn.filter("apart").select("lang", "text"))
    return model


def cuts(text: str) -> list[str]:
    """The text and parts of it of all lengths, from its start and from its middle."""
    return [text, *[text[at:at + n] for n in CUTS if n < len(text) for at in {0, (len(text) - n) // 2}]]


def limits(model: Model, apart: DataFrame) -> np.ndarray:
    """Least cosine of each centroid's language by length, from texts (lang, text) it was not fitted on."""
    names = np.array(model.languages)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                vectors, length = model.measured(cuts(text))
                cosines = vectors @ model.centroids.T
                best = lambda some: cosines[:, some].max(axis=1, initial=0.0).astype(np.float64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(length)), pa.array(length), pa.array(best(names == name)), pa.array(best(names != name))],
                    names=["lang", "length", "own", "other"])

    found = apart.mapInArrow(measure, "lang string, length bigint, own double, other double").filter("own > 0").collect()
    out = np.zeros((len(names), LENGTHS))
    lang, length = np.array([r["lang"] for r in found]), np.array([r["length"] for r in found], np.int64)
    own, other = np.array([r["own"] for r in found]), np.array([r["other"] for r in found])
    alone = len(set(names)) == 1
    for k in range(LENGTHS if len(found) else 0):
        # Of lengths that no cut has, the nearest that one has.
        nearest = length[np.abs(length - k).argmin()]
        wrong = np.quantile(other[length == nearest], OTHERS)
        for name in set(names):
            mine = own[(length == nearest) & (lang == name)]
            least = np.quantile(mine, OWN_LOST) if len(mine) else wrong
            out[names == name, k] = ALONE * least if alone else min(wrong, least)
    return out


def predict(docs: DataFrame, model: Model, text: str = "text",
            into: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """All rows and columns, with the language, its cosine, and whether it is rejected."""
    added = list(zip(into, (T.StringType(), T.DoubleType(), T.BooleanType())))
    docs = docs.drop(*[name for name, _ in added])
    place = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in added]])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, out = model.judge(batch.column(place).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.string()), pa.array(scores), pa.array(out)],
                names=[*batch.schema.names, *[n for n, _ in added]])

    return docs.mapInArrow(judge, schema)


def op9_language_id(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
