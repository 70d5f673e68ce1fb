import hashlib
import math
import struct
from collections import Counter

import regex
import xxhash

from llm_helpers import PROSE, odd_rows, plain
from tramline.llm import imatch
from tramline.llm.catalog import QUERIES


def long_hash(value, seed):
    return xxhash.xxh64_intdigest(struct.pack("<q", value), seed % 2**64)


def word_hash(word):
    h = xxhash.xxh64_intdigest(word.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def expected_mark(text, lexicon):
    words = {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}
    terms = sorted({word_hash(w) for w in words} & lexicon)
    if not terms:
        low = format(xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFFFF, "08x")
        return [low] * (1 + sum(imatch.SUBSETS))

    def mark(some):
        seed = 42
        for t in some:
            seed = long_hash(t, seed)
        return format(seed & 0xFFFFFFFF, "08x") if some else "-"

    out = [mark(terms)]
    for i, (density, n) in enumerate(zip(imatch.DENSITIES, imatch.SUBSETS)):
        out += [mark([t for t in terms if (t >> 11 * i) & (density - 1) == j]) for j in range(n)]
    return out


def test_against_brute_force(spark, documents):
    texts = {i * 7: f"{PROSE} " + " ".join(f"w{(i * i + k) % 331}" for k in range(i % 60 + 1)) for i in range(120)}
    folder = documents([(k, v, "en", "a") for k, v in texts.items()])
    got = {r["doc_id"]: r for r in plain(QUERIES["op2_imatch"](spark, folder))}
    seen = Counter(w for t in texts.values() for w in {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w})
    low, high = len(texts) * math.exp(-imatch.HIGH_IDF), len(texts) * math.exp(-imatch.LOW_IDF)
    lexicon = {word_hash(w) for w, n in seen.items() if low <= n <= high}
    order = sorted(texts, reverse=True)
    for i, key in enumerate(order):
        text, after = texts[key], texts[order[(i + 1) % len(order)]]
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[key]["fingerprint"].split(".") == expected_mark(text, lexicon)
        assert got[key]["edited_fingerprint"].split(".") == expected_mark(edited, lexicon)
        assert 0 <= got[key]["near_edited"] <= 1 and 0 <= got[key]["near_next"] <= 1


def test_likeness_tells_edits_from_others(spark):
    rows = plain(QUERIES["op2_imatch"](spark, "/root/testdata/sf0.01"))
    edited = sum(r["near_edited"] for r in rows) / len(rows)
    other = sum(r["near_next"] for r in rows) / len(rows)
    assert edited > 0.3 and other < 0.05


def test_odd_rows(spark, odd, empty, documents):
    rows = plain(QUERIES["op2_imatch"](spark, odd))
    assert len(rows) == len(odd_rows())
    prose = {r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(prose) == 1
    assert {r["n_chars"] for r in rows if r["doc_id"] in (1, 2)} == {0}
    assert plain(QUERIES["op2_imatch"](spark, empty)) == []
    only = plain(QUERIES["op2_imatch"](spark, documents([(3, "abc def", "en", "a")], "only")))
    assert only[0]["near_next"] == 1.0


def test_shuffled_lexicon_gives_the_same(spark, documents, monkeypatch):
    folder = documents([(i, f"{PROSE} w{i} v{i % 9} u{i % 31}", "en", "a") for i in range(200)])
    before = plain(QUERIES["op2_imatch"](spark, folder))
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", -1)
    assert plain(QUERIES["op2_imatch"](spark, folder)) == before


def test_short_documents_of_common_words_are_fingerprinted(spark, documents):
    """Words in one document of twenty carry: a short text of such words has terms, and its copy is like it."""
    texts = {i: " ".join(f"w{(i * 12 + k * 7) % 240}" for k in range(12)) for i in range(200)}
    rows = plain(QUERIES["op2_imatch"](spark, documents([(k, v, "en", "a") for k, v in texts.items()])))
    assert all(len(set(r["fingerprint"].split("."))) > 1 for r in rows)
    assert sum(r["near_edited"] for r in rows) > 0.2 * len(rows)


def test_any_ids(spark, documents, monkeypatch):
    """Ids far from all others or 2**64 apart: the next document is right, and blocks stay even."""
    monkeypatch.setattr(imatch, "LEAST_BLOCKS", 16)
    for name, ids in (("far", [*range(1000), 2**62]), ("wide", [*range(0, 3000, 3), -2**63, -2**62 - 5, 2**62 + 7, 2**63 - 1])):
        texts = {k: f"{PROSE[:i % 90]} w{i} u{i % 7}" for i, k in enumerate(ids)}
        folder = documents([(k, v, "en", "a") for k, v in texts.items()], name)
        got = {r["doc_id"]: r for r in plain(QUERIES["op2_imatch"](spark, folder))}
        order = sorted(texts, reverse=True)
        for i, key in enumerate(order):
            text, after = texts[key], texts[order[(i + 1) % len(order)]]
            third = len(text) // 3
            assert got[key]["edited_sha256"] == hashlib.sha256((text[:len(text) - third] + after[:third]).encode()).hexdigest()
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        sizes = [r["count"] for r in docs.select(imatch.block_of(docs, "doc_id").alias("b")).groupBy("b").count().collect()]
        assert len(sizes) >= 14 and max(sizes) < 100
