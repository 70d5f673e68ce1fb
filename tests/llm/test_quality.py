import re
from collections import Counter

import numpy as np
import pytest

from llm_helpers import odd_rows, plain
from tramline.llm import quality
from tramline.llm.catalog import QUERIES


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(words) < 50 or 100 * len(covered) > 50 * len(words)}


def test_supplied_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = plain(QUERIES["op7_quality"](spark, folder))
    assert len(rows) == len(texts)
    for r in rows:
        told = expected(texts[r["doc_id"]])
        assert {k: r[k] for k in told} == told
        assert not (r["kept"] and r["base_failed"])
    fine = [r for r in rows if good.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(r["kept"] for r in fine) >= 0.99 * len(fine)
    marked = [r for r in rows if not r["base_failed"] and r["n_symbols"] > r["n_words"]]
    assert marked and not any(r["kept"] for r in marked)


def test_bands_against_plain_quartiles(spark):
    """Kept exactly where the logarithm lies in the band of the language, or of all languages if it is small."""
    rng = np.random.default_rng(4)
    rows = [(i, lang, False, int(rng.integers(50, 5000)), float(rng.normal(2 + 0.5 * (lang == "b"), 0.2) + 9 * (i % 41 == 0)))
            for i, lang in enumerate(["a"] * 300 + ["b"] * 200 + ["c"] * 12)]
    rows += [(900, "a", True, 100, 2.0), (901, "c", False, 0, None)]
    got = {r["doc_id"]: r["kept"] for r in quality.judged(spark.createDataFrame(
        rows, "doc_id int, lang string, base_failed boolean, chars long, log_perplexity double")).collect()}

    def quartiles(some):
        some = sorted(some)
        return [some[max(0, -(-len(some) * k // 4) - 1)] for k in (1, 2, 3)]

    known = [(lang, p) for _, lang, failed, _, p in rows if not failed and p is not None]
    bands = {lang: quartiles([p for g, p in known if g == lang]) for lang in "ab"}
    bands["c"] = quartiles([p for _, p in known])
    for key, lang, failed, chars, p in rows:
        low, middle, high = bands[lang]
        room = quality.WIDTH * max(1e-3, (high - low) / 1.349) * (1 + quality.SHORT / max(chars, 1)) ** 0.5
        assert got[key] == (not failed and (p is None or abs(p - middle) <= room)), key
    assert sum(got.values()) < len(rows) - 2


def test_numbers_are_no_prose(spark):
    """Lists of random numbers lie outside the band of a language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(6)
    numbers = [(10**6 + i, " ".join(str(x) for x in rng.integers(0, 10**6, 400)), lang) for i, lang in enumerate(["en", "de"] * 3)]
    rows = docs.unionByName(spark.createDataFrame(numbers, docs.schema))
    got = {r["doc_id"]: r["kept"] for r in quality.judged(quality.scored(rows, quality.trained(rows))).collect()}
    assert not any(got[k] for k, *_ in numbers)


def test_odd_rows(spark, odd, empty):
    rows = plain(QUERIES["op7_quality"](spark, odd))
    assert len(rows) == len(odd_rows())
    texts = {k: t for k, t, *_ in odd_rows() if k is not None}
    for r in rows:
        if r["doc_id"] is not None:
            told = expected(texts[r["doc_id"]])
            assert {k: r[k] for k in told} == told
    assert plain(QUERIES["op7_quality"](spark, empty)) == []


def test_kneser_ney_against_plain_counting():
    text = "the cat sat on the mat and the dog sat on the log, then they all went to the sea. " * 3 + "a b c d"
    codes = np.concatenate(list(quality.grams(text)))
    unique, n = np.unique(codes, return_counts=True)
    model = quality.estimated(unique, n)
    # Each context's probabilities add up to one.
    for context in {int(c) >> quality.BITS for c in unique} | {12345}:
        every = (context << quality.BITS) + np.arange(quality.CLASSES)
        assert model.chance(every).sum() == pytest.approx(1)
    # The formula, term by term, from dictionaries.
    levels = {4: Counter(map(int, codes))}
    for k in (3, 2, 1):
        levels[k] = Counter(g & ((1 << 6 * k) - 1) for g in levels[k + 1])

    def chance(gram, k):
        if k == 0:
            return 1 / quality.CLASSES
        gram &= (1 << 6 * k) - 1
        counts = levels[k]
        d = quality.discounts(np.array(list(counts.values())))
        after = [c for g, c in counts.items() if g >> 6 == gram >> 6]
        if not after:
            return chance(gram, k - 1)
        off = sum(d[min(c, 3)] for c in after)
        own = counts.get(gram, 0)
        return (own - d[min(own, 3)]) / sum(after) + off / sum(after) * chance(gram, k - 1)

    for gram in [*map(int, unique[:40]), 99, 5_000_000]:
        assert model.chance(np.array([gram]))[0] == pytest.approx(chance(gram, 4))
