import random
import re

import numpy as np
import pyarrow as pa

from llm_helpers import PROSE, odd_rows, plain
from tramline.llm import shingles, suffixes
from tramline.llm.catalog import QUERIES


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(texts):
    """Per document, the words in a stretch of LEAST words that another document holds."""
    holders = {}
    for key, text in texts.items():
        w = words(text)
        for i in range(len(w) - suffixes.LEAST + 1):
            holders.setdefault(tuple(w[i:i + suffixes.LEAST]), set()).add(key)
    covered = {k: set() for k in texts}
    for key, text in texts.items():
        w = words(text)
        for i in range(len(w) - suffixes.LEAST + 1):
            if len(holders[tuple(w[i:i + suffixes.LEAST])]) > 1:
                covered[key] |= set(range(i, i + suffixes.LEAST))
    return covered


def covered(rows, keys):
    out = {k: set() for k in keys}
    for r in rows:
        assert not out[r["doc_id"]] & set(range(r["start"], r["stop"])) and r["n_words"] == r["stop"] - r["start"]
        assert r["partner"] != r["doc_id"]
        out[r["doc_id"]] |= set(range(r["start"], r["stop"]))
    return out


def test_against_all_windows(spark, documents):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [fresh(n) for n in (50, 51, 60, 90, 300)]
    texts = {}
    for key in range(80):
        text = fresh(rng.randint(0, 200))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            cut = rng.randint(0, max(0, len(p) - 45)) if rng.random() < 0.3 else 0   # parts around the limit
            at = rng.randint(0, len(text))
            text[at:at] = p[cut:]
        texts[key] = " ".join(text) if rng.random() < 0.7 else "\n ".join(text).upper()
    texts[900] = texts[3]
    folder = documents([(k, t, "en", "a") for k, t in texts.items()])
    rows = plain(QUERIES["op4_suffix_passages"](spark, folder))
    got, told = covered(rows, texts), expected(texts)
    assert all(told[k] <= got[k] and len(got[k] - told[k]) <= 1 for k in texts)   # 16-bit hashes at the ends


def test_hot_passage_and_clean_documents(spark, documents):
    rng = random.Random(7)
    hot = " ".join(f"h{i}" for i in range(55))
    texts = {i: " ".join(f"o{rng.randrange(10**6)}" for _ in range(60)) for i in range(400)}
    for i in range(200):
        texts[i] += f" {hot} " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(40))
    folder = documents([(k, t, "en", "a") for k, t in texts.items()])
    rows = sorted(plain(QUERIES["op4_suffix_passages"](spark, folder)), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == list(range(200))
    assert all(r["start"] in (59, 60) and r["stop"] in (115, 116) for r in rows)


def test_supplied_documents(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got, told = covered(plain(QUERIES["op4_suffix_passages"](spark, folder)), texts), expected(texts)
    assert sum(map(len, told.values())) > 0 and all(got[k] <= told[k] or len(got[k] - told[k]) <= 2 for k in texts)
    assert sum(len(told[k] - got[k]) for k in texts) <= 0.001 * sum(map(len, told.values()))


def test_minimisers_follow_content():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 2**63, 500).astype(np.uint64)
    whole, part = suffixes.suffixes_of(hashes), suffixes.suffixes_of(hashes[200:251])
    assert {int(p) + 200 for p in part[1]} <= set(whole[1].tolist()) and len(part[1])


def test_odd_rows(spark, odd, empty):
    rows = plain(QUERIES["op4_suffix_passages"](spark, odd))
    assert {r["doc_id"] for r in rows} <= {k for k, *_ in odd_rows() if k is not None}
    assert plain(QUERIES["op4_suffix_passages"](spark, empty)) == [] and len(words(PROSE)) < suffixes.LEAST


def exactly(spark, documents, texts):
    rows = plain(QUERIES["op4_suffix_passages"](spark, documents([(k, t, "en", "a") for k, t in texts.items()])))
    assert covered(rows, texts) == expected(texts)
    return rows


def test_block_repeated_in_one_document(spark, documents):
    """Copies inside a document don't hide it from another one."""
    rng = random.Random(8)
    fresh = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    block = fresh(55)
    often = " ".join(f"{block} {fresh(5)}" for _ in range(40))
    rows = exactly(spark, documents, {
        1: often, 2: f"{fresh(30)} {block} {fresh(30)} {block}", 3: " ".join([block] * 100), 4: " ".join([block] * 100),
        5: "same " * 300, 6: "same " * 200, 7: fresh(200)})
    assert {r["doc_id"]: r["n_words"] for r in rows if r["doc_id"] in (3, 4, 5, 6)} == {3: 5500, 4: 5500, 5: 300, 6: 200}
    assert {r["doc_id"]: r["partner"] for r in rows if r["doc_id"] in (1, 2, 6)} == {1: 2, 2: 1, 6: 5}


def test_frequent_gram_with_contexts_of_one_side(spark, documents):
    """Documents that share more words on one side only don't hide a passage around a frequent gram."""
    rng = random.Random(10)
    fresh = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    places = None
    while places != [20]:                                                # the gram is the one kept
        passage = fresh(50)
        hashed, _ = shingles.word_hashes(*shingles.buffers(pa.array([" ".join(passage)])))
        places = sorted({int(p) for p in suffixes.suffixes_of(hashed)[1]})
    left, gram, right = passage[:20], passage[20:30], passage[30:]
    texts = {1: fresh(40) + left + gram + right + fresh(40), 2: fresh(40) + left + gram + right + fresh(40)}
    for i in range(60):
        one = fresh(39 - i // 2) + left[-(i // 3 + 1):] + gram + fresh(60)
        other = fresh(60) + gram + right[:i // 3 + 1] + fresh(39)
        texts |= {10 + 2 * i: one, 11 + 2 * i: other}
    for i in range(80):                                                  # right side whole, and left side whole
        texts |= {200 + i: fresh(60) + gram + right + fresh(40), 400 + i: fresh(40) + left + gram + fresh(60)}
    rows = exactly(spark, documents, {k: " ".join(t) for k, t in texts.items()})
    assert {1, 2} <= {r["doc_id"] for r in rows}


def test_second_way_gives_the_same(spark, documents, monkeypatch):
    """Grams of more entries than MOST are counted by window."""
    rng = random.Random(11)
    fresh = lambda n: " ".join(f"o{rng.randrange(10**6)}" for _ in range(n))
    blocks = [fresh(n) for n in (50, 57, 120)]
    texts = {i: " ".join([fresh(rng.randint(0, 40)), rng.choice(blocks), fresh(20), rng.choice(blocks)]) for i in range(60)}
    rows = exactly(spark, documents, texts)
    match = suffixes.match_blocks

    def none_whole(batches):
        suffixes.MOST = 0
        return match(batches)

    monkeypatch.setattr(suffixes, "match_blocks", none_whole)
    again = plain(suffixes.passages(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")))
    assert again == rows


def test_neighbours_against_all_pairs():
    rng = np.random.default_rng(8)
    grid = rng.integers(0, 3, (150, 7)).astype(np.uint64)
    docs = rng.integers(0, 20, 150)
    told = np.zeros(grid.shape, np.int64)
    for i in range(150):
        for c in range(7):
            for j in np.flatnonzero(docs != docs[i]):
                n = 0
                while c + n < 7 and grid[i, c + n] == grid[j, c + n] != 0:
                    n += 1
                told[i, c] = max(told[i, c], n)
    assert (suffixes.longest_elsewhere(grid, docs) == told).all()
