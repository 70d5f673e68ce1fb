import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import odd_rows, plain, same
from tramline.llm import relative_lz
from tramline.llm.catalog import QUERIES

W = relative_lz.WINDOW


def expected(rows):
    """Per row, the words outside all windows that start in two places or more, found by counting all windows."""
    words = [(k, (t or "").encode().split()) for k, t in rows]
    held = Counter(tuple(w[i:i + W]) for _, w in words for i in range(len(w) - W + 1))
    out = []
    for key, w in words:
        gone = set()
        for i in range(len(w) - W + 1):
            if held[tuple(w[i:i + W])] > 1:
                gone |= set(range(i, i + W))
        left = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append({"doc_id": key, "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(left).hexdigest()})
    return out


def check(spark, documents, rows, name="data"):
    folder = documents([(k, t, "en", "a") for k, t in rows], name)
    same(plain(QUERIES["op11_relative_lz"](spark, folder)), expected(rows))


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"o{rng.randrange(10**6)}" for _ in range(n)]
    passages = [fresh(n) for n in (34, 35, 36, 50, 62, 63, 120, 400)]
    rows = []
    for key in range(150):
        text = fresh(rng.randint(0, 150))
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            at = rng.randint(0, len(text))
            text[at:at] = p[a:a + rng.randint(30, 80)]
        rows.append((key, " ".join(text)))
    left, mid, right = fresh(20), fresh(10), fresh(20)
    for i in range(60):                        # one frequent seed, shared sides of all lengths
        rows.append((200 + i, " ".join(fresh(40) + left[-rng.randint(1, 20):] + mid + right[:rng.randint(1, 20)] + fresh(40))))
    rows += [(300, rows[3][1]), (301, rows[3][1].upper()), (302, "same " * 100), (303, " ".join(passages[5] * 30)),
             (304, " \t".join(passages[6] + passages[6][:40])), (305, "a b c " * 40)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, documents, seed):
    check(spark, documents, corpus(seed))


def test_second_way_alone(spark, documents, monkeypatch):
    """Seeds of more than HOT phrases are counted by window; the result is the same."""
    monkeypatch.setattr(relative_lz, "HOT", 1)
    rows = corpus(3)
    folder = documents([(k, t, "en", "a") for k, t in rows])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    hot = relative_lz.parse_blocks

    def all_hot(batches):
        relative_lz.HOT = 1
        return hot(batches)

    monkeypatch.setattr(relative_lz, "parse_blocks", all_hot)
    same(plain(relative_lz.without_repeats(docs)), expected(rows))


def test_seeds_split_between_tasks():
    """A block that lacks phrases of a seed hands the others on."""
    rng = random.Random(5)
    text = " ".join(f"o{rng.randrange(10**6)}" for _ in range(300))
    parts = [pa.RecordBatch.from_pydict({"row": [k], "text": [text]}) for k in (0, 1)]
    told = [pa.Table.from_batches(relative_lz.phrase_rows(iter([p]))) for p in parts]

    def block(tables):
        rows = pa.concat_tables(tables).sort_by("seed")
        n = len(rows)
        return rows.append_column("n", pa.array([2] * n)).append_column("records", pa.array([2] * n)).combine_chunks().to_batches()

    out = pa.Table.from_batches(relative_lz.parse_blocks(iter(block(told[:1])))).to_pylist()
    assert len(out) == len(told[0]) and all(r["windows"] for r in out)
    whole = pa.Table.from_batches(relative_lz.parse_blocks(iter(block(told)))).to_pylist()
    assert not any(r["windows"] for r in whole)
    for key in (0, 1):
        covered = {i for r in whole if r["row"] == key for at in r["ats"] for i in range(at, at + r["size"])}
        assert covered == set(range(300))


def test_longest_matches():
    """The neighbour in sorted order has the longest match, against comparing all rows."""
    rng = np.random.default_rng(2)
    grid = rng.integers(0, 3, (200, 8)).astype(np.uint64)
    told = np.zeros(grid.shape, np.int64)
    for i in range(200):
        for c in range(8):
            for j in range(200):
                n = 0
                while i != j and c + n < 8 and grid[i, c + n] == grid[j, c + n] != 0:
                    n += 1
                told[i, c] = max(told[i, c], n)
    assert (relative_lz.longest_matches(grid) == told).all()


def test_supplied_documents(spark, duck):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    told = expected([(r["doc_id"], r["text"]) for r in docs])
    assert sum(r["n_removed"] for r in told) > 0
    same(plain(QUERIES["op11_relative_lz"](spark, folder)), told)


def test_odd_rows(spark, odd, empty, duck):
    same(plain(QUERIES["op11_relative_lz"](spark, odd)), expected([r[:2] for r in odd_rows()]))
    same(duck(relative_lz.SQL, odd), expected([r[:2] for r in odd_rows()]))
    assert plain(QUERIES["op11_relative_lz"](spark, empty)) == []


def test_kept_text(spark, documents):
    block = " ".join(f"w{i}" for i in range(40))
    folder = documents([(1, f"a  b {block}\nc", "en", "a"), (2, block, "en", "a")])
    rows = plain(relative_lz.without_repeats(spark.read.parquet(f"{folder}/documents.parquet"), texts=True))
    assert {r["doc_id"]: r["kept_text"] for r in rows} == {1: "a b c", 2: ""}
