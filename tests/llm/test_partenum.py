import random

import numpy as np
import pyarrow as pa
import pytest

from llm_helpers import PROSE, expected, odd_rows, plain, shingle_set
from tramline.llm import components, partenum, shingles
from tramline.llm.catalog import QUERIES


def edited(rng, words, share):
    words = list(words)
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, documents, seed, monkeypatch):
    """Near copies around the limit, small sets, shared passages, chains; blocks made small."""
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 4)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for group in range(25):
        n = rng.choice([1, 3, 5, 8, 12, 25, 60, 150, 400])
        base = [f"g{group}w{rng.randrange(1000)}" for _ in range(n)]
        if rng.random() < 0.4:
            base = base[:n // 2] + passage + base[n // 2:]
        for _ in range(rng.randint(1, 9)):
            words = edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))
            if rng.random() < 0.3:
                base = words   # chains
            texts[rng.randrange(10**6)] = " ".join(words) if rng.random() < 0.7 else "  ".join(words).upper()
    folder = documents([(k, v, "en", "a") for k, v in texts.items()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in plain(QUERIES["op8_partenum_join"](spark, folder))}
    assert got == expected(texts)


def test_large_group_of_near_copies(spark, documents):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(edited(rng, base, 0.012)) for i in range(300)}
    folder = documents([(k, v, "en", "a") for k, v in texts.items()])
    got = {r["doc_id"]: r["component_id"] for r in plain(QUERIES["op8_partenum_join"](spark, folder))}
    assert got == {k: c for k, (_, c) in expected(texts).items()}


def test_passage_in_many_unlike_documents(spark, documents, monkeypatch):
    """Work on a bucket grows with its members, not their pairs; near copies among them are found."""
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 16)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(80)]
    texts = {}
    for i in range(400):
        own = [f"d{i}w{j}" for j in range(rng.randint(30, 60))]
        texts[i] = " ".join(own + passage)
        if i % 40 == 0:
            texts[1000 + i] = " ".join(edited(rng, own + passage, 0.01))
    frame, seen = type(spark.range(0)), []
    real = frame.repartition

    def counted(self, *given):
        if given == ("bucket", "one", "two"):
            seen.append(self.count())
        return real(self, *given)

    monkeypatch.setattr(frame, "repartition", counted)
    folder = documents([(k, v, "en", "a") for k, v in texts.items()])
    got = {r["doc_id"]: r["component_id"] for r in plain(QUERIES["op8_partenum_join"](spark, folder))}
    assert got == {k: c for k, (_, c) in expected(texts).items()}
    assert len(seen) == 1 and seen[0] < 4 * len(texts)


def test_sketches_never_pass_over_near_sets():
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(n)) for n in (30, 31, 700, 720, 5000, 5200, 9000)]
    texts += [" ".join(edited(rng, t.split(), 0.02)) for t in texts]
    column = pa.array(texts)
    hashes, begin = shingles.sets(column)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(begin[:-1], begin[1:])]
    sketch = partenum.Sketches(pa.array(partenum.sketches(hashes, begin), pa.binary()))
    a, b = (x.ravel() for x in np.meshgrid(range(len(texts)), range(len(texts))))
    apart = np.array([len(sets[i] ^ sets[j]) for i, j in zip(a, b)])
    assert sketch.near(a, b, apart).all()
    most = np.array([(len(sets[i]) + len(sets[j])) // 7 for i, j in zip(a, b)])
    assert sketch.near(a, b, most).sum() < len(a) / 2


def test_odd_rows(spark, odd, empty):
    rows = plain(QUERIES["op8_partenum_join"](spark, odd))
    assert len(rows) == len(odd_rows())
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[5]["component_id"] == 4 and by_id[11]["component_id"] == 4 and by_id[7]["component_id"] == 6
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3)] == [0, 0, 0] and by_id[3]["component_id"] == 3
    assert sorted(r["component_id"] or -1 for r in rows if r["doc_id"] is None) == [-1, 4]
    assert plain(QUERIES["op8_partenum_join"](spark, empty)) == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (100, 95), (90, 100), (7, 7)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(2, 41)}, 95: 90, 100: 90}


def test_shingles_do_not_depend_on_blocks():
    texts = [PROSE, None, "", " a", "A b c d e f", "x" * 5000 + " y z", "é " * 40, PROSE * 20]
    values, offsets = shingles.buffers(pa.array(texts))
    whole = shingles.word_hashes(values, offsets)
    for block in (7, 64, 1000):
        parts = shingles.word_hashes(values, offsets, block)
        assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    hashes, begin = shingles.sets(pa.array(texts))
    assert [int(n) for n in begin[1:] - begin[:-1]] == [len(shingle_set(t)) for t in texts]
