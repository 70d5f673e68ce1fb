import math
import random
import re
from collections import Counter

import numpy as np

from llm_helpers import odd_rows, plain, same
from tramline.llm import ranked_search
from tramline.llm.catalog import QUERIES


def terms(text):
    return re.findall(ranked_search.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, k=10):
    """Every score, by the formula; the best k of each item."""
    held = [(key, Counter(terms(t))) for key, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    total, length = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for _, c in held for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, own in wanted.items():
        scores = []
        for (key, c), n in zip(held, sizes):
            m = 100 - 90 + (90 * n * total) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (
                (10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        for rank, (score, _, _, key) in enumerate(sorted(scores)[:k], 1):
            out.append({"item_id": item, "rank": rank, "doc_id": key, "score": -score})
    return out


def tables(spark, documents, tmp_path, docs, items, name="data"):
    folder = documents([(k, t, "en", "a") for k, t in docs], name)
    spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, rank int, score string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder


def random_corpus(seed, n_docs=3000, n_items=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "É9", "don't", "x_y"]
    text = lambda n: rng.choice([" ", ", ", "-\n"]).join(words[min(int(rng.expovariate(0.02)), 403)] for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(n_docs)]
    docs += [(n_docs + i, docs[7][1]) for i in range(30)]                     # ties
    items = [(i, text(rng.randint(1, 20))) for i in range(n_items)] + [(900, docs[7][1]), (901, "unknown words"), (902, None)]
    return docs, items


def test_against_all_scores(spark, documents, tmp_path, duck):
    docs, items = random_corpus(3)
    folder = tables(spark, documents, tmp_path, docs, items)
    told = expected(docs, items)
    same(plain(QUERIES["op13_ranked_search"](spark, folder)), told)
    con = duck(ranked_search.SQL, folder, ("documents", "benchmark"))
    same(con, told)


def test_blocks_of_items(spark, documents, tmp_path):
    docs, items = random_corpus(4, 400, 30)
    folder = tables(spark, documents, tmp_path, docs, items)
    read = lambda t: spark.read.parquet(f"{folder}/{t}.parquet")
    got = ranked_search.search(read("documents"), read("benchmark"), k=3, terms_a_block=60)
    same(plain(got), expected(docs, items, 3))


def test_nodes_bound_their_rows_and_prune():
    rng = np.random.default_rng(1)
    sizes = rng.integers(0, 12, 500)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    held = np.concatenate([rng.choice(50, s, replace=False) for s in sizes]).astype(np.int64)
    tree = ranked_search.Tree(begin, held, rng.integers(1, 1000, len(held)), 50, 8, 4)
    for depth, level in enumerate(tree.levels):
        width = 8 * 4 ** depth
        for node in range(len(level)):
            rows = tree.dense(tree.order[node * width:(node + 1) * width])
            assert (level[node] == rows.max(axis=0)).all()
    items = ranked_search.Tree(np.array([0, 3, 5]), np.array([1, 2, 3, 7, 9]), np.array([5, 1, 9, 4, 4]), 50, 4, 4)
    whole = tree.dense(np.arange(500))
    ids, none = np.arange(500), np.zeros(500, bool)
    best = ranked_search.Best(np.zeros(2, np.int64), 5)
    scored, dense = [], tree.dense
    tree.dense = lambda rows: scored.append(len(rows)) or dense(rows)
    ranked_search.search_tree(items, tree, best, ids, none, False)
    for i, (at, w) in enumerate([([1, 2, 3], [5, 1, 9]), ([7, 9], [4, 4])]):
        scores = whole[:, at] @ np.array(w)
        told = sorted(((int(s), -k) for k, s in enumerate(scores)), reverse=True)[:5]
        assert sorted(((s, k) for s, _, k in best.heaps[i]), reverse=True) == told
    assert sum(scored) < 500 * 0.8


def test_odd_rows(spark, documents, tmp_path, duck):
    docs = [r[:2] for r in odd_rows()]
    items = [(1, "Then the OLD ship"), (1, "one"), (None, "mail 1"), (None, "É x"), (2, None), (3, ""), (4, "..."), (5, "end word3")]
    folder = tables(spark, documents, tmp_path, docs, items)
    told = expected(docs, items)
    same(plain(QUERIES["op13_ranked_search"](spark, folder)), told)
    same(duck(ranked_search.SQL, folder, ("documents", "benchmark")), told)
    for name, d, i in (("none", [], items), ("no_items", docs, []), ("neither", [], [])):
        assert plain(QUERIES["op13_ranked_search"](spark, tables(spark, documents, tmp_path, d, i, name))) == []
