"""Ranked lexical search by dual trees.

A document's coordinate for a term of it is its impact, ``(1000000000 * tf) div (1000 * tf + 8 * m)``
with ``m = 10 + (90 * n * N) div L``; an item's coordinate is the term's weight,
``floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``. A score is the sum of their products.

Documents of a task are put into trees of ``TREE`` documents, in the order of their heaviest
terms, so that like documents share a leaf; items into one tree alike. A node holds the maximum
of each coordinate below it. The product of two nodes' maxima bounds every score of their
pairs; where it is less than the least kth score known for the items of the node, the whole
batch of pairs is left out, which is exact (equal scores are never left out). Else the pair of
nodes is split, the best bound first, down to leaves, whose pairs are bounded item by item and
then scored.

A first pass scores each item leaf's most promising document leaf of each tree only. The kth
best of those scores over all tasks are lower bounds of the results and the starting point of
the second pass, which searches whole trees. Each task hands on at most ``k`` rows an item, and
the best of these are ranked.

Items are a stated query set: they are searched in blocks of about ``TERMS_A_BLOCK`` terms, each
against all documents, so that a block and its bounds fit a task however many items there are.

Defined cases: a null or empty item, or one of no known term, has no rows; rows that share an
item id are one item of all their terms, null ids included; documents are rows, so those that
share an id each have a rank, in the order of their scores; null document ids come last among
equal scores; an empty table on either side gives no rows; other columns are not looked at.
Texts count whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm.common import kept, table, text_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
TREE, LEAF, FAN = 4096, 32, 8          # documents of a tree and of a leaf; children of a node
ITEM_LEAF, ITEM_FAN = 4, 4
TERMS_A_BLOCK = 20_000
NO_ID = (1 << 63) - 1

VECTORS = "doc_id bigint, no_id boolean, n bigint, terms array<int>, counts array<bigint>"
FOUND = "item int, doc_id bigint, no_id boolean, score bigint"

# ASCII other than letters and digits parts terms; only A-Z are lower-cased.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """Distinct (item_id, term)."""
    found = F.regexp_extract_all(lowered(text_of(text)), F.lit(f"({TERM})"))
    return items.select(F.col(key).alias("item_id"), F.explode(found).alias("term")).distinct()


def vector_rows(batches: Iterator[pa.RecordBatch], known: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Each text's number of terms, and its counts of known ones."""
    for batch in batches:
        ids, n, terms, counts = batch.column(0), [], [], []
        for text in batch.column(1):
            found = terms_of(text.as_py())
            n.append(len(found))
            held = Counter(map(known.get, found))
            held.pop(None, None)
            terms.append(list(held))
            counts.append(list(held.values()))
        yield pa.RecordBatch.from_arrays([
            ids.fill_null(NO_ID), ids.is_null(), pa.array(n, pa.int64()),
            pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
            names=["doc_id", "no_id", "n", "terms", "counts"])


class Tree:
    """Levels of nodes over rows of a sparse matrix, each with the maximum of every coordinate below it.

    ``levels[0]`` are the leaves; a node's children are the next ``fan`` of the level below.
    """

    def __init__(self, begin: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int, leaf: int, fan: int):
        sizes = np.diff(begin)
        of = np.repeat(np.arange(len(sizes)), sizes)
        # The heaviest term first: rows of the same heaviest term, then of like weight, are neighbours.
        heaviest = np.lexsort((-values, of))[begin[:-1][sizes > 0]]
        top = np.full(len(sizes), width, np.int64)
        weight = np.zeros(len(sizes), np.int64)
        top[sizes > 0], weight[sizes > 0] = terms[heaviest], values[heaviest]
        self.order = np.lexsort((-weight, top))
        self.begin, self.terms, self.values, self.leaf, self.fan = begin, terms, values, leaf, fan
        place = np.empty(len(sizes), np.int64)
        place[self.order] = np.arange(len(sizes))
        level = np.zeros((-(-len(sizes) // leaf), width), np.int64)
        np.maximum.at(level, (place[of] // leaf, terms), values)
        self.levels = [level]
        while len(level) > 1:
            level = np.maximum.reduceat(level, np.arange(0, len(level), fan), axis=0)
            self.levels.append(level)

    def rows(self, leaf: int) -> np.ndarray:
        return self.order[leaf * self.leaf:(leaf + 1) * self.leaf]

    def below(self, depth: int, node: int) -> np.ndarray:
        return np.arange(node * self.fan, min((node + 1) * self.fan, len(self.levels[depth - 1])))

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), self.levels[0].shape[1]), np.int64)
        for i, r in enumerate(rows):
            own = slice(self.begin[r], self.begin[r + 1])
            out[i, self.terms[own]] = self.values[own]
        return out


class Best:
    """The k best (score, -id) of each item, and the score that a pair has to reach."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, np.maximum(floor, 1)
        self.heaps: list[list] = [[] for _ in floor]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        heap = self.heaps[item]
        for i in np.flatnonzero(scores >= self.floor[item]):
            heapq.heappush(heap, (int(scores[i]), not none[i], -int(ids[i])))
            if len(heap) > self.k:
                heapq.heappop(heap)
        if len(heap) == self.k:
            self.floor[item] = max(self.floor[item], heap[0][0])


def search_tree(items: Tree, docs: Tree, best: Best, ids: np.ndarray, none: np.ndarray, seeds: bool) -> None:
    """All pairs that can be among the best; with ``seeds``, each item leaf's most promising document leaf only."""
    def score(item_leaf: int, doc_leaf: int) -> None:
        own, rows = items.rows(item_leaf), docs.rows(doc_leaf)
        most, values = docs.levels[0][doc_leaf], None
        for item in own:
            at = slice(items.begin[item], items.begin[item + 1])
            terms, weights = items.terms[at], items.values[at]
            if most[terms] @ weights >= best.floor[item]:
                values = docs.dense(rows) if values is None else values
                best.add(item, values[:, terms] @ weights, ids[rows], none[rows])

    def bounds(upper: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(upper)
        return nodes[:, used] @ upper[used]

    if seeds:
        for leaf in range(len(items.levels[0])):
            score(leaf, int(np.argmax(bounds(items.levels[0][leaf], docs.levels[0]))))
        return

    def needed(depth: int, node: int) -> int:
        """The weakest kth score of the items below a node."""
        width = items.leaf * items.fan ** depth
        return int(best.floor[items.order[node * width:(node + 1) * width]].min())

    at, to = len(items.levels) - 1, len(docs.levels) - 1
    stack = [(int(bounds(items.levels[at][0], docs.levels[to][:1])[0]), at, 0, to, 0)]
    while stack:
        bound, a, i, b, j = stack.pop()
        if bound < needed(a, i) or bound < 1:
            continue
        if a == 0 and b == 0:
            score(i, j)
        elif b >= a:                         # split the documents; the best bound is popped first
            below = docs.below(b, j)
            found = bounds(items.levels[a][i], docs.levels[b - 1][below])
            stack += sorted((int(x), a, i, b - 1, int(n)) for x, n in zip(found, below))
        else:
            below = items.below(a, i)
            found = [int(bounds(items.levels[a - 1][n], docs.levels[b][j:j + 1])[0]) for n in below]
            stack += sorted((x, a - 1, int(n), b, j) for x, n in zip(found, below))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    m = 10 + 90 * n * documents // max(1, length)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def search_rows(batches: Iterator[pa.RecordBatch], begin: np.ndarray, terms: np.ndarray, weights: np.ndarray,
                floor: np.ndarray, width: int, documents: int, length: int, k: int, seeds: bool) -> Iterator[pa.RecordBatch]:
    """A task's best documents of each item."""
    items = Tree(begin, terms, weights, width, ITEM_LEAF, ITEM_FAN)
    best = Best(floor, k)

    def search(held: pa.Table) -> None:
        held = held.filter(pc.greater(pc.list_value_length(held["terms"]), 0)).combine_chunks()
        if not len(held):
            return
        sizes = pc.list_value_length(held["terms"]).to_numpy()
        tf = pc.list_flatten(held["counts"]).to_numpy()
        value = impacts(tf, np.repeat(held["n"].to_numpy(), sizes), documents, length)
        tree = Tree(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
                    pc.list_flatten(held["terms"]).to_numpy().astype(np.int64), value, width, LEAF, FAN)
        search_tree(items, tree, best, held["doc_id"].to_numpy(), held["no_id"].to_numpy(zero_copy_only=False), seeds)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, len(batch), TREE):
            held.append(batch.slice(at, TREE))
            if sum(map(len, held)) >= TREE:
                search(pa.Table.from_batches(held))
                held = []
    if held:
        search(pa.Table.from_batches(held))
    found = [(i, -at, not known, score) for i, heap in enumerate(best.heaps) for score, known, at in heap]
    columns = list(zip(*found)) or [[]] * 4
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.bool_(), pa.int64()))],
        names=["item", "doc_id", "no_id", "score"])


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), "no_id", "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The best documents of one block of items, whose (item_id, term) come to the driver."""
    spark, held = docs.sparkSession, pairs.collect()
    names = sorted({r["item_id"] for r in held}, key=lambda x: (x is None, x))
    item_of = {name: i for i, name in enumerate(names)}
    words = sorted({r["term"] for r in held})
    known = {w.encode(): i for i, w in enumerate(words)}
    vectors = kept(docs.mapInArrow(lambda b: vector_rows(b, known), VECTORS), "vectors")
    whole = vectors.filter("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    documents, length = whole
    df = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * df[i] + 1))) if i in df else 0 for i in range(len(words))]
    rows = sorted((item_of[r["item_id"]], known[r["term"].encode()]) for r in held if known[r["term"].encode()] in df)
    of, terms = (np.array(x, np.int64) for x in zip(*rows)) if rows else (np.zeros(0, np.int64),) * 2
    begin = np.searchsorted(of, np.arange(len(names) + 1))
    weights = np.array(weight, np.int64)[terms]

    def searched(floor: np.ndarray, seeds: bool) -> DataFrame:
        return vectors.mapInArrow(lambda b: search_rows(
            b, begin, terms, weights, floor, max(1, len(words)), documents, length, k, seeds), FOUND)

    floor = np.zeros(len(names), np.int64)
    for r in ranked(searched(floor, True), k).filter(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r["score"]
    kind = dict(pairs.dtypes)["item_id"]
    shown = spark.createDataFrame([(i, name) for i, name in enumerate(names)], f"item int, item_id {kind}")
    return ranked(searched(floor, False), k).join(F.broadcast(shown), "item").select(
        "item_id", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, text: str = "text", key: str = "doc_id",
           item_text: str = "text", item_key: str = "item_id", terms_a_block: int = TERMS_A_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of the highest score above 0."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    pairs = kept(item_terms(items, item_text, item_key), "item-terms")
    blocks = max(1, -(-pairs.count() // terms_a_block))
    out = None
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        found = search_block(docs, own, k)
        out = found if out is None else out.unionByName(found)
    return out


def op13_ranked_search(spark, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def sql_terms(name: str, key: str) -> str:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return (f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), '{letters}', "
            f"'{letters.lower()}'), '{TERM}')) AS term FROM {name}")


SQL = f"""
WITH numbered AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, text FROM documents
), found AS MATERIALIZED ({sql_terms('numbered', 'doc')}
), sizes AS (
  SELECT doc, count(*) AS n FROM found GROUP BY doc
), whole AS (
  SELECT count(*)::BIGINT AS documents, sum(n)::BIGINT AS length FROM sizes
), wanted AS (
  SELECT DISTINCT item_id, term FROM ({sql_terms('benchmark', 'item_id')})
), counts AS MATERIALIZED (
  SELECT doc, term, count(*)::BIGINT AS tf FROM found WHERE term IN (SELECT term FROM wanted) GROUP BY doc, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counts, whole GROUP BY term
), coordinates AS (
  SELECT doc, term, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * documents) // length)) AS impact
  FROM counts JOIN sizes USING (doc), whole
), scores AS (
  SELECT item_id, doc, sum(w * impact)::BIGINT AS score
  FROM wanted JOIN coordinates USING (term) JOIN weights USING (term) GROUP BY item_id, doc
), placed AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scores JOIN numbered USING (doc) WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM placed WHERE rank <= {K}
"""
