"""Document fingerprints by I-Match with randomised lexicons.

``lexicon`` counts in how many documents each term stands and keeps those within a band of
inverse document frequency. A document's terms in that lexicon are made distinct, sorted, and
hashed: once whole, and for several random subsets of the lexicon (each keeps one term in
4, 16, 64, 256 or 1024). A document and its edited copy agree on a subset if the edit touched
none of its terms; sparse subsets tell long texts apart from others, dense ones short texts.

``likeness`` of two fingerprints: for each density, the share of equal hashes among subsets
that hold a term of either document; the best density with at least four such subsets counts
(all together if none has). It is 1 for equal texts, in 0 to 1 otherwise.

A term is a lower-cased run of letters and digits, known by a 64-bit hash. The lexicon holds
at most (distinct terms per document) / exp(-high idf) terms; it is broadcast if it has
``BROADCAST_TERMS`` or fewer, counted before, and joined by shuffle beyond that.

Defined cases: a null text is an empty one; a text without a lexicon term gets the hash of the
whole text in every place, so only equal texts match it; rows that share an id are ordered by
a hash of their text, and each has the next row as its next document; null ids come last; an
only document is its own next one; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm.common import kept, table, text_of

LOW_IDF, HIGH_IDF = 2.0, 7.5
DENSITIES = (4, 16, 64, 256, 1024)   # a subset holds one term in so many
SUBSETS = (4, 12, 12, 12, 12)        # subsets of each density
LEAST_COMPARED = 4
BROADCAST_TERMS = 2_000_000
ROWS_A_BLOCK = 20_000
LEAST_BLOCKS, MOST_BLOCKS = 200, 10_000
END = "\u0000"   # is no term; stands in every document's list to keep its row


def terms(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), "")


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW_IDF, high: float = HIGH_IDF) -> DataFrame:
    """Terms (64-bit hashes) with an idf, ln(documents / documents with it), in the band."""
    n = docs.count()
    return (
        docs.select(F.explode(terms(text_of(text))).alias("word"))
        .select(F.xxhash64("word").alias("term"))
        .groupBy("term").count()
        .filter((F.col("count") >= n * math.exp(-high)) & (F.col("count") <= n * math.exp(-low)))
        .select("term")
    )


def signatures(rows: DataFrame, found: str, whole: str, into: str) -> DataFrame:
    """Adds 1 + sum(SUBSETS) hashes below 2**32, null where a subset is empty.

    ``found`` is a column of sorted distinct terms. A term is a hash, so some of its bits, others
    for each density, draw the lexicon class it is in; the first few classes are the subsets.
    """
    low_half = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    hashed = lambda a: F.when(F.size(a) > 0, low_half(F.xxhash64(a)))

    def drawn(term: Column, i: int) -> Column:
        return F.shiftright(term, 11 * i).bitwiseAND(F.lit(DENSITIES[i] - 1).cast("bigint"))

    def some(i: int) -> Column:
        return F.filter(found, lambda t: drawn(t, i) < SUBSETS[i])

    def subset(i: int, j: int) -> Column:
        return F.filter(f"{into}_{i}", lambda t: drawn(t, i) == j)

    # Each density's terms are a column of their own, so they are picked out once.
    rows = rows.select("*", *[some(i).alias(f"{into}_{i}") for i in range(len(DENSITIES))])
    hashes = F.array(hashed(F.col(found)), *[
        hashed(subset(i, j)) for i, n in enumerate(SUBSETS) for j in range(n)])
    return rows.withColumn(into, F.when(F.size(found) > 0, hashes).otherwise(
        F.array_repeat(low_half(F.col(whole)), 1 + sum(SUBSETS))))


def shown(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda h: F.coalesce(
        F.lpad(F.lower(F.hex(h)), 8, "0"), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    told = lambda part: F.size(F.filter(part, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    same = lambda part: F.size(F.filter(part, lambda p: p["a"] == p["b"]))
    parts = [F.slice(pairs, 1, 1)] + [
        F.slice(pairs, 2 + sum(SUBSETS[:i]), n) for i, n in enumerate(SUBSETS)]
    shares = [F.when(told(p) >= (1 if i == 0 else LEAST_COMPARED), same(p) / told(p)) for i, p in enumerate(parts)]
    best = F.greatest(*shares)
    return F.when(a == b, 1.0).when(
        F.greatest(*[F.when(told(p) >= LEAST_COMPARED, 1) for p in parts[1:]]).isNotNull(), best).otherwise(
        F.coalesce(F.try_divide(same(pairs), told(pairs)), F.lit(0.0)))


def fingerprints(rows: DataFrame, words: DataFrame, texts: dict[str, str], key: str,
                 carried: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Signatures of each text column in ``texts`` (column to result name), with ``carried``.

    Each row's term lists are exploded, kept where the lexicon has the term, and gathered per
    row again; only terms of the lexicon are shuffled, and none where the lexicon is broadcast and
    rows already lie by the columns ``by``, which the key determines.
    """
    words = kept(words, "lexicon")
    known = words.count()
    words = words.unionByName(rows.sparkSession.range(1).select(F.xxhash64(F.lit(END)).alias("term")))
    if known <= BROADCAST_TERMS:
        words = F.broadcast(words)

    def entries(column: str, side: int) -> Column:
        return F.transform(terms(text_of(column)), lambda w: F.struct(
            F.lit(side).alias("side"), w.alias("word")))

    lists = F.flatten(F.array(
        F.array(F.struct(F.lit(-1).alias("side"), F.lit(END).alias("word"))),
        *[entries(column, i) for i, column in enumerate(texts)]))
    once = F.col("side") == -1
    sums = {c: F.xxhash64(text_of(c)) for c in texts}
    hits = (
        rows.select(*by, key, *carried, *[h.alias(f"whole_{i}") for i, h in enumerate(sums.values())],
                    F.explode(lists).alias("entry"))
        .select(*by, key, "entry.side", F.xxhash64("entry.word").alias("term"),
                *[F.when(F.col("entry.side") == -1, F.col(c)).alias(c)
                  for c in [*carried, *[f"whole_{i}" for i in range(len(texts))]]])
        .join(words, "term")
    )
    carried = [*carried, *[f"whole_{i}" for i in range(len(texts))]]
    gathered = hits.groupBy(*by, key).agg(
        *[F.max(F.when(once, F.col(c))).alias(c) for c in carried],
        *[F.sort_array(F.collect_list(F.when(F.col("side") == i, F.col("term")))).alias(f"terms_{i}")
          for i in range(len(texts))])
    for i, name in enumerate(texts.values()):
        gathered = signatures(gathered, f"terms_{i}", f"whole_{i}", name)
    return gathered.select(key, *carried[:-len(texts)], *texts.values())


def block_of(rows: DataFrame, key: str) -> Column:
    """Blocks of about equal size in descending order of ``key``, nulls last; equal keys share one.

    Edges are approximate quantiles, so ids far from all others don't matter. A row's edge is
    looked up among every few edges first, then among the few between two of these.
    """
    count = rows.count()
    wanted = min(MOST_BLOCKS, max(LEAST_BLOCKS, count // ROWS_A_BLOCK))
    found = rows.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)], 10_000)).first()[0]
    edges = sorted(set(found or ()))
    step = max(1, math.isqrt(len(edges)))
    groups = [edges[i:i + step] for i in range(0, len(edges), step)]
    if not groups:
        return F.lit(1)
    below = lambda some: F.size(F.filter(some, lambda e: e <= F.col(key)))
    literal = lambda some: F.array(*[F.lit(e).cast("bigint") for e in some])
    group = below(literal([g[0] for g in groups]))
    place = F.when(group == 0, 0).otherwise(
        (group - 1) * step + below(F.element_at(F.array(*[literal(g) for g in groups]), F.greatest(group, F.lit(1)))))
    return F.when(F.col(key).isNull(), len(edges) + 1).otherwise(len(edges) - place).cast("bigint")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (block, place, key, text, next_place, next_text) in descending order of ``key``.

    Rows are cut into blocks of ranges of ids; a window looks one row ahead inside each
    block and the last row of a block gets the first row of the next block that has rows.
    """
    rows = docs.select(F.col(key).alias("id"), text_of(text).alias("text"))
    block = block_of(rows, "id")
    heads = (
        rows.withColumn("block", block)
        .groupBy("block").agg(F.min_by("text", F.struct(
            F.col("id").isNull(), F.bitwise_not(F.coalesce("id", F.lit(0))), F.xxhash64("text"))).alias("head_text"))
    )
    order = W.partitionBy("block").orderBy(F.desc_nulls_last("id"), F.xxhash64("text"))
    rows = (
        rows.withColumn("block", block)
        .withColumn("at", F.row_number().over(order))
        .withColumn("next_at", F.lead(F.lit(1)).over(order))
        .withColumn("inside_text", F.lead("text").over(order))
    )
    following = W.orderBy("block")
    whole = following.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    steps = heads.select("block").select(
        "block", F.coalesce(F.lead("block").over(following), F.first("block").over(whole)).alias("next_block"))
    heads = steps.join(
        heads.select(F.col("block").alias("next_block"), "head_text"), "next_block")
    place = lambda block, at: F.shiftleft(block, 32) + at
    return rows.join(heads, "block").select(
        "block", place(F.col("block"), F.col("at")).alias("place"), F.col("id").alias(key), "text",
        F.when(F.col("next_at").isNotNull(), place(F.col("block"), F.col("at") + 1)).otherwise(
            place(F.col("next_block"), F.lit(1))).alias("next_place"),
        F.when(F.col("next_at").isNotNull(), F.col("inside_text")).otherwise(
            F.col("head_text")).alias("next_text"))


def op2_imatch(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    chars = F.char_length("text")
    third = F.floor(chars / 3).cast("int")
    rows = with_next(docs).select(
        "block", "place", "next_place", "doc_id", "text", chars.cast("bigint").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), chars - third),
                 F.substring("next_text", F.lit(1), third)).alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    marks = kept(fingerprints(
        rows, lexicon(docs), {"text": "mark", "edited": "edited_mark"}, "place",
        ["next_place", "doc_id", "n_chars", "edited_sha256"], ("block",)), "imatch")
    after = marks.select(F.col("place").alias("next_place"), F.col("mark").alias("next_mark"))
    return marks.join(after, "next_place").select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("mark")).alias("fingerprint"),
        shown(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"))
