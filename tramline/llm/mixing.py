"""Mixing sources to target weights: hash order, distributed prefix sums, exact cuts.

``mix`` adds one struct column with, for each row, ``size`` (words), ``source_size``,
``target`` (words its source is to give), ``epochs`` (whole repeats) and ``extra`` (words of
one more, partial repeat) and ``taken`` (all words taken). ``take`` turns that into rows.

Rows of a source are ordered by a hash of their id, which is uniform, so equal ranges of the
hash are equal shares of the rows: a range is summed as a whole, ranges are summed up within
their source, and inside a range a running sum gives each row its place. No source, however
large, meets in one task, and nothing but sums leaves the ranges.

Defined cases: a null text has no words; a null source is a source of its own, ordered last;
a null id hashes as the empty string; repeated rows each count and take neighbouring places
(ties in the hash go by id, then size); an empty table gives no rows; sources without words
have the target 0; a column called like the result is replaced, other columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm.common import WORD, free_name, hash_key, power_of_two, table, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5      # of all words
REPEATS = 2      # times a source's words at most
SEED = 7
KEY_BITS = 60
ROWS_A_RANGE = 20_000
LEAST_RANGES = 256


def words(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, repeats=REPEATS) -> DataFrame:
    """From (unnamed, source, source_size), one row per source, to that and ``target``.

    Sources take the weights in turn, in order of their names. A source is full when the
    level of words per weight, with all sources that fill earlier already full, reaches it.
    """
    by_name = W.orderBy("unnamed", "source")
    filling = W.orderBy("ratio", "unnamed", "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy("ratio", "unnamed", "source").rowsBetween(
        W.unboundedPreceding, W.unboundedFollowing)
    return (
        sizes
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(
            F.array(*[F.lit(w).cast("bigint") for w in weights]),
            (F.col("place") - 1) % len(weights) + 1))
        .withColumn("most", F.col("source_size") * F.lit(repeats))
        .withColumn("ratio", F.col("most").cast("double") / F.col("weight"))
        .withColumn("level", (
            F.lit(share) * F.sum("source_size").over(whole)
            - F.coalesce(F.sum("most").over(filling), F.lit(0))
        ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(filling), F.lit(0))))
        .withColumn("full", F.col("level") >= F.col("ratio"))
        .withColumn("level", F.min(F.when(~F.col("full"), F.struct("ratio", "unnamed", "source", "level"))).over(whole)["level"])
        .withColumn("target", F.when(F.col("full"), F.col("most").cast("double")).otherwise(
            F.col("level") * F.col("weight")))
        .select("unnamed", "source", "source_size", "target")
    )


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id",
        into: str = "mix", weights=WEIGHTS, share=SHARE, repeats=REPEATS, seed=SEED) -> DataFrame:
    docs = docs.drop(into)
    bits = min(40, power_of_two(max(LEAST_RANGES, docs.count() / ROWS_A_RANGE)))
    place = hash_key(key, seed, KEY_BITS)
    rows = docs.select(
        *[docs[c].alias(f"d_{i}") for i, c in enumerate(docs.columns)],
        F.col(source).isNull().alias("unnamed"), text_of(source).alias("source"),
        words(text).alias("size"), place.alias("place"),
        F.shiftright(place, KEY_BITS - bits).alias("range"), F.col(key).alias("tie"))
    ranges = rows.groupBy("unnamed", "source", "range").agg(F.sum("size").alias("range_size"))
    sources = ranges.groupBy("unnamed", "source").agg(F.sum("range_size").alias("source_size"))
    before = W.partitionBy("unnamed", "source").orderBy("range").rowsBetween(
        W.unboundedPreceding, -1)
    offsets = (
        ranges.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0)))
        .join(targets(sources, weights, share, repeats), ["unnamed", "source"])
        .drop("range_size")
    )
    inside = W.partitionBy("unnamed", "source", "range").orderBy("place", "tie", "size").rowsBetween(
        W.unboundedPreceding, 0)
    placed = (
        rows.withColumn("until", F.sum("size").over(inside))
        .join(offsets, ["unnamed", "source", "range"])
        .withColumn("start", F.col("before") + F.col("until") - F.col("size"))
        .withColumn("epochs", F.when(
            F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("extra", F.least(F.col("size"), F.greatest(
            F.lit(0).cast("bigint"),
            F.floor("target") - F.col("epochs") * F.col("source_size") - F.col("start"))))
    )
    return placed.select(
        *[F.col(f"d_{i}").alias(c) for i, c in enumerate(docs.columns)],
        F.struct("size", "source_size", "target", "epochs", "extra",
                 (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")).alias(into))


def take(mixed: DataFrame, text: str = "text", chars: str = "n_chars", into: str = "mix") -> DataFrame:
    """The mixture as rows: a row for each whole repeat, and one cut after ``extra`` words.

    The only texts cut are those on which a source's budget ends, one at most per source.
    ``chars``, where there is such a column, follows a cut text.
    """
    spaced_words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(spaced_words, 1, F.col(f"{into}.extra").cast("int")), "")
    whole = F.col(f"{into}.extra") >= F.col(f"{into}.size")
    repeat = F.col(f"{into}.epochs") + F.when(
        (F.col(f"{into}.extra") > 0) & whole, 1).otherwise(0)
    copies = F.concat(
        F.array_repeat(F.lit(True), repeat.cast("int")),
        F.when((F.col(f"{into}.extra") > 0) & ~whole, F.array(F.lit(False))).otherwise(
            F.array().cast("array<boolean>")))
    flag = free_name(mixed, "copy_is_whole")
    rows = mixed.withColumn(flag, F.explode(copies))
    rows = rows.withColumn(text, F.when(F.col(flag), F.col(text)).otherwise(cut))
    if chars in mixed.columns:
        rows = rows.withColumn(chars, F.when(F.col(flag), F.col(chars)).otherwise(F.char_length(text)))
    return rows.drop(flag, into)


def op6_mix_sources(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':7'), 1, 15))::BIGINT AS place
  FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2 * source_size AS most,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources),
filled AS (
  SELECT *, most::DOUBLE / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER f, 0)) /
         (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM weighed
  WINDOW f AS (ORDER BY most::DOUBLE / weight, source IS NULL, source
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size,
         CASE WHEN level >= ratio THEN most::DOUBLE
              ELSE weight * (SELECT arg_min(level, (ratio, source IS NULL, coalesce(source, '')))
                             FROM filled WHERE level < ratio) END AS target
  FROM filled),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size AS start,
         CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS epochs
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target) - epochs * source_size - start)))::BIGINT
         AS taken
FROM placed
"""
