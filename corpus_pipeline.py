"""The corpus pipeline: stages that each read what the one before wrote.

Language ID, near-duplicate join, redaction of personal data, mixing to target weights,
packing. Each stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tramline.llm import langid, mixing, packing, partenum, pii
from tramline.llm.common import free_name, kept, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose text is near enough to a learned language; the others go."""
    names = tuple(free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_rejected"))
    found = langid.predict(docs, langid.fit(docs), into=names)
    return found.filter(~F.col(names[2])).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of linked documents, the one with the least id; rows without an id stay."""
    first = partenum.join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    one = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    place = free_name(docs, "row_of_id")
    named = (
        docs.join(first, "doc_id", "left_semi")
        .withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1)
    )
    return named.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with each private span replaced by its kind."""
    return pii.redact(docs, pii.trained(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents repeated, left out or, one per source, cut to meet each source's target."""
    into = free_name(docs, "mix")
    return mixing.take(mixing.mix(docs, into=into), into=into).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None   # tokens, trees and centroids are beyond SQL; tests hold stages to plain versions


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, folder)
        if place < len(STAGES) - 1:
            docs = kept(docs, f"pipeline-{name}")
    return docs
