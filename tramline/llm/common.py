"""Helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.session import shared_folder

# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where a frame feeds several branches or rounds, so that a lost executor costs a
    re-read and every branch sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made of it that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_key(column: str, seed: int, bits: int = 60) -> Column:
    """A random-looking key below 2**bits that DuckDB computes alike (from MD5)."""
    shown = F.coalesce(F.col(column).cast("string"), F.lit(""))
    digits = F.substring(F.md5(F.concat(shown, F.lit(f":{seed}"))), 1, bits // 4)
    return F.conv(digits, 16, 10).cast("bigint")


def power_of_two(n: float) -> int:
    """Exponent of the smallest power of two that is at least n."""
    return max(0, int(n - 1).bit_length()) if n > 1 else 0


def drawn(df: DataFrame, key: str, seed: int, most: int) -> DataFrame:
    """About ``most`` rows (twice as many at most), chosen by a hash of the key."""
    share = min(1.0, most / max(1, df.count()))
    return df.filter(hash_key(key, seed) < F.lit(int(share * (1 << 60)))).limit(2 * most)
