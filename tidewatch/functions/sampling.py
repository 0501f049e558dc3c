"""Samples that always pick the same keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_bucket(key: Column, buckets: int) -> Column:
    """Bucket 0..buckets-1 of a text key, from the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets


def hash_sample(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """All rows of about one key in ``buckets``: whole keys are kept or left out."""
    return df.where(hash_bucket(F.col(key), buckets) == 0)


def sample_scan(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """A random share of the rows of a scan."""
    return df.sample(withReplacement=False, fraction=percent / 100.0, seed=seed)


def sample_files(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """All rows of about a share of the files of a scan, by a hash of seed and file name; other files are not opened.

    ``df`` reads files, without joins or aggregates in between. The share is close where files are many and alike.
    """
    chosen = F.pmod(F.xxhash64(F.lit(seed), F.col("_metadata.file_name")), F.lit(1_000_000)) < round(percent * 10_000)
    return df.where(chosen)
