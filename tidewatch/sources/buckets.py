"""Tables split into buckets by a key, so that joins on the key need no shuffle.

Tables with the same key and number of buckets are read bucket by bucket, each already sorted; a join of several of them
is a merge within each bucket. Worth it for tables that are written once and joined often.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _name() -> str:
    return f"bucketed_{uuid.uuid4().hex}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` below ``path`` in ``buckets`` files of one bucket each, sorted by ``key``, and return it read back.

    All rows of a key lie in one bucket, so the key should not be one that a large share of the rows has.
    """
    spark, name = df.sparkSession, _name()
    rows = df.repartition(buckets, key)
    rows.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path).mode("error").saveAsTable(name)
    return spark.table(name)


def open_bucketed(spark: SparkSession, path: str, schema: str, key: str, buckets: int) -> DataFrame:
    """A table that an earlier application wrote with the same key and number of buckets."""
    name = _name()
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`)"
              f" INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def merge_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join by merging: between tables of equal buckets there is no exchange, and nothing is broadcast."""
    return left.join(right.hint("merge"), key, how)
