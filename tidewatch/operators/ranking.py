"""Counting, ranking and top-k per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_by_count(counts: DataFrame, group: str, count: str, rank: str) -> DataFrame:
    """RANK() of each row in its group by descending count, with gaps after ties.

    A row's rank is one more than the number of rows in its group with a higher count. That needs only how
    many rows share each count, a table far smaller than the rows, so no task ever sorts a whole group.
    """
    levels = counts.groupBy(group, count).agg(F.count(F.lit(1)).alias("_rows"))
    above = Window.partitionBy(group).orderBy(F.desc(count)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select(
        group, count, (F.coalesce(F.sum("_rows").over(above), F.lit(0)) + 1).cast("bigint").alias(rank)
    )
    return counts.join(ranks, [group, count]).select(*counts.columns, rank)


def top_per_group(df: DataFrame, group: str, n: int, order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each group; map tasks already keep no more than ``n`` of a group."""
    position = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("_position", position).where(F.col("_position") <= n).drop("_position")


def share_of_group_max(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Each value divided by the largest of its group (heat intensity in 0..1).

    The maxima are aggregated first and joined back, so a hot group stays spread over its tasks.
    """
    maxima = df.groupBy(group).agg(F.max(value).alias("_max"))
    return df.join(maxima, group).withColumn(name, F.col(value) / F.col("_max")).drop("_max")


def bounded(limit: int, highest: int) -> int:
    if not 1 <= limit <= highest:
        raise ValueError(f"limit must be in 1..{highest}, not {limit}")
    return limit
