"""Rows that stand for several equal ones.

A repeated taxonomy name repeats every record of that name. A counted table has each record once and how often it
occurs in ``COPIES``: filters, joins, distances, sorts and shuffles then work on records, sums weigh them, and
``repeated`` writes them out last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES = "_copies"


def is_counted(df: DataFrame) -> bool:
    return COPIES in df.columns


def copies_column(df: DataFrame) -> list[str]:
    """The column to carry through a projection, if the table is counted."""
    return [COPIES] if is_counted(df) else []


def repeated(df: DataFrame) -> DataFrame:
    """Each row as often as ``COPIES`` says, without that column; a table that is not counted stays as it is."""
    if not is_counted(df):
        return df
    names = [name for name in df.columns if name != COPIES]
    # One byte a copy, of one row at a time.
    each = F.explode(F.array_repeat(F.lit(0).cast("tinyint"), F.col(COPIES).cast("int")))
    return df.select(*names, each.alias("_copy")).drop("_copy")


def split_copies(df: DataFrame, most: int) -> DataFrame:
    """A counted table whose rows stand for at most ``most`` rows each, with the number of the piece in ``_piece``."""
    pieces = F.sequence(F.lit(0).cast("bigint"), F.expr(f"({COPIES} - 1) div {most}"))
    return df.withColumn("_piece", F.explode(pieces)).withColumn(
        COPIES, F.least(F.lit(most).cast("bigint"), F.col(COPIES) - F.col("_piece") * most))


def count_rows(df: DataFrame, condition: Column | None = None) -> Column:
    """Aggregate: how many rows there are, or for how many the condition holds, copies included."""
    if not is_counted(df):
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    weight = F.col(COPIES) if condition is None else F.when(condition, F.col(COPIES))
    return F.coalesce(F.sum(weight), F.lit(0).cast("bigint"))
