"""Equi-joins that hold when one key carries a third of the rows."""

from __future__ import annotations

import weakref
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.copies import COPIES

# A side is sent to every executor only when counting it proved both bounds.
BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 64 * 1024 * 1024
# Beyond them the rows of the large side are spread over this many copies of each small-side key.
SALTS = 16

_SALT = "_salt"
_sizes: weakref.WeakKeyDictionary[DataFrame, Size] = weakref.WeakKeyDictionary()


class Size(NamedTuple):
    rows: int
    bytes: int

    @property
    def can_broadcast(self) -> bool:
        return self.rows <= BROADCAST_MAX_ROWS and self.bytes <= BROADCAST_MAX_BYTES


def measure(df: DataFrame) -> Size:
    """Rows and data bytes of a table, counted by one aggregation over it; kept for this DataFrame."""
    size = _sizes.get(df)
    if size is None:
        rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(_row_bytes(df)), F.lit(0))).first()
        size = _sizes[df] = Size(rows, total)
    return size


def _row_bytes(df: DataFrame) -> Column:
    widths = [
        F.coalesce(F.octet_length(F.col(field.name).cast("string")), F.lit(0))
        if field.dataType.typeName() not in ("double", "long", "timestamp", "timestamp_ntz", "date", "boolean", "integer")
        else F.lit(8)
        for field in df.schema.fields
    ]
    return sum(widths[1:], widths[0]).cast("bigint")


def measure_repeated(df: DataFrame) -> tuple[int, Size]:
    """Rows of a counted table, and the size it has once they are repeated, by one aggregation."""
    bare = df.drop(COPIES)
    found, rows, total = df.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(COPIES), F.lit(0)), F.coalesce(F.sum(_row_bytes(bare) * F.col(COPIES)), F.lit(0))
    ).first()
    return found, Size(rows, total)


def with_row_salt(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """Spread equal rows too: the salt is a hash of the row and of the input partition it was read from.

    A task that runs again after a lost executor reads the same partition, so it gives the same salts, in whatever
    order the rows arrive. Copies within one partition share a salt; a partition is one file split at most.
    """
    return df.withColumn(_SALT, F.pmod(F.xxhash64(F.spark_partition_id(), *df.columns), F.lit(salts)).cast("int"))


def with_every_salt(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each row once per salt."""
    return df.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salted_join(large: DataFrame, small: DataFrame, on: list[str], how: str, salts: int = SALTS) -> DataFrame:
    """Shuffle join in which a hot key of the large side is spread over ``salts`` tasks.

    Spark is told to merge: its own estimate is taken from the files a side is read from, knows nothing of the rows that
    are unpacked from them, and would send a side to the driver and to every executor that doesn't fit there.
    """
    return (
        with_row_salt(large, salts)
        .join(with_every_salt(small, salts).hint("merge"), [*on, _SALT], how)
        .drop(_SALT)
    )


def lookup_join(large: DataFrame, small: DataFrame, on: list[str] | str, how: str = "inner",
                size_of: DataFrame | None = None, hot_keys: bool = True) -> DataFrame:
    """Join a large table to a reference table: broadcast if counting proves it small, else shuffle.

    The shuffle is salted unless the keys of the large side are known to be few rows each (``hot_keys=False``);
    salting copies the small side ``SALTS`` times. ``size_of`` names the stored table the lookup was derived from
    without growing, so that it is counted once.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"not a lookup join: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if measure(size_of if size_of is not None else small).can_broadcast:
        return large.join(F.broadcast(small), keys, how)
    if not hot_keys:
        return large.join(small.hint("merge"), keys, how)
    return salted_join(large, small, keys, how)
