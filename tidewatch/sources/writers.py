"""Table sinks: overwrite by default, optionally by month and clustered for row-group skipping."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidewatch.functions.geo import Grid
from tidewatch.operators.copies import is_counted, repeated, split_copies
from tidewatch.operators.joins import measure, measure_repeated
from tidewatch.operators.spatial import RADIUS_M
from tidewatch.session import new_table_path

# Side of the square, in degrees, whose points are written together in a table clustered by geography.
TILE_DEGREES = 5.0


# Bytes of data, before encoding, that a file of a clustered table holds at most; and at least, where a smaller table is
# cut into one file per core.
FILE_BYTES, LEAST_FILE_BYTES = 256 * 1024 * 1024, 4 * 1024 * 1024

# Months of one range that are written at a time before Spark sorts the rest by month. Rows come in the order of the
# month, so one of them grows at a time; a range of a large table has few.
OPEN_MONTHS = 32

# Rows that are sampled to cut the ranges: so many in all, which few ranges share, or so many a range, as Spark does.
SAMPLED_ROWS, LEAST_SAMPLED_ROWS = 100_000, 100


@contextmanager
def _settings(spark: SparkSession, values: dict[str, int]) -> Iterator[None]:
    """Session settings that hold for one write."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def file_count(data_bytes: int, cores: int) -> int:
    """So many files that none exceeds ``FILE_BYTES``, and that all cores write unless files would get too small."""
    return max(1, math.ceil(data_bytes / FILE_BYTES), min(cores, data_bytes // LEAST_FILE_BYTES))


def _clustered(
    df: DataFrame, month: str | None, cluster_by: list[str], files: int | None, stored: bool
) -> tuple[DataFrame, int]:
    """Rows in the order of the month and the cluster keys, cut into ranges, one file each; and how many ranges.

    Neighbouring keys lie in one file, so its statistics name a narrow range and a filter on a key skips the others. A
    hash of the row is the last part of the order: a key that holds a third of the rows spans several neighbouring
    files. The rows are stored first, so that counting and sampling them computes nothing again; ``stored`` rows lie in
    files already.

    Counted rows are ordered as such and repeated in the task that writes them. Rows of more copies than the average are
    cut first, so that ranges of equally many rows are files of about equal size.
    """
    rows = df
    if not stored:
        unordered = new_table_path(df.sparkSession, "unordered")
        df.write.parquet(unordered)
        rows = df.sparkSession.read.schema(df.schema).parquet(unordered)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if is_counted(rows):
        found, size = measure_repeated(rows)
        files = files or file_count(size.bytes, cores)
        rows = split_copies(rows, max(1, math.ceil(size.rows / max(1, found))))
    elif files is None:
        files = file_count(measure(rows).bytes, cores)
    order, out = [month] if month else [], rows.withColumn("_row", F.xxhash64(*rows.columns))
    for name in cluster_by:
        if name == "geography":
            tile = F.floor(F.col("lat") / TILE_DEGREES) * 1000 + F.floor(F.col("lon") / TILE_DEGREES)
            out = Grid(RADIUS_M).with_cell(out.withColumn("_tile", tile), "_cell")
            order += ["_tile", "_cell"]
        else:
            order.append(name)
    ranges = out.repartitionByRange(files, *order, "_row").sortWithinPartitions(*order)
    return repeated(ranges.drop("_tile", "_cell", "_row", "_piece")), files


def write_table(
    df: DataFrame,
    path: str,
    codec: str = "snappy",
    partition_month: str | None = None,
    cluster_by: list[str] | None = None,
    mode: str = "overwrite",
    partitions: int | None = None,
    keep_other_months: bool = False,
    stored: bool = False,
) -> None:
    """Write parquet.

    ``partition_month`` adds an ``event_month`` folder per month of that column; with ``keep_other_months`` an
    overwrite replaces only the months it writes. ``cluster_by`` writes ranges of those columns to files of their own,
    sorted, so that a filter on them skips files and row groups; ``"geography"`` stands for the position (lon, lat).
    ``partitions`` asks for about that many files; without it a clustered table has as many as ``file_count`` says,
    and one more where a month begins. A table stays a folder of part files. A counted table (``operators.copies``) is
    written with its rows repeated. ``stored`` says that the rows are read from files other than those of ``path``, by
    little more than filters: a clustered table is then made from them without a copy in between.

    Month folders are filled from rows that lie in the order of the month. Spark doesn't see that order once rows are
    repeated and would sort every copy again, so it is told to keep the months of a range open instead.
    """
    out, month, settings = df, None, {}
    if partition_month:
        month = "event_month"
        out = out.withColumn(month, F.date_trunc("month", F.col(partition_month)).cast("date"))
    if month or cluster_by:
        out, files = _clustered(out, month, cluster_by or [], partitions, stored)
        settings["spark.sql.execution.rangeExchange.sampleSizePerPartition"] = max(LEAST_SAMPLED_ROWS, SAMPLED_ROWS // files)
    elif partitions:
        out = repeated(out.repartition(partitions))
    else:
        out = repeated(out)
    writer = out.write.mode(mode).option("compression", codec)
    if month:
        writer = writer.partitionBy(month).option(
            "partitionOverwriteMode", "dynamic" if keep_other_months else "static"
        )
        settings["spark.sql.maxConcurrentOutputFileWriters"] = OPEN_MONTHS
    with _settings(df.sparkSession, settings):
        writer.parquet(path)


def read_months(
    spark: SparkSession, path: str, first_month: str | None = None, last_month: str | None = None, as_text: bool = False
) -> DataFrame:
    """Rows of a month-partitioned table whose month lies in the given range; other folders are not opened.

    Either end may be open. ``as_text`` gives the month as its folder is named, yyyy-MM-dd: that costs a row nothing,
    while formatting a date costs as much as reading the row.
    """
    rows = spark.read.parquet(path)
    if as_text:
        schema = [StructField("event_month", StringType()) if f.name == "event_month" else f for f in rows.schema]
        rows = spark.read.schema(StructType(schema)).parquet(path)
    month = F.col("event_month").cast("date")
    if first_month is not None:
        rows = rows.where(month >= F.lit(first_month).cast("date"))
    if last_month is not None:
        rows = rows.where(month <= F.lit(last_month).cast("date"))
    return rows


def read_event_dates(
    spark: SparkSession, path: str, since: datetime | None = None, until: datetime | None = None
) -> DataFrame:
    """Rows of a month-partitioned table with ``since <= event_date < until``; either end may be open.

    The months that can hold such a time are derived here, so the folders of all others are not opened.
    """
    rows = spark.read.parquet(path)
    if since is not None:
        first = since.date().replace(day=1)
        rows = rows.where((F.col("event_month") >= F.lit(first)) & (F.col("event_date") >= F.lit(since).cast("timestamp_ntz")))
    if until is not None:
        rows = rows.where((F.col("event_month") <= F.lit(until.date())) & (F.col("event_date") < F.lit(until).cast("timestamp_ntz")))
    return rows


def export_serving(tables: dict[str, DataFrame], folder: str) -> None:
    """Write the serving tables as one folder each."""
    cluster = {"species_divesite_summary": ["species"], "divesite_species_detail": ["dive_site"]}
    for name, table in tables.items():
        write_table(table, f"{folder.rstrip('/')}/{name}", cluster_by=cluster.get(name))
