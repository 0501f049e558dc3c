"""Counts per month that are kept, so that a change in few months is recounted there only.

The closest pair of a timestamp lies in the month of the timestamp, so a month's counts follow from its own records. The
ranks and totals of all time are sums over the months.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.ranking import rank_by_count
from tidewatch.operators.spatial import RADIUS_M
from tidewatch.plans.models import near_dive_site_occurrences

COUNTS = "dive_site string, species string, sighting_count bigint, event_month date"


def month_counts(near: DataFrame) -> DataFrame:
    """Sightings per month, site title and species."""
    month = F.date_trunc("month", F.col("event_date")).cast("date").alias("event_month")
    return near.groupBy(month, "dive_site", "species").agg(F.count(F.lit(1)).alias("sighting_count")).select(
        "dive_site", "species", "sighting_count", "event_month")


def restate_months(
    spark: SparkSession, occurrences: str, sites: DataFrame, counts: str, months: list[date] | None = None,
    radius_m: float = RADIUS_M,
) -> None:
    """Recount the given months of a month-partitioned occurrence table into the folder ``counts``; all months if None.

    Only the folders of those months are read and replaced. A month that holds no record any more is replaced too: each
    recounted month has one row without site, which readers leave out.
    """
    records = spark.read.parquet(occurrences)
    if months is None:
        wanted = records.select("event_month").distinct()
    else:
        records = records.where(F.col("event_month").isin(*months))
        wanted = spark.createDataFrame([(m,) for m in months], "event_month date")
    near = near_dive_site_occurrences(records.drop("event_month"), sites, radius_m)
    marked = wanted.select(F.lit(None).cast("string").alias("dive_site"), F.lit(None).cast("string").alias("species"),
                           F.lit(0).cast("bigint").alias("sighting_count"), "event_month")
    # Rows of a month are one group per site and species, so a month is a few files at most.
    rows = month_counts(near).unionByName(marked).repartition("event_month", F.pmod(F.xxhash64("dive_site"), F.lit(4)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_month").parquet(counts)


def read_counts(spark: SparkSession, counts: str) -> DataFrame:
    """The kept counts of all months."""
    return spark.read.schema(COUNTS).parquet(counts).where("dive_site IS NOT NULL")


def frequency_from_counts(counts: DataFrame) -> DataFrame:
    """Sightings per site title and species over all months, ranked within the title."""
    total = counts.groupBy("dive_site", "species").agg(F.sum("sighting_count").alias("sighting_count"))
    return rank_by_count(total, "dive_site", "sighting_count", "frequency_rank")
