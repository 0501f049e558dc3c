"""Raw records to one clean shape: missing values filtered, counts floored at one, points checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.casts import as_utc_ntz, count_at_least_one, safe_long, safe_timestamp
from tidewatch.functions.geo import checked_latitude, wrap_longitude
from tidewatch.functions.sampling import hash_sample, sample_scan

# Shares of the data that development mode keeps.
DEV_SCAN_PERCENT = 0.01
DEV_SPECIES_BUCKETS = 100


def _with_point(df: DataFrame, lon: str, lat: str, on_bad_point: str) -> DataFrame:
    """Columns lon and lat in place of the raw ones."""
    kept = [name for name in df.columns if name not in (lon, lat)]
    point = df.select(
        *kept,
        wrap_longitude(F.col(lon)).alias("lon"),
        checked_latitude(F.col(lat), on_bad_point).alias("lat"),
    )
    return point.where(F.col("lat").isNotNull()) if on_bad_point == "null" else point


def stage_sites(raw: DataFrame, on_bad_point: str = "fail") -> DataFrame:
    """Sites with a title and a position: title, lon, lat. Titles may repeat."""
    known = raw.where("title IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL")
    return _with_point(known.select("title", "longitude", "latitude"), "longitude", "latitude", on_bad_point)


def stage_gbif(raw: DataFrame, dev: bool = False, seed: int = 0, on_bad_point: str = "fail") -> DataFrame:
    """The typed source: species, individualcount, eventdate, lon, lat where all but the count are known."""
    scan = sample_scan(raw, DEV_SCAN_PERCENT, seed) if dev else raw
    known = scan.where(
        "eventdate IS NOT NULL AND decimallongitude IS NOT NULL AND decimallatitude IS NOT NULL"
        " AND species IS NOT NULL"
    )
    time_type = raw.schema["eventdate"].dataType.typeName()
    shaped = known.select(
        "species",
        count_at_least_one(F.col("individualcount")).alias("individualcount"),
        as_utc_ntz(F.col("eventdate"), time_type).alias("eventdate"),
        "decimallongitude", "decimallatitude",
    )
    return _with_point(shaped, "decimallongitude", "decimallatitude", on_bad_point)


def stage_obis(raw: DataFrame, dev: bool = False, on_bad_point: str = "fail") -> DataFrame:
    """The text-typed source: counts and dates that cannot be read become NULL, rows without a date are dropped.

    A date is read once a row, in an array that is unpacked: a filter on the date would be moved below the columns and
    read the text again for each mention of it.
    """
    known = raw.where("decimalLongitude IS NOT NULL AND decimalLatitude IS NOT NULL AND species IS NOT NULL")
    if dev:
        known = hash_sample(known, "species", DEV_SPECIES_BUCKETS)
    readable = F.filter(F.transform(F.array("eventDate"), safe_timestamp), lambda date: date.isNotNull())
    shaped = known.select(
        "species",
        count_at_least_one(safe_long(F.col("individualCount"))).alias("individualcount"),
        F.explode(readable).alias("eventdate"),
        "decimalLongitude", "decimalLatitude",
    )
    return _with_point(shaped, "decimalLongitude", "decimalLatitude", on_bad_point)


def standardize(staged: DataFrame, source: str) -> DataFrame:
    """The common occurrence shape, tagged with its source."""
    return staged.select(
        F.col("eventdate").alias("event_date"), "species", F.col("individualcount").alias("individual_count"),
        "lon", "lat", F.lit(source).alias("source"),
    )
