"""The tables of the site and species model, each a DataFrame of its inputs.

Joins keep the multiplicity of their keys: taxonomy names, site titles and enrichment rows may repeat, and a
repeated key repeats the rows it matches. ``fanout_safe`` and ``mode="semi"`` variants count each row once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.sampling import hash_sample
from tidewatch.operators.copies import copies_column
from tidewatch.operators.joins import lookup_join
from tidewatch.operators.ranking import rank_by_count
from tidewatch.operators.spatial import RADIUS_M, closest_per_key, nearest_among, nearest_site, within_distance
from tidewatch.operators.taxa import classify_species, validate_taxa
from tidewatch.plans.staging import standardize
from tidewatch.sources.buckets import merge_join

# Fixed value: development mode keeps about one species in this many before the distance join.
DEV_NEAR_BUCKETS = 20

# Occurrences at the same distance are taken in this order.
NEAR_TIE_BREAK = ["dive_site", "species", "source", "individual_count", "lon", "lat"]


def all_records(gbif: DataFrame, obis: DataFrame) -> DataFrame:
    """Both staged sources in the common shape."""
    return standardize(gbif, "GBIF").unionByName(standardize(obis, "OBIS"))


def occurrences(gbif: DataFrame, obis: DataFrame, taxonomy: DataFrame, mode: str = "inner") -> DataFrame:
    """Records of both sources whose species is in the taxonomy; see ``validate_taxa`` for the modes."""
    return validate_taxa(all_records(gbif, obis), taxonomy, mode)


def species(occurrence_table: DataFrame, redlist: DataFrame, invasive: DataFrame) -> DataFrame:
    """Each observed species once, with its conservation flags."""
    return classify_species(occurrence_table.select("species").distinct(), redlist, invasive)


def near_dive_site_occurrences(
    occurrence_table: DataFrame,
    sites: DataFrame,
    radius_m: float = RADIUS_M,
    rank_by: str | None = "event_date",
    dev: bool = False,
) -> DataFrame:
    """Occurrences near a site.

    ``rank_by="event_date"``: the closest pair per distinct timestamp of the whole data set (what the model is
    defined as). ``"occurrence"``: every occurrence with its closest site. ``None``: every pair within the radius.
    Of counted occurrences the last two give counted pairs; copies don't change the closest pair of a timestamp.
    """
    records = hash_sample(occurrence_table, "species", DEV_NEAR_BUCKETS) if dev else occurrence_table
    shape = ["dive_site", "event_date", "species", "individual_count", "distance_to_dive_site", "lon", "lat",
             "source"]
    if rank_by is None:
        return within_distance(records, sites, radius_m).select(*shape, *copies_column(records))
    if rank_by not in ("event_date", "occurrence"):
        raise ValueError(f"rank_by must be 'event_date', 'occurrence' or None, not {rank_by!r}")
    if rank_by == "event_date":
        pairs = nearest_among(records, sites, radius_m).select(*shape)
        best = closest_per_key(pairs, ["event_date"], NEAR_TIE_BREAK)
    else:
        best = nearest_site(records, sites, radius_m).select(*shape, *copies_column(records))
    return best.withColumn("proximity_rank", F.lit(1).cast("bigint"))


def sighting_counts(near: DataFrame) -> DataFrame:
    return near.groupBy("dive_site", "species").agg(F.count(F.lit(1)).alias("sighting_count"))


def divesite_species_frequency(near: DataFrame) -> DataFrame:
    """Sightings per site title and species, ranked within the title."""
    return rank_by_count(sighting_counts(near), "dive_site", "sighting_count", "frequency_rank")


def monthly_species_occurrences(near: DataFrame, sites: DataFrame, grain: str = "event_date") -> DataFrame:
    """Sightings per site, species and event date with the month's short name and the site position.

    ``grain="month"`` counts per calendar month instead; ``event_date`` is then the first of the month.
    """
    if grain not in ("event_date", "month"):
        raise ValueError(f"grain must be 'event_date' or 'month', not {grain!r}")
    dated = near
    if grain == "month":
        dated = near.withColumn("event_date", F.date_trunc("month", F.col("event_date")).cast("timestamp_ntz"))
    counts = dated.groupBy(
        "dive_site", "species", "event_date", F.date_format("event_date", "MMM").alias("month")
    ).agg(F.count(F.lit(1)).alias("sighting_count"))
    places = sites.select(F.col("title").alias("dive_site"), "lon", "lat")
    return lookup_join(counts, places, "dive_site", "inner", size_of=sites).select(
        "dive_site", "species", "lon", "lat", "month", "event_date", "sighting_count"
    )


def _described(frequency: DataFrame, species_table: DataFrame, sites: DataFrame, enrichment: DataFrame) -> DataFrame:
    places = sites.select(
        F.col("title").alias("dive_site"),
        F.col("lat").alias("dive_site_latitude"),
        F.col("lon").alias("dive_site_longitude"),
    )
    # The species table is as long as the taxonomy; adaptive execution measures it and picks the join. A species
    # has at most one row per site here, so its rows need no salt.
    typed = frequency.join(species_table, "species")
    placed = lookup_join(typed, places, "dive_site", "inner", size_of=sites)
    return lookup_join(placed, enrichment, "species", "left", hot_keys=False)


def detail_from_buckets(frequency: DataFrame, species_table: DataFrame, enrichment: DataFrame, sites: DataFrame) -> DataFrame:
    """``divesite_species_detail`` from three tables bucketed by species: their join merges bucket with bucket."""
    joined = merge_join(merge_join(frequency, species_table, "species"), enrichment, "species", "left")
    places = sites.select(
        F.col("title").alias("dive_site"),
        F.col("lat").alias("dive_site_latitude"),
        F.col("lon").alias("dive_site_longitude"),
    )
    return lookup_join(joined, places, "dive_site", "inner", size_of=sites).select(*DETAIL)


# Columns of a site's species panel (fixed values).
DETAIL = [
    "dive_site", "dive_site_latitude", "dive_site_longitude", "species", "common_name", "description",
    "image_url", "is_endangered", "is_invasive", "species_type", "sighting_count", "frequency_rank",
]


def divesite_species_detail(
    frequency: DataFrame, species_table: DataFrame, sites: DataFrame, enrichment: DataFrame
) -> DataFrame:
    """Everything a site's species panel shows."""
    return _described(frequency, species_table, sites, enrichment).select(*DETAIL)


def species_divesite_summary(
    frequency: DataFrame, species_table: DataFrame, sites: DataFrame, enrichment: DataFrame
) -> DataFrame:
    """Everything the map of one species shows."""
    narrow = enrichment.select("species", "common_name", "image_url")
    return _described(frequency, species_table, sites, narrow).select(
        "species", "common_name", "image_url", "is_endangered", "is_invasive", "species_type", "dive_site",
        "dive_site_latitude", "dive_site_longitude", "sighting_count", "frequency_rank",
    )


def site_totals(detail: DataFrame) -> DataFrame:
    """Per site title: distinct species, sightings, and rows flagged endangered or invasive."""
    return detail.groupBy("dive_site").agg(
        F.count_distinct("species").alias("total_species"),
        F.sum("sighting_count").alias("total_sightings"),
        F.count_if("is_endangered").alias("endangered_count"),
        F.count_if("is_invasive").alias("invasive_count"),
    )


def divesite_summary(
    sites: DataFrame,
    detail: DataFrame | None = None,
    fanout_safe: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """Every site with its totals, zero where nothing was seen.

    From ``detail`` the sightings and flag counts include the rows that repeated titles and enrichment rows add.
    ``fanout_safe=(frequency, species_table)`` counts each species of a title once instead.
    """
    if fanout_safe is not None:
        frequency, species_table = fanout_safe
        totals = site_totals(frequency.join(species_table, "species"))
    elif detail is not None:
        totals = site_totals(detail)
    else:
        raise ValueError("give either detail or fanout_safe")
    numbers = ("total_species", "total_sightings", "endangered_count", "invasive_count")
    return sites.withColumnRenamed("title", "dive_site").join(totals, "dive_site", "left").select(
        "dive_site", F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
        *(F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name) for name in numbers),
    )
