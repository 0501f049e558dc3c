"""The questions asked of the finished tables: where is a species, and what lives near a site.

Each takes a table and parameters and returns a DataFrame. The ``every_``/``top_`` forms answer for all keys at
once, in one distributed job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import contains_ignoring_case, display_title, has_all_tokens, is_image_url, tokens
from tidewatch.operators.ranking import bounded, share_of_group_max, top_per_group

SPECIES_TYPES = ("all", "endangered", "invasive", "normal")

CARD = ["species", "common_name", "image_url", "species_type", "is_endangered", "is_invasive"]
PROFILE = ["species", "common_name", "description", "image_url", "species_type", "is_endangered", "is_invasive"]


def _of_type(df: DataFrame, species_type: str) -> DataFrame:
    return df if species_type == "all" else df.where(F.col("species_type") == species_type)


def matching_species(summary: DataFrame, q: str = "", species_type: str = "all", escape: bool = False) -> DataFrame:
    """All species whose scientific or common name contains ``q``, one row per distinct card."""
    found = summary
    if q:
        found = found.where(
            contains_ignoring_case(F.col("species"), q, escape)
            | contains_ignoring_case(F.col("common_name"), q, escape)
        )
    return _of_type(found, species_type).select(*CARD).distinct()


def search_species(
    summary: DataFrame, q: str = "", species_type: str = "all", limit: int = 20, escape: bool = False
) -> DataFrame:
    """The first ``limit`` (1..100) matches by name; cards of one name are ordered by their other columns."""
    order = ["species", *(F.asc_nulls_last(name) for name in ("common_name", "image_url"))]
    return matching_species(summary, q, species_type, escape).orderBy(*order).limit(bounded(limit, 100))


def every_species_detail(detail: DataFrame) -> DataFrame:
    """Profile, sightings and number of sites of every species."""
    return detail.groupBy(*PROFILE).agg(
        F.sum("sighting_count").alias("total_sightings"), F.count_distinct("dive_site").alias("total_sites")
    )


def species_detail(detail: DataFrame, name: str) -> DataFrame:
    """Profile of one species: one row or none."""
    one = every_species_detail(detail.where(F.col("species") == name))
    return one.orderBy(*(F.asc_nulls_last(c) for c in ("common_name", "description", "image_url"))).limit(1)


def every_species_sites(summary: DataFrame) -> DataFrame:
    """Sites of every species with positions, counts and ranks."""
    return summary.select(
        "species", "dive_site", F.col("dive_site_latitude").alias("latitude"),
        F.col("dive_site_longitude").alias("longitude"), "sighting_count", "frequency_rank",
    )


def species_sites(summary: DataFrame, name: str) -> DataFrame:
    """Sites of one species, best rank first."""
    sites = every_species_sites(summary.where(F.col("species") == name)).drop("species")
    return sites.orderBy("frequency_rank", "dive_site", "latitude", "longitude")


def list_divesites(site_summary: DataFrame) -> DataFrame:
    """All sites with their totals, richest first."""
    return site_summary.orderBy(F.desc("total_species"), "dive_site", "latitude", "longitude")


_PANEL = [*PROFILE, "sighting_count", "frequency_rank"]


def _panel_order():
    return ["frequency_rank", "species",
            *(F.asc_nulls_last(c) for c in ("common_name", "description", "image_url"))]


def divesite_species(detail: DataFrame, site: str, species_type: str = "all", limit: int = 50) -> DataFrame:
    """The ``limit`` (1..200) most frequent species of one site."""
    panel = _of_type(detail.where(F.col("dive_site") == site), species_type).select(*_PANEL)
    return panel.orderBy(*_panel_order()).limit(bounded(limit, 200))


def top_species_per_site(detail: DataFrame, n: int = 50, species_type: str = "all") -> DataFrame:
    """The ``n`` most frequent species of every site."""
    order = [F.col(o) if isinstance(o, str) else o for o in _panel_order()]
    order += [F.col("dive_site_latitude"), F.col("dive_site_longitude")]
    chosen = top_per_group(_of_type(detail, species_type), "dive_site", bounded(n, 200), order)
    return chosen.select("dive_site", *_PANEL)


def token_search(enrichment: DataFrame, terms: str, limit: int = 20) -> DataFrame:
    """Species whose common name has every word of ``terms``."""
    found = enrichment.where(has_all_tokens(F.col("common_name"), terms))
    return found.select("species", "common_name", "image_url").orderBy(
        "species", "common_name", F.asc_nulls_last("image_url")
    ).limit(limit)


def token_index(enrichment: DataFrame) -> DataFrame:
    """Each word of each common name with its species."""
    words = enrichment.select("species", F.explode(F.array_distinct(tokens(F.col("common_name")))).alias("token"))
    return words.select("token", "species").distinct()


def species_by_name(enrichment: DataFrame, name: str) -> DataFrame:
    """Names and image of one species; ``has_image`` says whether the address points to an image."""
    row = enrichment.where(F.col("species") == name).select("species", "common_name", "image_url")
    row = row.withColumn("has_image", is_image_url(F.col("image_url")))
    return row.orderBy(F.asc_nulls_last("common_name"), F.asc_nulls_last("image_url")).limit(1)


def species_points(clustered: DataFrame, name: str) -> DataFrame:
    """Where one species was recorded, with the weight for a density map."""
    return clustered.where(F.col("species") == name).select(
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "individual_count"
    )


def every_heat_points(summary: DataFrame) -> DataFrame:
    """Sites of every species with heat intensity: sightings over the species' largest count."""
    points = share_of_group_max(summary, "species", "sighting_count", "intensity")
    return points.select(
        "species", F.col("dive_site_latitude").alias("latitude"), F.col("dive_site_longitude").alias("longitude"),
        "intensity",
    )


def heat_points(summary: DataFrame, name: str) -> DataFrame:
    return every_heat_points(summary.where(F.col("species") == name)).drop("species")


def every_map_stats(summary: DataFrame) -> DataFrame:
    """Per species: number of site rows, sightings, largest count and bounding box."""
    return summary.groupBy("species").agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum("sighting_count").alias("sightings"),
        F.max("sighting_count").alias("max_sightings"),
        *bounding_box("dive_site_latitude", "dive_site_longitude"),
    )


def map_stats(summary: DataFrame, name: str) -> DataFrame:
    return every_map_stats(summary.where(F.col("species") == name))


def bounding_box(lat: str, lon: str) -> list:
    return [
        F.min(lat).alias("south"), F.min(lon).alias("west"), F.max(lat).alias("north"), F.max(lon).alias("east")
    ]


def site_bounds(site_summary: DataFrame) -> DataFrame:
    """Box around all sites."""
    return site_summary.agg(*bounding_box("latitude", "longitude"))


def mean_centre(points: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Average position, where a map of the points opens."""
    return points.agg(F.avg(lat).alias("latitude"), F.avg(lon).alias("longitude"))


def site_markers(site_summary: DataFrame) -> DataFrame:
    """Risk class and marker size per site: invasive before endangered before normal, size from 4 to 14."""
    risk = F.when(F.col("invasive_count") > 0, "invasive").when(F.col("endangered_count") > 0, "endangered")
    size = F.greatest(F.lit(4.0), F.least(F.lit(14.0), F.sqrt("total_species")))
    return site_summary.select(
        "dive_site", "latitude", "longitude", risk.otherwise("normal").alias("risk_class"), size.alias("marker_size")
    )


def species_site_markers(summary: DataFrame) -> DataFrame:
    """Marker size of each site of a species, from 5 to 18."""
    size = F.greatest(F.lit(5.0), F.least(F.lit(18.0), F.sqrt("sighting_count") * 2))
    return every_species_sites(summary).withColumn("marker_size", size)


def titled(cards: DataFrame) -> DataFrame:
    """Cards with the title they are shown under."""
    return cards.withColumn("title", display_title(F.col("common_name"), F.col("species")))
