"""Rules the finished tables must keep. A rule that holds has no violations."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidewatch.operators.copies import count_rows
from tidewatch.operators.spatial import RADIUS_M

# The columns that must be known, and the values a column may take.
_POINT = ("lon", "lat")
_OCCURRENCE = ("event_date", "species", "individual_count", *_POINT, "source")
NOT_NULL = {
    "gbif_occurrences": ("species", "individualcount", "eventdate", *_POINT),
    "obis_occurrences": ("species", "individualcount", "eventdate", *_POINT),
    "divesites": ("title", *_POINT),
    "occurrences": _OCCURRENCE,
    "clustered_occurrences": _OCCURRENCE,
    "species": ("species", "is_endangered", "is_invasive", "species_type"),
    "near_dive_site_occurrences": (
        "dive_site", "event_date", "species", "individual_count", "distance_to_dive_site", *_POINT, "source",
        "proximity_rank",
    ),
    "monthly_species_occurrences": ("dive_site", "species", *_POINT, "month", "event_date", "sighting_count"),
    "divesite_species_frequency": ("dive_site", "species", "sighting_count", "frequency_rank"),
    "species_divesite_summary": (
        "species", "is_endangered", "is_invasive", "species_type", "dive_site", "dive_site_latitude",
        "dive_site_longitude", "sighting_count", "frequency_rank",
    ),
    "divesite_species_detail": (
        "dive_site", "dive_site_latitude", "dive_site_longitude", "species", "is_endangered", "is_invasive",
        "species_type", "sighting_count", "frequency_rank",
    ),
    "divesite_summary": (
        "dive_site", "latitude", "longitude", "total_species", "total_sightings", "endangered_count",
        "invasive_count",
    ),
}
UNIQUE = {"species": ("species",)}
SOURCES = ("GBIF", "OBIS")
TYPES = ("endangered", "invasive", "normal")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
ACCEPTED = {
    "occurrences": {"source": SOURCES},
    "clustered_occurrences": {"source": SOURCES},
    "species": {"is_endangered": (True, False), "is_invasive": (True, False), "species_type": TYPES},
    "near_dive_site_occurrences": {"source": SOURCES, "proximity_rank": (1,)},
    "monthly_species_occurrences": {"month": MONTHS},
    "species_divesite_summary": {"species_type": TYPES},
    "divesite_species_detail": {"species_type": TYPES},
}
RELATIONSHIPS = (
    ("occurrences", "species", "worms", "scientificName"),
    ("near_dive_site_occurrences", "species", "worms", "scientificName"),
    ("near_dive_site_occurrences", "dive_site", "divesites", "title"),
)


def type_contradicts_flags() -> Column:
    endangered, invasive, kind = F.col("is_endangered"), F.col("is_invasive"), F.col("species_type")
    return (
        (endangered & (kind != "endangered"))
        | (~endangered & invasive & (kind != "invasive"))
        | (~endangered & ~invasive & (kind != "normal"))
    )


def bad_coordinates() -> Column:
    lat, lon = F.col("latitude"), F.col("longitude")
    return lat.isNull() | lon.isNull() | ~lat.between(-90, 90) | ~lon.between(-180, 180)


def row_rules(radius_m: float = RADIUS_M, as_of: datetime | None = None) -> dict[str, dict[str, Column]]:
    """Per table, the conditions a row breaks the rule by."""
    now = F.lit(as_of).cast("timestamp_ntz") if as_of else F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
    )
    rules: dict[str, dict[str, Column]] = {table: {} for table in NOT_NULL}
    for table, names in NOT_NULL.items():
        for name in names:
            rules[table][f"not_null:{table}.{name}"] = F.col(name).isNull()
    for table, columns in ACCEPTED.items():
        for name, values in columns.items():
            rules[table][f"accepted_values:{table}.{name}"] = ~F.col(name).isin(*values)
    rules["near_dive_site_occurrences"]["distance_non_negative"] = F.col("distance_to_dive_site") < 0
    rules["near_dive_site_occurrences"]["distance_within_radius"] = F.col("distance_to_dive_site") > radius_m
    rules["divesite_summary"]["coordinates_valid"] = bad_coordinates()
    rules["occurrences"]["individual_count_positive"] = F.col("individual_count") <= 0
    rules["occurrences"]["no_future_dates"] = F.col("event_date") > now
    rules["divesite_species_frequency"]["sighting_count_positive"] = F.col("sighting_count") <= 0
    rules["divesite_species_detail"]["species_type_present"] = F.col("species_type").isNull() | ~F.col(
        "species_type"
    ).isin(*TYPES)
    rules["species"]["type_consistent_with_flags"] = type_contradicts_flags()
    return rules


def violations(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that break a row rule."""
    return df.where(condition)


def duplicate_keys(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def missing_references(child: DataFrame, name: str, parent: DataFrame, parent_name: str) -> DataFrame:
    """Distinct child values with no parent row, and how many rows carry each.

    The rows are counted per value before the join, so a hot value costs one row.
    """
    values = child.where(F.col(name).isNotNull()).groupBy(name).agg(count_rows(child).alias("rows"))
    known = parent.select(F.col(parent_name).alias(name)).distinct()
    return values.join(known, name, "left_anti")


def missing_source(occurrences: DataFrame) -> DataFrame:
    """One row if not both sources are present."""
    sources = occurrences.agg(F.count_distinct("source").alias("sources"))
    return sources.where("sources < 2").select(F.lit("missing_source").alias("failure_reason"))


def summary_differs_from_detail(summary: DataFrame, detail: DataFrame) -> DataFrame:
    counted = detail.groupBy("dive_site").agg(F.count_distinct("species").alias("actual_count"))
    return summary.join(counted, "dive_site").where("total_species <> actual_count").select(
        "dive_site", F.col("total_species").alias("summary_count"), "actual_count"
    )


def species_not_covered(clustered: DataFrame, species_table: DataFrame) -> DataFrame:
    observed = clustered.select("species").distinct()
    return observed.join(species_table.select("species"), "species", "left_anti")


def too_many_empty_sites(summary: DataFrame) -> DataFrame:
    """One row if fewer than half of the sites have a species."""
    counted = summary.agg(F.count_if(F.col("total_species") > 0).alias("filled"), F.count(F.lit(1)).alias("total"))
    return counted.where("filled < total * 0.5").select(F.lit("too_many_empty_divesites").alias("failure_reason"))


def too_few_species_at_sites(summary: DataFrame, species_table: DataFrame) -> DataFrame:
    """One row if fewer than one in a hundred species has a site."""
    zero = F.lit(0).cast("bigint")
    placed = summary.agg(F.count_distinct("species").alias("placed"), zero.alias("total"))
    total = species_table.agg(zero.alias("placed"), F.count(F.lit(1)).alias("total"))
    both = placed.unionByName(total).agg(F.sum("placed").alias("placed"), F.sum("total").alias("total"))
    return both.where("placed < total * 0.01").select(F.lit("too_few_species_at_divesites").alias("failure_reason"))


def sites_without_first_rank(frequency: DataFrame) -> DataFrame:
    return frequency.groupBy("dive_site").agg(F.min("frequency_rank").alias("first")).where("first <> 1").select(
        "dive_site"
    )


def nothing_searchable(enrichment: DataFrame) -> DataFrame:
    """One row if no species has a common name (a warning: enrichment runs on its own)."""
    named = enrichment.agg(F.count("common_name").alias("named"))
    return named.where("named = 0").select(F.lit("no_searchable_species").alias("failure_reason"))


def _tally(table: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """All row rules of one table in a single pass: (rule, violations)."""
    names = list(rules)
    counts = table.agg(*(count_rows(table, rules[name]).alias(f"r{i}") for i, name in enumerate(names)))
    pairs = F.array(
        *(F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations")) for i, name in enumerate(names))
    )
    return counts.select(F.inline(pairs))


def observed(
    table: DataFrame, name: str, radius_m: float = RADIUS_M, as_of: datetime | None = None
) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """The table with the rules on its single rows counted as it is written, and a function that gives the counts then.

    The rows pass the counters on their way to the files, so the rules cost no scan of their own. Ask for the counts
    after the write; a table without such rules passes as it is. Rows of a counted table count with their copies.
    """
    rules = row_rules(radius_m, as_of).get(name, {})
    if not rules:
        return table, dict
    seen, names = Observation(), list(rules)
    watched = table.observe(seen, *(count_rows(table, rules[rule]).alias(f"r{i}") for i, rule in enumerate(names)))
    return watched, lambda: {rule: seen.get[f"r{i}"] for i, rule in enumerate(names)}


def run_checks(
    tables: dict[str, DataFrame], radius_m: float = RADIUS_M, as_of: datetime | None = None
) -> DataFrame:
    """Every rule with its severity and number of violations: (rule, severity, violations).

    ``tables`` holds the model tables by name, and ``worms`` and ``species_enrichment``. Any of the occurrence tables
    may be counted.
    """
    parts = [_tally(tables[name], rules) for name, rules in row_rules(radius_m, as_of).items()]

    def counted(rule: str, found: DataFrame) -> None:
        parts.append(found.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(rule).alias("rule"), "violations"))

    for table, names in UNIQUE.items():
        for name in names:
            counted(f"unique:{table}.{name}", duplicate_keys(tables[table], name))
    for child, name, parent, parent_name in RELATIONSHIPS:
        counted(
            f"relationships:{child}.{name}", missing_references(tables[child], name, tables[parent], parent_name)
        )
    summary, detail = tables["divesite_summary"], tables["divesite_species_detail"]
    counted("both_sources_present", missing_source(tables["occurrences"]))
    counted("summary_consistent_with_detail", summary_differs_from_detail(summary, detail))
    counted("species_cover_occurrences", species_not_covered(tables["clustered_occurrences"], tables["species"]))
    counted("sites_have_species", too_many_empty_sites(summary))
    counted("species_have_sites", too_few_species_at_sites(tables["species_divesite_summary"], tables["species"]))
    counted("first_rank_is_one", sites_without_first_rank(tables["divesite_species_frequency"]))
    counted("some_species_searchable", nothing_searchable(tables["species_enrichment"]))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    severity = F.when(F.col("rule") == "some_species_searchable", "warn").otherwise("error")
    return result.select("rule", severity.alias("severity"), "violations")
