from datetime import datetime

from pyspark.sql import functions as F

from checks.inputs import Tables
from checks.registry import _model_tables
from tests.conftest import FOLDER
from tidewatch.plans import quality


def outcome(tables):
    checks = quality.run_checks(tables, as_of=datetime(2030, 1, 1)).collect()
    return {r.rule: (r.severity, r.violations) for r in checks}


def test_clean_tables_have_no_violations_but_empty_sites(spark):
    found = outcome(_model_tables(Tables(spark, FOLDER)))
    broken = {rule for rule, (_, count) in found.items() if count}
    assert broken <= {"sites_have_species"}
    assert found["some_species_searchable"][0] == "warn"
    assert sum(rule.startswith("not_null:") for rule in found) == 67 + 7  # each of the 7 points is two columns
    assert sum(rule.startswith("accepted_values:") for rule in found) == 10
    assert sum(rule.startswith("relationships:") for rule in found) == 3
    assert sum(rule.startswith("unique:") for rule in found) == 1
    assert len([rule for rule in found if ":" not in rule]) == 15


def test_defects_are_found(spark):
    tables = {name: table.cache() for name, table in _model_tables(Tables(spark, FOLDER)).items()}
    near, species = tables["near_dive_site_occurrences"], tables["species"]
    tables["near_dive_site_occurrences"] = near.withColumn(
        "distance_to_dive_site", F.lit(4000.0)).withColumn("source", F.lit("X")).withColumn(
        "dive_site", F.lit("nowhere"))
    tables["species"] = species.unionByName(species.limit(1)).withColumn(
        "species_type", F.when(F.col("species_type") != "normal", "normal"))
    tables["occurrences"] = tables["occurrences"].where("source = 'OBIS'").withColumn("individual_count", F.lit(0))
    tables["divesite_summary"] = tables["divesite_summary"].withColumn("latitude", F.lit(91.0)).withColumn(
        "total_species", F.lit(0))
    tables["divesite_species_frequency"] = tables["divesite_species_frequency"].where("frequency_rank > 1")
    tables["species_enrichment"] = tables["species_enrichment"].withColumn("common_name", F.lit(None).cast("string"))
    found = outcome(tables)
    for rule in ("distance_within_radius", "accepted_values:near_dive_site_occurrences.source",
                 "relationships:near_dive_site_occurrences.dive_site", "unique:species.species",
                 "not_null:species.species_type", "type_consistent_with_flags", "both_sources_present",
                 "individual_count_positive", "coordinates_valid", "summary_consistent_with_detail",
                 "sites_have_species", "first_rank_is_one", "some_species_searchable"):
        assert found[rule][1] > 0, rule
