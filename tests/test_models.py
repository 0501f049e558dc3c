"""Multiplicity, the one-row cases of the questions, and the whole build."""

import pytest

from checks.inputs import Tables
from checks.registry import model_build
from tests.conftest import FOLDER, rows
from tidewatch.plans import models, serving, staging

SITE_SUMMARY = ("dive_site string, latitude double, longitude double, total_species bigint, total_sightings bigint,"
                " endangered_count bigint, invasive_count bigint")
SUMMARY = ("species string, common_name string, image_url string, species_type string, is_endangered boolean,"
           " is_invasive boolean, dive_site string, dive_site_latitude double, dive_site_longitude double,"
           " sighting_count bigint, frequency_rank bigint")
DETAIL = ("species string, common_name string, description string, image_url string, species_type string,"
          " is_endangered boolean, is_invasive boolean, sighting_count bigint, frequency_rank bigint, dive_site string,"
          " dive_site_latitude double, dive_site_longitude double")


@pytest.fixture
def site_summary(spark):
    return spark.createDataFrame(
        [("Wreck North", -21.5, 149.25, 2, 12, 0, 1), ("Amber Wall", 4.75, 73.5, 3, 40, 2, 0)], SITE_SUMMARY)


@pytest.fixture
def summary(spark):
    return spark.createDataFrame([
        ("Velella minor", "Small sail", "https://img.test/v.png", "normal", False, False, "Wreck North", -21.5, 149.25, 9, 1),
        ("Velella minor", "Small sail", "https://img.test/v.png", "normal", False, False, "Amber Wall", 4.75, 73.5, 30, 1),
        ("Pterois dubia", None, None, "invasive", False, True, "Wreck North", -21.5, 149.25, 3, 2),
    ], SUMMARY)


@pytest.fixture
def detail(spark):
    return spark.createDataFrame([
        ("Pterois dubia", None, "Striped", None, "invasive", False, True, 3, 2, "Wreck North", -21.5, 149.25),
        ("Velella minor", "Small sail", "Drifts", "https://img.test/v.png", "normal", False, False, 9, 1, "Wreck North",
         -21.5, 149.25),
        ("Velella minor", "Small sail", "Drifts", "https://img.test/v.png", "normal", False, False, 30, 1, "Amber Wall",
         4.75, 73.5),
    ], DETAIL)


def test_sites_are_listed(site_summary):
    assert {r.dive_site for r in serving.list_divesites(site_summary).collect()} == {"Amber Wall", "Wreck North"}


def test_species_are_found(summary):
    assert [r.species for r in serving.search_species(summary, "velel").collect()] == ["Velella minor"]
    assert serving.search_species(summary, "SAIL").count() == 1
    assert serving.search_species(summary).count() == 2
    assert serving.search_species(summary, limit=1).count() == 1
    assert serving.search_species(summary, "velel", "invasive").count() == 0
    assert serving.search_species(summary, "dubia", "invasive").count() == 1


def test_a_site_lists_its_species(detail):
    found = serving.divesite_species(detail, "Wreck North")
    assert [r.species for r in found.collect()] == ["Velella minor", "Pterois dubia"]
    assert found.columns == ["species", "common_name", "description", "image_url", "species_type", "is_endangered",
                             "is_invasive", "sighting_count", "frequency_rank"]
    assert serving.divesite_species(detail, "Wreck North", limit=1).count() == 1
    assert serving.divesite_species(detail, "Nowhere").count() == 0
    for limit in (0, 201):
        with pytest.raises(ValueError):
            serving.divesite_species(detail, "Amber Wall", limit=limit)


def test_a_species_has_a_profile_and_sites(summary, detail):
    profile = serving.species_detail(detail, "Velella minor").first()
    assert (profile.total_sightings, profile.total_sites) == (39, 2)
    assert serving.species_detail(detail, "Nobody").count() == 0
    assert rows(serving.species_sites(summary, "Velella minor")) == [
        ("Amber Wall", 4.75, 73.5, 30, 1), ("Wreck North", -21.5, 149.25, 9, 1)]


def test_markers(spark):
    sites = spark.createDataFrame(
        [("a", 0.0, 0.0, 400, 1, 1, 1), ("b", 0.0, 0.0, 1, 1, 1, 0), ("c", 0.0, 0.0, 49, 1, 0, 0)], SITE_SUMMARY)
    got = serving.site_markers(sites).select("dive_site", "risk_class", "marker_size")
    assert rows(got) == [("a", "invasive", 14.0), ("b", "endangered", 4.0), ("c", "normal", 7.0)]


def test_repeated_titles_and_enrichment_rows_multiply(spark):
    frequency = spark.createDataFrame([("S", "a", 4, 1), ("S", "b", 3, 2)],
                                      "dive_site string, species string, sighting_count bigint, frequency_rank bigint")
    species = spark.createDataFrame([("a", True, False, "endangered"), ("b", False, False, "normal")],
                                    "species string, is_endangered boolean, is_invasive boolean, species_type string")
    sites = spark.createDataFrame([("S", 1.0, 2.0), ("S", 3.0, 4.0), ("T", 5.0, 6.0)],
                                  "title string, lon double, lat double")
    enrichment = spark.createDataFrame([("a", "A", None, None), ("a", "AA", None, None)],
                                       "species string, common_name string, description string, image_url string")
    detail = models.divesite_species_detail(frequency, species, sites, enrichment)
    assert detail.count() == 2 * (2 + 1)
    assert models.species_divesite_summary(frequency, species, sites, enrichment).count() == 6
    assert rows(models.divesite_summary(sites, detail)) == [
        ("S", 2.0, 1.0, 2, 22, 4, 0), ("S", 4.0, 3.0, 2, 22, 4, 0), ("T", 6.0, 5.0, 0, 0, 0, 0)]
    assert rows(models.divesite_summary(sites, fanout_safe=(frequency, species))) == [
        ("S", 2.0, 1.0, 2, 7, 1, 0), ("S", 4.0, 3.0, 2, 7, 1, 0), ("T", 6.0, 5.0, 0, 0, 0, 0)]
    with pytest.raises(ValueError):
        models.divesite_summary(sites)


def test_monthly_counts(spark):
    near = spark.sql("""SELECT 'S' AS dive_site, 'a' AS species, t AS event_date FROM VALUES
        (TIMESTAMP_NTZ'2020-05-01 10:00:00'), (TIMESTAMP_NTZ'2020-05-01 10:00:00'),
        (TIMESTAMP_NTZ'2020-05-31 23:59:59'), (TIMESTAMP_NTZ'2021-05-01 00:00:00') v(t)""")
    sites = spark.createDataFrame([("S", 1.0, 2.0)], "title string, lon double, lat double")
    by_date = models.monthly_species_occurrences(near, sites)
    assert sorted((r.month, r.sighting_count) for r in by_date.collect()) == [("May", 1), ("May", 1), ("May", 2)]
    by_month = models.monthly_species_occurrences(near, sites, grain="month")
    assert sorted((str(r.event_date), r.sighting_count) for r in by_month.collect()) == [
        ("2020-05-01 00:00:00", 3), ("2021-05-01 00:00:00", 1)]


def test_large_side_ways_give_the_same_tables(spark, shuffle_only, monkeypatch):
    """The whole chain with no broadcast at all equals the default one."""
    from tidewatch.operators import joins

    shuffled = {name: rows(getattr(Tables(spark, FOLDER), name)) for name in ("near", "detail", "site_summary")}
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 2_000_000)
    assert {name: rows(getattr(Tables(spark, FOLDER), name)) for name in shuffled} == shuffled


def test_repeated_rows_do_not_change_the_closest_pair(spark):
    t = Tables(spark, FOLDER)
    assert rows(models.near_dive_site_occurrences(t.occurrences, t.sites)) == rows(t.near)
    assert rows(models.species(t.occurrences, t.redlist, t.invasive)) == rows(t.species)


def test_build_equals_the_lazy_tables(spark):
    t = Tables(spark, FOLDER)
    built = model_build(t)
    for name, lazy in (("occurrences", t.occurrences), ("near_dive_site_occurrences", t.near),
                       ("species", t.species), ("divesite_species_detail", t.detail),
                       ("monthly_species_occurrences", t.monthly), ("divesite_summary", t.site_summary)):
        assert rows(built[name].select(lazy.columns)) == rows(lazy), name


def test_a_date_is_read_once_a_row(spark):
    """Also where only other columns are used, and the text of the date is computed itself."""
    raw = spark.sql("""SELECT species, '3' AS individualCount, concat(day, '') AS eventDate, 1.0D AS decimalLongitude, 2.0D AS decimalLatitude
      FROM VALUES ('a', '2024-05-01 10:00:00+02:00'), ('b', '2024-05-01'), ('c', 'unknown'), ('d', NULL), (NULL, '2024-05-01') v(species, day)""")
    staged = staging.stage_obis(raw)
    assert [(r[0], r[1], str(r[2])) for r in rows(staged)] == [("a", 3, "2024-05-01 08:00:00"), ("b", 3, "2024-05-01 00:00:00")]
    table = Tables(spark, FOLDER)
    for df in (table.obis, table.obis.select("species")):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("make_dt_interval") == 1
    assert sorted(r[0] for r in rows(staged.select("species"))) == ["a", "b"]


def test_development_mode_is_a_part_of_the_whole(spark):
    t = Tables(spark, FOLDER)
    part = staging.stage_obis(t.obis_raw, dev=True)
    assert part.exceptAll(t.obis).count() == 0
    assert staging.stage_gbif(t.gbif_raw, dev=True).count() < t.gbif.count() / 10
