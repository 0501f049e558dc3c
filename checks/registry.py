"""Every registered query with the SQL it is compared with (None where the result is random by design).

Each entry takes the lazy tables of one data folder. Metres are shown with 3 decimals, averages with 6.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.inputs import Tables
from checks.oracle import BY_NAME, checks_sql
from tidewatch.functions import text
from tidewatch.functions.sampling import hash_sample, sample_scan
from tidewatch.operators import spatial, taxa
from tidewatch.operators.copies import repeated
from tidewatch.plans import build, enrichment, models, quality, serving, staging
from tidewatch.session import new_table_path
from tidewatch.sources import readers, writers

# Keys that occur at every scale.
SITE = "Site-8"
SPECIES = "large plate Brand#22 STANDARD"
AS_OF = datetime(2030, 1, 1)


class Query(NamedTuple):
    run: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None):
    def register(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = Query(run, sql)
        return run

    return register


def _metres(df: DataFrame) -> DataFrame:
    return df.withColumn("distance_to_dive_site", F.round("distance_to_dive_site", 3))


_NEAR = ("dive_site, event_date, species, individual_count, round(distance_to_dive_site, 3) AS distance_to_dive_site,"
         " lon, lat, source")
_CARD = "species, common_name, image_url, species_type, is_endangered, is_invasive"
_PROFILE = "species, common_name, description, image_url, species_type, is_endangered, is_invasive"


def _stored(t: Tables, df: DataFrame, **layout) -> DataFrame:
    path = new_table_path(t.spark, "table")
    writers.write_table(df, path, **layout)
    return t.spark.read.parquet(path)


# --- sources and sinks -------------------------------------------------------------------------------------


@query("s1_read_observations", """
SELECT species, individualCount, eventDate, eventTime, year, month, day, decimalLongitude, decimalLatitude
FROM obis_raw WHERE species IS NOT NULL AND decimalLatitude IS NOT NULL AND decimalLongitude IS NOT NULL""")
def _(t):
    nested = t.obis_raw.select(F.struct(
        "species", "individualCount", "eventDate", "eventTime", F.col("year").alias("date_year"), "month", "day",
        "decimalLongitude", "decimalLatitude",
    ).alias("interpreted"))
    path = new_table_path(t.spark, "observations")
    nested.write.parquet(f"{path}/part=a")
    return readers.read_observations(t.spark, path)


@query("s4_read_checklist", "SELECT scientificName FROM worms")
def _(t):
    path = new_table_path(t.spark, "checklist")
    t.worms.write.csv(path, sep="\t", header=True, quote="", escapeQuotes=False)
    return readers.read_checklist(t.spark, path, "scientificName string")


_SITES_SQL = """
SELECT {0} coalesce(g.id, m.id) AS id, g.title, m.latitude, m.longitude
FROM (SELECT id, title FROM divesites_raw WHERE region <> 5 AND title IS NOT NULL) g
FULL OUTER JOIN (
  SELECT id, CAST(((id * 37) % 121) - 60 AS DOUBLE) AS latitude, CAST(((id * 73) % 361) - 180 AS DOUBLE) AS longitude
  FROM (SELECT id FROM divesites_raw WHERE region <> 7
        UNION ALL SELECT id FROM divesites_raw WHERE region < 9 AND region <> 7) cells) m ON g.id = m.id
WHERE g.title IS NOT NULL AND m.latitude IS NOT NULL AND m.longitude IS NOT NULL"""


@query("s5_build_sites", _SITES_SQL.format(""))
def _(t):
    return readers.build_sites(t.guide_pages, t.map_pages)


@query("s5_build_sites_dedup", _SITES_SQL.format("DISTINCT"))
def _(t):
    return readers.build_sites(t.guide_pages, t.map_pages, dedup=True)


@query("s6_load_stored_inputs", """
SELECT 'worms_table' AS name, count(*) AS row_count, count(scientificName) AS known,
  CAST(sum(length(scientificName)) AS BIGINT) AS content FROM worms
UNION ALL SELECT 'divesites_table', count(*), count(title), CAST(sum(length(title) * id) AS BIGINT) FROM divesites_raw
UNION ALL SELECT 'species_enrichment', count(*), count(common_name),
  CAST(sum(length(common_name) + length(description)) AS BIGINT) FROM species_enrichment
UNION ALL SELECT 'obis_table', count(*), count(species), CAST(sum(length(species) * length(eventDate)) AS BIGINT) FROM obis_raw
UNION ALL SELECT 'gbif_table', count(*), count(species), CAST(sum(length(species) * individualcount) AS BIGINT)
FROM gbif_raw""")
def _(t):
    folder = new_table_path(t.spark, "inputs")
    size = {name: F.length(name) for name in ("scientificName", "title", "common_name", "description", "species", "eventDate")}
    stored = {
        "worms_table": (t.worms, "scientificName", size["scientificName"]),
        "divesites_table": (t.divesites_raw, "title", size["title"] * F.col("id")),
        "species_enrichment": (t.species_enrichment, "common_name", size["common_name"] + size["description"]),
        "obis_table": (t.obis_raw, "species", size["species"] * size["eventDate"]),
        "gbif_table": (t.gbif_raw, "species", size["species"] * F.col("individualcount")),
    }
    result = None
    for name, (table, column, content) in stored.items():
        writers.write_table(table, f"{folder}/{name}")
        counted = readers.load(t.spark, folder, name).agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).alias("row_count"), F.count(column).alias("known"),
            F.sum(content).cast("bigint").alias("content")
        )
        result = counted if result is None else result.unionByName(counted)
    return result


@query("s7_stage_gbif", "SELECT * FROM m_gbif")
def _(t):
    return t.gbif


@query("s8_sample_scan", "SELECT TRUE AS only_given_rows, TRUE AS share_within_bounds, TRUE AS same_for_the_seed")
def _(t):
    scan = _stored(t, t.gbif_raw)
    sample = _stored(t, sample_scan(scan, 5.0, seed=7))
    again = sample_scan(scan, 5.0, seed=7)
    none = (F.count(F.lit(1)) == 0).alias("holds")
    share = sample.select(F.lit(1).alias("drawn")).unionByName(scan.select(F.lit(0).alias("drawn")))
    facts = (
        ("only_given_rows", sample.exceptAll(scan).agg(none)),
        ("share_within_bounds", share.agg(F.avg("drawn").between(0.04 / 1.04, 0.06 / 1.06).alias("holds"))),
        ("same_for_the_seed", sample.exceptAll(again).unionByName(again.exceptAll(sample)).agg(none)),
    )
    rows = [df.select(*(F.col("holds").alias(n) if n == name else F.lit(None).cast("boolean").alias(n)
                        for n, _ in facts)) for name, df in facts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*(F.bool_and(n).alias(n) for n, _ in facts))


@query("k1_write_snappy", "SELECT scientificName FROM worms")
def _(t):
    return _stored(t, t.worms)


@query("k2_write_zstd", "SELECT * FROM m_obis")
def _(t):
    return _stored(t, t.obis, codec="zstd", partitions=4)


@query("k3_write_by_month", """
SELECT event_date, species, individual_count, lon, lat, source, strftime(event_date, '%Y-%m-01') AS event_month
FROM m_occ WHERE event_date >= TIMESTAMP '1996-01-01' AND event_date < TIMESTAMP '1997-01-01'""")
def _(t):
    path = new_table_path(t.spark, "occurrences")
    writers.write_table(t.counted, path, partition_month="event_date", cluster_by=["geography"])
    return writers.read_months(t.spark, path, "1996-01-01", "1996-12-01", as_text=True)


@query("k3_every_month", """
SELECT event_date, species, individual_count, lon, lat, source, strftime(event_date, '%Y-%m-01') AS event_month
FROM m_occ""")
def _(t):
    path = new_table_path(t.spark, "occurrences")
    writers.write_table(t.counted, path, partition_month="event_date", cluster_by=["geography"])
    return writers.read_months(t.spark, path, as_text=True)


def _files_that_may_hold(table: DataFrame, low: dict, high: dict):
    """Files in all, and files whose smallest and largest values don't rule the asked range out.

    The table has all files in one folder: a file is known by its name, which is shorter to group by than its path.
    """
    names = list(low)
    rows, n = table.withColumn("file", F.col("_metadata.file_name")), F.lit(1)
    if any(kind == "string" for name, kind in table.dtypes if name in names):
        # Each value of a file once first: the smallest text of a group can't be hashed, only sorted. Its rows are
        # summed, else the optimizer drops this step.
        rows, n = rows.groupBy("file", *names).agg(F.count(n).alias("n")), F.col("n")
    bounds = rows.groupBy("file").agg(
        F.sum(n).alias("rows"), *(f(name).alias(f"{name}_{f.__name__}") for name in names for f in (F.min, F.max)))
    may = F.col("rows") > 0
    for n in names:
        may = may & (F.col(f"{n}_min") <= F.lit(high[n])) & (F.col(f"{n}_max") >= F.lit(low[n]))
    return bounds.agg(F.count(F.lit(1)).alias("files"), F.count_if(may).alias("candidates"))


@query("k4_clustered_files_skip", """
SELECT 'species' AS layout, TRUE AS many_files, TRUE AS few_candidates UNION ALL SELECT 'geography', TRUE, TRUE""")
def _(t):
    path = new_table_path(t.spark, "records")
    t.counted.write.parquet(path)
    records, result = t.spark.read.schema(t.counted.schema).parquet(path), None
    for name, keys, low, high in (
        ("species", ["species"], {"species": SPECIES}, {"species": SPECIES}),
        ("geography", ["geography"], {"lat": 10.0, "lon": 10.0}, {"lat": 12.0, "lon": 12.0}),
    ):
        found = _files_that_may_hold(_stored(t, records, cluster_by=keys, partitions=24, stored=True), low, high).select(
            F.lit(name).alias("layout"), (F.col("files") >= 8).alias("many_files"),
            (F.col("candidates") <= 2).alias("few_candidates"))
        result = found if result is None else result.unionByName(found)
    return result


@query("k4_write_clustered_by_species", "SELECT * FROM m_occ")
def _(t):
    return _stored(t, t.counted, cluster_by=["species"])


@query("k4_write_clustered_by_geography", "SELECT * FROM m_sites")
def _(t):
    return _stored(t, t.sites, cluster_by=["geography"])


@query("k5_overwrite", "SELECT * FROM m_sites")
def _(t):
    path = new_table_path(t.spark, "sites")
    for _again in range(2):
        writers.write_table(t.sites, path)
    return t.spark.read.parquet(path)


@query("k6_export_and_s9_open_serving", """
SELECT 'divesite_summary' AS name, count(*) AS row_count, CAST(sum(total_sightings) AS BIGINT) AS sightings,
  CAST(sum(length(dive_site) * (total_species + 10 * endangered_count + 100 * invasive_count)) AS BIGINT) AS content
FROM m_site_summary
UNION ALL SELECT 'species_divesite_summary', count(*), CAST(sum(sighting_count) AS BIGINT),
  CAST(sum(length(dive_site) * length(species) * frequency_rank) AS BIGINT) FROM m_summary
UNION ALL SELECT 'divesite_species_detail', count(*), CAST(sum(sighting_count) AS BIGINT),
  CAST(sum(length(dive_site) * length(species) * frequency_rank + length(coalesce(description, ''))) AS BIGINT)
FROM m_detail""")
def _(t):
    folder = new_table_path(t.spark, "serving")
    writers.export_serving(
        {"divesite_summary": t.site_summary, "species_divesite_summary": t.summary,
         "divesite_species_detail": t.detail}, folder)
    opened = readers.open_serving(t.spark, folder, cache=False)
    result = None
    place = F.length("dive_site")
    for name, table in opened.items():
        column = "total_sightings" if name == "divesite_summary" else "sighting_count"
        if name == "divesite_summary":
            content = place * (F.col("total_species") + 10 * F.col("endangered_count") + 100 * F.col("invasive_count"))
        else:
            content = place * F.length("species") * F.col("frequency_rank")
            if name == "divesite_species_detail":
                content = content + F.length(F.coalesce("description", F.lit("")))
        counted = table.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("row_count"),
                            F.sum(column).alias("sightings"), F.sum(content).cast("bigint").alias("content"))
        result = counted if result is None else result.unionByName(counted)
    return result


# --- projections and predicates ----------------------------------------------------------------------------


@query("p1_stage_sites", "SELECT * FROM m_sites")
def _(t):
    return t.sites


@query("p2_standardize", "SELECT * FROM m_records WHERE source = 'GBIF'")
def _(t):
    return staging.standardize(t.gbif, "GBIF")


@query("p3_stage_obis", "SELECT * FROM m_obis")
def _(t):
    return t.obis


_BUCKET = "CAST('0x' || substr(md5({0}), 1, 8) AS BIGINT) % {1}"


@query("p4_hash_sample", f"SELECT * FROM m_occ WHERE {_BUCKET.format('species', 20)} = 0")
def _(t):
    return hash_sample(t.occurrences, "species", models.DEV_NEAR_BUCKETS)


@query("p5_stage_obis_dev", f"SELECT * FROM m_obis WHERE {_BUCKET.format('species', 100)} = 0")
def _(t):
    return staging.stage_obis(t.obis_raw, dev=True)


@query("p5_near_dev", f"""
SELECT {_NEAR}, rn AS proximity_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY distance_to_dive_site, dive_site, species, source,
    individual_count, lon, lat) AS rn
  FROM m_pairs WHERE {_BUCKET.format('species', 20)} = 0) r WHERE rn = 1""")
def _(t):
    return _metres(models.near_dive_site_occurrences(t.counted, t.sites, dev=True))


@query("p7_matching_species", f"""
SELECT DISTINCT {_CARD} FROM m_summary WHERE species ILIKE '%ring br%' OR common_name ILIKE '%ring br%'""")
def _(t):
    return serving.matching_species(t.summary, "RING br")


@query("p8_token_search", """
SELECT species, common_name, image_url FROM species_enrichment
WHERE list_has_all(string_split_regex(lower(common_name), '[^\\p{L}\\p{N}]+'), ['widget', 'common'])
ORDER BY species, common_name, image_url NULLS LAST LIMIT 20""")
def _(t):
    return serving.token_search(t.species_enrichment, "Common, WIDGET")


@query("p8_token_index", """
SELECT DISTINCT token, species FROM (
  SELECT species, unnest(string_split_regex(lower(common_name), '[^\\p{L}\\p{N}]+')) AS token
  FROM species_enrichment) w WHERE token <> ''""")
def _(t):
    return serving.token_index(t.species_enrichment)


@query("p9_is_image_url", """
SELECT species, image_url, coalesce(regexp_matches(lower(trim(image_url)), '^https?://([a-z0-9-]+\\.)+[a-z]{2,}/\\S*$')
  AND regexp_matches(lower(trim(image_url)), '\\.(png|jpg|jpeg|gif|bmp|tiff|svg)$'), FALSE) AS is_image
FROM species_enrichment""")
def _(t):
    return t.species_enrichment.select(
        "species", "image_url", text.is_image_url(F.col("image_url")).alias("is_image")
    )


# --- joins -------------------------------------------------------------------------------------------------


@query("j1_validate_taxa", "SELECT * FROM m_occ")
def _(t):
    return t.occurrences


@query("j1_validate_taxa_semi", "SELECT * FROM m_records WHERE species IN (SELECT scientificName FROM worms)")
def _(t):
    return models.occurrences(t.gbif, t.obis, t.worms, mode="semi")


@query("j2_within_distance", f"SELECT {_NEAR} FROM m_pairs")
def _(t):
    return repeated(_metres(models.near_dive_site_occurrences(t.counted, t.sites, rank_by=None)))


@query("j3_classify_species", "SELECT * FROM m_species")
def _(t):
    return t.species


@query("j4_sites_by_title", """
SELECT f.dive_site, f.species, f.sighting_count, s.lon, s.lat FROM m_freq f JOIN m_sites s ON f.dive_site = s.title""")
def _(t):
    from tidewatch.operators.joins import lookup_join

    places = t.sites.withColumnRenamed("title", "dive_site")
    return lookup_join(t.frequency, places, "dive_site", size_of=t.sites).drop("frequency_rank")


@query("j6_species_with_enrichment", """
SELECT s.species, s.species_type, e.common_name, e.description, e.image_url
FROM m_species s LEFT JOIN species_enrichment e ON s.species = e.species""")
def _(t):
    from tidewatch.operators.joins import lookup_join

    return lookup_join(t.species.select("species", "species_type"), t.species_enrichment, "species", "left")


@query("j8_new_species", "SELECT * FROM m_new")
def _(t):
    return enrichment.new_species(t.species, t.species_enrichment)


@query("j9_remaining_work", "SELECT * FROM m_work WHERE species NOT IN (SELECT species FROM m_names)")
def _(t):
    work = enrichment.work_list(t.species, t.species_enrichment)
    return enrichment.remaining(work, enrichment.extract_common_name(t.vernacular_responses))


@query("j13_missing_references", """
SELECT r.species, count(*) AS rows FROM m_records r LEFT JOIN (SELECT DISTINCT scientificName FROM worms) w
ON r.species = w.scientificName WHERE w.scientificName IS NULL GROUP BY r.species""")
def _(t):
    return quality.missing_references(models.all_records(t.gbif, t.obis), "species", t.worms, "scientificName")


# --- aggregations ------------------------------------------------------------------------------------------


@query("a1_sighting_counts", "SELECT dive_site, species, count(*) AS sighting_count FROM m_near GROUP BY ALL")
def _(t):
    return models.sighting_counts(t.near)


@query("a3_site_totals", """
SELECT dive_site, count(DISTINCT species) AS total_species, CAST(sum(sighting_count) AS BIGINT) AS total_sightings,
  count(*) FILTER (WHERE is_endangered) AS endangered_count, count(*) FILTER (WHERE is_invasive) AS invasive_count
FROM m_detail GROUP BY dive_site""")
def _(t):
    return models.site_totals(t.detail)


@query("a4_distinct_species", "SELECT DISTINCT species FROM m_occ")
def _(t):
    return t.counted.select("species").distinct()


@query("a7_coverage_counts", """
SELECT (SELECT count(*) FROM m_species) AS total_species,
  count(*) FILTER (WHERE nullif(common_name, '') IS NOT NULL AND nullif(description, '') IS NOT NULL
    AND nullif(image_url, '') IS NOT NULL) AS fully_enriched,
  count(*) FILTER (WHERE nullif(common_name, '') IS NOT NULL OR nullif(description, '') IS NOT NULL
    OR nullif(image_url, '') IS NOT NULL) AS with_any_data
FROM species_enrichment""")
def _(t):
    return enrichment.coverage_counts(t.species, t.species_enrichment)


@query("a8_coverage_shares", """
SELECT count(*) AS rows, count(nullif(common_name, '')) AS with_common_name,
  count(nullif(description, '')) AS with_description, count(nullif(image_url, '')) AS with_image_url,
  count(coalesce(nullif(common_name, ''), nullif(description, ''), nullif(image_url, ''))) AS with_any,
  round(100.0 * count(nullif(common_name, '')) / count(*), 6) AS common_name_percent,
  round(100.0 * count(nullif(description, '')) / count(*), 6) AS description_percent,
  round(100.0 * count(nullif(image_url, '')) / count(*), 6) AS image_url_percent
FROM species_enrichment""")
def _(t):
    shares = enrichment.coverage_shares(t.species_enrichment)
    return shares.select(*(
        F.round(name, 6).alias(name) if name.endswith("_percent") else F.col(name) for name in shares.columns
    ))


@query("a10_site_bounds", """
SELECT min(latitude) AS south, min(longitude) AS west, max(latitude) AS north, max(longitude) AS east
FROM m_site_summary""")
def _(t):
    return serving.site_bounds(t.site_summary)


@query("a11_mean_centre", f"""
SELECT round(avg(lat), 6) AS latitude, round(avg(lon), 6) AS longitude FROM m_occ WHERE species = '{SPECIES}'""")
def _(t):
    centre = serving.mean_centre(serving.species_points(t.occurrences, SPECIES))
    return centre.select(*(F.round(name, 6).alias(name) for name in centre.columns))


@query("a14_type_histogram", "SELECT species_type, count(*) AS species FROM m_species GROUP BY species_type")
def _(t):
    return t.species.groupBy("species_type").agg(F.count(F.lit(1)).alias("species"))


# --- windows, order, sets ----------------------------------------------------------------------------------


@query("w1_nearest_per_event_date", f"SELECT {_NEAR}, proximity_rank FROM m_near")
def _(t):
    return _metres(t.near)


@query("w1_nearest_per_occurrence", f"SELECT {_NEAR}, proximity_rank FROM m_near_each")
def _(t):
    return repeated(_metres(models.near_dive_site_occurrences(t.counted, t.sites, rank_by="occurrence")))


@query("w2_frequency_rank", "SELECT * FROM m_freq")
def _(t):
    return t.frequency


@query("o1_monthly_ordered", "SELECT * FROM m_monthly ORDER BY dive_site, species, month")
def _(t):
    return t.monthly.orderBy("dive_site", "species", "month")


@query("u1_union_sources", "SELECT * FROM m_records")
def _(t):
    return models.all_records(t.gbif, t.obis)


# --- models ------------------------------------------------------------------------------------------------


@query("c2_monthly_species_occurrences", "SELECT * FROM m_monthly")
def _(t):
    return t.monthly


@query("c2_monthly_true_months", """
SELECT c.dive_site, c.species, s.lon, s.lat, strftime(c.event_date, '%b') AS month, c.event_date, c.sighting_count
FROM (SELECT dive_site, species, CAST(date_trunc('month', event_date) AS TIMESTAMP) AS event_date,
        count(*) AS sighting_count FROM m_near GROUP BY ALL) c JOIN m_sites s ON c.dive_site = s.title""")
def _(t):
    return models.monthly_species_occurrences(t.near, t.sites, grain="month")


@query("c3_divesite_species_detail", "SELECT * FROM m_detail")
def _(t):
    return t.detail


@query("c5_species_divesite_summary", "SELECT * FROM m_summary")
def _(t):
    return t.summary


@query("c6_divesite_summary", "SELECT * FROM m_site_summary")
def _(t):
    return t.site_summary


@query("c6_divesite_summary_fanout_safe", """
SELECT s.title AS dive_site, s.lat AS latitude, s.lon AS longitude, coalesce(a.ts, 0) AS total_species,
  CAST(coalesce(a.tn, 0) AS BIGINT) AS total_sightings, coalesce(a.e, 0) AS endangered_count,
  coalesce(a.i, 0) AS invasive_count
FROM m_sites s LEFT JOIN (
  SELECT dive_site, count(*) AS ts, sum(sighting_count) AS tn, count(*) FILTER (WHERE is_endangered) AS e,
    count(*) FILTER (WHERE is_invasive) AS i
  FROM m_freq JOIN m_species USING (species) GROUP BY dive_site) a ON s.title = a.dive_site""")
def _(t):
    return models.divesite_summary(t.sites, fanout_safe=(t.frequency, t.species))


def model_build(t) -> dict[str, DataFrame]:
    """All model tables, written below the shared folder."""
    return build.build_tables(
        t.spark,
        {"gbif": t.gbif_raw, "obis": t.obis_raw, "worms": t.worms, "redlist": t.redlist, "invasive": t.invasive,
         "divesites": t.divesites_raw, "species_enrichment": t.species_enrichment},
        new_table_path(t.spark, "model"),
    )


@query("c_build_all_tables", " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS row_count FROM {table}" for name, table in BY_NAME.items()))
def _(t):
    tables = model_build(t)
    result = None
    for name, table in tables.items():
        counted = table.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("row_count"))
        result = counted if result is None else result.unionByName(counted)
    return result


# --- serving -----------------------------------------------------------------------------------------------


@query("q1_search_species", f"""
SELECT DISTINCT {_CARD} FROM m_summary
WHERE (species ILIKE '%widget%' OR common_name ILIKE '%widget%') AND species_type = 'endangered'
ORDER BY species, common_name NULLS LAST, image_url NULLS LAST LIMIT 20""")
def _(t):
    return serving.search_species(t.summary, "widget", "endangered")


@query("q1_search_all", f"""
SELECT DISTINCT {_CARD} FROM m_summary ORDER BY species, common_name NULLS LAST, image_url NULLS LAST LIMIT 100""")
def _(t):
    return serving.search_species(t.summary, limit=100)


_EVERY_DETAIL = f"""
SELECT {_PROFILE}, CAST(sum(sighting_count) AS BIGINT) AS total_sightings, count(DISTINCT dive_site) AS total_sites
FROM m_detail {{0}} GROUP BY {_PROFILE}"""


@query("q2_species_detail", _EVERY_DETAIL.format(f"WHERE species = '{SPECIES}'"))
def _(t):
    return serving.species_detail(t.detail, SPECIES)


@query("q2_every_species_detail", _EVERY_DETAIL.format(""))
def _(t):
    return serving.every_species_detail(t.detail)


_SPECIES_SITES = """dive_site, dive_site_latitude AS latitude, dive_site_longitude AS longitude, sighting_count,
  frequency_rank"""


@query("q3_species_sites", f"SELECT {_SPECIES_SITES} FROM m_summary WHERE species = '{SPECIES}' ORDER BY 5")
def _(t):
    return serving.species_sites(t.summary, SPECIES)


@query("q3_every_species_sites", f"SELECT species, {_SPECIES_SITES} FROM m_summary")
def _(t):
    return serving.every_species_sites(t.summary)


@query("q4_list_divesites", "SELECT * FROM m_site_summary ORDER BY total_species DESC")
def _(t):
    return serving.list_divesites(t.site_summary)


@query("q5_divesite_species", f"""
SELECT {_PROFILE}, sighting_count, frequency_rank FROM m_detail WHERE dive_site = '{SITE}' AND species_type = 'normal'
ORDER BY frequency_rank, species, common_name NULLS LAST, description NULLS LAST, image_url NULLS LAST LIMIT 50""")
def _(t):
    return serving.divesite_species(t.detail, SITE, "normal")


@query("q5_top_species_per_site", f"""
SELECT dive_site, {_PROFILE}, sighting_count, frequency_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dive_site ORDER BY frequency_rank, species, common_name NULLS LAST,
    description NULLS LAST, image_url NULLS LAST, dive_site_latitude, dive_site_longitude) AS n FROM m_detail) r
WHERE n <= 10""")
def _(t):
    return serving.top_species_per_site(t.detail, 10)


@query("q6_species_by_name", f"""
SELECT species, common_name, image_url, coalesce(regexp_matches(lower(trim(image_url)),
  '^https?://.*\\.(png|jpg|jpeg|gif|bmp|tiff|svg)$'), FALSE) AS has_image
FROM species_enrichment WHERE species = '{SPECIES}'""")
def _(t):
    return serving.species_by_name(t.species_enrichment, SPECIES)


@query("q7_species_points", f"""
SELECT lat AS latitude, lon AS longitude, individual_count FROM m_occ WHERE species = '{SPECIES}'""")
def _(t):
    return serving.species_points(t.occurrences, SPECIES)


_HEAT = """
SELECT species, dive_site_latitude AS latitude, dive_site_longitude AS longitude,
  sighting_count / max(sighting_count) OVER (PARTITION BY species) AS intensity FROM m_summary"""


@query("q8_heat_points", f"SELECT latitude, longitude, intensity FROM ({_HEAT}) h WHERE species = '{SPECIES}'")
def _(t):
    return serving.heat_points(t.summary, SPECIES)


@query("q8_every_heat_points", _HEAT)
def _(t):
    return serving.every_heat_points(t.summary)


_STATS = """
SELECT species, count(*) AS sites, CAST(sum(sighting_count) AS BIGINT) AS sightings,
  max(sighting_count) AS max_sightings, min(dive_site_latitude) AS south, min(dive_site_longitude) AS west,
  max(dive_site_latitude) AS north, max(dive_site_longitude) AS east FROM m_summary {0} GROUP BY species"""


@query("q8_map_stats", _STATS.format(f"WHERE species = '{SPECIES}'"))
def _(t):
    return serving.map_stats(t.summary, SPECIES)


@query("q8_every_map_stats", _STATS.format(""))
def _(t):
    return serving.every_map_stats(t.summary)


@query("q9_site_markers", """
SELECT dive_site, latitude, longitude, CASE WHEN invasive_count > 0 THEN 'invasive' WHEN endangered_count > 0
  THEN 'endangered' ELSE 'normal' END AS risk_class, greatest(4.0, least(14.0, sqrt(total_species))) AS marker_size
FROM m_site_summary""")
def _(t):
    return serving.site_markers(t.site_summary)


@query("q9_species_site_markers", f"""
SELECT species, {_SPECIES_SITES}, greatest(5.0, least(18.0, sqrt(sighting_count) * 2)) AS marker_size FROM m_summary""")
def _(t):
    return serving.species_site_markers(t.summary)


@query("q10_display_title", f"""
SELECT DISTINCT {_CARD}, coalesce(nullif(common_name, ''), species) AS title FROM m_summary""")
def _(t):
    return serving.titled(serving.matching_species(t.summary))


# --- enrichment --------------------------------------------------------------------------------------------


def _work(t):
    return enrichment.work_list(t.species, t.species_enrichment)


def _replies(t):
    return (
        enrichment.extract_common_name(t.vernacular_responses),
        enrichment.extract_summary(t.summary_responses),
        enrichment.extract_fallback_image(t.image_responses),
    )


@query("e1_work_list", "SELECT * FROM m_work")
def _(t):
    return _work(t)


@query("e1_work_list_new_only", "SELECT * FROM m_new")
def _(t):
    return enrichment.work_list(t.species, t.species_enrichment, new_only=True)


@query("e2_common_names", "SELECT * FROM m_names")
def _(t):
    return _replies(t)[0]


@query("e3_summaries", "SELECT * FROM m_texts")
def _(t):
    return _replies(t)[1]


@query("e3_fallback_images", "SELECT * FROM m_images")
def _(t):
    return _replies(t)[2]


@query("e3_plan_lookups", """
SELECT w.species, w.common_name IS NULL AS needs_name, w.description IS NULL OR w.image_url IS NULL AS needs_summary,
  w.image_url IS NULL AND w.species NOT IN (SELECT species FROM m_texts WHERE image_url IS NOT NULL) AS needs_fallback
FROM m_work w""")
def _(t):
    return enrichment.plan_lookups(_work(t), _replies(t)[1])


@query("e4_resolve", "SELECT species, common_name, description, image_url, is_new FROM m_resolved")
def _(t):
    return enrichment.resolve_enrichment(_work(t), *_replies(t))


@query("e5_merge", "SELECT * FROM m_merged")
def _(t):
    return enrichment.merge_enrichment(
        t.species_enrichment, enrichment.resolve_enrichment(_work(t), *_replies(t)).drop("is_new")
    )


@query("e6_repeated_keys", """
SELECT scientificName AS species, count(*) AS rows FROM worms GROUP BY scientificName HAVING count(*) > 1""")
def _(t):
    return enrichment.repeated_keys(t.worms.withColumnRenamed("scientificName", "species"))


@query("e6_dedup", "SELECT * FROM species_enrichment")
def _(t):
    return enrichment.dedup_enrichment(t.species_enrichment.unionByName(t.species_enrichment))


@query("e7_enrich_incremental", "SELECT species, common_name, description, image_url, is_new FROM m_resolved")
def _(t):
    progress = new_table_path(t.spark, "progress")
    work = _work(t).cache()
    done = None
    # The first run stops after the rows that were tried before; the second picks up the rest.
    for share in (work.where("NOT is_new"), work):
        done = enrichment.enrich_incremental(t.spark, share, *_replies(t), progress=progress, batch_rows=100)
    work.unpersist()
    return done.drop("batch_id", "unit")


@query("e7_run_enrichment", "SELECT * FROM m_merged")
def _(t):
    folder, progress = new_table_path(t.spark, "versions"), new_table_path(t.spark, "progress")
    enrichment.write_version(t.species_enrichment, folder, 1)
    replies = (t.vernacular_responses, t.summary_responses, t.image_responses)
    enrichment.run_enrichment(t.spark, t.species, folder, progress, replies, batch_rows=100)
    return enrichment.current_version(t.spark, folder)[0]


@query("e8_batches", """
SELECT count(*) AS rows, count(DISTINCT species) AS species, CAST(ceil(count(*) / 50.0) AS BIGINT) AS batches,
  CAST(0 AS BIGINT) AS split_species, TRUE AS no_batch_twice_as_large FROM m_work""")
def _(t):
    batched = enrichment.assign_batches(_work(t), enrichment.DEV_BATCH_ROWS)
    per_species = batched.groupBy("species").agg(
        F.count(F.lit(1)).alias("n"), F.min("batch_id").alias("batch_id"), F.max("batch_id").alias("other"))
    ids = per_species.groupBy("batch_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("s"), F.count_if(F.col("batch_id") != F.col("other")).alias("split"))
    return ids.agg(
        F.sum("n").alias("rows"), F.sum("s").alias("species"), (F.max("batch_id") + 1).alias("batches"),
        F.sum("split").alias("split_species"),
        (F.max("n") <= 2 * enrichment.DEV_BATCH_ROWS).alias("no_batch_twice_as_large"))


@query("e8_image_groups", """
SELECT species, TRUE AS at_most_50, TRUE AS alone FROM (
  SELECT DISTINCT w.species FROM m_work w
  WHERE w.image_url IS NULL AND w.species NOT IN (SELECT species FROM m_texts WHERE image_url IS NOT NULL)) g""")
def _(t):
    work = _work(t)
    groups = enrichment.image_groups(
        enrichment.plan_lookups(work, _replies(t)[1]), enrichment.assign_batches(work, enrichment.BATCH_ROWS))
    listed = groups.select(F.explode("names").alias("species"), F.size("names").alias("n"))
    return listed.groupBy("species").agg(
        (F.max("n") <= enrichment.IMAGE_GROUP_NAMES).alias("at_most_50"), (F.count(F.lit(1)) == 1).alias("alone"))


# --- quality rules, each on data that breaks it -------------------------------------------------------------


def _model_tables(t) -> dict[str, DataFrame]:
    return {
        "gbif_occurrences": t.gbif, "obis_occurrences": t.obis, "divesites": t.sites, "occurrences": t.occurrences,
        "clustered_occurrences": t.occurrences, "species": t.species, "near_dive_site_occurrences": t.near,
        "monthly_species_occurrences": t.monthly, "divesite_species_frequency": t.frequency,
        "species_divesite_summary": t.summary, "divesite_species_detail": t.detail,
        "divesite_summary": t.site_summary, "worms": t.worms, "species_enrichment": t.species_enrichment,
    }


@query("d_run_checks", checks_sql(AS_OF.isoformat(" ")))
def _(t):
    # Rules read the tables as stored, so each is written once and not computed again per rule. Occurrences are stored
    # counted; the rules weigh them by their copies.
    folder = new_table_path(t.spark, "checked")
    stored = {}
    t.counted.write.parquet(f"{folder}/occurrences")
    stored["occurrences"] = stored["valid_records"] = t.spark.read.parquet(f"{folder}/occurrences")
    again = Tables(t.spark, t.folder, stored)
    writers.write_table(again.near, f"{folder}/near")
    stored["near"] = t.spark.read.parquet(f"{folder}/near")
    for name in ("species", "frequency", "detail"):
        again = Tables(t.spark, t.folder, stored)
        writers.write_table(getattr(again, name), f"{folder}/{name}")
        stored[name] = t.spark.read.parquet(f"{folder}/{name}")
    return quality.run_checks(_model_tables(Tables(t.spark, t.folder, stored)), as_of=AS_OF)


@query("d1_not_null", """
SELECT * FROM gbif_raw WHERE species IS NULL OR individualcount IS NULL OR eventdate IS NULL
  OR decimallongitude IS NULL OR decimallatitude IS NULL""")
def _(t):
    broken = F.lit(False)
    for name in t.gbif_raw.columns:
        broken = broken | F.col(name).isNull()
    return quality.violations(t.gbif_raw, broken)


@query("d2_unique", """
SELECT scientificName, count(*) AS rows FROM worms WHERE scientificName IS NOT NULL GROUP BY scientificName
HAVING count(*) > 1""")
def _(t):
    return quality.duplicate_keys(t.worms, "scientificName")


@query("d3_accepted_values", "SELECT * FROM m_species WHERE species_type NOT IN ('normal', 'invasive')")
def _(t):
    return quality.violations(t.species, ~F.col("species_type").isin("normal", "invasive"))


@query("d5_both_sources_present", """
SELECT 'missing_source' AS failure_reason FROM (
  SELECT count(DISTINCT source) AS n FROM m_records WHERE source = 'OBIS') c WHERE n < 2""")
def _(t):
    return quality.missing_source(staging.standardize(t.obis, "OBIS"))


@query("d6_distance_rules", f"SELECT {_NEAR} FROM m_pairs WHERE distance_to_dive_site > 2500")
def _(t):
    rules = quality.row_rules(radius_m=2500.0)["near_dive_site_occurrences"]
    pairs = models.near_dive_site_occurrences(t.counted, t.sites, rank_by=None)
    return repeated(_metres(quality.violations(pairs, rules["distance_within_radius"] | rules["distance_non_negative"])))


@query("d7_coordinates_valid", """
SELECT id, title, latitude, longitude FROM divesites_raw WHERE latitude IS NULL OR longitude IS NULL
  OR latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180""")
def _(t):
    return quality.violations(t.divesites_raw.drop("region"), quality.bad_coordinates())


@query("d8_summary_consistent", """
SELECT s.dive_site, s.total_species AS summary_count, d.n AS actual_count FROM m_site_summary s JOIN (
  SELECT dive_site, count(DISTINCT species) AS n FROM m_detail WHERE species_type = 'normal' GROUP BY dive_site) d
ON s.dive_site = d.dive_site WHERE s.total_species <> d.n""")
def _(t):
    return quality.summary_differs_from_detail(t.site_summary, t.detail.where("species_type = 'normal'"))


@query("d9_species_covered", """
SELECT DISTINCT r.species FROM m_records r LEFT JOIN m_species s ON r.species = s.species WHERE s.species IS NULL""")
def _(t):
    return quality.species_not_covered(models.all_records(t.gbif, t.obis), t.species)


@query("d10_sites_have_species", """
SELECT 'too_many_empty_divesites' AS failure_reason FROM (
  SELECT count(*) FILTER (WHERE endangered_count > 5) AS f, count(*) AS n FROM m_site_summary) c WHERE f < n * 0.5""")
def _(t):
    crowded = t.site_summary.withColumn("total_species", F.when(F.col("endangered_count") > 5, 1).otherwise(0))
    return quality.too_many_empty_sites(crowded)


@query("d10_species_have_sites", """
SELECT 'too_few_species_at_divesites' AS failure_reason FROM (
  SELECT (SELECT count(DISTINCT species) FROM m_summary WHERE sighting_count > 100) AS f,
    (SELECT count(*) FROM m_species) AS n) c WHERE f < n * 0.01""")
def _(t):
    return quality.too_few_species_at_sites(t.summary.where("sighting_count > 100"), t.species)


@query("d11_first_rank", """
SELECT dive_site FROM m_freq WHERE frequency_rank <> 1 GROUP BY dive_site HAVING min(frequency_rank) <> 1""")
def _(t):
    return quality.sites_without_first_rank(t.frequency.where("frequency_rank <> 1"))


@query("d12_counts_positive", "SELECT * FROM gbif_raw WHERE individualcount <= 0")
def _(t):
    rules = quality.row_rules()["occurrences"]
    raw = t.gbif_raw.withColumnRenamed("individualcount", "individual_count")
    return quality.violations(raw, rules["individual_count_positive"]).withColumnRenamed(
        "individual_count", "individualcount"
    )


@query("d13_no_future_dates", "SELECT * FROM m_occ WHERE event_date > TIMESTAMP '2000-06-30 12:00:00'")
def _(t):
    rules = quality.row_rules(as_of=datetime(2000, 6, 30, 12))["occurrences"]
    return repeated(quality.violations(t.counted, rules["no_future_dates"]))


@query("d14_type_consistent", """
SELECT species, is_invasive AS is_endangered, is_endangered AS is_invasive, species_type FROM m_species
WHERE (is_invasive AND species_type <> 'endangered') OR (NOT is_invasive AND is_endangered AND species_type <>
  'invasive') OR (NOT is_invasive AND NOT is_endangered AND species_type <> 'normal')""")
def _(t):
    swapped = t.species.select("species", F.col("is_invasive").alias("is_endangered"),
                               F.col("is_endangered").alias("is_invasive"), "species_type")
    return quality.violations(swapped, quality.type_contradicts_flags())


@query("d15_nothing_searchable", """
SELECT 'no_searchable_species' AS failure_reason FROM (SELECT count(common_name) AS n FROM m_new) c WHERE n = 0""")
def _(t):
    return quality.nothing_searchable(enrichment.new_species(t.species, t.species_enrichment))


# More queries, on tables that are replaced, bucketed, searched and checked as they are stored.
import checks.stored  # noqa: E402, F401
