"""Input tables derived from the whole given tables, by one SQL text that both engines run.

Missing values, bad counts, partial dates, repeated names and titles come from
the columns of the given tables, so they grow with them.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidewatch.plans import models, staging

GIVEN = ("supplier", "part", "lineitem", "events")

_NAME = "p_name || ' ' || p_brand || ' ' || p_type"
_SITE_LAT = "CAST((({0} * 37) % 121) - 60 AS DOUBLE)"
_SITE_LON = "CAST((({0} * 73) % 361) - 180 AS DOUBLE)"
_FILE = "http://commons.wikimedia.org/wiki/Special:FilePath/"

VIEWS = {
    # Every tenth site has the title of the one before; some titles and latitudes are missing.
    "divesites_raw": f"""
SELECT s_suppkey AS id, s_nationkey AS region,
  CASE WHEN s_nationkey = 11 THEN NULL ELSE 'Site-' ||
    CAST(s_suppkey - CASE WHEN s_suppkey % 10 = 9 THEN 1 ELSE 0 END AS VARCHAR(20)) END AS title,
  CASE WHEN s_nationkey = 16 THEN NULL ELSE {_SITE_LAT.format('s_suppkey')} END AS latitude,
  {_SITE_LON.format('s_suppkey')} AS longitude
FROM supplier""",
    # Names repeat in the taxonomy.
    "worms": f"SELECT {_NAME} AS scientificName FROM part WHERE p_size <= 40",
    # The two lists overlap.
    "redlist": f"SELECT {_NAME} AS scientificName FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_size <= 15",
    "invasive": f"SELECT {_NAME} AS scientificName FROM part WHERE p_type IN ('SMALL', 'LARGE') AND p_size <= 25",
    # Typed source.
    "gbif_raw": f"""
SELECT CASE WHEN l_returnflag = 'N' AND l_tax = 0.08 THEN NULL ELSE {_NAME} END AS species,
  CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS BIGINT) - 2 END AS individualcount,
  CASE WHEN l_linenumber = 7 AND l_quantity = 50 THEN NULL ELSE l_shipdate END AS eventdate,
  {_SITE_LON.format('l_suppkey')} + (((l_orderkey * 7 + l_linenumber * 13) % 101) - 50) / CAST(1000 AS DOUBLE)
    AS decimallongitude,
  CASE WHEN l_discount = 0.1 AND l_tax = 0.0 THEN NULL ELSE {_SITE_LAT.format('l_suppkey')}
    + (((l_orderkey * 11 + l_linenumber * 17) % 101) - 50) / CAST(1000 AS DOUBLE) END AS decimallatitude
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""",
    # Text-typed source: unreadable counts, partial dates, offsets.
    "obis_raw": f"""
SELECT CASE WHEN k = 98 THEN NULL ELSE name END AS species,
  CASE event_type WHEN 'error' THEN 'many' WHEN 'signup' THEN NULL WHEN 'click' THEN ' ' || CAST(k AS VARCHAR(9))
    WHEN 'view' THEN CASE WHEN k < 50 THEN '-4' ELSE '3.0' END ELSE CAST(k AS VARCHAR(9)) END AS individualCount,
  CASE WHEN k < 5 THEN 'unknown' WHEN k < 10 THEN '2024-01' WHEN k < 15 THEN NULL WHEN k < 25 THEN iso || 'Z'
    WHEN k < 35 THEN iso || '+02:00' WHEN k < 45 THEN iso || '-05:30' WHEN k < 55 THEN day
    WHEN k < 59 THEN iso || '+02' WHEN k < 63 THEN iso || '-5:30' WHEN k < 66 THEN replace(iso, ' ', 't') || 'z'
    WHEN k < 69 THEN iso || ' UTC' WHEN k < 73 THEN iso || ' America/New_York' WHEN k < 75 THEN iso || ' No/Where'
    WHEN k < 78 THEN day || '+3' WHEN k < 80 THEN iso || ' -08:00' ELSE iso END AS eventDate,
  substr(iso, 12) AS eventTime, CAST(substr(iso, 1, 4) AS BIGINT) AS year, substr(iso, 6, 2) AS month,
  substr(iso, 9, 2) AS day,
  {_SITE_LON.format('user_id')} + (((event_id * 7) % 101) - 50) / CAST(1000 AS DOUBLE) AS decimalLongitude,
  CASE WHEN k = 99 THEN NULL ELSE {_SITE_LAT.format('user_id')}
    + (((event_id * 11) % 101) - 50) / CAST(1000 AS DOUBLE) END AS decimalLatitude
FROM (SELECT event_id, user_id, event_type, (event_id * 31) % 100 AS k, {_NAME} AS name,
        substr(CAST(ts AS VARCHAR(30)), 1, 19) AS iso, substr(CAST(ts AS VARCHAR(30)), 1, 10) AS day
      FROM events LEFT JOIN part ON p_partkey = user_id) e""",
    "taxon_key": f"""
SELECT {_NAME} AS species, MIN(p_partkey) AS k, MIN(p_size) AS size FROM part GROUP BY {_NAME}""",
    # NULL = not tried, '' = nothing found; large taxa have no row yet.
    "species_enrichment": """
SELECT species,
  CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'Common ' || species END AS common_name,
  CASE k % 3 WHEN 0 THEN NULL ELSE 'About ' || species END AS description,
  CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'https://img.example/' || CAST(k AS VARCHAR(20)) ||
    CASE WHEN size > 20 THEN '.jpg' WHEN size > 10 THEN '.PNG ' WHEN size > 5 THEN '.webp' ELSE '' END END AS image_url
FROM taxon_key WHERE size <= 30""",
    "vernacular_responses": """
SELECT species,
  CASE k % 5 WHEN 0 THEN '{"matchType":"NONE"}'
    WHEN 1 THEN '{"usageKey":' || CAST(k AS VARCHAR(20)) || ',"rank":"GENUS"}'
    ELSE '{"usageKey":' || CAST(k + 1 AS VARCHAR(20)) || ',"rank":"SPECIES"}' END AS match_json,
  CASE k % 3 WHEN 0 THEN '{"results":[]}'
    WHEN 1 THEN '{"results":[{"vernacularName":"fr ' || species || '","language":"fra"}]}'
    ELSE '{"results":[{"vernacularName":"fr ' || species || '","language":"fra"},{"vernacularName":"en ' || species
      || '","language":"eng"},{"vernacularName":"en2 ' || species || '","language":"eng"}]}' END AS names_json
FROM taxon_key""",
    "summary_responses": """
SELECT species,
  CASE k % 4 WHEN 1 THEN '{"extract":"Text ' || species || '"}' WHEN 2 THEN '{"type":"standard"}'
    ELSE '{"extract":"Text ' || species || '","originalimage":{"source":"https://img.example/w'
      || CAST(k AS VARCHAR(20)) || '.png"}}' END AS json
FROM taxon_key WHERE size > 5
UNION ALL SELECT species, '{"originalimage":{"source":"https://img.example/a' || CAST(k AS VARCHAR(20)) || '.png"}}'
FROM taxon_key WHERE size > 5 AND k % 8 < 3""",
    # Some names have two images: the first wins. Some addresses are empty.
    "image_responses": f"""
SELECT '{{"results":{{"bindings":[{{"scientificName":{{"value":"' || species || '"}},"image":{{"value":"' ||
  CASE WHEN k % 7 = 3 THEN '' ELSE '{_FILE}Red%20Fish%20(' || CAST(k AS VARCHAR(20)) || ')%2B~*.jpg' END || '"}}}}' ||
  CASE WHEN k % 2 = 0 THEN ',{{"scientificName":{{"value":"' || species ||
    '"}},"image":{{"value":"{_FILE}Other+' || CAST(k AS VARCHAR(20)) || '.jpg"}}}}' ELSE '' END || ']}}}}' AS json
FROM taxon_key WHERE size <= 30""",
    # Some sites are missing from the guide, some from the map; map cells overlap. A page has the sites of one region.
    "guide_pages": """
SELECT '{"results":[' || string_agg('{"id":' || CAST(id AS VARCHAR(20)) || ',"title":"' || title || '","images":["x.jpg"]}', ',')
  || ']}' AS body
FROM divesites_raw WHERE region <> 5 AND title IS NOT NULL GROUP BY region""",
    "map_pages": """
SELECT '[' || string_agg('{"id":' || CAST(id AS VARCHAR(20)) || ',"latitude":' || CAST(((id * 37) % 121) - 60 AS VARCHAR(20))
  || ',"longitude":' || CAST(((id * 73) % 361) - 180 AS VARCHAR(20)) || '}', ',') || ']' AS body
FROM (SELECT id, region FROM divesites_raw WHERE region <> 7
      UNION ALL SELECT id, region + 100 AS region FROM divesites_raw WHERE region < 9 AND region <> 7) cells
GROUP BY region""",
}


_schemas: dict[str, StructType] = {}


def read_given(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is read from the file once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


class Inputs:
    """The derived tables of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str, stored: dict[str, DataFrame] | None = None):
        """``stored`` gives tables that are already written, by name; they are used instead of being derived."""
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}
        for name, table in (stored or {}).items():
            if name in VIEWS:
                self._tables[name] = table
            else:
                self.__dict__[name] = table

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            if name in GIVEN:
                table = read_given(self.spark, self.folder, name)
            else:
                text = VIEWS[name].strip()
                for other in (*GIVEN, *VIEWS):
                    if re.search(rf"\b{other}\b", text):
                        self.table(other).createOrReplaceTempView(other)
                table = self.spark.sql(text)
            self._tables[name] = table
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS or name in GIVEN:
            return self.table(name)
        raise AttributeError(name)


class Tables(Inputs):
    """The model tables over the derived inputs, lazy and each defined once."""

    @cached_property
    def sites(self):
        return staging.stage_sites(self.divesites_raw)

    @cached_property
    def gbif(self):
        return staging.stage_gbif(self.gbif_raw)

    @cached_property
    def obis(self):
        return staging.stage_obis(self.obis_raw)

    @cached_property
    def occurrences(self):
        return models.occurrences(self.gbif, self.obis, self.worms)

    @cached_property
    def counted(self):
        """The occurrences with each record once and its number of copies."""
        return models.occurrences(self.gbif, self.obis, self.worms, mode="counted")

    @cached_property
    def valid_records(self):
        """Each record with a taxonomy name once. Rows that only repeat change neither the set of species nor the
        closest pair of a timestamp, so those two start here."""
        return models.occurrences(self.gbif, self.obis, self.worms, mode="semi")

    @cached_property
    def species(self):
        return models.species(self.valid_records, self.redlist, self.invasive)

    @cached_property
    def near(self):
        return models.near_dive_site_occurrences(self.valid_records, self.sites)

    @cached_property
    def frequency(self):
        return models.divesite_species_frequency(self.near)

    @cached_property
    def monthly(self):
        return models.monthly_species_occurrences(self.near, self.sites)

    @cached_property
    def detail(self):
        return models.divesite_species_detail(self.frequency, self.species, self.sites, self.species_enrichment)

    @cached_property
    def summary(self):
        return models.species_divesite_summary(self.frequency, self.species, self.sites, self.species_enrichment)

    @cached_property
    def site_summary(self):
        return models.divesite_summary(self.sites, self.detail)
