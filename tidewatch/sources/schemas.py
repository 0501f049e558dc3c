"""Declared schemas, as DDL, of the stored inputs and of the enrichment and response tables."""

from __future__ import annotations

# Field names are those of the published observation files (fixed values).
OBSERVATION_FILE = (
    "interpreted struct<species:string,individualCount:string,eventDate:string,eventTime:string,"
    "date_year:bigint,month:string,day:string,decimalLongitude:double,decimalLatitude:double>"
)
OBSERVATIONS = (
    "species string, individualCount string, eventDate string, eventTime string, year bigint, month string,"
    " day string, decimalLongitude double, decimalLatitude double"
)
TYPED_OBSERVATIONS = (
    "species string, individualcount bigint, eventdate timestamp_ntz, decimallongitude double,"
    " decimallatitude double"
)
CHECKLIST = "scientificName string"
SITES = "id bigint, title string, latitude double, longitude double"
ENRICHMENT = "species string, common_name string, description string, image_url string"
NAME_REPLIES = "species string, match_json string, names_json string"
SUMMARY_REPLIES = "species string, json string"
IMAGE_REPLIES = "json string"

STORED = {
    "obis_table": OBSERVATIONS,
    "gbif_table": TYPED_OBSERVATIONS,
    "worms_table": CHECKLIST,
    "redlist_table": CHECKLIST,
    "invasive_table": CHECKLIST,
    "divesites_table": SITES,
    "species_enrichment": ENRICHMENT,
}

# JSON bodies inside the landed replies and site pages.
GUIDE_PAGE = "results array<struct<id:bigint,title:string,latitude:double,longitude:double>>"
MAP_PAGE = "array<struct<id:bigint,title:string,latitude:double,longitude:double>>"
NAME_MATCH = "usageKey bigint, rank string"
NAME_LIST = "results array<struct<vernacularName:string,language:string>>"
SUMMARY = "extract string, originalimage struct<source:string>"
IMAGE_BINDINGS = (
    "results struct<bindings:array<struct<scientificName:struct<value:string>,image:struct<value:string>>>>"
)
