"""The same tables in plain SQL, written for comparison: cross joins, windows and scalar functions only."""

from __future__ import annotations

import re

from checks.inputs import VIEWS

RADIUS = 3000.0

_WRAP = "CASE WHEN {0} BETWEEN -180 AND 180 THEN {0} ELSE {0} - floor(({0} + 180) / 360.0) * 360.0 END"
# A time is read from its first ten characters, its clock, and what is left over: the zone.
_ZONE = "trim(CASE WHEN length(eventDate) > 18 AND substr(eventDate, 14, 1) = ':' THEN substr(eventDate, 20)"
_ZONE += " ELSE substr(eventDate, 11) END)"
_CLOCK = "CASE WHEN length(eventDate) > 18 AND substr(eventDate, 14, 1) = ':' THEN substr(eventDate, 12, 8) ELSE '00:00:00' END"
_LOCAL = f"TRY_CAST(substr(eventDate, 1, 10) || ' ' || {_CLOCK} AS TIMESTAMP)"
_MINUTES = ("(60 * TRY_CAST(string_split(substr({0}, 2), ':')[1] AS INT)"
            " + coalesce(TRY_CAST(string_split(substr({0}, 2), ':')[2] AS INT), 0))").format(_ZONE)
_TIME = f"""CASE WHEN length(eventDate) < 10 THEN NULL
    WHEN {_ZONE} = '' OR upper({_ZONE}) IN ('Z', 'UTC') THEN {_LOCAL}
    WHEN left({_ZONE}, 1) = '+' THEN {_LOCAL} - to_minutes({_MINUTES})
    WHEN left({_ZONE}, 1) = '-' THEN {_LOCAL} + to_minutes({_MINUTES})
    WHEN {_ZONE} IN (SELECT name FROM pg_timezone_names())
      THEN timezone('UTC', timezone({_ZONE}, {_LOCAL})) END"""
_COUNT = r"CASE WHEN regexp_matches(individualCount, '^\s*[+-]?[0-9]+\s*$') THEN TRY_CAST(trim(individualCount) AS BIGINT) END"


def distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"sin(radians({lat2} - {lat1}) / 2)"
    b = f"sin(radians({lon2} - {lon1}) / 2)"
    chord = f"{a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b}"
    return f"(asin(least(1.0, sqrt({chord}))) * 12742020.0)"


_NEAR_COLUMNS = "dive_site, event_date, species, individual_count, distance_to_dive_site, lon, lat, source"
_NEAR_ORDER = "distance_to_dive_site, dive_site, species, source, individual_count, lon, lat"

# Each may name the ones before it, and the derived inputs.
MODELS = {
    "m_sites": f"""
SELECT title, {_WRAP.format('longitude')} AS lon, latitude AS lat FROM divesites_raw
WHERE title IS NOT NULL AND longitude IS NOT NULL AND latitude IS NOT NULL""",
    "m_gbif": f"""
SELECT species, greatest(coalesce(individualcount, 1), 1) AS individualcount, eventdate,
  {_WRAP.format('decimallongitude')} AS lon, decimallatitude AS lat FROM gbif_raw
WHERE eventdate IS NOT NULL AND decimallongitude IS NOT NULL AND decimallatitude IS NOT NULL
  AND species IS NOT NULL""",
    "m_obis": f"""
SELECT species, greatest(coalesce(n, 1), 1) AS individualcount, t AS eventdate,
  {_WRAP.format('decimalLongitude')} AS lon, decimalLatitude AS lat
FROM (SELECT *, {_COUNT} AS n, {_TIME} AS t FROM obis_raw) o
WHERE t IS NOT NULL AND decimalLongitude IS NOT NULL AND decimalLatitude IS NOT NULL AND species IS NOT NULL""",
    "m_records": """
SELECT eventdate AS event_date, species, individualcount AS individual_count, lon, lat, 'GBIF' AS source FROM m_gbif
UNION ALL
SELECT eventdate AS event_date, species, individualcount AS individual_count, lon, lat, 'OBIS' AS source FROM m_obis""",
    "m_occ": "SELECT r.* FROM m_records r JOIN worms w ON r.species = w.scientificName",
    "m_species": """
SELECT s.species, e.scientificName IS NOT NULL AS is_endangered, i.scientificName IS NOT NULL AS is_invasive,
  CASE WHEN e.scientificName IS NOT NULL THEN 'endangered' WHEN i.scientificName IS NOT NULL THEN 'invasive'
    ELSE 'normal' END AS species_type
FROM (SELECT DISTINCT species FROM m_occ) s
LEFT JOIN (SELECT DISTINCT scientificName FROM redlist) e ON s.species = e.scientificName
LEFT JOIN (SELECT DISTINCT scientificName FROM invasive) i ON s.species = i.scientificName""",
    "m_pairs": f"""
SELECT * FROM (
  SELECT s.title AS dive_site, o.event_date, o.species, o.individual_count,
    {distance('o.lon', 'o.lat', 's.lon', 's.lat')} AS distance_to_dive_site,
    o.lon, o.lat, o.source, o.rid, s.lon AS site_lon, s.lat AS site_lat
  FROM (SELECT *, row_number() OVER () AS rid FROM m_occ) o CROSS JOIN m_sites s) p
WHERE distance_to_dive_site <= {RADIUS}""",
    "m_near": f"""
SELECT {_NEAR_COLUMNS}, rn AS proximity_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY {_NEAR_ORDER}) AS rn FROM m_pairs) t WHERE rn = 1""",
    "m_near_each": f"""
SELECT {_NEAR_COLUMNS}, rn AS proximity_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY distance_to_dive_site, dive_site, site_lon, site_lat) AS rn
  FROM m_pairs) t WHERE rn = 1""",
    "m_freq": """
SELECT *, rank() OVER (PARTITION BY dive_site ORDER BY sighting_count DESC) AS frequency_rank FROM (
  SELECT dive_site, species, count(*) AS sighting_count FROM m_near GROUP BY dive_site, species) c""",
    "m_monthly": """
SELECT c.dive_site, c.species, s.lon, s.lat, strftime(c.event_date, '%b') AS month, c.event_date, c.sighting_count
FROM (SELECT dive_site, species, event_date, count(*) AS sighting_count FROM m_near
      GROUP BY dive_site, species, event_date) c JOIN m_sites s ON c.dive_site = s.title""",
    "m_detail": """
SELECT f.dive_site, s.lat AS dive_site_latitude, s.lon AS dive_site_longitude, f.species, e.common_name,
  e.description, e.image_url, sp.is_endangered, sp.is_invasive, sp.species_type, f.sighting_count, f.frequency_rank
FROM m_freq f JOIN m_species sp ON f.species = sp.species JOIN m_sites s ON f.dive_site = s.title
LEFT JOIN species_enrichment e ON f.species = e.species""",
    "m_summary": """
SELECT species, common_name, image_url, is_endangered, is_invasive, species_type, dive_site, dive_site_latitude,
  dive_site_longitude, sighting_count, frequency_rank FROM m_detail""",
    "m_site_summary": """
SELECT s.title AS dive_site, s.lat AS latitude, s.lon AS longitude, coalesce(a.ts, 0) AS total_species,
  CAST(coalesce(a.tn, 0) AS BIGINT) AS total_sightings, coalesce(a.e, 0) AS endangered_count,
  coalesce(a.i, 0) AS invasive_count
FROM m_sites s LEFT JOIN (
  SELECT dive_site, count(DISTINCT species) AS ts, sum(sighting_count) AS tn,
    count(*) FILTER (WHERE is_endangered) AS e, count(*) FILTER (WHERE is_invasive) AS i
  FROM m_detail GROUP BY dive_site) a ON s.title = a.dive_site""",
    "m_partial": """
SELECT species, common_name, description, image_url, FALSE AS is_new FROM species_enrichment
WHERE (common_name IS NULL OR description IS NULL OR image_url IS NULL)
  AND (common_name IS NOT NULL OR description IS NOT NULL OR image_url IS NOT NULL)""",
    "m_new": """
SELECT s.species, CAST(NULL AS VARCHAR) AS common_name, CAST(NULL AS VARCHAR) AS description,
  CAST(NULL AS VARCHAR) AS image_url, TRUE AS is_new
FROM m_species s LEFT JOIN species_enrichment e ON s.species = e.species WHERE e.species IS NULL""",
    "m_work": "SELECT * FROM m_partial UNION ALL SELECT * FROM m_new",
    "m_names": """
SELECT species, common_name FROM (
  SELECT species, json_extract_string(list_filter(json_extract(names_json, '$.results[*]'),
    lambda r: json_extract_string(r, '$.language') = 'eng')[1], '$.vernacularName') AS common_name
  FROM vernacular_responses
  WHERE CAST(json_extract_string(match_json, '$.usageKey') AS BIGINT) <> 0
    AND json_extract_string(match_json, '$.rank') = 'SPECIES') n WHERE common_name IS NOT NULL""",
    "m_texts": """
SELECT species, description, image_url FROM (
  SELECT *, row_number() OVER (PARTITION BY species ORDER BY CASE WHEN description IS NOT NULL AND image_url IS NOT NULL
    THEN 0 WHEN description IS NOT NULL THEN 1 ELSE 2 END, description, image_url) AS rn
  FROM (SELECT species, json_extract_string(json, '$.extract') AS description,
    json_extract_string(json, '$.originalimage.source') AS image_url FROM summary_responses) t
  WHERE description IS NOT NULL OR image_url IS NOT NULL) r WHERE rn = 1""",
    "m_first_image": """
SELECT species, arg_min(url, position) AS url FROM (
  SELECT json_extract_string(b, '$.scientificName.value') AS species, json_extract_string(b, '$.image.value') AS url,
    position
  FROM (SELECT unnest(bindings) AS b, generate_subscripts(bindings, 1) AS position
        FROM (SELECT json_extract(json, '$.results.bindings[*]') AS bindings FROM image_responses) j) u) v
WHERE url <> '' GROUP BY species""",
    "m_images": """
SELECT species, 'https://upload.wikimedia.org/wikipedia/commons/thumb/' || substr(md5(f), 1, 1) || '/' ||
  substr(md5(f), 1, 2) || '/' || q || '/800px-' || q AS image_url
FROM (SELECT *, replace(replace(replace(replace(f, '%', '%25'), '+', '%2B'), '*', '%2A'), '(', '%28') AS p1 FROM (
  SELECT species, replace(replace(replace(replace(string_split(url, '/')[-1], '%20', '_'), '%2B', chr(43)), ' ', '_'),
    '%25', '%') AS f FROM m_first_image) d) e, LATERAL (SELECT replace(p1, ')', '%29') AS q)""",
    "m_resolved": """
SELECT w.species, w.is_new,
  CASE WHEN w.is_new THEN n ELSE coalesce(n, '') END AS common_name,
  CASE WHEN w.is_new THEN t ELSE coalesce(t, '') END AS description,
  CASE WHEN w.is_new THEN g ELSE coalesce(g, '') END AS image_url
FROM (SELECT w.species, w.is_new,
    CASE WHEN w.common_name IS NULL THEN nullif(a.common_name, '') ELSE w.common_name END AS n,
    CASE WHEN w.description IS NULL THEN nullif(b.description, '')
      WHEN w.image_url IS NULL THEN coalesce(nullif(b.description, ''), w.description) ELSE w.description END AS t,
    CASE WHEN w.description IS NULL AND w.image_url IS NOT NULL THEN coalesce(nullif(b.image_url, ''), w.image_url)
      WHEN w.image_url IS NULL THEN coalesce(nullif(b.image_url, ''),
        CASE WHEN b.image_url IS NULL THEN nullif(c.image_url, '') END) ELSE w.image_url END AS g
  FROM m_work w LEFT JOIN m_names a ON w.species = a.species LEFT JOIN m_texts b ON w.species = b.species
  LEFT JOIN m_images c ON w.species = c.species) w""",
    "m_merged": """
SELECT coalesce(s.species, t.species) AS species, coalesce(s.common_name, t.common_name) AS common_name,
  coalesce(s.description, t.description) AS description, coalesce(s.image_url, t.image_url) AS image_url
FROM species_enrichment t FULL OUTER JOIN m_resolved s ON t.species = s.species""",
}

# Model table names as the rules use them.
BY_NAME = {
    "gbif_occurrences": "m_gbif",
    "obis_occurrences": "m_obis",
    "divesites": "m_sites",
    "occurrences": "m_occ",
    "clustered_occurrences": "m_occ",
    "species": "m_species",
    "near_dive_site_occurrences": "m_near",
    "monthly_species_occurrences": "m_monthly",
    "divesite_species_frequency": "m_freq",
    "species_divesite_summary": "m_summary",
    "divesite_species_detail": "m_detail",
    "divesite_summary": "m_site_summary",
    "worms": "worms",
    "species_enrichment": "species_enrichment",
}

_ALL = {**VIEWS, **MODELS}


def _names_in(text: str) -> list[str]:
    return [name for name in _ALL if re.search(rf"\b{name}\b", text)]


def compose(select: str) -> str:
    """One SQL statement: the views a query needs, directly or through others, as CTEs before it."""
    needed: set[str] = set()
    pending = _names_in(select)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending += [other for other in _names_in(_ALL[name]) if other != name]
    ctes = ",\n".join(f"{name} AS MATERIALIZED ({_ALL[name].strip()})" for name in _ALL if name in needed)
    return f"WITH {ctes}\n{select.strip()}" if ctes else select.strip()


# Which columns of a table must be known (a position is two columns), which values a column may take, and
# which columns refer to another table. Written out here, apart from the rules under test.
_NOT_NULL = """
gbif_occurrences species individualcount eventdate lon lat
obis_occurrences species individualcount eventdate lon lat
divesites title lon lat
occurrences event_date species individual_count lon lat source
clustered_occurrences event_date species individual_count lon lat source
species species is_endangered is_invasive species_type
near_dive_site_occurrences dive_site event_date species individual_count distance_to_dive_site lon lat source proximity_rank
monthly_species_occurrences dive_site species lon lat month event_date sighting_count
divesite_species_frequency dive_site species sighting_count frequency_rank
species_divesite_summary species is_endangered is_invasive species_type dive_site dive_site_latitude dive_site_longitude sighting_count frequency_rank
divesite_species_detail dive_site dive_site_latitude dive_site_longitude species is_endangered is_invasive species_type sighting_count frequency_rank
divesite_summary dive_site latitude longitude total_species total_sightings endangered_count invasive_count
"""
_ACCEPTED = """
near_dive_site_occurrences source 'GBIF', 'OBIS'
near_dive_site_occurrences proximity_rank 1
monthly_species_occurrences month 'Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'
species_divesite_summary species_type 'endangered', 'invasive', 'normal'
divesite_species_detail species_type 'endangered', 'invasive', 'normal'
occurrences source 'GBIF', 'OBIS'
clustered_occurrences source 'GBIF', 'OBIS'
species is_endangered TRUE, FALSE
species is_invasive TRUE, FALSE
species species_type 'endangered', 'invasive', 'normal'
"""
_RELATIONSHIPS = """
near_dive_site_occurrences dive_site divesites title
near_dive_site_occurrences species worms scientificName
occurrences species worms scientificName
"""


def checks_sql(as_of: str) -> str:
    """All rules as one statement: (rule, severity, violations)."""
    parts = []

    def add(rule: str, table: str, condition: str, severity: str = "error") -> None:
        parts.append(
            f"SELECT '{rule}' AS rule, '{severity}' AS severity, count(*) FILTER (WHERE {condition}) AS violations"
            f" FROM {table}"
        )

    for line in _NOT_NULL.strip().splitlines():
        table, *names = line.split()
        for name in names:
            add(f"not_null:{table}.{name}", BY_NAME[table], f"{name} IS NULL")
    for line in _ACCEPTED.strip().splitlines():
        table, name, allowed = line.split(maxsplit=2)
        add(f"accepted_values:{table}.{name}", BY_NAME[table], f"{name} NOT IN ({allowed})")
    add("unique:species.species", "(SELECT species, count(*) AS n FROM m_species GROUP BY species) g", "n > 1")
    for child, name, parent, parent_name in (line.split() for line in _RELATIONSHIPS.strip().splitlines()):
        add(f"relationships:{child}.{name}",
            f"(SELECT DISTINCT {name} AS v FROM {BY_NAME[child]}) c"
            f" LEFT JOIN (SELECT DISTINCT {parent_name} AS k FROM {BY_NAME[parent]}) p ON c.v = p.k", "k IS NULL")
    add("distance_non_negative", "m_near", "distance_to_dive_site < 0")
    add("distance_within_radius", "m_near", f"distance_to_dive_site > {RADIUS}")
    add("coordinates_valid", "m_site_summary",
        "latitude IS NULL OR longitude IS NULL OR latitude NOT BETWEEN -90 AND 90 OR longitude NOT BETWEEN -180 AND 180")
    add("individual_count_positive", "m_occ", "individual_count <= 0")
    add("no_future_dates", "m_occ", f"event_date > TIMESTAMP '{as_of}'")
    add("sighting_count_positive", "m_freq", "sighting_count <= 0")
    add("species_type_present", "m_detail",
        "species_type IS NULL OR species_type NOT IN ('endangered', 'invasive', 'normal')")
    add("type_consistent_with_flags", "m_species",
        "(is_endangered AND species_type <> 'endangered') OR (NOT is_endangered AND is_invasive AND species_type <>"
        " 'invasive') OR (NOT is_endangered AND NOT is_invasive AND species_type <> 'normal')")
    add("both_sources_present", "(SELECT count(DISTINCT source) AS n FROM m_occ) c", "n < 2")
    add("summary_consistent_with_detail",
        "m_site_summary s JOIN (SELECT dive_site, count(DISTINCT species) AS n FROM m_detail GROUP BY dive_site) d"
        " ON s.dive_site = d.dive_site", "n <> total_species")
    add("species_cover_occurrences",
        "(SELECT DISTINCT species AS o FROM m_occ) c LEFT JOIN m_species s ON c.o = s.species", "s.species IS NULL")
    add("sites_have_species",
        "(SELECT count(*) FILTER (WHERE total_species > 0) AS f, count(*) AS n FROM m_site_summary) c", "f < n * 0.5")
    add("species_have_sites",
        "(SELECT (SELECT count(DISTINCT species) FROM m_summary) AS f, (SELECT count(*) FROM m_species) AS n) c",
        "f < n * 0.01")
    add("first_rank_is_one",
        "(SELECT dive_site, min(frequency_rank) AS r FROM m_freq GROUP BY dive_site) g", "r <> 1")
    add("some_species_searchable", "(SELECT count(common_name) AS n FROM species_enrichment) c", "n = 0", "warn")
    return " UNION ALL ".join(parts)
