"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
    BENCH_CPUS    local threads (default 8)

The raw inputs are landed as parquet first, as they are in production. The staging, join and model queries then
run from the landed files through all the steps before them, the serving queries from the tables the build wrote.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks.inputs import VIEWS, Tables
from checks.registry import QUERIES, SPECIES, model_build
from tidewatch.operators import joins
from tidewatch.session import local_session, new_table_path
from tidewatch.sources import schemas
from tidewatch.sources.readers import read_observations
from tidewatch.sources.writers import write_table

# How often the ingest of many records reads the landed files.
INGEST_COPIES = 100

FROM_RAW = (
    "s1_read_observations",
    "s7_stage_gbif",
    "p3_stage_obis",
    "j1_validate_taxa",
    "j2_within_distance",
    "j3_classify_species",
    "w1_nearest_per_event_date",
    "w1_nearest_per_occurrence",
    "w2_frequency_rank",
    "c2_monthly_species_occurrences",
    "c3_divesite_species_detail",
    "c6_divesite_summary",
    "e3_fallback_images",
    "k3_write_by_month",
)
FROM_TABLES = (
    "q1_search_species",
    "q2_every_species_detail",
    "q3_species_sites",
    "q4_list_divesites",
    "q5_divesite_species",
    "q5_top_species_per_site",
    "q7_species_points",
    "q8_every_heat_points",
    "q8_every_map_stats",
    "e1_work_list",
    "e4_resolve",
    "e5_merge",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}

    def timed(name: str, action) -> None:
        started = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - started, 3)

    landing = new_table_path(spark, "landing")

    def land() -> None:
        derived = Tables(spark, folder)
        for name in VIEWS:
            derived.table(name).repartition(int(cpus)).write.parquet(f"{landing}/{name}")

    timed("land_inputs", land)
    nested = spark.read.parquet(f"{landing}/obis_raw").withColumnRenamed("year", "date_year")
    nested.select(F.struct("*").alias("interpreted")).write.parquet(f"{landing}/nested")
    inputs = {name: spark.read.parquet(f"{landing}/{name}") for name in VIEWS}

    def run(name: str, stored) -> None:
        QUERIES[name].run(Tables(spark, folder, stored)).write.format("noop").mode("overwrite").save()

    def ingest() -> None:
        write_table(read_observations(spark, f"{landing}/nested"), f"{landing}/ingested", codec="zstd")

    timed("ingest_observations", ingest)

    # Fixed costs hide the rate of a small ingest, so the same files are read many times over.
    copies = [f"{landing}/nested"] * INGEST_COPIES
    nested_files = spark.read.schema(schemas.OBSERVATION_FILE).parquet(*copies)
    many = nested_files.where("interpreted.species IS NOT NULL").select("interpreted.*")
    timed("ingest_many", lambda: write_table(many, f"{landing}/ingested_many", codec="zstd"))
    for name in FROM_RAW:
        timed(name, lambda name=name: run(name, inputs))
    built = {}
    timed("build_all_tables", lambda: built.update(model_build(Tables(spark, folder, inputs))))
    tables = {
        **inputs, "sites": built["divesites"], "occurrences": built["clustered_occurrences"],
        "species": built["species"], "summary": built["species_divesite_summary"],
        "detail": built["divesite_species_detail"], "site_summary": built["divesite_summary"],
    }
    for name in FROM_TABLES:
        timed(name, lambda name=name: run(name, tables))

    # The ways beyond what counting proves small, and a key read from a table of many files.
    limit, joins.BROADCAST_MAX_ROWS = joins.BROADCAST_MAX_ROWS, -1
    timed("shuffle_w1_nearest_per_event_date", lambda: run("w1_nearest_per_event_date", inputs))
    joins.BROADCAST_MAX_ROWS = limit
    files = f"{landing}/many_files"
    write_table(built["clustered_occurrences"], files, cluster_by=["species"], partitions=64)
    timed("read_one_key_of_many_files", lambda: spark.read.parquet(files).where(F.col("species") == SPECIES).count())

    records = inputs["gbif_raw"].count() + inputs["obis_raw"].count()
    landed = seconds.pop("land_inputs")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")),
        "land_inputs_sec": landed,
        "raw_records": records,
        "ingest_records_per_sec": round(inputs["obis_raw"].count() / seconds["ingest_observations"]),
        "ingest_many_records_per_sec_and_thread": round(
            INGEST_COPIES * inputs["obis_raw"].count() / seconds["ingest_many"] / int(cpus)),
        "staging_records_per_sec": round(records / (seconds["p3_stage_obis"] + seconds["s7_stage_gbif"])),
        "build_records_per_sec": round(records / seconds["build_all_tables"]),
    }))


if __name__ == "__main__":
    main()
