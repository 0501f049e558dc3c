"""Records that a repeated taxonomy name repeats: worked on once, counted and written with every copy."""

import re

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from checks.inputs import Tables
from checks.registry import AS_OF, QUERIES, _files_that_may_hold, model_build
from tests.conftest import FOLDER, plan, rows
from tidewatch.operators import joins, taxa
from tidewatch.operators.copies import COPIES, count_rows, repeated, split_copies
from tidewatch.plans import build, models, quality
from tidewatch.sources import writers


@pytest.fixture
def tables(spark):
    """Five records of which one is far from the only site; name a is in the taxonomy seven times, b once."""
    gbif = spark.sql("""SELECT * FROM VALUES ('a', 1L, TIMESTAMP_NTZ'1996-05-01 00:00:00', 10.0D, 0.0D),
        ('a', 2L, TIMESTAMP_NTZ'1996-05-01 00:00:00', 10.0D, 0.024D), ('b', 3L, TIMESTAMP_NTZ'2001-01-01 00:00:00', 10.0D, 0.0D),
        ('c', 1L, TIMESTAMP_NTZ'2001-01-01 00:00:00', 10.0D, 0.0D), ('a', 1L, TIMESTAMP_NTZ'2001-02-01 00:00:00', 90.0D, 0.0D)
        v(species, individualcount, eventdate, lon, lat)""")
    return Tables(spark, FOLDER, {
        "gbif": gbif, "obis": gbif.limit(0), "worms": spark.createDataFrame([(n,) for n in "aaaaaaab"], "scientificName string"),
        "sites": spark.createDataFrame([("S", 10.0, 0.0), ("T", 10.0, 0.0)], "title string, lon double, lat double"),
    })


def expanded(tables):
    """The same occurrences by a plain join."""
    return models.all_records(tables.gbif, tables.obis).join(
        tables.worms.withColumnRenamed("scientificName", "species"), "species").select(*tables.occurrences.columns)


def names_joined_once(df, other_groupings=0):
    """The taxonomy is grouped by name before the join, beside what else groups by species."""
    return plan(df).count("HashAggregate(keys=[species#") == 2 * (1 + other_groupings)


def test_a_name_is_joined_and_measured_once(spark, tables, monkeypatch):
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 5)
    for mode in ("inner", "counted", "semi"):
        joined = models.occurrences(tables.gbif, tables.obis, tables.worms, mode=mode)
        assert "BroadcastHashJoin" in plan(joined) and "_salt" not in plan(joined), mode
    assert rows(tables.occurrences) == rows(expanded(tables)) == rows(repeated(tables.counted))
    assert tables.occurrences.count() == 3 * 7 + 1
    assert sorted(r[COPIES] for r in tables.counted.collect()) == [1, 7, 7, 7]


def test_pieces_add_up(spark):
    counted = spark.createDataFrame([("a", 7), ("b", 1), ("c", 6)], f"k string, {COPIES} bigint")
    pieces = split_copies(counted, 3)
    assert rows(pieces.groupBy("k").agg(F.sum(COPIES), F.max(COPIES), F.count(F.lit(1)))) == [
        ("a", 7, 3, 3), ("b", 1, 1, 1), ("c", 6, 3, 2)]
    assert rows(repeated(pieces.drop("_piece"))) == rows(repeated(counted))


def test_distinct_species_need_no_copies(tables):
    found = QUERIES["a4_distinct_species"].run(tables)
    assert names_joined_once(found, 1) and rows(found) == [("a",), ("b",)]


def test_the_clock_counts_copies(tables):
    found = QUERIES["d13_clock_of_the_check"].run(tables)
    assert names_joined_once(found) and rows(found) == [(22, 0)]
    nothing = tables.counted.where("species = 'none'")
    assert rows(nothing.agg(count_rows(nothing))) == [(0,)]


def test_late_records_are_repeated_after_the_filter(tables):
    found = QUERIES["d13_no_future_dates"].run(tables)
    assert names_joined_once(found) and sorted(r.species for r in found.collect()) == ["a"] * 7 + ["b"]


@pytest.mark.parametrize("rank_by", [None, "occurrence"])
def test_counted_records_give_counted_pairs(tables, rank_by):
    pairs = models.near_dive_site_occurrences(tables.counted, tables.sites, rank_by=rank_by)
    plain = models.near_dive_site_occurrences(expanded(tables), tables.sites, rank_by=rank_by)
    assert COPIES in pairs.columns and pairs.count() == (6 if rank_by is None else 3)
    assert rows(repeated(pairs)) == rows(plain)


def test_all_pairs_are_repeated(tables):
    assert QUERIES["j2_within_distance"].run(tables).count() == 2 * (2 * 7 + 1)


def test_distance_rules_repeat_what_breaks_them(tables):
    found = QUERIES["d6_distance_rules"].run(tables)
    assert names_joined_once(found) and sorted(r.dive_site for r in found.collect()) == ["S"] * 7 + ["T"] * 7


def test_nearest_site_of_each_copy(tables):
    found = QUERIES["w1_nearest_per_occurrence"].run(tables)
    assert names_joined_once(found) and sorted(r.dive_site for r in found.collect()) == ["S"] * 15


def test_closest_pair_of_a_timestamp_needs_no_copies(tables):
    assert names_joined_once(QUERIES["p5_near_dev"].run(tables))
    near = models.near_dive_site_occurrences(tables.counted, tables.sites)
    assert rows(near) == rows(models.near_dive_site_occurrences(expanded(tables), tables.sites)) and near.count() == 2


def test_counted_rows_are_written_with_every_copy(spark, tmp_path):
    path = str(tmp_path / "t")
    counted = spark.range(3000, numPartitions=5).selectExpr(
        "CONCAT('k', LPAD(id % 40, 2, '0')) AS species", "id", "TIMESTAMP_NTZ'2020-01-01 00:00:00' + MAKE_DT_INTERVAL(id % 60) AS at",
        "(id % 90) * 1.0D AS lon", "(id % 70) * 1.0D AS lat", f"CASE WHEN id % 40 = 7 THEN 90L ELSE 1 + id % 3 END AS {COPIES}")
    whole = rows(repeated(counted))
    for layout in ({}, {"partitions": 3}, {"cluster_by": ["species"]}, {"cluster_by": ["species"], "partitions": 12},
                   {"partition_month": "at", "cluster_by": ["geography"]}, {"partition_month": "at", "partitions": 4}):
        writers.write_table(counted, path, **layout)
        assert rows(spark.read.parquet(path).select("species", "id", "at", "lon", "lat")) == whole, layout
    writers.write_table(counted, path, cluster_by=["species"], partitions=12)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.collect_list("species"), F.count(F.lit(1))).collect()
    assert len(files) >= 8 and all(r[1] == sorted(r[1]) for r in files)
    # Name k07 has half of all rows; the file sizes follow the copies.
    assert max(r[2] for r in files) < 3 * len(whole) / 12
    assert joins.measure_repeated(counted)[1].rows == len(whole)


def test_every_month_holds_every_copy(tables):
    found = QUERIES["k3_every_month"].run(tables)
    assert rows(found.groupBy("event_month", "species").count()) == [
        ("1996-05-01", "a", 14), ("2001-01-01", "b", 1), ("2001-02-01", "a", 7)]


@pytest.mark.parametrize("name", ["k3_every_month", "k3_write_by_month", "k3_read_event_dates", "k4_write_clustered_by_species",
                                  "k4_clustered_files_skip"])
def test_rows_are_ordered_once_and_then_repeated(tables, monkeypatch, name):
    written, plain = [], writers.write_table
    monkeypatch.setattr(writers, "write_table", lambda df, *args, **layout: (written.append(df), plain(df, *args, **layout)))
    QUERIES[name].run(tables)
    assert written and all(COPIES in df.columns for df in written)


def test_copies_are_not_sorted_by_month_again(spark, tables, tmp_path, monkeypatch):
    plans, plain, kept = [], DataFrameWriter.parquet, "spark.sql.maxConcurrentOutputFileWriters"
    spark.sql(f"""CREATE TABLE months (event_date timestamp_ntz, species string, individual_count bigint, lon double, lat double,
        source string, event_month date) USING parquet PARTITIONED BY (event_month) LOCATION '{tmp_path}/months'""")

    def explained(writer, path, *args, **named):
        if path == f"{tmp_path}/t":
            writer._df.createOrReplaceTempView("written")
            plans.append(spark.sql("EXPLAIN INSERT OVERWRITE months SELECT * FROM written").first()[0])
        return plain(writer, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", explained)
    before = spark.conf.get(kept)
    try:
        writers.write_table(tables.counted, f"{tmp_path}/t", partition_month="event_date", cluster_by=["geography"])
        assert len(plans) == 1 and "WriteFiles" in plans[0] and "Generate explode(array_repeat" in plans[0]
        assert "Sort [" not in plans[0].split("Generate explode(array_repeat")[0]
    finally:
        spark.sql("DROP TABLE months")
    # The settings of the write are gone after it.
    assert spark.conf.get(kept) == before and rows(spark.read.parquet(f"{tmp_path}/t").drop("event_month")) == rows(repeated(tables.counted))


def test_a_range_of_many_months(spark, tmp_path):
    counted = spark.range(400, numPartitions=3).selectExpr(
        "id", "TIMESTAMP_NTZ'2020-01-05 00:00:00' + MAKE_YM_INTERVAL(0, CAST(id % 100 AS INT)) AS at", "(id % 9) * 1.0D AS lon",
        "0.0D AS lat", f"1 + id % 3 AS {COPIES}")
    assert writers.OPEN_MONTHS < 100
    writers.write_table(counted, str(tmp_path / "t"), partition_month="at", cluster_by=["geography"], partitions=1)
    read = spark.read.parquet(str(tmp_path / "t"))
    assert rows(read.select("id", "at", "lon", "lat")) == rows(repeated(counted))
    files = read.groupBy(F.input_file_name()).agg(F.count_distinct("event_month"), F.collect_list("lon")).collect()
    assert len(files) == 100 and all(r[1] == 1 and r[2] == sorted(r[2]) for r in files)


@pytest.mark.parametrize("name", ["k3_every_month", "k3_write_by_month"])
def test_no_row_formats_its_month(tables, name):
    found = QUERIES[name].run(tables)
    assert "date_format" not in plan(found) and dict(found.dtypes)["event_month"] == "string"
    year = [("1996-05-01", "a", 14)]
    assert rows(found.groupBy("event_month", "species").count()) == year + (
        [("2001-01-01", "b", 1), ("2001-02-01", "a", 7)] if name == "k3_every_month" else [])
    if name == "k3_write_by_month":
        assert "event_month" in plan(found).split("PartitionFilters: [")[1].split("]")[0]


def test_both_layouts_are_cut_from_one_set_of_records(tables, monkeypatch):
    written, paths, plain, new_path = [], [], writers.write_table, writers.new_table_path
    monkeypatch.setattr(writers, "new_table_path", lambda *args: (paths.append(args[1]), new_path(*args))[1])
    monkeypatch.setattr(writers, "write_table", lambda df, *args, **layout: (written.append(df.inputFiles()), plain(df, *args, **layout)))
    found = QUERIES["k4_clustered_files_skip"].run(tables)
    assert len(written) == 2 and written[0] and written[0] == written[1] and "unordered" not in paths
    assert "input_file_name" not in plan(found) and sorted(r.layout for r in found.collect()) == ["geography", "species"]


def test_bounds_of_files_are_hashed(spark, tmp_path):
    spark.range(100).selectExpr("CONCAT('k', id) AS species", "id").write.parquet(str(tmp_path / "t"))
    found = _files_that_may_hold(spark.read.parquet(str(tmp_path / "t")), {"species": "k5"}, {"species": "k6"})
    # The sort that a smallest text needs runs over the values of a file, not over its rows.
    assert re.search(r"HashAggregate\(keys=\[[^\]]*species#", plan(found))
    assert found.first().files >= 1


def test_rules_weigh_copies(spark, tables):
    counted = tables.counted.withColumn("individual_count", F.when(F.col("species") == "a", 0).otherwise(1).cast("bigint"))
    rule = {"x": F.col("individual_count") <= 0}
    assert rows(quality._tally(counted, rule)) == [("x", 21)]
    assert rows(quality.missing_references(counted, "species", counted.limit(0), "species")) == [("a", 21), ("b", 1)]


def test_copies_are_counted_while_written(spark, tables, tmp_path):
    counted = tables.counted.withColumn("event_date", F.lit(AS_OF).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    watched, counts = quality.observed(counted, "occurrences", as_of=AS_OF)
    writers.write_table(watched, str(tmp_path / "t"))
    assert counts()["no_future_dates"] == 22 == spark.read.parquet(str(tmp_path / "t")).count()
    assert counts()["individual_count_positive"] == 0


def test_observed_pairs_of_many_sites_stay_off_the_driver(tables, tmp_path, monkeypatch, shuffle_only):
    tables.sites.write.parquet(str(tmp_path / "sites"))
    tables.__dict__["sites"] = tables.spark.read.parquet(str(tmp_path / "sites"))
    for name in ("species", "gbif_raw"):
        table = tables.spark.sql("SELECT 'a' AS species, TRUE AS is_endangered, FALSE AS is_invasive, 'normal' AS species_type,"
                                 " 1L AS individualcount, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS eventdate, 0D AS decimallongitude, 0D AS decimallatitude")
        tables.__dict__[name] = table
    written = []
    monkeypatch.setattr(writers, "write_table", lambda df, *args, **layout: written.append(df))
    monkeypatch.setattr(quality, "observed", lambda df, *args, **named: (df, dict))
    QUERIES["d_observed_while_writing"].run(tables)
    # What may be broadcast is the tiles, bounded by the sphere; neither the cells nor the names.
    text = plan(written[2])
    assert text.count("SortMergeJoin") == 2 and text.count("BroadcastExchange") == 1


def test_the_build_copies_records_only_where_they_are_watched(spark, monkeypatch):
    given, laid = Tables(spark, FOLDER), {}
    inputs = {"gbif": given.gbif_raw, "obis": given.obis_raw, "worms": given.worms, "redlist": given.redlist, "invasive": given.invasive,
              "divesites": given.divesites_raw, "species_enrichment": given.species_enrichment}

    def replaced(table, folder, **layout):
        laid[folder.split("/")[-1]] = layout.get("stored")
        return table

    monkeypatch.setattr(build, "replace_table", replaced)
    monkeypatch.setattr(quality, "observed", lambda table, *args, **named: (table, dict))
    for observed in (None, {}):
        build.build_tables(spark, inputs, "unused", observed=observed)
        assert {laid[name] for name in ("occurrences", "clustered_occurrences")} == {observed is None}


def test_the_build_works_on_counted_records(spark, monkeypatch):
    seen, plain = [], models.near_dive_site_occurrences
    monkeypatch.setattr(models, "near_dive_site_occurrences", lambda records, *a, **k: (seen.append(records), plain(records, *a, **k))[1])
    given = Tables(spark, FOLDER)
    built = model_build(given)
    assert build.models is models and COPIES in seen[0].columns
    for name in ("occurrences", "clustered_occurrences"):
        assert rows(built[name]) == rows(given.occurrences), name
