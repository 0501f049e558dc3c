import pytest
from pyspark.sql import functions as F

from checks.inputs import Tables
from tests.conftest import FOLDER, plan, rows
from tidewatch.sources import readers, writers


@pytest.fixture
def observations(spark, tmp_path):
    record = ("struct('a' AS species, '1' AS individualCount, '2020-01-01' AS eventDate, '' AS eventTime,"
              " 2020L AS date_year, '1' AS month, '1' AS day, id * 1.0D AS decimalLongitude,"
              " CASE WHEN id > 0 THEN id * 1.0D END AS decimalLatitude, 'unused' AS remarks) AS interpreted")
    for part in ("x", "y/z"):
        spark.range(10).selectExpr(record, "'raw' AS original").write.parquet(str(tmp_path / "in" / part))
    return tmp_path / "in"


def test_observations_below_a_folder(spark, observations):
    read = readers.read_observations(spark, str(observations))
    assert read.columns == ["species", "individualCount", "eventDate", "eventTime", "year", "month", "day",
                            "decimalLongitude", "decimalLatitude"]
    assert read.count() == 18
    text = plan(read.select("species", "decimalLatitude"))
    assert "remarks" not in text and "eventTime" not in text.split("ReadSchema")[-1]
    assert "IsNotNull(interpreted.decimalLatitude)" in text


def test_unreadable_files_fail_or_are_skipped(spark, observations):
    (observations / "broken.parquet").write_bytes(b"not parquet at all")
    (observations / "notes.txt").write_text("ignored")
    with pytest.raises(Exception, match="not a Parquet file"):
        readers.read_observations(spark, str(observations)).collect()
    assert readers.read_observations(spark, str(observations), on_error="skip").count() == 18
    with pytest.raises(ValueError):
        readers.read_observations(spark, str(observations), on_error="warn")


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tidewatch import session

    class Elsewhere:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Elsewhere()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_checklist_text(spark, tmp_path):
    core = tmp_path / "core.txt"
    core.write_text('taxonID\tscientificName\tremark\n1\tA "b" c\tx\n2\tÉ d\t\n3\t\ty\n', encoding="utf-8")
    read = readers.read_checklist(spark, str(core), "taxonID string, scientificName string, remark string")
    assert rows(read.select("taxonID", "scientificName")) == [("1", 'A "b" c'), ("2", "É d"), ("3", None)]


def test_sites_from_pages(spark):
    guide = spark.createDataFrame([
        ('{"results":[{"id":1,"title":"A","images":["i"]},{"id":2,"title":"B"},{"id":3,"title":null}]}',),
        ('{"results":[{"id":4,"title":"only guide"}]}',), ('{"results":[]}',), ('{"detail":"Invalid page."}',),
    ], "body string")
    cells = spark.createDataFrame([
        ('[{"id":1,"latitude":1.5,"longitude":2},{"id":2,"latitude":3,"longitude":4}]',),
        ('[{"id":1,"latitude":1.5,"longitude":2},{"id":3,"latitude":5,"longitude":6}]',),
        ('[{"id":9,"latitude":7,"longitude":8}]',), ("[]",), ('{"error":"too many"}',),
    ], "body string")
    repeated = [(1, "A", 1.5, 2.0), (1, "A", 1.5, 2.0), (2, "B", 3.0, 4.0)]
    assert rows(readers.build_sites(guide, cells)) == repeated
    assert rows(readers.build_sites(guide, cells, dedup=True)) == repeated[1:]


def test_month_folders_are_pruned_and_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.sql("""SELECT t AS event_date, n FROM VALUES (TIMESTAMP_NTZ'2020-01-31 23:00:00', 1),
        (TIMESTAMP_NTZ'2020-02-01 00:00:00', 2), (TIMESTAMP_NTZ'2020-03-05 00:00:00', 3) v(t, n)""")
    writers.write_table(table, path, partition_month="event_date")
    read = writers.read_months(spark, path, "2020-02-01", "2020-02-01")
    assert [r.n for r in read.collect()] == [2]
    assert "PartitionFilters: [isnotnull(event_month" in plan(read)
    placed = table.selectExpr("event_date", "n", "n * 20.0D AS lon", "n * 5.0D AS lat")
    for files in (None, 4):
        writers.write_table(placed, path, partition_month="event_date", cluster_by=["geography"], partitions=files)
        assert rows(spark.read.parquet(path).drop("event_month")) == rows(placed)
    writers.write_table(table, path, partition_month="event_date")
    writers.write_table(table.where("n = 2").withColumn("n", F.lit(20)), path, partition_month="event_date",
                        keep_other_months=True)
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 3, 20]
    writers.write_table(table.where("n = 3"), path, partition_month="event_date")
    assert [r.n for r in spark.read.parquet(path).collect()] == [3]


def test_clustered_files_are_sorted_and_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(5000, numPartitions=5).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CONCAT('k', id % 70) END AS species", "id",
        "(id * 37 % 360) - 180.0D AS lon", "(id * 11 % 180) - 90.0D AS lat")
    writers.write_table(table, path, cluster_by=["species"], codec="zstd")
    read = spark.read.parquet(path)
    assert rows(read) == rows(table)
    for file in [r[0] for r in read.select(F.input_file_name()).distinct().collect()]:
        keys = [r.species for r in spark.read.parquet(file).collect()]
        assert keys == sorted(keys) and ".zstd." in file
    writers.write_table(table, path, cluster_by=["geography"])
    assert rows(spark.read.parquet(path)) == rows(table)


def test_a_key_lies_in_few_files_and_a_hot_key_in_several(spark, tmp_path):
    path = str(tmp_path / "t")
    table = spark.range(30_000, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'k35' ELSE CONCAT('k', LPAD(id % 70, 2, '0')) END AS species", "id")
    writers.write_table(table, path, cluster_by=["species"], partitions=12)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(
        F.min("species").alias("low"), F.max("species").alias("high"), F.count(F.lit(1)).alias("n")).collect()
    assert len(files) >= 8 and max(r.n for r in files) < 2 * 30_000 / len(files)
    assert sum(r.low <= "k10" <= r.high for r in files) <= 2
    assert sum(r.low <= "k35" <= r.high for r in files) >= 3
    assert spark.read.parquet(path).exceptAll(table).count() == 0


def test_serving_tables_from_files_or_folders(spark, tmp_path, caplog):
    t = Tables(spark, FOLDER)
    writers.export_serving({"divesite_summary": t.site_summary}, str(tmp_path))
    t.summary.write.parquet(str(tmp_path / "species_divesite_summary.parquet"))
    opened = readers.open_serving(spark, str(tmp_path))
    assert set(opened) == {"divesite_summary", "species_divesite_summary"}
    assert "divesite_species_detail" in caplog.text
    assert spark.table("divesite_summary").count() == t.site_summary.count()
    for table in opened.values():
        table.unpersist()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    Tables(spark, FOLDER).gbif_raw.write.parquet(path)
    from tidewatch.plans import staging

    text = plan(staging.stage_gbif(spark.read.parquet(path)).select("species", "eventdate"))
    for column in ("eventdate", "decimallongitude", "decimallatitude", "species"):
        assert f"IsNotNull({column})" in text
    assert "individualcount" not in text.split("ReadSchema")[-1]
