"""How tables are stored: versions, buckets, months, postings, samples of files, and what reading leaves out."""

import random
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.inputs import Tables
from checks.registry import QUERIES
from checks.stored import nested_observations, put_file
from tests.conftest import FOLDER, plan, rows
from tidewatch.functions.sampling import sample_files
from tidewatch.plans import build, enrichment, models, quality, restate, search, serving
from tidewatch.sources import buckets, readers, schemas, versions, writers


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The model tables of the smallest data, each stored once."""
    t, folder, stored = Tables(spark, FOLDER), tmp_path_factory.mktemp("tables"), {}
    for name in ("valid_records", "sites", "species", "species_enrichment", "near", "frequency", "summary"):
        again = Tables(spark, FOLDER, stored)
        getattr(again, name).write.parquet(f"{folder}/{name}")
        stored[name] = spark.read.parquet(f"{folder}/{name}")
    assert t.folder == FOLDER
    return Tables(spark, FOLDER, stored)


def files_below(folder):
    return {p.name for p in Path(folder).rglob("*.parquet")}


def files_read(df):
    """Files that the scans of an executed query opened."""
    df.collect()
    executed, total = df._jdf.queryExecution().executedPlan(), 0
    leaves = executed.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if "QueryStage" in leaf.getClass().getSimpleName():
            leaf = leaf.plan()
            while leaf.children().size():
                leaf = leaf.children().apply(0)
        metric = leaf.metrics().get("numFiles")
        total += metric.get().value() if metric.isDefined() else 0
    return total


# --- versions ----------------------------------------------------------------------------------------------


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "t")
    with pytest.raises(ValueError, match="no version"):
        versions.read_current(spark, folder)
    versions.replace_table(spark.range(5), folder)
    broken = spark.range(10).withColumn("id", F.when(F.col("id") > 7, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        versions.replace_table(broken, folder)
    assert versions.current_parts(spark, folder)[0] == 1 and versions.read_current(spark, folder).count() == 5
    # A version may be made from the one it replaces, which a reader that opened it before goes on reading.
    old = versions.read_current(spark, folder)
    assert versions.replace_table(old.where("id > 1"), folder).count() == 3
    assert old.count() == 5 and versions.read_current(spark, folder).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        versions.commit(spark, folder, 2, {"all": f"{folder}/data/other"})


def test_old_versions_are_forgotten(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versions.forget_versions(spark, folder) == []
    for n in range(4):
        versions.replace_table(spark.range(n + 1), folder)
    assert len(versions.forget_versions(spark, folder, keep=2)) == 4
    assert versions.read_current(spark, folder).count() == 4
    assert len(list((tmp_path / "t" / "data").iterdir())) == 2
    assert versions.replace_table(spark.range(9), folder).count() == 9


def test_a_build_replaces_its_tables_by_versions(spark, tmp_path):
    t = Tables(spark, FOLDER)
    inputs = {"gbif": t.gbif_raw, "obis": t.obis_raw, "worms": t.worms, "redlist": t.redlist, "invasive": t.invasive,
              "divesites": t.divesites_raw, "species_enrichment": t.species_enrichment}
    observed = {}
    first = build.build_tables(spark, inputs, str(tmp_path), observed=observed)
    before = rows(first["divesite_summary"])
    with pytest.raises(Exception, match="nothing"):
        build.build_tables(spark, inputs | {"redlist": t.redlist.withColumn("scientificName", F.raise_error(F.lit("nothing")))},
                           str(tmp_path))
    assert rows(versions.read_current(spark, f"{tmp_path}/divesite_summary")) == before
    assert rows(first["divesite_summary"]) == before
    # Rules counted while writing are those counted by reading again.
    whole = {r.rule: r.violations for r in quality.run_checks(first | {"worms": t.worms}).collect()}
    assert observed == {rule: whole[rule] for rule in observed} and len(observed) > 60


def test_an_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    folder = str(tmp_path / "e")
    names = [f"s{i}" for i in range(200)]

    def staged(found, field):
        return spark.createDataFrame([(n, field, None, None) for n in found], schemas.ENRICHMENT)

    assert enrichment.upsert_buckets(spark, folder, staged(names, "one"), buckets=16) == 1
    _, old = versions.current_parts(spark, folder)
    before = files_below(folder)
    assert enrichment.upsert_buckets(spark, folder, staged(["s3", "new"], "two"), buckets=16) == 2
    _, now = versions.current_parts(spark, folder)
    moved = {b for b in now if now[b] != old.get(b)}
    assert 1 <= len(moved) <= 2 and before <= files_below(folder)
    assert len(files_below(folder) - before) == len(moved)
    found = {r.species: r.common_name for r in enrichment.read_buckets(spark, folder).collect()}
    assert found == dict.fromkeys(names, "one") | {"s3": "two", "new": "two"}
    assert enrichment.upsert_buckets(spark, folder, staged([], "x"), buckets=16) == 2
    with pytest.raises(ValueError, match="more than one"):
        enrichment.upsert_buckets(spark, folder, staged(["s3", "s3"], "x"), buckets=16)
    assert versions.current_parts(spark, folder)[0] == 2


def test_unit_files_grow_with_the_rows():
    assert enrichment.unit_files(1_000, 10) == enrichment.UNIT_FILES
    assert enrichment.unit_files(64 * 10 * enrichment.FILE_ROWS, 64) == 10


# --- buckets -----------------------------------------------------------------------------------------------


def test_bucketed_tables_join_without_an_exchange(spark, tables, tmp_path):
    frequency, species, known = tables.frequency, tables.species, tables.species_enrichment
    expected = rows(models.divesite_species_detail(frequency, species, tables.sites, known))
    for n in (3, 8):
        split = [buckets.write_bucketed(df, f"{tmp_path}/{n}/{name}", "species", n)
                 for name, df in (("f", frequency), ("s", species), ("e", known))]
        joined = buckets.merge_join(buckets.merge_join(split[0], split[1], "species"), split[2], "species", "left")
        text = plan(joined)
        assert "Exchange" not in text and text.count("SortMergeJoin") == 2
        assert rows(models.detail_from_buckets(*split, tables.sites)) == expected
        again = buckets.open_bucketed(spark, f"{tmp_path}/{n}/s", species._jdf.schema().toDDL(), "species", n)
        assert "Exchange" not in plan(buckets.merge_join(split[0], again, "species")) and rows(again) == rows(species)


# --- months ------------------------------------------------------------------------------------------------


def test_months_follow_from_a_range_of_dates(spark, tmp_path):
    path = str(tmp_path / "t")
    days = spark.sql("""SELECT TIMESTAMP_NTZ'2020-01-01 06:00:00' + make_interval(0, 0, 0, CAST(id AS INT)) AS event_date, id,
      0.0D AS lon, 0.0D AS lat FROM range(400)""")
    writers.write_table(days, path, partition_month="event_date")
    every = [(r.event_date, r.id) for r in days.collect()]
    for since, until in ((datetime(2020, 2, 10), datetime(2020, 4, 1)), (datetime(2020, 3, 31, 7), None), (None, datetime(2020, 2, 1)),
                         (datetime(2020, 5, 5, 6), datetime(2020, 5, 5, 6, 0, 1)), (None, None), (datetime(2021, 9, 1), None)):
        found = writers.read_event_dates(spark, path, since, until)
        assert sorted(r.id for r in found.collect()) == [
            i for d, i in every if (since is None or d >= since) and (until is None or d < until)]
        if since or until:
            assert "PartitionFilters: []" not in plan(found) and "event_month" in plan(found).split("PartitionFilters")[1]
    one = writers.read_event_dates(spark, path, datetime(2020, 3, 2), datetime(2020, 3, 9))
    assert files_read(one) < files_read(spark.read.parquet(path)) / 5


def test_restated_months_equal_a_whole_recount(spark, tables, tmp_path):
    occurrences, counts = f"{tmp_path}/occurrences", f"{tmp_path}/counts"
    writers.write_table(tables.valid_records, occurrences, partition_month="event_date")
    restate.restate_months(spark, occurrences, tables.sites, counts)
    assert rows(restate.frequency_from_counts(restate.read_counts(spark, counts))) == rows(tables.frequency)
    untouched = {p: p.stat().st_mtime_ns for p in Path(counts).rglob("*.parquet") if "1995-" not in str(p)}
    gone, less = date(1995, 3, 1), date(1995, 8, 1)
    all_rows = spark.read.parquet(occurrences)
    rest = all_rows.where((F.col("event_month") != gone) & ((F.col("event_month") != less) | (F.col("individual_count") > 20)))
    changed = f"{tmp_path}/changed"
    writers.write_table(rest.drop("event_month"), changed, partition_month="event_date")
    restate.restate_months(spark, changed, tables.sites, counts, [gone, less])
    near = models.near_dive_site_occurrences(spark.read.parquet(changed).drop("event_month"), tables.sites)
    assert rows(restate.frequency_from_counts(restate.read_counts(spark, counts))) == rows(models.divesite_species_frequency(near))
    assert untouched.items() <= {p: p.stat().st_mtime_ns for p in Path(counts).rglob("*.parquet")}.items()


def test_the_closest_pair_of_a_timestamp_never_leaves_its_month(spark, tables):
    """The months recounted one by one give the pairs of the whole table."""
    records = tables.valid_records.withColumn("m", F.date_trunc("month", "event_date"))
    whole = rows(models.near_dive_site_occurrences(records.drop("m"), tables.sites))
    months = [r.m for r in records.select("m").distinct().collect()][:6]
    for month in months:
        part = models.near_dive_site_occurrences(records.where(F.col("m") == month).drop("m"), tables.sites)
        at = part.columns.index("event_date")
        assert rows(part) == [r for r in whole if r[at].replace(day=1, hour=0, minute=0, second=0, microsecond=0) == month]


@pytest.mark.parametrize("name", ["k3_restated_site_summary", "j5_detail_from_buckets"])
def test_records_are_made_once(spark, monkeypatch, name):
    """The species and the frequencies both start from records that are stored, and those are not stored again."""
    gbif = spark.sql("""SELECT * FROM VALUES ('a', 1L, TIMESTAMP_NTZ'1996-03-05 00:00:00', 10.0D, 0.0D),
        ('b', 20L, TIMESTAMP_NTZ'1996-03-06 00:00:00', 10.0D, 0.0D), ('a', 3L, TIMESTAMP_NTZ'1995-06-01 00:00:00', 10.0D, 0.0D),
        ('a', 3L, TIMESTAMP_NTZ'2001-01-01 00:00:00', 10.0D, 0.0D), ('c', 3L, TIMESTAMP_NTZ'2001-01-02 00:00:00', 10.0D, 0.0D)
        v(species, individualcount, eventdate, lon, lat)""")
    names = spark.createDataFrame([("a",), ("b",)], "scientificName string")
    t = Tables(spark, FOLDER, {
        "gbif": gbif, "obis": gbif.limit(0), "worms": names, "redlist": names.limit(1), "invasive": names.limit(0),
        "sites": spark.createDataFrame([("S", 10.0, 0.0)], "title string, lon double, lat double"),
        "species_enrichment": spark.createDataFrame([("a", "A", "", None)], schemas.ENRICHMENT)})
    used, paths = [], []
    for function in ("species", "near_dive_site_occurrences"):
        monkeypatch.setattr(models, function, lambda df, *args, f=getattr(models, function), **named: (
            used.append(df.inputFiles()), f(df, *args, **named))[1])
    new_path = writers.new_table_path
    monkeypatch.setattr(writers, "new_table_path", lambda *args: (paths.append(args[1]), new_path(*args))[1])
    found = rows(QUERIES[name].run(t))
    assert used and all(used) and all(files == used[0] for files in used)
    assert "unordered" not in paths
    if name == "k3_restated_site_summary":
        assert found == [("S", 0.0, 10.0, 2, 2, 1, 0)]
    else:
        assert sorted((r[0], r[4], r[11], r[12]) for r in found) == [(4, "a", 3, 1), (4, "b", 1, 2), (16, "a", 3, 1), (16, "b", 1, 2)]


def test_stored_rows_are_clustered_without_a_copy(spark, tmp_path, monkeypatch):
    spark.sql("""SELECT TIMESTAMP_NTZ'2020-01-01 06:00:00' + make_interval(0, 0, 0, CAST(id % 90 AS INT)) AS event_date,
      CAST(id % 300 - 150 AS DOUBLE) AS lon, CAST(id % 7 AS DOUBLE) AS lat, id FROM range(2000)""").write.parquet(f"{tmp_path}/in")
    given, made = spark.read.parquet(f"{tmp_path}/in"), []
    monkeypatch.setattr(writers, "new_table_path", lambda *args: made.append(args) or f"{tmp_path}/between")
    layout = {"partition_month": "event_date", "cluster_by": ["geography"], "partitions": 6}
    writers.write_table(given, f"{tmp_path}/stored", **layout, stored=True)
    assert not made
    writers.write_table(given, f"{tmp_path}/copied", **layout)
    stored, copied = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("stored", "copied"))
    assert len(made) == 1 and rows(stored) == rows(copied) and rows(stored.drop("event_month")) == rows(given)
    held = [{(r.m, r.low, r.high, r.n) for r in df.groupBy(F.input_file_name(), F.col("event_month").alias("m")).agg(
        F.min("lon").alias("low"), F.max("lon").alias("high"), F.count(F.lit(1)).alias("n")).collect()} for df in (stored, copied)]
    assert held[0] == held[1]


# --- reading -----------------------------------------------------------------------------------------------


def test_skipped_files_are_named(spark, tmp_path):
    path = str(tmp_path / "in")
    nested_observations(Tables(spark, FOLDER)).repartition(3).write.parquet(f"{path}/whole")
    assert readers.skipped_files(spark, path).count() == 0
    spark.createDataFrame([], schemas.OBSERVATION_FILE).write.parquet(f"{path}/empty")
    put_file(spark, f"{path}/cut.parquet", b"PAR1" + b"x" * 30)
    put_file(spark, f"{path}/notes.txt", b"not looked at")
    # A file whose pages are damaged behind a good footer.
    whole = next((tmp_path / "in" / "whole").glob("*.parquet"))
    data = bytearray(whole.read_bytes())
    data[40:len(data) // 2] = bytes(len(data) // 2 - 40)
    put_file(spark, f"{path}/damaged.parquet", bytes(data))
    found = {r.path.split("/")[-1]: r for r in readers.skipped_files(spark, path).collect()}
    assert set(found) == {"cut.parquet", "damaged.parquet"}
    assert found["cut.parquet"].reason == "no footer at the end" and found["cut.parquet"].rows_lost is None
    assert found["damaged.parquet"].rows_lost > 0 and "damaged" in found["damaged.parquet"].reason


def test_broken_lines_are_apart(spark, tmp_path):
    core = tmp_path / "core.txt"
    core.write_text("taxon\tname\tremark\n1\tA\tx\n2\tB\n3\tC\ty\tz\nfour\tD\tw\n\n5\t\t\n", encoding="utf-8")
    whole, rejects = readers.read_checklist_with_rejects(spark, str(core), "taxon bigint, name string, remark string")
    assert rows(whole) == [(1, "A", "x"), (5, None, None)]
    assert sorted(r.line for r in rejects.collect()) == ["2\tB", "3\tC\ty\tz", "four\tD\tw"]
    assert {r.file.split("/")[-1] for r in rejects.collect()} == {"core.txt"}
    with pytest.raises(ValueError, match="3 of 5"):
        readers.read_checklist_with_rejects(spark, str(core), "taxon bigint, name string, remark string", most_rejected=0.5)


def test_sites_keep_fields_that_no_schema_names(spark):
    guide = spark.createDataFrame([(
        '{"results":[{"id":1,"title":"A","images":["x"],"rating":4.5,"tags":["a",{"b":1}],"none":null},{"id":2,"title":"B","depth":9}]}',),
        (None,), ('{"results":[]}',)], "body string")
    cells = spark.createDataFrame([(
        '[{"id":1,"latitude":1,"longitude":2.5,"rating":3,"country":"X"},{"id":1,"latitude":1,"longitude":2.5,"country":"Y"},'
        '{"id":2,"latitude":null,"longitude":1},{"id":3,"latitude":1,"longitude":1}]',)], "body string")
    found = [(r.id, r.title, r.latitude, r.longitude, r.fields) for r in readers.build_sites_with_fields(guide, cells).collect()]
    common = {"rating": "4.5", "tags": '["a",{"b":1}]'}
    assert sorted(found, key=repr) == [(1, "A", 1.0, 2.5, common | {"country": c}) for c in "XY"]
    once = readers.build_sites_with_fields(guide, cells, dedup=True).collect()
    assert [(r.id, r.fields["country"]) for r in once] == [(1, "X")]
    plain = readers.build_sites(guide, cells)
    assert rows(readers.build_sites_with_fields(guide, cells).drop("fields")) == rows(plain)


def test_a_sample_of_files_opens_no_others(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(60_000).repartition(120).write.parquet(path)
    scan = spark.read.parquet(path)
    sample = sample_files(scan, 25.0, seed=3)
    opened = files_read(sample)
    assert 12 <= opened <= 50 and abs(sample.count() - 500 * opened) < 60 * opened
    assert rows(sample_files(scan, 25.0, seed=3)) == rows(sample)
    assert sample_files(scan, 100.0, seed=3).count() == 60_000 and sample_files(scan, 0.0, seed=3).count() == 0


# --- rules and searches ------------------------------------------------------------------------------------


def test_rules_are_counted_in_the_scan_that_writes(spark, tables, tmp_path):
    watched, counts = quality.observed(tables.species, "species")
    text = plan(watched)
    assert text.count("FileScan") == 1 and "CollectMetrics" in text
    writers.write_table(watched, str(tmp_path / "t"))
    assert set(counts()) == set(quality.row_rules()["species"]) and not any(counts().values())
    other, none = quality.observed(tables.species, "no such table")
    assert other is tables.species and none() == {}


def test_searches_from_postings_equal_the_scan(spark, tables, tmp_path):
    odd = spark.createDataFrame([
        ("Ünïcode ŞİSTE", "ΟΔΟΣ 50%_x\\y", None), ("ab", None, None), ("aaa aaa", "", None), ("x", "Aa%b_c", None)],
        "species string, common_name string, image_url string").select(
        "*", F.lit(False).alias("is_endangered"), F.lit(False).alias("is_invasive"), F.lit("normal").alias("species_type"))
    table = tables.summary.unionByName(odd, allowMissingColumns=True).cache()
    stored = search.write_postings(table, str(tmp_path / "p"), files=24)
    pick, low = random.Random(9), [r.species for r in tables.species.collect()]
    texts = ["", "%", "_", "ab", "%%a%%", "ŞİS", "ΟΔΟΣ", "οδος", "50%", "_x\\y", "aaaa", "AA A", "ringbr"]
    for _ in range(12):
        word = pick.choice(low)
        at = pick.randrange(len(word))
        text = list(word[at:at + pick.randint(2, 12)].swapcase())
        if pick.random() < 0.5:
            text[pick.randrange(len(text))] = pick.choice("%_")
        texts.append("".join(text))
    for q in texts:
        for escape in (False, True):
            expected = rows(serving.matching_species(table, q, escape=escape))
            assert rows(search.matching_species(table, stored, q, escape=escape)) == expected, (q, escape)
    few = search._having(stored, "piece0", search.search_pieces(table, "large plate"))
    assert "In(key" in plan(few).split("PushedFilters")[1]


def test_a_search_reads_the_postings_of_its_keys(spark, tables, tmp_path):
    path = str(tmp_path / "p")
    stored = search.write_postings(tables.summary, path, files=24)
    held = stored.groupBy(F.input_file_name().alias("f")).agg(
        F.min(F.struct("kind", "key")).alias("low"), F.max(F.struct("kind", "key")).alias("high")).collect()
    key = ("piece0", "ing")
    assert len(held) >= 12 and sum(tuple(r.low) <= key <= tuple(r.high) for r in held) <= 2
    assert "PushedFilters: [" in plan(stored.where("kind = 'piece0' AND key = 'ing'"))
