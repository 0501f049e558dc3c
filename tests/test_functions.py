import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import rows
from tidewatch.functions import casts, geo, sampling, text, urls


def one_column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"v {kind}")


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_timestamps_are_read_as_utc_in_any_session_zone(spark, zone):
    cases = {
        "2024-03-05": "2024-03-05 00:00:00",
        "2024-3-5": "2024-03-05 00:00:00",
        "2024-03-05T10:00:00": "2024-03-05 10:00:00",
        "2024-03-05 10:00:00.25": "2024-03-05 10:00:00.25",
        "2024-03-05T10:00:00Z": "2024-03-05 10:00:00",
        "2024-03-05T10:00:00+02:00": "2024-03-05 08:00:00",
        "2024-03-05T23:30:00-05:30": "2024-03-06 05:00:00",
        "2024-03-05 10:00:00+02": "2024-03-05 08:00:00", "2024-03-05 10:00:00-5:30": "2024-03-05 15:30:00",
        "2024-03-05t10:00:00z": "2024-03-05 10:00:00", "2024-03-05 10:00:00 UTC": "2024-03-05 10:00:00",
        "2024-07-05 10:00:00 America/New_York": "2024-07-05 14:00:00", "2024-03-05 10:00:00 No/Where": None,
        "2024-03-05+3": "2024-03-04 21:00:00", "2024-03-05Z": "2024-03-05 00:00:00",
        "2024-03-05 10:00:00 -08:00": "2024-03-05 18:00:00", "2024-11-03 01:30:00-05:00": "2024-11-03 06:30:00",
        "2024-02-30": None, "2024": None, "2024-05": None, "": None, "unknown": None, None: None,
        "2024-03-05/2024-03-07": None, "2024-03-05T25:00:00": None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        read = one_column(spark, list(cases)).select(
            "v", casts.safe_timestamp(F.col("v")).cast("string")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert {r[0]: r[1] for r in read} == cases


def test_typed_times_become_utc(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        table = spark.sql("SELECT TIMESTAMP_LTZ'2024-07-01 20:00:00' AS a, TIMESTAMP_NTZ'2024-07-01 20:00:00' AS b")
        read = table.select(*(casts.as_utc_ntz(F.col(f.name), f.dataType.typeName()).cast("string")
                              for f in table.schema.fields)).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert tuple(read) == ("2024-07-02 00:00:00", "2024-07-01 20:00:00")


def test_counts(spark):
    cases = {"5": 5, " 7 ": 7, "+3": 3, "-4": 1, "0": 1, "3.0": 1, "1e2": 1, "many": 1, "": 1, None: 1,
             "99999999999999999999": 1}
    read = one_column(spark, list(cases)).select("v", casts.count_at_least_one(casts.safe_long(F.col("v")))).collect()
    assert {r[0]: r[1] for r in read} == cases


def test_longitudes_wrap(spark):
    cases = {0.0: 0.0, 180.0: 180.0, -180.0: -180.0, 181.0: -179.0, -190.0: 170.0, 540.0: -180.0, 725.0: 5.0}
    read = one_column(spark, list(cases), "double").select("v", geo.wrap_longitude(F.col("v"))).collect()
    assert {r[0]: r[1] for r in read} == cases


def test_bad_latitude_fails_or_becomes_null(spark):
    table = one_column(spark, [90.0, -90.0, None, 90.5], "double")
    with pytest.raises(PySparkException, match="latitude out of range"):
        table.select(geo.checked_latitude(F.col("v"))).collect()
    kept = table.select(geo.checked_latitude(F.col("v"), "null")).collect()
    assert [r[0] for r in kept] == [90.0, -90.0, None, None]
    with pytest.raises(ValueError):
        geo.checked_latitude(F.col("v"), "ignore")


def test_thumbnail_url(spark):
    root = "https://upload.wikimedia.org/wikipedia/commons/thumb/"
    # Expected values worked out by hand from the MD5 of the decoded name.
    import hashlib

    names = {
        "Queen%20Angelfish.jpg": ("Queen_Angelfish.jpg", "Queen_Angelfish.jpg"),
        "a+b.png": ("a+b.png", "a%2Bb.png"),
        "Red%20Fish%20(5)%2B~*.jpg": ("Red_Fish_(5)+~*.jpg", "Red_Fish_%285%29%2B~%2A.jpg"),
        "%C3%A9t%C3%A9.svg": ("été.svg", "%C3%A9t%C3%A9.svg"),
        "a%2Fb.jpg": ("a/b.jpg", "a/b.jpg"),
    }
    for coded, (plain, again) in names.items():
        digest = hashlib.md5(plain.encode()).hexdigest()
        url = one_column(spark, [f"http://host/Special:FilePath/{coded}"]).select(
            urls.thumbnail_url(F.col("v"), 320)).first()[0]
        assert url == f"{root}{digest[0]}/{digest[:2]}/{again}/320px-{again}"


def test_image_urls(spark):
    cases = {
        "https://a.example/x.jpg": True, " HTTP://A.example/x.PNG ": True, "ftp://a.example/x.svg": True,
        "http://10.0.0.1/x.gif": True, "https://a.example:8080/d/x.jpeg": True, "https://a.example/x.webp": False,
        "https://a.example/xjpg": False, "x.jpg": False, "https://x.jpg y.jpg": False, "": False, "  ": False,
        None: False,
    }
    read = one_column(spark, list(cases)).select("v", text.is_image_url(F.col("v"))).collect()
    assert {r[0]: r[1] for r in read} == cases


def test_substring_search(spark):
    table = one_column(spark, ["Blue Whale", "50% off", "a_b", "axb", "c\\d", None])

    def found(q, **options):
        return rows(table.where(text.contains_ignoring_case(F.col("v"), q, **options)))

    assert found("whale") == [("Blue Whale",)]
    assert found("A_B") == [("a_b",), ("axb",)]
    assert found("A_B", escape=True) == [("a_b",)]
    assert found("0%F") == [("50% off",)]
    assert found("0%F", escape=True) == []
    assert found("C\\D") == found("C\\D", escape=True) == [("c\\d",)]


def test_token_search(spark):
    table = one_column(spark, ["Great White Shark", "white-tip shark", "Sharkey", "Éclair white", None])

    def found(q):
        return rows(table.where(text.has_all_tokens(F.col("v"), q)))

    assert found("SHARK white") == [("Great White Shark",), ("white-tip shark",)]
    assert found("éclair") == [("Éclair white",)]
    assert found("sharke") == []


def test_blank_and_title(spark):
    table = spark.createDataFrame([("s", ""), ("s", None), ("s", "n")], "species string, common_name string")
    titles = table.select(text.display_title(F.col("common_name"), F.col("species"))).collect()
    assert [r[0] for r in titles] == ["s", "s", "n"]


def test_hash_sample_keeps_whole_keys(spark):
    table = spark.range(10_000).selectExpr("CONCAT('k', id % 1000) AS k", "id")
    kept = sampling.hash_sample(table, "k", 10)
    per_key = kept.groupBy("k").count().collect()
    assert {r["count"] for r in per_key} == {10}
    assert 50 < len(per_key) < 160


def test_scan_sample_is_a_share_and_repeats(spark):
    table = spark.range(20_000)
    first = sampling.sample_scan(table, 5.0, seed=1)
    assert 800 < first.count() < 1200
    assert rows(first) == rows(sampling.sample_scan(table, 5.0, seed=1))
