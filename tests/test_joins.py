import pytest
from pyspark.sql import functions as F

from tests.conftest import plan, rows
from tidewatch.operators import joins, ranking, taxa


@pytest.fixture
def hot(spark):
    """A third of the rows have one key, half of those are copies of one row; some keys are NULL or unmatched."""
    return spark.range(900, numPartitions=6).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id < 320 THEN NULL ELSE CONCAT('k', id % 50) END AS k",
        "CASE WHEN id % 6 = 0 THEN -1 ELSE id END AS v")


@pytest.fixture
def names(spark):
    return spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), (None, 5)], "k string, w int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, hot, names, how, shuffle_only):
    expected = hot.join(names, "k", how)
    got = joins.lookup_join(hot, names, "k", how)
    assert "_salt" in plan(got)
    assert got.columns == expected.columns
    assert rows(got) == rows(expected)


def test_small_side_is_broadcast_after_counting(spark, hot, names):
    got = joins.lookup_join(hot, names, ["k"], "inner")
    assert "BroadcastHashJoin" in plan(got) and "_salt" not in plan(got)
    assert rows(got) == rows(hot.join(names, "k"))


@pytest.mark.parametrize("hot_keys", [True, False])
def test_a_side_that_counting_found_large_is_not_broadcast(spark, hot, names, tmp_path, shuffle_only, hot_keys):
    """Spark's own estimate is the size of the file, whatever is unpacked from its rows."""
    names.write.parquet(str(tmp_path / "names"))
    unpacked = spark.read.parquet(str(tmp_path / "names")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50))))
    got = joins.lookup_join(hot, unpacked, "k", hot_keys=hot_keys)
    assert "SortMergeJoin" in plan(got) and "BroadcastHashJoin" not in plan(got)
    assert rows(got) == rows(hot.join(unpacked, "k"))
    got.collect()
    assert "BroadcastHashJoin" not in plan(got)


def test_full_outer_is_not_a_lookup(hot, names):
    with pytest.raises(ValueError):
        joins.lookup_join(hot, names, "k", "full_outer")


def test_size_is_counted_in_rows_and_bytes(spark):
    table = spark.createDataFrame([("abc", 1), (None, 2)], "k string, v bigint")
    size = joins.measure(table)
    assert (size.rows, size.bytes) == (2, 3 + 2 * 8)
    assert size.can_broadcast
    assert not joins.Size(10, joins.BROADCAST_MAX_BYTES + 1).can_broadcast
    assert not joins.Size(joins.BROADCAST_MAX_ROWS + 1, 10).can_broadcast


def test_salts_spread_copies_and_repeat_on_a_second_run(hot):
    copies = joins.with_row_salt(hot.where("k = 'hot' AND v = -1"))
    assert copies.select("_salt").distinct().count() > 1
    again = joins.with_row_salt(hot.sortWithinPartitions(F.desc("v")))
    assert rows(joins.with_row_salt(hot)) == rows(again)


def test_taxonomy_repeats_rows_or_not(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2), ("A", 3)], "species string, n int")
    taxonomy = spark.createDataFrame([("a",), ("a",), ("c",)], "scientificName string")
    assert rows(taxa.validate_taxa(records, taxonomy)) == [("a", 1), ("a", 1)]
    assert rows(taxa.validate_taxa(records, taxonomy, "semi")) == [("a", 1)]
    with pytest.raises(ValueError):
        taxa.validate_taxa(records, taxonomy, "outer")


def test_endangered_wins_over_invasive(spark):
    species = spark.createDataFrame([("a",), ("b",), ("c",)], "species string")
    red = spark.createDataFrame([("a",), ("a",)], "scientificName string")
    invasive = spark.createDataFrame([("a",), ("b",)], "scientificName string")
    assert rows(taxa.classify_species(species, red, invasive)) == [
        ("a", True, True, "endangered"), ("b", False, True, "invasive"), ("c", False, False, "normal")]


def test_rank_equals_the_window_function(spark):
    counts = spark.range(3000).selectExpr("CASE WHEN id < 1000 THEN 'hot' ELSE CONCAT('s', id % 40) END AS site",
                                          "id AS species", "(id * 7919) % 13 + 1 AS n")
    got = ranking.rank_by_count(counts, "site", "n", "r")
    counts.createOrReplaceTempView("counts_for_rank")
    expected = spark.sql(
        "SELECT *, CAST(RANK() OVER (PARTITION BY site ORDER BY n DESC) AS BIGINT) AS r FROM counts_for_rank")
    assert rows(got) == rows(expected)


def test_top_per_group_limits_before_the_shuffle(spark):
    table = spark.range(1000, numPartitions=4).selectExpr("id % 2 AS g", "id AS v")
    top = ranking.top_per_group(table, "g", 3, [F.col("v")])
    assert rows(top) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]
    assert "WindowGroupLimit" in plan(top) and "Partial" in plan(top)


def test_share_of_group_max(spark):
    table = spark.createDataFrame([("a", 4), ("a", 1), ("b", 3)], "g string, v bigint")
    assert rows(ranking.share_of_group_max(table, "g", "v", "s")) == [("a", 1, 0.25), ("a", 4, 1.0), ("b", 3, 1.0)]


@pytest.mark.parametrize("limit", [0, 101, -1])
def test_limits_are_checked(limit):
    with pytest.raises(ValueError):
        ranking.bounded(limit, 100)
