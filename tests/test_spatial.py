import numpy as np
import pytest

from tests.conftest import plan, rows
from tidewatch.operators import spatial
from tidewatch.plans import models

EARTH = 6_371_010.0


def brute_force(points, sites, radius):
    lon1, lat1 = np.radians(points[:, None, 0]), np.radians(points[:, None, 1])
    lon2, lat2 = np.radians(sites[None, :, 0]), np.radians(sites[None, :, 1])
    chord = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
    distance = 2 * EARTH * np.arcsin(np.minimum(1.0, np.sqrt(chord)))
    return {(int(i), int(j)) for i, j in zip(*np.nonzero(distance <= radius), strict=True)}


def scattered(seed, n, spread):
    """Points near the poles, the date line, the equator and everywhere, on exact edges too."""
    rng = np.random.default_rng(seed)
    centres = np.array([(0, 90), (0, -90), (180, 0), (-180, 60), (10, 0), (179.99, -89.9), (-30, 89.95), (45, 45)])
    near = centres[rng.integers(0, len(centres), n)] + rng.normal(0, spread, (n, 2))
    anywhere = np.column_stack([rng.uniform(-180, 180, n // 4), np.degrees(np.arcsin(rng.uniform(-1, 1, n // 4)))])
    points = np.vstack([near, anywhere, centres])
    points[:, 1] = np.clip(points[:, 1], -90, 90)
    points[:, 0] = (points[:, 0] + 180) % 360 - 180
    return points


def frames(spark, points, sites):
    occurrences = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)],
                                        "id int, lon double, lat double")
    places = spark.createDataFrame([(str(j), float(x), float(y)) for j, (x, y) in enumerate(sites)],
                                   "title string, lon double, lat double")
    return occurrences, places


@pytest.mark.parametrize("radius, spread", [
    (50.0, 0.0005), (3000.0, 0.03), (120_000.0, 1.0), (3_000_000.0, 20.0), (21_000_000.0, 50.0)])
def test_pairs_equal_brute_force(spark, radius, spread):
    points, sites = scattered(1, 500, spread), scattered(2, 120, spread)
    occurrences, places = frames(spark, points, sites)
    found = [(r.id, int(r.dive_site)) for r in
             spatial.within_distance(occurrences, places, radius).select("id", "dive_site").collect()]
    assert len(found) == len(set(found))
    assert set(found) == brute_force(points, sites, radius)
    assert len(found) > 10


def test_shuffled_pairs_equal_broadcast_pairs(spark, shuffle_only):
    points, sites = scattered(3, 400, 0.03), scattered(4, 100, 0.03)
    occurrences, places = frames(spark, points, sites)
    found = spatial.within_distance(occurrences, places).select("id", "dive_site")
    assert {(r.id, int(r.dive_site)) for r in found.collect()} == brute_force(points, sites, 3000.0)


def test_a_cell_with_a_third_of_all_rows_is_spread(spark, shuffle_only):
    copies = spark.range(30_000, numPartitions=6).selectExpr("0 AS id", "10.0D AS lon", "20.0D AS lat")
    others = spark.range(60_000).selectExpr("1 AS id", "id / 1000.0D AS lon", "0.0D AS lat")
    places = spark.createDataFrame([("a", 10.0, 20.0), ("b", 10.001, 20.0)], "title string, lon double, lat double")
    found = spatial.within_distance(copies.unionByName(others), places)
    assert found.count() == 60_000
    assert "_salt" in plan(found)


def test_many_cells_of_a_small_file_stay_off_the_driver(spark, tmp_path, shuffle_only):
    """A site is several cells and each has its salts; the file they are unpacked from says nothing about that."""
    points, sites = scattered(5, 200, 0.03), scattered(6, 60, 0.03)
    occurrences, places = frames(spark, points, sites)
    places.write.parquet(str(tmp_path / "sites"))
    found = spatial.within_distance(occurrences, spark.read.parquet(str(tmp_path / "sites"))).select("id", "dive_site")
    # The tiles, bounded by the sphere, are the one broadcast side.
    assert "SortMergeJoin" in plan(found) and plan(found).count("BroadcastExchange") == 1
    assert {(r.id, int(r.dive_site)) for r in found.collect()} == brute_force(points, sites, 3000.0)


def nearest_by_hand(points, sites, radius):
    best = {}
    for i, j in brute_force(points, sites, radius):
        lon1, lat1, lon2, lat2 = map(np.radians, (*points[i], *sites[j]))
        chord = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2
        distance = 2 * EARTH * np.arcsin(min(1.0, np.sqrt(chord)))
        best[i] = min(best.get(i, (9e9, -1)), (distance, j))
    return {i: j for i, (_, j) in best.items()}


def test_nearest_site(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points, sites = rng.uniform(-0.1, 0.1, (400, 2)), rng.uniform(-0.1, 0.1, (60, 2))
    occurrences, places = frames(spark, points, sites)
    expected = nearest_by_hand(points, sites, 3000.0)
    small = {r.id: int(r.dive_site) for r in spatial.nearest_site(occurrences, places).collect()}
    assert small == expected
    from tidewatch.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", -1)
    large = {r.id: int(r.dive_site) for r in spatial.nearest_site(occurrences, places).collect()}
    assert large == expected


@pytest.mark.parametrize("small", [True, False])
def test_crowded_cells_are_searched_at_smaller_radii_first(spark, monkeypatch, small):
    """A third of all sites in one cell, many of them at one spot: same answer, and no wide cell is walked."""
    rng = np.random.default_rng(6)
    crowd = rng.normal(0, 0.002, (60, 2))
    sites = np.vstack([crowd, np.repeat(crowd[:1], 30, axis=0), rng.uniform(-1, 1, (120, 2))])
    points = np.vstack([rng.normal(0, 0.01, (200, 2)), rng.uniform(-1, 1, (200, 2))])
    occurrences, places = frames(spark, points, sites)
    places = places.selectExpr("LPAD(title, 4, '0') AS title", "lon", "lat")
    monkeypatch.setattr(spatial, "CROWDED", 8)
    radii, _ = spatial.search_radii(spatial.one_title_per_spot(places), 3000.0)
    assert len(radii) > 1 and radii == sorted(radii) and radii[-1] == 3000.0
    if not small:
        from tidewatch.operators import joins

        monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", -1)
    got = {r.id: int(r.dive_site) for r in spatial.nearest_site(occurrences, places).collect()}
    assert got == nearest_by_hand(points, sites, 3000.0)


def test_repeated_occurrences_stay_repeated(spark, monkeypatch):
    occurrences = spark.createDataFrame([(1, 0.0, 0.0)] * 5 + [(2, 9.0, 9.0)], "id int, lon double, lat double")
    places = spark.createDataFrame([("a", 0.0, 0.01), ("b", 0.0, 0.02)], "title string, lon double, lat double")
    assert spatial.nearest_site(occurrences, places).count() == 5
    from tidewatch.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", -1)
    assert spatial.nearest_site(occurrences, places).count() == 5


def test_closest_pair_per_timestamp_over_the_whole_data(spark):
    occurrences = spark.sql("""
        SELECT TIMESTAMP_NTZ'2020-01-01' AS event_date, s AS species, 1L AS individual_count, x AS lon, 0.0D AS lat,
          'GBIF' AS source FROM VALUES ('far', 0.01D), ('near', 0.001D), ('near', 0.001D), ('out', 5.0D) v(s, x)""")
    places = spark.createDataFrame([("a", 0.0, 0.0)], "title string, lon double, lat double")
    near = models.near_dive_site_occurrences(occurrences, places)
    assert [(r.species, r.proximity_rank) for r in near.collect()] == [("near", 1)]
    each = models.near_dive_site_occurrences(occurrences, places, rank_by="occurrence")
    assert sorted(r.species for r in each.collect()) == ["far", "near", "near"]
    every = models.near_dive_site_occurrences(occurrences, places, rank_by=None)
    assert every.count() == 3 and "proximity_rank" not in every.columns


def test_radius_is_inclusive_and_must_be_positive(spark):
    occurrences, places = frames(spark, np.array([(0.0, 0.0)]), np.array([(0.0, 0.02)]))
    exact = spatial.within_distance(occurrences, places).first().distance_to_dive_site
    assert spatial.within_distance(occurrences, places, exact).count() == 1
    assert spatial.within_distance(occurrences, places, exact - 1e-6).count() == 0
    with pytest.raises(ValueError):
        spatial.within_distance(occurrences, places, 0)


def test_no_cross_join_in_the_plan(spark):
    occurrences, places = frames(spark, scattered(1, 50, 1), scattered(2, 20, 1))
    text = plan(spatial.within_distance(occurrences, places))
    assert "BroadcastHashJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_the_plan_grows_in_step_with_the_radii(spark, monkeypatch):
    rng = np.random.default_rng(8)
    sites = rng.normal(0, 0.0005, (60, 2))
    points = np.vstack([rng.normal(0, 0.01, (100, 2)), rng.uniform(-0.05, 0.05, (100, 2))])
    occurrences, places = frames(spark, points, sites)
    places = places.selectExpr("LPAD(title, 4, '0') AS title", "lon", "lat")
    from tidewatch.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", -1)
    monkeypatch.setattr(spatial, "CROWDED", 4)
    radii, _ = spatial.search_radii(spatial.one_title_per_spot(places), 3000.0)
    assert len(radii) >= 4
    found = spatial.nearest_site(occurrences, places)
    assert found._jdf.queryExecution().analyzed().toString().count("Relation") <= 2 * len(radii) + 2
    # Sites far from the crowd's cell are found too.
    assert {r.id: int(r.dive_site) for r in found.collect()} == nearest_by_hand(points, sites, 3000.0)


def test_pairs_are_computed_once(spark, tmp_path, monkeypatch):
    spark.sql("""
        SELECT TIMESTAMP_NTZ'2020-01-01' + make_interval(0, 0, 0, CAST(id % 7 AS INT)) AS event_date, 'a' AS species,
          id AS individual_count, id / 1000.0D AS lon, 0.0D AS lat, 'GBIF' AS source FROM range(50)""").write.parquet(
        f"{tmp_path}/occurrences")
    spark.createDataFrame([("a", 0.0, 0.0)], "title string, lon double, lat double").write.parquet(f"{tmp_path}/sites")
    stored, places = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("occurrences", "sites"))
    from tidewatch.operators import joins

    for limit in (joins.BROADCAST_MAX_ROWS, -1):
        monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", limit)
        text = plan(models.near_dive_site_occurrences(stored, places))
        assert "partial_min(struct(distance_to_dive_site" in text
        # Only the scan of the occurrences reads their columns.
        assert sum("FileScan parquet" in line and "individual_count" in line for line in text.split("\n")) == 1


def test_closest_per_key_keeps_one_candidate_per_task(spark):
    pairs = spark.range(1000, numPartitions=4).selectExpr(
        "id % 3 AS event_date", "CAST(id AS DOUBLE) AS distance_to_dive_site", "CAST(id AS STRING) AS dive_site")
    best = spatial.closest_per_key(pairs, ["event_date"], ["dive_site"])
    assert rows(best.select("event_date", "dive_site")) == [(0, "0"), (1, "1"), (2, "2")]
    assert "partial_min" in plan(best)
