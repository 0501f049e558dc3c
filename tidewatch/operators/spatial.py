"""The distance join between occurrences and sites, and the nearest-site rules built on it.

Occurrences carry ``lon`` and ``lat`` besides any other columns; sites are (title, lon, lat).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.geo import Grid, haversine_m
from tidewatch.operators.joins import Size, measure, salted_join
from tidewatch.session import new_table_path

# The radius the pipeline uses unless told otherwise (fixed value).
RADIUS_M = 3000.0

# Cells of a grid this coarse number fewer than 200,000 on the whole sphere, however many sites there are.
TILE_RADIUS_M = 55_000.0

# A cell with more sites than this is searched at a smaller radius first, down to a radius at which sites of different
# positions hardly share a cell; the result is the same either way.
CROWDED = 256
SMALLEST_RADIUS_M = 1.0

_CELL = "_cell"


def site_cells(sites: DataFrame, grid: Grid) -> DataFrame:
    """One row per site and cell its circle can reach."""
    named = sites.selectExpr("title AS dive_site", "lon AS site_lon", "lat AS site_lat")
    return grid.with_reachable_cells(named, "site_lon", "site_lat", _CELL)


def near_any_site(occurrences: DataFrame, sites: DataFrame, radius_m: float) -> DataFrame:
    """Occurrences on a coarse tile that some site's circle can reach.

    The set of tiles is bounded by the sphere, not by the sites, so it is sent to every task, and occurrences far
    from all sites are dropped where they are read, before any shuffle.
    """
    tiles = Grid(max(radius_m, TILE_RADIUS_M))
    occupied = site_cells(sites, tiles).select(F.col(_CELL).alias("_tile")).distinct()
    return tiles.with_cell(occurrences, "_tile").join(F.broadcast(occupied), "_tile", "left_semi").drop("_tile")


def _distance():
    return haversine_m(F.col("lon"), F.col("lat"), F.col("site_lon"), F.col("site_lat"))


def within_distance(occurrences: DataFrame, sites: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Every (occurrence, site) pair at most ``radius_m`` apart, with ``distance_to_dive_site`` in metres.

    If counting proves the site cells small, the pairs are found where the occurrences are read, without a
    shuffle. Else both are shuffled by cell, and a crowded cell is spread over several tasks.
    """
    grid = Grid(radius_m)
    cells = site_cells(sites, grid)
    if measure(cells).can_broadcast:
        pairs = grid.with_cell(occurrences, _CELL).join(F.broadcast(cells), _CELL)
    else:
        points = grid.with_cell(near_any_site(occurrences, sites, radius_m), _CELL)
        pairs = salted_join(points, cells, [_CELL], "inner")
    return (
        pairs.drop(_CELL)
        .withColumn("distance_to_dive_site", _distance())
        .where(F.col("distance_to_dive_site") <= radius_m)
    )


def closest_per_key(pairs: DataFrame, keys: list[str], tie_break: list[str]) -> DataFrame:
    """The row with the smallest distance per key; ties fall to the first in ``tie_break`` order.

    One pass: each task keeps one row per key before the shuffle, so the pairs are computed once and a key that holds
    a third of them is one row a task.
    """
    order = ["distance_to_dive_site", *tie_break]
    rest = [name for name in pairs.columns if name not in keys and name not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return pairs.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*pairs.columns)


def one_title_per_spot(sites: DataFrame) -> DataFrame:
    """Sites at one position are equally far from everything, so only the first title can be the nearest."""
    return sites.groupBy("lon", "lat").agg(F.min("title").alias("title")).select("title", "lon", "lat")


def _crowding(spots: DataFrame, radius_m: float) -> tuple[Size, int]:
    """Size of the cell table and the largest number of sites in one cell, in one pass over the sites."""
    per_cell = site_cells(spots, Grid(radius_m)).groupBy(_CELL).agg(
        F.count(F.lit(1)).alias("sites"), F.sum(F.octet_length("dive_site") + 24).alias("bytes")
    )
    row = per_cell.agg(
        F.coalesce(F.sum("sites"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0)),
        F.coalesce(F.max("sites"), F.lit(0)),
    ).first()
    return Size(row[0], row[1]), row[2]


def search_radii(spots: DataFrame, radius_m: float) -> tuple[list[float], Size]:
    """Radii to search one after the other, smallest first, and the size of all their cell tables.

    A site found within a small radius is the nearest of all, so where a cell is crowded a quarter of the radius is
    searched first. Without crowded cells there is one radius.
    """
    radii = [radius_m]
    size, crowd = _crowding(spots, radius_m)
    while crowd > CROWDED and radii[0] > SMALLEST_RADIUS_M:
        radii.insert(0, radii[0] / 4)
        more, crowd = _crowding(spots, radii[0])
        size = Size(size.rows + more.rows, size.bytes + more.bytes)
    return radii, size


def _nearest_in(sites: str, radius_m: float):
    """The nearest site of an array column, or NULL if it is farther than the radius."""

    def candidate(site):
        return F.struct(
            haversine_m(F.col("lon"), F.col("lat"), site.site_lon, site.site_lat).alias("distance_to_dive_site"),
            site.dive_site.alias("dive_site"),
            site.site_lon.alias("site_lon"),
            site.site_lat.alias("site_lat"),
        )

    listed = F.col(sites)
    # Most cells have one site, for which no array has to be walked.
    nearest = F.when(F.size(listed) == 1, candidate(F.get(listed, F.lit(0)))).otherwise(
        F.array_min(F.transform(listed, candidate))
    )
    return F.get(F.filter(F.array(nearest), lambda best: best.distance_to_dive_site <= radius_m), F.lit(0))


def nearest_among(occurrences: DataFrame, sites: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Pairs within the radius that hold each occurrence's nearest one: all pairs, or that one where cells are crowded."""
    spots = one_title_per_spot(sites)
    if len(search_radii(spots, radius_m)[0]) == 1:
        return within_distance(occurrences, spots, radius_m)
    return nearest_site(occurrences, sites, radius_m)


def nearest_site(occurrences: DataFrame, sites: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Each occurrence with its nearest site within the radius; occurrences with none are left out.

    If counting proves the site cells small, the sites of a cell travel as one array and the choice is made in the
    row: no pairs are emitted and nothing is shuffled. Else the sites are joined to the distinct positions, radius by
    radius, and the answer is joined back with a salt, as one position may hold many rows. What a radius settles and
    leaves open is stored, so the plan doesn't grow with the radii.
    """
    columns = occurrences.columns
    answer = [*columns, "dive_site", "site_lon", "site_lat", "distance_to_dive_site"]
    spots = one_title_per_spot(sites)
    radii, size = search_radii(spots, radius_m)
    if size.can_broadcast:
        out, found = occurrences, []
        # The full radius comes first and drops occurrences no site can reach.
        for step, radius in enumerate(reversed(radii)):
            grid, listed = Grid(radius), f"_sites_{step}"
            by_cell = site_cells(spots, grid).groupBy(_CELL).agg(
                F.collect_list(F.struct("dive_site", "site_lon", "site_lat")).alias(listed)
            )
            out = grid.with_cell(out, _CELL).join(F.broadcast(by_cell), _CELL, "left" if step else "inner").drop(_CELL)
            found.insert(0, _nearest_in(listed, radius))
        # Unpacking an array computes the choice once; a filter on the column would compute it twice.
        choice = F.filter(F.array(F.coalesce(*found)), lambda best: best.isNotNull())
        return out.select(*columns, F.inline(choice)).select(*answer)
    candidates = near_any_site(occurrences, spots, radius_m)
    open_positions, nearest = _stored(candidates.select("lon", "lat").distinct(), "positions"), None
    for radius in radii:
        settled = _stored(closest_per_key(
            within_distance(open_positions, spots, radius), ["lon", "lat"], ["dive_site", "site_lon", "site_lat"]
        ), "settled")
        nearest = settled if nearest is None else nearest.unionByName(settled)
        if radius != radii[-1]:
            open_positions = _stored(
                open_positions.join(settled.select("lon", "lat"), ["lon", "lat"], "left_anti"), "positions")
    return salted_join(candidates, nearest, ["lon", "lat"], "inner").select(*answer)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
