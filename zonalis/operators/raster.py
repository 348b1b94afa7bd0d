"""Raster tiles as rows: pixels, slope and zonal statistics.

A tile is (tile_id, x0, y0, dx, dy, ncols, nrows, nodata, band): x0, y0 the outer corner of the first pixel, the band row
by row.  Pixels are joined to zones by their centres.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.functions.projection import EPSG_6372, Conic, forward
from zonalis.operators.quadtree_join import quadtree_join, region_targets


def from_bounds(west: Column, north: Column, east: Column, south: Column, ncols: Column, nrows: Column) -> dict[str, Column]:
    """The affine columns of a tile that fills given bounds."""
    return {"x0": west, "y0": north, "dx": (east - west) / ncols, "dy": (south - north) / nrows}


def pixels(tiles: DataFrame) -> DataFrame:
    """(col, row, x, y, z) of every pixel with data: global column and row numbers on the grid of (dx, dy), the centre and
    the value.  Overlapping tiles give a pixel once, by their mean."""
    one = tiles.select("x0", "y0", "dx", "dy", "ncols", "nodata", F.posexplode("band").alias("i", "z"))
    at = one.select(
        (F.floor(F.col("x0") / F.col("dx") + 0.5) + F.col("i") % F.col("ncols")).cast("bigint").alias("col"),
        (F.floor(F.col("y0") / F.col("dy") + 0.5) + F.floor(F.col("i") / F.col("ncols"))).cast("bigint").alias("row"),
        "dx", "dy", F.col("z").cast("double").alias("z"), "nodata",
    ).where(F.col("z").isNotNull() & ~F.isnan("z") & (F.col("nodata").isNull() | (F.col("z") != F.col("nodata"))))
    mean = at.groupBy("col", "row").agg(F.avg("z").alias("z"), F.first("dx").alias("dx"), F.first("dy").alias("dy"))
    return mean.select("col", "row", ((F.col("col") + 0.5) * F.col("dx")).alias("x"), ((F.col("row") + 0.5) * F.col("dy")).alias("y"), "z", "dx", "dy")


def slope(cells: DataFrame) -> DataFrame:
    """(col, row, x, y, slope) in degrees by Horn's 3x3 kernel, for the pixels all of whose neighbours have data.

    Every pixel offers its weighted value to its eight neighbours, whose sums are one grouped aggregate: no self joins."""
    # The kernel's weights to the east and to the south of the pixel
    kernel = [(dc, dr, dc * (2 if dr == 0 else 1), dr * (2 if dc == 0 else 1)) for dc in (-1, 0, 1) for dr in (-1, 0, 1) if (dc, dr) != (0, 0)]
    offers = F.explode(F.array(*[F.struct((F.col("col") - dc).alias("c"), (F.col("row") - dr).alias("r"), (F.col("z") * e).alias("e"), (F.col("z") * s).alias("s")) for dc, dr, e, s in kernel]))
    sums = cells.select(offers.alias("o")).groupBy(F.col("o.c").alias("col"), F.col("o.r").alias("row")).agg(F.sum("o.e").alias("e"), F.sum("o.s").alias("s"), F.count("*").alias("n"))
    rise = F.hypot(F.col("e") / (8 * F.col("dx")), F.col("s") / (8 * F.col("dy")))
    return cells.join(sums.where("n = 8"), ["col", "row"]).select("col", "row", "x", "y", F.degrees(F.atan(rise)).alias("slope"))


def in_zones(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """The cells with the zone that holds their centre; cells in no zone drop out."""
    kept = tuple(c for c in cells.columns if c not in ("x", "y"))
    keyed = cells.withColumn("cell", F.concat_ws("_", "col", "row"))
    return quadtree_join(keyed, "cell", "x", "y", region_targets(zones, "cvegeo", "geom"), carry=kept).withColumnRenamed("other_id", "ageb_id")


def projected(cells: DataFrame, crs: Conic = EPSG_6372) -> DataFrame:
    """The cells with their centres in the plane instead of geographic degrees; values aren't resampled."""
    x, y = forward(F.col("x"), F.col("y"), crs)
    return cells.withColumns({"x": x, "y": y})


def zonal_slope(tiles: DataFrame, zones: DataFrame) -> DataFrame:
    """(ageb_id, slope_mean): mean slope over a zone's pixels."""
    return in_zones(slope(pixels(tiles)), zones).groupBy("ageb_id").agg(F.avg("slope").alias("slope_mean"))


def zonal_statistics(tiles: DataFrame, zones: DataFrame, above: float = 0.0) -> DataFrame:
    """(ageb_id, median, mean, max) of a zone's pixel values above a limit, over all tiles given (e.g. of twelve months)."""
    inside = in_zones(pixels(tiles), zones).where(F.col("z") > above)
    return inside.groupBy("ageb_id").agg(F.median("z").alias("median"), F.avg("z").alias("mean"), F.max("z").alias("max"))


def mean_of_tile_means(tiles: DataFrame, zones: DataFrame) -> DataFrame:
    """(ageb_id, mean): the mean over tiles of the tiles' means inside a zone, each tile counting alike."""
    keyed = tiles.select("tile_id", "x0", "y0", "dx", "dy", "ncols", "nodata", F.posexplode("band").alias("i", "z"))
    at = keyed.select(
        "tile_id", F.concat_ws("_", "tile_id", "i").alias("cell"), (F.col("x0") + (F.col("i") % F.col("ncols") + 0.5) * F.col("dx")).alias("x"),
        (F.col("y0") + (F.floor(F.col("i") / F.col("ncols")) + 0.5) * F.col("dy")).alias("y"), F.col("z").cast("double").alias("z"), "nodata",
    ).where(~F.isnan("z") & (F.col("nodata").isNull() | (F.col("z") != F.col("nodata"))))
    found = quadtree_join(at, "cell", "x", "y", region_targets(zones, "cvegeo", "geom"), carry=("tile_id", "z"))
    return found.groupBy(F.col("other_id").alias("ageb_id"), "tile_id").agg(F.avg("z").alias("m")).groupBy("ageb_id").agg(F.avg("m").alias("mean"))
