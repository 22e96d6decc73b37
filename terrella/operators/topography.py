"""Slope, aspect and landform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import f32
from .grid import blocked, column_window, row_window, unblocked, with_neighbours

#: Landform names by code. Fixed values.
LANDFORMS = ["flat", "slope", "ridge", "valley", "basin"]


def normalize_degrees(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def with_slope_aspect(tiles: DataFrame) -> DataFrame:
    """slope and aspect from differences to the neighbours in the row and column, a missing one being the tile itself."""
    h = F.col("h")
    hx = F.coalesce(F.lead("h").over(row_window()), h) - F.coalesce(F.lag("h").over(row_window()), h)
    hy = F.coalesce(F.lead("h").over(column_window()), h) - F.coalesce(F.lag("h").over(column_window()), h)
    tiles = unblocked(blocked(tiles, "x", 1).withColumn("_hx", hx))
    tiles = unblocked(blocked(tiles, "y", 1).withColumn("_hy", hy))
    hx, hy = F.col("_hx"), F.col("_hy")
    aspect = F.when((hx == 0) & (hy == 0), F.lit(0.0)).otherwise(normalize_degrees(F.atan2(-hy, -hx) * F.lit(180.0) / F.lit(3.141592653589793)))
    return tiles.withColumn("slope", f32(F.sqrt(hx * hx + hy * hy) / 2)).withColumn("aspect", f32(aspect)).drop("_hx", "_hy")


def landform(near: Column, h: Column, slope: Column, eps: float, flat: float) -> Column:
    """Code from how many of the neighbours stand higher and lower by more than eps."""
    count = lambda test: F.size(F.filter(near, test))
    hi = count(lambda n: n.isNotNull() & (n["h"] - h > eps))
    lo = count(lambda n: n.isNotNull() & (h - n["h"] > eps))
    level = slope < flat
    return (
        F.when(level & (lo == 0) & (hi > 0), 4).when(level & (hi == 0) & (lo > 0), 2).when(level, 0)
        .when(hi >= 6, 4).when(lo >= 6, 2).when((hi >= 5) & (lo <= 2), 3).when((lo >= 5) & (hi <= 2), 2).otherwise(1)
    )


def with_landform(tiles: DataFrame, params: dict) -> DataFrame:
    own = params["landform"]
    near = with_neighbours(tiles, ["h"])
    return near.withColumn("landform", landform(F.col("near"), F.col("h"), F.col("slope"), float(own["eps"]), float(own["flatSlopeThreshold"]))).drop("near")


def with_topography(tiles: DataFrame, params: dict) -> DataFrame:
    return with_landform(with_slope_aspect(tiles), params)
