"""The whole pipeline as one plan: base maps, topography, hydrology, ecology, trails, navigation, nested tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import decode, flag_names
from ..functions.storage import settled
from ..operators import ecology, hydrology, navigation, noise, topography, trails
from ..operators.grid import dense_grid

SPEC = "forest-terrain-v1"


def derived(tiles: DataFrame, params: dict, seed: int, width: int, height: int) -> DataFrame:
    """All maps of tiles (grid_id, x, y, h, r, v); grids of one job share width and height."""
    tiles = settled(topography.with_topography(tiles, params), "topography")
    tiles = settled(ecology.with_ecology(hydrology.with_hydrology(tiles, params, seed, width * height), params), "ecology")
    return navigation.with_navigation(trails.with_trails(tiles, params, width, height), params, width, height)


def generate(spark: SparkSession, seed: int, width: int, height: int, params: dict, authored: dict[str, DataFrame] | None = None) -> DataFrame:
    return derived(noise.with_base_maps(dense_grid(spark, width, height), seed, params, authored), params, seed, width, height)


def nested(tiles: DataFrame) -> DataFrame:
    """Tiles in their interchange form: x, y, topography, hydrology, ecology, navigation."""
    c = F.col
    return tiles.select(
        "grid_id", "x", "y",
        F.struct("h", "r", "v", c("slope").alias("slopeMag"), c("aspect").alias("aspectDeg"), decode(c("landform"), topography.LANDFORMS, "landform").alias("landform")).alias("topography"),
        F.struct("fd", "fa", c("fa_norm").alias("faN"), c("lake").alias("lakeMask"), c("stream").alias("isStream"), c("dist_water").alias("distWater"), "moisture", decode(c("water"), hydrology.WATER, "water").alias("waterClass")).alias("hydrology"),
        F.struct(
            decode(c("biome"), ecology.BIOMES, "biome").alias("biome"), c("density").alias("treeDensity"), c("canopy").alias("canopyCover"), "dominant",
            F.struct(decode(c("soil"), ecology.SOILS, "soil").alias("soil"), "firmness", flag_names(c("surface"), ecology.SURFACE).alias("surfaceFlags")).alias("ground"),
            F.struct("obstruction", flag_names(c("features"), ecology.ROUGHNESS).alias("featureFlags")).alias("roughness"),
        ).alias("ecology"),
        navigation.payload().alias("navigation"),
    )
