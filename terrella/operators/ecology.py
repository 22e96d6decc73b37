"""Biomes, vegetation, ground and roughness: projections of the maps before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp01, f32, f32_of

#: Names by code and by bit, and each biome's base density and canopy. Fixed values.
BIOMES = ["open_bog", "spruce_swamp", "mixed_forest", "pine_heath", "esker_pine", "lake", "stream_bank"]
DENSITY = [0.10, 0.80, 0.55, 0.35, 0.30, 0.0, 0.60]
CANOPY = [0.15, 0.78, 0.60, 0.40, 0.35, 0.0, 0.55]
SOILS = ["peat", "sandy_till", "rocky_till"]
SURFACE = ["standing_water", "sphagnum", "lichen", "exposed_sand", "bedrock"]
ROUGHNESS = ["fallen_log", "root_tangle", "boulder", "windthrow"]


def biome(strength: float) -> Column:
    t = f32_of
    m = f32(clamp01(F.col("moisture") + (F.col("v") - 0.5) * F.lit(t(strength))))
    dry = F.when((F.col("h") >= t(0.70)) & (F.col("slope") < t(0.05)), 4).otherwise(3)
    wet = F.when(F.col("slope") < t(0.03), 0).otherwise(1)
    return F.when(F.col("water") == 1, 5).when(F.col("water") == 2, 6).when(m >= t(0.85), wet).when(m >= t(0.65), 1).when(m >= t(0.40), 2).otherwise(dry)


def with_vegetation(tiles: DataFrame) -> DataFrame:
    """density and canopy; the canopy follows the density before it is rounded."""
    base = lambda table: F.element_at(F.array(*map(F.lit, table)), F.col("biome") + 1)
    density = clamp01(base(DENSITY) + (F.col("v") - 0.5) * 0.1 + (F.col("moisture") - 0.5) * 0.08)
    tiles = tiles.withColumn("_d", density)
    canopy = clamp01(base(CANOPY) + (F.col("_d") - base(DENSITY)) * 0.6)
    return tiles.withColumn("density", f32(F.col("_d"))).withColumn("canopy", f32(canopy)).drop("_d")


def dominant() -> Column:
    """The ordered species of a tile."""
    one = lambda *names: F.array(*map(F.lit, names))
    none = F.array().cast("array<string>")
    b, m = F.col("biome"), F.col("moisture")
    mixed = F.when(m >= f32_of(0.52), one("norway_spruce", "birch")).otherwise(one("birch", "norway_spruce"))
    bog = F.when(m < f32_of(0.75), one("birch")).otherwise(none)
    return F.when(b.isin(3, 4), one("scots_pine")).when(b == 1, one("norway_spruce")).when(b == 2, mixed).when(b == 6, one("birch")).when(b == 0, bog).otherwise(none)


def with_ground(tiles: DataFrame, params: dict) -> DataFrame:
    own = {k: f32_of(v) for k, v in params["ground"].items()}
    h, r, m, slope = (F.col(c) for c in ("h", "r", "moisture", "slope"))
    sandy = (m <= own["exposedSandMoistureMax"]) & ((F.col("landform") == 2) | (h >= own["bedrockHeightMin"]))
    peat = m >= own["peatMoistureThreshold"]
    tiles = tiles.withColumn("soil", F.when(peat, 0).when(sandy, 1).otherwise(2))
    tiles = tiles.withColumn("firmness", f32(clamp01(F.lit(1.0) - m * 0.85 + clamp01(slope / F.lit(f32_of(0.2))) * 0.15)))
    standing = (m >= own["standingWaterMoistureThreshold"]) & (slope < own["standingWaterSlopeMax"])
    bits = [standing, F.col("soil") == 0, m <= own["lichenMoistureMax"], (F.col("soil") == 1) & (m <= own["exposedSandMoistureMax"]), (h >= own["bedrockHeightMin"]) & (r >= own["bedrockRoughnessMin"])]
    return tiles.withColumn("surface", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)))


def with_roughness(tiles: DataFrame, params: dict) -> DataFrame:
    """obstruction and features; the flags look at the obstruction before it is rounded."""
    own = {k: f32_of(v) for k, v in params["roughnessFeatures"].items()}
    mix = own["obstructionMoistureMix"]
    tiles = tiles.withColumn("_o", clamp01(F.col("r") * F.lit(1 - mix) + F.col("moisture") * F.lit(mix)))
    o = F.col("_o")
    boulder = (F.col("h") >= own["boulderHeightMin"]) & (F.col("r") >= own["boulderRoughnessMin"])
    bits = [o >= own["fallenLogThreshold"], F.col("moisture") >= own["rootTangleMoistureThreshold"], boulder, o >= own["windthrowThreshold"]]
    tiles = tiles.withColumn("features", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)))
    return tiles.withColumn("obstruction", f32(o)).drop("_o")


def with_ecology(tiles: DataFrame, params: dict) -> DataFrame:
    tiles = tiles.withColumn("biome", biome(params["vegVarianceNoise"]["strength"]))
    tiles = with_vegetation(tiles).withColumn("dominant", dominant())
    return with_roughness(with_ground(tiles, params), params)
