"""Drainage: flow directions, accumulation, lakes, streams, distances, moisture and water classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.columns import clamp01, f32, f32_of, tie_hash, unsigned_mod
from ..functions.storage import settled
from .graph import labelled, subtree_sizes
from .grid import DIR8, KEYS, NO_DIR, box_distance, with_neighbours

#: Water class names by code. Fixed values.
WATER = ["none", "lake", "stream", "marsh"]


def with_flow_direction(tiles: DataFrame, params: dict, seed: int) -> DataFrame:
    """fd: the direction of the largest drop, 255 without any; ties within tieEps go by the tile's hash."""
    own = params["hydrology"]
    near = with_neighbours(tiles, ["h"])
    drops = F.transform(F.col("near"), lambda n: F.when(n.isNotNull() & (F.col("h") - n["h"] >= float(own["minDropThreshold"])), F.col("h") - n["h"]))
    near = near.withColumn("_drops", drops).withColumn("_most", F.array_max("_drops"))
    tied = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda d: F.coalesce(F.abs(F.col("_most") - F.get(F.col("_drops"), d)) <= float(own["tieEps"]), F.lit(False)))
    near = near.withColumn("_tied", tied)
    one = F.element_at("_tied", 1)
    by_hash = F.element_at("_tied", unsigned_mod(tie_hash(seed, F.col("x"), F.col("y")), F.size("_tied").cast("long")).cast("int") + 1)
    fd = F.when(F.size("_tied") == 0, F.lit(NO_DIR)).when(F.size("_tied") == 1, one).otherwise(by_hash)
    return near.withColumn("fd", fd).drop("near", "_drops", "_most", "_tied")


def downstream(column: str) -> Column:
    """struct(x, y) of where fd leads, null for 255; any other code than the eight directions raises."""
    code = F.col(column)
    step = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in DIR8]), F.least(F.greatest(code, F.lit(0)), F.lit(7)) + 1)
    known = F.when(code.between(0, 7), F.struct((F.col("x") + step(0)).alias("x"), (F.col("y") + step(1)).alias("y")))
    unknown = F.raise_error(F.concat(F.lit("flow direction: unknown code "), code.cast("string"))).cast("struct<x:int,y:int>")
    return known.when(code.isNotNull() & (code != NO_DIR), unknown)


def in_degree(tiles: DataFrame) -> DataFrame:
    """Adds in_deg, how many tiles flow into each."""
    into = tiles.where(F.col("fd") != NO_DIR).select("grid_id", downstream("fd").alias("to")).groupBy("grid_id", F.col("to.x").alias("x"), F.col("to.y").alias("y")).agg(F.count(F.lit(1)).cast("int").alias("in_deg"))
    return tiles.join(into, KEYS, "left").withColumn("in_deg", F.coalesce("in_deg", F.lit(0)))


def with_flow_accumulation(tiles: DataFrame, size: int) -> DataFrame:
    """fa: how many tiles drain through each, itself included. size: tiles of the largest grid."""
    edges = tiles.select("grid_id", F.struct("x", "y").alias("node"), downstream("fd").alias("next"))
    sums = subtree_sizes(edges, size).select("grid_id", "node.x", "node.y", F.col("total").alias("fa"))
    return tiles.join(sums, KEYS)


def with_flow_norm(tiles: DataFrame) -> DataFrame:
    """fa_norm: the logarithm of fa between the grid's least and largest, 0 where all are equal."""
    ends = tiles.groupBy("grid_id").agg(F.min("fa").alias("_lo"), F.max("fa").alias("_hi"))
    lo, hi = F.log(F.col("_lo").cast("double")), F.log(F.col("_hi").cast("double"))
    norm = F.when(F.col("_lo") == F.col("_hi"), F.lit(0.0)).otherwise((F.log(F.col("fa").cast("double")) - lo) / (hi - lo))
    return tiles.join(ends, "grid_id").withColumn("fa_norm", f32(norm)).drop("_lo", "_hi")


def lake_mask(params: dict) -> Column:
    own = params["hydrology"]
    return (F.col("landform") == 4) & (F.col("slope") < f32_of(own["lakeFlatSlopeThreshold"])) & (F.col("fa_norm") >= f32_of(own["lakeAccumThreshold"]))


def grown_lakes(tiles: DataFrame, params: dict) -> DataFrame:
    """lake, widened by lakeGrowSteps: each 8-way lake spreads 4-way over low, level ground, as far as its own base allows."""
    own = params["hydrology"]
    steps, delta = own.get("lakeGrowSteps", 0), own.get("lakeGrowHeightDelta", 0)
    steps = int(steps) if steps == steps and steps > 0 else 0
    if not steps:
        return tiles
    delta = f32_of(max(0.0, float(delta)))
    lakes = tiles.where("lake")
    near = lambda a, step8: a.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in step8])))
    moved = near(lakes.select(*KEYS), DIR8).select("grid_id", F.struct("x", "y").alias("a"), (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y"))
    edges = moved.join(lakes.select(*KEYS), KEYS).select("grid_id", "a", F.struct("x", "y").alias("b"))
    labels = labelled(lakes.select("grid_id", F.struct("x", "y").alias("node")), edges).select("grid_id", "node.x", "node.y", "label")
    lows = lakes.join(labels, KEYS).groupBy("grid_id", "label").agg(F.min("h").alias("ref"))
    open_ = settled(tiles.where(~F.col("lake") & (F.col("slope") <= f32_of(own["lakeFlatSlopeThreshold"]))).select(*KEYS, "h"))
    seen = settled(labels.join(lows, ["grid_id", "label"]).select(*KEYS, "label", "ref"))
    front = seen
    for _ in range(steps):
        reach = near(front, DIR8[::2]).select("grid_id", "label", "ref", (F.col("x") + F.col("_s.dx")).alias("x"), (F.col("y") + F.col("_s.dy")).alias("y")).distinct()
        front = reach.join(open_, KEYS).where(F.col("h") <= F.col("ref") + delta).drop("h").join(seen, [*KEYS, "label"], "left_anti")
        front = settled(front.select(*KEYS, "label", "ref"))
        if front.isEmpty():
            break
        seen = settled(seen.unionByName(front))
    wet = seen.select(*KEYS).distinct().withColumn("_wet", F.lit(True))
    return tiles.join(wet, KEYS, "left").withColumn("lake", F.col("lake") | F.coalesce("_wet", F.lit(False))).drop("_wet")


def stream_mask(params: dict) -> Column:
    own = params["hydrology"]
    return ~F.col("lake") & (F.col("fa_norm") >= f32_of(own["streamAccumThreshold"])) & (F.col("slope") >= f32_of(own["streamMinSlopeThreshold"]))


def moisture(params: dict) -> Column:
    own = params["hydrology"]
    start, flat, most, w = own["moistureAccumStart"], own["flatnessThreshold"], own["waterProxMaxDist"], own["weights"]
    if most <= 0:
        raise InputError("hydrology.waterProxMaxDist must be positive")
    gathered = clamp01((F.col("fa_norm") - start) / F.lit(1.0 - start))
    level = clamp01((F.lit(flat) - F.col("slope")) / F.lit(float(flat)))
    close = clamp01(F.lit(1.0) - F.col("dist_water") / F.lit(float(most)))
    return f32(clamp01(F.lit(w["accum"]) * gathered + F.lit(w["flat"]) * level + F.lit(w["prox"]) * close))


def water_class(params: dict) -> Column:
    own = params["hydrology"]
    marsh = (F.col("moisture") >= f32_of(own["marshMoistureThreshold"])) & (F.col("slope") < f32_of(own["marshSlopeThreshold"]))
    return F.when(F.col("lake"), 1).when(F.col("stream"), 2).when(marsh, 3).otherwise(0)


def with_hydrology(tiles: DataFrame, params: dict, seed: int, size: int) -> DataFrame:
    own = params["hydrology"]
    tiles = settled(with_flow_direction(tiles, params, seed), "flow")
    tiles = with_flow_norm(with_flow_accumulation(tiles, size)).withColumn("lake", lake_mask(params))
    tiles = settled(grown_lakes(tiles, params).withColumn("stream", stream_mask(params)), "water")
    tiles = box_distance(tiles, F.col("lake") | F.col("stream"), own["waterProxMaxDist"], "dist_water")
    return tiles.withColumn("moisture", moisture(params)).withColumn("water", water_class(params))
