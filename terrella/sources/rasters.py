"""Authored rasters: JSON files and rasters made from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InputError, ShapeError
from ..functions.columns import clamp01, f32

SCHEMA = "width bigint, height bigint, data array<double>"
#: Cells of a row of the vector raster.
SIDE = 64


def read_authored(spark: SparkSession, path: str, shape: tuple[int, int] | None = None, grid_id: int = 0) -> DataFrame:
    """(grid_id, x, y, value) of a JSON raster {width, height, data}; its shape and values are checked first."""
    raw = spark.read.schema(SCHEMA + ", _corrupt_record string").json(path, multiLine=True).select("width", "height", "data")
    check = violations(raw).first()
    if check is None or check["bad_structure"]:
        raise InputError(f"{path} is no raster with whole positive width and height and an array of numbers")
    if check["bad_length"]:
        raise ShapeError(f"{path}: the data's length is not width times height")
    if check["bad_values"]:
        raise InputError(f"{path}: {check['bad_values']} values are not finite or not in [0, 1]")
    if shape and (check["width"], check["height"]) != shape:
        raise ShapeError(f"{path} is {check['width']} x {check['height']}, not {shape[0]} x {shape[1]}")
    return cells(raw, grid_id)


def violations(raw: DataFrame) -> DataFrame:
    """Per raster: what is wrong with it."""
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v <= 1)
    structure = F.col("width").isNull() | F.col("height").isNull() | F.col("data").isNull() | (F.col("width") <= 0) | (F.col("height") <= 0)
    return raw.select("width", "height", F.coalesce(structure, F.lit(True)).alias("bad_structure"), (F.size("data") != F.col("width") * F.col("height")).alias("bad_length"), F.size(F.filter("data", lambda v: ~fine(v))).alias("bad_values"))


def cells(raw: DataFrame, grid_id: int = 0) -> DataFrame:
    at = raw.select("width", F.posexplode("data").alias("idx", "value"))
    return at.select(F.lit(grid_id).cast("long").alias("grid_id"), (F.col("idx") % F.col("width")).cast("int").alias("x"), F.floor(F.col("idx") / F.col("width")).cast("int").alias("y"), f32(F.col("value")).alias("value"))


def vector_raster(vectors: DataFrame) -> DataFrame:
    """A grid 64 wide with a row for each vector: h from its components, r from them backwards, v from half-way round."""
    value = lambda i: f32(clamp01((F.element_at("embedding", i).cast("double") + 0.6) / F.lit(1.2)))
    at = vectors.select(F.lit(0).cast("long").alias("grid_id"), F.col("vec_id").cast("int").alias("y"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(SIDE - 1))).alias("x"))
    x = F.col("x")
    return at.select("grid_id", "x", "y", value(x + 1).alias("h"), value(F.lit(SIDE) - x).alias("r"), value((x + 32) % SIDE + 1).alias("v"))


def item_raster(items: DataFrame, side: int = SIDE) -> DataFrame:
    """(grid_id, x, y, value): mean discount of the line items of each (part, order) cell, from whole cents."""
    cell = lambda c: F.pmod(F.col(c), F.lit(side)).cast("int")
    sums = items.groupBy(cell("l_partkey").alias("x"), cell("l_orderkey").alias("y")).agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.lit(0).cast("long").alias("grid_id"), "x", "y", f32(clamp01(F.col("s") / (F.col("n") * 10))).alias("value"))
