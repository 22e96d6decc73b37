"""Tiles that arrive as JSON lines: the stateless stages as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.envelope import TILE


def tile_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema("grid_id bigint, " + TILE).json(path)


def blocked_directions(tiles: DataFrame) -> DataFrame:
    """How many directions of each tile are blocked; needs no state, so it runs on streams and tables alike."""
    ways = F.array(*[F.col(f"navigation.passability.{d}") for d in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return tiles.select("grid_id", "x", "y", F.size(F.filter(ways, lambda w: w == "blocked")).alias("blocked"))
