"""Dense grids: addressing, stencils by two windows, box distances, and coordinate joins for sparse tiles.

Tiles are rows (grid_id, x, y, map columns); every operator keeps grid_id, so many grids run in one job. A stencil is a
window over rows and one over columns of a grid: two exchanges, whatever the number of grids, and no self-join. Long rows
and columns are cut into blocks that hold copies of their neighbours' ends, so a grid is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import settled

#: Steps in the order of direction codes 0 to 7 (E, SE, S, SW, W, NW, N, NE); 255 is no direction. Fixed values.
DIR8 = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
NO_DIR = 255
#: Steps around a tile from north, clockwise, by name. Fixed values.
RING = {"N": (0, -1), "NE": (1, -1), "E": (1, 0), "SE": (1, 1), "S": (0, 1), "SW": (-1, 1), "W": (-1, 0), "NW": (-1, -1)}
KEYS = ["grid_id", "x", "y"]
#: Tiles of a row or column that one window holds, besides the copies at its ends.
BLOCK = 2_048


def row_window():
    return Window.partitionBy("grid_id", "y", "_block").orderBy("x")


def column_window():
    return Window.partitionBy("grid_id", "x", "_block").orderBy("y")


def blocked(tiles: DataFrame, axis: str, halo: int) -> DataFrame:
    """tiles with _block along an axis; those within halo of a block's end are there again, with _copy, for the next block."""
    block, at = F.floor(F.col(axis) / BLOCK), F.pmod(F.col(axis), F.lit(BLOCK))
    reach = range(1, -(-halo // BLOCK) + 1)
    there = [F.struct(block.alias("b"), F.lit(False).alias("copy"))]
    for k in reach:
        far = halo - (k - 1) * BLOCK
        there += [F.when(at < far, F.struct((block - k).alias("b"), F.lit(True).alias("copy"))), F.when(at >= BLOCK - far, F.struct((block + k).alias("b"), F.lit(True).alias("copy")))]
    placed = tiles.withColumn("_in", F.explode(F.filter(F.array(*there), lambda p: p.isNotNull())))
    return placed.withColumn("_block", F.col("_in.b")).withColumn("_copy", F.col("_in.copy")).drop("_in")


def unblocked(tiles: DataFrame) -> DataFrame:
    return tiles.where(~F.col("_copy")).drop("_block", "_copy")


def dense_grid(spark: SparkSession, width: int, height: int, grid_id: int = 0) -> DataFrame:
    ids = spark.range(width * height)
    return ids.select(F.lit(grid_id).cast("long").alias("grid_id"), (F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))


def index(width: int) -> Column:
    return F.col("y").cast("long") * width + F.col("x")


def with_neighbours(tiles: DataFrame, columns: list[str], name: str = "near") -> DataFrame:
    """Adds an array of eight structs of the columns, by direction code; null beyond the edge. For dense grids."""
    me = F.struct(*columns)
    three = F.struct(F.lag(me).over(row_window()).alias("w"), me.alias("c"), F.lead(me).over(row_window()).alias("e"))
    rows = unblocked(blocked(tiles, "x", 1).withColumn("_three", three))
    rows = blocked(rows, "y", 1).withColumn("_up", F.lag("_three").over(column_window())).withColumn("_down", F.lead("_three").over(column_window()))
    rows = unblocked(rows)
    column = {-1: "w", 0: "c", 1: "e"}
    line = {-1: "_up", 0: "_three", 1: "_down"}
    return rows.withColumn(name, F.array(*[F.col(f"{line[dy]}.{column[dx]}") for dx, dy in DIR8])).drop("_three", "_up", "_down")


def box_distance(tiles: DataFrame, source: Column, cap: int, name: str) -> DataFrame:
    """Capped steps (8-way, nothing in the way) to the nearest source: the least d whose box of radius d holds one.

    All row maxima come from one window over rows, all column maxima from one over columns.
    """
    if cap < 0 or int(cap) != cap:
        raise ValueError(f"the cap must be a whole number of steps, not {cap}")
    tiles = tiles.withColumn("_source", F.coalesce(source, F.lit(False)))
    across = [F.max("_source").over(row_window().rowsBetween(-d, d)).alias(f"_a{d}") for d in range(cap)]
    tiles = unblocked(blocked(tiles, "x", cap).select("*", *across))
    down = [F.max(f"_a{d}").over(column_window().rowsBetween(-d, d)).alias(f"_b{d}") for d in range(cap)]
    tiles = unblocked(blocked(tiles, "y", cap).select("*", *down))
    out = F.lit(cap)
    for d in reversed(range(cap)):
        out = F.when(F.col(f"_b{d}"), F.lit(d)).otherwise(out)
    return tiles.withColumn(name, out.cast("int")).drop("_source", *[f"_{k}{d}" for k in "ab" for d in range(cap)])


def neighbour_pairs(tiles: DataFrame, columns: list[str], steps: dict[str, tuple[int, int]] = RING) -> DataFrame:
    """(grid_id, x, y, dir, columns of the neighbour) of tiles that may be sparse, by an equi-join on coordinates.

    Every tile offers itself to its up to eight neighbours' places, so the join needs no condition beyond equality.
    """
    offers = F.explode(F.array(*[F.struct(F.lit(name).alias("dir"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for name, (dx, dy) in steps.items()]))
    theirs = tiles.select(*KEYS, F.struct(*columns).alias("other")).withColumn("o", offers)
    theirs = theirs.select("grid_id", (F.col("x") - F.col("o.dx")).alias("x"), (F.col("y") - F.col("o.dy")).alias("y"), F.col("o.dir").alias("dir"), "other")
    return tiles.select(*KEYS).join(theirs, KEYS)


def numbered(rows: DataFrame, coarse: Column, order: list[Column], name: str, most: int | None = None) -> DataFrame:
    """Adds name: a row's place, from 0, among those of its grid by coarse, then order; of the first `most` places if given.

    Rows are counted by coarse values, whose running sums say where each value's places begin; within a value, rows are
    sorted. So a grid is as many tasks as it has coarse values, and only their counts meet in one.
    """
    rows = settled(rows.withColumn("_coarse", coarse))
    starts = rows.groupBy("grid_id", "_coarse").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.partitionBy("grid_id").orderBy("_coarse")) - F.col("_n")).drop("_n")
    if most is not None:
        starts = starts.where(F.col("_start") < most)
    within = Window.partitionBy("grid_id", "_coarse").orderBy(*order)
    out = rows.join(starts.hint("merge"), ["grid_id", "_coarse"]).withColumn(name, (F.col("_start") + F.row_number().over(within) - 1).cast("int")).drop("_coarse", "_start")
    return out if most is None else out.where(F.col(name) < most)


def non_playable(width: int, height: int, inset: int) -> Column:
    if inset <= 0:
        return F.lit(False)
    return (F.col("x") < inset) | (F.col("y") < inset) | (F.col("x") >= width - inset) | (F.col("y") >= height - inset)


def grid_dimensions(tiles: DataFrame) -> DataFrame:
    """width and height: the largest non-negative coordinates plus one, 0 without any."""
    side = lambda c: (F.coalesce(F.max(F.when(F.col(c) >= 0, F.col(c))), F.lit(-1)) + 1).cast("int")
    return tiles.agg(side("x").alias("width"), side("y").alias("height"))
