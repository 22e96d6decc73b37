"""Biome regions of tiles that may be sparse: components of equal biome, their summaries and enclosures.

Tiles are cut into square blocks. A kernel labels each block on its own, so only what meets across the blocks' rims is left
to rounds of joins; borders are looked up in blocks that hold copies of the tiles around them. Joins here are merged: files
of labels are so small, for their rows, that Spark would send whole grids through the driver to broadcast them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InputError
from ..functions.storage import discard, settled
from .graph import labelled
from .grid import KEYS, RING, numbered

#: Tiles along a block's side; a task holds one block.
SIDE = 512
_NONE, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def checked(tiles: DataFrame) -> DataFrame:
    """tiles, if no coordinate is there twice and no biome is missing."""
    if not tiles.where(F.col("biome").isNull() | F.col("x").isNull() | F.col("y").isNull()).isEmpty():
        raise InputError("a tile has no biome or no coordinates")
    if not tiles.groupBy(*KEYS).count().where("count > 1").isEmpty():
        raise InputError("a coordinate is there twice")
    return tiles


def _block(axis: str) -> Column:
    return F.floor(F.col(axis) / SIDE)


def _joined(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of nodes 0 to size and edges (a, b)."""
    label = np.arange(size)
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != (up := label[label])).any():
            label = up
    return label


def _local(tiles: pa.Table) -> pa.Table:
    """A block's tiles with fx and fy: the first tile, in row order, of their component inside the block."""
    x, y = (tiles[c].to_numpy().astype(np.int64) for c in ("x", "y"))
    left, top = x.min() - 1, y.min() - 1
    wide = int(x.max() - left) + 2
    at = (y - top) * wide + x - left
    size = (int(y.max() - top) + 2) * wide
    kind = np.full(size, -1)
    kind[at] = pa.concat_arrays(tiles["biome"].chunks).dictionary_encode().indices.to_numpy()
    near = [(at[same], at[same] + step) for step in (1, wide - 1, wide, wide + 1) if (same := kind[at] == kind[at + step]).any()]
    a, b = (np.concatenate([np.empty(0, np.int64), *ends]) for ends in (zip(*near, strict=True) if near else ((), ())))
    first = _joined(size, a, b)[at]
    return tiles.append_column("fx", pa.array(first % wide + left)).append_column("fy", pa.array(first // wide + top))


def _across(local: DataFrame) -> DataFrame:
    """Edges (grid_id, a, b), in both directions, between the blocks' components that touch across a rim."""
    on_rim = lambda axis: F.pmod(F.col(axis), F.lit(SIDE)).isin(0, SIDE - 1)
    rim = local.where(on_rim("x") | on_rim("y")).select(*KEYS, "biome", F.struct(F.col("fy").alias("y"), F.col("fx").alias("x")).alias("b"))
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in RING.values()]))
    offers = rim.select("grid_id", "biome", F.col("b").alias("a"), _block("x").alias("bx"), _block("y").alias("by"), "x", "y", steps.alias("o"))
    offers = offers.withColumn("x", F.col("x") + F.col("o.dx")).withColumn("y", F.col("y") + F.col("o.dy")).where((_block("x") != F.col("bx")) | (_block("y") != F.col("by")))
    return offers.join(rim.hint("merge"), [*KEYS, "biome"]).select("grid_id", "a", "b").distinct()


def with_regions(tiles: DataFrame) -> DataFrame:
    """Adds region: 8-way components of equal biome, numbered from 0 by their first tile in row order."""
    narrow = tiles.select(*KEYS, "biome")
    schema = T.StructType([*narrow.schema, T.StructField("fx", T.LongType()), T.StructField("fy", T.LongType())])
    local = settled(narrow.groupBy("grid_id", _block("x").alias("bx"), _block("y").alias("by")).applyInArrow(_local, schema), "blocks")
    edges = settled(_across(local))
    labels = labelled(edges.select("grid_id", F.col("a").alias("node")).distinct(), edges)
    discard(edges)
    parts = local.where("x = fx and y = fy").select("grid_id", F.struct(F.col("fy").alias("y"), F.col("fx").alias("x")).alias("node"))
    parts = settled(parts.join(labels.hint("merge"), ["grid_id", "node"], "left").select("grid_id", "node", F.coalesce("label", "node").alias("label")))
    ids = numbered(parts.where("node = label").select("grid_id", "label"), F.col("label.y"), [F.col("label")], "region")
    named = parts.join(ids.hint("merge"), ["grid_id", "label"]).select("grid_id", F.col("node.x").alias("fx"), F.col("node.y").alias("fy"), "region")
    found = local.join(named.hint("merge"), ["grid_id", "fx", "fy"]).select(*KEYS, "biome", "region")
    if set(tiles.columns) == set(narrow.columns):
        return found.select(*tiles.columns, "region")
    return tiles.join(found.drop("biome").hint("merge"), KEYS)


def region_shapes(tiles: DataFrame) -> DataFrame:
    """Per region: biome, tile_count and box."""
    return tiles.groupBy("grid_id", "region").agg(
        F.min("biome").alias("biome"), F.count(F.lit(1)).alias("tile_count"),
        F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"),
    )


def _borders(side: int) -> Callable:
    """Of each region in a block: whether a tile of it lacks a neighbour (open), the least and the greatest region beside it."""

    def kernel(key: tuple[pa.Scalar, ...], tiles: pa.Table) -> pa.Table:
        grid_id, bx, by = (k.as_py() for k in key)
        x, y, region = (tiles[c].to_numpy().astype(np.int64) for c in ("x", "y", "region"))
        x, y, wide = x - bx * side + 1, y - by * side + 1, side + 2
        around = np.full(wide * wide, _NONE)
        around[y * wide + x] = region
        own = (x >= 1) & (x <= side) & (y >= 1) & (y <= side)
        at, mine = (y * wide + x)[own], region[own]
        bare, lo, hi = np.zeros(len(at), bool), np.full(len(at), _MOST), np.full(len(at), _NONE)
        for dx, dy in RING.values():
            o = around[at + dy * wide + dx]
            bare |= o == _NONE
            other = (o != _NONE) & (o != mine)
            lo, hi = np.minimum(lo, np.where(other, o, _MOST)), np.maximum(hi, np.where(other, o, _NONE))
        ids, of = np.unique(mine, return_inverse=True)
        least, most = np.full(len(ids), _MOST), np.full(len(ids), _NONE)
        np.minimum.at(least, of, lo)
        np.maximum.at(most, of, hi)
        alone = least == _MOST
        return pa.table({"grid_id": pa.array([grid_id] * len(ids), pa.int64()), "region": ids, "open": np.bincount(of, bare, len(ids)) > 0, "lo": pa.array(least, mask=alone), "hi": pa.array(most, mask=alone)})

    return kernel


def region_parents(tiles: DataFrame) -> DataFrame:
    """Per region its parent: the one region around it, if it does not touch the outside.

    The outside is beyond the box of all tiles, or a missing tile.
    """
    at = lambda axis: F.pmod(F.col(axis), F.lit(SIDE))
    blocks = lambda axis: F.filter(F.array(_block(axis), F.when(at(axis) == 0, _block(axis) - 1), F.when(at(axis) == SIDE - 1, _block(axis) + 1)), lambda b: b.isNotNull())
    kind = tiles.schema["region"].dataType
    there = tiles.select(*KEYS, "region", F.explode(blocks("x")).alias("bx")).withColumn("by", F.explode(blocks("y")))
    beside = there.groupBy("grid_id", "bx", "by").applyInArrow(_borders(SIDE), "grid_id long, region long, open boolean, lo long, hi long")
    beside = beside.groupBy("grid_id", F.col("region").cast(kind).alias("region")).agg(F.max("open").alias("open"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return beside.select("grid_id", "region", F.when(~F.col("open") & (F.col("lo") == F.col("hi")), F.col("lo")).cast(kind).alias("parent"))


def region_summary(tiles: DataFrame) -> DataFrame:
    """Per region: biome, tile_count, box and parent."""
    whole = region_shapes(tiles).join(region_parents(tiles).hint("merge"), ["grid_id", "region"])
    return whole.select("grid_id", "region", "biome", "tile_count", "min_x", "min_y", "max_x", "max_y", "parent")
