"""Queries about descriptions: neighbour signals, hash picks, movement arcs, and the texts themselves."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phrases
from ..functions.columns import flag_names, pick
from ..operators import describe, ecology, navigation
from ..operators.grid import RING
from . import oracle
from .generate import nested

_GRAVE = ["windthrow", "boulder", "fallen_log", "root_tangle"]  # those of the roughness flags, gravest first


def _key():
    return F.concat_ws(",", "x", "y")


def neighbor_signals(tiles: DataFrame) -> DataFrame:
    """Per tile and direction the neighbour's biome and step in height; beyond the edge the tile itself."""
    flat = describe.signals(nested(tiles))
    whole = flat.join(describe.neighbour_signals(flat), ["grid_id", "x", "y"], "left")
    each = whole.select("x", "y", "biome", "elevation", "near", F.explode(F.array(*map(F.lit, RING))).alias("dir"))
    other = F.try_element_at("near", F.col("dir"))
    return each.select("x", "y", "dir", F.coalesce(other["biome"], "biome").alias("biome"), (F.coalesce(other["elevation"], "elevation") - F.col("elevation")).alias("elev_delta"))


def obstacle_pick(tiles: DataFrame) -> DataFrame:
    """The obstacle that a tile's description names, as descriptions choose it."""

    @F.pandas_udf("string")
    def chosen(flags: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([describe.chosen_obstacle(list(f), k) for f, k in zip(flags, keys, strict=True)], dtype=object)

    return tiles.select("x", "y", chosen(flag_names(F.col("features"), ecology.ROUGHNESS), _key()).alias("obstacle"))


def phrase_pick(tiles: DataFrame) -> DataFrame:
    out = F.lit(None).cast("string")
    for code, name in enumerate(ecology.BIOMES):
        out = F.when(F.col("biome") == code, pick(phrases.BIOME[name], F.concat(_key(), F.lit(f":biome:{name}")))).otherwise(out)
    return tiles.select("x", "y", out.alias("phrase"))


def movement_runs(tiles: DataFrame) -> DataFrame:
    """How many ways lead out of a tile, and how many arcs of open and of closed directions it has, as descriptions see them."""

    @F.pandas_udf("exits int, passages int, blockages int")
    def counted(ways: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for way in ways.to_dict("records"):
            runs = describe.movement_runs(way)
            open_ = [r["directions"] for r in runs if r["type"] == "passage"]
            rows.append((sum(map(len, open_)), len(open_), len(runs) - len(open_)))
        return pd.DataFrame(rows, columns=["exits", "passages", "blockages"]).astype("int32")

    return tiles.select("x", "y", counted(navigation.unpacked(F.col("pass_packed"))).alias("c")).select("x", "y", "c.*")


def described(tiles: DataFrame) -> DataFrame:
    return describe.describe(nested(tiles)).select("x", "y", "description", "debug")


def queries(nav: Callable, kept: Callable) -> dict[str, Callable]:
    of = lambda f: lambda spark, sf_dir: f(nav(spark, sf_dir))
    return {"neighbor_signals": of(neighbor_signals), "obstacle_pick": of(obstacle_pick), "phrase_pick": of(phrase_pick), "movement_runs": of(movement_runs), "described_tiles": of(described)}


def oracles(sql: Callable[[str], str]) -> dict[str, str]:
    grave = "list_filter([" + ", ".join(f"CASE WHEN features & {1 << ecology.ROUGHNESS.index(n)} <> 0 THEN '{n}' END" for n in _GRAVE) + "], lambda z: z IS NOT NULL)"
    lots = "list_filter([g[1], g[1], g[1], g[2], g[2], g[3]], lambda z: z IS NOT NULL)"
    hashed = oracle._fnv("(x || ',' || y || ':obstacle:key')")
    pools = " ".join(f"WHEN {code} THEN {oracle.pick(phrases.BIOME[name], f"(x || ',' || y || ':biome:{name}')")}" for code, name in enumerate(ecology.BIOMES))
    return {
        "neighbor_signals": sql(f"SELECT a.x, a.y, dir, ({ecology.BIOMES})[coalesce(b.biome, a.biome) + 1] AS biome, coalesce(b.h, a.h) - a.h AS elev_delta FROM eco a CROSS JOIN ring LEFT JOIN eco b ON b.x = a.x + dx AND b.y = a.y + dy"),
        "obstacle_pick": sql(f"SELECT x, y, CASE WHEN len(l) > 0 THEN l[({hashed} % greatest(len(l), 1))::INTEGER + 1] END AS obstacle FROM (SELECT x, y, {lots} AS l FROM (SELECT x, y, {grave} AS g FROM eco))"),
        "phrase_pick": sql(f"SELECT x, y, CASE biome {pools} END AS phrase FROM eco"),
        "movement_runs": sql("SELECT x, y, exits::INTEGER AS exits, (CASE WHEN exits = 8 THEN 1 ELSE starts END)::INTEGER AS passages, (CASE WHEN exits = 0 THEN 1 ELSE starts END)::INTEGER AS blockages FROM (SELECT x, y, count(*) FILTER (code = 0) AS exits, count(*) FILTER (code = 0 AND prev <> 0) AS starts FROM (SELECT p.*, q.code AS prev FROM passable p JOIN passable q ON q.x = p.x AND q.y = p.y AND q.i = (p.i + 7) % 8) GROUP BY x, y)"),
    }
