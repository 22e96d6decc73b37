"""Tile envelopes: JSON documents of meta, optional regions and tiles, read into tile rows and checked."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FileError, InputError

_WAYS = ",".join(f"{d}:string" for d in ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))
TILE = (
    "x int, y int,"
    "topography struct<h:double,r:double,v:double,slopeMag:double,aspectDeg:double,landform:string>,"
    "hydrology struct<fd:int,fa:bigint,faN:double,lakeMask:boolean,isStream:boolean,distWater:int,moisture:double,waterClass:string>,"
    "ecology struct<biome:string,treeDensity:double,canopyCover:double,dominant:array<string>,ground:struct<soil:string,firmness:double,surfaceFlags:array<string>>,roughness:struct<obstruction:double,featureFlags:array<string>>>,"
    f"navigation struct<moveCost:double,followable:array<string>,passability:struct<{_WAYS}>,gameTrailId:int>,"
    "region struct<biomeRegionId:int>"
)
_STRUCTURE = "struct<" + TILE.replace("x int, y int", "x:int,y:int").replace(" struct<", ":struct<") + ">"
GROUPS = ("topography", "hydrology", "ecology", "navigation")


def read_document(path: str) -> dict:
    """The whole document on the driver, with its structure checked: for single files that a person or a tool wrote."""
    if not path.endswith(".json"):
        raise InputError(f"{path} is not a .json file")
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
    except OSError as e:
        raise FileError(f"cannot read {path}: {e.strerror}") from e
    except ValueError as e:
        raise InputError(f"{path} is not JSON: {e}") from e
    if not isinstance(data, dict) or not isinstance(data.get("meta"), dict) or not isinstance(data["meta"].get("specVersion"), str):
        raise InputError("an envelope needs meta.specVersion")
    if not isinstance(data.get("tiles"), list):
        raise InputError("an envelope needs an array of tiles")
    whole = lambda v: isinstance(v, int) and not isinstance(v, bool)
    for i, t in enumerate(data["tiles"]):
        if not isinstance(t, dict) or not whole(t.get("x")) or not whole(t.get("y")):
            raise InputError(f"tiles[{i}] needs whole x and y")
        for g in GROUPS:
            if not isinstance(t.get(g), dict):
                raise InputError(f"tiles[{i}].{g} must be an object")
    for i, r in enumerate(data.get("regions") or []):
        box = r.get("bbox") if isinstance(r, dict) else None
        if not isinstance(box, dict) or not all(whole(box.get(k)) for k in ("minX", "minY", "maxX", "maxY")) or not whole(r.get("id")) or not whole(r.get("tileCount")) or not isinstance(r.get("biome"), str):
            raise InputError(f"regions[{i}] is malformed")
    return data


def tiles_of(spark: SparkSession, path: str, grid_id: int = 0) -> DataFrame:
    """(grid_id, pos, tile columns) of an envelope file that Spark reads; pos keeps the order."""
    raw = spark.read.schema(f"tiles array<{_STRUCTURE}>").json(path, multiLine=True)
    return raw.select(F.lit(grid_id).cast("long").alias("grid_id"), F.posexplode("tiles").alias("pos", "t")).select("grid_id", "pos", "t.*")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Tiles as JSON lines, one a row, with grid_id: the form for many or large grids."""
    return spark.read.schema("grid_id bigint, " + TILE).json(path)
