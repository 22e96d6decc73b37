"""Move cost, directional passability, cliffs and what can be followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp01, f32, flag_names, lerp
from .grid import DIR8, RING, with_neighbours

#: Names by code and by bit. Fixed values.
PASSABILITY = ["passable", "difficult", "blocked"]
FOLLOWABLE = ["stream", "ridge", "game_trail", "shore"]


def move_cost(params: dict) -> Column:
    """Factors in a fixed order; the trail's comes last."""
    own = params["movement"]
    cost = F.lit(1.0) * lerp(1.0, own["moveCostObstructionMax"], F.col("obstruction")) * lerp(1.0, own["moveCostMoistureMax"], F.col("moisture"))
    times = lambda c, test, by: F.when(test, c * F.lit(float(by))).otherwise(c)
    cost = times(cost, F.col("water") == 3, own["marshMoveCostMultiplier"])
    cost = times(cost, F.col("biome") == 0, own["openBogMoveCostMultiplier"])
    return f32(times(cost, F.col("trail"), params["gameTrails"]["gameTrailMoveCostMultiplier"]))


def with_passability(tiles: DataFrame, params: dict, width: int, height: int, lake_rule: str = "symmetric") -> DataFrame:
    """Adds pass_packed (two bits a direction, north first, clockwise) and cliff_packed (one bit).

    lake_rule "asymmetric" lets a move leave a lake; the default blocks moves that touch one either way.
    """
    own, inset = params["movement"], params["grid"]["playableInset"]
    near = with_neighbours(tiles, ["x", "y", "h", "water"])
    place = {step: i for i, step in enumerate(DIR8)}
    codes, cliffs = [], []
    for dx, dy in RING.values():
        n = F.col("near")[place[dx, dy]]
        outside = n.isNull()
        if inset > 0:
            outside = outside | (n["x"] < inset) | (n["y"] < inset) | (n["x"] >= width - inset) | (n["y"] >= height - inset)
        rise = n["h"] - F.col("h")
        steep = rise >= own["steepBlockDelta"]
        lake = n["water"] == 1
        if lake_rule == "symmetric":
            lake = lake | (F.col("water") == 1)
        bog = (F.col("moisture") >= 0.9) & (F.col("slope") < 0.03)
        codes.append(F.when(outside | lake, 2).when(bog, 1).when(steep, 2).when(rise >= own["steepDifficultDelta"], 1).otherwise(0))
        cliffs.append(F.when(~outside & steep & (F.col("slope") >= own["cliffSlopeMin"]), 1).otherwise(0))
    pack = lambda parts, bits: sum((F.call_function("shiftleft", c, F.lit(bits * i)) for i, c in enumerate(parts)), F.lit(0))
    return near.withColumn("pass_packed", pack(codes, 2)).withColumn("cliff_packed", pack(cliffs, 1)).drop("near")


def unpacked(packed: Column) -> Column:
    """struct of eight passability names by direction; the unused code counts as blocked."""
    code = lambda i: F.call_function("shiftright", packed, F.lit(2 * i)).bitwiseAND(F.lit(3))
    name = lambda c: F.when(c == 0, F.lit(PASSABILITY[0])).when(c == 1, F.lit(PASSABILITY[1])).otherwise(F.lit(PASSABILITY[2]))
    return F.struct(*[name(code(i)).alias(d) for i, d in enumerate(RING)])


def cliffs_unpacked(packed: Column) -> Column:
    return F.struct(*[(packed.bitwiseAND(F.lit(1 << i)) != 0).alias(d) for i, d in enumerate(RING)])


def with_followable(tiles: DataFrame) -> DataFrame:
    """follow: bits for stream, ridge, trail, and shore (no lake, but a lake beside it)."""
    near = with_neighbours(tiles, ["water"])
    shore = (F.col("water") != 1) & F.exists("near", lambda n: F.coalesce(n["water"] == 1, F.lit(False)))
    bits = [F.col("water") == 2, F.col("landform") == 2, F.col("trail"), shore]
    return near.withColumn("follow", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))).drop("near")


def with_navigation(tiles: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    return with_followable(with_passability(tiles.withColumn("move_cost", move_cost(params)), params, width, height))


def payload() -> Column:
    """The nested navigation value of a tile; a missing trail has a null id."""
    return F.struct(
        F.col("move_cost").alias("moveCost"),
        flag_names(F.col("follow"), FOLLOWABLE).alias("followable"),
        unpacked(F.col("pass_packed")).alias("passability"),
        F.when(F.col("trail_id") >= 0, F.col("trail_id")).alias("gameTrailId"),
    )


def invariant_violations(tiles: DataFrame) -> DataFrame:
    """One row: how many tiles break each rule of the navigation maps."""
    bad = {
        "move_cost": F.col("move_cost").isNull() | F.isnan("move_cost") | (F.abs("move_cost") == float("inf")) | (F.col("move_cost") <= 0),
        "passability": F.col("pass_packed").bitwiseAND(F.lit(0x5555)).bitwiseAND(F.call_function("shiftright", F.col("pass_packed"), F.lit(1))) != 0,
        "followable": F.col("follow").bitwiseAND(F.lit(~15)) != 0,
        "trail_id": F.col("trail_id") < -1,
    }
    return tiles.agg(*[F.count_if(test).alias(f"bad_{name}") for name, test in bad.items()])


def visibility_metres(params: dict) -> Column:
    """How far one sees; an optional column that is not part of a tile's payload."""
    own = params["visibility"]
    far = F.lit(float(own["base"])) - F.col("density") * own["densityPenalty"] - F.col("obstruction") * own["obstructionPenalty"] + F.col("h") * own["elevationBonus"]
    return F.greatest(F.lit(float(own["minMeters"])), F.least(F.lit(float(own["maxMeters"])), far))


def orientation(params: dict) -> Column:
    """How reliably one keeps a bearing; an optional column that is not part of a tile's payload."""
    own = params["orientation"]
    wet = clamp01((F.col("moisture") - own["wetnessStart"]) / F.lit(float(own["wetnessRange"])))
    ridge = F.when(F.col("landform") == 2, F.lit(float(own["ridgeBonus"]))).otherwise(F.lit(0.0))
    v = F.lit(1.0) - F.col("density") * own["densityWeight"] - F.col("obstruction") * own["obstructionWeight"] - wet * own["wetnessWeight"] + ridge
    return F.greatest(F.lit(float(own["min"])), F.least(F.lit(float(own["max"])), v))
