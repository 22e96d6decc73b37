"""Run parameters: defaults, merging, and checks with hints."""

from __future__ import annotations

import copy
import json
import os
import re
from functools import reduce
from typing import Any

from ..errors import FileError, InputError

#: Default parameters. Fixed values.
DEFAULTS: dict[str, Any] = {
    "grid": {"playableInset": 1},
    "heightNoise": {"octaves": 5, "baseFrequency": 0.035, "lacunarity": 2.0, "persistence": 0.5},
    "roughnessNoise": {"octaves": 3, "baseFrequency": 0.06, "lacunarity": 2.0, "persistence": 0.55},
    "vegVarianceNoise": {"octaves": 4, "baseFrequency": 0.045, "lacunarity": 2.0, "persistence": 0.5, "strength": 0.12},
    "landform": {"eps": 0.005, "flatSlopeThreshold": 0.03},
    "hydrology": {
        "minDropThreshold": 0.0005, "tieEps": 0.000001, "streamAccumThreshold": 0.55, "streamMinSlopeThreshold": 0.01, "lakeFlatSlopeThreshold": 0.03,
        "lakeAccumThreshold": 0.65, "lakeGrowSteps": 0, "lakeGrowHeightDelta": 0.01, "moistureAccumStart": 0.35, "flatnessThreshold": 0.06, "waterProxMaxDist": 6,
        "weights": {"accum": 0.55, "flat": 0.25, "prox": 0.2}, "marshMoistureThreshold": 0.78, "marshSlopeThreshold": 0.04,
    },
    "ground": {
        "peatMoistureThreshold": 0.7, "standingWaterMoistureThreshold": 0.78, "standingWaterSlopeMax": 0.04, "lichenMoistureMax": 0.35,
        "exposedSandMoistureMax": 0.4, "bedrockHeightMin": 0.75, "bedrockRoughnessMin": 0.55,
    },
    "roughnessFeatures": {
        "obstructionMoistureMix": 0.15, "windthrowThreshold": 0.7, "fallenLogThreshold": 0.45, "rootTangleMoistureThreshold": 0.6,
        "boulderHeightMin": 0.7, "boulderRoughnessMin": 0.6,
    },
    "movement": {
        "steepBlockDelta": 0.22, "steepDifficultDelta": 0.12, "cliffSlopeMin": 0.18, "moveCostObstructionMax": 1.35, "moveCostMoistureMax": 1.25,
        "marshMoveCostMultiplier": 1.15, "openBogMoveCostMultiplier": 1.2,
    },
    "visibility": {"base": 40, "densityPenalty": 28, "obstructionPenalty": 10, "elevationBonus": 6, "minMeters": 8, "maxMeters": 60},
    "orientation": {
        "min": 0.25, "max": 0.95, "densityWeight": 0.45, "obstructionWeight": 0.2, "wetnessWeight": 0.15, "wetnessStart": 0.6, "wetnessRange": 0.4, "ridgeBonus": 0.1,
    },
    "gameTrails": {
        "diagWeight": 1.41421356237, "inf": 1000000000, "wSlope": 4.0, "slopeScale": 0.18, "wMoist": 3.0, "moistStart": 0.55, "wObs": 2.0, "wRidge": 0.35,
        "wStreamProx": 0.25, "streamProxMaxDist": 5, "wCross": 0.65, "wMarsh": 1.25, "waterSeedMaxDist": 6, "seedTilesPerTrail": 450,
        "streamEndpointAccumThreshold": 0.7, "ridgeEndpointMaxSlope": 0.12, "gameTrailMoveCostMultiplier": 0.85,
    },
}
#: A key that older files put at the top.
OLD_STRENGTH = "vegVarianceStrength"
#: Keys of a file that holds a whole run: the parameters, sides and seed, where things are, and whether to overwrite.
PATHS = ("mapHPath", "mapRPath", "mapVPath", "outputFile", "outputDir", "debugOutputFile")
WRAPPER = ("seed", "width", "height", "params", *PATHS, "force")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def suggestion(name: str, known: list[str], most: int = 3) -> str | None:
    """The first of the closest known names, if it is at most three edits away."""
    near = min(known, key=lambda k: edit_distance(name, k), default=None)
    return near if near is not None and edit_distance(name, near) <= most else None


def merged(base: dict, over: dict) -> dict:
    """base with the values of over; objects merge, everything else is replaced."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def check_keys(given: dict, known: dict, at: str = "params", also: tuple[str, ...] = ()) -> None:
    for k, v in given.items():
        if k in also:
            continue
        if k not in known:
            near = suggestion(k, [*known, *also])
            raise InputError(f"unknown key {at}.{k}" + (f"; did you mean {near}?" if near else ""))
        if isinstance(known[k], dict):
            if not isinstance(v, dict):
                raise InputError(f"{at}.{k} must be an object")
            check_keys(v, known[k], f"{at}.{k}")


def resolved(given: dict) -> dict:
    """Defaults with the given parameters; the old strength key holds where the nested one is not given."""
    check_keys(given, DEFAULTS, also=(OLD_STRENGTH,))
    out = merged(DEFAULTS, {k: v for k, v in given.items() if k != OLD_STRENGTH})
    if OLD_STRENGTH in given and "strength" not in given.get("vegVarianceNoise", {}):
        out["vegVarianceNoise"]["strength"] = given[OLD_STRENGTH]
    return out


def seed_of(text: str) -> int:
    if not isinstance(text, str) or not re.fullmatch("[0-9]+", text) or int(text) >= 1 << 64:
        raise InputError("the seed must be a whole number from 0 to 2^64 - 1, as decimal digits")
    return int(text)


def side_of(value: Any, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise InputError(f"{name} must be a positive whole number")
    return value


def read_params(path: str, base: str = ".") -> tuple[dict, dict]:
    """(params, run settings) of a JSON file, bare or wrapped; its own path starts at base, paths in it at its folder.

    A file is a wrapper if any of a wrapper's keys is there. Settings of a wrong type are as if not given: a seed counts
    only as text, sides as numbers, paths as text, force as true or false.
    """
    full = os.path.join(base, path)
    try:
        with open(full, encoding="utf-8") as f:
            data = json.load(f)
    except OSError as e:
        raise FileError(f"cannot read {full}: {e.strerror}") from e
    except ValueError as e:
        raise InputError(f"{full} is not JSON: {e}") from e
    if not isinstance(data, dict):
        raise InputError("a parameter file must hold an object")
    run: dict = {}
    if any(k in data for k in WRAPPER):
        check_keys(data, dict.fromkeys(WRAPPER), "file")
        right = lambda k: isinstance(data[k], bool) if k == "force" else isinstance(data[k], (int, float)) and not isinstance(data[k], bool) if k in ("width", "height") else isinstance(data[k], str)
        run = {k: data[k] for k in WRAPPER if k != "params" and k in data and right(k)}
        run |= {k: os.path.join(os.path.dirname(os.path.abspath(full)), run[k]) for k in PATHS if k in run}
        data = data.get("params", {})
        if not isinstance(data, dict):
            raise InputError("params must be an object")
    check_keys(data, DEFAULTS, also=(OLD_STRENGTH,))
    return data, run


def combined(*layers: dict | None) -> dict:
    """Later layers win."""
    return reduce(merged, [x for x in layers if x], {})
