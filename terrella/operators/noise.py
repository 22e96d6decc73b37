"""Gradient noise as a vectorised kernel: permutation tables are constants made on the driver, a batch is a few array passes."""

from __future__ import annotations

import math
from numbers import Real

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.columns import f32
from ..functions.rng import permutation

#: Gradients by the low three bits of a hash. Fixed values.
GRADIENTS = ((1, 1), (-1, 1), (1, -1), (-1, -1), (1, 0), (-1, 0), (0, 1), (0, -1))
SETTINGS = {"h": "heightNoise", "r": "roughnessNoise", "v": "vegVarianceNoise"}


_GX, _GY = (np.array([float(g[i]) for g in GRADIENTS]) for i in (0, 1))


def gradient_noise(x: np.ndarray, y: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Noise at points, in [-1, 1]: quintic blend of four lattice gradients, over the root of two."""
    dot = lambda h, dx, dy: _GX[h & 7] * dx + _GY[h & 7] * dy
    blend = lambda a, b, t: a + t * (b - a)
    fade = lambda t: t * t * t * (t * (t * 6 - 15) + 10)
    cell_x, cell_y = np.floor(x), np.floor(y)
    xi, yi = np.mod(cell_x, 256).astype(np.int64), np.mod(cell_y, 256).astype(np.int64)
    xf, yf = x - cell_x, y - cell_y
    left, right = table[xi] + yi, table[xi + 1] + yi
    u, v = fade(xf), fade(yf)
    top = blend(dot(table[left], xf, yf), dot(table[right], xf - 1, yf), u)
    bottom = blend(dot(table[left + 1], xf, yf - 1), dot(table[right + 1], xf - 1, yf - 1), u)
    return np.clip(blend(top, bottom, v) / math.sqrt(2), -1.0, 1.0)


def settings(params: dict, name: str) -> dict:
    own = params.get(SETTINGS[name])
    if not isinstance(own, dict):
        raise InputError(f"{SETTINGS[name]} must be an object")
    for key in ("octaves", "baseFrequency", "lacunarity", "persistence"):
        v = own.get(key)
        if not isinstance(v, Real) or isinstance(v, bool) or not math.isfinite(v):
            raise InputError(f"{SETTINGS[name]}.{key} must be a finite number")
    if own["octaves"] != int(own["octaves"]) or own["octaves"] < 1:
        raise InputError(f"{SETTINGS[name]}.octaves must be a positive whole number")
    return own


def base_map(seed: int, name: str, params: dict) -> Column:
    """One of h, r, v: octaves of noise, summed in order, brought to [0, 1] and rounded to 32 bits."""
    own = settings(params, name)
    tables = [np.array(permutation(seed, name, octave)) for octave in range(int(own["octaves"]))]
    frequency, lacunarity, persistence = float(own["baseFrequency"]), own["lacunarity"], own["persistence"]

    @F.pandas_udf("double")
    def mapped(x: pd.Series, y: pd.Series) -> pd.Series:
        at_x, at_y = (c.to_numpy(float, na_value=np.nan) for c in (x, y))
        there = np.isfinite(at_x) & np.isfinite(at_y)
        total, weight, scale, amplitude = np.zeros(int(there.sum())), 0.0, frequency, 1.0
        for table in tables:
            total = total + gradient_noise(at_x[there] * scale, at_y[there] * scale, table) * amplitude
            weight += amplitude
            scale *= lacunarity
            amplitude *= persistence
        out = np.full(len(at_x), np.nan)
        out[there] = np.clip((total / weight + 1) / 2, 0.0, 1.0).astype(np.float32)
        return pd.Series(out)

    return mapped(F.col("x"), F.col("y"))


def with_base_maps(tiles: DataFrame, seed: int, params: dict, authored: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds h, r and v; an authored raster (grid_id, x, y, value) takes the place of a map's noise."""
    authored = authored or {}
    for name in SETTINGS:
        if name in authored:
            own = authored[name].select("grid_id", "x", "y", f32(F.col("value").cast("double")).alias(name))
            tiles = tiles.join(own, ["grid_id", "x", "y"], "left")
        else:
            tiles = tiles.withColumn(name, base_map(seed, name, params))
    return tiles
