"""Game trails: preference cost, seeds, endpoints, least-cost routes and marking."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InputError
from ..functions.columns import clamp01, f32
from ..functions.storage import settled
from .grid import DIR8, box_distance, index, non_playable, numbered

KINDS = ["seed_to_water", "seed_to_ridge"]
#: Routes of a grid go to so many tasks, each of which holds the grid's cost field once.
ROUTE_PARTS = 4


def capped(v: float) -> int:
    return max(0, math.floor(v))


def moisture_term(params: dict) -> Column:
    own = params["gameTrails"]
    room, m = 1 - own["moistStart"], F.col("moisture")
    if room <= 0:
        return F.when(m > own["moistStart"], F.lit(float(own["wMoist"]))).otherwise(F.lit(0.0))
    return F.lit(float(own["wMoist"])) * clamp01((m - own["moistStart"]) / F.lit(room))


def with_trail_cost(tiles: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    """trail_cost: what a trail would pay for a tile; terms are added in a fixed order and the sum kept in 32 bits."""
    own = params["gameTrails"]
    tiles = box_distance(tiles, F.col("stream"), capped(own["streamProxMaxDist"]), "_dist_stream")
    at = lambda code: F.col("water") == code
    term = lambda test, w: F.when(test, F.lit(float(w))).otherwise(F.lit(0.0))
    slope = F.lit(float(own["wSlope"])) * clamp01(F.col("slope") / F.lit(max(own["slopeScale"], 2.0**-52)))
    close = F.lit(0.0)
    if own["streamProxMaxDist"] > 0:
        close = F.lit(-float(own["wStreamProx"])) * clamp01(F.lit(1.0) - F.col("_dist_stream") / F.lit(float(own["streamProxMaxDist"])))
    cost = F.lit(1.0) + slope + moisture_term(params) + F.col("obstruction") * float(own["wObs"]) + term(at(2), own["wCross"]) + term(at(3), own["wMarsh"]) + term(at(1), own["inf"])
    cost = cost + term(non_playable(width, height, params["grid"]["playableInset"]), own["inf"]) + term(F.col("landform") == 2, -own["wRidge"]) + close
    return tiles.withColumn("trail_cost", f32(cost)).drop("_dist_stream")


def seed_count(params: dict, width: int, height: int) -> int:
    inset = capped(params["grid"]["playableInset"])
    area = max(0, (width - 2 * inset) * (height - 2 * inset))
    return max(1, area // max(1, math.floor(params["gameTrails"]["seedTilesPerTrail"])))


def scored_seeds(tiles: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    """Tiles where a trail may start, with score."""
    most = capped(params["gameTrails"]["waterSeedMaxDist"])
    tiles = box_distance(tiles, F.col("water").isin(1, 2), most, "_dist")
    m = F.col("moisture")
    near = clamp01(F.lit(1.0) - F.col("_dist") / F.lit(float(params["gameTrails"]["waterSeedMaxDist"]))) if most > 0 else F.lit(0.0)
    score = clamp01((F.col("firmness") - 0.35) / F.lit(0.65)) * 0.35 + clamp01(F.lit(1.0) - F.abs(m - 0.55) / F.lit(0.55)) * 0.25 + clamp01(F.lit(1.0) - F.col("slope") / F.lit(0.25)) * 0.2 + near * 0.2
    fit = ~non_playable(width, height, params["grid"]["playableInset"]) & (F.col("water") != 1) & (m < 0.92) & (F.col("slope") < 0.3)
    return tiles.where(fit).withColumn("score", score).drop("_dist")


def trail_seeds(tiles: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    """(grid_id, x, y, score, seed_rank from 0): the best seeds of each grid, ties by row then column."""
    scored = scored_seeds(tiles, params, width, height).select("grid_id", "x", "y", "score")
    return numbered(scored, -F.floor(F.col("score") * 4096), [F.desc("score"), F.col("y"), F.col("x")], "seed_rank", seed_count(params, width, height))


def nearest(points: DataFrame, candidates: DataFrame, width: int, height: int) -> DataFrame:
    """points with end (row-major index) of the nearest candidate by Chebyshev distance, ties to the smaller index.

    Candidates lie in square cells; a point asks the nine cells around it, by equality of cells, and what it finds within
    a cell's width is nearest for sure. Points that found nothing so near ask again with cells twice as wide.
    """
    side, left, done = 8, settled(points), None
    spots = settled(candidates.select("grid_id", "x", "y"))
    while True:
        whole = side >= max(width, height)
        cell = lambda c, s=side: F.floor(F.col(c) / s)
        held = spots.select("grid_id", cell("x").alias("_cx"), cell("y").alias("_cy"), F.col("x").alias("_x"), F.col("y").alias("_y"))
        around = F.explode(F.array(*[F.struct((cell("x") + dx).alias("x"), (cell("y") + dy).alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
        asked = left.withColumn("_c", around).withColumn("_cx", F.col("_c.x")).withColumn("_cy", F.col("_c.y")).drop("_c")
        far = F.greatest(F.abs(F.col("x") - F.col("_x")), F.abs(F.col("y") - F.col("_y")))
        place = F.col("_y").cast("long") * width + F.col("_x")
        best = asked.join(held, ["grid_id", "_cx", "_cy"]).groupBy("grid_id", "x", "y").agg(F.min(F.struct(far.alias("d"), place.alias("end"))).alias("_best"))
        sure = best if whole else best.where(F.col("_best.d") <= side)
        found = left.join(sure.select("grid_id", "x", "y", F.col("_best.end").alias("end")), ["grid_id", "x", "y"])
        done = found if done is None else done.unionByName(found)
        if whole:
            return done
        left = settled(left.join(sure.select("grid_id", "x", "y"), ["grid_id", "x", "y"], "left_anti"))
        if left.isEmpty():
            return done
        side *= 2


def route_requests(tiles: DataFrame, seeds: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    """(grid_id, route_seq, kind, seed, end): for each seed the way to water, then to a ridge, where there is one."""
    own = params["gameTrails"]
    streams = tiles.where((F.col("water") == 2) & (F.col("fa_norm") >= own["streamEndpointAccumThreshold"]))
    ridges = tiles.where((F.col("landform") == 2) & (F.col("slope") < own["ridgeEndpointMaxSlope"]))
    seeds = settled(seeds)
    both = None
    for n, (kind, ends) in enumerate(zip(KINDS, (streams, ridges), strict=True)):
        one = nearest(seeds, ends, width, height).select("grid_id", (F.col("seed_rank") * 2 + n).alias("route_seq"), F.lit(kind).alias("kind"), index(width).alias("seed"), "end")
        both = one if both is None else both.unionByName(one)
    return both


class _Open:
    """A frontier entry: cheaper first, costs within eps by index, then by the step that led there."""

    __slots__ = ("cost", "eps", "index", "step")

    def __init__(self, cost: float, index_: int, step: int, eps: float) -> None:
        self.cost, self.index, self.step, self.eps = cost, index_, step, eps

    def __lt__(self, other: _Open) -> bool:
        if abs(self.cost - other.cost) > self.eps:
            return self.cost < other.cost
        return (self.index, self.step) < (other.index, other.step)


def least_cost_path(cost: np.ndarray, width: int, start: int, end: int, diagonal: float, infinite: float, eps: float) -> list[int] | None:
    """Dijkstra on eight neighbours; a step costs its destination, times the diagonal weight. None if there is no way."""
    size = len(cost)
    if not (0 <= start < size and 0 <= end < size):
        raise InputError(f"route endpoint out of bounds: {start}, {end} of {size}")
    if cost[start] >= infinite or cost[end] >= infinite:
        return None
    height = size // width
    best = {start: 0.0}
    before: dict[int, int] = {}
    frontier = [_Open(0.0, start, -1, eps)]
    while frontier:
        here = heapq.heappop(frontier)
        if here.cost > best[here.index] + eps:
            continue
        if here.index == end:
            path = [end]
            while path[-1] != start:
                path.append(before[path[-1]])
            return path[::-1]
        y, x = divmod(here.index, width)
        for step, (dx, dy) in enumerate(DIR8):
            if not (0 <= x + dx < width and 0 <= y + dy < height):
                continue
            there = (y + dy) * width + x + dx
            if cost[there] >= infinite:
                continue
            new = best[here.index] + cost[there] * (1.0 if dx == 0 or dy == 0 else diagonal)
            if new < best.get(there, math.inf) - eps:
                best[there] = new
                before[there] = here.index
                heapq.heappush(frontier, _Open(new, there, step, eps))
    return None


def routed(tiles: DataFrame, requests: DataFrame, params: dict, width: int, height: int, parts: int = ROUTE_PARTS) -> DataFrame:
    """(grid_id, route_seq, step, idx) of the paths that exist; idx is row-major.

    The cost field never changes while routing, so routes run apart: a grid's requests are dealt to `parts` tasks, each of
    which gets the grid's costs (one number a tile) once.
    """
    own, eps = params["gameTrails"], float(params["hydrology"]["tieEps"])
    diagonal, infinite = float(own["diagWeight"]), float(own["inf"])
    costs = tiles.select("grid_id", index(width).alias("idx"), "trail_cost").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = requests.withColumn("part", (F.col("route_seq") % parts).cast("int"))

    def kernel(field: pd.DataFrame, own_routes: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, int]] = []
        if len(own_routes):
            cost = np.full(width * height, infinite)
            cost[field["idx"].to_numpy()] = field["trail_cost"].to_numpy()
            for r in own_routes.itertuples():
                path = least_cost_path(cost, width, int(r.seed), int(r.end), diagonal, infinite, eps)
                out += [(r.grid_id, r.route_seq, i, idx) for i, idx in enumerate(path or [])]
        return pd.DataFrame(out, columns=["grid_id", "route_seq", "step", "idx"])

    run: Callable = kernel
    return costs.groupBy("grid_id", "part").cogroup(asked.groupBy("grid_id", "part")).applyInPandas(run, "grid_id long, route_seq long, step long, idx long")


def trail_marks(paths: DataFrame) -> DataFrame:
    """(grid_id, idx, trail_id): tiles on any path, with the first route's number among those that found a way."""
    order = Window.partitionBy("grid_id").orderBy("route_seq")
    ids = paths.select("grid_id", "route_seq").distinct().withColumn("trail_id", F.row_number().over(order) - 1)
    return paths.join(ids, ["grid_id", "route_seq"]).groupBy("grid_id", "idx").agg(F.min("trail_id").alias("trail_id"))


def with_trails(tiles: DataFrame, params: dict, width: int, height: int) -> DataFrame:
    """Adds trail_cost, trail (boolean) and trail_id (-1: none)."""
    if params["gameTrails"].get("postProcessEnabled") or params["gameTrails"].get("enablePostProcess"):
        raise InputError("trail post-processing must stay disabled")
    tiles = settled(with_trail_cost(tiles, params, width, height), "costs")
    seeds = trail_seeds(tiles, params, width, height)
    marks = trail_marks(settled(routed(tiles, route_requests(tiles, seeds, params, width, height), params, width, height), "paths"))
    joined = tiles.withColumn("idx", index(width)).join(marks, ["grid_id", "idx"], "left").drop("idx")
    return joined.withColumn("trail", F.col("trail_id").isNotNull()).withColumn("trail_id", F.coalesce("trail_id", F.lit(-1)))
