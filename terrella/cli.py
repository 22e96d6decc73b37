"""Command line: generate, derive, debug, assign-regions and describe."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .errors import InputError, categorised
from .operators import describe, regions
from .plans import generate
from .sinks import outputs
from .sources import envelope, params, rasters

FLAGS = ("--seed", "--width", "--height", "--params", "--map-h", "--map-r", "--map-v", "--output-file", "--output-dir", "--debug-output-file", "--input-file", "--force", "--include-structured", "--strict")


def check_flags(tokens: list[str]) -> None:
    seen = set()
    for t in tokens:
        if not t.startswith("--"):
            continue
        flag = t.split("=")[0]
        if flag not in FLAGS and flag != "--help":
            near = params.suggestion(flag, list(FLAGS))
            raise InputError(f"unknown flag {flag}" + (f"; did you mean {near}?" if near else ""))
        if flag in seen:
            raise InputError(f"{flag} is given twice")
        seen.add(flag)


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise InputError(message)


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="terrella", description=__doc__, allow_abbrev=False)
    p.add_argument("mode", choices=["generate", "derive", "debug", "assign-regions", "describe"])
    for flag in FLAGS[:-3]:
        p.add_argument(flag, type=int if flag in ("--width", "--height") else str)
    for flag in FLAGS[-3:]:
        p.add_argument(flag, action="store_true")
    return p


#: Settings of a parameter file by the argument that goes before them.
SETTINGS = {"seed": "seed", "width": "width", "height": "height", "map_h": "mapHPath", "map_r": "mapRPath", "map_v": "mapVPath", "output_file": "outputFile", "output_dir": "outputDir", "debug_output_file": "debugOutputFile"}


def check_outputs(args: argparse.Namespace) -> None:
    """Which outputs and inputs go with a mode; looked at before any work."""
    if args.mode == "debug":
        if not args.output_dir:
            raise InputError("debug needs --output-dir")
        if args.output_file:
            raise InputError("--output-file does not go with debug; --debug-output-file does")
        return
    if not args.output_file:
        raise InputError(f"{args.mode} needs --output-file")
    for flag, given in (("--output-dir", args.output_dir), ("--debug-output-file", args.debug_output_file)):
        if given:
            raise InputError(f"{flag} does not go with {args.mode}")
    if args.mode in ("assign-regions", "describe"):
        if not args.input_file:
            raise InputError(f"{args.mode} needs --input-file")
    elif args.input_file:
        raise InputError("--input-file goes with debug alone")
    if args.mode == "derive" and not args.map_h:
        raise InputError("derive needs --map-h")


def settled_arguments(args: argparse.Namespace) -> dict:
    """Fills args from the parameter file where the command line is silent, checks them, and gives the parameters."""
    given, settings = params.read_params(args.params) if args.params else ({}, {})
    if args.input_file and args.mode == "debug" and any((args.seed, args.width, args.height, args.params, args.map_h, args.map_r, args.map_v)):
        raise InputError("--input-file goes with debug alone, without inputs for generation")
    for name, key in SETTINGS.items():
        if getattr(args, name) is None:
            setattr(args, name, settings.get(key))
    args.force = args.force or settings.get("force", False)
    check_outputs(args)
    if not args.input_file:
        if args.seed is None:
            raise InputError("a seed is needed")
        args.seed = params.seed_of(args.seed)
        args.width, args.height = params.side_of(args.width, "width"), params.side_of(args.height, "height")
    return params.resolved(given)


def session() -> SparkSession:
    return SparkSession.builder.appName("terrella").getOrCreate()


def run(spark: SparkSession | None, args: argparse.Namespace) -> None:
    """Arguments are settled and checked before a session is begun, if none is given."""
    settings = settled_arguments(args)
    if args.mode in ("assign-regions", "describe"):
        companion(spark or session(), args)
        return
    if args.input_file:
        outputs.write_mode("debug", envelope.read_document(args.input_file), args.debug_output_file, args.output_dir, args.force)
        return
    spark = spark or session()
    maps = {k: rasters.read_authored(spark, p, (args.width, args.height)) for k, p in (("h", args.map_h), ("r", args.map_r), ("v", args.map_v)) if p}
    tiles = generate.generate(spark, args.seed, args.width, args.height, settings, maps)
    outputs.write_mode(args.mode, outputs.envelope(generate.nested(tiles), generate.SPEC), args.debug_output_file if args.mode == "debug" else args.output_file, args.output_dir, args.force)


def companion(spark: SparkSession, args: argparse.Namespace) -> None:
    data = envelope.read_document(args.input_file)
    tiles = envelope.tiles_of(spark, args.input_file)
    if args.mode == "describe":
        found = {(r.x, r.y): r for r in describe.describe(tiles, args.strict).collect()}
        for t in data["tiles"]:
            r = found[t["x"], t["y"]]
            t["description"] = r.description
            if r.debug:
                t["descriptionDebug"] = json.loads(r.debug)
            if args.include_structured:
                t["descriptionStructured"] = json.loads(r.structured) if r.structured else None
        kept = ("id", "biome", "tileCount", "bbox")  # parents are not carried over
        if data.get("regions"):
            data["regions"] = [{k: r[k] for k in kept} for r in data["regions"]]
    else:
        placed = regions.with_regions(regions.checked(tiles.select("grid_id", "x", "y", F.col("ecology.biome").alias("biome")))).cache()
        ids = {(r.x, r.y): r.region for r in placed.collect()}
        for t in data["tiles"]:
            t["region"] = {"biomeRegionId": ids[t["x"], t["y"]]}
        rows = regions.region_summary(placed).orderBy("region").collect()
        summary = [{"id": r.region, "biome": r.biome, "tileCount": r.tile_count, "bbox": {"minX": r.min_x, "minY": r.min_y, "maxX": r.max_x, "maxY": r.max_y}} | ({} if r.parent is None else {"parentRegionId": r.parent}) for r in rows]
        data = {"meta": data["meta"], "regions": summary, "tiles": data["tiles"]}
    outputs.write_envelope(data, args.output_file, args.force)


def main(tokens: list[str] | None = None) -> int:
    tokens = sys.argv[1:] if tokens is None else tokens
    try:
        check_flags(tokens)
        run(None, parser().parse_args(tokens))
    except Exception as e:  # every failure ends in the exit code of its category
        failure = categorised(e)
        print(f"error: {failure}", file=sys.stderr)
        return failure.exit_code
    return 0


if __name__ == "__main__":
    sys.exit(main())
