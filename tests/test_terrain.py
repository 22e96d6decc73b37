import hashlib
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import known_maps
from terrella.errors import FileError, InputError, InternalError, ShapeError
from terrella.functions.columns import hash32, tie_hash, unsigned_mod
from terrella.functions import rng
from terrella.operators import describe, ecology, graph, hydrology, navigation, regions, topography, trails
from terrella.operators.noise import with_base_maps
from terrella.operators.grid import box_distance, dense_grid, grid_dimensions
from terrella.plans.generate import SPEC, generate, nested
from terrella.sinks import outputs
from terrella.sources import envelope, params, rasters
from terrella.sources.params import DEFAULTS, merged

TIES = [((0, 0, 0), 0), ((1, 0, 0), 6238072747940578789), ((42, 1, 1), 7160109091909588253), ((123456789, 63, 17), 9672262271120887731), ((2**64 - 1, 15, 31), 10179000537863991047)]


def grid(spark, width, height, **columns):
    rows = [(0, i % width, i // width, *[c[i] for c in columns.values()]) for i in range(width * height)]
    kinds = {bool: "boolean", int: "int", float: "double"}
    return spark.createDataFrame(rows, "grid_id long, x int, y int, " + ", ".join(f"{n} {kinds[type(c[0])]}" for n, c in columns.items()))


def column(df, name):
    return [r[0] for r in df.orderBy("y", "x").select(name).collect()]


def close(a, b):
    assert a == pytest.approx(b, abs=1e-6)


def test_hashes(spark):
    for (seed, x, y), want in TIES:
        assert rng.tie_hash(seed, x, y) == want
        got = spark.range(1).select(unsigned_mod(tie_hash(seed, F.lit(x), F.lit(y)), F.lit(1_000_003).cast("long"))).first()[0]
        assert got == want % 1_000_003
    words = ["", "a", "3,14:biome:lake", "x" * 40]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in rows.select(hash32(F.col("w"))).collect()] == [rng.hash32(w) for w in words]


def test_flow(spark):
    h = [1.2, 1.2, 1.2, 1.2, 1.0, 0.8, 1.2, 0.8, 1.2]
    p = merged(DEFAULTS, {"hydrology": {"minDropThreshold": 0.1}})
    fd = column(hydrology.with_flow_direction(grid(spark, 3, 3, h=h), p, 42), "fd")
    assert fd[4] == [0, 2][rng.tie_hash(42, 1, 1) % 2]
    flow = grid(spark, 3, 3, fd=[0, 0, 255] * 3)
    assert column(hydrology.with_flow_accumulation(flow, 9), "fa") == [1, 2, 3] * 3
    assert column(hydrology.in_degree(flow), "in_deg") == [0, 1, 1] * 3
    assert column(hydrology.with_flow_norm(grid(spark, 4, 1, fa=[7] * 4)), "fa_norm") == [0.0] * 4
    close(column(hydrology.with_flow_norm(grid(spark, 3, 1, fa=[1, 2, 4])), "fa_norm"), [0, 0.5, 1])


def test_unknown_flow_codes_raise(spark):
    for code in (8, -1, 254):
        with pytest.raises(Exception, match="unknown code"):
            hydrology.in_degree(grid(spark, 2, 1, fd=[0, code])).collect()
    assert [r.in_deg for r in hydrology.in_degree(grid(spark, 2, 1, fd=[0, 255])).orderBy("x").collect()] == [0, 1]


def test_cycles_are_found(spark):
    with pytest.raises(InternalError):
        hydrology.with_flow_accumulation(grid(spark, 2, 1, fd=[0, 4]), 2).collect()


def test_water(spark):
    p = merged(DEFAULTS, {"hydrology": {"lakeFlatSlopeThreshold": 0.5, "lakeAccumThreshold": 0.5, "streamAccumThreshold": 0.5, "streamMinSlopeThreshold": 0.5}})
    t = grid(spark, 3, 1, landform=[4, 4, 0], slope=[0.49, 0.5, 0.5], fa_norm=[0.5] * 3).withColumn("lake", hydrology.lake_mask(p))
    assert column(t, "lake") == [True, False, False]
    assert column(t.withColumn("s", hydrology.stream_mask(p)), "s") == [False, True, True]
    t = grid(spark, 4, 1, lake=[True, False, False, False], stream=[True, True, False, False], moisture=[0.9, 0.9, 0.9, 0.4], slope=[0.01, 0.01, 0.01, 0.2])
    assert column(t.withColumn("w", hydrology.water_class(DEFAULTS)), "w") == [1, 2, 3, 0]


def test_lakes_grow(spark):
    p = merged(DEFAULTS, {"hydrology": {"lakeGrowSteps": 1, "lakeGrowHeightDelta": 0.01, "lakeFlatSlopeThreshold": 0.06}})
    lake = [False, False, False, False, True, False, False, True, False]
    t = grid(spark, 3, 3, lake=lake, h=[0.8, 0.8, 0.8, 0.8, 0.2, 0.205, 0.8, 0.3, 0.295], slope=[0.02] * 9)
    assert column(hydrology.grown_lakes(t, p), "lake") == [False, False, False, False, True, True, False, True, False]


def test_box_distance_is_capped_chebyshev(spark):
    t = box_distance(dense_grid(spark, 7, 4), (F.col("x") == 1) & (F.col("y") == 1), 3, "d")
    assert column(t, "d") == [min(3, max(abs(i % 7 - 1), abs(i // 7 - 1))) for i in range(28)]
    with pytest.raises(ValueError):
        box_distance(dense_grid(spark, 2, 2), F.lit(True), 1.5, "d")


def test_ecology(spark):
    t = ecology.with_vegetation(grid(spark, 3, 1, biome=[2, 1, 4], moisture=[0.8, 1.0, 0.0], v=[0.7, 1.0, 0.0]))
    close(column(t, "density"), [0.594, 0.89, 0.21])
    close(column(t, "canopy"), [0.6264, 0.834, 0.296])
    t = grid(spark, 9, 1, biome=[3, 4, 1, 2, 2, 6, 0, 0, 0], moisture=[0.3, 0.3, 0.9, 0.52, 0.51, 0.5, 0.75, 0.74, 0.5]).withColumn("d", ecology.dominant())
    pine, spruce, birch = ["scots_pine"], ["norway_spruce"], ["birch"]
    assert column(t, "d") == [pine, pine, spruce, spruce + birch, birch + spruce, birch, [], birch, birch]
    t = grid(spark, 5, 1, moisture=[0.7, 0.34, 0.5, 0.8, 0.2], slope=[0.1, 0.02, 0.2, 0.03, 0.01], h=[0.2, 0.2, 0.2, 0.2, 0.8], r=[0.2, 0.2, 0.2, 0.2, 0.6], landform=[0, 2, 0, 0, 0])
    t = ecology.with_ground(t, DEFAULTS)
    assert column(t, "soil") == [0, 1, 2, 0, 1] and column(t, "surface") == [2, 12, 0, 3, 28]
    close(column(t, "firmness"), [0.48, 0.726, 0.725, 0.3425, 0.8375])
    t = ecology.with_roughness(grid(spark, 4, 1, r=[0.2, 0.8, 0.4, 0.6], moisture=[0.2, 0.9, 0.65, 0.4], h=[0.3, 0.8, 0.8, 0.2]), DEFAULTS)
    assert column(t, "features") == [0, 15, 2, 1]
    close(column(t, "obstruction"), [0.2, 0.815, 0.4375, 0.57])


def test_navigation(spark):
    p = merged(DEFAULTS, {"grid": {"playableInset": 0}})
    slope = [0.05] * 9
    slope[4] = 0.2
    t = grid(spark, 3, 3, h=[0.45, 0.5, 0.63, 0.45, 0.5, 0.73, 0.45, 0.45, 0.45], moisture=[0.5] * 9, slope=slope, water=[0] * 8 + [1])
    t = navigation.with_passability(t, p, 3, 3)
    row = t.where("x = 1 and y = 1").select(navigation.unpacked(F.col("pass_packed")).alias("p"), navigation.cliffs_unpacked(F.col("cliff_packed")).alias("c")).first()
    assert row.p.asDict() == {"N": "passable", "NE": "difficult", "E": "blocked", "SE": "blocked", "S": "passable", "SW": "passable", "W": "passable", "NW": "passable"}
    assert [d for d, c in row.c.asDict().items() if c] == ["E"]
    water, land, trail = [0] * 8 + [1], [0] * 9, [False] * 9
    water[4], land[4], trail[4] = 2, 2, True
    assert column(navigation.with_followable(grid(spark, 3, 3, water=water, landform=land, trail=trail)), "follow")[4] == 15
    t = grid(spark, 1, 1, obstruction=[1.0], moisture=[1.0], water=[3], biome=[0], trail=[True]).withColumn("c", navigation.move_cost(DEFAULTS))
    close(column(t, "c"), [1.9794375])


def path(width, cost, a, b, diagonal=math.sqrt(2), eps=1e-6):
    return trails.least_cost_path(np.array(cost, float), width, a, b, diagonal, 1e9, eps)


def test_routing():
    assert path(2, [1, 1, 1, 1], 0, 3, 10) == [0, 1, 3]
    for c, want in ((1.0000004, [0, 1, 3]), (1.000001, [0, 1, 3]), (1.0000012, [0, 2, 3])):
        assert path(2, [1, c, 1, 1], 0, 3, 10) == want
    assert path(3, [1e9, *[1] * 8], 0, 8) is None
    with pytest.raises(InputError):
        path(2, [1] * 4, 0, 9)


def test_trails(spark):
    firm = [0.2] * 25
    firm[6], firm[7], firm[11] = 0.9, 0.8, 0.8
    water = [0] * 25
    water[18] = 1
    moist, slope = [0.5] * 25, [0.05] * 25
    moist[12], slope[13] = 0.95, 0.4
    p = merged(DEFAULTS, {"gameTrails": {"seedTilesPerTrail": 3}})
    t = grid(spark, 5, 5, firmness=firm, water=water, moisture=moist, slope=slope)
    assert [(r.x, r.y) for r in trails.trail_seeds(t, p, 5, 5).orderBy("seed_rank").collect()] == [(1, 1), (2, 1), (1, 2)]
    ends = trails.nearest(spark.createDataFrame([(0, 2, 2)], "grid_id long, x int, y int"), spark.createDataFrame([(0, 3, 1), (0, 1, 1)], "grid_id long, x int, y int"), 5, 5)
    assert ends.first()["end"] == 6
    paths = [(0, 0, i, v) for i, v in enumerate([0, 1, 2])] + [(0, 1, i, v) for i, v in enumerate([2, 5, 8])] + [(0, 4, i, v) for i, v in enumerate([0, 3, 6])]
    marks = {r.idx: r.trail_id for r in trails.trail_marks(spark.createDataFrame(paths, "grid_id long, route_seq long, step long, idx long")).collect()}
    assert marks == {0: 0, 1: 0, 2: 0, 5: 1, 8: 1, 3: 2, 6: 2}


def region_rows(spark, cells):
    return spark.createDataFrame([(0, x, y, b) for (x, y), b in cells.items()], "grid_id long, x int, y int, biome string")


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        ({(x, y): "lake" if (x, y) == (1, 1) else "heath" for x in range(3) for y in range(3)}, {0: None, 1: 0}),
        ({(x, y): "lake" if (x, y) == (0, 1) else "heath" for x in range(3) for y in range(3)}, {0: None, 1: None}),
        ({(x, y): "lake" if (x, y) == (1, 1) else "a" if x + y < 3 else "b" for x in range(3) for y in range(3)}, {0: None, 1: None, 2: None}),
    ],
)
def test_regions(spark, cells, want):
    tiles = regions.with_regions(regions.checked(region_rows(spark, cells)))
    assert {r.region: r.parent for r in regions.region_summary(tiles).collect()} == want


def test_regions_of_bad_tiles(spark):
    twice = spark.createDataFrame([(0, 1, 1, "a"), (0, 1, 1, "b")], "grid_id long, x int, y int, biome string")
    with pytest.raises(InputError):
        regions.checked(twice)
    with pytest.raises(InputError):
        regions.checked(region_rows(spark, {(0, 0): None}))
    empty = region_rows(spark, {(0, 0): "a"}).where("x > 9")
    assert regions.region_summary(regions.with_regions(empty)).collect() == []


#: SHA-256 of little-endian map bytes for seed 42 at 16 x 16. Fixed values.
MAPS = {
    "h": ("<f4", "7a478a63126d39241c63fe654232f680a5b8e0b7907e2bd3d6b2c4b5cf60c210"),
    "r": ("<f4", "a66ef7fd25e1192270dcc4e631395411a7ac9f064ccf433b14d07114ed31d1fd"),
    "v": ("<f4", "6cdd51f402c61aa70fddfff896cc7123e81d8deb7cf552fe3391d5a15cef44ab"),
    "slope": ("<f4", "e4d92b60d3ac05470943ec0332f1f85db1dbf62d43a5224bdca6ce04caf79d1e"),
    "aspect": ("<f4", "75db33c803dc1608d90718eb3ea7fc6208c75ff216e6317a8faca357e8c5b4c8"),
    "landform": ("u1", "9dbc6d9df236f18f74937f63186fa8624a02c5379f34770f9c739a2c5924001d"),
    "trail_cost": ("<f4", "d1a09b64080ec54591b2f02de05293ed23f3f7e6b203359f6d882755bc2c1870"),
    "trail": ("u1", "e3922dcdc791c0ebe4a68862d75725e53b4de0390b99c62239faeaf8c11fd7b1"),
    "trail_id": ("<i4", "82f9d1930e45dfda930763c9313a3f9f8a84b3576eaa8a33373528232879a292"),
    "move_cost": ("<f4", "8df145cc3e5114c06b0a4b64846fbebeb23c392b535b4883b8e633966759e513"),
    "pass_packed": ("<u2", "1c5b88543a65122bb48c50e32886565c5731e3cc5203e63569bc787e55bb3b0b"),
    "cliff_packed": ("u1", "5341e6b2646979a70e57653007a1f310169421ec9bdd9f1a5648f75ade005af1"),
    "follow": ("u1", "5109b491e1925e8d159147f4d325dd920ade6dd1ed910a36da15279b945870cb"),
}
#: SHA-256 of the whole document for seed 42 at 16 x 16. Fixed value.
DOCUMENT = "3ff22bc43864b5953eddbd4a4d42fea7a129e5426c6fd79cc3f2d26387766e93"


@pytest.fixture(scope="module")
def generated(spark):
    return generate(spark, 42, 16, 16, DEFAULTS).cache()


def test_known_maps(generated):
    d = generated.orderBy("y", "x").toPandas()
    for name, (kind, want) in MAPS.items():
        assert hashlib.sha256(d[name].to_numpy().astype(kind).tobytes()).hexdigest() == want, name


KINDS = {"landform": "u1", "trail": "u1", "cliff_packed": "u1", "follow": "u1", "trail_id": "<i4", "pass_packed": "<u2"}


def assert_known(d, known):
    for name, want in known.items():
        assert hashlib.sha256(d[name].to_numpy().astype(KINDS.get(name, "<f4")).tobytes()).hexdigest() == want, name


@pytest.mark.parametrize("place", known_maps.TOPOGRAPHY)
def test_known_topography(spark, place):
    seed, side = place
    maps = with_base_maps(dense_grid(spark, side, side), seed, DEFAULTS)
    assert_known(topography.with_topography(maps, DEFAULTS).orderBy("y", "x").toPandas(), known_maps.TOPOGRAPHY[place])


@pytest.mark.parametrize("place", [k for k in known_maps.NAVIGATION if k[0] != 42])
def test_known_navigation(spark, place):
    seed, side = place
    assert_known(generate(spark, seed, side, side, DEFAULTS).orderBy("y", "x").toPandas(), known_maps.NAVIGATION[place])


def test_known_document(generated, tmp_path):
    data = outputs.envelope(nested(generated), SPEC)
    outputs.write_envelope(data, str(tmp_path / "e.json"))
    assert hashlib.sha256((tmp_path / "e.json").read_bytes()).hexdigest() == DOCUMENT
    with pytest.raises(FileError):
        outputs.write_envelope(data, str(tmp_path / "e.json"))


def test_companions(spark, generated, tmp_path):
    source, out = str(tmp_path / "in.json"), str(tmp_path / "out.json")
    outputs.write_envelope(outputs.envelope(nested(generated), SPEC), source)
    from terrella.cli import check_flags, parser, run

    run(spark, parser().parse_args(["assign-regions", "--input-file", source, "--output-file", out]))
    data = envelope.read_document(out)
    assert sum(r["tileCount"] for r in data["regions"]) == 256 and all("region" in t for t in data["tiles"])
    run(spark, parser().parse_args(["describe", "--input-file", out, "--output-file", out, "--force", "--include-structured"]))
    data = json.load(open(out))
    assert all(isinstance(t["description"], str) and t["descriptionStructured"]["sentences"] for t in data["tiles"])
    assert not any("parentRegionId" in r for r in data["regions"])
    run(spark, parser().parse_args(["debug", "--input-file", source, "--output-dir", str(tmp_path / "d")]))
    assert json.load(open(tmp_path / "d" / "debug-manifest.json"))["tileCount"] == 256
    for bad in (["--sed", "1"], ["--seed", "1", "--seed", "2"]):
        with pytest.raises(InputError):
            check_flags(bad)


@pytest.mark.parametrize(("tokens", "code"), [
    (["generate", "--seed", "1", "--width", "2", "--height", "2", "--output-dir", "d", "--output-file", "f"], 2),
    (["generate", "--seed", "1", "--width", "2", "--height", "2", "--output-file", "f", "--debug-output-file", "g"], 2),
    (["debug", "--seed", "1", "--width", "2", "--height", "2", "--output-file", "f", "--output-dir", "d"], 2),
    (["debug", "--seed", "1", "--width", "2", "--height", "2"], 2),
    (["derive", "--seed", "1", "--width", "2", "--height", "2", "--output-file", "f"], 2),
    (["generate", "--width", "2", "--height", "2", "--output-file", "f"], 2),
    (["generate", "--seed", "x", "--width", "2", "--height", "2", "--output-file", "f"], 2),
    (["generate", "--seed", "1", "--width", "0", "--height", "2", "--output-file", "f"], 2),
    (["generate", "--seed", "1", "--width", "two", "--height", "2", "--output-file", "f"], 2),
    (["generate", "--see", "1"], 2),
    (["paint"], 2),
    (["describe", "--output-file", "f"], 2),
    (["generate", "--input-file", "i", "--output-file", "f"], 2),
    (["debug", "--input-file", "/nowhere/in.json", "--output-dir", "d"], 4),
    (["generate", "--params", "/nowhere/p.json"], 4),
])
def test_exit_codes_before_any_work(tokens, code, monkeypatch, capsys):
    from terrella import cli

    monkeypatch.setattr(cli, "session", lambda: pytest.fail("a session was begun"))
    assert cli.main(tokens) == code and capsys.readouterr().err.startswith("error: ")


def test_unforeseen_failures_have_exit_codes(monkeypatch):
    from terrella import cli

    for failure, code in ((PermissionError("no"), 4), (KeyError("x"), 5), (RuntimeError(), 5)):
        def fails(*_, failure=failure):
            raise failure

        monkeypatch.setattr(cli, "run", fails)
        assert cli.main(["generate"]) == code


def test_a_parameter_file_may_hold_a_whole_run(spark, tmp_path):
    from terrella import cli

    heights = {"width": 3, "height": 2, "data": [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]}
    (tmp_path / "h.json").write_text(json.dumps(heights))
    whole = {"seed": "7", "width": 3, "height": 2, "mapHPath": "h.json", "outputFile": "out/tiles.json", "force": True, "params": {"grid": {"playableInset": 0}}}
    (tmp_path / "run.json").write_text(json.dumps(whole))
    for _ in range(2):
        cli.run(spark, cli.parser().parse_args(["derive", "--params", str(tmp_path / "run.json")]))
    data = json.loads((tmp_path / "out" / "tiles.json").read_text())
    assert [t["topography"]["h"] for t in data["tiles"]] == pytest.approx(heights["data"], abs=1e-7)
    other = str(tmp_path / "other.json")
    cli.run(spark, cli.parser().parse_args(["derive", "--params", str(tmp_path / "run.json"), "--output-file", other]))
    assert json.load(open(other)) == data
    (tmp_path / "bare.json").write_text(json.dumps({"seed": 5, "outputDir": "d"}))
    args = cli.parser().parse_args(["debug", "--params", str(tmp_path / "bare.json")])
    with pytest.raises(InputError, match="seed"):
        cli.settled_arguments(args)
    assert args.output_dir == str(tmp_path / "d")
    (tmp_path / "odd.json").write_text(json.dumps({"seed": "5", "outputFil": "d"}))
    with pytest.raises(InputError, match="outputFile"):
        cli.settled_arguments(cli.parser().parse_args(["generate", "--params", str(tmp_path / "odd.json")]))


def test_shared_folder(spark, tmp_path):
    from terrella.functions import storage

    t = storage.settled(spark.range(7).where("id > 2"), "t")
    assert storage.rows(t) == 4 == t.count() and storage.rows(spark.range(3)) == 3
    assert storage.rows(storage.settled(spark.range(7).where("false"))) == 0
    storage.discard(t, spark.range(1))
    assert not os.path.exists(t._settled_path.removeprefix("file://"))

    class Elsewhere:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "applicationId": "a"})

    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_path(Elsewhere, "x")


def tile(**over):
    near = {d: {"biome": "pine_heath", "water": "none", "elevDelta": 0.0, "densityDelta": 0.0, "followable": []} for d in describe.DIRS}
    base = {"biome": "pine_heath", "landform": "flat", "moisture": 0.4, "standingWater": False, "passability": dict.fromkeys(describe.DIRS, "passable"), "flowDirection": None, "slopeDirection": "S", "slopeStrength": 0.0, "obstacles": [], "followable": [], "visibility": "long", "neighbors": near}
    return base | over


def test_description_rules():
    assert describe.described(tile(biome="lake"), "0,0")["text"] == "Lake surface."
    runs = describe.movement_runs({d: "blocked" if d in ("E", "SE") else "passable" for d in describe.DIRS})
    assert runs == [{"type": "passage", "directions": ["S", "SW", "W", "NW", "N", "NE"]}, {"type": "blockage", "directions": ["E", "SE"]}]
    t = tile(landform="slope", slopeStrength=0.2)
    t["neighbors"]["N"]["elevDelta"] = 0.09
    text, details = describe.landform_part(t)
    assert details["local"]["derived"]["mode"] == "rise" and "steeply rises to the north" in details["local"]["derived"]["text"]
    t = tile(followable=["stream"], flowDirection="E")
    for d in ("W", "E"):
        t["neighbors"][d]["followable"] = ["stream"]
    assert describe.followable_part(t) == "A stream flows from west to the east."
    assert describe.side_of(["NE", "SE"]) == "the eastern side" and describe.side_of(["N"]) is None
    assert describe.chosen_obstacle(["boulder", "boulder"], "1,1") == "boulder"
    with pytest.raises(describe.PhraseMissing):
        describe.described(tile(biome="moon"), "0,0", strict=True)
    full = describe.described(tile(), "0,0")["sentences"]
    assert [s["contributors"] for s in full if s["slot"] == "movement_structure"] == [{"emit": False, "suppressedBy": "fully_passable"}]


def test_description_failures_are_rows(spark):
    whole = {"moveCost": 1.0, "followable": [], "passability": dict.fromkeys(describe.DIRS, "passable"), "gameTrailId": None}
    rows = [(0, 0, 0, None, None, None, whole, None), (0, 1, 0, None, None, None, None, None), (0, None, 0, None, None, None, whole, None), (0, 9, 9, None, None, None, whole | {"followable": None}, None)]
    got = describe.describe(spark.createDataFrame(rows, "grid_id bigint, " + envelope.TILE)).collect()
    codes = {(r.x, r.y): json.loads(r.debug)["code"] if r.debug else None for r in got}
    assert codes == {(0, 0): None, (1, 0): "malformed_passability", (None, 0): "description_input_invalid", (9, 9): "description_generation_failed"}


def test_params(tmp_path):
    assert params.suggestion("octave", ["octaves", "eps"]) == "octaves" and params.suggestion("zzzzzz", ["eps"]) is None
    with pytest.raises(InputError, match="did you mean landform.eps|did you mean eps"):
        params.resolved({"landform": {"ep": 1}})
    assert params.resolved({"vegVarianceStrength": 0.5})["vegVarianceNoise"]["strength"] == 0.5
    assert params.seed_of(str(2**64 - 1)) == 2**64 - 1
    for bad in ("-1", "1.0", str(2**64), ""):
        with pytest.raises(InputError):
            params.seed_of(bad)
    (tmp_path / "p.json").write_text(json.dumps({"seed": 5, "width": 8, "params": {"landform": {"eps": 0.1}}}))
    assert params.read_params("p.json", str(tmp_path)) == ({"landform": {"eps": 0.1}}, {"width": 8})
    with pytest.raises(FileError):
        params.read_params("none.json", str(tmp_path))


def test_authored_maps(spark, tmp_path):
    def write(**d):
        (tmp_path / "m.json").write_text(json.dumps(d))
        return str(tmp_path / "m.json")

    good = rasters.read_authored(spark, write(width=2, height=2, data=[0, 0.25, 0.5, 1]), (2, 2))
    assert column(good, "value") == [0.0, 0.25, 0.5, 1.0]
    for error, d, shape in ((ShapeError, {"width": 2, "height": 2, "data": [0]}, None), (InputError, {"width": 1, "height": 1, "data": [2]}, None), (ShapeError, {"width": 1, "height": 1, "data": [0]}, (2, 2)), (InputError, {"width": 0, "height": 1, "data": []}, None)):
        with pytest.raises(error):
            rasters.read_authored(spark, write(**d), shape)


def test_thin_and_empty_grids(spark):
    for w, h in ((1, 8), (8, 1)):
        tiles = topography.with_topography(dense_grid(spark, w, h).withColumn("h", (F.col("x") + F.col("y")) / 10.0), DEFAULTS)
        assert all(r.slope == r.slope and r.landform is not None for r in tiles.collect())
    none = dense_grid(spark, 2, 2).where("x > 5").withColumn("h", F.lit(0.5))
    assert topography.with_topography(none, DEFAULTS).collect() == []
    assert tuple(grid_dimensions(none).first()) == (0, 0)


def test_blocks_do_not_change_stencils(spark, monkeypatch):
    from terrella.operators import grid as module

    values = [float(i * 37 % 11) for i in range(9 * 8)]
    tiles = grid(spark, 9, 8, h=values, wet=[v > 8 for v in values])
    whole = module.with_neighbours(tiles, ["h"]).orderBy("y", "x").collect()
    far = [column(box_distance(tiles, F.col("wet"), cap, "d"), "d") for cap in (1, 3, 7)]
    for block in (1, 2, 5):
        monkeypatch.setattr(module, "BLOCK", block)
        assert module.with_neighbours(tiles, ["h"]).orderBy("y", "x").collect() == whole
        assert [column(box_distance(tiles, F.col("wet"), cap, "d"), "d") for cap in (1, 3, 7)] == far


def test_labels_of_a_long_path(spark):
    nodes = spark.range(40).select(F.lit(0).cast("long").alias("grid_id"), F.col("id").alias("node"))
    one = nodes.where("node < 39").select("grid_id", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    edges = one.union(one.select("grid_id", F.col("b"), F.col("a")))
    assert {r.label for r in graph.labelled(nodes, edges).collect()} == {0}


def test_stream_of_tiles(spark, generated, tmp_path):
    from terrella.streaming.envelopes import blocked_directions, tile_stream

    outputs.write_lines(nested(generated), str(tmp_path / "t"))
    run = blocked_directions(tile_stream(spark, str(tmp_path / "t"))).writeStream.format("memory").queryName("blocked").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(spark.table("blocked").collect()) == sorted(blocked_directions(nested(generated)).collect())


def test_region_queries_hold_the_whole_raster(spark):
    from terrella.plans import registry

    sf = "/root/testdata/sf0.001"
    biome = {(r.y, r.x): r.biome for r in registry.classed(spark, sf).collect()}
    near = lambda y, x: [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    of, members = {}, []
    for first in sorted(biome):
        if first not in of:
            of[first], todo = len(members), [first]
            for t in todo:
                for o in near(*t):
                    if o not in of and biome.get(o) == biome[first]:
                        of[o] = len(members)
                        todo.append(o)
            members.append(todo)
    around = [{of.get(o) for t in m for o in near(*t)} - {k} for k, m in enumerate(members)]
    box = lambda m: (min(x for _, x in m), min(y for y, _ in m), max(x for _, x in m), max(y for y, _ in m))
    assert len(biome) == 64 * registry.table(spark, sf, "embeddings").count()
    assert {(r.y, r.x): r.region for r in registry.QUERIES["regions"](spark, sf).collect()} == of
    assert sorted(map(tuple, registry.QUERIES["region_summary"](spark, sf).collect())) == [(k, biome[m[0]], len(m), *box(m)) for k, m in enumerate(members)]
    parents = {k: min(a) if len(a) == 1 and None not in a else None for k, a in enumerate(around)}
    assert {r.region: r.parent for r in registry.QUERIES["region_parent"](spark, sf).collect()} == parents


def crossing_tiles(spark):
    """Sparse tiles of three biomes in two grids, on both sides of the blocks' rims and of 0, with their brute-force regions."""
    import random

    rng = random.Random(7)
    biome = {(g, y, x): rng.choice("aab") for g in (0, 3) for x in range(-3, 4) for y in range(regions.SIDE - 40, regions.SIDE + 40)}
    biome |= {(g, y, x): rng.choice("abc") for g in (0, 3) for x in range(regions.SIDE - 3, regions.SIDE + 4) for y in range(-40, 40)}
    for t in rng.sample(sorted(biome), 300):
        del biome[t]
    for y in range(-12, -1):  # a ring over four blocks around one lake
        for x in range(-8, 9):
            biome[9, y, x] = "lake" if -9 <= y <= -5 and -3 <= x <= 3 else "heath"
    near = lambda g, y, x: [(g, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    of, members, last = {}, {}, {}
    for first in sorted(biome):
        if first not in of:
            last[first[0]] = k = last.get(first[0], -1) + 1
            of[first], todo = k, [first]
            for t in todo:
                for o in near(*t):
                    if o not in of and biome.get(o) == biome[first]:
                        of[o] = k
                        todo.append(o)
            members[first[0], k] = todo
    around = {k: {of.get(o) for t in m for o in near(*t)} - {k[1]} for k, m in members.items()}
    parents = {k: min(a) if len(a) == 1 and None not in a else None for k, a in around.items()}
    return spark.createDataFrame([(g, x, y, b) for (g, y, x), b in biome.items()], "grid_id long, x int, y int, biome string"), of, members, parents


def test_regions_cross_the_rims_of_blocks(spark, monkeypatch):
    tiles, of, _, _ = crossing_tiles(spark)
    nodes = []
    monkeypatch.setattr(regions, "labelled", lambda n, e: nodes.append(n.count()) or graph.labelled(n, e))
    placed = regions.with_regions(tiles.withColumn("extra", F.col("x") * 2))
    assert {(r.grid_id, r.y, r.x): r.region for r in placed.collect()} == of
    assert all(r.extra == 2 * r.x for r in placed.collect())
    # Rounds of joins get what touches a rim, not every tile.
    assert 0 < nodes[0] < len(of) / 4


def no_broadcast(df):
    return "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_region_shapes_need_no_joins(spark, tmp_path):
    tiles, of, members, parents = crossing_tiles(spark)
    tiles.withColumn("region", F.col("x") * 0).limit(0).write.parquet(str(tmp_path / "tiles"))
    placed = regions.with_regions(tiles)
    box = lambda m: (min(t[2] for t in m), min(t[1] for t in m), max(t[2] for t in m), max(t[1] for t in m))
    got = {(r.grid_id, r.region): (r.biome, r.tile_count, r.min_x, r.min_y, r.max_x, r.max_y, r.parent) for r in regions.region_summary(placed).collect()}
    biome = {(r.grid_id, r.y, r.x): r.biome for r in tiles.collect()}
    assert got == {k: (biome[m[0]], len(m), *box(m), parents[k]) for k, m in members.items()}
    # Files of tiles are small for their rows, so a plan must not send them through the driver.
    assert no_broadcast(regions.region_summary(spark.read.parquet(str(tmp_path / "tiles"))))


def test_region_parents_across_blocks(spark, tmp_path):
    tiles, _, _, parents = crossing_tiles(spark)
    assert {(r.grid_id, r.region): r.parent for r in regions.region_parents(regions.with_regions(tiles)).collect()} == parents
    assert parents[9, 1] == 0  # a lake over four blocks
    tiles.withColumn("region", F.col("x") * 0).limit(0).write.parquet(str(tmp_path / "tiles"))
    assert no_broadcast(regions.region_parents(spark.read.parquet(str(tmp_path / "tiles"))))
