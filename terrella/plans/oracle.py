"""The terrain operators once more, as SQL over the parquet tables: a chain of named steps for checking results."""

from __future__ import annotations

from ..functions.columns import f32_of
from ..functions.rng import MIX_1, MIX_2, X_MIX, Y_MIX, permutation
from ..operators.noise import SETTINGS


def num(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else f"{text}e0"


def near32(v: float) -> str:
    return num(f32_of(v))


def f32(e: str) -> str:
    return f"(({e})::FLOAT)::DOUBLE"


def clamp(e: str) -> str:
    return f"(CASE WHEN ({e}) <= 0 THEN 0e0 WHEN ({e}) >= 1 THEN 1e0 ELSE ({e}) END)"


def _mix(e: str) -> str:
    two64 = "18446744073709551616::UHUGEINT"
    shift = lambda a, n: f"xor({a}, ({a}) // {1 << n}::UHUGEINT)"
    return shift(f"(({shift(f'(({shift(e, 30)}) * {MIX_1}::UHUGEINT) % {two64}', 27)}) * {MIX_2}::UHUGEINT) % {two64}", 31)


def _fnv(text: str) -> str:
    codes = f"list_prepend(2166136261::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT))"
    return f"list_reduce({codes}, lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def pick(options: list[str], text: str) -> str:
    return "(" + str(options) + f")[({_fnv(text)} % {len(options)})::INTEGER + 1]"


def cap_distance(source: str, table: str, cap: int) -> str:
    """Per tile the least step count to a source, by comparing with each source within the cap."""
    return f"SELECT t.x, t.y, least({cap}, coalesce(min(greatest(abs(s.x - t.x), abs(s.y - t.y))), {cap}))::INTEGER AS d FROM {table} t LEFT JOIN (SELECT x, y FROM {table} WHERE {source}) s ON s.x BETWEEN t.x - {cap} AND t.x + {cap} AND s.y BETWEEN t.y - {cap} AND t.y + {cap} GROUP BY t.x, t.y"


def steps(p: dict, seed: int) -> dict[str, str]:
    """Named steps in order; each may use those before it."""
    hy, gr, rf, mv, gt, w = p["hydrology"], p["ground"], p["roughnessFeatures"], p["movement"], p["gameTrails"], p["hydrology"]["weights"]
    inset = p["grid"]["playableInset"]
    raster = lambda i: f32(clamp(f"(e[{i}]::DOUBLE + 6e-1) / 12e-1"))
    edge = "({x} < {i} OR {y} < {i} OR {x} >= 64 - {i} OR {y} >= (SELECT n FROM tall) - {i})"
    flags = lambda parts: " + ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, c in enumerate(parts))
    table = lambda values: "([" + ", ".join(map(num, values)) + "])[biome + 1]"
    strength = near32(p["vegVarianceNoise"]["strength"])
    dens, canopy = (0.10, 0.80, 0.55, 0.35, 0.30, 0.0, 0.60), (0.15, 0.78, 0.60, 0.40, 0.35, 0.0, 0.55)
    density = clamp(f"{table(dens)} + (v - 5e-1) * 1e-1 + (moisture - 5e-1) * 8e-2")
    rise_codes = f"CASE WHEN b.x IS NULL OR {edge.format(x='b.x', y='b.y', i=inset)} OR a.water = 1 OR b.water = 1 THEN 2 WHEN a.moisture >= 9e-1 AND a.slope < 3e-2 THEN 1 WHEN b.h - a.h >= {num(mv['steepBlockDelta'])} THEN 2 WHEN b.h - a.h >= {num(mv['steepDifficultDelta'])} THEN 1 ELSE 0 END"
    return {
        "tall": "SELECT max(vec_id) + 1 AS n FROM embeddings",
        "dirs": "SELECT * FROM (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)) t(d, dx, dy)",
        "ring": "SELECT * FROM (VALUES (0, 'N', 0, -1), (1, 'NE', 1, -1), (2, 'E', 1, 0), (3, 'SE', 1, 1), (4, 'S', 0, 1), (5, 'SW', -1, 1), (6, 'W', -1, 0), (7, 'NW', -1, -1)) t(i, dir, dx, dy)",
        "base": f"SELECT x, y, {raster('x + 1')} AS h, {raster('64 - x')} AS r, {raster('(x + 32) % 64 + 1')} AS v FROM (SELECT vec_id::INTEGER AS y, unnest(range(64))::INTEGER AS x, embedding AS e FROM embeddings)",
        "diff": "SELECT *, coalesce(lead(h) OVER r, h) - coalesce(lag(h) OVER r, h) AS hx, coalesce(lead(h) OVER c, h) - coalesce(lag(h) OVER c, h) AS hy FROM base WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)",
        "tilt": f"SELECT x, y, h, r, v, {f32('sqrt(hx * hx + hy * hy) / 2')} AS slope, {f32('CASE WHEN hx = 0 AND hy = 0 THEN 0e0 WHEN atan2(-hy, -hx) < 0 THEN atan2(-hy, -hx) * 180e0 / 3.141592653589793e0 + 360 ELSE atan2(-hy, -hx) * 180e0 / 3.141592653589793e0 END')} AS aspect FROM diff",
        "near": "SELECT a.x, a.y, d, b.h - a.h AS rise FROM base a, dirs JOIN base b ON b.x = a.x + dx AND b.y = a.y + dy",
        "sides": f"SELECT x, y, count(*) FILTER (rise > {num(p['landform']['eps'])}) AS hi, count(*) FILTER (-rise > {num(p['landform']['eps'])}) AS lo FROM near GROUP BY x, y",
        "topo": f"SELECT t.*, (CASE WHEN slope < {num(p['landform']['flatSlopeThreshold'])} THEN (CASE WHEN lo = 0 AND hi > 0 THEN 4 WHEN hi = 0 AND lo > 0 THEN 2 ELSE 0 END) WHEN hi >= 6 THEN 4 WHEN lo >= 6 THEN 2 WHEN hi >= 5 AND lo <= 2 THEN 3 WHEN lo >= 5 AND hi <= 2 THEN 2 ELSE 1 END)::INTEGER AS landform FROM tilt t JOIN sides USING (x, y)",
        "most": f"SELECT x, y, max(-rise) AS m FROM near WHERE -rise >= {num(hy['minDropThreshold'])} GROUP BY x, y",
        "ties": f"SELECT x, y, list(d ORDER BY d) AS ds FROM near JOIN most USING (x, y) WHERE -rise >= {num(hy['minDropThreshold'])} AND abs(m + rise) <= {num(hy['tieEps'])} GROUP BY x, y",
        "hashes": f"SELECT x, y, xor(xor({seed}::UHUGEINT, (x::UHUGEINT * {X_MIX}::UHUGEINT) % 18446744073709551616::UHUGEINT), (y::UHUGEINT * {Y_MIX}::UHUGEINT) % 18446744073709551616::UHUGEINT) AS z FROM base",
        "hashed": f"SELECT x, y, {_mix('z')} AS k FROM hashes",
        "flow": "SELECT t.*, (CASE WHEN ds IS NULL THEN 255 WHEN len(ds) = 1 THEN ds[1] ELSE ds[(k % len(ds)::UHUGEINT)::INTEGER + 1] END)::INTEGER AS fd FROM topo t LEFT JOIN ties USING (x, y) JOIN hashed USING (x, y)",
        "edges": "SELECT x, y, x + dx AS nx, y + dy AS ny FROM flow JOIN dirs ON d = fd",
        "walk": "SELECT x AS sx, y AS sy, x, y FROM base UNION ALL SELECT sx, sy, nx, ny FROM walk JOIN edges e ON walk.x = e.x AND walk.y = e.y",
        "drained": "SELECT x, y, count(*)::BIGINT AS fa FROM walk GROUP BY x, y",
        "normed": f"SELECT flow.*, fa, {f32('CASE WHEN lo = hi THEN 0e0 ELSE (ln(fa::DOUBLE) - ln(lo::DOUBLE)) / (ln(hi::DOUBLE) - ln(lo::DOUBLE)) END')} AS fa_norm FROM flow JOIN drained USING (x, y), (SELECT min(fa) AS lo, max(fa) AS hi FROM drained)",
        "laked": f"SELECT *, landform = 4 AND slope < {near32(hy['lakeFlatSlopeThreshold'])} AND fa_norm >= {near32(hy['lakeAccumThreshold'])} AS lake FROM normed",
        "lakes": "SELECT x, y, h FROM laked WHERE lake",
        "shared": "SELECT x, y, x AS rx, y AS ry FROM lakes UNION SELECT s.x, s.y, l.x, l.y FROM shared s, dirs JOIN lakes l ON l.x = s.rx + dx AND l.y = s.ry + dy",
        "lows": "SELECT label, x, y, min(h) OVER (PARTITION BY label) AS ref FROM lakes JOIN (SELECT x, y, min(ry * 64 + rx) AS label FROM shared GROUP BY x, y) USING (x, y)",
        "spread": f"SELECT label, x, y, ref, 0 AS n FROM lows UNION SELECT label, t.x, t.y, ref, n + 1 FROM spread s JOIN dirs ON d % 2 = 0 AND n < {int(hy['lakeGrowSteps'])} JOIN laked t ON t.x = s.x + dx AND t.y = s.y + dy WHERE NOT t.lake AND t.slope <= {near32(hy['lakeFlatSlopeThreshold'])} AND t.h <= ref + {near32(hy['lakeGrowHeightDelta'])}",
        "streamed": f"SELECT *, NOT lake AND fa_norm >= {near32(hy['streamAccumThreshold'])} AND slope >= {near32(hy['streamMinSlopeThreshold'])} AS stream FROM laked",
        "wet_far": cap_distance("lake OR stream", "streamed", hy["waterProxMaxDist"]),
        "moist": "SELECT s.*, d AS dist_water, "
        + f32(clamp(f"{num(w['accum'])} * {clamp(f'(fa_norm - {num(hy["moistureAccumStart"])}) / {num(1 - hy["moistureAccumStart"])}')} + {num(w['flat'])} * {clamp(f'({num(hy["flatnessThreshold"])} - slope) / {num(hy["flatnessThreshold"])}')} + {num(w['prox'])} * {clamp(f'1e0 - d / {num(hy["waterProxMaxDist"])}')}"))
        + " AS moisture FROM streamed s JOIN wet_far USING (x, y)",
        "hydro": f"SELECT *, (CASE WHEN lake THEN 1 WHEN stream THEN 2 WHEN moisture >= {near32(hy['marshMoistureThreshold'])} AND slope < {near32(hy['marshSlopeThreshold'])} THEN 3 ELSE 0 END)::INTEGER AS water FROM moist",
        "damp": f"SELECT *, {f32(clamp(f'moisture + (v - 5e-1) * {strength}'))} AS m2 FROM hydro",
        "living": f"SELECT * EXCLUDE (m2), (CASE WHEN water = 1 THEN 5 WHEN water = 2 THEN 6 WHEN m2 >= {near32(0.85)} THEN (CASE WHEN slope < {near32(0.03)} THEN 0 ELSE 1 END) WHEN m2 >= {near32(0.65)} THEN 1 WHEN m2 >= {near32(0.40)} THEN 2 WHEN h >= {near32(0.70)} AND slope < {near32(0.05)} THEN 4 ELSE 3 END)::INTEGER AS biome FROM damp",
        "plants": f"SELECT *, {f32(density)} AS density, {f32(clamp(f'{table(canopy)} + ({density} - {table(dens)}) * 6e-1'))} AS canopy, CASE WHEN biome IN (3, 4) THEN ['scots_pine'] WHEN biome = 1 THEN ['norway_spruce'] WHEN biome = 2 THEN (CASE WHEN moisture >= {near32(0.52)} THEN ['norway_spruce', 'birch'] ELSE ['birch', 'norway_spruce'] END) WHEN biome = 6 OR biome = 0 AND moisture < {near32(0.75)} THEN ['birch'] ELSE []::VARCHAR[] END AS dominant FROM living",
        "soiled": f"SELECT *, (CASE WHEN moisture >= {near32(gr['peatMoistureThreshold'])} THEN 0 WHEN moisture <= {near32(gr['exposedSandMoistureMax'])} AND (landform = 2 OR h >= {near32(gr['bedrockHeightMin'])}) THEN 1 ELSE 2 END)::INTEGER AS soil FROM plants",
        "grounded": f"SELECT *, {f32(clamp(f'1e0 - 85e-2 * moisture + 15e-2 * {clamp(f"slope / {near32(0.2)}")}'))} AS firmness, ("
        + flags([f"moisture >= {near32(gr['standingWaterMoistureThreshold'])} AND slope < {near32(gr['standingWaterSlopeMax'])}", "soil = 0", f"moisture <= {near32(gr['lichenMoistureMax'])}", f"soil = 1 AND moisture <= {near32(gr['exposedSandMoistureMax'])}", f"h >= {near32(gr['bedrockHeightMin'])} AND r >= {near32(gr['bedrockRoughnessMin'])}"])
        + ")::INTEGER AS surface FROM soiled",
        "rough": f"SELECT *, {clamp(f'r * {num(1 - f32_of(rf["obstructionMoistureMix"]))} + moisture * {near32(rf["obstructionMoistureMix"])}')} AS o FROM grounded",
        "eco": f"SELECT * EXCLUDE (o), {f32('o')} AS obstruction, ("
        + flags([f"o >= {near32(rf['fallenLogThreshold'])}", f"moisture >= {near32(rf['rootTangleMoistureThreshold'])}", f"h >= {near32(rf['boulderHeightMin'])} AND r >= {near32(rf['boulderRoughnessMin'])}", f"o >= {near32(rf['windthrowThreshold'])}"])
        + ")::INTEGER AS features FROM rough",
        "stream_far": cap_distance("stream", "streamed", int(gt["streamProxMaxDist"])),
        "priced": "SELECT e.*, "
        + f32(
            f"1e0 + {num(gt['wSlope'])} * {clamp(f'slope / {num(gt["slopeScale"])}')} + {num(gt['wMoist'])} * {clamp(f'(moisture - {num(gt["moistStart"])}) / {num(1 - gt["moistStart"])}')} + {num(gt['wObs'])} * obstruction"
            f" + CASE WHEN water = 2 THEN {num(gt['wCross'])} ELSE 0e0 END + CASE WHEN water = 3 THEN {num(gt['wMarsh'])} ELSE 0e0 END + CASE WHEN water = 1 THEN {num(gt['inf'])} ELSE 0e0 END"
            f" + CASE WHEN {edge.format(x='x', y='y', i=inset)} THEN {num(gt['inf'])} ELSE 0e0 END + CASE WHEN landform = 2 THEN {num(-gt['wRidge'])} ELSE 0e0 END + {num(-gt['wStreamProx'])} * {clamp(f'1e0 - d / {num(gt["streamProxMaxDist"])}')}"
        )
        + " AS trail_cost FROM eco e JOIN stream_far USING (x, y)",
        "seed_far": cap_distance("water IN (1, 2)", "hydro", int(gt["waterSeedMaxDist"])),
        "scored": f"SELECT e.*, {clamp('(firmness - 35e-2) / 65e-2')} * 35e-2 + {clamp('1e0 - abs(moisture - 55e-2) / 55e-2')} * 25e-2 + {clamp('1e0 - slope / 25e-2')} * 2e-1 + {clamp(f'1e0 - d / {num(gt["waterSeedMaxDist"])}')} * 2e-1 AS score FROM eco e JOIN seed_far USING (x, y) WHERE NOT {edge.format(x='x', y='y', i=inset)} AND water <> 1 AND moisture < 92e-2 AND slope < 3e-1",
        "seeds": f"SELECT x, y, score, (row_number() OVER (ORDER BY score DESC, y, x) - 1)::INTEGER AS seed_rank FROM scored QUALIFY seed_rank < greatest(1, ((64 - {2 * inset}) * ((SELECT n FROM tall) - {2 * inset})) // {gt['seedTilesPerTrail']})",
        "ends": f"SELECT 0 AS kind, x, y FROM eco WHERE water = 2 AND fa_norm >= {num(gt['streamEndpointAccumThreshold'])} UNION ALL SELECT 1, x, y FROM eco WHERE landform = 2 AND slope < {num(gt['ridgeEndpointMaxSlope'])}",
        "requests": "SELECT (seed_rank * 2 + kind)::INTEGER AS route_seq, (['seed_to_water', 'seed_to_ridge'])[kind + 1] AS kind, s.y::BIGINT * 64 + s.x AS seed, min_by(e.y::BIGINT * 64 + e.x, [greatest(abs(e.x - s.x), abs(e.y - s.y))::BIGINT, e.y::BIGINT * 64 + e.x]) AS \"end\" FROM seeds s, ends e GROUP BY seed_rank, kind, s.x, s.y",
        "passable": f"SELECT a.x, a.y, i, dir, ({rise_codes})::INTEGER AS code, (b.x IS NOT NULL AND NOT {edge.format(x='b.x', y='b.y', i=inset)} AND b.h - a.h >= {num(mv['steepBlockDelta'])} AND a.slope >= {num(mv['cliffSlopeMin'])}) AS cliff FROM hydro a CROSS JOIN ring LEFT JOIN hydro b ON b.x = a.x + dx AND b.y = a.y + dy",
        "packed": "SELECT x, y, sum(code << (2 * i))::INTEGER AS pass_packed, sum(CASE WHEN cliff THEN 1 << i ELSE 0 END)::INTEGER AS cliff_packed FROM passable GROUP BY x, y",
        "shores": "SELECT DISTINCT x, y FROM (SELECT a.x, a.y FROM hydro a, dirs JOIN hydro b ON b.x = a.x + dx AND b.y = a.y + dy WHERE a.water <> 1 AND b.water = 1)",
        # All tiles of the region queries, heights in five classes. Labels travel from tile to tile, the least one stays.
        "sparse": "SELECT x, y, (['a', 'b', 'c', 'd', 'e'])[least(4, floor(h * 5))::INTEGER + 1] AS biome FROM base",
        "pairs": "SELECT a.x, a.y, b.x AS tx, b.y AS ty FROM sparse a, dirs JOIN sparse b ON b.x = a.x + dx AND b.y = a.y + dy AND b.biome = a.biome",
        "labels": "SELECT x, y, y * 64 + x AS label FROM sparse UNION SELECT p.x, p.y, min(l.label) FROM labels l JOIN pairs p ON l.x = p.tx AND l.y = p.ty JOIN recurring.labels o ON o.x = p.x AND o.y = p.y WHERE l.label < o.label GROUP BY p.x, p.y",
        "regions": "SELECT s.x, s.y, biome, (dense_rank() OVER (ORDER BY label) - 1)::INTEGER AS region FROM sparse s JOIN labels USING (x, y)",
        "borders": "SELECT a.region, b.region AS o FROM regions a, dirs JOIN regions b ON b.x = a.x + dx AND b.y = a.y + dy WHERE a.region <> b.region GROUP BY 1, 2",
        "rims": "SELECT region, bool_or(n < 8) AS open FROM (SELECT a.region, a.x, a.y, count(b.x) AS n FROM regions a CROSS JOIN dirs LEFT JOIN regions b ON b.x = a.x + dx AND b.y = a.y + dy GROUP BY 1, 2, 3) GROUP BY region",
        "summary": "SELECT region, min(biome) AS biome, count(*)::BIGINT AS tile_count, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM regions GROUP BY region",
        "parents": "SELECT s.region, CASE WHEN NOT open AND kinds = 1 THEN o END AS parent FROM summary s JOIN rims USING (region) LEFT JOIN (SELECT region, count(*) AS kinds, min(o) AS o FROM borders GROUP BY region) USING (region)",
    }


RECURSIVE = ("walk", "shared", "spread")
#: Recursive steps whose newer rows take the place of older ones of the same key.
KEYED = {"labels": "labels USING KEY (x, y)"}


def noise(p: dict, seed: int) -> str:
    """Gradient noise of all three maps over the vector raster's tiles, a step for each octave."""
    at = lambda i: f"p[({i})::INTEGER + 1]"
    dot = lambda h, dx, dy: f"([1e0, -1e0, 1e0, -1e0, 1e0, -1e0, 0e0, 0e0])[({h} & 7) + 1] * ({dx}) + ([1e0, 1e0, -1e0, -1e0, 0e0, 0e0, 1e0, -1e0])[({h} & 7) + 1] * ({dy})"
    blend = lambda a, b, t: f"(({a}) + {t} * (({b}) - ({a})))"
    fade = lambda t: f"({t} * {t} * {t} * ({t} * ({t} * 6e0 - 15e0) + 10e0))"
    parts, maps = [f"base AS MATERIALIZED ({steps(p, seed)['base']})"], []
    for name, key in SETTINGS.items():
        own = p[key]
        total, weight, frequency, amplitude = "0e0", 0.0, float(own["baseFrequency"]), 1.0
        for k in range(own["octaves"]):
            place = f"SELECT x, y, p, floor(x * {num(frequency)}) AS cx, floor(y * {num(frequency)}) AS cy, x * {num(frequency)} AS px, y * {num(frequency)} AS py FROM base, (SELECT {list(permutation(seed, name, k))} AS p)"
            cell = f"SELECT x, y, p, px - cx AS xf, py - cy AS yf, {at('cx::INTEGER & 255')} AS a, {at('(cx::INTEGER & 255) + 1')} AS b, cy::INTEGER & 255 AS yi FROM ({place})"
            corner = f"SELECT x, y, xf, yf, {fade('xf')} AS u, {fade('yf')} AS v, {at('a + yi')} AS aa, {at('a + yi + 1')} AS ab, {at('b + yi')} AS ba, {at('b + yi + 1')} AS bb FROM ({cell})"
            value = blend(blend(dot("aa", "xf", "yf"), dot("ba", "xf - 1", "yf"), "u"), blend(dot("ab", "xf", "yf - 1"), dot("bb", "xf - 1", "yf - 1"), "u"), "v")
            parts.append(f"{name}{k} AS (SELECT x, y, greatest(-1e0, least(1e0, {value} / {num(2**0.5)})) AS n FROM ({corner}))")
            total = f"({total} + {name}{k}.n * {num(amplitude)})"
            weight += amplitude
            frequency *= own["lacunarity"]
            amplitude *= own["persistence"]
        first, *rest = [f"{name}{k}" for k in range(own["octaves"])]
        joins = "".join(f" JOIN {r} ON {r}.x = {first}.x AND {r}.y = {first}.y" for r in rest)
        maps.append(f"(SELECT {first}.x, {first}.y, {f32(clamp(f'({total} / {num(weight)} + 1) / 2'))} AS {name} FROM {first}{joins})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT x, y, h, r, v FROM {maps[0]} JOIN {maps[1]} USING (x, y) JOIN {maps[2]} USING (x, y)"


def query(p: dict, seed: int, select: str) -> str:
    """select, with the steps that it needs, however far down."""
    import re

    every = steps(p, seed)
    wanted: set[str] = set()

    def need(sql: str) -> None:
        for name in every:
            if name not in wanted and re.search(rf"\b{name}\b", sql):
                wanted.add(name)
                need(every[name])

    need(select)
    kept = [(n, s) for n, s in every.items() if n in wanted]
    return "WITH RECURSIVE " + ",\n".join(f"{KEYED.get(n, n)} AS {'' if n in RECURSIVE or n in KEYED else 'MATERIALIZED '}({s})" for n, s in kept) + f"\n{select}"
