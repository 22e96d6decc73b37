"""Seeded 64-bit arithmetic on the driver: generator, sub-seeds, permutation tables and the string hash."""

from __future__ import annotations

from functools import cache

MASK = (1 << 64) - 1
#: Generator step, mixing factors, tile factors, map constants.
GAMMA = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
X_MIX, Y_MIX = 0x9e3779b97f4a7c15, 0xc2b2ae3d27d4eb4f
MAPS = {"h": 0x4848484848484848, "r": 0x5252525252525252, "v": 0x5656565656565656}


def signed(u: int) -> int:
    """The bigint with the bits of an unsigned number."""
    u &= MASK
    return u - (1 << 64) if u >> 63 else u


def mix64(z: int) -> int:
    for shift, factor in ((30, MIX_1), (27, MIX_2)):
        z = (z ^ z >> shift) * factor & MASK
    return z ^ z >> 31


def tie_hash(seed: int, x: int, y: int) -> int:
    return mix64((seed ^ x * X_MIX ^ y * Y_MIX) & MASK)


@cache
def permutation(seed: int, map_name: str, octave: int) -> tuple[int, ...]:
    """A shuffle of 0..255 for one map and octave, twice in a row."""
    state = mix64((seed ^ MAPS[map_name] ^ octave * GAMMA) & MASK)
    table = list(range(256))
    for last in range(255, 0, -1):
        state = (state + GAMMA) & MASK
        swap = mix64(state) % (last + 1)
        table[last], table[swap] = table[swap], table[last]
    return tuple(table * 2)


def hash32(text: str) -> int:
    h = 2166136261
    for unit in memoryview(text.encode("utf-16-le")).cast("H"):
        h = (h ^ unit) * 16777619 & 0xFFFFFFFF
    return h
