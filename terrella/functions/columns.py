"""Column helpers: 32-bit rounding, clamping, 64-bit wrapping products and string hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rng import MIX_1, MIX_2, X_MIX, Y_MIX, signed


def f32(c: Column) -> Column:
    """What a 32-bit map keeps of a double, as a double."""
    return c.cast("float").cast("double")


def f32_of(v: float) -> float:
    import struct

    return struct.unpack("<f", struct.pack("<f", v))[0]


def clamp01(c: Column) -> Column:
    """Bound to [0, 1]; NaN passes."""
    return F.when(c <= 0, F.lit(0.0)).when(c >= 1, F.lit(1.0)).otherwise(c)


def lerp(a: float, b: float, t: Column) -> Column:
    return F.lit(a) + F.lit(b - a) * clamp01(t)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mul64(a: Column, factor: int) -> Column:
    """a * factor modulo 2^64 on the bits of a bigint, by 16-bit limbs: no step overflows."""
    limb = lambda v, i: F.shiftrightunsigned(v, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long"))
    c = [factor >> 16 * i & 0xFFFF for i in range(4)]

    def of_limbs(a_: Column) -> Column:
        p = [limb(a_, i) for i in range(4)]
        t = [sum((p[i] * F.lit(c[n - i]).cast("long") for i in range(n + 1)), F.lit(0).cast("long")) for n in range(4)]
        high = F.aggregate(
            F.array(*t),
            F.struct(F.lit(0).cast("long").alias("carry"), F.lit(0).cast("long").alias("out"), F.lit(0).alias("at")),
            lambda acc, x: F.struct(
                F.shiftright(x + acc["carry"], 16).alias("carry"),
                acc["out"].bitwiseOR(F.call_function("shiftleft", (x + acc["carry"]).bitwiseAND(F.lit(0xFFFF).cast("long")), acc["at"])).alias("out"),
                (acc["at"] + 16).alias("at"),
            ),
        )
        return high["out"]

    return let(a, of_limbs)


def mix64(z: Column) -> Column:
    shifted = lambda v, n: v.bitwiseXOR(F.shiftrightunsigned(v, n))
    return let(mul64(let(mul64(let(z, lambda v: shifted(v, 30)), MIX_1), lambda v: shifted(v, 27)), MIX_2), lambda v: shifted(v, 31))


def tie_hash(seed: int, x: Column, y: Column) -> Column:
    """Bits of the unsigned 64-bit hash of a tile."""
    return mix64(F.lit(signed(seed)).bitwiseXOR(mul64(x.cast("long"), X_MIX)).bitwiseXOR(mul64(y.cast("long"), Y_MIX)))


def unsigned_mod(h: Column, n: Column) -> Column:
    half = F.pmod(F.shiftrightunsigned(h, 1), n)
    return F.pmod(half * 2 + h.bitwiseAND(F.lit(1).cast("long")), n)


def hash32(text: Column) -> Column:
    """FNV-1a over the characters of a text (of the basic plane), 32 bits unsigned as a bigint."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    step = lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), step)


def pick(options: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.pmod(hash32(key), F.lit(len(options))) + 1).cast("int"))


def decode(code: Column, names: list[str], what: str) -> Column:
    """Name of a code; an unknown one raises."""
    out = F.when(F.lit(False), F.lit(""))
    for i, name in enumerate(names):
        out = out.when(code == i, F.lit(name))
    return out.when(code.isNull(), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what} code "), code.cast("string"))))


def flag_names(mask: Column, names: list[str]) -> Column:
    """Names of set bits, lowest first; unknown bits are ignored."""
    return F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda v: v.isNotNull())
