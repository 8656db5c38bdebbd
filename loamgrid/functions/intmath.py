"""Exact integer helpers: truncating, floor and unsigned 64-bit arithmetic as Columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64 = 2**64


def _wide(n: int) -> Column:
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def _c(x: Column | str | int) -> Column:
    return F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, int) else x


def div(a, b) -> Column:
    """Integer division towards zero, exact over all of BIGINT."""
    return F.call_function("div", _c(a), _c(b))


def floor_div(a, b) -> Column:
    """Integer division towards minus infinity, for a positive divisor; exact over all of BIGINT."""
    a, b = _c(a), _c(b)
    return div(a, b) - F.when(a % b < 0, 1).otherwise(0)


def let(x: Column, f) -> Column:
    """f(x) with x worked out once, however often f uses it: nested mixes would else grow without bound."""
    return F.transform(F.array(x), f)[0]


def u64(x: Column) -> Column:
    """A BIGINT bit pattern as an unsigned DECIMAL(20,0)."""
    return let(x.cast("decimal(38,0)"), lambda d: F.when(d < 0, d + _wide(TWO64)).otherwise(d).cast("decimal(20,0)"))


def umod(x: Column, n: int) -> Column:
    """A bit pattern, read as unsigned, modulo n (up to 2^61), in BIGINT."""
    return let(x, lambda v: (F.shiftrightunsigned(v, 1) % n * 2 + v.bitwiseAND(1)) % n)


LOW32, LOW16 = 2**32 - 1, 2**16 - 1


def times(x: Column, constant: int) -> Column:
    """The product of a bit pattern and a constant, modulo 2^64, as a bit pattern: 32-bit by 16-bit products, none of which overflows a BIGINT."""
    high, low = divmod(constant, 2**32)
    parts = lambda c: (F.lit(c % 2**16).cast("bigint"), F.lit(c // 2**16).cast("bigint"))
    (h0, h1), (l0, l1) = parts(high), parts(low)
    upper = lambda v, c0, c1: v * c0 + F.shiftleft((v * c1).bitwiseAND(LOW16), 16)  # noqa: E731  modulo 2^32, but for bits above

    def product(v: Column) -> Column:
        lo, hi = v["lo"], v["hi"]
        return let(F.struct((lo * l0).alias("a"), (lo * l1).alias("b")), lambda p: let(
            p["a"] + F.shiftleft(p["b"].bitwiseAND(LOW16), 16),
            lambda t: F.shiftleft(F.shiftrightunsigned(t, 32) + F.shiftrightunsigned(p["b"], 16) + upper(hi, l0, l1) + upper(lo, h0, h1), 32).bitwiseOR(t.bitwiseAND(LOW32)),
        ))

    return let(x.cast("bigint"), lambda v: let(F.struct(v.bitwiseAND(LOW32).alias("lo"), F.shiftrightunsigned(v, 32).alias("hi")), product))


def fold(x: Column, by: int) -> Column:
    """x xor (x >> by), unsigned."""
    return let(x, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, by)))


def mix64(x: Column) -> Column:
    """The 64-bit finalizer with two multiplications, on bit patterns."""
    # The finalizer's multipliers.
    return fold(times(fold(times(fold(x, 30), 0xBF58476D1CE4E5B9), 27), 0x94D049BB133111EB), 31)


def variation(x: Column, n: int) -> Column:
    """A choice among n, spread over ids: one multiplication between two shifts; 0 for n = 0."""
    if n == 0:
        return F.lit(0).cast("bigint")
    # Fixed value: the multiplier.
    return umod(fold(times(fold(x, 33), 0xFF51AFD7ED558CCD), 33), n)


def fnv1a64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes of a short key, as DECIMAL(20,0)."""
    # The offset basis and the prime.
    basis, prime = 14695981039346656037, 1099511628211
    raw = F.hex(F.encode(text, "UTF-8"))
    byte = lambda i: F.conv(F.substring(raw, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(0), (F.length(raw) / 2 - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return u64(F.aggregate(places, F.lit(basis - TWO64).cast("bigint"), lambda h, i: times(h.bitwiseXOR(byte(i)), prime)))


def rotated(x: Column, by: int) -> Column:
    """x rotated left by so many bits, as a bit pattern."""
    return F.shiftleft(x.cast("bigint"), by).bitwiseOR(F.shiftrightunsigned(x.cast("bigint"), 64 - by))


def primitive_key(object_id: Column, stage: Column, ordinal: Column) -> Column:
    """The key of an object's n-th primitive of a stage, as DECIMAL(20,0); never 0."""
    # What the stage and the ordinal are multiplied with.
    x = object_id.bitwiseXOR(times(stage.cast("bigint"), 0x9E3779B97F4A7C15)).bitwiseXOR(times(ordinal.cast("bigint"), 0xBF58476D1CE4E5B9))
    key = u64(mix64(x))
    return F.when(key == 0, F.lit(1).cast("decimal(20,0)")).otherwise(key)


def facade_variant(object_id: Column, ring: Column, edge: Column, floor: Column, bay: Column) -> Column:
    """A choice for an opening of a wall, as an unsigned DECIMAL(20,0)."""
    # The rotations.
    x = object_id
    for part, by in ((ring, 11), (edge, 23), (floor, 37), (bay, 49)):
        x = x.bitwiseXOR(rotated(part, by))
    return u64(mix64(x))
