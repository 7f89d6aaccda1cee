"""SplitMix64 as Column arithmetic: 64-bit numbers that wrap, kept in longs. Sums and products go by parts, as Spark's own
stop at an overflow. The same seed gives the same order on any cluster."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of SplitMix64.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
HALF = 0xFFFFFFFF


def signed(n: int) -> int:
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined(high: Column, low: Column) -> Column:
    """Both halves, cut at 32 bits."""
    return F.shiftleft(high.bitwiseAND(F.lit(HALF)), 32).bitwiseOR(low.bitwiseAND(F.lit(HALF)))


def plus(a: Column, b: Column) -> Column:
    low = a.bitwiseAND(F.lit(HALF)) + b.bitwiseAND(F.lit(HALF))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32)
    return let(low, lambda x: joined(high + F.shiftrightunsigned(x, 32), x))


def times(a: Column, c: int) -> Column:
    """a is named ten times, so it should be a column or a lambda's variable."""
    x = [F.shiftrightunsigned(a, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    y = [c >> 16 * i & 0xFFFF for i in range(4)]
    at = lambda k: sum((x[i] * F.lit(y[k - i]) for i in range(k + 1)), F.lit(0).cast("long"))
    low = at(0) + F.shiftleft(at(1), 16)
    return let(low, lambda n: joined(at(2) + F.shiftleft(at(3), 16) + F.shiftrightunsigned(n, 32), n))


def splitmix64(state: Column) -> Column:
    """The number that follows a state (a long)."""
    mix = lambda z, by: z.bitwiseXOR(F.shiftrightunsigned(z, by))
    last = lambda z: mix(z, 31)
    second = lambda z: let(times(z, SECOND), last)
    third = lambda z: let(mix(z, 27), second)
    first = lambda z: let(times(z, FIRST), third)
    return let(plus(state, F.lit(signed(GOLDEN))), lambda z: let(mix(z, 30), first))


def container_seed(uuid: Column) -> Column:
    """The two halves of a UUID (its hexadecimal text) by exclusive or; the golden ratio where that is 0."""
    bare = F.replace(uuid, F.lit("-"), F.lit(""))
    quarter = lambda i: F.conv(F.substring(bare, 8 * i + 1, 8), 16, 10).cast("long")
    half = lambda i: joined(quarter(2 * i), quarter(2 * i + 1))
    return let(half(0).bitwiseXOR(half(1)), lambda s: F.when(s == 0, F.lit(signed(GOLDEN))).otherwise(s))


def shuffled_key(seed: Column, number: Column) -> Column:
    """A row's place in the seeded order, as text that sorts like the unsigned number."""
    state = let(number.cast("long"), lambda n: plus(seed, times(n, GOLDEN)))
    return F.lpad(F.hex(let(state, splitmix64)), 16, "0")
