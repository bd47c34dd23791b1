"""Integer arithmetic that wraps around, and intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(value: int, bits: int) -> int:
    """``value`` in two's complement of so many bits."""
    return (value + (1 << (bits - 1))) % (1 << bits) - (1 << (bits - 1))


def _quotient(a: int, b: int) -> int:
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


_OPERATORS: dict[str, Callable[[int, int, int], int]] = {
    "+": lambda a, b, n: a + b, "-": lambda a, b, n: a - b, "*": lambda a, b, n: a * b, "/": lambda a, b, n: _quotient(a, b), "%": lambda a, b, n: a - _quotient(a, b) * b,
    "&": lambda a, b, n: a & b, "|": lambda a, b, n: a | b, "^": lambda a, b, n: a ^ b, "<<": lambda a, b, n: a << (b & (n - 1)), ">>": lambda a, b, n: a >> (b & (n - 1)),
    ">>>": lambda a, b, n: (a % (1 << n)) >> (b & (n - 1)),
}


def binary(op: str, left: int, right: int, bits: int = 32) -> int | None:
    """The wrapped result of a binary operator; division truncates; by zero it has no value."""
    if op in ("/", "%") and right == 0:
        return None
    return wrap(_OPERATORS[op](wrap(left, bits), wrap(right, bits), bits), bits)


def wrapped(value: Column, bits: int = 32) -> Column:
    """A decimal or bigint column wrapped to 8, 16 or 32 bits, within the JVM."""
    half, size = 1 << (bits - 1), 1 << bits
    return (F.pmod(value + F.lit(half), F.lit(size)) - F.lit(half)).cast("bigint")


def interval_contains(low: Column, high: Column, low_open: Column, high_open: Column, value: Column) -> Column:
    """Whether an interval with open or closed ends, null for no end, holds a value."""
    above = F.when(low.isNull(), True).when(low_open, value > low).otherwise(value >= low)
    below = F.when(high.isNull(), True).when(high_open, value < high).otherwise(value <= high)
    return above & below


def interval_meet(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> tuple[Column, Column, Column]:
    """Low end, high end and emptiness of the intersection of two closed intervals; null for no end."""
    low, high = F.greatest(a_low, b_low), F.least(a_high, b_high)
    return low, high, F.coalesce(low > high, F.lit(False))
