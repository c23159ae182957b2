"""A portable pseudorandom number of an integer: the same expression runs in any SQL dialect with 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A prime; squares of numbers below it fit in 63 bits.
PRIME = (1 << 31) - 1


def scatter_sql(x: str, seed: int | str) -> str:
    """SQL for a number from 0 to PRIME - 1 that looks random in x and the seed; not one-to-one."""
    h = f"((({x}) % {PRIME}) * 48271 + ({seed}) * 7919 + 12345) % {PRIME}"
    for factor, more in ((69621, 3), (40692, 7)):
        h = f"((({h}) * {factor} + {more}) % {PRIME})"
        h = f"(({h}) * ({h}) + ({x}) % {PRIME}) % {PRIME}"
    return f"({h})"


def scattered(x: str, seed: int | str) -> Column:
    return F.expr(scatter_sql(x, seed))
