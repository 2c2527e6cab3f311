"""Repeatable random draws.

A draw is a pure function of (seed, epoch, row id, purpose, number): the first 48
bits of an MD5 over the parts.  A rerun, another partition count or a retried task
therefore gives the same value, ids may be strings, and any SQL engine with
``md5`` can replay it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 48
DRAW_SPAN = 1 << DRAW_BITS
_HEX = DRAW_BITS // 4


def _part(value) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def draw(*parts) -> Column:
    """BIGINT in [0, 2**48), uniform."""
    digest = F.md5(F.concat_ws("|", *[_part(p) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("bigint")


def pick(n, *parts) -> Column:
    """Uniform in 0 .. n-1 (``n`` an int or a Column)."""
    n = n if isinstance(n, Column) else F.lit(int(n))
    return draw(*parts) % n.cast("bigint")


def coin(*parts) -> Column:
    """Fair coin as BOOLEAN."""
    return draw(*parts) % 2 == 1


def unit(*parts) -> Column:
    """DOUBLE in the open interval (0, 1)."""
    return (draw(*parts).cast("double") + F.lit(0.5)) / F.lit(float(DRAW_SPAN))


def gauss(mean: Column, std: Column, *parts) -> Column:
    """Normal draw (Box-Muller over two uniform draws)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(unit(*parts, "r")))
    angle = F.cos(F.lit(2.0 * math.pi) * unit(*parts, "t"))
    return mean + std * radius * angle


def choose(options: list, *parts) -> Column:
    """Uniform choice among literal options."""
    arr = F.array(*[F.lit(o) for o in options])
    return F.element_at(arr, (pick(len(options), *parts) + 1).cast("int"))
