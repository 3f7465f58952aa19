"""Grays, blending and conversions to bytes as column expressions.

Four grays are in use and must not be mixed up: ``luma`` for medians and dark counts,
``integer_gray`` for ink masks, ``channel_mean`` for the paper test, ``page_gray`` for
glyph measurement.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.expr(f"0.299D * {r} + 0.587D * {g} + 0.114D * {b}")


def integer_gray(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.expr(f"shiftright(9798 * {r} + 19235 * {g} + 3735 * {b} + 16384, 15)")


def page_gray(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.expr(f"shiftright(19595 * {r} + 38470 * {g} + 7471 * {b} + 32768, 16)")


def channel_mean(r: str = "r", g: str = "g", b: str = "b") -> Column:
    return F.expr(f"({r} + {g} + {b}) / 3D")


def to_byte(value: Column) -> Column:
    """Clip to 0..255, then cut the fraction off."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), value)).cast("int")


def feather(x: Column, y: Column, width: int, height: int, edge: float = 4) -> Column:
    """Alpha of a patch: rises from 0 at its border to 1 at ``edge`` pixels from it."""
    if edge <= 0 or width <= 2 or height <= 2:
        return F.lit(1.0)
    away = F.least(x, F.lit(width - 1) - x, y, F.lit(height - 1) - y).cast("double")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), away / F.lit(float(edge))))


def blend(base: Column, patch: Column, alpha: Column) -> Column:
    return to_byte(base * (F.lit(1.0) - alpha) + patch * alpha)


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) that depends on the keys alone, not on partitions."""
    low = F.xxhash64(F.lit(seed), *keys).bitwiseAND(F.lit((1 << 52) - 1))
    return (low + 0.5) / F.lit(float(1 << 52))


def normal(seed: int, *keys: str) -> Column:
    """A standard normal number of the keys, by Box and Muller."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * F.pi() * uniform(seed + 1, *keys))


def colour_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Sum of the channels' absolute differences; over 30 the colours look different."""
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1]) + F.abs(a[2] - b[2])


def close_size(w1: Column, h1: Column, w2: Column, h2: Column, tolerance: float = 0.02) -> Column:
    return (F.abs(w1 - w2) <= tolerance) & (F.abs(h1 - h2) <= tolerance)
