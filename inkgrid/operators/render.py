"""New text on a page, from glyph masks: clean, and with the texture of a scan.

Rasterising needs fonts and stays outside; what comes in is ``mask(page_id, y, x, m)``, m
from 0 to 255 where strokes are.  All steps are column expressions over the cells around
the strokes: a blur is a weighted sum over neighbours that are written out and summed by a
pre-aggregated group, and noise is a function of (seed, page, y, x), so results do not
depend on partitions.  Equal bits with other generators are no goal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import normal, to_byte, uniform
from .overlay import KEY, overlay
from .stats import CHANNELS, normalised

#: Cells around a stroke that any layer can reach.
REACH = 8
#: Widths of the blurs, by layer.
SOFT, SHOULDER, INNER, OUTER, WIDE = 0.34, 0.72, 0.24, 1.55, 2.35
#: Widths and amplitudes of the smooth noises.
INK_NOISE, FRINGE_NOISE, LOW_NOISE = (1.15, 0.18), (0.50, 9.0), (0.95, 1.0)


def weights(sigma: float) -> list[tuple[int, float]]:
    """A Gaussian's weights at whole distances; they sum to one."""
    reach = min(REACH, max(1, math.ceil(3 * sigma)))
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    return [(d, w / sum(raw)) for d, w in zip(range(-reach, reach + 1), raw, strict=True)]


def blurred(cells: DataFrame, value: str, sigma: float, name: str) -> DataFrame:
    """(page_id, y, x, ``name``): the values spread by a Gaussian; absent cells are zero."""
    for axis in ("y", "x"):
        near = F.explode(F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in weights(sigma)]))
        spread = cells.withColumn("k", near).withColumns({axis: F.col(axis) + F.col("k.d"), value: F.col(value) * F.col("k.w")})
        cells = spread.groupBy(*KEY).agg(F.sum(value).alias(value))
    return cells.withColumnRenamed(value, name)


def text_mask(mask: DataFrame, shoulder: float = 0.0) -> DataFrame:
    """The mask, with a part ``shoulder`` of its 3 x 3 maximum blended in."""
    if shoulder <= 0:
        return mask.select(*KEY, F.col("m").cast("double").alias("m"))
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    grown = mask.withColumn("k", near).select("page_id", (F.col("y") + F.col("k.dy")).alias("y"), (F.col("x") + F.col("k.dx")).alias("x"), "m", ((F.col("k.dy") == 0) & (F.col("k.dx") == 0)).alias("own"))
    both = grown.groupBy(*KEY).agg(F.max("m").alias("most"), F.coalesce(F.max(F.when(F.col("own"), F.col("m"))), F.lit(0)).alias("m"))
    return both.select(*KEY, (F.col("m") * (1 - shoulder) + F.col("most") * shoulder).alias("m"))


def smooth_noise(cells: DataFrame, seed: int, sigma: float, amplitude: float, name: str) -> DataFrame:
    """A smooth field over the cells, within half the amplitude of zero; a page whose noise
    has no span gets zeros."""
    raw = normalised(cells.select(*KEY, normal(seed, *KEY).alias("v")), "v")
    spanned = cells.groupBy("page_id").agg(F.count("*").alias("n"))
    field = blurred(raw.select(*KEY, "v"), "v", sigma, "v").join(blurred(cells.select(*KEY, F.lit(1.0).alias("o")), "o", sigma, "o"), KEY)
    inside = cells.select(*KEY).join(field, KEY).join(spanned, "page_id")
    value = F.when(F.col("n") > 1, (F.col("v") / F.col("o") - 0.5) * amplitude).otherwise(0.0)
    return inside.select(*KEY, value.alias(name))


def around(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells of the page within ``REACH`` of strokes, with the page's colours."""
    rows = F.explode(F.sequence(F.col("y") - REACH, F.col("y") + REACH))
    columns = F.explode(F.sequence(F.col("x") - REACH, F.col("x") + REACH))
    wide = mask.where("m > 0").select("page_id", "y", columns.alias("x")).distinct().select("page_id", rows.alias("y"), "x").distinct()
    return pixels.select(*KEY, *CHANNELS).join(wide, KEY, "left_semi")


def _layered(cells: DataFrame, mask: DataFrame, layers: dict[str, float]) -> DataFrame:
    """The cells with blurs of the mask (0..1), one for each width, by name."""
    ink = mask.select(*KEY, (F.col("m") / F.lit(255.0)).alias("v"))
    for name, sigma in layers.items():
        layer = blurred(ink, "v", sigma, name) if sigma else ink.withColumnRenamed("v", name)
        cells = cells.join(layer, KEY, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return cells


def _mixed(cells: DataFrame, alpha: Column, colour: list[Column]) -> DataFrame:
    """Colours laid over the cells; what is a rounding error below a level counts as it."""
    mix = lambda c, v: to_byte(F.round(F.col(c) * (1 - F.col("alpha")) + v * F.col("alpha"), 6)).alias(c)
    return cells.withColumn("alpha", alpha).select(*KEY, *[mix(c, v) for c, v in zip(CHANNELS, colour, strict=True)])


def clean_text(pixels: DataFrame, mask: DataFrame, colour: tuple[int, int, int], alpha: int = 252, blur: float = 0.16) -> DataFrame:
    """The page with the strokes in one colour, only a little softened: shows the place."""
    cells = _layered(pixels, mask, {"a": blur})
    return _mixed(cells, F.col("a") * alpha / 255, [F.lit(float(v)) for v in colour])


def fused_text(pixels: DataFrame, mask: DataFrame, ink: tuple[int, int, int], seed: int = 20260701, strength: float = 1.0, shoulder: float = 0.0, core: float = 0.965) -> DataFrame:
    """The page with strokes as a scanner sees them: soft shoulders, uneven ink, frayed
    edges and small holes, in sixteen levels of cover.  ``strength`` scales the roughness,
    ``core`` the cover of the strokes' middle."""
    base = seed * 100
    strokes = text_mask(mask, shoulder)
    cells = _layered(around(pixels, mask), strokes, {"full": 0.0, "soft": SOFT, "fringe": SHOULDER})
    for k, (sigma, amplitude) in enumerate((INK_NOISE, (FRINGE_NOISE[0], FRINGE_NOISE[1] * strength))):
        cells = cells.join(smooth_noise(cells.select(*KEY), base + (13, 25)[k], sigma, amplitude, f"n{k}"), KEY)
    rough = lambda k: normal(base + 100 + 2 * k, *KEY)
    chance = lambda k: uniform(base + 200 + k, *KEY)
    between = lambda k, a, b: a + (b - a) * chance(k)
    edge = (F.col("fringe") > 0.018) & (F.col("soft") < 0.93)
    cover = F.pow(F.least(F.lit(1.0), F.col("soft")), F.lit(0.86)) * core
    cover = cover * (1 + 0.45 * F.col("n0"))
    cover = cover + F.when(cover > 0.35, rough(0) * (0.030 * strength)).otherwise(0.0)
    cells = cells.withColumn("c", F.greatest(cover, F.col("fringe") * 0.37) + F.when(edge, rough(1) * (0.070 * strength)).otherwise(0.0))
    fray = F.when(edge & (chance(0) < 0.015 * strength), F.col("c") * between(1, 0.42, 0.78)).when(edge & (chance(0) > 0.986), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c") * 1.16 + 0.035))).otherwise(F.col("c"))
    cells = cells.withColumn("c", fray)
    holed = F.when((F.col("full") > 0.55) & (chance(2) < 0.006 * strength), F.col("c") * between(3, 0.72, 0.90)).otherwise(F.col("c"))
    cells = cells.withColumn("c", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), holed)) * 15) / 15)
    uneven = F.col("n1") + rough(2) * (1.1 * strength)
    tint = [F.greatest(F.lit(0.0), F.least(F.lit(255.0), v + uneven)) for v in map(float, ink)]
    return overlay(pixels, _mixed(cells, F.col("c"), tint))


def halo(pixels: DataFrame, mask: DataFrame, colour: tuple[int, int, int], seed: int = 20260701, strength: float = 1.0, shoulder: float = 0.0) -> DataFrame:
    """The page with a faint tint outside the strokes, never over a fifth of cover."""
    base = seed * 100 + 17
    cells = _layered(around(pixels, mask), text_mask(mask, shoulder), {"inner": INNER, "outer": OUTER, "wide": WIDE})
    cells = cells.join(smooth_noise(cells.select(*KEY), base, *LOW_NOISE, "low"), KEY)
    unit = lambda v, a=0.0, b=1.0: F.greatest(F.lit(a), F.least(F.lit(b), v))
    ring = unit((F.col("outer") - F.col("inner") * 0.58) * 1.18 + F.col("wide") * 0.13) * unit(1 - F.col("inner") * 0.88)
    grain = unit(0.72 + (F.col("low") + 0.5) * 0.48 + normal(base + 100, *KEY) * 0.22, 0.28, 1.35)
    drop, size = uniform(base + 200, *KEY), uniform(base + 201, *KEY)
    grain = F.when(drop < 0.018, grain * (0.25 + 0.45 * size)).when(drop > 0.988, grain * (1.08 + 0.27 * size)).otherwise(grain)
    cover = F.when(F.col("wide") < 0.006, 0.0).otherwise(unit(ring * grain * (0.118 * strength), 0.0, min(0.105 * strength, 0.20)))
    cells = cells.withColumns({"c": cover, "u": F.col("low") * 12 + normal(base + 102, *KEY) * 1.2})
    tint = [unit(v + F.col("u"), 0.0, 255.0) for v in map(float, colour)]
    return overlay(pixels, _mixed(cells, F.col("c"), tint))


def rendered(pixels: DataFrame, mask: DataFrame, stage: str, explicit: tuple[int, int, int] | None, sampled: tuple[int, int, int] | None = None, default: tuple[int, int, int] = (60, 60, 60), tint: tuple[int, int, int] = (150, 160, 180), **named) -> DataFrame:
    """One stage (``clean``, ``fusion``, ``halo``) or ``all`` of the last two in turn; the ink
    is the explicit colour, else the sampled one, else the default."""
    ink = explicit or sampled or default
    if stage == "clean":
        return clean_text(pixels, mask, ink)
    if stage not in ("fusion", "halo", "all"):
        raise ValueError(f"stage: {stage!r} is none of clean, fusion, halo, all")
    page = fused_text(pixels, mask, ink, **named) if stage in ("fusion", "all") else pixels
    return halo(page, mask, tint, **named) if stage in ("halo", "all") else page
