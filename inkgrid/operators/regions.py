"""Selection by boxes: masks, unions, dilation, crops.

A few boxes given as Python objects become a predicate that the scan evaluates.  Tables
of boxes of any size are matched by tiles: boxes are spread over the tiles they touch,
and an equality join on (page, tile) is narrowed by the exact predicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import integer_gray
from ..model import Box

TILE = 64


def ellipse(size: int) -> list[tuple[int, int]]:
    """Neighbours (dy, dx) that an ellipse of ``size`` rows and columns reaches."""
    half = size // 2
    out = []
    for dy in range(-half, size - half):
        reach = round(half * math.sqrt(max(0, half * half - dy * dy)) / half) if half else 0
        out += [(dy, dx) for dx in range(max(-half, -reach), min(size - half - 1, reach) + 1)]
    return out


def inside(box: Box, x: str = "x", y: str = "y") -> Column:
    return (F.col(x) >= box.x1) & (F.col(x) < box.x2) & (F.col(y) >= box.y1) & (F.col(y) < box.y2)


def inside_any(boxes: Iterable[Box]) -> Column:
    return reduce(lambda a, b: a | b, [inside(b) for b in boxes], F.lit(False))


def select(pixels: DataFrame, boxes: Iterable[Box]) -> DataFrame:
    """Pixels in any box, each once."""
    return pixels.where(inside_any(boxes))


def reject(pixels: DataFrame, boxes: Iterable[Box]) -> DataFrame:
    """Pixels in no box."""
    return pixels.where(~inside_any(boxes))


def _tiled(boxes: DataFrame, tile: int) -> DataFrame:
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(b) - 1) / tile).cast("int")))
    ok = boxes.where("x1 < x2 and y1 < y2").select(F.col("page_id").alias("bp"), "x1", "y1", "x2", "y2")
    return ok.withColumn("tx", spread("x1", "x2")).withColumn("ty", spread("y1", "y2"))


def join_boxes(pixels: DataFrame, boxes: DataFrame, how: str = "left_semi", tile: int = TILE) -> DataFrame:
    """Pixels in any (``left_semi``) or in no box (``left_anti``) of a table
    ``boxes(page_id, x1, y1, x2, y2)``; overlapping boxes don't count twice."""
    t = _tiled(boxes, tile)
    on = (F.col("page_id") == t["bp"]) & (F.floor(F.col("x") / tile).cast("int") == t["tx"]) & (F.floor(F.col("y") / tile).cast("int") == t["ty"])
    return pixels.join(t, on & (F.col("x") >= t["x1"]) & (F.col("x") < t["x2"]) & (F.col("y") >= t["y1"]) & (F.col("y") < t["y2"]), how)


def crop(pixels: DataFrame, box: Box) -> DataFrame:
    """The pixels of a box, counted from its corner."""
    return pixels.where(inside(box)).withColumns({"x": F.col("x") - box.x1, "y": F.col("y") - box.y1})


def full_mask(pixels: DataFrame, boxes: Iterable[Box]) -> DataFrame:
    return select(pixels, boxes).select("page_id", "y", "x")


def ink_mask(pixels: DataFrame, boxes: Iterable[Box], threshold: int = 180, dilation: int = 5) -> DataFrame:
    """Dark pixels of the boxes, grown by an ellipse but not beyond the boxes."""
    boxes = list(boxes)
    ink = select(pixels, boxes).where(integer_gray() < threshold).select("page_id", "y", "x")
    if dilation <= 1:
        return ink
    return dilate(ink, dilation).join(select(pixels, boxes).select("page_id", "y", "x"), ["page_id", "y", "x"], "left_semi")


def dilate(mask: DataFrame, size: int = 5) -> DataFrame:
    """The mask and its elliptic neighbourhood, without a join: each pixel is expanded in
    place and copies are removed by a pre-aggregated distinct."""
    near = F.array(*[F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for dy, dx in ellipse(size)])
    return mask.withColumn("d", F.explode(near)).select("page_id", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x")).distinct()


def sizes(pixels: DataFrame) -> DataFrame:
    """Width and height of each page's raster."""
    return pixels.groupBy("page_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def stack(panels: list[tuple[str, DataFrame]], label: int = 34, gap: int = 10) -> DataFrame:
    """Panels of one page below each other, room for a label above each."""
    out, offset = None, F.lit(0)
    heights = [p.groupBy("page_id").agg((F.max("y") + 1).alias(f"h{i}")) for i, (_, p) in enumerate(panels)]
    for i, (name, panel) in enumerate(panels):
        placed = panel
        offset = F.lit(label * (i + 1) + gap * i)
        for j in range(i):
            placed = placed.join(heights[j], "page_id", "left")
            offset = offset + F.coalesce(F.col(f"h{j}"), F.lit(0))
        placed = placed.select("page_id", F.lit(name).alias("panel"), (F.col("y") + offset).alias("y"), "x", "r", "g", "b")
        out = placed if out is None else out.unionByName(placed)
    return out
