"""Ink and colour measurement by exact grouped aggregates, all pages in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import luma
from ..model import Box
from .regions import inside

CHANNELS = ("r", "g", "b")
#: Thresholds at which ink is sampled, from light to dark.
INK_THRESHOLDS = (180, 165, 150, 135, 120, 105)


def dark_count(pixels: DataFrame, box: Box, threshold: float = 180) -> DataFrame:
    """Dark pixels of a box; ``covered`` is how many the box holds at all, and a page
    where it is 0 has no row: nothing was checked there."""
    return pixels.where(inside(box)).groupBy("page_id").agg(F.count_if(luma() < threshold).alias("dark"), F.count("*").alias("covered"))


def level_medians(pixels: DataFrame, where: Column) -> DataFrame:
    """Exact medians of the channels of pixels that ``where`` holds for, from counts of their
    256 levels, which are summed up before the shuffle; null for a page without any."""
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.when(where, F.col(c)).alias("v")) for k, c in enumerate(CHANNELS)]))
    counts = pixels.select("page_id", levels.alias("l")).groupBy("page_id", "l.k", "l.v").agg(F.count("*").alias("n"))
    held = counts.groupBy("page_id", "k").agg(F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "n")))).alias("h"))
    total = F.aggregate("h", F.lit(0).cast("long"), lambda n, x: n + x["n"])

    def at(place: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("v"))
        step = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.when(acc["v"].isNull() & (acc["n"] + x["n"] > place), x["v"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate("h", start, step, lambda acc: acc["v"])

    median = (at(F.floor((total - 1) / 2)) + at(F.floor(total / 2))) / F.lit(2.0)
    each = held.select("page_id", "k", F.when(total > 0, median).alias("m"))
    return each.groupBy("page_id").agg(*[F.max(F.when(F.col("k") == k, F.col("m"))).alias(f"{c}_med") for k, c in enumerate(CHANNELS)])


def dark_median(pixels: DataFrame, threshold: float = 180) -> DataFrame:
    """Median colour of dark pixels; null without any."""
    return level_medians(pixels, luma() < threshold)


def background_median(pixels: DataFrame, threshold: float = 235) -> DataFrame:
    """Median colour of light pixels, of all pixels if none is light."""
    return pixels.groupBy("page_id").agg(*[F.coalesce(F.median(F.when(luma() > threshold, F.col(c))), F.median(c)).alias(f"{c}_med") for c in CHANNELS])


def ink_colour(pixels: DataFrame, thresholds: tuple[int, ...] = INK_THRESHOLDS) -> DataFrame:
    """Median colour at the darkest threshold that holds ink, rounded half to even;
    the median of all pixels where none does."""
    ordered = sorted(thresholds)
    return pixels.groupBy("page_id").agg(*[F.bround(F.coalesce(*[F.median(F.when(luma() < t, F.col(c))) for t in ordered], F.median(c))).cast("int").alias(f"ink_{c}") for c in CHANNELS])


def ink_samples(pixels: DataFrame, thresholds: tuple[int, ...] = INK_THRESHOLDS) -> DataFrame:
    """For each threshold: pixels darker than it, their median and mean colours."""
    levels = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    dark = pixels.select("page_id", *CHANNELS, luma().alias("l"), levels).where("l < threshold")
    return dark.groupBy("page_id", "threshold").agg(F.count("*").alias("n"), *[F.median(c).alias(f"{c}_med") for c in CHANNELS], *[F.avg(c).alias(f"{c}_avg") for c in CHANNELS])


def fingerprint(gray: DataFrame, threshold: float = 160) -> DataFrame:
    """Density of dark pixels, and the fullest row's count over the fullest column's."""
    cells = gray.select("page_id", "x", "y", (F.col("gray") < threshold).cast("long").alias("dark"))
    rows = cells.groupBy("page_id", "y").agg(F.sum("dark").alias("n"), F.count("*").alias("w")).groupBy("page_id").agg(F.max("n").alias("row"), F.sum("n").alias("dark"), F.sum("w").alias("area"))
    columns = cells.groupBy("page_id", "x").agg(F.sum("dark").alias("n")).groupBy("page_id").agg(F.max("n").alias("column"))
    return rows.join(columns, "page_id").select("page_id", (F.col("dark") / F.col("area")).alias("density"), F.when(F.col("column") > 0, F.col("row") / F.col("column")).otherwise(0.0).alias("ratio"))


def ink_bounds(gray: DataFrame, threshold: float = 160, least: int = 1) -> DataFrame:
    """Box of dark pixels; null where there are fewer than ``least``."""
    dark = F.col("gray") < threshold
    at = lambda f, c: F.when(F.count_if(dark) >= least, f(F.when(dark, F.col(c))))
    return gray.groupBy("page_id").agg(at(F.min, "x").alias("x1"), at(F.min, "y").alias("y1"), (at(F.max, "x") + 1).alias("x2"), (at(F.max, "y") + 1).alias("y2"))


def ink_crop(gray: DataFrame, threshold: float = 160) -> DataFrame:
    """Each page cut to the box of its ink and counted from its corner; a page without ink
    has no rows."""
    boxes = ink_bounds(gray, threshold).where("x1 is not null")
    cut = gray.join(boxes, "page_id").where((F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2")))
    return cut.select("page_id", (F.col("y") - F.col("y1")).alias("y"), (F.col("x") - F.col("x1")).alias("x"), "gray")


def rendered_fingerprint(glyphs: DataFrame, threshold: float = 160) -> DataFrame:
    """The fingerprint of glyph canvases, each cut to its ink first."""
    return fingerprint(ink_crop(glyphs, threshold), threshold)


def ink_dims(gray: DataFrame, threshold: float = 160) -> DataFrame:
    """Height and width of the ink; null with fewer than five dark pixels."""
    return ink_bounds(gray, threshold, 5).select("page_id", (F.col("y2") - F.col("y1")).alias("ink_h"), (F.col("x2") - F.col("x1")).alias("ink_w"))


def ink_centre(gray: DataFrame, threshold: float = 160) -> DataFrame:
    """Mean row of the ink; null without any."""
    return gray.groupBy("page_id").agg(F.avg(F.when(F.col("gray") < threshold, F.col("y"))).alias("centre"))


def boxes_centre(gray: DataFrame, boxes: list[Box], threshold: float = 160) -> DataFrame:
    """Unweighted mean of the ink centres of several boxes of each page."""
    number = F.explode(F.array(*[F.when(inside(b), F.lit(i)) for i, b in enumerate(boxes)]))
    own = gray.where(F.col("gray") < threshold).select("page_id", "y", number.alias("box")).where("box is not null")
    return own.groupBy("page_id", "box").agg(F.avg("y").alias("c")).groupBy("page_id").agg(F.avg("c").alias("centre"))


def align_delta(target: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rows by which rendered ink must move to the target's centre, half to even."""
    return target.join(rendered.withColumnRenamed("centre", "own"), "page_id").select("page_id", F.bround(F.col("centre") - F.col("own")).cast("int").alias("delta"))


def density_ratio(rendered: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean density of rendered glyphs over that of the references, and a verdict."""
    a, b = rendered.agg(F.avg("density").alias("a")), reference.agg(F.avg("density").alias("b"))
    ratio = F.when(F.col("b") > 0.01, F.col("a") / F.col("b"))
    return a.crossJoin(b).select(ratio.alias("ratio"), F.when(ratio > 1.5, "too heavy").when(ratio < 0.67, "too light").otherwise("plausible").alias("verdict"))


def normalised(values: DataFrame, column: str, by: str = "page_id") -> DataFrame:
    """Values stretched to 0..1 within each page; 0 where all are equal."""
    span = values.groupBy(by).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return values.join(span, by).withColumn(column, F.when(F.col("hi") > F.col("lo"), (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).drop("lo", "hi")
