"""Glyph correlation, rankings, consensus and ordered lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import name_tokens

#: Fixed values of the verdicts: average score and margin for each candidate.
CERTAIN, LIKELY, MARGIN = 0.6, 0.5, 0.15


def ncc(pairs: DataFrame, by: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Normalised correlation of two grays in each group; 0 where one of them is flat.

    Sums are taken of centred values, so that no precision goes to large means."""
    means = pairs.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"))
    centred = pairs.join(means, by).select(*by, (F.col(a) - F.col("ma")).alias("u"), (F.col(b) - F.col("mb")).alias("v"))
    sums = centred.groupBy(*by).agg(F.sqrt(F.sum(F.col("u") * F.col("u"))).alias("nu"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nv"), F.sum(F.col("u") * F.col("v")).alias("uv"))
    flat = (F.col("nu") < 1e-6) | (F.col("nv") < 1e-6)
    return sums.select(*by, F.when(flat, 0.0).otherwise(F.try_divide(F.col("uv"), F.col("nu") * F.col("nv"))).alias("ncc"))


def best_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """Best correlation of each group, 0 at least."""
    return scores.groupBy(*by).agg(F.greatest(F.lit(0.0), F.max("ncc")).alias("score"))


def shifted_ncc(target: DataFrame, glyphs: DataFrame, shifts: int = 2, pad: float = 0.0) -> DataFrame:
    """Best correlation of each (font, char) over sizes and places, 0 at least.

    ``target(char, y, x, gray)`` and ``glyphs(font_ord, font, char, size, y, x, gray)``
    have equal heights.  A glyph that is narrower than its target is centred and shifted in
    both directions; one as wide or wider slides over it sideways.  Where it has no pixel,
    ``pad`` stands.
    """
    keys = ["font_ord", "font", "char", "size"]
    of_target = target.groupBy("char").agg((F.max("x") + 1).alias("tw"), (F.max("y") + 1).alias("th"))
    of_glyph = glyphs.groupBy(*keys).agg((F.max("x") + 1).alias("gw"), (F.max("y") + 1).alias("gh")).join(of_target, "char")
    wide = F.col("gw") >= F.col("tw")
    shift = lambda middle: F.sequence((middle - shifts).cast("int"), (middle + shifts).cast("int"))
    across = F.when(wide, F.sequence(F.col("tw") - F.col("gw"), F.lit(0))).otherwise(shift(F.floor((F.col("tw") - F.col("gw")) / 2)))
    down = F.when(wide, F.array(F.lit(0))).otherwise(shift(F.floor((F.col("th") - F.col("gh")) / 2)))
    search = of_glyph.withColumn("dx", F.explode(across)).withColumn("dy", F.explode(down)).select(*keys, "dy", "dx")
    cells = search.join(target.withColumnRenamed("gray", "a"), "char")
    moved = cells.withColumns({"gy": F.col("y") - F.col("dy"), "gx": F.col("x") - F.col("dx")})
    g = glyphs.select(*keys, F.col("y").alias("gy"), F.col("x").alias("gx"), F.col("gray").alias("b"))
    pairs = moved.join(g, [*keys, "gy", "gx"], "left").withColumn("b", F.coalesce("b", F.lit(pad)))
    return best_scores(ncc(pairs, [*keys, "dy", "dx"]), ["font_ord", "font", "char"])


def rank_fonts(scores: DataFrame) -> DataFrame:
    """Fonts by summed score, ties in registry order, with the margin to the next and a
    verdict for the first."""
    total = scores.groupBy("font_ord", "font").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    w = Window.orderBy(F.desc("total"), "font_ord")  # as many rows as fonts
    ranked = total.select("font_ord", "font", "total", "n", F.row_number().over(w).alias("rank"), (F.col("total") - F.lead("total", 1, 0.0).over(w)).alias("margin"), F.count("*").over(Window.partitionBy()).alias("fonts"))
    mean = F.col("total") / F.col("n")
    verdict = F.when(F.col("fonts") < 2, "reference only").when((mean >= CERTAIN) & (F.col("margin") >= MARGIN * F.col("n")), "certain").when(mean >= LIKELY, "likely").otherwise("doubtful")
    return ranked.select("rank", "font_ord", "font", "total", "margin", F.when(F.col("rank") == 1, verdict).alias("verdict"))


def size_errors(rendered: DataFrame, references: DataFrame) -> DataFrame:
    """Mean relative error of height plus width of each (threshold, size);
    ``rendered(threshold, size, size_ord, char, h, w)``, ``references(threshold, char, h, w)``."""
    ref = references.select("threshold", "char", F.col("h").alias("rh"), F.col("w").alias("rw")).where("rh is not null and rw is not null")
    error = F.abs(F.col("h") - F.col("rh")) / F.col("rh") + F.abs(F.col("w") - F.col("rw")) / F.col("rw")
    return rendered.join(ref, ["threshold", "char"], "left").groupBy("threshold", "size", "size_ord").agg(F.coalesce(F.avg(error), F.lit(9e9)).alias("error"))


def size_consensus(errors: DataFrame) -> DataFrame:
    """Best size of each threshold (the first of equals), their median, and agreement."""
    best = errors.groupBy("threshold").agg(F.min_by("size", F.struct("error", "size_ord")).alias("best"))
    median = best.agg(F.bround(F.median("best")).cast("int").alias("size"), F.count("*").alias("n"))
    both = best.crossJoin(median)  # one row
    return both.groupBy("size", "n").agg(F.count_if(F.col("best") == F.col("size")).alias("agree")).select("size", "n", "agree", (F.col("agree") >= F.col("n") - 1).alias("certain"))


def resolve_files(fonts: DataFrame, dirs: DataFrame, files: DataFrame) -> DataFrame:
    """Registry entries with the path of their file in the first folder that has it."""
    there = files.join(dirs, "dir").groupBy("file").agg(F.min_by(F.concat_ws("/", "dir", "file"), "dir_ord").alias("path"))
    return fonts.join(there, "file", "left").select("ord", "name", "file", "face", "path")


def find_font(resolved: DataFrame, specs: DataFrame) -> DataFrame:
    """The first installed entry for each ``spec``: its file or stem, a token of its name,
    or a prefix of a token of two letters or more."""
    s, f = F.lower("spec"), F.lower("file")
    token = F.exists(name_tokens(F.col("name")), lambda t: (t == s) | ((F.length(s) >= 2) & t.startswith(s)))
    hit = (s == f) | (s == F.regexp_replace(f, r"\.[^.]*$", "")) | token
    found = specs.join(resolved.where("path is not null"), hit).groupBy("spec").agg(F.min_by(F.struct("path", "face", "name"), "ord").alias("v"))
    return specs.select("spec").distinct().join(found, "spec", "left").select("spec", "v.path", "v.face", "v.name")


def default_font(resolved: DataFrame, preferred: DataFrame) -> DataFrame:
    """The first installed entry by keyword, then registry order; else the first at all."""
    have = resolved.where("path is not null")
    keyed = have.join(preferred, have["name"].contains(preferred["keyword"]), "left")
    last = F.lit(1 << 30)
    return keyed.orderBy(F.coalesce("pref_ord", last), "ord").limit(1).select("name", "path", "face")


def check_fonts(resolved: DataFrame, filters: list[str]) -> DataFrame:
    """Entries whose names hold any of the filters (all without one), installed or not."""
    chosen: Column = F.lit(not filters)
    for word in filters:
        chosen = chosen | F.contains(F.lower("name"), F.lit(word.lower()))
    return resolved.where(chosen).select("ord", "name", F.col("path").isNotNull().alias("installed"))


def select_page_image(images: DataFrame, pages: DataFrame, strict: bool = True) -> DataFrame:
    """The embedded image that is the page: the only one, or the one that covers most.

    Each image counts once per rectangle; ``error`` tells why none is chosen."""
    cover = images.dropDuplicates(["doc_id", "page_index", "xref", "rect_w", "rect_h"]).groupBy("doc_id", "page_index", "xref").agg(F.coalesce(F.sum(F.col("rect_w") * F.col("rect_h")), F.lit(0.0)).alias("area"))
    ratio = cover.join(pages, ["doc_id", "page_index"]).withColumn("ratio", F.col("area") / (F.col("w_pt") * F.col("h_pt")))
    w = Window.partitionBy("doc_id", "page_index").orderBy(F.desc("ratio"), "xref")
    top = ratio.select("doc_id", "page_index", "xref", "ratio", F.row_number().over(w).alias("rank"), F.lead("ratio").over(w).alias("second")).where("rank = 1")
    alone = F.col("second").isNull()
    error = F.when(~alone & (F.col("ratio") <= 0), "no image is placed on the page").when(F.lit(strict) & ~alone & (F.col("ratio") > 0.5) & (F.col("ratio") - F.col("second") < 0.1), "two images cover the page about equally")
    return top.select("doc_id", "page_index", F.when(error.isNull(), F.col("xref")).alias("xref"), "ratio", error.alias("error"))
