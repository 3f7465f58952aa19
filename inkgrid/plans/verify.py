"""Change auditing: what changed, where, was it allowed, is it clean.

All metrics of a page come from one join of both rasters on the pixel's key and one
grouped aggregate; the rules are a projection over them.  Where an edit is a function of
the page, ``edited`` pairs both colours in place and the functions ``*_of`` take that, so
that no pixel is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import close_size, luma
from ..model import Box
from ..operators.regions import inside, inside_any
from ..operators.stats import CHANNELS

#: What a rebuilt page may differ by.
MAX_CHANGED, MAX_LEVEL, MAX_MAE = 10_000, 4, 0.001
KEY = ["page_id", "y", "x"]


def paired(before: DataFrame, after: DataFrame) -> DataFrame:
    """Both colours of each pixel; a pixel that only one raster has is ``alone``."""
    b = before.select(*KEY, *[F.col(c).alias(f"{c}0") for c in CHANNELS])
    a = after.select(*KEY, *[F.col(c).alias(f"{c}1") for c in CHANNELS])
    return a.join(b, KEY, "full_outer")


def edited(raster: DataFrame, after: dict[str, Column], kept: Column | None = None) -> DataFrame:
    """The pairs of a raster and an edit of it, as ``paired`` has them, without a join; the
    edit lacks pixels for which ``kept`` is not true.  A page must be there once."""
    new = lambda c: after[c] if kept is None else F.when(kept, after[c])
    return raster.select(*KEY, *[new(c).alias(f"{c}1") for c in CHANNELS], *[F.col(c).alias(f"{c}0") for c in CHANNELS])


def changed() -> Column:
    return (F.col("r0") != F.col("r1")) | (F.col("g0") != F.col("g1")) | (F.col("b0") != F.col("b1"))


def alone() -> Column:
    return F.col("r0").isNull() | F.col("r1").isNull()


def largest_difference() -> Column:
    return F.greatest(*[F.abs(F.col(f"{c}0") - F.col(f"{c}1")) for c in CHANNELS])


def diff_columns() -> list[Column]:
    at = lambda f, c: f(F.when(changed(), F.col(c)))
    return [
        F.count_if(changed()).alias("changed"),
        at(F.min, "x").alias("x1"),
        at(F.min, "y").alias("y1"),
        (at(F.max, "x") + 1).alias("x2"),
        (at(F.max, "y") + 1).alias("y2"),
    ]


def tolerance_columns() -> list[Column]:
    total = sum((F.abs(F.col(f"{c}0") - F.col(f"{c}1")) for c in CHANNELS), F.lit(0))
    return [F.max(largest_difference()).alias("max_diff"), (F.sum(total) / (3 * F.count("*"))).alias("mae")]


def misfit() -> Column:
    """Pixels that one raster of a page has alone: the page has two sizes."""
    return F.count_if(alone()).alias("misfit")


def refused(found: DataFrame) -> DataFrame:
    """Metrics of pages of two sizes are null: they can't be compared."""
    keep = ("page_id", "misfit")
    return found.select(*[F.col(c) if c in keep else F.when(F.col("misfit") == 0, F.col(c)).alias(c) for c in found.columns])


def diff_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed pixels of each page and their box, null without any and for ``misfit``."""
    return diff_report_of(paired(before, after))


def diff_report_of(pairs: DataFrame) -> DataFrame:
    return refused(pairs.groupBy("page_id").agg(*diff_columns(), misfit()))


def outside_allowed(before: DataFrame, after: DataFrame, boxes: list[Box]) -> DataFrame:
    return outside_allowed_of(paired(before, after), boxes)


def outside_allowed_of(pairs: DataFrame, boxes: list[Box]) -> DataFrame:
    return refused(pairs.groupBy("page_id").agg(F.count_if(changed() & ~inside_any(boxes)).alias("outside"), misfit()))


def preserved_changes(before: DataFrame, after: DataFrame, box: Box) -> DataFrame:
    """Changes in a box that had to stay; a page that the box misses has none covered."""
    return preserved_changes_of(paired(before, after), box)


def preserved_changes_of(pairs: DataFrame, box: Box) -> DataFrame:
    found = pairs.groupBy("page_id").agg(F.count_if(inside(box) & changed()).alias("preserved"), F.count_if(inside(box)).alias("covered"), misfit())
    return refused(found)


def tolerance_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    return tolerance_diff_of(paired(before, after))


def tolerance_diff_of(pairs: DataFrame) -> DataFrame:
    found = refused(pairs.groupBy("page_id").agg(F.count_if(changed()).alias("changed"), *tolerance_columns(), misfit()))
    ok = (F.col("changed") <= MAX_CHANGED) & (F.col("max_diff") <= MAX_LEVEL) & (F.col("mae") <= MAX_MAE)
    return found.withColumn("within", F.coalesce(ok, F.lit(False)))


def report(results: DataFrame) -> DataFrame:
    """One row over the cases of a batch: how many, how many with errors, the exit code."""
    return results.agg(F.count("*").alias("cases"), F.count_if(F.size("errors") > 0).alias("failed")).withColumn("exit_code", (F.col("failed") > 0).cast("int"))


def audit(before: DataFrame, after: DataFrame, allowed: list[Box], dark: Box | None = None, preserve: Box | None = None, dark_threshold: int = 180) -> DataFrame:
    """All metrics of all pages in one aggregate."""
    return audit_of(paired(before, after), allowed, dark, preserve, dark_threshold)


def audit_of(pairs: DataFrame, allowed: list[Box], dark: Box | None = None, preserve: Box | None = None, dark_threshold: int = 180) -> DataFrame:
    of_dark = inside(dark) if dark else F.lit(False)
    of_kept = inside(preserve) if preserve else F.lit(False)
    return pairs.groupBy("page_id").agg(
        *diff_columns(),
        F.count_if(changed() & ~inside_any(allowed)).alias("outside"),
        F.count_if(of_dark & (luma("r1", "g1", "b1") < dark_threshold)).alias("dark"),
        F.count_if(of_dark).alias("dark_covered"),
        F.count_if(of_kept & changed()).alias("preserved"),
        F.count_if(of_kept).alias("preserve_covered"),
        F.count_if(alone()).alias("misfit"),
        *tolerance_columns(),
    )


def judged(metrics: DataFrame, dark_limit: int = 0) -> DataFrame:
    """The first rule that a page breaks, in the order of the checks, or none."""
    rule = (
        F.when(F.col("misfit") > 0, "size")
        .when(F.col("outside") > 0, "outside")
        .when(F.col("dark_covered") == 0, "dark box misses the page")
        .when(F.col("dark") > dark_limit, "dark")
        .when(F.col("preserve_covered") == 0, "preserve box misses the page")
        .when(F.col("preserved") > 0, "preserve")
    )
    return metrics.select("page_id", "changed", "outside", "dark", "preserved", rule.alias("broken"), rule.isNull().alias("passed"))


def verify_cases(cases: DataFrame, pixels: DataFrame, meta: DataFrame, digests: DataFrame | None = None, strict_hash: bool = False, reproduce: bool = False) -> DataFrame:
    """All cases of a table against rasters: a row for each with its metrics and errors.

    ``pixels`` holds every page by ``page_id``; ``meta(page_id, pages, page_index, w_pt,
    h_pt)``; ``digests(page_id, sha256)``.  A case that lacks a page, or whose boxes miss
    it, has an error of its own; others go on.  An expected page that differs, and pages
    of different sizes, hide what would come after, as those checks mean nothing then.
    """
    colour = lambda n: F.struct(*[F.col(c) for c in CHANNELS]).alias(n)
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_page").alias("page_id")) for r in ("source", "final", "expected")]))
    wanted = cases.select("name", roles.alias("w")).select("name", "w.role", "w.page_id").where("page_id is not null")
    cells = pixels.join(wanted, "page_id").select("name", "role", "y", "x", colour("v"))
    pick = lambda r: F.max(F.when(F.col("role") == r, F.col("v")))
    wide = cells.groupBy("name", "y", "x").agg(pick("source").alias("s"), pick("final").alias("f"), pick("expected").alias("e"))
    return cases_of(wide.join(cases, "name"), cases, meta, digests, strict_hash, reproduce)


def cases_of(c: DataFrame, cases: DataFrame, meta: DataFrame, digests: DataFrame | None = None, strict_hash: bool = False, reproduce: bool = False) -> DataFrame:
    """``verify_cases`` from cells (name, y, x, s, f, e) that hold the colours of the source,
    final and expected page, and the columns of their case."""
    within = lambda b: F.col(b).isNotNull() & (F.col("x") >= F.col(f"{b}.x1")) & (F.col("x") < F.col(f"{b}.x2")) & (F.col("y") >= F.col(f"{b}.y1")) & (F.col("y") < F.col(f"{b}.y2"))
    allowed = F.exists(F.coalesce("allowed_boxes", F.array().cast(cases.schema["allowed_boxes"].dataType)), lambda b: (F.col("x") >= b["x1"]) & (F.col("x") < b["x2"]) & (F.col("y") >= b["y1"]) & (F.col("y") < b["y2"]))
    differ = lambda a, b: (F.col(f"{a}.r") != F.col(f"{b}.r")) | (F.col(f"{a}.g") != F.col(f"{b}.g")) | (F.col(f"{a}.b") != F.col(f"{b}.b"))
    light = luma("f.r", "f.g", "f.b")
    moved = differ("s", "f")
    delta = [F.abs(F.col(f"e.{k}") - F.col(f"f.{k}")) for k in CHANNELS]
    metrics = c.groupBy("name").agg(
        F.count_if(F.col("s").isNotNull()).alias("n_source"),
        F.count_if(F.col("f").isNotNull()).alias("n_final"),
        F.count_if(F.col("e").isNotNull()).alias("n_expected"),
        F.count_if(F.col("s").isNull() != F.col("f").isNull()).alias("misfit"),
        F.count_if((F.col("e").isNull() != F.col("f").isNull()) | differ("e", "f")).alias("unexpected"),
        F.count_if(F.col("e").isNull() != F.col("f").isNull()).alias("baseline_misfit"),
        F.count_if(moved).alias("changed"),
        F.when(F.count_if(moved) > 0, F.struct(*[f(F.when(moved, F.col(k))).cast("int").alias(n) for n, f, k in (("x1", F.min, "x"), ("y1", F.min, "y"))], *[(F.max(F.when(moved, F.col(k))) + 1).cast("int").alias(n) for n, k in (("x2", "x"), ("y2", "y"))])).alias("bbox"),
        F.count_if(moved & ~allowed).alias("outside"),
        F.count_if(within("blank_box") & F.col("f").isNotNull()).alias("blank_covered"),
        F.count_if(within("blank_box") & (light < 180)).alias("blank_dark"),
        F.count_if(within("preserve_box") & F.col("f").isNotNull()).alias("preserve_covered"),
        F.count_if(within("preserve_box") & moved).alias("preserved"),
        F.count_if(within("dark_box") & F.col("f").isNotNull()).alias("dark_covered"),
        F.count_if(within("dark_box") & (light < F.col("dark_threshold"))).alias("region_dark"),
        F.max(F.greatest(*delta)).alias("max_channel_diff"),
        F.count_if(F.greatest(*delta) > 0).alias("baseline_changed"),
        (F.sum(delta[0] + delta[1] + delta[2]) / (3 * F.count(delta[0]))).alias("mae"),
    )
    final = meta.select(F.col("page_id").alias("final_page"), F.col("page_index"), "pages", "w_pt", "h_pt")
    all_of = cases.join(metrics, "name", "left").join(final, ["final_page", "page_index"], "left")
    if digests is not None:
        all_of = all_of.join(digests.select(F.col("page_id").alias("final_page"), "sha256"), "final_page", "left")
    else:
        all_of = all_of.withColumn("sha256", F.lit(None).cast("string"))
    given = lambda k: F.col(k).isNotNull()
    say = lambda on, text: F.when(on, text)
    missing = F.coalesce("n_final", F.lit(0)) == 0
    unexpected = given("expected_page") & F.lit(not reproduce) & (F.col("unexpected") > 0)
    misfit = ~unexpected & (F.col("misfit") > 0)
    go = ~unexpected & ~misfit & ~missing
    box = lambda b, covered, text: say(go & given(b) & (F.col(covered) == 0), f"{text} box misses the page")
    errors = F.array(
        say(missing, "the final page is missing"),
        say(given("pages") & (F.col("pages") != F.col("expected_pages")), "page count"),
        say(given("page_size") & given("w_pt") & ~close_size(F.col("w_pt"), F.col("h_pt"), F.col("page_size.w"), F.col("page_size.h")), "page size"),
        say(F.lit(strict_hash) & given("expected_sha256") & ~F.col("expected_sha256").eqNullSafe(F.col("sha256")), "hash"),
        say(~missing & unexpected, "the page differs from the expected one"),
        say(~missing & misfit, "source and final page differ in size"),
        say(go & given("expected_changed_pixels") & (F.col("changed") != F.col("expected_changed_pixels")), "changed pixels"),
        say(go & given("expected_changed_bbox") & ~F.col("bbox").eqNullSafe(F.col("expected_changed_bbox")), "changed box"),
        say(go & (F.size(F.coalesce("allowed_boxes", F.array().cast(cases.schema["allowed_boxes"].dataType))) > 0) & (F.col("outside") > 0), "changes outside the allowed boxes"),
        box("blank_box", "blank_covered", "blank"),
        say(go & given("blank_box") & (F.col("blank_dark") > F.col("blank_dark_limit")), "blank box is dark"),
        box("preserve_box", "preserve_covered", "preserve"),
        say(go & given("preserve_box") & (F.col("preserved") > 0), "preserve box changed"),
        box("dark_box", "dark_covered", "dark"),
        say(go & given("dark_box") & (F.col("region_dark") > F.col("dark_limit")), "dark box is dark"),
        say(go & F.lit(reproduce) & ~given("expected_page"), "no page to reproduce"),
        say(go & F.lit(reproduce) & (F.col("baseline_misfit") > 0), "the baseline differs in size"),
        say(go & F.lit(reproduce) & (F.col("baseline_misfit") == 0) & ((F.col("baseline_changed") > MAX_CHANGED) | (F.col("max_channel_diff") > MAX_LEVEL) | (F.col("mae") > MAX_MAE)), "the baseline is out of tolerance"),
    )
    warning = say(F.lit(not strict_hash) & given("expected_sha256") & ~F.col("expected_sha256").eqNullSafe(F.col("sha256")), "hash")
    return all_of.select("name", "changed", "bbox", "outside", "blank_dark", "preserved", "region_dark", "max_channel_diff", "mae", F.filter(errors, lambda e: e.isNotNull()).alias("errors"), warning.alias("warning"))
