"""Regions, statistics, overlays and fills on small synthetic pages."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.functions.colour import feather, normal
from inkgrid.functions.names import derived_seeds, name_tokens, style_strength
from inkgrid.model import BOX, Box, InvalidInput, Move, page_points, parse_box, parse_boxes, parse_filter, parse_interval, parse_references, parse_strengths, text_crop_box
from inkgrid.operators import fill, kernels, match, overlay, regions, render, stats
from inkgrid.plans import queries, verify
from inkgrid.sources import fonts, rasters
from inkgrid.streaming import audit

SCHEMA = "page_id long, y int, x int, r int, g int, b int"


def page(spark, image, page_id=1):
    h, w = image.shape[:2]
    rgb = image if image.ndim == 3 else np.repeat(image[:, :, None], 3, 2)
    return spark.createDataFrame([(page_id, y, x, *map(int, rgb[y, x])) for y in range(h) for x in range(w)], SCHEMA)


def array(df, shape, page_id=1):
    out = np.full((*shape, 3), -1)
    for r in df.where(F.col("page_id") == page_id).collect():
        out[r["y"], r["x"]] = r["r"], r["g"], r["b"]
    return out


def band(h=40, w=50, paper=240, ink=60):
    image = np.full((h, w), paper)
    image[15:20, 10:40] = ink
    return image


@pytest.mark.parametrize("text", ["1,2,3", "a,b,c,d", "-1,0,5,5", "5,0,5,9", "0,9,5,2"])
def test_bad_boxes(text):
    with pytest.raises(InvalidInput):
        parse_box(text)


def test_parsers():
    assert parse_boxes("0,0,2,2; 1,1,3,3") == [Box(0, 0, 2, 2), Box(1, 1, 3, 3)]
    with pytest.raises(InvalidInput):
        parse_box("0,0,9,9", size=(8, 20))
    with pytest.raises(InvalidInput):
        parse_interval("5,3")
    assert parse_references(["a=0,0,1,1", "a=1,1,2,2"]) == {"a": Box(1, 1, 2, 2)}
    assert parse_filter(" song,, noto ") == ["song", "noto"]
    assert parse_strengths("1, ,0.5") == [1.0, 0.5]
    with pytest.raises(InvalidInput):
        parse_strengths("nan")
    with pytest.raises(InvalidInput):
        page_points(10, 10, 0)
    assert text_crop_box((100, 100), (400, 300), "abc", 20) == Box(40, 50, 360, 198)


def test_diff_box_and_outside(spark):
    before, after = np.full((30, 40), 245), np.full((30, 40), 245)
    after[5:10, 6:12] = 0
    a, b = page(spark, before), page(spark, after)
    row = verify.diff_report(a, b).first()
    assert (row["changed"], row["x1"], row["y1"], row["x2"], row["y2"]) == (30, 6, 5, 12, 10)
    assert verify.outside_allowed(a, b, [Box(6, 5, 12, 8), Box(0, 0, 7, 9)]).first()["outside"] == 11
    same = verify.diff_report(a, a).first()
    assert same["changed"] == 0 and same["x1"] is None


def test_masks_and_dilation(spark):
    image = np.full((20, 20), 245)
    image[10, 10] = 10
    px = page(spark, image)
    ink = {(r["y"], r["x"]) for r in regions.ink_mask(px, [Box(0, 0, 20, 20)]).collect()}
    assert len(ink) == 17 and (8, 10) in ink and (8, 9) not in ink
    cut = {(r["y"], r["x"]) for r in regions.ink_mask(px, [Box(10, 0, 20, 20)]).collect()}
    assert cut == {(y, x) for y, x in ink if x >= 10}
    boxes = spark.createDataFrame([(1, 0, 0, 5, 5), (1, 3, 3, 8, 8), (2, 0, 0, 20, 20)], "page_id long, x1 int, y1 int, x2 int, y2 int")
    assert regions.join_boxes(px, boxes, tile=4).count() == 46 == regions.full_mask(px, [Box(0, 0, 5, 5), Box(3, 3, 8, 8)]).count()
    assert regions.join_boxes(px, boxes, "left_anti", tile=4).count() == 400 - 46


def test_statistics(spark):
    image = band()
    px = page(spark, image)
    assert stats.dark_count(px, Box(0, 0, 50, 40)).first()["dark"] == 150
    assert stats.dark_count(px, Box(100, 100, 120, 120)).count() == 0
    assert stats.dark_median(px).first()["r_med"] == 60
    assert stats.background_median(page(spark, np.full((3, 3), 10))).first()["r_med"] == 10
    assert stats.ink_colour(px).first()["ink_r"] == 60
    gray = px.select("page_id", "y", "x", F.col("r").alias("gray"))
    row = stats.fingerprint(gray).first()
    assert row["density"] == pytest.approx(150 / 2000) and row["ratio"] == 6
    assert tuple(stats.ink_dims(gray).first())[1:] == (5, 30)
    assert stats.ink_centre(gray).first()["centre"] == 17
    blank = page(spark, np.full((9, 9), 255)).select("page_id", "y", "x", F.col("r").alias("gray"))
    assert stats.ink_dims(blank).first()["ink_h"] is None and stats.ink_centre(blank).first()["centre"] is None
    assert stats.boxes_centre(gray, [Box(10, 15, 20, 17), Box(10, 18, 40, 20)]).first()["centre"] == pytest.approx((15.5 + 18.5) / 2)
    flat = stats.normalised(gray.where("y < 3"), "gray").agg(F.max("gray")).first()[0]
    assert flat == 0


def test_feather_blend_and_noise(spark):
    cells = spark.range(400).select((F.col("id") % 20).cast("int").alias("x"), F.expr("cast(id div 20 as int)").alias("y"))
    alpha = {(r["x"], r["y"]): r["a"] for r in cells.select("x", "y", feather(F.col("x"), F.col("y"), 20, 20).alias("a")).collect()}
    assert alpha[0, 0] == 0 and alpha[10, 10] == 1 and alpha[2, 10] == 0.5
    many = spark.range(20000).select(normal(3, "id").alias("v"))
    assert many.agg(F.avg("v"), F.stddev("v")).first() == pytest.approx((0, 1), abs=0.03)
    assert many.agg(F.sum("v")).first() == pytest.approx(tuple(many.repartition(3).agg(F.sum("v")).first()))


def test_move_paste_and_crop(spark):
    image = band()
    px = page(spark, image)
    moved = array(overlay.move_block(px, Move((10, 40), (15, 20), 5)), image.shape)
    assert (moved[10:15, 10:40] == 60).all() and (moved[15:20, 10:40] == 60).all()
    cleaned = array(kernels.move_and_clean(px, Move((10, 40), (15, 20), 5), (50, 40)), image.shape)
    assert (cleaned[10:15, 10:40] == 60).all() and (cleaned[20:] == 240).all() and (cleaned >= 0).all()
    with pytest.raises(InvalidInput):
        Move((0, 60), (0, 5), 0).checked((50, 40))
    patch = regions.crop(px, Box(10, 15, 20, 20))
    assert (array(patch, (5, 10)) == 60).all()
    pasted = array(overlay.paste(px, patch, (0, 0), (10, 5), 0), image.shape)
    assert (pasted[:5, :10] == 60).all() and (pasted[5:15, :10] == 240).all()
    assert overlay.provenance("paste", [Box(0, 0, 1, 1)], {"edge": "0"}, px).first()["op"] == "paste"
    assert regions.stack([("a", px), ("b", px)]).agg(F.max("y")).first()[0] == 39 + 40 + 34 * 2 + 10


def test_normalising(spark):
    donor, target = np.full((10, 20), 240), np.full((10, 20), 230)
    donor[:, :5], target[:, :5] = 60, 50
    d, t = page(spark, donor), page(spark, target)
    out = overlay.normalise_contrast(d, t, t)
    assert array(out, donor.shape)[:, :5].max() <= 60 and out.first()["scale"] is not None
    assert overlay.normalise_contrast(page(spark, np.full((5, 5), 60)), t, t).first()["scale"] is None
    light = np.full((4, 4), 250)
    moved = overlay.normalise_offset(page(spark, light), page(spark, light - 2))
    assert (array(moved, (4, 4)) == 248).all()


def brute_fill(image, box, sample=45):
    h, w = image.shape[:2]
    left, right = image[box.y1 : box.y2, max(0, box.x1 - sample) : box.x1], image[box.y1 : box.y2, box.x2 : min(w, box.x2 + sample)]
    rows = []
    for row in np.concatenate([left, right], 1):
        paper = row[row.mean(1) > 238]
        rows.append(np.median(paper if len(paper) else row, 0))
    rows = np.pad(np.array(rows), ((5, 5), (0, 0)), mode="edge")
    out = image.copy()
    for i in range(box.y2 - box.y1):
        out[box.y1 + i, box.x1 : box.x2] = rows[i : i + 11].mean(0).astype(int)
    return out


def test_interpolation(spark):
    rng = np.random.default_rng(1)
    image = rng.integers(200, 256, (30, 40, 3))
    px = page(spark, image)
    for box in (Box(10, 5, 30, 25), Box(0, 0, 12, 3)):
        out = array(fill.interpolate(px, [box], (40, 30), sigma=0), image.shape[:2])
        assert (out == brute_fill(image, box)).all()
    assert (array(fill.interpolate(px, [Box(90, 90, 99, 99)], (40, 30)), image.shape[:2]) == image).all()
    wide = array(fill.interpolate(px, [Box(0, 10, 40, 14)], (40, 30), sigma=0), image.shape[:2])
    assert (wide[:10] == image[:10]).all() and (wide[10:14] > 150).all()
    whole = array(fill.interpolate(page(spark, np.full((4, 4), 77)), [Box(0, 0, 4, 4)], (4, 4), sigma=0), (4, 4))
    assert (whole == 77).all()


def test_compound(spark):
    image = band()
    out = array(kernels.move_and_clear(page(spark, image), Move((10, 40), (15, 20), 5), [Box(10, 15, 40, 20)], (50, 40), sigma=0), image.shape)
    assert (out[10:15, 10:40] == 60).all() and (out[15:20, 10:40] == 240).all()


def test_inpainting(spark):
    image = band()
    px = page(spark, image)
    out = array(kernels.remove(px, [Box(5, 10, 45, 25)], (50, 40)), image.shape)
    assert (out == 240).all()
    gradient = np.tile(np.arange(0, 200, 5), (20, 1))
    hole = np.zeros(gradient.shape, bool)
    hole[8:12, 15:20] = True
    filled = kernels.telea(np.repeat(gradient[:, :, None], 3, 2), hole)
    assert (filled[~hole][:, 0] == gradient[~hole]).all()
    assert np.abs(filled[:, :, 0] - gradient)[hole].max() < 25
    replaced = kernels.replace_with_donor(px, px, Box(5, 13, 25, 22), [Box(25, 10, 48, 25)], (26, 13), Box(0, 10, 50, 25), (50, 40), edge=0)
    assert (array(replaced, image.shape)[:, :9] == image[:, :9, None]).all()


def test_resize(spark):
    gray = spark.createDataFrame([(1, y, x, float(10 * x)) for y in range(12) for x in range(6)], "page_id long, y int, x int, gray double")
    rows = kernels.normalise_height(gray, 24).collect()
    assert len(rows) == 24 * 12 and min(r["gray"] for r in rows) == 0 and max(r["gray"] for r in rows) == 50


def test_matching(spark):
    pairs = [("a", float(i), float(2 * i + 1)) for i in range(9)] + [("flat", 3.0, float(i)) for i in range(9)]
    got = {r["k"]: r["ncc"] for r in match.ncc(spark.createDataFrame(pairs, "k string, a double, b double"), ["k"]).collect()}
    assert got["a"] == pytest.approx(1) and got["flat"] == 0
    cells = [(y, x, float((3 * y + 5 * x) % 11)) for y in range(6) for x in range(6)]
    target = spark.createDataFrame([("c", *c) for c in cells], "char string, y int, x int, gray double")
    good = [(0, "A", "c", 20, y, x + 1, g) for y, x, g in cells]
    bad = [(1, "B", "c", 20, y, x, float((y * y + x) % 7)) for y, x, _ in cells]
    glyphs = spark.createDataFrame(good + bad, "font_ord int, font string, char string, size int, y int, x int, gray double")
    ranked = match.rank_fonts(match.shifted_ncc(target, glyphs)).orderBy("rank").collect()
    assert ranked[0]["font"] == "A" and ranked[0]["total"] > ranked[1]["total"] and ranked[0]["verdict"] in ("certain", "likely")
    errors = spark.createDataFrame([(t, s, i, abs(s - (32 if t < 120 else 33)) / 10) for t in (80, 90, 100, 110, 120) for i, s in enumerate((31, 32, 33))], "threshold int, size int, size_ord int, error double")
    assert tuple(match.size_consensus(errors).first()) == (32, 5, 4, True)


def test_registry(spark):
    files = spark.createDataFrame([("/usr/share/fonts", "simsun.ttc"), ("/Library/Fonts", "Songti.ttc")], "dir string, file string")
    resolved = match.resolve_files(fonts.registry(spark), fonts.folders(spark), files)
    got = {r["spec"]: r["name"] for r in match.find_font(resolved, spark.createDataFrame([(s,) for s in ("宋体", "宋", "Song", "ong", "simsun", "SimSun", "SC")], "spec string")).collect()}
    assert got == {"宋体": "宋体 (SimSun)", "宋": None, "Song": "Songti SC", "ong": None, "simsun": "宋体 (SimSun)", "SimSun": "宋体 (SimSun)", "SC": "Songti SC"}
    assert match.default_font(resolved, fonts.preferred(spark)).first()["name"] == "宋体 (SimSun)"
    assert match.check_fonts(resolved, []).count() == 16
    assert match.check_fonts(resolved, ["songti"]).first()["installed"]
    row = spark.range(1).select(name_tokens(F.lit("仿宋 (FangSong)")).alias("t"), derived_seeds(F.lit(20260701)).alias("s"), style_strength(F.lit("a"), F.lit(None).cast("double"), {"a": 0.5}).alias("k")).first()
    assert row["t"] == ["仿宋", "fangsong"] and row["s"][0] == 2026070102 and row["k"] == 0.5


def test_page_image(spark):
    images = spark.createDataFrame([(1, 0, 5, 10.0, 10.0), (1, 0, 6, 100.0, 100.0), (1, 0, 6, 100.0, 100.0), (2, 0, 7, None, None), (3, 0, 1, 90.0, 100.0), (3, 0, 2, 100.0, 95.0)], "doc_id long, page_index int, xref int, rect_w double, rect_h double")
    pages = spark.createDataFrame([(d, 0, 100.0, 100.0) for d in (1, 2, 3)], "doc_id long, page_index int, w_pt double, h_pt double")
    got = {r["doc_id"]: (r["xref"], r["error"]) for r in match.select_page_image(images, pages).collect()}
    assert got[1] == (6, None) and got[2] == (7, None) and got[3][0] is None and got[3][1]
    assert {r["doc_id"]: r["xref"] for r in match.select_page_image(images, pages, strict=False).collect()}[3] == 2


def test_verify_cases(spark, tmp_path):
    before, after = band(), band()
    after[15:20, 10:40] = 240
    px = page(spark, before, 1).union(page(spark, after, 2)).union(page(spark, after[:30], 3))
    good = {"name": "good", "source_page": 1, "final_page": 2, "allowed_boxes": [{"x1": 10, "y1": 15, "x2": 40, "y2": 20}], "expected_changed_pixels": 150, "expected_changed_bbox": {"x1": 10, "y1": 15, "x2": 40, "y2": 20}, "blank_box": {"x1": 0, "y1": 0, "x2": 50, "y2": 40}, "page_size": {"w": 50.01, "h": 40.0}}
    cases = [good, good | {"name": "narrow", "allowed_boxes": [{"x1": 10, "y1": 15, "x2": 39, "y2": 20}]}, {"name": "lost", "source_page": 1, "final_page": 99}, {"name": "short", "source_page": 1, "final_page": 3}, {"name": "off", "source_page": 1, "final_page": 2, "preserve_box": {"x1": 90, "y1": 90, "x2": 99, "y2": 99}}, {"name": "unlike", "source_page": 1, "final_page": 2, "expected_page": 1}]
    (tmp_path / "cases.json").write_text(json.dumps(cases))
    table = rasters.verify_cases(spark, str(tmp_path / "cases.json"))
    assert table.where("name = 'lost'").first()["dark_threshold"] == 180
    meta = spark.createDataFrame([(2, 1, 0, 50.0, 40.0), (3, 1, 0, 50.0, 30.0)], "page_id long, pages int, page_index int, w_pt double, h_pt double")
    got = {r["name"]: r["errors"] for r in verify.verify_cases(table, px, meta).collect()}
    assert got == {"good": [], "narrow": ["changes outside the allowed boxes"], "lost": ["the final page is missing"], "short": ["source and final page differ in size"], "off": ["preserve box misses the page"], "unlike": ["the page differs from the expected one"]}
    again = {r["name"]: r["errors"] for r in verify.verify_cases(table, px, meta, reproduce=True).collect()}
    assert again["unlike"] == ["the baseline is out of tolerance"] and "no page to reproduce" in again["good"]


def test_files_and_stream(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "A.ttf").write_bytes(b"test")
    row = rasters.content_hashes(spark, str(tmp_path / "f")).first()
    assert row["sha256"].startswith("9f86d081")
    assert rasters.matching_files(spark, str(tmp_path / "f"), ["a.TTF"]).count() == 1
    pairs = verify.paired(page(spark, band()), page(spark, band(ink=61))).select(*[f.name for f in audit.PAIR.fields])
    pairs.write.parquet(str(tmp_path / "pairs"))
    query = audit.audit_stream(audit.page_pairs(spark, str(tmp_path / "pairs")), [Box(0, 0, 20, 20)]).writeStream.outputMode("complete").format("memory").queryName("audited").start()
    query.processAllAvailable()
    query.stop()
    row = spark.table("audited").first()
    assert (row["changed"], row["outside"]) == (150, 100)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert verify.diff_report(none, none).count() == 0
    assert regions.ink_mask(none, [Box(0, 0, 5, 5)]).count() == 0
    assert fill.interpolate(none, [Box(0, 0, 5, 5)], (9, 9)).count() == 0
    assert kernels.remove(none, [Box(0, 0, 5, 5)], (9, 9)).count() == 0
    assert BOX.fieldNames() == ["x1", "y1", "x2", "y2"]


def test_pages_of_two_sizes_are_refused(spark):
    image = np.full((8, 6), 200)
    whole, half = page(spark, image), page(spark, image[:4])
    for found in (verify.diff_report(whole, half), verify.outside_allowed(whole, half, []), verify.preserved_changes(whole, half, Box(0, 0, 6, 8)), verify.tolerance_diff(whole, half)):
        row = found.first().asDict()
        assert row.pop("misfit") == 24 and row.pop("page_id") == 1
        assert row.pop("within", False) is False and set(row.values()) == {None}
    assert verify.judged(verify.audit(whole, half, [])).first()["broken"] == "size"
    assert verify.preserved_changes(whole, whole, Box(90, 90, 99, 99)).first()["covered"] == 0


def test_ellipses():
    assert regions.ellipse(1) == [(0, 0)]
    assert sorted(regions.ellipse(3)) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    assert [sum(dy == k for dy, _ in regions.ellipse(5)) for k in range(-2, 3)] == [1, 5, 5, 5, 1]


def test_exact_medians_of_levels(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (11, 13, 3))
    found = stats.dark_median(page(spark, image)).first()
    dark = image[(image * [0.299, 0.587, 0.114]).sum(2) < 180]
    assert [found[f"{c}_med"] for c in "rgb"] == np.median(dark, 0).tolist()
    assert stats.dark_median(page(spark, np.full((3, 3), 250))).first()["r_med"] is None


def test_ink_is_cut_out(spark):
    gray = page(spark, band()).select("page_id", "y", "x", F.col("r").alias("gray"))
    assert stats.ink_crop(gray).agg(F.count("*"), F.max("y"), F.max("x")).first() == (150, 4, 29)
    assert stats.rendered_fingerprint(gray).first()["density"] == 1
    assert stats.ink_crop(gray.withColumn("gray", F.lit(250))).count() == 0


def test_a_glyph_slides_over_a_narrower_target(spark):
    rng = np.random.default_rng(7)
    target = rng.random((6, 5))
    wide = np.concatenate([rng.random((6, 3)), target, rng.random((6, 2))], 1)
    narrow = target[:, 1:4]
    cells = lambda a, *keys: [(*keys, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    t = spark.createDataFrame(cells(target, "a"), "char string, y int, x int, gray double")
    g = spark.createDataFrame(cells(wide, 0, "wide", "a", 9) + cells(narrow, 1, "narrow", "a", 9), "font_ord int, font string, char string, size int, y int, x int, gray double")
    got = {r["font"]: r["score"] for r in match.shifted_ncc(t, g).collect()}
    best = 0.0
    for dy in range(-2, 3):
        for dx in range(-1, 4):
            moved = np.zeros((6, 5))
            for y in range(6):
                for x in range(5):
                    if 0 <= y - dy < 6 and 0 <= x - dx < 3:
                        moved[y, x] = narrow[y - dy, x - dx]
            best = max(best, np.corrcoef(target.ravel(), moved.ravel())[0, 1])
    assert got["wide"] == pytest.approx(1) and got["narrow"] == pytest.approx(best)


def test_new_text(spark):
    image = np.full((40, 60), 240)
    px = page(spark, image)
    strokes = [(1, y, x, 255) for y in range(15, 25) for x in range(20, 24)] + [(1, y, 40, 255) for y in range(15, 25)]
    mask = spark.createDataFrame(strokes, "page_id long, y int, x int, m int")
    at = np.zeros(image.shape, bool)
    for _, y, x, _ in strokes:
        at[y, x] = True
    clean = array(render.clean_text(px, mask, (30, 40, 50)), image.shape)
    assert clean[20, 21].tolist() == [32, 42, 52] and (clean[~at] >= 235).all()
    one, two = (array(render.fused_text(px.repartition(n), mask, (30, 40, 50), seed=5), image.shape) for n in (1, 3))
    assert (one == two).all() and one[at].mean() < 120 < one[~at].mean()
    far = np.ones(image.shape, bool)
    far[7:33, 12:49] = False
    assert (one[far] == 240).all()
    other = array(render.fused_text(px, mask, (30, 40, 50), seed=6), image.shape)
    rough = array(render.fused_text(px, mask, (30, 40, 50), seed=5, strength=3.0), image.shape)
    thick = array(render.fused_text(px, mask, (30, 40, 50), seed=5, shoulder=0.25), image.shape)
    assert (other != one).any() and (rough != one).any() and thick.sum() < one.sum()
    tinted = array(render.halo(px, mask, (150, 160, 180), seed=5), image.shape)
    ring = (tinted != 240).any(2)
    assert ring.any() and (tinted[far] == 240).all() and (240 - tinted).max() <= 0.2 * 110
    assert (240 - tinted[:, :, 0])[at].mean() < (240 - tinted[:, :, 0])[ring & ~at].mean() + 1
    both = array(render.rendered(px, mask, "all", None, (30, 40, 50), seed=5), image.shape)
    assert both.sum() < one.sum()
    flat = render.smooth_noise(px.where("y = 0 and x = 0"), 1, 1.0, 5.0, "n").first()["n"]
    assert flat == 0
    with pytest.raises(ValueError):
        render.rendered(px, mask, "other", None)


def test_report_of_a_batch(spark):
    found = spark.createDataFrame([("a", []), ("b", ["size"])], "name string, errors array<string>")
    assert verify.report(found).first() == (2, 1, 1) and verify.report(found.where("name = 'a'")).first()["exit_code"] == 0


#: Queries that pair pages in place.
IN_PLACE = ["diff_report", "outside_allowed", "preserved_changes", "tolerance_diff", "verify_batch", "verify_rules"]


@pytest.mark.parametrize("name", IN_PLACE)
def test_pages_are_paired_without_shuffling_pixels(spark, name):
    """Under a byte of shuffle for a pixel, where a join writes both rasters."""
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    sf = "/root/testdata/sf0.01"
    pixels = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    before = written()
    assert queries.QUERIES[name](spark, sf).count() > 0
    assert written() - before < pixels


def test_pages_of_repeated_and_no_ids_are_joined(spark, tmp_path):
    rows = [(1, "a1 b2 " * 60), (2, "c3"), (2, "d4 e5 f"), (3, "g6 " * 90), (3, "g7 " * 90), (None, "h8 i"), (13, "j9 " * 70), (4, None), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = rasters.character_raster(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    after = rasters.edited_raster(before).where("not (page_id % 10 = 3 and y >= 2)")
    want = verify.diff_report(before, after).collect()
    assert sorted(map(repr, queries.QUERIES["diff_report"](spark, str(tmp_path)).collect())) == sorted(map(repr, want)) and len(want) == 5


@pytest.mark.parametrize("name", ["clean_text", "inpaint_telea", "fused_text", "halo", "replace_donor"])
def test_pages_edited_in_slices_are_the_same(spark, tmp_path, monkeypatch, name):
    rows = [(i, f"Ab 1 Cd{i} E " * 90) for i in range(9)] + [(3, "again Xy " * 120), (None, "No Id " * 160), (50, None), (51, "Z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda: sorted(map(repr, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    whole = found()
    monkeypatch.setattr(queries, "PAGES", 6)
    assert found() == whole and len(whole) > 8


#: Queries that edit pages in place, and the same by operators on tables of pixels.
EDITED = {
    "inpaint_telea": (10, lambda px: kernels.remove(px.drop("code"), [queries.D], (80, 10), threshold=90)),
    "replace_donor": (12, lambda px: kernels.replace_with_donor(px.drop("code"), px.drop("code"), Box(0, 0, 20, 6), [Box(30, 4, 50, 10)], (30, 4), queries.A, (80, 12), mode="offset")),
    "halo": (0, lambda px: render.halo(*queries._strokes(px), (150, 160, 180))),
    "fused_text": (0, lambda px: render.fused_text(*queries._strokes(px), queries._INK, shoulder=0.25)),
    "clean_text": (0, lambda px: render.clean_text(*queries._strokes(px), queries._INK, blur=0.6)),
}


@pytest.mark.parametrize("name", EDITED)
def test_pages_are_edited_without_shuffling_pixels(spark, name):
    """Under a tenth of a byte of shuffle for a pixel."""
    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    sf = "/root/testdata/sf0.01"
    pixels = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    before = written()
    assert queries.QUERIES[name](spark, sf).count() > 0
    assert written() - before < pixels / 10


@pytest.mark.parametrize("name", EDITED)
def test_pages_edited_in_place_equal_tables_of_pixels(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    letters = np.array(list("ABCXYZabc d\n0é世😀"))
    rows = [(i, "".join(rng.choice(letters, n))) for i, n in enumerate((1, 79, 239, 241, 800, 801, 870, 960, 1199, 1281, 1441, 4000))]
    rows += [(2**40, "Z" * 1000), (-7, "a" * 1000), (20, None), (21, ""), (None, "Ab" * 600)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    least, edit = EDITED[name]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.length("text") >= 80 * least)
    want = queries._sums(edit(rasters.character_raster(docs))).collect()
    found = queries.QUERIES[name](spark, str(tmp_path)).where("n is not null").select("page_id", "n", "places", "sum_r", "sum_g", "sum_b").collect()
    assert sorted(map(repr, found)) == sorted(map(repr, want)) and len(want) >= 8


def test_inpainting_many_pages_equals_one_at_a_time():
    rng = np.random.default_rng(5)
    images, heights = rng.integers(0, 256, (3, 40, 14, 20)), rng.integers(6, 15, 40)
    holes = (rng.random((40, 14, 20)) < rng.random(40)[:, None, None] * 0.9) & (np.arange(14)[:, None] < heights[:, None, None])
    holes[7] = False
    found = kernels.telea_pages(images, holes, heights, at_once=16)
    for i, h in enumerate(heights):
        want = kernels.telea(np.moveaxis(images[:, i, :h], 0, 2), holes[i, :h])
        assert (np.moveaxis(found[:, i, :h], 0, 2) == want).all(), i


@pytest.mark.parametrize("name", ["halo", "fused_text", "clean_text", "inpaint_telea", "replace_donor"])
def test_pages_of_one_id_keep_their_pixels(spark, tmp_path, name):
    rows = [(1, "Ab Cd " * 200), (2, "Ab Cd " * 200), (2, "x Y zW " * 180), (2, "tT" * 500), (None, "Qq" * 500), (None, "Rr" * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["page_id"]: r["n"] for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert found == {1: 1200, 2: 1200 + 1260 + 1000, None: 2000}


def test_new_text_on_pages_of_one_id_equals_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "Ab Cd " * 90), (2, "Ab Cd " * 90), (2, "x Y zW " * 100), (3, "E"), (None, "Qq" * 300), (None, "Rr" * 300), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(queries.ORACLE_SQL["clean_text"]).fetchall()
    found = [tuple(r) for r in queries.QUERIES["clean_text"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    docs = rasters.character_raster(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    found = [tuple(r) for r in queries._sums(render.clean_text(*queries._strokes(docs), queries._INK, blur=0.6)).collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_a_text_longer_than_a_piece_is_summed_whole(spark, tmp_path, monkeypatch):
    from inkgrid.operators import pages

    monkeypatch.setattr(pages, "PIECE", 100)
    lengths = np.array([70, 1, 250, 30, 99])
    codes = np.random.default_rng(1).integers(32, 127, lengths.sum()).astype(np.uint32)
    found, ends = pages._sums(lengths, codes), np.cumsum(lengths)
    for i, (end, n) in enumerate(zip(ends, lengths, strict=True)):
        want = pages._colours()[:, codes[end - n : end]].astype(np.int64) @ np.arange(1, n + 1)
        assert (found[:, i] == want).all()
