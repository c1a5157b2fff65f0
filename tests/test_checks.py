"""Letter heights, placement, checks between readings, and order on a page."""

import pytest
from pyspark.sql import functions as F

from labelkite.operators import checks, measure, rules

BOX = "bbox struct<x1 int, y1 int, x2 int, y2 int>"


def packs(spark, *rows):
    kind = "inspection_id int, calibration_px_per_mm double, calibration_source string, panel_width_mm double, panel_height_mm double, pdp_area_cm2 double, family string, moulded boolean"
    return spark.createDataFrame(list(rows), kind)


def images(spark, *rows):
    return spark.createDataFrame(list(rows), "inspection_id int, image_id int, role string, width int, height int, dpi double")


def test_scale_and_area(spark):
    p = packs(spark, (1, 10.0, "", 80.0, 50.0, 9.0, "MASS", False), (2, None, None, None, None, 9.0, "MASS", False), (3, None, None, None, None, None, "MASS", False), (4, 0.0, "", 0.0, 5.0, None, None, None))
    i = images(spark, (2, 1, "BACK", 10, 10, 72.0), (2, 2, "FRONT", 10, 10, 254.0), (3, 1, "BACK", 100, 100, 254.0), (3, 2, "front", 1000, 500, 508.0), (3, 3, None, None, None, None))
    got = {r.inspection_id: (r.px_per_mm, r.scale_source, r.area_cm2, r.area_source) for r in measure.panel_areas(measure.scales(p, i), i).collect()}
    assert got == {1: (10.0, "manual_calibration", 40.0, "measured"), 2: (10.0, "image_dpi(254)", 9.0, "entered"), 3: (10.0, "image_dpi(254)", 50.0, "estimated"), 4: (None, "UNAVAILABLE", None, "unavailable")}


@pytest.mark.parametrize(
    ("pack", "heights", "want"),
    [
        ((1, 10.0, "", 100.0, 20.0, None, "MASS", False), [20, 40], ("PASS", 0.75, 1.0)),  # 20 square cm, 1.5 mm of at least 1
        ((1, 10.0, "", 100.0, 20.0, None, "MASS", False), [8, 40], ("FAIL", 0.6, 1.0)),
        ((1, 10.0, "", 100.0, 20.0, None, "MASS", False), [13], ("UNCERTAIN", 0.4, 1.0)),  # 0.98 mm is within the tolerance
        ((1, 10.0, "", 100.0, 20.0, None, None, False), [8], ("UNCERTAIN", 0.3, None)),
        ((1, None, "", 100.0, 20.0, None, "MASS", False), [8], ("UNCERTAIN", 0.2, None)),
        ((1, 10.0, "", None, None, 200.0, "NUMBER", True), [8], ("FAIL", 0.6, 4.0)),
        ((1, 10.0, "", 100.0, 20.0, None, "MASS", False), [], ("UNCERTAIN", 0.3, 1.0)),
    ],
)
def test_height_check(spark, pack, heights, want):
    p = packs(spark, pack)
    i = images(spark)
    fields = spark.createDataFrame([(1, f"f{k}", "MRP 10", (0, 0, 60, h)) for k, h in enumerate(heights)], f"inspection_id int, field_name string, text string, {BOX}")
    paneled = measure.panel_areas(measure.scales(p, i), i)
    r = measure.height_checks(paneled, measure.measurements(fields, paneled)).first()
    assert (r.status, r.confidence, r.required_mm) == want


def test_estimates_fail_only_below_the_next_smaller_panel(spark):
    # 60 square cm by the image: 1.5 mm asked, 1 mm on the next smaller panel
    p, i = packs(spark, (1, 10.0, "", None, None, None, "MASS", False)), images(spark, (1, 1, "FRONT", 1000, 600, None))
    paneled = measure.panel_areas(measure.scales(p, i), i)
    for height, want in ((20, "PASS"), (15, "UNCERTAIN"), (10, "FAIL")):
        f = spark.createDataFrame([(1, "mrp", "MRP", (0, 0, 60, height))], f"inspection_id int, field_name string, text string, {BOX}")
        assert measure.height_checks(paneled, measure.measurements(f, paneled)).first().status == want


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (12.0, 12.5, 0.1234567, 100.10, -3.0)], "x double")
    assert [r[0] for r in df.select(measure.number_text(F.col("x"))).collect()] == ["12", "12.5", "0.123457", "100.1", "-3"]


@pytest.mark.parametrize(
    ("roles", "want"),
    [(["FRONT", "TOP"], ("PASS", 0.55)), (["FRONT", ""], ("PASS", 0.55)), (["BACK"], ("UNCERTAIN", 0.4)), (["FRONT", "BACK"], ("UNCERTAIN", 0.4)), ([None], ("UNCERTAIN", 0.3)), (["BACK", None], ("UNCERTAIN", 0.3)), ([], ("UNCERTAIN", 0.3))],
)
def test_placement(spark, roles, want):
    f = spark.createDataFrame([(1, "mrp", "Rs 10", "DETECTED", r) for r in roles] + [(1, "brand", "X Y", "DETECTED", "BACK"), (1, "mrp", "", "DETECTED", "BACK")], "inspection_id int, field_name string, value string, state string, role string")
    r = rules.placement(spark.createDataFrame([(1,)], "inspection_id int"), f, ("mrp",)).first()
    assert (r.status, r.confidence) == want


def test_calibration_keeps_the_last_valid_one(spark):
    p = packs(spark, (1, 5.0, "old", None, None, 9.0, "MASS", False), (2, 5.0, "old", None, None, 9.0, "MASS", False))
    kind = "inspection_id int, updated_at int, px_per_mm double, reference_px double, reference_mm double, panel_width_mm double, panel_height_mm double, pdp_area_cm2 double, moulded boolean"
    u = spark.createDataFrame([(1, 1, 7.0, None, None, None, None, None, True), (1, 2, None, 100.0, 12.5, None, None, None, False), (1, 3, -1.0, None, None, None, None, None, False), (2, 1, None, None, None, 4.0, None, None, False)], kind)
    got = {r.inspection_id: (r.calibration_px_per_mm, r.calibration_source, r.pdp_area_cm2) for r in measure.calibrated(p, u).collect()}
    assert got == {1: (8.0, "reference_length(12.5 mm, 100 px)", None), 2: (5.0, "old", 9.0)}


@pytest.mark.parametrize(
    ("email", "others", "want"),
    [("care@britindia.com", "BRIT-INDIA Foods", True), ("care@briindio.com", "BRIT-INDIA Foods", False), ("a@gmail.com", None, True), ("none", "x", None), (None, "x", None), ("a@", "x", None)],
)
def test_corroborated(spark, email, others, want):
    df = spark.createDataFrame([(email, others)], "e string, o string")
    assert df.select(checks.corroborated(F.col("e"), F.col("o"))).first()[0] is want


@pytest.mark.parametrize(
    ("dates", "want"),
    [
        (("2025-01-10", "2024-01-10", "2024-02-10", None, "2025-02-10"), [("best_before", "CONSISTENT"), ("packing", "CONSISTENT")]),
        (("2025-01-10", "2024-01-10", "2024-01-09", None, "2025-06-10"), [("best_before", "INCONSISTENT"), ("packing", "INCONSISTENT")]),
        (("12 months", None, None, None, None), [("best_before", "UNVERIFIABLE")]),
        (('{"type": "DURATION_FROM_REFERENCE", "duration": "6 months", "reference": "PACKING_DATE"}', None, "2024-01", None, "2024-07-01"), [("best_before", "CONSISTENT")]),
        ((None, "2024-01-01|AMBIGUOUS", None, None, "2050-01-01"), [("shelf_life", "INCONSISTENT")]),
        (("junk", "2024-13-45", "", None, None), []),
        ((None, None, None, None, None), []),
    ],
)
def test_date_findings(spark, dates, want):
    df = spark.createDataFrame([dates], "b string, m string, p string, i string, e string")
    got = df.select(checks.date_findings(*[F.col(c) for c in "bmpie"])).first()[0]
    assert [tuple(r) for r in got] == want


@pytest.mark.parametrize(("line", "want"), [("PKD 150324 B", "2024-03-15"), ("15032024", "2024-03-15"), ("310224", None), ("8901234567890 150324", None), ("1503249", None), ("", None), (None, None)])
def test_date_code(spark, line, want):
    assert spark.createDataFrame([(line,)], "t string").select(checks.date_code(F.col("t"))).first()[0] == want


def test_marks_on_other_panels(spark):
    lines = spark.createDataFrame([(1, 1, "BRITAN"), (1, 2, "Made by BritanIndustries Ltd"), (1, 3, "xbritan"), (2, 1, "SOLO"), (2, 1, "solo again")], "inspection_id int, image_id int, text string")
    marks = spark.createDataFrame([(1, 1, "BRITAN"), (2, 1, "SOLO"), (1, 1, "a.b"), (1, 1, "")], "inspection_id int, image_id int, token string")
    assert [tuple(r) for r in checks.marks_on_other_panels(marks, lines).collect()] == [(1, 1, "BRITAN")]


def test_outcomes_of_unknown_types_and_missing_sides(spark):
    kinds = ["manual_only", "legibility", "font_size", "placement", "something"]
    applied = spark.createDataFrame([(1, k, k, k, 1.0, False, "APPLIES", []) for k in kinds] + [(1, "off", "off", "legibility", 1.0, False, "INAPPLICABLE", [])], "inspection_id int, rule_id string, rule_number string, check_type string, weight double, critical boolean, applicability_kind string, fields array<string>")
    none = spark.createDataFrame([], "inspection_id int, status string, confidence double")
    fields = spark.createDataFrame([], "inspection_id int, field_name string, value string, state string, confidence double, human_absent boolean")
    quality = spark.createDataFrame([(1, "GOOD")], "inspection_id int, quality string")
    got = {r.rule_id: (r.status, r.confidence) for r in checks.outcomes(applied, fields, quality, none, none).collect()}
    assert got == {"manual_only": ("UNCERTAIN", 0.1), "legibility": ("PASS", 0.7), "font_size": ("UNCERTAIN", 0.2), "placement": ("UNCERTAIN", 0.3), "something": ("UNCERTAIN", 0.1), "off": ("NOT_APPLICABLE", 1.0)}


def test_dates_are_taken_apart_once(spark):
    df = spark.createDataFrame([('{"type": "DURATION_FROM_REFERENCE", "duration": "2 months", "reference": "PACKING_DATE"}', "2024-01-01|AMBIGUOUS", "2024-01-10", "2024-03-09"), (None, "2024-01-01", None, "2023-01-01"), ("3 weeks", "x", "", "2023-01")], "b string, m string, p string, e string")
    got = df.select(checks.date_findings(F.col("b"), F.col("m"), F.col("p"), F.lit(None).cast("string"), F.col("e")).alias("f"))
    assert [[(x.about, x.code) for x in r.f] for r in got.collect()] == [[("best_before", "CONSISTENT"), ("packing", "CONSISTENT")], [("shelf_life", "INCONSISTENT")], [("best_before", "UNVERIFIABLE")]]
    assert got._jdf.queryExecution().analyzed().toString().count("get_json_object(") <= 4


def test_readings_of_a_rule_are_looked_up_once(spark):
    facts = "array<struct<field_name:string,seen:boolean,confidence:double,conflicting:boolean,human_absent:boolean>>"
    rows = [(["a"], [("a", True, 0.7, False, None), ("a", True, 0.9, False, None)]), (["b"], [("b", False, 0.7, True, None)]), (["c"], [("c", False, 0.1, False, True)]), (["d"], [("c", True, 0.1, False, None)]), (["e"], None)]
    got = spark.createDataFrame(rows, f"asked array<string>, facts {facts}").select(rules.declared(F.lit(True), F.col("asked"), F.col("facts")).alias("r"))
    assert [tuple(r.r) for r in got.collect()] == [("PASS", 0.9), ("UNCERTAIN", 0.3), ("FAIL", 1.0), ("UNCERTAIN", 0.3), ("UNCERTAIN", 0.3)]
    assert got._jdf.queryExecution().analyzed().toString().count("array_contains(") == 1
