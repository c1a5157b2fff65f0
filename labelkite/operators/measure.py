"""Letter heights in millimetres: scale, panel area, measured declarations, the check against the table, calibration.

Inspections: ``inspection_id calibration_px_per_mm calibration_source panel_width_mm panel_height_mm pdp_area_cm2 family
moulded``; images: ``inspection_id image_id role width height dpi``; declarations: ``inspection_id field_name text bbox``,
with the box as a struct. All joins are on the inspection, against sides with one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelkite.operators.rules import BORDERLINE, required_heights

#: Capitals as a share of a line's height, least resolution that tells of the capture, views of a panel,
#: least width of a letter as a share of its height, and how far an estimate of it may fall short.
CAP_HEIGHT_RATIO = 0.75
LEAST_DPI = 100.0
PANEL_VIEWS = ("FRONT", "CLOSE_UP")
LEAST_WIDTH_RATIO = 1.0 / 3.0
WIDTH_SLACK = 0.8


def number_text(x: Column) -> Column:
    """Whole numbers without a point, others with at most six digits that count."""
    short = F.regexp_replace(F.format_string("%.6g", x), r"(\.[0-9]*?)0+$", "$1")
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(F.regexp_replace(short, r"\.$", ""))


def scales(inspections: DataFrame, images: DataFrame) -> DataFrame:
    """``inspections`` with ``px_per_mm`` and ``scale_source``: what a person gave, else the first image that tells its resolution."""
    told = images.filter(F.col("dpi") >= LEAST_DPI).groupBy("inspection_id").agg(F.min_by("dpi", "image_id").alias("_dpi"))
    manual = F.col("calibration_px_per_mm") > 0
    source = (
        F.when(manual, F.coalesce(F.nullif("calibration_source", F.lit("")), F.lit("manual_calibration")))
        .when(F.col("_dpi").isNotNull(), F.concat(F.lit("image_dpi("), number_text(F.col("_dpi")), F.lit(")")))
        .otherwise("UNAVAILABLE")
    )
    px = F.when(manual, F.col("calibration_px_per_mm").cast("double")).otherwise(F.col("_dpi") / 25.4)
    return inspections.join(told, "inspection_id", "left").withColumns({"px_per_mm": px, "scale_source": source}).drop("_dpi")


def panel_areas(scaled: DataFrame, images: DataFrame) -> DataFrame:
    """``scaled`` with ``area_cm2`` and ``area_source``: measured sides, else an entered area, else the panel's image, else none."""
    order = F.struct((~F.coalesce(F.upper("role").isin(*PANEL_VIEWS), F.lit(False))).alias("other"), "image_id")
    panel = images.groupBy("inspection_id").agg(F.min_by(F.struct("width", "height"), order).alias("_panel"))
    w, h, px = F.col("_panel.width"), F.col("_panel.height"), F.col("px_per_mm")
    measured = (F.col("panel_width_mm") > 0) & (F.col("panel_height_mm") > 0)
    entered, seen = F.col("pdp_area_cm2") > 0, (px > 0) & (w > 0) & (h > 0)
    area = (
        F.when(measured, F.bround(F.col("panel_width_mm") * F.col("panel_height_mm") / 100, 2))
        .when(entered, F.bround(F.col("pdp_area_cm2").cast("double"), 2))
        .when(seen, F.bround((w / px / 10) * (h / px / 10), 2))
    )
    source = F.when(measured, "measured").when(entered, "entered").when(seen, "estimated").otherwise("unavailable")
    return scaled.join(panel, "inspection_id", "left").withColumns({"area_cm2": area, "area_source": source}).drop("_panel")


def measurements(declarations: DataFrame, scaled: DataFrame) -> DataFrame:
    """Height and width ratio of the letters of each declaration that has a box and a scale."""
    b = F.col("bbox")
    boxed = declarations.filter((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    px = F.col("px_per_mm")
    high = F.bround((b["y2"] - b["y1"]) / px * CAP_HEIGHT_RATIO, 2)
    n = F.char_length(F.trim("text"))
    wide = F.when(n > 0, F.bround((b["x2"] - b["x1"]) / n / px, 3))
    joined = boxed.join(scaled.select("inspection_id", "px_per_mm").filter("px_per_mm > 0"), "inspection_id")
    out = joined.select("inspection_id", "field_name", "text", (b["y2"] - b["y1"]).alias("line_height_px"), high.alias("letter_height_mm"), wide.alias("char_width_mm"))
    return out.withColumn("width_ratio", F.when(F.col("letter_height_mm") > 0, F.bround(F.col("char_width_mm") / F.col("letter_height_mm"), 3)))


def height_checks(paneled: DataFrame, measured: DataFrame) -> DataFrame:
    """The letter-height check of each inspection, with what it rests on.

    Undecided without a scale, a family of quantities, an area or a measurement; where the area is only an estimate a
    failure needs to fall below what the next smaller panel asks for.
    """
    least = F.min(F.struct("letter_height_mm", "field_name"))
    facts = measured.groupBy("inspection_id").agg(least.alias("_least"), F.min(F.when(F.col("width_ratio") > 0, F.col("width_ratio"))).alias("_ratio"), F.count("*").alias("_n"))
    asked = required_heights(paneled)
    j = asked.join(facts, "inspection_id", "left")
    estimated = F.col("area_source") == "estimated"
    floor = F.when(estimated & (F.col("lower_mm") > 0), F.col("lower_mm")).otherwise(F.col("required_mm"))
    seen, need = F.col("_least.letter_height_mm"), F.col("required_mm")
    ready = F.coalesce(F.col("px_per_mm") > 0, F.lit(False)) & F.col("family").isNotNull() & F.col("area_cm2").isNotNull() & need.isNotNull() & seen.isNotNull()
    status = F.when(~ready, "UNCERTAIN").when(seen >= need, "PASS").when(seen < floor * BORDERLINE, "FAIL").otherwise("UNCERTAIN")
    sure = F.when(F.col("area_source").isin("measured", "entered"), 0.75).otherwise(0.55)
    confidence = F.when(~F.coalesce(F.col("px_per_mm") > 0, F.lit(False)), 0.2).when(~ready, 0.3).when(seen >= need, sure).when(seen < floor * BORDERLINE, 0.6).otherwise(0.4)
    known = F.col("px_per_mm").isNotNull() & F.col("family").isNotNull()
    return j.select(
        "inspection_id", "scale_source", "px_per_mm", "area_cm2", "area_source", "family", F.when(known, need).alias("required_mm"), F.when(ready, floor).alias("floor_mm"),
        seen.alias("detected_mm"), F.col("_least.field_name").alias("detected_field"), F.coalesce("_n", F.lit(0)).alias("n_measured"),
        (F.col("_ratio") >= LEAST_WIDTH_RATIO * WIDTH_SLACK).alias("width_ok"), status.alias("status"), confidence.alias("confidence"),
    )


def calibrated(inspections: DataFrame, updates: DataFrame) -> DataFrame:
    """``inspections`` with the latest valid calibration laid over them.

    ``updates``: inspection_id, updated_at, px_per_mm, reference_px, reference_mm, panel_width_mm, panel_height_mm,
    pdp_area_cm2, moulded. One without a scale, both sides or an area is not valid, nor is a scale or reference of zero or
    less; a valid one replaces sides and area also by nothing, and names its source only where it has a scale.
    """
    px, ref_px, ref_mm = F.col("px_per_mm"), F.col("reference_px"), F.col("reference_mm")
    by_reference = px.isNull() & (ref_px != 0) & (ref_mm != 0)
    scale = F.when(px.isNotNull(), px).when(by_reference, ref_px / ref_mm)
    sound = F.coalesce(scale > 0, F.lit(True)) & ~F.coalesce(by_reference & ((ref_px <= 0) | (ref_mm <= 0)), F.lit(False))
    some = scale.isNotNull() | ((F.col("panel_width_mm") != 0) & (F.col("panel_height_mm") != 0)) | (F.col("pdp_area_cm2") != 0)
    source = F.when(px.isNotNull(), "manual_px_per_mm").when(by_reference, F.concat(F.lit("reference_length("), number_text(ref_mm), F.lit(" mm, "), number_text(ref_px), F.lit(" px)")))
    valid = updates.filter(sound & F.coalesce(some, F.lit(False)))
    facts = F.struct("updated_at", scale.alias("px"), source.alias("source"), "panel_width_mm", "panel_height_mm", "pdp_area_cm2", "moulded")
    last = valid.groupBy("inspection_id").agg(F.max_by(facts, "updated_at").alias("_u"))
    over = lambda name, field: F.when(F.col("_u").isNotNull(), F.col(f"_u.{field}")).otherwise(F.col(name))
    new = {c: over(c, c) for c in ("panel_width_mm", "panel_height_mm", "pdp_area_cm2")} | {"calibration_px_per_mm": over("calibration_px_per_mm", "px")}
    new |= {"calibration_source": F.coalesce("_u.source", "calibration_source"), "moulded": F.coalesce("_u.moulded", "moulded")}
    return inspections.join(last, "inspection_id", "left").withColumns(new).drop("_u")


def prominence(line_height: Column, image_height: Column, contrast: Column, confidence: Column) -> Column:
    """How much a block stands out: a line of 4 % of the image counts as fully high."""
    high = F.least(F.lit(1.0), line_height / F.greatest(F.lit(1.0), image_height.cast("double")) / 0.04)
    return F.bround(0.5 * high + 0.25 * F.least(F.lit(1.0), contrast) + 0.25 * confidence, 3)


def readability(n_lines: Column, n_visible: Column, sharpness: Column, contrast: Column, glare: Column) -> Column:
    """READABLE, MARGINAL or UNREADABLE by the share of lines read with confidence 0.6 and the image's metrics."""
    share = F.bround(n_visible / F.nullif(n_lines, F.lit(0)), 3)
    clear = (share >= 0.6) & (sharpness >= 40) & (contrast >= 0.15) & (glare <= 0.25)
    return F.when(clear, "READABLE").when(share >= 0.3, "MARGINAL").otherwise("UNREADABLE")


def asked_area(question: Column) -> Column:
    """The area in square cm that a question names."""
    return F.regexp_extract(F.lower(question), r"([0-9]+(?:\.[0-9]+)?)\s*(?:cm\s*[²2]|sq\.?\s*cm|square\s*cm)", 1).try_cast("double")


def heights_for_questions(questions: DataFrame) -> DataFrame:
    """``questions`` (question_id, question) with the area they name and the heights it asks for, printed and moulded."""
    q = F.lower("question")
    counted = F.lit(False)
    for word in ("number", "pieces", "pcs", "length", "area", "metre", "meter"):
        counted = counted | q.contains(word)
    asked = questions.select("question_id", asked_area(F.col("question")).alias("area_cm2"), F.when(counted, "NUMBER").otherwise("MASS").alias("family"))
    both = asked.withColumn("moulded", F.explode(F.array(F.lit(False), F.lit(True))))
    need = required_heights(both).groupBy("question_id", "area_cm2", "family")
    return need.agg(F.max(F.when(~F.col("moulded"), F.col("required_mm"))).alias("printed_mm"), F.max(F.when(F.col("moulded"), F.col("required_mm"))).alias("moulded_mm"))
