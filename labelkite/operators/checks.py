"""All check types in one evaluation, their view with sources, decisions after a review, and checks between readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelkite.functions.geometry import area, overlap
from labelkite.functions.text import duration_days, once
from labelkite.operators import rules, scoring

#: Providers whose addresses say nothing of the sender.
PUBLIC_MAIL = (
    "gmail", "googlemail", "yahoo", "yahoomail", "hotmail", "outlook", "live", "msn",
    "rediffmail", "rediff", "protonmail", "proton", "icloud", "me", "aol", "zoho", "yandex",
    "gmx", "mail",
)
#: Days between dates that still agree, days from making to packing, longest shelf life.
TOLERANCE, PACKING_WITHIN, LONGEST_SHELF = 45, 90, 3650
REFERENCES = ("MANUFACTURING_DATE", "PACKING_DATE", "IMPORT_DATE")


def outcomes(applied: DataFrame, fields: DataFrame, quality: DataFrame, heights: DataFrame, placed: DataFrame) -> DataFrame:
    """Status and confidence of every rule that ``rules.applicability`` gave for each inspection, by its type of check.

    ``quality``: inspection_id, quality (null: no images); ``heights`` and ``placed``: inspection_id, status, confidence.
    Each has a row for an inspection at most. A type that isn't known is undecided.
    """
    side = lambda df, name: df.select("inspection_id", F.struct("status", "confidence").alias(name))
    # one row for each inspection, so that its rules are shuffled once and meet all of it
    sides = quality.select("inspection_id", "quality").join(side(heights, "_height"), "inspection_id", "full_outer")
    sides = sides.join(side(placed, "_place"), "inspection_id", "full_outer").join(rules.field_facts(fields), "inspection_id", "full_outer")
    j = applied.join(sides, "inspection_id", "left")
    field = rules.declared(F.lit(True), F.col("fields"), F.col("facts"))
    j = j.withColumn("_field", F.when(F.col("check_type").isin(*rules.FIELD_CHECKS) & (F.size("fields") > 0), field))
    kind, q = F.col("check_type"), F.col("quality")
    q_sure = F.when(q.isin("GOOD", "ACCEPTABLE"), 0.7).when(q.isNull() | (q == "UNUSABLE"), 0.2).otherwise(0.3)

    def pick(field: Column, legible: Column, part: str, off, none, unmeasured: float | str, unplaced: float | str) -> Column:
        return (
            F.when(F.col("applicability_kind") != "APPLIES", off).when(kind.isin(*rules.FIELD_CHECKS), field).when(kind == "legibility", legible)
            .when(kind == "font_size", F.coalesce(F.col(f"_height.{part}"), F.lit(unmeasured))).when(kind == "placement", F.coalesce(F.col(f"_place.{part}"), F.lit(unplaced))).otherwise(none)
        )

    status = pick(F.col("_field.status"), rules.legibility(q), "status", "NOT_APPLICABLE", "UNCERTAIN", "UNCERTAIN", "UNCERTAIN")
    confidence = pick(F.col("_field.confidence"), q_sure, "confidence", 1.0, 0.1, 0.2, 0.3)
    return j.select("inspection_id", "rule_id", "rule_number", "check_type", "weight", "critical", "applicability_kind", status.alias("status"), confidence.alias("confidence"))


def with_sources(evaluations: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Evaluations with the reference of the first rule (by id) that bears their number; empty where none does."""
    first = rule_rows.groupBy("rule_number").agg(F.min_by("source_reference", "rule_id").alias("source_reference"))
    return evaluations.join(first, "rule_number", "left").withColumn("source_reference", F.coalesce("source_reference", F.lit("")))


def checks_view(evaluations: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """One row for each check as a reader sees it, the reference beside it and details of numbers parsed from JSON."""
    detail = F.from_json("detail", "required_mm double, detected_mm double, detected_field string")
    return with_sources(evaluations, rule_rows).withColumn("_d", detail).select(
        "inspection_id", "rule_number", "check_type", "status", "confidence", "source_reference",
        F.col("_d.required_mm").alias("required_mm"), F.col("_d.detected_mm").alias("detected_mm"), F.coalesce("_d.detected_field", F.lit("")).alias("detected_field"),
    )


def left_after_review(evaluations: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Evaluations without those that don't apply and the rules whose violation a person dismissed or resolved."""
    settled = reviewed.filter(F.col("violation_state").isin("DISMISSED", "RESOLVED")).select("inspection_id", "rule_number")
    return evaluations.filter("status <> 'NOT_APPLICABLE'").join(settled, ["inspection_id", "rule_number"], "left_anti")


def decisions_after_review(evaluations: DataFrame, reviewed: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """Decisions over what ``left_after_review`` leaves."""
    return scoring.decisions(left_after_review(evaluations, reviewed), contexts)


def corroborated(email: Column, others: Column) -> Column:
    """Whether an address' domain stands in the package's other text; public providers do, no address is null."""
    e = F.trim(email)
    core = F.nullif(F.element_at(F.split(F.lower(F.trim(F.element_at(F.split(e, "@"), -1))), r"\."), 1), F.lit(""))
    return F.when(e.contains("@") & core.isNotNull(), core.isin(*PUBLIC_MAIL) | F.regexp_replace(F.lower(F.coalesce(others, F.lit(""))), r"[^\p{L}\p{N}]", "").contains(core))


def date_findings(best_before: Column, made: Column, packed: Column, imported: Column, expires: Column) -> Column:
    """array<struct<about, code>> of what dates say of each other; dates are ISO text, ``best_before`` may be a duration.

    A duration from a reference is JSON with ``type`` DURATION_FROM_REFERENCE, ``duration`` and ``reference``. Months count
    30 days.
    """
    bare_iso = lambda c: F.replace(c, F.lit("|AMBIGUOUS"), F.lit(""))
    iso = lambda c: once(bare_iso(c), lambda x: F.when(x.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), x.try_cast("date")))
    return once(best_before, lambda text: _dated(text, iso(made), iso(packed), iso(imported), iso(expires), iso(text)))


def _dated(best_before: Column, made: Column, packed: Column, imported: Column, expires: Column, until: Column) -> Column:
    # only what has a brace can be an object
    semantic = F.when(best_before.contains("{"), F.get_json_object(best_before, "$.type") == "DURATION_FROM_REFERENCE")
    bare = F.when(best_before.rlike(r"(?i)^\s*[0-9]{1,3}\s*(months?|days?|years?|weeks?)\s*$"), best_before)
    facts = F.struct(
        made.alias("mfg"), packed.alias("pkd"), imported.alias("imp"), expires.alias("exp"), until.alias("until"),
        duration_days(F.when(semantic, F.get_json_object(best_before, "$.duration")).otherwise(bare)).alias("days"),
        F.when(semantic, F.get_json_object(best_before, "$.reference")).alias("reference"), (F.coalesce(best_before, F.lit("")) == "").alias("no_end"),
    )
    return once(facts, _findings)


def _findings(f: Column) -> Column:
    mfg, pkd, exp, days, reference = f["mfg"], f["pkd"], f["exp"], f["days"], f["reference"]
    since = F.when(reference == REFERENCES[0], mfg).when(reference == REFERENCES[1], pkd).when(reference == REFERENCES[2], f["imp"])
    code = lambda ok: F.when(ok, "CONSISTENT").otherwise("INCONSISTENT")
    near = lambda a: F.abs(F.date_diff(exp, a)) <= TOLERANCE
    referred = days.isNotNull() & (F.coalesce(reference, F.lit("")) != "")
    ends = (
        F.when(referred & since.isNotNull(), code(exp.isNull() | near(F.date_add(since, days)))).when(referred, "UNVERIFIABLE")
        .when(f["until"].isNotNull() & exp.isNotNull(), code(near(f["until"]))).when(days.isNotNull(), "UNVERIFIABLE")
    )
    gap, shelf = F.date_diff(pkd, mfg), F.date_diff(exp, mfg)
    found = (
        ("best_before", ends), ("packing", F.when(gap.isNotNull(), code((gap >= 0) & (gap <= PACKING_WITHIN)))),
        ("shelf_life", F.when(shelf.isNotNull() & f["no_end"], code((shelf > 0) & (shelf <= LONGEST_SHELF)))),
    )
    named = F.array(*[F.struct(F.lit(n).alias("about"), c.alias("code")) for n, c in found])
    return F.filter(named, lambda x: x["code"].isNotNull())


def date_code(text: Column) -> Column:
    """ISO date of the first six or eight digits that stand alone, day first; null in lines with 13 digits running.

    Such a code reads both ways, so it is always ambiguous.
    """
    code = F.regexp_extract(text, r"(?<![0-9])([0-9]{8}|[0-9]{6})(?![0-9])", 1)
    year = F.when(F.length(code) == 8, F.substring(code, 5, 4)).otherwise(F.concat(F.lit("20"), F.substring(code, 5, 2)))
    iso = F.concat_ws("-", year, F.substring(code, 3, 2), F.substring(code, 1, 2))
    date = F.to_date(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")))
    return F.when((code != "") & ~text.rlike("[0-9]{13}") & (year >= "2000") & (year <= "2100") & date.isNotNull(), iso)


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with their ``place`` from 1 on their image: rows of 12 pixels, then from left to right."""
    b = F.col("bbox")
    row = F.bround((b["y1"] + b["y2"]) / 2 / 12)
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("image_id").orderBy(row, b["x1"], "line_index")))


def in_hero(fields: DataFrame, heroes: DataFrame, least: float = 0.6) -> DataFrame:
    """Fields with ``in_hero``: at least this share of their box lies in the image's most prominent block (image_id, hero_box)."""
    j = fields.join(heroes, "image_id", "left")
    share = overlap(F.col("hero_box"), F.col("bbox")) / area(F.col("bbox"))
    return j.withColumn("in_hero", F.coalesce((share > 0) & (share >= least), F.lit(False))).drop("hero_box")


def marks_on_other_panels(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """Word marks (inspection_id, image_id, token) that start a word on another image of the inspection.

    Marks meet lines by the first character of each word, so an inspection's lines aren't paired with all of its marks. Both sides are
    shuffled: a word is a row, so they are far larger than the files by whose size a broadcast would be chosen.
    """
    key = lambda c: F.substring(c, 1, 1)
    word = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), 0), key)))
    keyed = lines.select("inspection_id", F.col("image_id").alias("_image"), F.lower("text").alias("_text"), word.alias("_key"))
    low = F.lower("token")
    asked = marks.filter("token <> ''").withColumn("_key", key(F.regexp_extract(low, "[a-z0-9]+", 0)))
    near = asked.hint("merge").join(keyed, ["inspection_id", "_key"]).filter(F.col("image_id") != F.col("_image"))
    hit = near.filter(F.expr(r"rlike(_text, concat('(?<![a-z0-9])\\Q', lower(token), '\\E'))"))
    return hit.select(*marks.columns).distinct()


def standalone_state(value: Column, conflict: Column, low_confidence: Column, inferred: Column, role_uncertain: Column, confidence: Column) -> Column:
    """State of a winner read without an inspection around it; null without a reading."""
    unsure = low_confidence | inferred | role_uncertain | (confidence < 0.55)
    return F.when(value.isNull(), None).when(conflict, "CONFLICTING").when(unsure, "UNCERTAIN").otherwise("DETECTED")


def passes_wanted(found: Column, quality: Column) -> Column:
    """At most two further passes over an image, by the fields (an array of names) that it lacks and its quality."""
    has = lambda f: F.array_contains(found, f)
    dated = F.exists(found, lambda f: f.startswith("date_"))
    wanted = (
        (~has("mrp"), "smalltext"), (~dated, "thresholded"), (~has("net_quantity"), "upscaled"),
        (~has("fssai_license") & ~has("consumer_care_phone"), "smalltext"), (quality.isin("POOR", "UNUSABLE"), "denoised"),
    )
    return F.slice(F.array_compact(F.array(*[F.when(c, name) for c, name in wanted])), 1, 2)
